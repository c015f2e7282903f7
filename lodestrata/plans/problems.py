"""Queries of the general training-data problems (4, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import packed, profile, units
from lodestrata.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack(table(spark, sf_dir, "companies"), "id", "email", "source_tokens")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.read_quantities(table(spark, sf_dir, "enrichment_aiark"), "row_id", ["employee_count", "revenue"], "description", table(spark, sf_dir, "fx_rates"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [profile.phone_rule(), profile.year_rule(), profile.website_rule()]
    return profile.quality_issues(table(spark, sf_dir, "enrichment_aiark"), "load_id", "row_id", rules)


PATTERNED = ["phone", "founded_year", "website"]
# Columns of enrichment_aiark without a pattern of their own.
TEXTS = ["company_name", "domain", "linkedin_url", "industry", "employee_count", "city", "state", "country", "description", "revenue"]


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [profile.phone_rule(), profile.year_rule(), profile.website_rule(), *map(profile.text_rule, TEXTS)]
    return profile.profile(profile.classified(table(spark, sf_dir, "enrichment_aiark"), "load_id", "row_id", rules))


def p7_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of two halves of the rows, kept apart until their sums are merged."""
    rules = [profile.phone_rule(), profile.year_rule(), profile.website_rule(), *map(profile.text_rule, TEXTS)]
    cells = profile.classified(table(spark, sf_dir, "enrichment_aiark"), "load_id", "row_id", rules)
    odd = F.col("row_id") % 2 == 1
    counts = [profile.value_counts(cells.where(part)) for part in (odd, ~odd)]
    sums = profile.power_sums(counts[0]).unionByName(profile.power_sums(counts[1]))
    every = counts[0].unionByName(counts[1]).groupBy("load_id", "column_name", "value", "class").agg(F.sum("n").alias("n"))
    distinct = every.groupBy("load_id", "column_name").agg(F.count(F.when(F.col("class") != "missing", F.col("value"))).alias("n_distinct"))
    return profile.described(profile.merged_sums(sums, distinct))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p7_profile": p7_profile, "p7_merged": p7_merged}

def _cells(columns: list[str]) -> str:
    return "cells AS (" + " UNION ALL ".join(f"SELECT load_id, row_id, '{c}' AS column_name, {c} AS v FROM enrichment_aiark" for c in columns) + ")"


_JUDGED = """marked AS (
  SELECT *, v IS NULL OR regexp_replace(v, '[\\s\\x{00A0}]', '', 'g') IN ('', '-') AS gone,
    regexp_replace(regexp_replace(v, '[ .\\-/()]*(x|X|ext|Ext|EXT)\\.?[ .]*[0-9]+$', ''), '[^0-9]', '', 'g') AS digits
  FROM cells
), judged AS (
  SELECT *, CASE column_name
    WHEN 'phone' THEN regexp_full_match(v, '\\+?[ .\\-/()]*[0-9]([ .\\-/()]*[0-9]){6,14}[ .\\-/()]*((x|X|ext|Ext|EXT)\\.?[ .]*[0-9]+)?') AND replace(digits, substr(digits, 1, 1), '') <> ''
    WHEN 'founded_year' THEN regexp_full_match(v, '1[89][0-9]{2}|20[01][0-9]|202[0-5]')
    WHEN 'website' THEN regexp_full_match(v, '(?i:https?://)?[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+(:[0-9]+)?([/?].*)?') ELSE TRUE END AS good
  FROM marked
)"""

ORACLES = {
    "p7_profile": f"""WITH {_cells([*PATTERNED, *TEXTS])}, {_JUDGED}, num AS (
  SELECT *, CASE WHEN NOT gone AND good THEN CASE column_name WHEN 'phone' THEN length(digits) WHEN 'founded_year' THEN CAST(v AS BIGINT) ELSE length(v) END END AS x, CASE WHEN NOT gone THEN v END AS f FROM judged
), s AS (SELECT load_id, column_name, count(*) AS n_rows, count(*) FILTER (gone) AS n_missing, count(*) FILTER (NOT gone AND NOT good) AS n_bad, count(DISTINCT f) AS n_distinct,
    min(f) AS min_value, max(f) AS max_value, count(x) AS s0, coalesce(sum(x), 0)::DOUBLE AS s1, coalesce(sum(x * x), 0)::DOUBLE AS s2 FROM num GROUP BY ALL
), r AS (SELECT *, sum(s0) OVER w - s0 AS r0, sum(s1) OVER w - s1 AS r1, sum(s2) OVER w - s2 AS r2 FROM s WINDOW w AS (PARTITION BY column_name)
), m AS (SELECT *, s1 / nullif(s0, 0) AS mu, s2 / nullif(s0, 0) - (s1 / nullif(s0, 0)) ** 2 AS var, r1 / nullif(r0, 0) AS rmu, r2 / nullif(r0, 0) - (r1 / nullif(r0, 0)) ** 2 AS rvar FROM r)
SELECT load_id, column_name, n_rows, n_missing, n_bad, n_distinct, min_value, max_value, round(mu, 3) AS mean, round(sqrt(greatest(var, 0)), 3) AS stddev,
  CASE WHEN (var + rvar) / 2 > 1e-9 THEN round((mu - rmu) / sqrt((var + rvar) / 2), 3) END AS std_difference FROM m""",
    "p7_found": f"""WITH {_cells(PATTERNED)}, {_JUDGED}, classed AS (
  SELECT load_id, column_name, CASE WHEN gone THEN 'missing' WHEN NOT good THEN 'bad'
    WHEN column_name = 'phone' THEN CASE WHEN v LIKE '+%' THEN '+' || regexp_extract(v, '^\\+[ .\\-/()]*([0-9])', 1) ELSE 'no plus' END
    WHEN column_name = 'founded_year' THEN substr(v, 1, 3)
    ELSE CASE WHEN lower(v) LIKE 'https://%' THEN 'https' WHEN lower(v) LIKE 'http://%' THEN 'http' ELSE 'none' END END AS k
  FROM judged
), n AS (SELECT load_id, column_name, k, count(*) AS n FROM classed GROUP BY ALL),
grid AS (SELECT l.load_id, c.column_name, c.k FROM (SELECT DISTINCT load_id FROM n) l, (SELECT DISTINCT column_name, k FROM n) c),
f AS (SELECT g.*, coalesce(n.n, 0) AS n,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.load_id, g.column_name) AS ln,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.column_name, g.k) AS kn,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.column_name) AS an
  FROM grid g LEFT JOIN n USING (load_id, column_name, k))
SELECT load_id, CAST(row_id AS BIGINT) AS row_id, column_name, 'bad_value' AS issue FROM judged WHERE NOT gone AND NOT good
UNION SELECT load_id, CAST(0 AS BIGINT), column_name, 'shift' FROM f WHERE an > ln GROUP BY load_id, column_name
  HAVING sum(abs(n / ln - (kn - n) / (an - ln))) / 2 > 0.4""",
}
ORACLES["p7_merged"] = ORACLES["p7_profile"]
