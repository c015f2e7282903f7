"""Column-level data quality profile of a table, load by load.

Everything that leaves the first aggregation is mergeable: counts, minima, maxima, and exact decimal power
sums of a numeric view of every column. Means, variances and the standardised difference between a load and
all other loads come from the merged sums, so a profile of new loads can be added to a stored one. Hot loads
are harmless, since partial aggregation precedes the only shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What the statement of the problem calls good.
PHONE = r"^\+?[ .\-/()]*[0-9]([ .\-/()]*[0-9]){6,14}[ .\-/()]*((x|X|ext|Ext|EXT)\.?[ .]*[0-9]+)?$"
PHONE_TAIL = r"[ .\-/()]*(x|X|ext|Ext|EXT)\.?[ .]*[0-9]+$"
YEAR = r"^(1[89][0-9][0-9]|20[01][0-9]|202[0-5])$"
WEBSITE = r"^([hH][tT][tT][pP][sS]?://)?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?([/?].*)?$"
SHIFT_ABOVE = 0.4


def missing(c: Column) -> Column:
    """Null, empty, blank or a lone dash."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", "").isin("", "-"), F.lit(True))


@dataclass(frozen=True)
class ColumnRule:
    """How one column is judged: which values are good, their class, and its numeric view."""

    name: str
    good: Column
    klass: Column
    number: Column


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, PHONE_TAIL, ""), r"[^0-9]", "")


def phone_rule(name: str = "phone", c: Column | None = None) -> ColumnRule:
    """Optional plus, 7 to 15 digits that are not all the same, optionally an extension."""
    c = F.col("value") if c is None else c
    digits = _digits(c)
    good = c.rlike(PHONE) & ~digits.rlike(r"^([0-9])\1*$")
    first = F.regexp_extract(c, r"^\+[ .\-/()]*([0-9])", 1)
    return ColumnRule(name, good, F.when(c.startswith("+"), F.concat(F.lit("+"), first)).otherwise("no plus"), F.length(digits).cast("decimal(18,0)"))


def year_rule(name: str = "founded_year", c: Column | None = None) -> ColumnRule:
    """Four digits from 1800 to 2025; classes are decades."""
    c = F.col("value") if c is None else c
    return ColumnRule(name, c.rlike(YEAR), F.substring(c, 1, 3), F.expr("try_cast(value AS decimal(18,0))"))


def website_rule(name: str = "website", c: Column | None = None) -> ColumnRule:
    """Optional scheme and a host of two or more labels; classes are schemes."""
    c = F.col("value") if c is None else c
    low = F.lower(c)
    klass = F.when(low.startswith("https://"), "https").when(low.startswith("http://"), "http").otherwise("no scheme")
    return ColumnRule(name, c.rlike(WEBSITE), klass, F.length(c).cast("decimal(18,0)"))


def text_rule(name: str) -> ColumnRule:
    """Any column without a pattern of its own: nothing is bad, the numeric view is the length."""
    return ColumnRule(name, F.lit(True), F.lit("good"), F.length("value").cast("decimal(18,0)"))


def classified(df: DataFrame, load: str, key: str, rules: list[ColumnRule]) -> DataFrame:
    """One row per cell: load_id, row_id, column_name, value, class ('missing', 'bad' or 'good:...'), number.

    Null cells are missing; null loads form a load of their own; extra columns of df are not read.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(r.name).alias("column_name"), F.col(r.name).cast("string").alias("value")) for r in rules]))
    cells = df.select(F.col(load).alias("load_id"), F.col(key).alias("row_id"), cells.alias("c")).select("load_id", "row_id", "c.column_name", "c.value")
    # One outer branch a column: the branches that do not apply are never evaluated.
    klass, number = F.lit(None), F.lit(None).cast("decimal(18,0)")
    for r in rules:
        here = F.col("column_name") == r.name
        klass = F.when(here, F.when(r.good, F.concat(F.lit("good:"), r.klass)).otherwise("bad")).otherwise(klass)
        number = F.when(here & r.good, r.number).otherwise(number)
    gone = missing(F.col("value"))
    return cells.withColumn("class", F.when(gone, F.lit("missing")).otherwise(klass)).withColumn("number", F.when(~gone, number))


def class_shifts(cells: DataFrame, above: float = SHIFT_ABOVE) -> DataFrame:
    """load_id, column_name, distance: half the L1 distance of a load's class shares to those of all others.

    Loads without any other load to compare with have no distance (null). Counts are merged first, so the
    windows below see one row per load, column and class.
    """
    n = cells.groupBy("load_id", "column_name", "class").agg(F.count("*").alias("n"))
    total = n.groupBy("column_name", "class").agg(F.sum("n").alias("all_n"))
    loads = n.groupBy("load_id", "column_name").agg(F.sum("n").alias("load_n"))
    loads = loads.withColumn("all_rows", F.sum("load_n").over(Window.partitionBy("column_name")))
    # Every class of the column, also those that the load lacks: L1 = sum over own classes + share of the rest.
    own = n.join(total, ["column_name", "class"]).join(loads.select(F.col("load_id").alias("l2"), F.col("column_name").alias("c2"), "load_n", "all_rows"), F.col("load_id").eqNullSafe(F.col("l2")) & (F.col("column_name") == F.col("c2")))
    rest = F.col("all_n") - F.col("n")
    others = F.col("all_rows") - F.col("load_n")
    own = own.where(others > 0).withColumn("p", F.col("n") / F.col("load_n")).withColumn("q", rest / others)
    # Half the L1 distance of two distributions is the sum of the positive parts of p - q; absent classes add none.
    return own.groupBy("load_id", "column_name").agg(F.sum(F.greatest(F.col("p") - F.col("q"), F.lit(0.0))).alias("distance")).withColumn("shifted", F.col("distance") > above)


def value_counts(cells: DataFrame) -> DataFrame:
    """load_id, column_name, value, class, number, n: distinct values. Those of two parts of a load are merged by adding n."""
    return cells.groupBy("load_id", "column_name", "value", "class", "number").agg(F.count("*").alias("n"))


def power_sums(counts: DataFrame) -> DataFrame:
    """One row per load and column: counts, ranges and the exact power sums s0, s1, s2 of the numeric view.

    counts: see value_counts. All but n_distinct of two parts merge by sum, min and max (merged_sums).
    """
    num, n = F.col("number").cast("decimal(18,0)"), F.col("n").cast("decimal(18,0)")
    filled = F.when(F.col("class") != "missing", F.col("value"))
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("class") == "missing", F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("class") == "bad", F.col("n")).otherwise(0)).alias("n_bad"),
        F.count(filled).alias("n_distinct"),
        F.min(filled).alias("min_value"),
        F.max(filled).alias("max_value"),
        F.sum(F.when(num.isNotNull(), F.col("n")).otherwise(0)).alias("s0"),
        total(num * n).alias("s1"),
        total((num * num).cast("decimal(38,0)") * n).alias("s2"),
    )


def merged_sums(sums: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Power sums of parts merged into those of the whole. distinct(load_id, column_name, n_distinct): counted over the
    merged value_counts, as the number of distinct values alone does not add up; null without it."""
    add, top = ["n_rows", "n_missing", "n_bad", "s0", "s1", "s2"], F.max("max_value").alias("max_value")
    out = sums.groupBy("load_id", "column_name").agg(*[F.sum(c).alias(c) for c in add], F.min("min_value").alias("min_value"), top)
    for c in ("s1", "s2"):
        out = out.withColumn(c, F.col(c).cast("decimal(38,0)"))
    if distinct is None:
        return out.withColumn("n_distinct", F.lit(None).cast("bigint"))
    d = distinct.select(F.col("load_id").alias("_l"), F.col("column_name").alias("_c"), "n_distinct")
    return out.join(d, F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")


def described(sums: DataFrame) -> DataFrame:
    """The profile that power sums give: means, deviations and the standardised difference to all other loads."""
    w = Window.partitionBy("column_name")
    for s in ("s0", "s1", "s2"):
        sums = sums.withColumn(f"r_{s}", (F.sum(s).over(w) - F.col(s)))

    def mean(p: str) -> Column:
        return F.expr(f"try_divide(cast({p}s1 as double), cast({p}s0 as double))")

    def var(p: str) -> Column:
        return F.expr(f"try_divide(cast({p}s2 as double), cast({p}s0 as double))") - mean(p) * mean(p)

    pooled = (var("") + var("r_")) / 2
    diff = F.when(pooled > 1e-9, (mean("") - mean("r_")) / F.sqrt(pooled))
    return sums.select(
        "load_id", "column_name", "n_rows", "n_missing", "n_bad", "n_distinct", "min_value", "max_value",
        F.round(mean(""), 3).alias("mean"), F.round(F.sqrt(F.greatest(var(""), F.lit(0.0))), 3).alias("stddev"), F.round(diff, 3).alias("std_difference"),
    )


def profile(cells: DataFrame) -> DataFrame:
    """One row per load and column: counts, ranges, means, deviations and the standardised difference to the rest.

    Distinct values are grouped first, so a value that fills a third of the table costs one row a task.
    """
    return described(power_sums(value_counts(cells)))


def quality_issues(df: DataFrame, load: str, key: str, rules: list[ColumnRule], above: float = SHIFT_ABOVE) -> DataFrame:
    """load_id, row_id, column_name, issue: every bad value, and every load whose class shares are shifted."""
    cells = classified(df, load, key, rules)
    bad = cells.where(F.col("class") == "bad").select("load_id", "row_id", "column_name", F.lit("bad_value").alias("issue"))
    moved = class_shifts(cells, above).where("shifted").select("load_id", F.lit(0).cast("bigint").alias("row_id"), "column_name", F.lit("shift").alias("issue"))
    return bad.unionByName(moved).distinct()
