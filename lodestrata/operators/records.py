"""Lookups, embeds and histories of imports and deliveries, and the checks a row passes before it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.functions import jsonval as J


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """The row of an id, or none."""
    return df.where(F.col("id") == F.lit(id_)).limit(1)


def with_total(page: DataFrame, df: DataFrame) -> DataFrame:
    """A page with the exact number of rows it is taken from; an empty page has none."""
    return page.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def page_after(df: DataFrame, last: tuple[object, str] | None, size: int = 50) -> DataFrame:
    """The page after a row given by its (last_updated, id), in the lists' order: only size rows are ever kept.

    Deep pages cost no more than the first one, unlike an offset. None gives the first page.
    """
    order = [F.desc_nulls_last("last_updated"), F.asc("id")]
    if last is not None:
        when, id_ = last
        same = F.col("last_updated").eqNullSafe(F.lit(when).cast("timestamp")) & (F.col("id") > F.lit(id_))
        later = F.lit(False) if when is None else F.col("last_updated").isNull() | (F.col("last_updated") < F.lit(when))
        df = df.where(same | later)
    return df.orderBy(*order).limit(size)


def drawer(people: DataFrame, company_id: str, most: int = 500) -> DataFrame:
    """The people of a company by name, unknown names last, then by id."""
    return people.where(F.col("company_id") == F.lit(company_id)).orderBy(F.asc_nulls_last("full_name"), "id").limit(most)


def delivered(df: DataFrame, records: DataFrame, outcome: str | None = None) -> DataFrame:
    """The rows that a job's records name, with one outcome or any. records(person_id, outcome)."""
    some = records if outcome is None else records.where(F.col("outcome") == outcome)
    return df.join(some.select(F.col("person_id").alias("id")).distinct(), "id", "left_semi")


def companies_of_records(people: DataFrame, records: DataFrame, outcome: str | None = None) -> DataFrame:
    """company_id: the companies of the people that a job's records name, each once."""
    return delivered(people, records, outcome).where("company_id IS NOT NULL").select("company_id").distinct()


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """df with the label of its key, the key itself where there is none. labels(key, label): one row a key."""
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, key))


def outcomes(wanted: DataFrame, earlier: DataFrame) -> DataFrame:
    """wanted with outcome: updated where earlier deliveries of the same person, client and platform exist, else created."""
    keys = ["person_id", "client_id", "platform"]
    return wanted.join(earlier.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left").withColumn("outcome", F.when(F.col("_old"), "updated").otherwise("created")).drop("_old")


def failure_sentence(reason: Column) -> Column:
    """What a database's error code means, in words."""
    column = F.replace(F.regexp_extract(reason, r'^23502:.*column "([^"]+)"', 1), F.lit("_"), F.lit(" "))
    return (
        F.when(reason.rlike(r'^23502:.*column "[^"]+"'), F.concat(F.lit('Missing a required value for "'), column, F.lit('".')))
        .when(reason.startswith("23505:"), "Duplicate record — a matching row already exists.")
        .when(reason.startswith("23503:"), "Refers to a related record that doesn't exist.")
        .when(reason.startswith("22P02:"), "One or more values were in an unexpected format.")
        .when(reason.contains("_import_error") | reason.rlike(r"(?i)^import (was )?(stopped|interrupted)"), "The import was interrupted before this record could be saved.")
        .otherwise("This record couldn't be saved due to an unexpected error.")
    )


def failures(history: DataFrame) -> DataFrame:
    """message, n: failed records of all imports by the reason in words. Unreadable lists have none."""
    each = history.select(F.explode(F.try_variant_get(J.parsed(F.col("failed_records")), "$", "array<variant>")).alias("r"))
    raw = F.coalesce(*[J.text(J.value(F.col("r"), k)) for k in ("_failure_reason", "reason", "_import_error")])
    return each.select(failure_sentence(raw).alias("message")).groupBy("message").agg(F.count("*").alias("n"))


def many_failed(failed: Column, total: Column) -> Column:
    """Whether so many rows failed that it should be told: ten and a tenth of all."""
    return (failed >= 10) & (failed / F.greatest(total, F.lit(1)) >= 0.1)


def checked(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, the others with reasons: the names of the rules they break). A null verdict passes."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def import_summary(rows: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: input, deduped, inserted, updated, failed of an import. kept has the flag exists."""
    a = rows.agg(F.count("*").alias("input_count"))
    b = kept.agg(F.count("*").alias("deduped_count"), F.count_if(~F.col("exists")).alias("inserted_count"), F.count_if("exists").alias("updated_count"))
    c = rejected.agg(F.count("*").alias("failed_count"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def link_by_domain(people: DataFrame, companies: DataFrame) -> DataFrame:
    """People with company_id set to the company of their domain; of companies with one domain the last by id counts.

    People without a domain, or with one that no company has, keep the company they have.
    """
    at = companies.select(C.normalize_domain(F.col("domain")).alias("_d"), "id").where("_d IS NOT NULL").groupBy("_d").agg(F.max("id").alias("_c"))
    j = people.withColumn("_d", C.normalize_domain(F.col("domain"))).join(at, "_d", "left")
    return j.withColumn("company_id", F.coalesce("_c", "company_id")).drop("_d", "_c")
