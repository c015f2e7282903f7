"""Facet counts in one pass: each facet honours every filter but its own.

A row counts for facet d if no facet filter rejects it, or only d's own does. So each row is exploded once into
the (facet, value) pairs it counts for, and one aggregation with map-side combining counts them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import filters as X


def counts(df: DataFrame, f: X.Filters, dims: tuple[X.Dimension, ...], search_columns: tuple[str, ...]) -> DataFrame:
    """dim, id, n for every value of every facet. Null values (and empty ones where a facet skips them) are not counted."""
    passes = X.dimension_passes(f, dims)
    fails = reduce(lambda a, b: a + b, [(~p).cast("int") for p in passes.values()], F.lit(0))

    def values(d: X.Dimension) -> Column:
        c = F.col(d.column)
        vals = F.coalesce(c, F.array().cast("array<string>")) if d.many else F.array(c.cast("string"))
        vals = F.filter(vals, lambda x: x.isNotNull() & (x != "") if d.skip_empty else x.isNotNull())
        counted = F.col("_fails") == 0
        if d.name in passes:
            counted = counted | ((F.col("_fails") == 1) & ~F.col(f"_{d.name}"))
        return F.when(counted, F.transform(vals, lambda x: F.struct(F.lit(d.name).alias("dim"), x.alias("id")))).otherwise(F.array().cast("array<struct<dim:string,id:string>>"))

    rows = X.with_data(df, f).where(X.base(f, search_columns)).withColumn("_fails", fails)
    for name, p in passes.items():
        rows = rows.withColumn(f"_{name}", p)
    if passes:
        rows = rows.where("_fails <= 1")
    pairs = rows.select(F.explode(F.flatten(F.array(*[values(d) for d in dims]))).alias("x")).select("x.dim", "x.id")
    return pairs.groupBy("dim", "id").agg(F.count("*").alias("n"))


def company_facets(df: DataFrame, f: X.Filters | None = None) -> DataFrame:
    return counts(df, f or X.Filters(), X.COMPANY_DIMENSIONS, ("company_name", "domain"))


def person_facets(df: DataFrame, f: X.Filters | None = None) -> DataFrame:
    return counts(df, f or X.Filters(), X.PERSON_DIMENSIONS, ("full_name", "email"))


def ranked(facets: DataFrame, top: int | None = None) -> DataFrame:
    """Facets with the rank of each value in its facet: by count, then by id; of each facet the first top ones, if given.

    With a limit every task keeps its own first values only, so a facet of any number of values costs little.
    """
    out = facets.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "id")))
    return out if top is None else out.where(F.col("rank") <= top)


def top_and_other(facets: DataFrame, top: int = 5) -> DataFrame:
    """The first values of each facet and the sum of the others as 'other' (if any), with their share of the facet.

    Only the first ranks are asked of the window, so it keeps no more than these of any facet.
    """
    first = ranked(facets, top).select("dim", "id", "n")
    total = facets.groupBy("dim").agg(F.sum("n").alias("total"))
    rest = total.join(first.groupBy("dim").agg(F.sum("n").alias("head")), "dim").select("dim", F.lit("other").alias("id"), (F.col("total") - F.col("head")).alias("n")).where("n > 0")
    both = first.unionByName(rest).groupBy("dim", "id").agg(F.sum("n").alias("n"))  # a value may itself be called other
    return both.join(total, "dim").select("dim", "id", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def percent_of_max(facets: DataFrame, top: int = 6, least: float = 4.0) -> DataFrame:
    """The first values of each facet with their length as a bar: percent of the longest, at least a little."""
    r = ranked(facets).where(F.col("rank") <= top)
    return r.withColumn("percent", F.round(F.greatest(F.lit(least), F.col("n") * 100.0 / F.max("n").over(Window.partitionBy("dim"))), 6))


def as_json(facets: DataFrame, top: int | None = None) -> DataFrame:
    """One row a facet: its values as JSON [{id, count}], most frequent first; the first top ones, if given.

    The whole of a facet is one text, so facets of many values need a limit.
    """
    facets = facets if top is None else ranked(facets, top)
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "id")))
    one = facets.groupBy("dim").agg(items.alias("v"))
    return one.select("dim", F.to_json(F.transform("v", lambda x: F.struct(x["id"].alias("id"), (-x["k"]).alias("count")))).alias("values"))
