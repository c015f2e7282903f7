"""CSV in and out, whatever lies in the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import jsonval as J


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of CSV files with a header: quotes, doubled quotes and line ends in cells; blank records go, missing cells are ''."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path).na.fill("")
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.trim(F.col(f"`{c}`")) != "")
    return df.where(filled)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quoted where a cell needs it, by as many tasks as df has partitions."""
    df.write.options(header=True, quote='"', escape='"', emptyValue="").mode("overwrite").csv(path)


def flat(v: Column) -> Column:
    """A JSON value as a cell: nothing for null, lists joined by ', ', objects as JSON, else its text."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.coalesce(F.when(J.tag(v) == "array", F.array_join(items, ", ")).otherwise(J.text(v)), F.lit(""))


def export(df: DataFrame, fixed: list[str], order: str = "id") -> DataFrame:
    """Fixed columns, then one column an attribute key in order of first appearance.

    The keys of a table are few by contract: they become columns, of which there are 5,000 at most (more raise).
    """
    keys = df.select(order, F.explode(F.map_keys(F.try_variant_get(J.parsed(F.col("custom_data")), "$", "map<string,variant>"))).alias("key"))
    heads = keys.groupBy("key").agg(F.min(order).alias("first")).orderBy("first", "key").limit(5_001).collect()
    if len(heads) > 5_000:
        raise ValueError("more than 5,000 attribute keys do not fit into a table's header")
    taken = set(fixed)
    cols = [flat(J.value(F.col("_data"), h["key"])).alias(h["key"]) for h in heads if h["key"] not in taken]
    cells = [F.when(F.col(c).isNull(), "").otherwise(F.array_join(F.col(c), ", ") if t.startswith("array") else F.col(c).cast("string")).alias(c) for c, t in df.select(*fixed).dtypes]
    return df.withColumn("_data", J.parsed(F.col("custom_data"))).select(*cells, *cols)
