"""What attributes JSON records hold: their type and most frequent values.

Records are exploded once into (key, value); types and values are counted by aggregation, then ranked in windows
over the counts. With sample=None every record is read; a sample is a feature for interactive use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import jsonval as J
from lodestrata.functions.canonical import key_blocked


def attributes(df: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """key, value (VARIANT), type of every attribute that is not kept for bookkeeping."""
    v = J.parsed(F.col("custom_data"))
    m = F.try_variant_get(v, "$", "map<string,variant>")
    kv = df.select(F.explode(m).alias("key", "value")).where(~key_blocked(F.col("key"), blocked))
    return kv.withColumn("type", J.value_type(F.col("value")))


def key_types(attrs: DataFrame) -> DataFrame:
    """key, type: the most frequent type that is not Empty, the first by name of equals; Text where all are empty."""
    n = attrs.groupBy("key", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy((F.col("type") == "Empty"), F.desc("n"), "type")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", F.when(F.col("type") == "Empty", "Text").otherwise(F.col("type")).alias("type"))


def key_values(attrs: DataFrame, cap: int = 25) -> DataFrame:
    """key, value, n, rank: the most frequent filled values of each key, elements of lists one by one."""
    full = attrs.where("type <> 'Empty'")
    items = F.when(F.col("type") == "List", F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.coalesce(x.cast("string"), F.lit(None).cast("string")))).otherwise(F.array(J.text(F.col("value"))))
    one = full.select("key", F.explode(items).alias("value")).where(F.col("value").isNotNull() & ~F.trim("value").isin("", "-") & ~F.col("value").rlike(J.TEMPLATE))
    n = one.groupBy("key", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= cap)


def discover(df: DataFrame, blocked: list[str] | None = None, cap: int = 25, sample: int | None = None) -> DataFrame:
    """key, type, sample_values (at most cap, most frequent first)."""
    attrs = attributes(df.limit(sample) if sample else df, blocked)
    values = key_values(attrs, cap).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
    got = key_types(attrs).join(values, "key", "left")
    return got.select("key", "type", F.coalesce(F.transform("v", lambda x: x["value"]), F.array().cast("array<string>")).alias("sample_values"))
