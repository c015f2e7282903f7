"""Streams give what the batch operators give over the same rows."""

from pyspark.sql import functions as F

from lodestrata.operators import facets
from lodestrata.session import table
from lodestrata.streaming import feeds

DATA = "/root/testdata/sf0.001"


def source(spark, tmp_path, name):
    df = table(spark, DATA, name)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    return df, feeds.read_stream(spark, str(tmp_path / "in"), df.schema, 2)


def drain(query_df, tmp_path, spark, mode="append"):
    q = query_df.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode)
    q = q.option("path", str(tmp_path / "out")) if mode == "append" else q.queryName("drained")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")) if mode == "append" else spark.table("drained")


def test_windowed_counts(spark, tmp_path):
    df, stream = source(spark, tmp_path, "companies")
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = drain(feeds.windowed_counts(timed, "created_at", ["country_id"], "30 days", "3650 days"), tmp_path, spark, "complete")
    want = df.where("created_at IS NOT NULL").groupBy(F.window(F.col("created_at").cast("timestamp"), "30 days").start.alias("w"), "country_id").count()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_distinct_rows(spark, tmp_path):
    df, stream = source(spark, tmp_path, "people")
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = drain(feeds.distinct_rows(timed, ["company_id"], "created_at", "3650 days").select("company_id"), tmp_path, spark)
    assert sorted(r[0] or "" for r in got.collect()) == sorted(r[0] or "" for r in df.select("company_id").distinct().collect())


def test_facets_add_up(spark, tmp_path):
    df, stream = source(spark, tmp_path, "companies")
    feeds.keep_facets(stream, str(tmp_path / "facets"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "facets")).groupBy("dim", "id").agg(F.sum("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, facets.company_facets(df).collect()))
