"""Session, shared folder and table access used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def expose(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Also sets how repeated keys of JSON records are read. It suffices where executors see the driver's folders; elsewhere install the package or pass it by --py-files.
    """
    # A record that repeats a key keeps the last of its values.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def session(cpus: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, ANSI left on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestrata")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    expose(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only where the cluster names none (tests, local mode) a temporary folder is chosen and set.
    """
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lodestrata/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then does Spark's cleaner drop the shuffle files of finished steps.

    Left alone they stay until the heap is full, on the disks of all executors.
    """
    spark._jvm.System.gc()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared file system, overwritten at once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared file system; None if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


class Scratch:
    """Tables stored for a while: clear() deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch(self.spark, what)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, or of any folder laid out alike."""
    expose(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_rows(df: DataFrame, bound: int) -> list:
    """Rows of a table that is small by contract; raises when it is not, instead of flooding the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows where a bounded table was expected")
    return rows
