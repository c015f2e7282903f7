"""Which rows were sent to a client's platform: semi-joins, anti-joins and relational division.

pushes(person_id, client_id, platform). A company is pushed if it has people and all of them are; it is not
pushed if it has a person who is not; a company without people is neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.filters import PushStatus


def pushed_ids(pushes: DataFrame, s: PushStatus) -> DataFrame:
    return pushes.where((F.col("client_id") == s.client_id) & (F.col("platform") == s.platform) & F.col("person_id").isNotNull()).select(F.col("person_id").alias("id"))


def people(df: DataFrame, pushes: DataFrame, s: PushStatus | None) -> DataFrame:
    """The people of a push status; no or an unknown status keeps all."""
    if s is None or s.status not in ("pushed", "not_pushed"):
        return df
    return df.join(pushed_ids(pushes, s), "id", "left_semi" if s.status == "pushed" else "left_anti")


def company_states(people_: DataFrame, pushes: DataFrame, s: PushStatus) -> DataFrame:
    """company_id, work_left of companies with people. Aggregated by person first, so hot companies combine map-side."""
    flag = pushed_ids(pushes, s).distinct().withColumn("done", F.lit(True))
    p = people_.where("company_id IS NOT NULL").select("id", "company_id").join(flag, "id", "left")
    return p.groupBy("company_id").agg(F.bool_or(F.col("done").isNull()).alias("work_left"))


def companies(df: DataFrame, people_: DataFrame, pushes: DataFrame, s: PushStatus | None) -> DataFrame:
    """The companies of a push status."""
    if s is None or s.status not in ("pushed", "not_pushed"):
        return df
    states = company_states(people_, pushes, s).where(~F.col("work_left") if s.status == "pushed" else F.col("work_left"))
    return df.join(states.select(F.col("company_id").alias("id")), "id", "left_semi")


def person_counts(df: DataFrame, pushes: DataFrame, s: PushStatus) -> DataFrame:
    """One row: pushed, not_pushed."""
    flag = pushed_ids(pushes, s).distinct().withColumn("done", F.lit(True))
    return df.select("id").join(flag, "id", "left").agg(F.count_if(F.col("done").isNotNull()).alias("pushed"), F.count_if(F.col("done").isNull()).alias("not_pushed"))


def company_counts(df: DataFrame, people_: DataFrame, pushes: DataFrame, s: PushStatus) -> DataFrame:
    """One row: pushed, not_pushed, without_people."""
    states = company_states(people_, pushes, s).select(F.col("company_id").alias("id"), "work_left")
    j = df.select("id").join(states, "id", "left")
    return j.agg(F.count_if(~F.col("work_left")).alias("pushed"), F.count_if(F.col("work_left")).alias("not_pushed"), F.count_if(F.col("work_left").isNull()).alias("without_people"))
