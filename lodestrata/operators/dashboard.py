"""Rollups for an overview: totals, breakdowns, latest rows, and an audit of niche tags."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import facets
from lodestrata.operators.filters import COMPANY_DIMENSIONS, Filters

# Words of trades that hardly go with a marketing niche.
TRADES = ["construction", "hvac", "heating", "cooling", "air condition", "plumbing", "roofing", "electrical contractor", "general contractor", "remodeling", "landscaping", "land improvement", "home improvement", "civil engineering", "building materials"]


def date_range(preset: str, today: date, start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """[from, to) of a preset (today, 7d, 30d, all, custom; the last day of a custom range counts)."""
    days = {"today": 0, "7d": 6, "30d": 29}
    if preset in days:
        return (today - timedelta(days=days[preset])).isoformat(), (today + timedelta(days=1)).isoformat()
    if preset == "custom":
        good = lambda x: x if x and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) else None
        return good(start), (date.fromisoformat(end) + timedelta(days=1)).isoformat() if good(end) else None
    return None, None


def totals(companies: DataFrame, people: DataFrame, pushes: DataFrame, f: Filters) -> DataFrame:
    """what, n: companies and people made in the range, and all pushes whatever the range. Three aggregates, no cache."""

    def within(df: DataFrame) -> DataFrame:
        if f.created_from:
            df = df.where(F.col("created_at") >= F.lit(f.created_from).cast("timestamp_ntz"))
        return df.where(F.col("created_at") < F.lit(f.created_to).cast("timestamp_ntz")) if f.created_to else df

    parts = [("companies", within(companies)), ("people", within(people)), ("pushes", pushes)]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def breakdown(companies: DataFrame, f: Filters) -> DataFrame:
    """Counts by niche, source, industry and country within the range, in one pass."""
    dims = tuple(d for d in COMPANY_DIMENSIONS if d.name in ("niche", "source", "industry", "country"))
    return facets.counts(companies, f, dims, ("company_name", "domain"))


def niche_audit(companies: DataFrame) -> DataFrame:
    """niche, kind (untagged, real, category_leak), total, described, mismatches with trades, and their percentage."""
    niche = F.trim(F.coalesce("niche", F.lit("")))
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    hay = F.when(has("industry_id"), F.col("industry_id")).otherwise(F.coalesce("description", F.lit("")))
    trade = hay.rlike("(?i)" + "|".join(t.replace(" ", r"\s+") for t in TRADES))
    kind = F.when(niche == "", "untagged").when(niche.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "real").otherwise("category_leak")
    g = companies.select(F.when(niche == "", "(untagged)").otherwise(niche).alias("niche"), kind.alias("kind"), (has("industry") | has("description")).alias("d"), trade.alias("t"))
    out = g.groupBy("niche", "kind").agg(F.count("*").alias("total"), F.count_if("d").alias("described"), F.count_if(F.col("t") & (F.col("kind") == "real")).alias("mismatches"))
    return out.withColumn("mismatch_percent", F.round(F.col("mismatches") * 100.0 / F.col("total"), 4))
