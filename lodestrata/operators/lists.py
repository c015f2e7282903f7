"""Lists: pages in a total order, quick search, counts and embeds of related rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.filters import contains

COMPANY_LIST = ["id", "company_name", "domain", "industry_id", "country_id", "employee_count", "email", "phone", "niche", "source", "last_updated"]
PERSON_LIST = ["id", "full_name", "job_title", "email", "email_status", "phone", "company_id", "country_id", "last_updated"]


def page(df: DataFrame, number: int = 1, size: int = 50, by_id: bool = False) -> DataFrame:
    """A page of a list: newest update first, unknown ones last, then by id; or by id alone."""
    order = [F.asc("id")] if by_id else [F.desc_nulls_last("last_updated"), F.asc("id")]
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def page_number(raw: str | None) -> int:
    """The page a parameter asks for: whole, one at least."""
    try:
        return max(1, int(float(raw or "1")))
    except (ValueError, OverflowError):
        return 1


def newest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The latest rows; unknown times come first, as if just made."""
    return df.orderBy(F.desc_nulls_first(by), F.asc("id")).limit(n)


def quick_search(df: DataFrame, term: str, columns: list[str], n: int = 5) -> DataFrame:
    """The first rows by id that contain the term in one of the columns; a blank term finds nothing."""
    if not term.strip():
        return df.where(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(F.col(c), term.replace(",", ""))
    return df.where(hit).orderBy("id").limit(n)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of an id set. The set is joined, so it may be of any size; AQE broadcasts a small one."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_people_count(companies: DataFrame, people: DataFrame) -> DataFrame:
    """Companies with the number of their people, zero where there are none."""
    n = people.where("company_id IS NOT NULL").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("people_count"))
    return companies.join(n, "id", "left").withColumn("people_count", F.coalesce("people_count", F.lit(0).cast("bigint")))


def with_company(people: DataFrame, companies: DataFrame) -> DataFrame:
    """People with their company's name, brand, domain and tier; null where they have none."""
    c = companies.select(F.col("id").alias("company_id"), F.col("company_name").alias("c_name"), F.col("brand_name").alias("c_brand"), F.col("domain").alias("c_domain"), F.col("quality_tier").alias("c_tier"))
    return people.join(c, "company_id", "left")


def people_of(people: DataFrame, companies: DataFrame) -> DataFrame:
    """All people of a set of companies."""
    return people.join(companies.select(F.col("id").alias("company_id")).distinct(), "company_id", "left_semi")


def companies_of(people: DataFrame, companies: DataFrame) -> DataFrame:
    """The companies of a set of people, each once."""
    return companies.join(people.where("company_id IS NOT NULL").select(F.col("company_id").alias("id")).distinct(), "id", "left_semi")


def known_clients(companies: DataFrame) -> DataFrame:
    """client: distinct filled clients, trimmed, in lower case."""
    return companies.select(F.lower(F.trim("client")).alias("client")).where("client <> ''").distinct()


def niche_values(companies: DataFrame, people: DataFrame) -> DataFrame:
    """niche: distinct filled niches of companies, people and their tokens, for completion."""
    a = companies.select(F.trim("niche").alias("niche"))
    b = people.select(F.explode("niche_tokens").alias("niche"))
    return a.unionByName(b).where("niche <> ''").distinct()
