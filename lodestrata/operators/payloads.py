"""What leaves the engine: export layouts, webhook payloads, contact records with chosen fields, tags and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.functions import jsonval as J
from lodestrata.sources.csv_files import export

# Headers of the exports and the columns they show, in the order of the files.
COMPANY_LAYOUT = {
    "Company Name": "company_name", "Brand Name": "brand_name", "Domain": "domain", "Website URL": "website_url", "LinkedIn URL": "linkedin_url", "Niche": "niche", "Industry": "industry", "Employees": "employee_count",
    "City": "city", "State": "state", "Country": "country", "Phone": "phone", "Phone Type": "phone_type", "Phone Status": "phone_status", "Phone Verified At": "phone_verified_at", "Email": "email", "Email Status": "email_status",
    "Email Verified At": "email_verified_at", "Description": "description", "Founded Year": "founded_year", "Revenue": "revenue", "Client": "client", "Source": "source_tokens", "Quality Tier": "quality_tier",
    "Domain Status": "domain_status", "MX Provider": "mx_provider", "Security Gateway": "security_gateway", "Keywords": "keywords", "Technologies": "technologies", "Tags": "tags", "Last Updated": "last_updated",
}
PERSON_LAYOUT = {
    "First Name": "first_name", "Last Name": "last_name", "Full Name": "full_name", "Job Title": "job_title", "Email": "email", "Email Status": "email_status", "Email Verified At": "email_verified_at", "Phone": "phone",
    "Phone Type": "phone_type", "Phone Status": "phone_status", "Phone Verified At": "phone_verified_at", "LinkedIn URL": "linkedin_url", "LinkedIn Username": "linkedin_username", "Company": "company_name",
    "Company Domain": "domain", "Company LinkedIn URL": "company_linkedin_url", "City": "city", "State": "state", "Country": "country", "Source ID": "source_id", "Source": "source_tokens", "Tags": "tags", "Last Updated": "last_updated",
}
# Keys that only keep track of deliveries.
DELIVERY_KEYS = ["pushed_to_clay", "pushed_to_clay_at"]
UNKNOWN = "Unknown"


def stamp(c: Column) -> Column:
    """A time as ISO text in UTC, to the microsecond."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def laid_out(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    """An export: the layout's columns under their headers, then one column an attribute key. Null gives an empty cell."""
    times = {f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")}
    cells = [(stamp(F.col(c)) if c in times else F.col(c)).alias(h) for h, c in layout.items()]
    return export(df.select("id", "custom_data", *cells), list(layout))


def attributes(data: Column) -> Column:
    """A record as a map of VARIANT; an empty one for what is no object."""
    return F.coalesce(F.try_variant_get(J.parsed(data), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def shown_attributes(data: Column, blocked: list[str] | None = None) -> Column:
    """The attributes to show: none kept for bookkeeping, none that is null, an empty text or an empty list."""
    empty = lambda v: F.coalesce(J.tag(v) == "null", F.lit(True)) | F.coalesce(J.text(v).isin("") | ((J.tag(v) == "array") & (J.text(v) == "[]")), F.lit(False))
    return F.map_filter(attributes(data), lambda k, v: ~C.key_blocked(k, blocked) & ~empty(v))


def webhook_payload(df: DataFrame, native: dict[str, str]) -> DataFrame:
    """id, payload (a map of JSON texts): the attributes but for delivery keys, over which native fields win.

    native: key in the payload -> column. Native fields come out even where they are null.
    """
    own = F.map_from_arrays(F.array(*map(F.lit, native)), F.array(*[F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in native.values()]))
    own = F.transform_values(own, lambda k, v: F.regexp_replace(F.regexp_replace(v, r'^\{"v":', ""), r"\}$", ""))
    kept = F.map_filter(attributes(F.col("custom_data")), lambda k, v: ~k.isin(*DELIVERY_KEYS, *native))
    return df.select("id", F.map_concat(F.transform_values(kept, lambda k, v: F.to_json(v)), own).alias("payload"))


def chosen_name(choice: str | None) -> Column:
    """The company's name to send: by choice the raw one or none, else the clean one if there is any."""
    if choice == "skip":
        return F.lit(None).cast("string")
    return F.col("company_name") if choice == "company_name" else F.coalesce(C.or_null(F.col("brand_name")), F.col("company_name"))


def contact_record(df: DataFrame, fields: dict[str, str], choices: dict[str, str] | None = None, variables: dict[str, str] | None = None) -> DataFrame:
    """id, the fields (name -> column) and variables (a map) of a contact.

    choices: 'skip' leaves a field null; for companyName also 'company_name'. variables: name -> field or attribute
    key; lists are joined by ', ', what is missing, null, empty or an empty list is left out.
    """
    choices = choices or {}
    cols = [F.lit(None).cast("string").alias(n) if choices.get(n) == "skip" else F.col(c).cast("string").alias(n) for n, c in fields.items()]
    v = J.parsed(F.col("custom_data"))
    told = lambda x: F.when(J.tag(x) == "array", C.or_null(F.array_join(F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: F.coalesce(y.cast("string"), F.lit(""))), ", "))).otherwise(C.or_null(J.text(x)))
    pairs = [(n, chosen_name(None) if k == "companyName" else F.col(fields[k]).cast("string") if k in fields else told(J.value(v, k))) for n, k in (variables or {}).items()]
    some = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n), c)) for n, c in pairs])) if pairs else F.array().cast("array<struct<k:string,v:string>>")
    return df.select("id", *cols, chosen_name(choices.get("companyName")).alias("companyName"), F.map_from_entries(some).alias("variables"))


def default_name_field(df: DataFrame) -> DataFrame:
    """One row: the name field to offer, the clean one if any record has it."""
    return df.agg(F.when(F.coalesce(F.bool_or(F.coalesce(F.col("brand_name"), F.lit("")) != ""), F.lit(False)), "brand_name").otherwise("company_name").alias("field"))


def campaign_tag(client: Column, niche: Column, employees: Column, country: Column, source: Column, suffix: str | None = None) -> Column:
    """client - niche | size class | country | source, and a suffix; blank parts read Unknown."""
    part = lambda c: F.coalesce(C.or_null(F.trim(c)), F.lit(UNKNOWN))
    base = F.concat(client, F.lit(" - "), F.concat_ws(" | ", part(niche), F.coalesce(C.employee_bucket(employees), F.lit(UNKNOWN)), part(country), part(source)))
    return F.concat(base, F.lit(f" | {suffix.strip()}")) if suffix and suffix.strip() else base


def name_targets(companies: DataFrame) -> DataFrame:
    """id, company_name, website of companies with a name but no clean one."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return companies.where(blank("brand_name") & ~blank("company_name")).select("id", "company_name", F.coalesce("domain", "website_url", F.lit("")).alias("website"))


def verification_targets(df: DataFrame) -> DataFrame:
    """id, email (the first of several), phone: what there is to verify; rows with neither are left out."""
    out = df.select("id", C.first_email(F.col("email")).alias("email"), C.or_null(C.strip(F.col("phone"))).alias("phone"))
    return out.where("email IS NOT NULL OR phone IS NOT NULL")


def score_band(score: Column) -> Column:
    """healthy from 80, warming from 30, else burnt; unknown for null."""
    return F.when(score.isNull(), "unknown").when(score >= 80, "healthy").when(score >= 30, "warming").otherwise("burnt")
