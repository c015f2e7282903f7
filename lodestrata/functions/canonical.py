"""Canonical forms of dirty scalar values, as Column expressions (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Spellings of countries, to their code.
COUNTRY_ALIASES = {"us": "US", "usa": "US", "united states": "US", "gb": "GB", "uk": "GB", "united kingdom": "GB", "ca": "CA", "canada": "CA"}
# Source tokens with another canonical id, and labels of sources.
SOURCE_ALIASES = {"aiark-api": "aiark", "aiark-people": "aiark", "ai ark": "aiark", "blitz-api": "blitz", "blitz-people": "blitz", "clay-people": "clay"}
SOURCE_LABELS = {"aiark": "AI Ark", "blitz": "Blitz", "apollo": "Apollo", "apollo-scraped": "Apollo (scraped)", "store-leads": "Store Leads", "clay": "Clay"}
# Words of slugs that are written otherwise.
ACRONYMS = {"dtc": "DTC", "saas": "SaaS", "crm": "CRM", "b2b": "B2B", "b2c": "B2C", "ai": "AI", "us": "US", "uk": "UK", "eu": "EU"}
# Hosts that are nobody's own domain.
JUNK_DOMAINS = ["facebook.com", "yelp.com", "wix.com", "squarespace.com", "wordpress.com", "blogspot.com", "linkedin.com", "twitter.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "shopify.com", "etsy.com", "amazon.com", "google.com", "apple.com", "microsoft.com"]
# Tags that are no niches by their prefix.
TAG_PREFIXES = ["campaign:", "geo:", "imported:", "source:"]
# Attribute keys kept for bookkeeping only.
BLOCKED_KEYS = ["naics", "aiark_id", "industries", "legal_name", "ai_ark_approaches", "pushed_to_clay", "created_at", "updated_at", "company_type"]
PERSON_BLOCKED_KEYS = ["company_linkedin_id", "connections_count", "apollo_id"]
BUCKETS = [("1–10", 1, 10), ("11–50", 11, 50), ("51–200", 51, 200), ("201–500", 201, 500), ("500+", 501, None)]
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_null(c: Column) -> Column:
    """Null in place of an empty text."""
    return F.when(c != "", c)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_domain(c: Column) -> Column:
    """Lower case without scheme, www. and path; port and query without a slash are kept; blank gives null."""
    d = F.regexp_replace(F.lower(strip(c)), r"^https?://", "")
    return or_null(F.split_part(F.regexp_replace(d, r"^www\.", ""), F.lit("/"), F.lit(1)))


def normalize_linkedin(c: Column, host: str = "linkedin.com") -> Column:
    """One form of a page's address at the network's host; other hosts give null."""
    at = host.replace(".", r"\.")
    u = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^https?://", ""), rf"^(www\.)?{at}", host)
    u = F.regexp_replace(F.regexp_replace(u, r"\?[\s\S]*$", ""), "/$", "")
    return F.when(u.startswith(host + "/"), F.concat(F.lit("https://www."), u, F.lit("/")))


def scrub_junk(domain: Column, junk: list[str] | None = None) -> Column:
    return F.when(~domain.isin(junk or JUNK_DOMAINS), domain)


def title_words(c: Column) -> Column:
    """First letter of each word upper, the rest as it is."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def country_id(c: Column) -> Column:
    t = strip(c)
    return F.when(t != "", F.coalesce(lookup(COUNTRY_ALIASES, F.lower(t)), F.upper(t)))


def country_names(spark: SparkSession) -> dict[str, str]:
    """English names of all ISO codes, by the JVM's locale data (fixed size)."""
    locale = spark._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def country_label(id_: Column, names: dict[str, str]) -> Column:
    """A code's English name, else each word capitalised."""
    words = F.filter(F.split(id_, " "), lambda w: w != "")
    proper = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.coalesce(lookup(names, F.upper(id_)), proper)


def industry_id(c: Column) -> Column:
    """Lower case, semicolons as commas, single blanks; blank gives null."""
    return or_null(F.regexp_replace(F.replace(F.lower(strip(c)), F.lit(";"), F.lit(",")), r"(?U)\s+", " "))


def industry_label(id_: Column) -> Column:
    return title_words(id_)


def source_tokens(c: Column) -> Column:
    """Canonical tokens of a source text split at commas and ampersands, first occurrences in order; null gives none."""
    parts = F.filter(F.transform(F.split(c, "[,&]"), lambda t: F.lower(strip(t))), lambda t: t != "")
    ids = F.transform(parts, lambda t: F.coalesce(lookup(SOURCE_ALIASES, t), t))
    return F.coalesce(F.array_distinct(ids), F.array().cast("array<string>"))


def humanize_slug(c: Column) -> Column:
    words = F.filter(F.split(c, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(ACRONYMS, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def source_label(id_: Column) -> Column:
    return F.coalesce(lookup(SOURCE_LABELS, id_), humanize_slug(id_))


def niches_from_tags(tags: Column, clients: Column) -> Column:
    """Niches among tags: keyed ones (niche:...) if any, else what is no date, prefix or client; null gives none.

    clients: an array column of known clients in lower case.
    """
    keyed = F.filter(F.transform(F.filter(tags, lambda t: F.lower(t).startswith("niche:")), lambda t: strip(F.substr(t, F.lit(7)))), lambda t: t != "")

    def keep(t: Column) -> Column:
        low = F.lower(strip(t))
        named = reduce(lambda a, b: a | b, [low.startswith(p) for p in TAG_PREFIXES])
        return ~strip(t).rlike(r"^\d{4}-\d{2}-\d{2}$") & ~named & ~F.coalesce(F.array_contains(clients, low), F.lit(False))

    return F.coalesce(F.array_distinct(F.when(F.size(keyed) > 0, keyed).otherwise(F.filter(tags, keep))), F.array().cast("array<string>"))


def full_name(full: Column, first: Column, last: Column) -> Column:
    """A filled full name as it is, else first and last name, else what was there."""
    both = F.concat_ws(" ", or_null(strip(first)), or_null(strip(last)))
    return F.when(F.coalesce(strip(full), F.lit("")) != "", full).otherwise(F.coalesce(or_null(both), full))


def safe_uuid(c: Column) -> Column:
    return F.when(c.rlike(UUID), F.lower(c))


def employee_bucket(n: Column) -> Column:
    """The size class of a head count; zero and null have none."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(BUCKETS):
        out = F.when((n >= low) if high is None else n.between(low, high), label).otherwise(out)
    return out


def key_blocked(key: Column, extra: list[str] | None = None) -> Column:
    return key.isin(BLOCKED_KEYS + (extra or [])) | key.startswith("pushed_to_") | key.endswith("_at")


def first_email(c: Column) -> Column:
    """The first address of a comma-separated field; null if that is blank."""
    return or_null(strip(F.split_part(c, F.lit(","), F.lit(1))))


def time_ago(then: Column, now: Column) -> Column:
    """Coarse age of a time in words, at any scale rounded half up; null stays null, the future is just now."""
    sec = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    steps = [("minute", 60, 60), ("hour", 60, 24), ("day", 24, 30), ("month", 30, 12), ("year", 12, None)]
    out, n, branches = None, sec, [(sec < 60, F.lit("Just now"))]
    for unit, per, limit in steps:
        n = F.floor(n / per + 0.5).cast("bigint")
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        branches.append((n < limit if limit else F.lit(True), text))
    for when, text in reversed(branches):
        out = text if out is None else F.when(when, text).otherwise(out)
    return F.when(then.isNotNull(), out)
