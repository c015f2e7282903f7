"""Imports: column mapping, row mapping, preflight, merge into a table, propagation and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import canonical as C
from lodestrata.functions import jsonval as J
from lodestrata.operators.dedupe import keep_first

# Header names that stand for a field.
HEADER_ALIASES = {
    "website": "website_url", "website url": "website_url", "url": "website_url", "company": "company_name", "company name": "company_name", "name": "company_name", "organization": "company_name",
    "org": "company_name", "linkedin": "linkedin_url", "linkedin url": "linkedin_url", "linkedin profile": "linkedin_url", "employees": "employee_count", "employee count": "employee_count",
    "number of employees": "employee_count", "size": "employee_count", "company size": "employee_count", "headcount": "employee_count", "first name": "first_name", "firstname": "first_name",
    "last name": "last_name", "lastname": "last_name", "full name": "full_name", "fullname": "full_name", "job title": "job_title", "title": "job_title", "position": "job_title", "role": "job_title",
    "email address": "email", "emails": "email", "phone number": "phone", "tel": "phone", "telephone": "phone", "linkedin username": "linkedin_username", "founded": "founded_year",
    "year founded": "founded_year", "founding year": "founded_year", "hq": "city", "location": "city", "hq city": "city", "hq country": "country", "hq state": "state", "desc": "description",
    "about": "description", "vertical": "niche", "sector": "industry",
}
# Prefixes of headers that describe the other entity, and fields that may carry them.
FOREIGN_PREFIXES = {"people": ("company ", "organization ", "employer ", "account "), "companies": ("contact ", "person ", "employee ")}
FOREIGN_FIELDS = {"people": ("company_name", "domain"), "companies": ()}
IDENTITY = {"companies": ["domain", "linkedin_url", "company_name", "full_name", "first_name"], "people": ["full_name", "first_name", "linkedin_url", "email"]}
ARRAYS, INTEGERS = ("technologies", "keywords"), ("employee_count", "founded_year")


def match_header(header: str, fields: list[str], entity: str | None = None) -> tuple[str, float] | None:
    """The field a header names, with a score: alias .95, same 1, same but case .9, same letters .8, contained .5."""
    low, bare = header.lower(), "".join(c for c in header.lower() if not c.isspace() and c not in "-_")
    foreign = bool(entity) and low.startswith(FOREIGN_PREFIXES[entity])
    allowed = [f for f in fields if not foreign or f in FOREIGN_FIELDS[entity or "companies"]]
    alias = HEADER_ALIASES.get(low) or HEADER_ALIASES.get(bare)
    if alias in allowed:
        return alias, 0.95

    def score(f: str) -> float:
        fl = f.lower()
        tests = ((header == f, 1.0), (low == fl, 0.9), (bare == "".join(c for c in fl if not c.isspace() and c not in "-_"), 0.8), (low in fl or fl in low, 0.5))
        return next((s for hit, s in tests if hit), 0.0)

    best = max(allowed, key=score, default=None)  # the first of equals
    return (best, score(best)) if best is not None and score(best) >= 0.4 else None


def match_headers(headers: list[str], fields: list[str], entity: str, preset: dict[str, str] | None = None) -> dict[str, str]:
    """header -> field: a preset first, then the best match; one header a field, the same name beating any score."""
    out = {h: (preset or {}).get(h, "") for h in headers}
    claims: dict[str, tuple[float, int]] = {}
    for i, h in enumerate(headers):
        if out[h] or not (m := match_header(h, fields, entity)):
            out[h] = out[h] or "ignore"
            continue
        field, s = m
        rank = (2.0 if h == field else s, -i)
        if field not in claims or rank > claims[field]:
            claims[field] = rank
    taken = {f for f in out.values() if f not in ("", "ignore", "custom_data")}
    for field, (_, i) in claims.items():
        if field not in taken:
            out[headers[-i]] = field
    return {h: f or "ignore" for h, f in out.items()}


def map_rows(df: DataFrame, mapping: dict[str, str], entity: str = "companies") -> DataFrame:
    """Rows of text columns mapped to fields; rows without an identity are dropped.

    Headers that equal their field come first, then the first filled one wins; lists are split at commas, mail lists
    joined by ', ', counts kept if whole, and custom_data gathers its headers' filled values as JSON.
    """
    by: dict[str, list[str]] = {}
    for h, f in sorted(mapping.items(), key=lambda x: x[0] != x[1]):
        if f and f != "ignore":
            by.setdefault(f, []).append(h)
    cols = []
    for f, hs in by.items():
        filled = [C.or_null(F.col(f"`{h}`")) for h in hs]
        if f == "custom_data":
            pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(h), c)) for h, c in zip(hs, filled)]))
            cols.append(F.when(F.size(pairs) > 0, F.to_json(F.map_from_entries(pairs))).alias(f))
        elif f in ARRAYS:
            cols.append(F.filter(F.transform(F.split(F.coalesce(*filled), ","), lambda x: C.strip(x)), lambda x: x != "").alias(f))
        elif f == "email":
            parts = F.filter(F.transform(F.split(F.coalesce(*filled), "[:;,]+"), lambda x: C.strip(x)), lambda x: x != "")
            cols.append(F.array_join(parts, ", ").alias(f))
        elif f in INTEGERS:
            clean = [F.regexp_replace(c, r"[,\s]", "") for c in filled]
            cols.append(F.coalesce(*[F.when(c.rlike(r"^\d+$"), c) for c in clean]).try_cast("int").alias(f))
        else:
            cols.append(F.coalesce(*filled).alias(f))
    out = df.select(*cols)
    ids = [f for f in IDENTITY[entity] if f in by]
    return out.where(F.coalesce(*[C.or_null(F.col(f)) for f in ids]).isNotNull()) if ids else out.where(F.lit(False))


def exists_in(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """df with a flag exists: one of its keys stands in the same column of held. Two semi-joins, not an OR-join."""
    for k in keys:
        some = held.where(F.col(k) != "").select(k).distinct().withColumn(f"_in_{k}", F.lit(True))
        df = df.join(some, k, "left")
    flag = F.lit(False)
    for k in keys:
        flag = flag | F.coalesce(F.col(f"_in_{k}"), F.lit(False))
    return df.withColumn("exists", flag).drop(*[f"_in_{k}" for k in keys])


def import_keys(df: DataFrame, keep: list[str], host: str = "linkedin.com") -> DataFrame:
    """The identity of rows to import: keep, domain (of the domain, else the website; none of a host that many share) and page."""
    at = F.coalesce(C.normalize_domain(F.col("domain")), C.normalize_domain(F.col("website_url")))
    return df.select(*keep, C.scrub_junk(at).alias("domain"), C.normalize_linkedin(F.col("linkedin_url"), host).alias("linkedin_url"))


def preflight(df: DataFrame, held: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """One row: input, deduped (kept), new (insert), known (update) of an import, before it is done."""
    kept = exists_in(keep_first(df, order, [F.col(k) for k in keys]), held, keys)
    counts = kept.agg(F.count("*").alias("kept"), F.count_if(~F.col("exists")).alias("inserts"), F.count_if("exists").alias("updates"))
    return df.agg(F.count("*").alias("input")).crossJoin(counts)  # two rows of one


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON records as one: of a key with two values both, joined by ', ', else the one there is; all as text."""
    empty = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(F.try_variant_get(J.parsed(x), "$", "map<string,string>"), empty) for x in (old, new))
    both = lambda k, x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), F.concat(x, F.lit(", "), y)).otherwise(F.coalesce(y, x))
    return F.map_zip_with(a, b, both)


def appended_source(old: Column, new: Column) -> Column:
    """The source text with the new one at its end, unless it is part of it already."""
    return F.when(old.isNull() | (old == ""), new).when(new.isNull() | old.contains(new), old).otherwise(F.concat(old, F.lit(","), new))


def merge_companies(held: DataFrame, new: DataFrame, texts: list[str], ints: list[str]) -> DataFrame:
    """The table after an import: rows of a domain (or, where it has none, of a page) take the new row's filled values.

    new: at most one row a key, with tags, source, source_tokens and custom_data besides texts and ints. A row whose
    domain is new but whose page is known updates the page's row. The result is a whole new snapshot.
    """
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in ["domain", "linkedin_url", "tags", "source", "source_tokens", "custom_data", *texts, *ints]])
    by_domain = n.where("n_domain <> ''").withColumn("k", F.concat(F.lit("d:"), "n_domain"))
    by_page = n.where("n_linkedin_url <> ''").withColumn("k", F.concat(F.lit("l:"), "n_linkedin_url"))
    keyed = by_domain.unionByName(by_page)
    rows = held.withColumn("_d", F.concat(F.lit("d:"), C.or_null(F.col("domain")))).withColumn("_l", F.concat(F.lit("l:"), C.or_null(F.col("linkedin_url"))))
    one = keyed.withColumn("_s", F.struct(*[c for c in keyed.columns if c != "k"])).groupBy("k").agg(F.min_by("_s", F.coalesce("n_domain", F.lit(""))).alias("_s"))
    rows = rows.join(one.select(F.col("k").alias("_d"), F.col("_s").alias("_sd")), "_d", "left").join(one.select(F.col("k").alias("_l"), F.col("_s").alias("_sl")), "_l", "left")
    rows = rows.withColumn("_n", F.coalesce("_sd", "_sl"))
    hit, new_of = F.col("_n").isNotNull(), lambda c: F.col(f"_n.n_{c}")
    for c in texts:
        rows = rows.withColumn(c, F.coalesce(C.or_null(new_of(c)), F.col(c)))
    for c in ints:
        rows = rows.withColumn(c, F.coalesce(new_of(c), F.col(c)))
    rows = rows.withColumn("tags", F.when(hit, F.coalesce(new_of("tags"), F.col("tags"))).otherwise(F.col("tags")))
    rows = rows.withColumn("source", F.when(hit, appended_source(F.col("source"), new_of("source"))).otherwise(F.col("source")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("source_tokens", F.when(hit, F.array_distinct(F.concat(F.coalesce("source_tokens", none), F.coalesce(new_of("source_tokens"), none)))).otherwise(F.col("source_tokens")))
    rows = rows.withColumn("custom_data", F.when(hit & new_of("custom_data").isNotNull(), F.to_json(merged_json(F.col("custom_data"), new_of("custom_data")))).otherwise(F.col("custom_data")))
    return rows.drop("_d", "_l", "_sd", "_sl", "_n")


def merge_people(held: DataFrame, new: DataFrame) -> DataFrame:
    """The table after an import: people of a page, or of a mail address for new rows without a page, take what is new.

    new: at most one row a page and, of those without one, a mail address; with company_id, tags, source,
    source_tokens, industry_id, employee_count (text), company_linkedin_url, niche_tokens, custom_data, last_updated.
    A row with a page never matches by mail. Company fields only replace what they supply; the country stays.
    """
    n = new.select(F.struct(*new.columns).alias("_n"))
    page, mail = F.col("_n.linkedin_url"), F.lower("_n.email")
    by_page = n.where(page.isNotNull()).groupBy(page.alias("linkedin_url")).agg(F.first("_n").alias("_p"))
    by_mail = n.where(page.isNull() & mail.isNotNull()).groupBy(mail.alias("_mail")).agg(F.first("_n").alias("_m"))
    rows = held.withColumn("_mail", F.lower("email")).join(by_page, "linkedin_url", "left").join(by_mail, "_mail", "left")
    rows = rows.withColumn("_n", F.coalesce("_p", "_m"))
    hit, of = F.col("_n").isNotNull(), lambda c: F.col(f"_n.{c}")
    none = F.array().cast("array<string>")
    count = F.when(of("employee_count").rlike("^[0-9]+$"), of("employee_count")).try_cast("int")
    takes = {
        "company_id": F.coalesce(of("company_id"), F.col("company_id")), "tags": F.when(hit, F.coalesce(of("tags"), none)).otherwise(F.col("tags")),
        "source": F.when(hit, appended_source(F.col("source"), of("source"))).otherwise(F.col("source")),
        "source_tokens": F.when(hit, F.array_distinct(F.concat(F.coalesce("source_tokens", none), F.coalesce(of("source_tokens"), none)))).otherwise(F.col("source_tokens")),
        "industry_id": F.coalesce(of("industry_id"), F.col("industry_id")), "employee_count": F.coalesce(count, F.col("employee_count")), "company_linkedin_url": F.coalesce(of("company_linkedin_url"), F.col("company_linkedin_url")),
        "niche_tokens": F.coalesce(of("niche_tokens"), F.col("niche_tokens")), "last_updated": F.when(hit, of("last_updated")).otherwise(F.col("last_updated")),
        "custom_data": F.when(hit & (J.tag(J.parsed(of("custom_data"))) == "object"), F.to_json(merged_json(F.col("custom_data"), of("custom_data")))).otherwise(F.col("custom_data")),
    }
    return rows.withColumns(takes).select(held.columns)


def canonicalised(df: DataFrame, tags: list[str], source_key: str) -> DataFrame:
    """New rows with the columns the engine derives: country_id, industry_id, source_tokens, client and niche (of the import's tags)."""
    tag = lambda i: F.lit(tags[i] if len(tags) > i else None).cast("string")
    return df.withColumns({"country_id": C.country_id(F.col("country")), "industry_id": C.industry_id(F.col("industry")), "source_tokens": C.source_tokens(F.lit(source_key)), "client": tag(0), "niche": tag(1)})


def update_payload(df: DataFrame, texts: list[str], ints: list[str], tags: list[str], source_key: str) -> DataFrame:
    """df's keys with payload, a map of what an update supplies: filled texts and numbers, and ids derived from them alone.

    A country or industry of nothing but blanks is supplied, but gives no id.
    """
    said = {c: F.when(F.col(c) != "", F.col(c)) for c in texts} | {c: C.or_null(F.col(c).cast("string")) for c in ints}
    said |= {"country_id": C.country_id(C.or_null(F.col("country"))), "industry_id": C.industry_id(C.or_null(F.col("industry"))), "source": F.lit(source_key)}
    said |= {k: F.lit(t) for k, t in zip(("client", "niche"), tags) if t}
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k), v)) for k, v in said.items()]))
    return df.select(*[c for c in ("row_id", "id", "domain", "linkedin_url") if c in df.columns], F.map_from_entries(pairs).alias("payload"))


def stale_columns(df: DataFrame) -> DataFrame:
    """One row: how many rows' canonical columns differ from what their raw ones give; token lists are compared as sets."""
    tokens = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    differ = lambda a, b: F.count_if(~a.eqNullSafe(b))
    return df.agg(
        differ(F.col("country_id"), C.country_id(F.col("country"))).alias("countries"), differ(F.col("industry_id"), C.industry_id(F.col("industry"))).alias("industries"),
        F.count_if(tokens(F.col("source_tokens")) != tokens(C.source_tokens(F.col("source")))).alias("tokens"), F.count("*").alias("n"),
    )


def propagate(people: DataFrame, companies: DataFrame, clients: DataFrame) -> DataFrame:
    """People with what their company gives them: industry, head count, page, and its niche, else the niches of their tags.

    clients(client): names in lower case, of any number; the distinct tags are joined with them.
    """
    c = companies.select(F.col("id").alias("company_id"), F.col("industry_id").alias("c_i"), F.col("employee_count").alias("c_e"), F.col("linkedin_url").alias("c_l"), F.col("niche").alias("c_n"))
    j = with_niches(people.join(c, "company_id", "left"), clients)
    own = F.trim(F.coalesce("c_n", F.lit("")))
    j = j.withColumn("industry_id", F.coalesce("c_i", "industry_id")).withColumn("employee_count", F.coalesce("c_e", "employee_count")).withColumn("company_linkedin_url", F.coalesce("c_l", "company_linkedin_url"))
    j = j.withColumn("niche_tokens", F.when(own != "", F.array(own)).otherwise(F.col("niches")))
    return j.drop("c_i", "c_e", "c_l", "c_n", "niches")


def with_niches(df: DataFrame, clients: DataFrame) -> DataFrame:
    """df(id, tags, ...) with niches: those among its tags in their order; tags that name a client are none.

    Lists of tags repeat, so distinct ones are looked up; tags and clients meet in a join, whatever their number.
    """
    lists = df.select("tags").where("tags IS NOT NULL").distinct().withColumn("_l", F.xxhash64("tags"))
    each = lists.select("tags", F.explode("tags").alias("t")).select("tags", "t", F.lower(C.strip(F.col("t"))).alias("client"))
    named = each.join(clients.select("client").distinct(), "client", "left_semi").groupBy("tags").agg(F.collect_set("client").alias("_named"))
    niches = lists.select("tags").join(named, "tags", "left").select("tags", C.niches_from_tags(F.col("tags"), F.coalesce("_named", F.array().cast("array<string>"))).alias("niches"))
    return df.join(niches, "tags", "left").withColumn("niches", F.coalesce("niches", F.array().cast("array<string>")))


def upsert(held: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the latest by order; a new row beats a held one of the same time, then the least row counts."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"), F.to_json(F.struct(*[c for c in both.columns if c != "_new"])))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
