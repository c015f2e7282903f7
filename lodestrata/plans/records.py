"""Queries of lookups, histories, exports, payloads and merges, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.functions import jsonval as J
from lodestrata.operators import discovery, ingest, lists, payloads, records
from lodestrata.operators import filters as X
from lodestrata.plans.reference import ALIAS_SQL, KV, LIST_SQL, PUSHES, STRIP, WS, js, page_sql, pushes_of, query
from lodestrata.session import table


def joined(entries: str) -> str:
    return f"array_to_string(list_sort({entries}), '|')"


def texts(m: str) -> Column:
    """A map of texts as key=value, in order of keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(F.col(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias(m)


# -- lookups and pages --------------------------------------------------------------------------------------------------
@query("company_by_id", "SELECT id, company_name, domain FROM companies WHERE id = (SELECT min(id) FROM companies)")
def company_by_id(c, p, spark, d):
    first = c.agg(F.min("id")).first()[0]
    return records.by_id(c, first).select("id", "company_name", "domain")


@query("list_page_total", f"SELECT {LIST_SQL}, (SELECT count(*) FROM companies WHERE niche = 'solar') AS total FROM companies WHERE niche = 'solar' ORDER BY last_updated DESC NULLS LAST, id LIMIT 50")
def list_page_total(c, p, spark, d):
    some = X.companies(c, X.Filters(niche=X.Choice(("solar",)))).select(*lists.COMPANY_LIST)
    return records.with_total(lists.page(some), some)


@query("list_page_after", f"SELECT {LIST_SQL} FROM companies ORDER BY last_updated DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def list_page_after(c, p, spark, d):
    rows = c.select(*lists.COMPANY_LIST)
    last = records.page_after(rows, None).agg(F.max_by(F.struct("last_updated", "id"), F.struct(F.coalesce(-F.unix_micros(F.col("last_updated").cast("timestamp")), F.lit(2**62)), "id"))).first()[0]
    return records.page_after(rows, (last["last_updated"], last["id"]) if last else None)


@query("company_drawer", "SELECT id, full_name FROM people WHERE company_id = (SELECT company_id FROM people WHERE company_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY full_name NULLS LAST, id LIMIT 500")
def company_drawer(c, p, spark, d):
    largest = p.where("company_id IS NOT NULL").groupBy("company_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company_id").first()
    return records.drawer(p, largest["company_id"] if largest else "").select("id", "full_name")


# -- histories ----------------------------------------------------------------------------------------------------------
SHOWN = [("leadforge", "Lead Forge"), ("cardfile", "Card File"), ("orbit-scraped", "Orbit")]


@query("import_history_labels", f"SELECT id, source_key, coalesce(m.name, source_key) AS display_name FROM import_history LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in SHOWN)}) m(k, name) ON m.k = source_key")
def import_history_labels(c, p, spark, d):
    labels = spark.createDataFrame(SHOWN, "source_key string, display_name string")
    return records.labelled(table(spark, d, "import_history"), labels, "source_key", "display_name").select("id", "source_key", "display_name")


REASON = "coalesce(json_extract_string(r, '$._failure_reason'), json_extract_string(r, '$.reason'), json_extract_string(r, '$._import_error'))"


@query("failure_histogram", f"SELECT CASE WHEN starts_with(x, '22P02:') THEN 'One or more values were in an unexpected format.' WHEN starts_with(x, '23505:') THEN 'Duplicate record — a matching row already exists.' ELSE 'This record couldn''t be saved due to an unexpected error.' END AS message, count(*) AS n FROM (SELECT {REASON} AS x FROM (SELECT unnest(CAST(failed_records AS JSON[])) AS r FROM import_history WHERE json_valid(failed_records))) GROUP BY 1")
def failure_histogram(c, p, spark, d):
    return records.failures(table(spark, d, "import_history"))


@query("import_many_failed", "SELECT id, coalesce(failed_count, 0) >= 10 AND coalesce(failed_count, 0) / greatest(coalesce(input_count, 0), 1) >= 0.1 AS many FROM import_history")
def import_many_failed(c, p, spark, d):
    zero = lambda x: F.coalesce(x, F.lit(0))
    return table(spark, d, "import_history").select("id", records.many_failed(zero(F.col("failed_count")), zero(F.col("input_count"))).alias("many"))


CLIENTS = [("leadforge", "Lead Forge"), ("mapscout", "Map Scout")]


@query("push_history_clients", f"SELECT h.person_id, h.platform, p.full_name, k.name AS client_name FROM {PUSHES} h LEFT JOIN people p ON p.id = h.person_id LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CLIENTS)}) k(id, name) ON k.id = h.client_id")
def push_history_clients(c, p, spark, d):
    clients = spark.createDataFrame(CLIENTS, "client_id string, client_name string")
    h = pushes_of(p).join(p.select(F.col("id").alias("person_id"), "full_name"), "person_id", "left").join(F.broadcast(clients), "client_id", "left")  # two given rows
    return h.select("person_id", "platform", "full_name", "client_name")


@query("push_outcomes", f"SELECT w.person_id, w.client_id, CASE WHEN EXISTS (SELECT 1 FROM {PUSHES} h WHERE h.person_id = w.person_id AND h.client_id = w.client_id AND h.platform = 'mail') THEN 'updated' ELSE 'created' END AS outcome FROM (SELECT id AS person_id, source AS client_id FROM people WHERE source IS NOT NULL) w")
def push_outcomes(c, p, spark, d):
    wanted = p.where("source IS NOT NULL").select(F.col("id").alias("person_id"), F.col("source").alias("client_id"), F.lit("mail").alias("platform"))
    return records.outcomes(wanted, pushes_of(p)).select("person_id", "client_id", "outcome")


RECORDS = "(SELECT person_id, CASE WHEN platform = 'crm' THEN 'succeeded' ELSE 'failed' END AS outcome FROM " + PUSHES + ")"


def job_records(p: DataFrame) -> DataFrame:
    return pushes_of(p).select("person_id", F.when(F.col("platform") == "crm", "succeeded").otherwise("failed").alias("outcome"))


@query("job_people", f"SELECT id FROM people WHERE id IN (SELECT person_id FROM {RECORDS} WHERE outcome = 'failed')")
def job_people(c, p, spark, d):
    return records.delivered(p, job_records(p), "failed").select("id")


@query("job_companies", f"SELECT DISTINCT company_id FROM people WHERE company_id IS NOT NULL AND id IN (SELECT person_id FROM {RECORDS})")
def job_companies(c, p, spark, d):
    return records.companies_of_records(p, job_records(p))


# -- checks, links and merges -------------------------------------------------------------------------------------------
@query("import_rejects", "SELECT record_id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(employee_count, '[0-9]+') THEN 'employee_count' END, CASE WHEN NOT (domain LIKE '%.%') THEN 'domain' END], lambda x: x IS NOT NULL), ',') AS reasons FROM step1_inserts WHERE NOT regexp_full_match(employee_count, '[0-9]+') OR NOT (domain LIKE '%.%')")
def import_rejects(c, p, spark, d):
    rules = {"employee_count": F.col("employee_count").rlike("^[0-9]+$"), "domain": F.col("domain").contains(".")}
    return records.checked(table(spark, d, "step1_inserts"), rules)[1].select("record_id", F.array_join("reasons", ",").alias("reasons"))


def domain_sql(x: str) -> str:
    return f"nullif(split_part(regexp_replace(regexp_replace(lower({STRIP(x)}), '^https?://', ''), '^www\\.', ''), '/', 1), '')"


@query("link_people_by_domain", f"WITH k AS (SELECT {domain_sql('domain')} AS dom, max(id) AS cid FROM companies GROUP BY 1) SELECT p.id, coalesce(k.cid, p.company_id) AS company_id FROM people p LEFT JOIN k ON k.dom = {domain_sql('p.domain')}")
def link_people_by_domain(c, p, spark, d):
    return records.link_by_domain(p, c).select("id", "company_id")


@query("import_identities", f"SELECT record_id, CASE WHEN dom NOT IN ({', '.join(f"'{j}'" for j in C.JUNK_DOMAINS)}) THEN dom END AS domain, {page_sql('linkedin_url')} AS linkedin_url FROM (SELECT *, coalesce({domain_sql('domain')}, {domain_sql('website_url')}) AS dom FROM step1_inserts)")
def import_identities(c, p, spark, d):
    return ingest.import_keys(table(spark, d, "step1_inserts"), ["record_id"], "linkedin.example")


NEW_PEOPLE = """n AS (SELECT linkedin_url AS l, min(id) AS nid, NULL AS m FROM people WHERE linkedin_url IS NOT NULL AND phone IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, min(id), lower(email) FROM people WHERE linkedin_url IS NULL AND email IS NOT NULL GROUP BY lower(email))"""


@query("merge_people_snapshot", f"WITH {NEW_PEOPLE}, j AS (SELECT p.*, coalesce(a.nid, b.nid) AS nid FROM people p LEFT JOIN n a ON a.l = p.linkedin_url LEFT JOIN n b ON b.l IS NULL AND b.m = lower(p.email)) SELECT id, company_id, CASE WHEN nid IS NOT NULL THEN 'x,y' ELSE array_to_string(tags, ',') END AS tags, CASE WHEN nid IS NULL THEN source WHEN source IS NULL OR source = '' THEN 'leadforge' WHEN contains(source, 'leadforge') THEN source ELSE source || ',leadforge' END AS source, array_to_string(list_sort(list_distinct(CASE WHEN nid IS NULL THEN source_tokens ELSE coalesce(source_tokens, []) || ['leadforge'] END)), ',') AS tokens, CASE WHEN nid IS NOT NULL THEN 'solar' ELSE industry_id END AS industry_id, CASE WHEN nid >= '8' THEN 77 ELSE employee_count END AS employee_count, country_id, CASE WHEN nid IS NULL THEN {js('tier')} WHEN {js('tier')} IS NULL OR {js('tier')} = 'gold' THEN 'gold' ELSE {js('tier')} || ', gold' END AS tier FROM j")
def merge_people_snapshot(c, p, spark, d):
    a = p.where("linkedin_url IS NOT NULL AND phone IS NOT NULL").groupBy("linkedin_url").agg(F.min("id").alias("nid")).select("linkedin_url", F.lit(None).cast("string").alias("email"), "nid")
    b = p.where("linkedin_url IS NULL AND email IS NOT NULL").groupBy(F.lower("email").alias("email")).agg(F.min("id").alias("nid")).select(F.lit(None).cast("string").alias("linkedin_url"), "email", "nid")
    text = lambda x: F.lit(x).cast("string")
    new = a.unionByName(b).select(
        "linkedin_url", "email", text(None).alias("company_id"), F.array(F.lit("x"), F.lit("y")).alias("tags"), text("leadforge").alias("source"), F.array(F.lit("leadforge")).alias("source_tokens"), text("solar").alias("industry_id"),
        F.when(F.col("nid") >= "8", "77").otherwise("about 5").alias("employee_count"), text(None).alias("company_linkedin_url"), F.lit(None).cast("array<string>").alias("niche_tokens"), text('{"tier": "gold"}').alias("custom_data"), F.lit(None).cast("timestamp").alias("last_updated"),
    )
    out = ingest.merge_people(p, new)
    tokens = F.array_join(F.array_sort(F.array_distinct("source_tokens")), ",").alias("tokens")
    return out.select("id", "company_id", F.array_join("tags", ",").alias("tags"), "source", tokens, "industry_id", "employee_count", "country_id", J.text(J.value(J.parsed(F.col("custom_data")), "tier")).alias("tier"))


COUNTRY_SQL = f"CASE WHEN {STRIP('country')} <> '' THEN (SELECT {ALIAS_SQL} FROM (SELECT {STRIP('country')} AS x)) END"
INDUSTRY_SQL = f"nullif(regexp_replace(replace(lower({STRIP('industry')}), ';', ','), '{WS}+', ' ', 'g'), '')"
IDS = f"ids AS (SELECT *, CASE WHEN x <> '' THEN {ALIAS_SQL} END AS cid, {INDUSTRY_SQL} AS iid FROM (SELECT *, {STRIP('country')} AS x FROM TABLE_))"


@query("canonical_columns", f"WITH {IDS.replace('TABLE_', 'enrichment_aiark')} SELECT row_id, cid AS country_id, iid AS industry_id, 'leadforge|mapscout' AS tokens, 'Tidewell' AS client, CAST(NULL AS VARCHAR) AS niche FROM ids")
def canonical_columns(c, p, spark, d):
    out = ingest.canonicalised(table(spark, d, "enrichment_aiark"), ["Tidewell"], "Leadforge & mapscout")
    return out.select("row_id", "country_id", "industry_id", F.array_join("source_tokens", "|").alias("tokens"), "client", "niche")


PAYLOAD_TEXTS = ["company_name", "city", "country", "industry", "phone"]


@query("update_payload", f"WITH {IDS.replace('TABLE_', 'enrichment_aiark')} SELECT row_id, {joined('list_filter([' + ', '.join(f"'{t}=' || nullif({t}, '')" for t in PAYLOAD_TEXTS) + ", 'founded_year=' || nullif(founded_year, ''), 'country_id=' || CASE WHEN country <> '' THEN cid END, 'industry_id=' || CASE WHEN industry <> '' THEN iid END, 'source=cardfile', 'client=Tidewell', 'niche=solar'], lambda x: x IS NOT NULL)")} AS payload FROM ids")
def update_payload(c, p, spark, d):
    return ingest.update_payload(table(spark, d, "enrichment_aiark"), PAYLOAD_TEXTS, ["founded_year"], ["Tidewell", "solar"], "cardfile").select("row_id", texts("payload"))


TOKENS_SQL = f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(source, ''), '[,&]'), lambda t: lower({STRIP('t')})), lambda t: t <> '')))"


@query("stale_canonical_all", f"WITH {IDS.replace('TABLE_', 'companies')} SELECT count(*) FILTER (country_id IS DISTINCT FROM cid) AS countries, count(*) FILTER (industry_id IS DISTINCT FROM iid) AS industries, count(*) FILTER (list_sort(list_distinct(coalesce(source_tokens, []))) <> {TOKENS_SQL}) AS tokens, count(*) AS n FROM ids")
def stale_canonical_all(c, p, spark, d):
    return ingest.stale_columns(c)


# -- discovery over filtered rows -----------------------------------------------------------------------------------------
FILTERED = X.Filters(country=X.Choice(("US", "GB")))
FILTERED_SQL = "country_id IN ('US', 'GB')"
COMPANY_KV = KV.replace("FROM people WHERE", f"FROM companies WHERE {FILTERED_SQL} AND")
TYPES_SQL = "n AS (SELECT key, type, count(*) AS n FROM typed GROUP BY ALL) SELECT key, CASE WHEN type = 'Empty' THEN 'Text' ELSE type END AS type, (SELECT count(*) FROM companies WHERE " + FILTERED_SQL + ") AS sampled_rows FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY type = 'Empty', n DESC, type) AS r FROM n) WHERE r = 1"


@query("discover_company_types", f"WITH {COMPANY_KV}, {TYPES_SQL}")
def discover_company_types(c, p, spark, d):
    some = X.companies(c, FILTERED)
    return records.with_total(discovery.key_types(discovery.attributes(some)), some).withColumnRenamed("total", "sampled_rows")


@query("discover_person_types", f"WITH {KV.replace('FROM people WHERE', f'FROM people WHERE {FILTERED_SQL} AND').replace("'company_type')", "'company_type', 'company_linkedin_id', 'connections_count', 'apollo_id')")}, {TYPES_SQL.replace('FROM companies', 'FROM people')}")
def discover_person_types(c, p, spark, d):
    some = X.people(p, FILTERED)
    return records.with_total(discovery.key_types(discovery.attributes(some, C.PERSON_BLOCKED_KEYS)), some).withColumnRenamed("total", "sampled_rows")


# -- exports and payloads -------------------------------------------------------------------------------------------------
def layout_sql(source: str, layout: dict[str, str]) -> str:
    arrays, times = {"source_tokens", "keywords", "technologies", "tags"}, {"phone_verified_at", "email_verified_at", "last_updated"}
    cell = lambda c: f"array_to_string({c}, ', ')" if c in arrays else f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'" if c in times else f"CAST({c} AS VARCHAR)"
    return "SELECT " + ", ".join(f"coalesce({cell(c)}, '') AS \"{h}\"" for h, c in layout.items()) + f" FROM {source}"


@query("export_companies", layout_sql("companies", payloads.COMPANY_LAYOUT))
def export_companies(c, p, spark, d):
    return payloads.laid_out(c, payloads.COMPANY_LAYOUT).select(*[F.col(f"`{h}`") for h in payloads.COMPANY_LAYOUT])


@query("export_people", layout_sql("people", payloads.PERSON_LAYOUT))
def export_people(c, p, spark, d):
    return payloads.laid_out(p, payloads.PERSON_LAYOUT).select(*[F.col(f"`{h}`") for h in payloads.PERSON_LAYOUT])


KEYS_SQL = "CASE WHEN json_type(custom_data) = 'OBJECT' THEN json_keys(custom_data) ELSE [] END"
NATIVE = {"person_id": "id", "full_name": "full_name", "email": "email", "employee_count": "employee_count"}


@query("webhook_payload", f"SELECT id, {joined(f"list_distinct(list_filter({KEYS_SQL}, lambda k: k NOT IN ('pushed_to_clay', 'pushed_to_clay_at')) || ['person_id', 'full_name', 'email', 'employee_count'])")} AS keys, coalesce(CAST(employee_count AS VARCHAR), 'null') AS employees, {js('tier')} AS tier FROM people")
def webhook_payload(c, p, spark, d):
    out = payloads.webhook_payload(p, NATIVE)
    return out.select("id", F.array_join(F.array_sort(F.map_keys("payload")), "|").alias("keys"), F.try_element_at("payload", F.lit("employee_count")).alias("employees"), F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("payload", F.lit("tier")), F.lit("}")), "$.v").alias("tier"))


@query("shown_attributes", f"SELECT id, {joined(f"list_filter({KEYS_SQL}, lambda k: NOT (k IN ('naics', 'aiark_id', 'industries', 'legal_name', 'ai_ark_approaches', 'pushed_to_clay', 'created_at', 'updated_at', 'company_type') OR starts_with(k, 'pushed_to_') OR ends_with(k, '_at')) AND NOT coalesce(json_type(json_extract(custom_data, '$.\"' || k || '\"')) = 'NULL' OR json_extract_string(custom_data, '$.\"' || k || '\"') = '' OR (json_type(json_extract(custom_data, '$.\"' || k || '\"')) = 'ARRAY' AND json_array_length(json_extract(custom_data, '$.\"' || k || '\"')) = 0), TRUE))")} AS keys FROM people")
def shown_attributes(c, p, spark, d):
    return p.select("id", F.array_join(F.array_sort(F.map_keys(payloads.shown_attributes(F.col("custom_data")))), "|").alias("keys"))


@query("contact_records", f"SELECT p.id, p.email, CAST(NULL AS VARCHAR) AS phone, p.job_title AS title, coalesce(nullif(c.brand_name, ''), p.company_name) AS \"companyName\", {joined(f"list_filter(['company=' || nullif(coalesce(nullif(c.brand_name, ''), p.company_name), ''), 'score=' || nullif({js('lead_score')}, ''), 'stack=' || nullif(CASE WHEN json_type(p.custom_data, '$.tech_stack') = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(p.custom_data, '$.tech_stack') AS JSON[]), lambda x: coalesce(json_extract_string(x, '$'), '')), ', ') ELSE json_extract_string(p.custom_data, '$.tech_stack') END, '')], lambda x: x IS NOT NULL)").replace('(custom_data', '(p.custom_data')} AS variables FROM people p LEFT JOIN companies c ON c.id = p.company_id")
def contact_records(c, p, spark, d):
    rows = p.join(c.select(F.col("id").alias("company_id"), "brand_name"), "company_id", "left")
    out = payloads.contact_record(rows, {"email": "email", "phone": "phone", "title": "job_title"}, {"phone": "skip"}, {"company": "companyName", "score": "lead_score", "stack": "tech_stack"})
    return out.select("id", "email", "phone", "title", "companyName", texts("variables"))


@query("default_name_field", "SELECT CASE WHEN bool_or(coalesce(brand_name, '') <> '') THEN 'brand_name' ELSE 'company_name' END AS field FROM companies")
def default_name_field(c, p, spark, d):
    return payloads.default_name_field(c)


BUCKET = "CASE WHEN employee_count BETWEEN 1 AND 10 THEN '1–10' WHEN employee_count BETWEEN 11 AND 50 THEN '11–50' WHEN employee_count BETWEEN 51 AND 200 THEN '51–200' WHEN employee_count BETWEEN 201 AND 500 THEN '201–500' WHEN employee_count > 500 THEN '500+' ELSE 'Unknown' END"


@query("campaign_tags", f"SELECT id, 'Tidewell - ' || coalesce(nullif(trim(niche_tokens[1]), ''), 'Unknown') || ' | ' || {BUCKET} || ' | ' || coalesce(nullif(trim(country), ''), 'Unknown') || ' | ' || coalesce(nullif(trim(source), ''), 'Unknown') || ' | spring' AS tag FROM people")
def campaign_tags(c, p, spark, d):
    return p.select("id", payloads.campaign_tag(F.lit("Tidewell"), F.try_element_at("niche_tokens", F.lit(1)), F.col("employee_count"), F.col("country"), F.col("source"), " spring ").alias("tag"))


@query("name_targets", "SELECT id, company_name, coalesce(domain, website_url, '') AS website FROM companies WHERE trim(coalesce(brand_name, '')) = '' AND trim(coalesce(company_name, '')) <> ''")
def name_targets(c, p, spark, d):
    return payloads.name_targets(c)


@query("verification_targets", f"SELECT * FROM (SELECT id, nullif({STRIP("split_part(email, ',', 1)")}, '') AS email, nullif({STRIP('phone')}, '') AS phone FROM companies) WHERE email IS NOT NULL OR phone IS NOT NULL")
def verification_targets(c, p, spark, d):
    return payloads.verification_targets(c)


@query("score_bands", f"SELECT CASE WHEN s IS NULL THEN 'unknown' WHEN s >= 80 THEN 'healthy' WHEN s >= 30 THEN 'warming' ELSE 'burnt' END AS band, count(*) AS n FROM (SELECT try_cast({js('lead_score')} AS DOUBLE) AS s FROM people) GROUP BY 1")
def score_bands(c, p, spark, d):
    s = J.text(J.value(J.parsed(F.col("custom_data")), "lead_score")).try_cast("double")
    return p.select(payloads.score_band(s).alias("band")).groupBy("band").agg(F.count("*").alias("n"))
