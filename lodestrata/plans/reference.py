"""Queries over the whole tables by the engine's operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.functions import jsonval as J
from lodestrata.operators import dashboard, dedupe, discovery, facets, ingest, lists, push_status
from lodestrata.operators import filters as X
from lodestrata.operators.json_predicates import filter_set
from lodestrata.session import table
from lodestrata.sources.csv_files import flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query of (companies, people, spark, sf_dir), with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, d: f(table(spark, d, "companies"), table(spark, d, "people"), spark, d)
        if sql:
            ORACLES[name] = sql
        return f

    return register


# -- facets ---------------------------------------------------------------------------------------------------------
COMPANY_SQL = {"niche": ("niche", "niche <> ''"), "industry": ("industry_id", "industry_id IS NOT NULL"), "country": ("country_id", "country_id IS NOT NULL"), "email_status": ("email_status", "email_status IS NOT NULL"), "phone_type": ("phone_type", "phone_type IS NOT NULL")}


def facet_sql(source: str, filters: dict[str, str] | None = None, where: str = "TRUE", arrays: tuple[str, ...] = ("source",), columns: dict | None = None) -> str:
    """Facet by facet, each with all filters but its own: the plain form that the one-pass plan is checked against."""
    filters = filters or {}
    cols = dict(columns or COMPANY_SQL)
    parts = []
    for dim in [*cols, *arrays]:
        rest = " AND ".join([f"({w})" for d, w in filters.items() if d != dim] + [f"({where})"])
        if dim in arrays:
            col = {"source": "source_tokens", "niche": "niche_tokens"}[dim]
            flt = "x <> ''" if dim == "niche" else "x IS NOT NULL"
            parts.append(f"SELECT '{dim}' AS dim, x AS id, count(*) AS n FROM (SELECT unnest({col}) AS x FROM {source} WHERE {rest}) WHERE {flt} GROUP BY x")
        else:
            col, flt = cols[dim]
            parts.append(f"SELECT '{dim}' AS dim, {col} AS id, count(*) AS n FROM {source} WHERE {rest} AND {flt} GROUP BY {col}")
    return " UNION ALL ".join(parts)


PERSON_SQL = {k: v for k, v in COMPANY_SQL.items() if k != "niche"}
PERSON_ARRAYS = ("niche", "source")


@query("facet_counts_all", facet_sql("companies"))
def facet_counts_all(c, p, spark, d):
    return facets.company_facets(c)


@query("facet_counts_include", facet_sql("companies", {"niche": "niche IN ('solar', 'freight')", "country": "country_id IN ('US', 'GB', 'FR')"}))
def facet_counts_include(c, p, spark, d):
    return facets.company_facets(c, X.Filters(niche=X.Choice(("solar", "freight")), country=X.Choice(("US", "GB", "FR"))))


@query("facet_counts_exclude_nulls", facet_sql("companies", {"country": "country_id IS NULL OR country_id <> 'US'", "source": "NOT coalesce(list_has_any(source_tokens, ['leadforge']), FALSE)"}))
def facet_counts_exclude_nulls(c, p, spark, d):
    return facets.company_facets(c, X.Filters(country=X.Choice(exclude=("US",)), source=X.Choice(exclude=("leadforge",))))


@query("facet_counts_multi_filter", facet_sql("companies", {"industry": "industry_id IN ('law firms', 'dental practices', 'water treatment')", "email_status": "email_status IS NULL OR email_status NOT IN ('invalid')", "source": "coalesce(list_has_any(source_tokens, ['cardfile', 'expo-list']), FALSE)"}, "(company_name ILIKE '%be%' OR domain ILIKE '%be%') AND employee_count BETWEEN 11 AND 500 AND coalesce(email, '') <> ''"))
def facet_counts_multi_filter(c, p, spark, d):
    f = X.Filters(search="be", employee_min=11, employee_max=500, email="not_empty", industry=X.Choice(("law firms", "dental practices", "water treatment")), email_status=X.Choice(exclude=("invalid",)), source=X.Choice(("cardfile", "expo-list")))
    return facets.company_facets(c, f)


@query("facet_counts_people", facet_sql("people", {"niche": "coalesce(list_has_any(niche_tokens, ['dental', 'solar']), FALSE)", "phone_type": "phone_type IN ('mobile')"}, arrays=PERSON_ARRAYS, columns=PERSON_SQL))
def facet_counts_people(c, p, spark, d):
    return facets.person_facets(p, X.Filters(niche=X.Choice(("dental", "solar")), phone_type=X.Choice(("mobile",))))


@query("facet_ranked", f"SELECT dim, id, n, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, id) AS INT) AS rank FROM ({facet_sql('companies')})")
def facet_ranked(c, p, spark, d):
    return facets.ranked(facets.company_facets(c))


TOP = f"(SELECT dim, id, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, id) AS r FROM ({facet_sql('companies')}))"


@query("topn_other", f"SELECT dim, id, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY dim), 6) AS share FROM (SELECT dim, CASE WHEN r <= 5 THEN id ELSE 'other' END AS id, sum(n) AS n FROM {TOP} GROUP BY 1, 2)")
def topn_other(c, p, spark, d):
    return facets.top_and_other(facets.company_facets(c))


@query("percent_of_max", f"SELECT dim, id, n, CAST(r AS INT) AS rank, round(greatest(4.0, n * 100.0 / max(n) OVER (PARTITION BY dim)), 6) AS percent FROM {TOP} WHERE r <= 6")
def percent_of_max(c, p, spark, d):
    return facets.percent_of_max(facets.company_facets(c))


@query("facet_json", f"SELECT dim, CAST(to_json(list({{'id': id, 'count': n}} ORDER BY n DESC, id)) AS VARCHAR) AS values FROM ({facet_sql('companies')}) GROUP BY dim")
def facet_json(c, p, spark, d):
    return facets.as_json(facets.company_facets(c))


# -- lists and scalar filters ------------------------------------------------------------------------------------------
LIST_SQL = ", ".join(lists.COMPANY_LIST)


@query("list_page_default", f"SELECT {LIST_SQL} FROM companies ORDER BY last_updated DESC NULLS LAST, id LIMIT 50")
def list_page_default(c, p, spark, d):
    return lists.page(c.select(*lists.COMPANY_LIST))


@query("list_page_offset", f"SELECT {LIST_SQL} FROM companies WHERE niche = 'solar' ORDER BY last_updated DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def list_page_offset(c, p, spark, d):
    return lists.page(X.companies(c, X.Filters(niche=X.Choice(("solar",)))).select(*lists.COMPANY_LIST), 2)


@query("list_page_people", "SELECT id, full_name, job_title, email, email_status, phone, company_id, country_id, last_updated FROM people ORDER BY last_updated DESC NULLS LAST, id LIMIT 50")
def list_page_people(c, p, spark, d):
    return lists.page(p.select(*lists.PERSON_LIST))


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


FILTERED: dict[str, tuple[str, X.Filters, str]] = {
    "search_ilike": ("companies", X.Filters(search="Solar"), "company_name ILIKE '%solar%' OR domain ILIKE '%solar%'"),
    "search_people": ("people", X.Filters(search="anda"), "full_name ILIKE '%anda%' OR email ILIKE '%anda%'"),
    "job_title_terms": ("people", X.Filters(job_title="founder, Head of, buyer"), "job_title ILIKE '%founder%' OR job_title ILIKE '%Head of%' OR job_title ILIKE '%buyer%'"),
    "employee_range": ("companies", X.Filters(employee_min=50, employee_max=300, buckets=("500+",)), "employee_count BETWEEN 50 AND 300"),
    "employee_minimum": ("companies", X.Filters(employee_min=0), "employee_count >= 0"),
    "employee_buckets": ("companies", X.Filters(buckets=("1–10", "500+")), "employee_count BETWEEN 1 AND 10 OR employee_count >= 501"),
    "presence_filter": ("companies", X.Filters(email="not_empty", phone="empty"), "coalesce(email, '') <> '' AND coalesce(phone, '') = ''"),
    "include_scalar": ("companies", X.Filters(industry=X.Choice(("law firms",), ())), "industry_id = 'law firms'"),
    "exclude_scalar": ("companies", X.Filters(country=X.Choice(exclude=("US", "GB"))), "country_id IS NULL OR country_id NOT IN ('US', 'GB')"),
    "exclude_scalar_without_nulls": ("companies", X.Filters(country=X.Choice(exclude=("US", "GB")), null_excludes=True), "country_id NOT IN ('US', 'GB')"),
    "array_overlap_include": ("people", X.Filters(source=X.Choice(("leadforge", "cardfile"))), "coalesce(list_has_any(source_tokens, ['leadforge', 'cardfile']), FALSE)"),
    "array_overlap_exclude": ("people", X.Filters(niche=X.Choice(exclude=("dental",))), "NOT coalesce(list_has_any(niche_tokens, ['dental']), FALSE)"),
    "date_range_half_open": ("companies", X.Filters(created_from="2025-03-01", created_to="2025-06-01"), "created_at >= TIMESTAMP '2025-03-01' AND created_at < TIMESTAMP '2025-06-01'"),
    "all_filters_together": ("people", X.Filters(search="e", email="not_empty", employee_min=10, country=X.Choice(("US", "FR", "DE")), email_status=X.Choice(exclude=("invalid",)), source=X.Choice(("mapscout", "expo-list"))), "(full_name ILIKE '%e%' OR email ILIKE '%e%') AND email <> '' AND employee_count >= 10 AND country_id IN ('US', 'FR', 'DE') AND (email_status IS NULL OR email_status <> 'invalid') AND coalesce(list_has_any(source_tokens, ['mapscout', 'expo-list']), FALSE)"),
}


def filtered(entity: str, f: X.Filters) -> Callable:
    return lambda c, p, spark, d: ids(X.companies(c, f) if entity == "companies" else X.people(p, f))


for _name, (_entity, _f, _where) in FILTERED.items():
    query(_name, f"SELECT id FROM {_entity} WHERE {_where}")(filtered(_entity, _f))

BUCKET_SQL = "CASE WHEN employee_count BETWEEN 1 AND 10 THEN '1–10' WHEN employee_count BETWEEN 11 AND 50 THEN '11–50' WHEN employee_count BETWEEN 51 AND 200 THEN '51–200' WHEN employee_count BETWEEN 201 AND 500 THEN '201–500' WHEN employee_count >= 501 THEN '500+' END"


@query("bucket_histogram", f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM companies GROUP BY 1")
def bucket_histogram(c, p, spark, d):
    return c.groupBy(C.employee_bucket(F.col("employee_count")).alias("bucket")).agg(F.count("*").alias("n"))


@query("quick_search", "SELECT id, company_name FROM companies WHERE company_name ILIKE '%ing%' OR domain ILIKE '%ing%' ORDER BY id LIMIT 5")
def quick_search(c, p, spark, d):
    return lists.quick_search(c, "ing", ["company_name", "domain"]).select("id", "company_name")


@query("people_per_company", "SELECT c.id, count(p.id) AS people_count FROM companies c LEFT JOIN people p ON p.company_id = c.id GROUP BY c.id")
def people_per_company(c, p, spark, d):
    return lists.with_people_count(c, p).select("id", "people_count")


@query("person_with_company", "SELECT p.id, c.company_name AS c_name, c.brand_name AS c_brand, c.domain AS c_domain, c.quality_tier AS c_tier FROM people p LEFT JOIN companies c ON c.id = p.company_id")
def person_with_company(c, p, spark, d):
    return lists.with_company(p, c).select("id", "c_name", "c_brand", "c_domain", "c_tier")


@query("people_of_companies", "SELECT id FROM people WHERE company_id IN (SELECT id FROM companies WHERE niche = 'freight')")
def people_of_companies(c, p, spark, d):
    return ids(lists.people_of(p, X.companies(c, X.Filters(niche=X.Choice(("freight",))))))


@query("companies_of_people", "SELECT id FROM companies WHERE id IN (SELECT company_id FROM people WHERE email_status = 'ok')")
def companies_of_people(c, p, spark, d):
    return ids(lists.companies_of(X.people(p, X.Filters(email_status=X.Choice(("ok",)))), c))


@query("id_set_intersection", "SELECT id FROM people WHERE id IN (SELECT id FROM people WHERE phone_type = 'mobile' INTERSECT SELECT id FROM people WHERE email_status = 'ok')")
def id_set_intersection(c, p, spark, d):
    return ids(lists.by_ids(lists.by_ids(p, ids(p.where("phone_type = 'mobile'"))), ids(p.where("email_status = 'ok'"))))


@query("distinct_clients", "SELECT DISTINCT lower(trim(client)) AS client FROM companies WHERE client <> ''")
def distinct_clients(c, p, spark, d):
    return lists.known_clients(c)


@query("niche_completion", "SELECT DISTINCT niche FROM (SELECT trim(niche) AS niche FROM companies UNION ALL SELECT unnest(niche_tokens) FROM people) WHERE niche <> ''")
def niche_completion(c, p, spark, d):
    return lists.niche_values(c, p)


@query("import_history_newest", "SELECT id, source_key, input_count, completed_at FROM import_history ORDER BY completed_at DESC NULLS FIRST, id LIMIT 50")
def import_history_newest(c, p, spark, d):
    return lists.newest(table(spark, d, "import_history"), "completed_at", 50).select("id", "source_key", "input_count", "completed_at")


@query("import_rows_check", "SELECT h.id, h.input_count, count(s.record_id) AS n_rows, coalesce(h.input_count = count(s.record_id), FALSE) AS agrees FROM import_history h LEFT JOIN step1_inserts s ON s.import_id = h.id GROUP BY h.id, h.input_count")
def import_rows_check(c, p, spark, d):
    n = table(spark, d, "step1_inserts").groupBy(F.col("import_id").alias("id")).agg(F.count("record_id").alias("n_rows"))
    j = table(spark, d, "import_history").join(n, "id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))
    return j.select("id", "input_count", "n_rows", F.coalesce(F.col("input_count") == F.col("n_rows"), F.lit(False)).alias("agrees"))


# -- JSON predicates -----------------------------------------------------------------------------------------------
def js(key: str) -> str:
    return f"json_extract_string(custom_data, '$.\"{key}\"')"


def jt(key: str) -> str:
    return f"coalesce(json_type(custom_data, '$.\"{key}\"'), '')"


NUM = lambda k: f"(CASE WHEN {jt(k)} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') OR ({jt(k)} = 'VARCHAR' AND regexp_full_match({js(k)}, '-?[0-9]+(\\.[0-9]+)?')) THEN try_cast({js(k)} AS DECIMAL(38,10)) END)"
DAY = lambda k: f"(CASE WHEN {jt(k)} = 'VARCHAR' AND regexp_matches({js(k)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN {js(k)} END)"
HAS = lambda k, vs: f"({jt(k)} = 'ARRAY' AND len(list_filter(CAST(json_extract(custom_data, '$.\"{k}\"') AS JSON[]), lambda x: json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') IN ({', '.join(repr(v) for v in vs)}))) > 0)"
EMPTY = lambda k: f"({jt(k)} IN ('', 'NULL') OR ({jt(k)} = 'ARRAY' AND json_array_length(custom_data, '$.\"{k}\"') = 0) OR ({jt(k)} = 'VARCHAR' AND (trim({js(k)}, ' ') IN ('', '-') OR regexp_full_match(trim({js(k)}, ' '), '\\{{\\{{.*\\}}\\}}', 's'))))"


def one(key: str, type_: str, operator: str, value: object = None) -> list:
    return [{"key": key, "type": type_, "operator": operator, "value": value}]


JSON_QUERIES: dict[str, tuple[object, str]] = {
    "json_text_is": (one("tier", "Text", "is", ["gold", "silver"]), f"coalesce({js('tier')}, '') IN ('gold', 'silver')"),
    "json_text_is_not": (one("tier", "Text", "is_not", "gold"), f"coalesce({js('tier')}, '') <> 'gold'"),
    "json_text_contains_any": (one("bio", "Text", "contains", ["audit", "Booking"]), f"coalesce({js('bio')} ILIKE '%audit%' OR {js('bio')} ILIKE '%booking%', FALSE)"),
    "json_not_contains_missing": (one("bio", "Text", "not_contains", "the"), f"NOT coalesce({js('bio')} ILIKE '%the%', FALSE)"),
    "json_number_between": (one("lead_score", "Number", "between", [20, 60.5]), f"coalesce({NUM('lead_score')} BETWEEN 20 AND 60.5, FALSE)"),
    "json_number_is_not": (one("followers", "Number", "is_not", 100), f"coalesce({NUM('followers')} <> 100, FALSE)"),
    "json_number_gt": (one("followers", "Number", "gt", 500), f"coalesce({NUM('followers')} > 500, FALSE)"),
    "json_boolean_true": (one("is_hiring", "Boolean", "is_true"), f"({jt('is_hiring')} = 'BOOLEAN' AND {js('is_hiring')} = 'true') OR ({jt('is_hiring')} = 'VARCHAR' AND lower({js('is_hiring')}) IN ('true', 'yes', '1'))"),
    "json_boolean_false": (one("is_hiring", "Boolean", "is_false"), f"({jt('is_hiring')} = 'BOOLEAN' AND {js('is_hiring')} = 'false') OR ({jt('is_hiring')} = 'VARCHAR' AND lower({js('is_hiring')}) IN ('false', 'no', '0'))"),
    "json_list_contains": (one("tech_stack", "List", "contains", ["crmdesk", "maproute"]), HAS("tech_stack", ["crmdesk", "maproute"])),
    "json_list_not_contains": (one("tech_stack", "List", "not_contains", "crmdesk"), "NOT " + HAS("tech_stack", ["crmdesk"])),
    "json_date_before": (one("last_contacted", "Date", "before", "2025-06-01"), f"coalesce({DAY('last_contacted')} < '2025-06-01', FALSE)"),
    "json_date_between": (one("last_contacted", "Date", "between", ["2025-02-01", "2025-04-30"]), f"coalesce({DAY('last_contacted')} BETWEEN '2025-02-01' AND '2025-04-30', FALSE)"),
    "json_is_empty": (one("qualification notes", "Text", "is_empty"), EMPTY("qualification notes")),
    "json_is_not_empty": (one("specialties", "List", "is_not_empty"), f"NOT {EMPTY('specialties')}"),
    "json_group_or_of_and": (
        {"combinator": "or", "groups": [{"combinator": "and", "conditions": one("tier", "Text", "is", "gold") + one("lead_score", "Number", "gt", 50)}, {"combinator": "or", "conditions": one("is_hiring", "Boolean", "is_true") + one("tech_stack", "List", "contains", "ledgerly")}]},
        f"(coalesce({js('tier')}, '') = 'gold' AND coalesce({NUM('lead_score')} > 50, FALSE)) OR (({jt('is_hiring')} = 'BOOLEAN' AND {js('is_hiring')} = 'true') OR ({jt('is_hiring')} = 'VARCHAR' AND lower({js('is_hiring')}) IN ('true', 'yes', '1')) OR {HAS('tech_stack', ['ledgerly'])})",
    ),
    "json_group_and_of_or": (
        {"combinator": "and", "groups": [{"combinator": "or", "conditions": one("tier", "Text", "is", "gold") + one("tier", "Text", "is", "silver")}, {"combinator": "and", "conditions": one("followers", "Number", "lt", 400)}]},
        f"coalesce({js('tier')}, '') IN ('gold', 'silver') AND coalesce({NUM('followers')} < 400, FALSE)",
    ),
}


def json_query(raw: object) -> Callable:
    return lambda c, p, spark, d: ids(X.people(p, X.Filters(virtual=filter_set(raw))))


for _name, (_raw, _where) in JSON_QUERIES.items():
    query(_name, f"SELECT id FROM people WHERE {_where}")(json_query(_raw))


@query("json_facets_together", facet_sql("people", {"country": "country_id IN ('US', 'GB')"}, f"coalesce({NUM('lead_score')} > 30, FALSE)", arrays=PERSON_ARRAYS, columns=PERSON_SQL))
def json_facets_together(c, p, spark, d):
    return facets.person_facets(p, X.Filters(country=X.Choice(("US", "GB")), virtual=filter_set(one("lead_score", "Number", "gt", 30))))


@query("json_column_projection", f"SELECT id, {js('tier')} AS tier, {js('qualification notes')} AS notes FROM people")
def json_column_projection(c, p, spark, d):
    v = p.select("id", J.parsed(F.col("custom_data")).alias("v"))
    return v.select("id", J.text(J.value(F.col("v"), "tier")).alias("tier"), J.text(J.value(F.col("v"), "qualification notes")).alias("notes"))


# -- push status: pushes are made up of people with a phone, sent by their source ---------------------------------------
PUSHES = "(SELECT id AS person_id, source AS client_id, CASE WHEN email_status = 'ok' THEN 'crm' ELSE 'mail' END AS platform FROM people WHERE source IS NOT NULL AND phone IS NOT NULL)"
STATUS = {s: X.PushStatus("leadforge", "mail", s) for s in ("pushed", "not_pushed")}
DONE = f"(SELECT person_id FROM {PUSHES} WHERE client_id = 'leadforge' AND platform = 'mail')"


def pushes_of(p: DataFrame) -> DataFrame:
    return p.where("source IS NOT NULL AND phone IS NOT NULL").select(F.col("id").alias("person_id"), F.col("source").alias("client_id"), F.when(F.col("email_status") == "ok", "crm").otherwise("mail").alias("platform"))


@query("push_person_pushed", f"SELECT id FROM people WHERE id IN {DONE}")
def push_person_pushed(c, p, spark, d):
    return ids(push_status.people(p, pushes_of(p), STATUS["pushed"]))


@query("push_person_not_pushed", f"SELECT id FROM people WHERE id NOT IN {DONE}")
def push_person_not_pushed(c, p, spark, d):
    return ids(push_status.people(p, pushes_of(p), STATUS["not_pushed"]))


@query("push_company_pushed", f"SELECT id FROM companies c WHERE EXISTS (SELECT 1 FROM people p WHERE p.company_id = c.id) AND NOT EXISTS (SELECT 1 FROM people p WHERE p.company_id = c.id AND p.id NOT IN {DONE})")
def push_company_pushed(c, p, spark, d):
    return ids(push_status.companies(c, p, pushes_of(p), STATUS["pushed"]))


@query("push_company_not_pushed", f"SELECT id FROM companies c WHERE EXISTS (SELECT 1 FROM people p WHERE p.company_id = c.id AND p.id NOT IN {DONE})")
def push_company_not_pushed(c, p, spark, d):
    return ids(push_status.companies(c, p, pushes_of(p), STATUS["not_pushed"]))


@query("push_counts_person", f"SELECT count(*) FILTER (id IN {DONE}) AS pushed, count(*) FILTER (id NOT IN {DONE}) AS not_pushed FROM people")
def push_counts_person(c, p, spark, d):
    return push_status.person_counts(p, pushes_of(p), STATUS["pushed"])


@query("push_counts_company", f"WITH s AS (SELECT company_id, bool_or(id NOT IN {DONE}) AS w FROM people WHERE company_id IS NOT NULL GROUP BY company_id) SELECT count(*) FILTER (NOT w) AS pushed, count(*) FILTER (w) AS not_pushed, count(*) FILTER (w IS NULL) AS without_people FROM companies LEFT JOIN s ON s.company_id = companies.id")
def push_counts_company(c, p, spark, d):
    return push_status.company_counts(c, p, pushes_of(p), STATUS["pushed"])


@query("push_history", f"SELECT h.person_id, h.client_id, h.platform, p.full_name, c.company_name FROM {PUSHES} h LEFT JOIN people p ON p.id = h.person_id LEFT JOIN companies c ON c.id = p.company_id WHERE h.platform = 'crm'")
def push_history(c, p, spark, d):
    h = pushes_of(p).where("platform = 'crm'").join(p.select(F.col("id").alias("person_id"), "full_name", "company_id"), "person_id", "left")
    return h.join(c.select(F.col("id").alias("company_id"), "company_name"), "company_id", "left").select("person_id", "client_id", "platform", "full_name", "company_name")


# -- dashboard --------------------------------------------------------------------------------------------------------
RANGE = X.Filters(created_from="2025-02-01", created_to="2025-09-01")
RANGE_SQL = "created_at >= TIMESTAMP '2025-02-01' AND created_at < TIMESTAMP '2025-09-01'"


@query("dashboard_totals", f"SELECT 'companies' AS what, count(*) AS n FROM companies WHERE {RANGE_SQL} UNION ALL SELECT 'people', count(*) FROM people WHERE {RANGE_SQL} UNION ALL SELECT 'pushes', count(*) FROM {PUSHES}")
def dashboard_totals(c, p, spark, d):
    return dashboard.totals(c, p, pushes_of(p), RANGE)


@query("dashboard_breakdown", facet_sql("companies", where=RANGE_SQL, columns={k: COMPANY_SQL[k] for k in ("niche", "industry", "country")}))
def dashboard_breakdown(c, p, spark, d):
    return dashboard.breakdown(c, RANGE)


@query("dashboard_recent", f"SELECT id, company_name, created_at FROM companies WHERE {RANGE_SQL} ORDER BY created_at DESC NULLS FIRST, id LIMIT 5")
def dashboard_recent(c, p, spark, d):
    return lists.newest(X.companies(c, RANGE), "created_at", 5).select("id", "company_name", "created_at")


TRADE_SQL = "(?i)" + "|".join(t.replace(" ", "\\s+") for t in dashboard.TRADES)


@query("niche_audit", f"SELECT CASE WHEN trim(coalesce(niche, '')) = '' THEN '(untagged)' ELSE trim(niche) END AS niche, CASE WHEN trim(coalesce(niche, '')) = '' THEN 'untagged' WHEN regexp_full_match(trim(niche), '[a-z0-9]+(-[a-z0-9]+)*') THEN 'real' ELSE 'category_leak' END AS kind, count(*) AS total, count(*) FILTER (trim(coalesce(industry, '')) <> '' OR trim(coalesce(description, '')) <> '') AS described, count(*) FILTER (kind = 'real' AND regexp_matches(CASE WHEN trim(coalesce(industry_id, '')) <> '' THEN industry_id ELSE coalesce(description, '') END, '{TRADE_SQL}')) AS mismatches, round(mismatches * 100.0 / total, 4) AS mismatch_percent FROM companies GROUP BY 1, 2")
def niche_audit(c, p, spark, d):
    return dashboard.niche_audit(c)


@query("status_histogram", "SELECT email_status, phone_status, count(*) AS n FROM people GROUP BY 1, 2")
def status_histogram(c, p, spark, d):
    return p.groupBy("email_status", "phone_status").agg(F.count("*").alias("n"))


# -- discovery --------------------------------------------------------------------------------------------------------
KV = """kv AS (SELECT k AS key, json_extract(custom_data, '$."' || k || '"') AS v, json_type(json_extract(custom_data, '$."' || k || '"')) AS t, json_extract_string(custom_data, '$."' || k || '"') AS s FROM (SELECT custom_data, unnest(json_keys(custom_data)) AS k FROM people WHERE json_type(custom_data) = 'OBJECT')
  WHERE NOT (k IN ('naics', 'aiark_id', 'industries', 'legal_name', 'ai_ark_approaches', 'pushed_to_clay', 'created_at', 'updated_at', 'company_type') OR starts_with(k, 'pushed_to_') OR ends_with(k, '_at'))),
typed AS (SELECT *, CASE WHEN t IS NULL OR t = 'NULL' THEN 'Empty' WHEN t = 'ARRAY' AND json_array_length(v) = 0 THEN 'Empty' WHEN t = 'ARRAY' THEN 'List' WHEN t = 'BOOLEAN' THEN 'Boolean' WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'Number' WHEN t = 'OBJECT' THEN 'Text'
  WHEN trim(s, ' ') IN ('', '-') OR regexp_full_match(s, '\\{\\{.*\\}\\}', 's') THEN 'Empty' WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}') THEN 'Date' WHEN regexp_full_match(s, '-?[0-9.]+') THEN 'Number' WHEN lower(s) IN ('true', 'false') THEN 'Boolean' ELSE 'Text' END AS type FROM kv)"""


@query("discover_types", f"WITH {KV}, n AS (SELECT key, type, count(*) AS n FROM typed GROUP BY ALL) SELECT key, CASE WHEN type = 'Empty' THEN 'Text' ELSE type END AS type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY type = 'Empty', n DESC, type) AS r FROM n) WHERE r = 1")
def discover_types(c, p, spark, d):
    return discovery.key_types(discovery.attributes(p))


# Objects as VARIANT prints them: keys in order, no blanks.
OBJECT = "'{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda k: '\"' || k || '\":' || CAST(json(json_extract(v, '$.\"' || k || '\"')) AS VARCHAR)), ',') || '}'"
ONE = f"one AS (SELECT key, CASE WHEN t = 'OBJECT' THEN {OBJECT} ELSE s END AS value FROM typed WHERE type NOT IN ('Empty', 'List') UNION ALL SELECT key, json_extract_string(e, '$') FROM (SELECT key, unnest(CAST(v AS JSON[])) AS e FROM typed WHERE type = 'List')), vn AS (SELECT key, value, count(*) AS n FROM one WHERE trim(value, ' ') NOT IN ('', '-') AND NOT regexp_full_match(value, '\\{{\\{{.*\\}}\\}}', 's') GROUP BY ALL), vr AS (SELECT key, value, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM vn)"


@query("discover_values", f"WITH {KV}, {ONE} SELECT key, value, n, CAST(r AS INT) AS rank FROM vr WHERE r <= 25")
def discover_values(c, p, spark, d):
    return discovery.key_values(discovery.attributes(p))


PERSON_KV = KV.replace("'company_type')", "'company_type', 'company_linkedin_id', 'connections_count', 'apollo_id')")


@query("discover_fields", f"WITH {PERSON_KV}, {ONE}, tn AS (SELECT key, type, count(*) AS n FROM typed GROUP BY ALL), tr AS (SELECT key, CASE WHEN type = 'Empty' THEN 'Text' ELSE type END AS type, row_number() OVER (PARTITION BY key ORDER BY type = 'Empty', n DESC, type) AS r FROM tn) SELECT tr.key, type, coalesce((SELECT string_agg(value, '|' ORDER BY vr.r) FROM vr WHERE vr.key = tr.key AND vr.r <= 25), '') AS samples FROM tr WHERE tr.r = 1")
def discover_fields(c, p, spark, d):
    return discovery.discover(p, C.PERSON_BLOCKED_KEYS).select("key", "type", F.array_join("sample_values", "|").alias("samples"))


# -- canonical values ----------------------------------------------------------------------------------------------------
WS = r"[\s\x{00A0}]"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query("normalize_domain", f"SELECT id, nullif(split_part(regexp_replace(regexp_replace(lower({STRIP('website_url')}), '^https?://', ''), '^www\\.', ''), '/', 1), '') AS domain FROM companies")
def normalize_domain(c, p, spark, d):
    return c.select("id", C.normalize_domain(F.col("website_url")).alias("domain"))


@query("normalize_linkedin", "SELECT id, CASE WHEN u LIKE 'linkedin.example/%' THEN 'https://www.' || u || '/' END AS page FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + STRIP("linkedin_url") + "), '^https?://', ''), '^(www\\.)?linkedin\\.example', 'linkedin.example'), '\\?.*$', '', 's'), '/$', '') AS u FROM companies)")
def normalize_linkedin(c, p, spark, d):
    return c.select("id", C.normalize_linkedin(F.col("linkedin_url"), "linkedin.example").alias("page"))


@query("normalize_industry", f"SELECT id, nullif(regexp_replace(replace(lower({STRIP('industry')}), ';', ','), '{WS}+', ' ', 'g'), '') AS industry FROM companies")
def normalize_industry(c, p, spark, d):
    return c.select("id", C.industry_id(F.col("industry")).alias("industry"))


ALIAS_SQL = "CASE " + " ".join(f"WHEN lower(x) = '{k}' THEN '{v}'" for k, v in C.COUNTRY_ALIASES.items()) + " ELSE upper(x) END"


@query("normalize_country", f"SELECT id, CASE WHEN x <> '' THEN {ALIAS_SQL} END AS country FROM (SELECT id, {STRIP('country')} AS x FROM companies)")
def normalize_country(c, p, spark, d):
    return c.select("id", C.country_id(F.col("country")).alias("country"))


@query("country_labels", "SELECT DISTINCT country_id, CASE code WHEN 'HK' THEN 'Hong Kong SAR China' WHEN 'TR' THEN 'Turkey' ELSE label END AS label FROM companies JOIN ref_items ON code = country_id")
def country_labels(c, p, spark, d):
    known = table(spark, d, "ref_items").where("code IS NOT NULL").select(F.col("code").alias("country_id"))
    used = c.where("country_id IS NOT NULL").select("country_id").distinct().join(known, "country_id", "left_semi")
    return used.select("country_id", C.country_label(F.col("country_id"), C.country_names(spark)).alias("label"))


@query("industry_labels", "SELECT DISTINCT industry_id, array_to_string(list_transform(list_filter(string_split(industry_id, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM companies WHERE industry_id IS NOT NULL")
def industry_labels(c, p, spark, d):
    return c.where("industry_id IS NOT NULL").select("industry_id").distinct().withColumn("label", C.industry_label(F.col("industry_id")))


@query("source_tokens", f"SELECT id, array_to_string(list_transform(list_filter(list_transform(l, lambda t, i: {{'t': t, 'i': i}}), lambda e: e.t <> '' AND list_position(l, e.t) = e.i), lambda e: e.t), '|') AS tokens FROM (SELECT id, list_transform(regexp_split_to_array(coalesce(source, ''), '[,&]'), lambda t: lower({STRIP('t')})) AS l FROM people)")
def source_tokens(c, p, spark, d):
    return p.select("id", F.array_join(C.source_tokens(F.col("source")), "|").alias("tokens"))


ACR = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ACRONYMS.items()) + " ELSE upper(w[1]) || w[2:] END"


@query("humanize_slug", f"SELECT DISTINCT niche, array_to_string(list_transform(list_filter(regexp_split_to_array(niche, '[-_]'), lambda w: w <> ''), lambda w: {ACR}), ' ') AS label FROM companies WHERE niche IS NOT NULL")
def humanize_slug(c, p, spark, d):
    return c.where("niche IS NOT NULL").select("niche").distinct().withColumn("label", C.humanize_slug(F.col("niche")))


@query("niches_from_tags", "WITH k AS (SELECT list(DISTINCT lower(trim(client))) AS names FROM companies WHERE client <> '') SELECT id, array_to_string(list_transform(list_filter(list_transform(coalesce(tags, []), lambda t, i: {'t': t, 'i': i}), lambda e: list_position(tags, e.t) = e.i AND NOT regexp_full_match(trim(e.t), '\\d{4}-\\d{2}-\\d{2}') AND NOT list_contains(names, lower(trim(e.t))) AND NOT starts_with(lower(trim(e.t)), 'campaign:')), lambda e: e.t), '|') AS niches FROM companies, k")
def niches_from_tags(c, p, spark, d):
    return ingest.with_niches(c.select("id", "tags"), lists.known_clients(c)).select("id", F.array_join("niches", "|").alias("niches"))


@query("derive_full_name", "SELECT id, CASE WHEN trim(coalesce(full_name, '')) <> '' THEN full_name ELSE coalesce(nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), ''), full_name) END AS full_name FROM people")
def derive_full_name(c, p, spark, d):
    return p.select("id", C.full_name(F.col("full_name"), F.col("first_name"), F.col("last_name")).alias("full_name"))


@query("safe_uuid", "SELECT id, CASE WHEN regexp_full_match(company_id, '(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN lower(company_id) END AS uuid FROM people")
def safe_uuid(c, p, spark, d):
    return p.select("id", C.safe_uuid(F.col("company_id")).alias("uuid"))


@query("csv_flatten", "SELECT id, CASE WHEN json_type(custom_data, '$.tech_stack') = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(custom_data, '$.tech_stack') AS JSON[]), lambda x: coalesce(json_extract_string(x, '$'), '')), ', ') ELSE coalesce(json_extract_string(custom_data, '$.tech_stack'), '') END AS cell FROM people")
def csv_flatten(c, p, spark, d):
    return p.select("id", flat(J.value(J.parsed(F.col("custom_data")), "tech_stack")).alias("cell"))


# -- ingest -----------------------------------------------------------------------------------------------------------
INSERTS = ["record_id", "company_name", "domain", "linkedin_url"]


def import_keys(df: DataFrame) -> DataFrame:
    return df.select("record_id", C.normalize_domain(F.col("domain")).alias("domain"), C.normalize_linkedin(F.col("linkedin_url"), "linkedin.example").alias("linkedin_url"))


def kept_sql(source: str, order: str, keys: list[str]) -> str:
    """Rows one after the other, each against the keys of those kept before: only rows that share a key with others need it."""
    filled = ", ".join(f"'{k}:' || nullif({k}, '')" for k in keys)
    return f"""WITH RECURSIVE t AS ({source}), e AS (SELECT {order} AS o, unnest(list_filter([{filled}], lambda x: x IS NOT NULL)) AS k FROM t),
many AS (SELECT k FROM e GROUP BY k HAVING count(*) > 1), r AS (SELECT o, list(k) AS ks, row_number() OVER (ORDER BY o) AS i FROM e WHERE k IN (FROM many) GROUP BY o),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS {'BIGINT' if order == 'record_id' else 'VARCHAR'}) AS o, CAST([] AS VARCHAR[]) AS seen, FALSE AS kept
  UNION ALL SELECT r.i, r.o, CASE WHEN list_has_any(s.seen, r.ks) THEN s.seen ELSE list_concat(s.seen, r.ks) END, NOT list_has_any(s.seen, r.ks) FROM s JOIN r ON r.i = s.i + 1),
kept AS (SELECT * FROM t WHERE {order} NOT IN (SELECT o FROM s WHERE NOT kept AND o IS NOT NULL))"""


def page_sql(x: str) -> str:
    return f"(SELECT CASE WHEN u LIKE 'linkedin.example/%' THEN 'https://www.' || u || '/' END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({STRIP(x)}), '^https?://', ''), '^(www\\.)?linkedin\\.example', 'linkedin.example'), '\\?.*$', '', 's'), '/$', '') AS u))"


def keys_sql(table_: str, *more: str) -> str:
    domain = f"nullif(split_part(regexp_replace(regexp_replace(lower({STRIP('domain')}), '^https?://', ''), '^www\\.', ''), '/', 1), '')"
    return f"SELECT {', '.join([*more, f'{domain} AS domain', page_sql('linkedin_url') + ' AS linkedin_url'])} FROM {table_}"


KEPT_INSERTS = kept_sql(keys_sql("step1_inserts", "record_id"), "record_id", ["domain", "linkedin_url"])


@query("dedupe_two_key", f"{KEPT_INSERTS} SELECT record_id, domain, linkedin_url FROM kept")
def dedupe_two_key(c, p, spark, d):
    return dedupe.keep_first(import_keys(table(spark, d, "step1_inserts")), "record_id", [F.col("domain"), F.col("linkedin_url")])


@query("dedupe_people", kept_sql("SELECT id, linkedin_url, lower(email) AS email FROM people", "id", ["linkedin_url", "email"]) + " SELECT id, linkedin_url, email FROM kept")
def dedupe_people(c, p, spark, d):
    return dedupe.keep_first(p.select("id", "linkedin_url", F.lower("email").alias("email")), "id", [F.col("linkedin_url"), F.col("email")])


@query("existing_keys", "SELECT s.record_id, (s.domain <> '' AND s.domain IN (SELECT domain FROM companies WHERE domain <> '')) IS TRUE OR (s.linkedin_url <> '' AND s.linkedin_url IN (SELECT linkedin_url FROM companies WHERE linkedin_url <> '')) IS TRUE AS \"exists\" FROM step1_inserts s")
def existing_keys(c, p, spark, d):
    return ingest.exists_in(table(spark, d, "step1_inserts").select(*INSERTS), c, ["domain", "linkedin_url"]).select("record_id", "exists")


@query("preflight_counts", f"{KEPT_INSERTS}, h AS ({keys_sql('companies')}), x AS (SELECT coalesce(domain IN (SELECT domain FROM h WHERE domain <> ''), FALSE) OR coalesce(linkedin_url IN (SELECT linkedin_url FROM h WHERE linkedin_url <> ''), FALSE) AS known FROM kept) SELECT (SELECT count(*) FROM step1_inserts) AS input, count(*) AS kept, count(*) FILTER (NOT known) AS inserts, count(*) FILTER (known) AS updates FROM x")
def preflight_counts(c, p, spark, d):
    held = c.select(C.normalize_domain(F.col("domain")).alias("domain"), C.normalize_linkedin(F.col("linkedin_url"), "linkedin.example").alias("linkedin_url"))
    return ingest.preflight(import_keys(table(spark, d, "step1_inserts")), held, "record_id", ["domain", "linkedin_url"])


@query("mapped_rows", "SELECT row_id, nullif(company_name, '') AS company_name, nullif(website, '') AS website_url, nullif(company_linkedin_url, '') AS linkedin_url, try_cast(CASE WHEN regexp_full_match(regexp_replace(employees, '[,\\s]', '', 'g'), '\\d+') THEN regexp_replace(employees, '[,\\s]', '', 'g') END AS INT) AS employee_count, nullif(industry, '') AS industry, nullif(corporate_phone, '') AS phone FROM apollo_companies WHERE coalesce(nullif(company_name, ''), nullif(company_linkedin_url, '')) IS NOT NULL")
def mapped_rows(c, p, spark, d):
    a = table(spark, d, "apollo_companies")
    mapping = {"row_id": "row_id", "company_name": "company_name", "website": "website_url", "company_linkedin_url": "linkedin_url", "employees": "employee_count", "industry": "industry", "corporate_phone": "phone"}
    return ingest.map_rows(a.withColumn("row_id", F.col("row_id").cast("string")), mapping).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("upsert_latest", "SELECT import_id, record_id, company_name FROM (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY record_id DESC) AS r FROM step1_inserts) WHERE r = 1")
def upsert_latest(c, p, spark, d):
    s = table(spark, d, "step1_inserts").select("import_id", "record_id", "company_name")
    half = F.col("record_id") % 2 == 0
    return ingest.upsert(s.where(half), s.where(~half), ["import_id"], "record_id")


@query("merge_custom_data", f"SELECT id, CASE WHEN {js('tier')} IS NULL OR {js('tier')} = 'gold' THEN 'gold' ELSE {js('tier')} || ', gold' END AS tier, source AS origin, {js('lead_score')} AS lead_score FROM people")
def merge_custom_data(c, p, spark, d):
    new = F.to_json(F.struct(F.lit("gold").alias("tier"), F.col("source").alias("origin")))
    m = p.select("id", ingest.merged_json(F.col("custom_data"), new).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return m.select("id", at("tier"), at("origin"), at("lead_score"))


MERGED = {"company_name": "name", "industry": "ind", "city": "c"}


@query("merge_companies_snapshot", f"""WITH n AS (SELECT domain AS d, min_by(struct_pack(name := company_name, ind := industry, c := city, n := employee_count), row_id) AS x FROM enrichment_aiark WHERE domain <> '' GROUP BY domain), j AS (SELECT companies.*, n.x, n.d IS NOT NULL AS hit FROM companies LEFT JOIN n ON nullif(companies.domain, '') = n.d)
SELECT id, {', '.join(f"coalesce(nullif(x.{v}, ''), {k}) AS {k}" for k, v in MERGED.items())}, CASE WHEN hit AND regexp_full_match(x.n, '[0-9]+') THEN coalesce(try_cast(x.n AS INT), employee_count) ELSE employee_count END AS employee_count, CASE WHEN hit THEN 'tidewell,solar' ELSE array_to_string(tags, ',') END AS tags,
  CASE WHEN NOT hit THEN source WHEN coalesce(source, '') = '' THEN 'cardfile' WHEN contains(source, 'cardfile') THEN source ELSE source || ',cardfile' END AS source, array_to_string(list_sort(list_distinct(CASE WHEN hit THEN coalesce(source_tokens, []) || ['cardfile'] ELSE source_tokens END)), ',') AS tokens,
  CASE WHEN NOT hit THEN {js('tier')} WHEN {js('tier')} IS NULL OR {js('tier')} = 'gold' THEN 'gold' ELSE {js('tier')} || ', gold' END AS tier, {js('lead_score')} AS lead_score FROM j""")
def merge_companies_snapshot(c, p, spark, d):
    e = table(spark, d, "enrichment_aiark").where("domain <> ''")
    new = e.groupBy("domain").agg(F.min_by(F.struct(*MERGED, "employee_count"), "row_id").alias("x")).select("domain", "x.*")
    count = F.when(F.col("employee_count").rlike("^[0-9]+$"), F.col("employee_count")).try_cast("int")
    new = new.withColumns({"employee_count": count, "linkedin_url": F.lit(None).cast("string"), "tags": F.array(F.lit("tidewell"), F.lit("solar")), "source": F.lit("cardfile"), "source_tokens": F.array(F.lit("cardfile")), "custom_data": F.lit('{"tier": "gold"}')})
    out = ingest.merge_companies(c, new, list(MERGED), ["employee_count"])
    v = J.parsed(F.col("custom_data"))
    tokens = F.array_join(F.array_sort(F.array_distinct("source_tokens")), ",").alias("tokens")
    return out.select("id", *MERGED, "employee_count", F.array_join("tags", ",").alias("tags"), "source", tokens, J.text(J.value(v, "tier")).alias("tier"), J.text(J.value(v, "lead_score")).alias("lead_score"))


@query("propagate_company_fields", "WITH k AS (SELECT list(DISTINCT lower(trim(client))) AS names FROM companies WHERE client <> ''), t AS (SELECT id, list_transform(list_filter(list_transform(coalesce(tags, []), lambda t, i: {'t': t, 'i': i}), lambda e: list_position(tags, e.t) = e.i AND NOT regexp_full_match(trim(e.t), '\\d{4}-\\d{2}-\\d{2}') AND NOT list_contains(names, lower(trim(e.t))) AND NOT starts_with(lower(trim(e.t)), 'campaign:')), lambda e: e.t) AS niches FROM people, k) SELECT p.id, coalesce(c.industry_id, p.industry_id) AS industry_id, coalesce(c.employee_count, p.employee_count) AS employee_count, coalesce(c.linkedin_url, p.company_linkedin_url) AS company_linkedin_url, CASE WHEN trim(coalesce(c.niche, '')) <> '' THEN trim(c.niche) ELSE array_to_string(t.niches, '|') END AS niches FROM people p JOIN t USING (id) LEFT JOIN companies c ON c.id = p.company_id")
def propagate_company_fields(c, p, spark, d):
    out = ingest.propagate(p, c, lists.known_clients(c))
    return out.select("id", "industry_id", "employee_count", "company_linkedin_url", F.array_join("niche_tokens", "|").alias("niches"))


@query("stale_canonical_columns", f"SELECT count(*) FILTER (industry_id IS DISTINCT FROM nullif(regexp_replace(replace(lower({STRIP('industry')}), ';', ','), '{WS}+', ' ', 'g'), '')) AS industries, count(*) AS n FROM companies")
def stale_canonical_columns(c, p, spark, d):
    return c.agg(F.count_if(~F.col("industry_id").eqNullSafe(C.industry_id(F.col("industry")))).alias("industries"), F.count("*").alias("n"))
