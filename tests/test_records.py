"""Lookups, payloads, merges and histories on edge cases, and their queries against SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestrata import session
from lodestrata.functions import jsonval as J
from lodestrata.operators import dedupe, facets, ingest, packed, payloads, profile, records, units
from lodestrata.plans import records as plans
from lodestrata.plans.reference import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x if not hasattr(x, "isoformat") else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    names = [k for k in QUERIES if getattr(plans, k, None) is not None] + ["dedupe_two_key", "dedupe_people", "preflight_counts", "merge_companies_snapshot", "niches_from_tags", "source_tokens"]
    assert len(names) > 30
    for name in names:
        got = QUERIES[name](spark, DATA)
        cols = sorted(got.columns)
        mine = sorted([tuple(cell(r[c]) for c in cols) for r in got.collect()], key=repr)
        cur = con.execute(ORACLES[name])
        head = [x[0] for x in cur.description]
        theirs = sorted([tuple(cell(r[head.index(c)]) for c in cols) for r in cur.fetchall()], key=repr)
        assert sorted(head) == cols and mine == theirs, name


def test_pages_after_a_row(spark):
    df = spark.createDataFrame([(f"{i:02d}", None if i % 4 == 0 else f"2025-01-{1 + i % 3:02d} 00:00:00") for i in range(23)], "id string, t string").select("id", F.col("t").cast("timestamp").alias("last_updated"))
    whole = [tuple(r) for r in df.orderBy(F.desc_nulls_last("last_updated"), "id").select("last_updated", "id").collect()]
    got, last = [], None
    while rows := [tuple(r) for r in records.page_after(df, last, 4).select("last_updated", "id").collect()]:
        got, last = got + rows, rows[-1]
    assert got == whole


def test_failures(spark):
    codes = ['23502: null value in column "company_name" violates', "23505: x", "23503: y", "22P02: z", "Import was stopped", "?", None]
    df = spark.createDataFrame([(c,) for c in codes], "r string").select(records.failure_sentence(F.col("r")).alias("m"))
    got = [r["m"] for r in df.collect()]
    assert got[0] == 'Missing a required value for "company name".' and got[1].startswith("Duplicate") and got[2].startswith("Refers") and got[3].startswith("One or more") and "interrupted" in got[4] and got[5] == got[6]
    h = spark.createDataFrame([('[{"reason": "23505: x"}, {"reason": "23505: y"}, {}]',), (None,), ("{",), ("[]",)], "failed_records string")
    assert sorted(r["n"] for r in records.failures(h).collect()) == [1, 2]


def test_merge_people(spark):
    held = spark.createDataFrame(
        [("1", "p1", "A@x.test", None, ["t"], "apollo-scraped", ["a"], "old", 5, None, None, '{"k": "v", "n": 1}', "DE", None), ("2", None, "b@x.test", "c9", None, None, None, None, None, "cl", ["n"], None, "FR", None), ("3", "p3", "b@x.test", None, None, "s", None, None, None, None, None, "x", None, None)],
        "id string, linkedin_url string, email string, company_id string, tags array<string>, source string, source_tokens array<string>, industry_id string, employee_count int, company_linkedin_url string, niche_tokens array<string>, custom_data string, country_id string, last_updated string",
    )
    new = spark.createDataFrame(
        [("p1", "b@x.test", "c1", ["u"], "apollo", ["b", "a"], None, "12", None, None, '{"k": "w"}', "t1"), (None, "B@X.test", None, None, "z", ["z"], "ind", "a lot", None, ["m"], "[]", "t2")],
        "linkedin_url string, email string, company_id string, tags array<string>, source string, source_tokens array<string>, industry_id string, employee_count string, company_linkedin_url string, niche_tokens array<string>, custom_data string, last_updated string",
    )
    got = {r["id"]: r for r in ingest.merge_people(held, new).collect()}
    a, b, c = got["1"], got["2"], got["3"]
    assert (a["company_id"], a["tags"], a["source"], sorted(a["source_tokens"]), a["industry_id"], a["employee_count"], a["last_updated"]) == ("c1", ["u"], "apollo-scraped", ["a", "b"], "old", 12, "t1") and '"v, w"' in a["custom_data"]
    assert (b["company_id"], b["source"], b["industry_id"], b["employee_count"], b["niche_tokens"], b["custom_data"], b["country_id"]) == ("c9", "z", "ind", None, ["m"], None, "FR")
    assert c["last_updated"] == "t2" and c["source"] == "s,z" and c["custom_data"] == "x"  # a mail address matches all that hold it
    assert ingest.merge_people(held, new.limit(0)).count() == 3 and ingest.merge_people(held.limit(0), new).count() == 0


def test_payloads(spark):
    df = spark.createDataFrame([("1", "Acme Ltd", "Acme", "a@x.test", '{"pushed_to_clay": true, "founded_at": "2020", "email": "other", "list": ["a", 2], "e": [], "z": null}'), ("2", None, None, None, None), ("3", "B", "", "b", "[1]")], "id string, company_name string, brand_name string, email string, custom_data string")
    got = {r["id"]: r["payload"] for r in payloads.webhook_payload(df, {"company": "company_name", "email": "email"}).collect()}
    assert got["1"] == {"founded_at": '"2020"', "email": '"a@x.test"', "list": '["a",2]', "e": "[]", "z": "null", "company": '"Acme Ltd"'} and got["2"] == {"company": "null", "email": "null"}
    out = {r["id"]: r for r in payloads.contact_record(df, {"email": "email"}, None, {"name": "companyName", "l": "list", "e": "e", "z": "z", "m": "email"}).collect()}
    assert out["1"]["variables"] == {"name": "Acme", "l": "a, 2", "m": "a@x.test"} and out["1"]["companyName"] == "Acme" and out["3"]["companyName"] == "B" and out["2"]["variables"] == {}
    shown = {r["id"]: sorted(r["m"]) for r in df.select("id", F.map_keys(payloads.shown_attributes(F.col("custom_data"))).alias("m")).collect()}
    assert shown == {"1": ["email", "list"], "2": [], "3": []}
    assert df.limit(0).select(payloads.campaign_tag(F.lit("c"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(" "), F.lit("s"))).count() == 0
    assert df.limit(1).select(payloads.campaign_tag(F.lit("c"), F.lit(None).cast("string"), F.lit(60), F.lit(" "), F.lit("s"), " x ").alias("t")).first()["t"] == "c - Unknown | 51–200 | Unknown | s | x"


def test_checked_rows(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, n string")
    good, bad = records.checked(df, {"n": F.col("n").rlike("^[0-9]+$")})
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and [(r["id"], r["reasons"]) for r in bad.collect()] == [(2, ["n"])]
    kept = good.withColumn("exists", F.col("id") == 1)
    assert tuple(records.import_summary(df, kept, bad).first()) == (3, 2, 1, 1, 1)


def test_tags_that_name_clients(spark):
    df = spark.createDataFrame([("1", ["Acme", "x", "2025-01-01", "x"]), ("2", None), ("3", []), ("4", ["niche:y", "x"])], "id string, tags array<string>")
    clients = spark.createDataFrame([("acme",), ("acme",)], "client string")
    assert {r["id"]: r["niches"] for r in ingest.with_niches(df, clients).collect()} == {"1": ["x"], "2": [], "3": [], "4": ["y"]}


def test_long_values_have_codes(spark):
    long = "the very long name of a source, " * 3 + "that is one token"
    rows = [(str(i), None, [f'"{long}"']) for i in range(40)] + [("a", None, [f"{long}; web"]), ("b", None, [f"web; {long}"])]
    df = spark.createDataFrame(rows, "id string, email string, tokens array<string>")
    got = sorted((r["company_id"], r["pos"], r["value"]) for r in packed.unpack(df, "id", "email", "tokens").collect())
    assert got == [("a", 1, long), ("a", 2, "web"), ("b", 1, "web"), ("b", 2, long)]


def test_many_delimiters():
    names = [f"n{i}" for i in range(9)]
    r = packed.Reader("token", {n: 3.0 for n in names} | {"a/b": 3.0, "c+d": 3.0})
    assert r.parse("n0,n1;n2|n3 > n4 · n5,a/b,c+d") == ["n0", "n1", "n2", "n3", "n4", "n5", "a/b", "c+d"]
    assert r.parse('"x/y;z|w" , n1') == ["x/y;z|w", "n1"]


def test_amounts_of_any_length(spark):
    rates = spark.createDataFrame([("EUR", 1.0)], "currency string, usd_per_unit double")
    pad = " " * 300
    rows = [(1, f"about{pad}5 k people", None, None), (2, None, "1" * 60 + " EUR", None), (3, "9" * 5_000 + " people", "EUR 1e400", None), (4, "x" * 100_000 + " 5", None, None), (5, "0" * 50 + "7 staff", None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, employee_count string, revenue string, description string")
    got = sorted(tuple(r) for r in units.read_quantities(df, "row_id", ["employee_count", "revenue"], "description", rates).collect())
    assert got == [(1, "employee_count", 5000, 5000), (2, "revenue", units.MOST, units.MOST), (3, "employee_count", units.MOST, units.MOST), (3, "revenue", units.MOST, units.MOST), (5, "employee_count", 7, 7)]


def test_profile_of_parts(spark):
    rows = [(i % 2, i, None if i % 5 == 0 else str(1990 + i % 7), "x") for i in range(40)] + [(None, 99, "1999", "x")]
    df = spark.createDataFrame(rows, "load_id int, row_id int, founded_year string, n string")
    cells = profile.classified(df, "load_id", "row_id", [profile.year_rule()])
    parts = [profile.power_sums(profile.value_counts(cells.where(w))) for w in ("row_id < 13", "row_id >= 13")]
    merged = profile.described(profile.merged_sums(parts[0].unionByName(parts[1]))).drop("n_distinct")
    whole = profile.profile(cells).drop("n_distinct")
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.select(merged.columns).collect()))
    assert profile.profile(cells.limit(0)).count() == 0


def test_dedupe_never_drops_silently(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "a", "b"), (3, "", "b")], "o int, x string, y string")
    keys = [F.col("x"), F.col("y")]
    assert sorted(r["o"] for r in dedupe.keep_first(df, "o", keys).collect()) == [1, 3]
    with pytest.raises(RuntimeError):
        dedupe.keep_first(df, "o", keys, max_rounds=1)


def test_repeated_keys_and_limits(spark):
    session.expose(spark)
    df = spark.createDataFrame([('{"a": 1, "a": "two"}',)], "custom_data string")
    assert df.select(J.text(J.value(J.parsed(F.col("custom_data")), "a")).alias("a")).first()["a"] == "two"
    n = spark.createDataFrame([("d", "x", 3), ("d", "y", 3), ("d", "z", 9), ("e", "x", 1)], "dim string, id string, n bigint")
    assert sorted((r["dim"], r["id"], r["rank"]) for r in facets.ranked(n, 2).collect()) == [("d", "x", 2), ("d", "z", 1), ("e", "x", 1)]
    assert {r["dim"]: r["values"] for r in facets.as_json(n, 1).collect()} == {"d": '[{"id":"z","count":9}]', "e": '[{"id":"x","count":1}]'}


def test_upsert_ties(spark):
    rows = [("k", 1, "b"), ("k", 1, "a")]
    new = spark.createDataFrame(rows, "k string, t int, v string")
    assert [r["v"] for r in ingest.upsert(new.limit(0), new, ["k"], "t").collect()] == ["a"]
