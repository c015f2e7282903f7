"""Packed fields, quantities and profiles on edge cases, and against brute force."""

from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import packed, profile, units

RATES = {"USD": Q(1), "EUR": Q("1.1"), "GBP": Q("1.25"), "INR": Q("0.012"), "JPY": Q("0.0068"), "SEK": Q("0.095"), "CAD": Q("0.75"), "BRL": Q("0.2"), "CHF": Q("1.12")}
PEOPLE = {
    "1,001 - 5,000 employees": (1001, 5000), "11 to 50": (11, 50), "between 51 and 200": (51, 200), "501..1,000": (501, 1000), "10k+": (10000, -1), "1000 or more": (1000, -1), "5,000+": (5000, -1),
    "7.210 empleados": (7210, 7210), "1 176 salariés": (1176, 1176), "1'629": (1629, 1629), "8.2K": (8200, 8200), "3.6 k employees": (3600, 3600), "2.3e2": (230, 230), "sixty-eight": (68, 68),
    "about thirty-two": (32, 32), "thirty-three people": (33, 33), "21 dozen": (252, 252), "19 doz.": (228, 228), "approx 19.5 hundred": (1950, 1950), "6.5 (hundreds)": (650, 650), "1.5 x100": (150, 150),
    "team of 41": (41, 41), "ca. 38 people": (38, 38), "~9": (9, 9), "34.0": (34, 34), "Headcount: 936": (936, 936), "5 FTE": (5, 5), "c. 12": (12, 12), "9 436": (9436, 9436),
    "see website": None, "unknown": None, "n/a": None, "-": None, "12 May 2020": None, "1-2-3": None, "x" * 5000: None,
}
MONEY = {
    "$200,000.00": (200000, 200000), "USD 25,000,000 - 100,000,000": (25000000, 100000000), "10-25 million USD": (10000000, 25000000), "$500k-$1 mn": (500000, 1000000), "€5 mio-€10M": (5500000, 11000000),
    "between 25 million and 100 mio US dollars": (25000000, 100000000), "over $500 mn": (500000000, -1), "$10bn+": (10000000000, -1), "12,70 Mio. EUR": (13970000, 13970000), "280.000 €": (308000, 308000),
    "Umsatz 27.200.000 Euro": (29920000, 29920000), "CHF 1'200'000": (1344000, 1344000), "EUR 85 800 000": (94380000, 94380000), "Rs. 34 crore (INR)": (4080000, 4080000), "₹56 lakh": (67200, 67200),
    "253 MSEK": (24035000, 24035000), "11.9 bn JPY": (80920000, 80920000), "R$ 332 milhões": (66400000, 66400000), "USD 9,700K": (9700000, 9700000), "32,400 (USD thousands)": (32400000, 32400000),
    "US$ '000: 56300": (56300000, 56300000), "€430K MRR": (5676000, 5676000), "$230K per quarter": (920000, 920000), "monthly GBP 440,000": (6600000, 6600000), "£390K/mo": (5850000, 5850000), "£130k / Q": (650000, 650000),
    "~$99.4MM annually": (99400000, 99400000), "C$660K": (495000, 495000), "undisclosed": None, "pre-revenue?": None, "Q3": None,
}


@pytest.mark.parametrize("field,cases", [("employee_count", PEOPLE), ("revenue", MONEY)])
def test_grammar(field, cases):
    g = units.grammars(RATES)[field]
    assert {k: g.parse(k) for k in cases} == cases


def test_context():
    g = units.grammars(RATES)["revenue"]
    for text, number, want in (("Figures in CAD million. A name.", "29.8", 22350000), ("Revenue is reported in millions of euro.", "15.2", 16720000), ("Turnover stated in GBP '000.", "3,300", 4125000), ("Revenue is reported in millions of Canadian dollars", "46", 34500000)):
        assert g.parse(number, g.context(text)) == (want, want)
    assert g.context("We work in cyber defence.") is None and g.context(None) is None


def test_units_with_offset():
    c = units.Unit(Q(5, 9), (0, 0, 1), Q(-160, 9))
    assert c.convert(Q(212)) == 100


def test_quantities_frame(spark):
    schema = "row_id bigint, employee_count string, revenue string, description string, extra string"
    rows = [(1, "410", "260000", None, "x"), (2, None, "", " ", None), (3, "10k+", "39800", "Turnover stated in CAD '000.", None), (3, "10k+", "39800", "Turnover stated in CAD '000.", None), (4, "5", "5000000", "Figures in USD million.", None)]
    fx = spark.createDataFrame([("USD", 1.0), ("CAD", 0.75), (None, 1.0)], "currency string, usd_per_unit double")
    got = sorted(tuple(r) for r in units.read_quantities(spark.createDataFrame(rows, schema), "row_id", ["employee_count", "revenue"], "description", fx).collect())
    assert got == [(3, "employee_count", 10000, -1), (3, "revenue", 29850000, 29850000), (4, "revenue", 5000000000000, 5000000000000)]
    assert units.read_quantities(spark.createDataFrame([], schema), "row_id", ["revenue"], "description", fx).count() == 0


def unpacked(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, email string, source_tokens array<string>, value string")
    out = {}
    for r in packed.unpack(df, "id", "email", "source_tokens").orderBy("company_id", "field_name", "pos").collect():
        out.setdefault((r["company_id"], r["field_name"]), []).append(r["value"])
    return out


def test_packed_emails(spark):
    cases = {
        "a@x.test; b@y.test": ["a@x.test", "b@y.test"], '"Doe, J" <j+crm@x.test>, "Roe, R" <R@y.test>': ["j+crm@x.test", "r@y.test"], "{a@x.test,,b+eu@x.test}": ["a@x.test", "b+eu@x.test"],
        '["a@x.test", "a@x.test"]': ["a@x.test", "a@x.test"], "'a@x.test'; 'b@x.test'": ["a@x.test", "b@x.test"], "mailto:a@x.test mailto:b@x.test": ["a@x.test", "b@x.test"], "a@x.test + b+c@x.test": ["a@x.test", "b+c@x.test"],
        "a@x.test and b@x.test": ["a@x.test", "b@x.test"], "a@x.test\r\nb@x.test，c@x.test": ["a@x.test", "b@x.test", "c@x.test"], "Emails: a@x.test; b@x.test": ["a@x.test", "b@x.test"],
        "Jane Roe <jane@x.test>": None, "jane+crm@x.test;": None, "": None, "none": None, None: None,
    }
    got = unpacked(spark, [(str(i), e, None) for i, e in enumerate(cases)])
    assert got == {(str(i), "email"): v for i, v in enumerate(cases.values()) if v}


def test_packed_tokens(spark):
    common = [(f"c{i}", None, [t]) for i in range(30) for t in ("harbor-api", "leadforge", "storewatch")]
    cases = [
        (["harbor-api/storewatch"], ["harbor-api", "storewatch"]), (['leadforge, "a/b; c & d",,storewatch'], ["leadforge", "a/b; c & d", "storewatch"]), (["Leadforge > STOREWATCH", "harbor-api", None, ""], ["leadforge", "storewatch", "harbor-api"]),
        (["harbor-api"], None), (['"inbound; web form"'], None), ([], None), (None, None), (["leadforge\tstorewatch|harbor-api"], ["leadforge", "storewatch", "harbor-api"]), ([' leadforge, '], None), ([";" * 3000], None),
    ]
    got = unpacked(spark, common + [(f"x{i}", None, a) for i, (a, _) in enumerate(cases)])
    assert got == {(f"x{i}", "source_tokens"): v for i, (_, v) in enumerate(cases) if v}


def test_packed_empty(spark):
    assert unpacked(spark, []) == {}


GOOD = {"phone": ["+1-777-555-0132", "(307) 555-0175", "041 5557 7187", "+497155550136 ext. 525", "266.555.0165 x7"], "founded_year": ["1800", "2025"], "website": ["https://a.example/x?y", "a-b.co.example:8080/", "WWW.a.test", "HTTP://a.b"]}
BAD = {"phone": ["+1-777-55", "1.31E+10", "555-CALL-HAJE", "1111111", "+44 20 7946 0146 (ask for Jo)", "ext. 400", "1 415 555 0182, 2", "1234567890123456"], "founded_year": ["1799", "2026", "c. 1999", "2003.0", "22", "2OO8"], "website": ["a,example", "htp://a.example", "https://https://a.b", "a", "a..b", "x@y.z q", "http:/a.b"]}


def test_profile(spark):
    rows = []
    for vals in (GOOD, BAD):
        for c, vs in vals.items():
            rows += [(1, len(rows) + i, *[v if n == c else None for n in ("phone", "founded_year", "website")], "clash") for i, v in enumerate(vs)]
    rows = [(load, i, *rest) for i, (load, _, *rest) in enumerate(rows)]
    schema = "load_id bigint, row_id bigint, phone string, founded_year string, website string, value string"
    rules = [profile.phone_rule(), profile.year_rule(), profile.website_rule()]
    df = spark.createDataFrame(rows, schema)
    cells = profile.classified(df, "load_id", "row_id", rules)
    assert {r["value"] for r in cells.where("class = 'bad'").collect()} == {v for vs in BAD.values() for v in vs}
    got = profile.quality_issues(df, "load_id", "row_id", rules).collect()
    assert len(got) == sum(map(len, BAD.values())) and {r["issue"] for r in got} == {"bad_value"}  # one load is never shifted
    empty = profile.quality_issues(df.limit(0), "load_id", "row_id", rules)
    assert empty.count() == 0


def test_shift_and_power_sums(spark):
    rows = [(1, i, "1999" if i % 2 else "-") for i in range(10)] + [(2, 10 + i, "2001") for i in range(10)] + [(None, 30, " ")]
    df = spark.createDataFrame(rows, "load_id bigint, row_id bigint, founded_year string")
    cells = profile.classified(df, "load_id", "row_id", [profile.year_rule()])
    d = {r["load_id"]: round(r["distance"], 6) for r in profile.class_shifts(cells).collect()}
    assert d == {1: round(max(0, 5 / 10 - 1 / 11) + 5 / 10, 6), 2: 1.0, None: round(1 - 5 / 20, 6)}
    p = {r["load_id"]: r for r in profile.profile(cells).collect()}
    assert (p[1]["n_rows"], p[1]["n_missing"], p[1]["n_distinct"], p[1]["mean"], p[1]["stddev"]) == (10, 5, 1, 1999.0, 0.0)
    assert p[2]["std_difference"] is None and p[None]["mean"] is None


def test_profile_sums_merge(spark):
    """The power sums of parts add up to those of the whole."""
    df = spark.range(100).select(F.lit(1).alias("load_id"), F.col("id").alias("row_id"), (F.col("id") + 1900).cast("string").alias("founded_year"))
    whole = profile.profile(profile.classified(df, "load_id", "row_id", [profile.year_rule()])).first()
    xs = [1900 + i for i in range(100)]
    assert whole["mean"] == sum(xs) / 100 and abs(whole["stddev"] - (sum(x * x for x in xs) / 100 - (sum(xs) / 100) ** 2) ** 0.5) < 1e-3
