"""Leaf and group cases of the JSON predicate engine."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import jsonval as J
from lodestrata.operators import json_predicates as P

MISSING = object()
CASES = [
    ("Number", "gt", 50, ["90", 90], ["9", MISSING, "9e9"]),
    ("Number", "between", [0, 100], ["10"], ["$10", "-", "{{ 0 }}", "20%", MISSING, " 5 "]),
    ("Number", "is_not", 5, ["6", 6.5], ["5", "x", MISSING]),
    ("Date", "before", "2025-06-01", ["2025-05-05"], ["2025-07-01", 20250505]),
    ("Date", "on", "2025-05-05", ["2025-05-05"], ["not-a-date", "-", "2025-05-05T10:00"]),
    ("Date", "after", "2025-05-05", ["2025-05-05T10:00"], ["2025-05-05", MISSING]),
    ("Boolean", "is_true", None, [True, "true", "YES", "1"], [False, "-", MISSING, 1, " true"]),
    ("Boolean", "is_false", None, [False, "no", "0"], [True, "-", MISSING, 0]),
    ("List", "contains", "a3", [["a3", "a4"]], [["a30"], "a3, a30", MISSING]),
    ("List", "not_contains", "a3", [["a30"], MISSING, "a3"], [["a3", "a4"]]),
    ("List", "contains", ["a3", "a4"], [["a3"], ["a4", "a5"]], [["a30"], MISSING]),
    ("List", "contains", "1", [["1"]], [[1]]),
    ("List", "is_empty", None, [[], MISSING, None], [["x"], {}]),
    ("Text", "is", "gold", ["gold"], ["silver", "Gold", MISSING]),
    ("Text", "is_not", ["gold", "silver"], ["bronze", MISSING], ["gold", "silver"]),
    ("Text", "contains", ["fintech", "insurtech"], ["B2B Fintech SaaS", "InsurTech platform"], ["Healthtech", MISSING]),
    ("Text", "not_contains", ["fintech"], ["Healthtech", MISSING], ["B2B Fintech SaaS"]),
    ("Text", "contains", "software", ["Business Software", ["software", "retail"]], [["retail"], MISSING]),
    ("Text", "contains", "a\\q", ["xA\\Qx"], ["aq"]),
    ("Text", "is_empty", None, [None, "", "   ", "-", "{{ 0 }}", [], MISSING, " {{a\nb}} "], ["real", "0", ["a3"], 0, {}, False]),
    ("Text", "is_not_empty", None, ["real", 0, False], ["", MISSING]),
]


@pytest.mark.parametrize("type_,op,value,yes,no", CASES)
def test_leaf(spark, type_, op, value, yes, no):
    key = "it's a \"key\" x"
    rows = [(i, None if v is MISSING and i % 2 else json.dumps({} if v is MISSING else {key: v}), i < len(yes)) for i, v in enumerate(yes + no)]
    df = spark.createDataFrame(rows, "i int, custom_data string, want boolean").withColumn("v", J.parsed(F.col("custom_data")))
    fs = P.filter_set([{"key": key, "type": type_, "operator": op, "value": value}])
    got = {r["i"]: r["m"] for r in df.select("i", P.matches(F.col("v"), fs).alias("m")).collect()}
    assert got == {i: w for i, _, w in rows}


H = {"key": "lead_score", "type": "Number", "operator": "gt", "value": 50}
G = {"key": "tier", "type": "Text", "operator": "is", "value": "gold"}
S = {"key": "tier", "type": "Text", "operator": "is", "value": "silver"}


@pytest.mark.parametrize(
    "request_,want",
    [
        ({"combinator": "and", "groups": []}, {"gold90", "silver90", "bronze90", "gold10", "bronze10"}),
        ([H, G], {"gold90"}),
        ({"groups": [{"combinator": "or", "conditions": [G, S]}]}, {"gold90", "silver90", "gold10"}),
        ({"combinator": "and", "groups": [{"combinator": "or", "conditions": [G, S]}, {"conditions": [H]}]}, {"gold90", "silver90"}),
        ({"combinator": "or", "groups": [{"conditions": [H]}, {"conditions": [G]}]}, {"gold90", "silver90", "bronze90", "gold10"}),
    ],
)
def test_groups(spark, request_, want):
    rows = [(t + n, json.dumps({"tier": t, "lead_score": int(n)})) for t, n in (("gold", "90"), ("silver", "90"), ("bronze", "90"), ("gold", "10"), ("bronze", "10"))]
    df = spark.createDataFrame(rows, "id string, c string")
    assert {r[0] for r in df.where(P.matches(J.parsed(F.col("c")), P.filter_set(request_))).collect()} == want


def test_validation():
    assert P.filter_set("x") is None and P.filter_set([]) is None
    assert P.filter_set([{"key": "", "type": "Text", "operator": "is", "value": "a"}, {"key": "k", "type": "Number", "operator": "gt", "value": float("nan")}]) is None
    assert P.filter_set([{"key": "k", "type": "Number", "operator": "gt", "value": True}]) is None
    assert P.filter_set([{"key": "k", "type": "Date", "operator": "between", "value": ["2025-01-01"]}]) is None
    fs = P.filter_set({"combinator": "or", "groups": [{"conditions": [G, {"bad": 1}]}, {"conditions": []}]})
    assert fs == P.FilterSet("or", (P.Group("and", (P.Condition("tier", "Text", "is", "gold"),)),))
    assert P.without_column(fs, "tier") is None and P.without_column(fs, "x") == fs


def test_broken_records(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "[]"), (4, '{"a": 1, "a": 2}'), (5, '{"a": 1}')], "id int, c string")
    fs = P.filter_set([{"key": "a", "type": "Number", "operator": "is", "value": 1}])
    assert [r[0] for r in df.where(P.matches(J.parsed(F.col("c")), fs)).collect()] == [5]
