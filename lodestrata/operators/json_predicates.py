"""Dynamically typed predicates over JSON attributes, in two levels of AND/OR groups.

A filter set is {"combinator": "and"|"or", "groups": [{"combinator", "conditions": [{"key", "type", "operator",
"value"}]}]}; a bare list of conditions is one AND group. It is validated, then compiled into one flat boolean
expression; every leaf is two-valued.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import jsonval as J

OPERATORS = {
    "Text": {"is", "is_not", "contains", "not_contains", "is_empty", "is_not_empty"},
    "Number": {"is", "is_not", "gt", "lt", "between"},
    "Boolean": {"is_true", "is_false"},
    "Date": {"on", "before", "after", "between"},
    "List": {"contains", "not_contains", "is_empty", "is_not_empty"},
}
NO_VALUE = {"is_empty", "is_not_empty", "is_true", "is_false"}
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Condition:
    key: str
    type: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Group:
    combinator: str = "and"
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class FilterSet:
    combinator: str = "and"
    groups: tuple[Group, ...] = field(default_factory=tuple)


def finite(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def condition(raw: object) -> Condition | None:
    """A valid condition, or None."""
    if not isinstance(raw, dict):
        return None
    key, type_, op, val = (raw.get(k) for k in ("key", "type", "operator", "value"))
    if not isinstance(key, str) or not 1 <= len(key) <= 200 or op not in OPERATORS.get(type_, ()):
        return None
    if op in NO_VALUE:
        return Condition(key, type_, op)
    if op == "between":
        if not isinstance(val, (list, tuple)) or len(val) != 2:
            return None
        good = all(map(finite, val)) if type_ == "Number" else all(isinstance(x, str) and DATE.match(x) for x in val)
        return Condition(key, type_, op, tuple(val)) if good else None
    if type_ == "Number":
        return Condition(key, type_, op, val) if finite(val) else None
    if type_ == "Date":
        return Condition(key, type_, op, val) if isinstance(val, str) and DATE.match(val) else None
    if isinstance(val, (list, tuple)):
        return Condition(key, type_, op, tuple(val)) if val and all(isinstance(x, str) and x for x in val) else None
    return Condition(key, type_, op, val) if isinstance(val, str) and val else None


def filter_set(raw: object) -> FilterSet | None:
    """The valid part of a request: bad conditions and empty groups go; nothing left gives None."""
    if isinstance(raw, list):
        raw = {"combinator": "and", "groups": [{"combinator": "and", "conditions": raw}]}
    if not isinstance(raw, dict) or not isinstance(raw.get("groups"), list):
        return None
    join = lambda x: "or" if isinstance(x, dict) and x.get("combinator") == "or" else "and"
    groups = []
    for g in raw["groups"]:
        found = [c for c in map(condition, g.get("conditions", []) if isinstance(g, dict) and isinstance(g.get("conditions"), list) else []) if c]
        if found:
            groups.append(Group(join(g), tuple(found)))
    return FilterSet(join(raw), tuple(groups)) if groups else None


def without_column(fs: FilterSet, key: str) -> FilterSet | None:
    """The set without the conditions of a key; groups left empty go."""
    groups = [Group(g.combinator, tuple(c for c in g.conditions if c.key != key)) for g in fs.groups]
    groups = [g for g in groups if g.conditions]
    return FilterSet(fs.combinator, tuple(groups)) if groups else None


def as_list(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def ilike_any(c: Column, terms: list[str]) -> Column:
    """Whether a text contains one of the terms in any case; % and _ in terms match as wildcards, a backslash as itself."""
    return reduce(lambda a, b: a | b, [c.ilike("%" + t.replace("\\", "\\\\") + "%") for t in terms], F.lit(False))


def leaf(data: Column, c: Condition) -> Column:
    """One condition as a two-valued column."""
    v = J.value(data, c.key)
    if c.type in ("Text", "List") and c.operator in ("is_empty", "is_not_empty"):
        out = J.is_empty(v)
        return ~out if c.operator == "is_not_empty" else out
    if c.type == "Text":
        t = J.text(v)
        hit = F.coalesce(t, F.lit("")).isin(as_list(c.value)) if c.operator.startswith("is") else F.coalesce(ilike_any(t, as_list(c.value)), F.lit(False))
        return ~hit if c.operator in ("is_not", "not_contains") else hit
    if c.type == "List":
        hit = F.coalesce(F.arrays_overlap(J.strings_of(v), F.array(*map(F.lit, as_list(c.value)))), F.lit(False))
        return ~hit if c.operator == "not_contains" else hit
    if c.type == "Boolean":
        kind, t = J.tag(v), F.lower(J.text(v))
        yes, no = ("true", "yes", "1"), ("false", "no", "0")
        words = yes if c.operator == "is_true" else no
        hit = F.when(kind == "boolean", t == words[0]).when(kind == "string", t.isin(*words))
        return F.coalesce(hit, F.lit(False))
    x = J.numeric(v) if c.type == "Number" else J.date_text(v)
    lit = (lambda y: F.lit(str(y)).cast("decimal(38,10)")) if c.type == "Number" else F.lit
    hit = {
        "is": lambda: x == lit(c.value), "on": lambda: x == lit(c.value), "is_not": lambda: x != lit(c.value),
        "gt": lambda: x > lit(c.value), "after": lambda: x > lit(c.value), "lt": lambda: x < lit(c.value), "before": lambda: x < lit(c.value),
        "between": lambda: x.between(lit(c.value[0]), lit(c.value[1])),
    }[c.operator]()
    return F.coalesce(hit, F.lit(False))


def fold(parts: list[Column], combinator: str) -> Column:
    if combinator == "or":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def matches(data: Column, fs: FilterSet | None) -> Column:
    """Whether a parsed record meets the set; no groups match every record."""
    if fs is None or not fs.groups:
        return F.lit(True)
    return fold([fold([leaf(data, c) for c in g.conditions], g.combinator) for g in fs.groups], fs.combinator)
