"""Typed reads of JSON attributes, over VARIANT.

Records are parsed once (parsed); keys are read by path from that column, so several predicates share one parse.
A record that is no JSON object counts as one without attributes; of a repeated key the last value counts (session.expose).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
TEMPLATE = r"(?s)^\{\{.*\}\}\z"


def parsed(c: Column) -> Column:
    return F.try_parse_json(c)


def value(data: Column, key: str) -> Column:
    """The top-level key's value as VARIANT, null if missing. A path takes either quote in a key, but not both."""
    if "'" in key and '"' in key:
        return F.try_element_at(F.try_variant_get(data, "$", "map<string,variant>"), F.lit(key))
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(data, f"$[{quote}{key}{quote}]", "variant")


def tag(v: Column) -> Column:
    """The JSON type: string, number, boolean, array, object, null (a JSON null); null if missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
        .when(s.isNotNull(), "number")
    )


def text(v: Column) -> Column:
    """A value as text; JSON null and missing give null, arrays and objects their JSON text."""
    return F.try_variant_get(v, "$", "string")


def is_empty(v: Column) -> Column:
    """Missing, null, an empty list, or a text that is blank (spaces), a dash or an unfilled template."""
    t, kind = text(v), tag(v)
    blank = F.trim(t).isin("", "-") | F.trim(t).rlike(TEMPLATE)
    return F.when(kind.isNull() | (kind == "null"), True).when(kind == "array", t == "[]").when(kind == "string", blank).otherwise(False)


def numeric(v: Column) -> Column:
    """A JSON number, or a text in plain decimal notation; else null. Beyond 38 digits null."""
    t = text(v)
    plain = F.try_variant_get(v, "$", "decimal(38,10)")
    return F.when(tag(v) == "number", plain).when((tag(v) == "string") & t.rlike(NUMBER), F.when(t.rlike(NUMBER), t).try_cast("decimal(38,10)"))


def date_text(v: Column) -> Column:
    """A text that begins with an ISO date, whole; else null."""
    t = text(v)
    return F.when((tag(v) == "string") & t.rlike(r"^\d{4}-\d{2}-\d{2}"), t)


def strings_of(v: Column) -> Column:
    """The string elements of an array; null for what is no array."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(tag(v) == "array", F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string")))


def value_type(v: Column) -> Column:
    """Empty, List, Boolean, Number, Text or Date, by the value's shape."""
    t, kind = text(v), tag(v)
    s = (
        F.when(F.trim(t).isin("", "-") | t.rlike(TEMPLATE), "Empty").when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), "Date").when(t.rlike(r"^-?[0-9.]+$"), "Number")
        .when(F.lower(t).isin("true", "false"), "Boolean").otherwise("Text")
    )
    return (
        F.when(kind.isNull() | (kind == "null"), "Empty").when((kind == "array") & (t == "[]"), "Empty").when(kind == "array", "List").when(kind == "boolean", "Boolean")
        .when(kind == "number", "Number").when(kind == "object", "Text").otherwise(s)
    )
