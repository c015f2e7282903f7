"""Keys by which companies and people are recognised, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that are part of a public suffix when they stand before the last one.
SECOND_LEVEL = "com|co|net|org|io|ac|gov|edu|biz|info"
# Legal forms and the like, at the end of a company's name.
LEGAL = "inc|incorporated|llc|ltd|limited|gmbh|ag|sa|bv|nv|plc|corp|corporation|co|company|holdings?|group|srl|sas|sarl|oy|ab|as|kg|pty|pte|llp|lp"


def blank_to_null(c: Column) -> Column:
    """Null for what is empty, blank or a lone dash; else without outer blanks."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~t.isin("", "-"), t)


def host(c: Column) -> Column:
    """The host of a domain or address however written: lower case, no scheme, www, port, path or final dot; null if none."""
    t = F.regexp_replace(F.lower(blank_to_null(c)), r"^[a-z]+:/{1,3}|^//", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[/?#\\].*$", ""), r"^.*@|:\d*$", "")
    t = F.regexp_replace(t, r"^www\d?\.|\.+$", "")
    return F.when(t.rlike(r"^[^\s.]+(\.[^\s.]+)+$"), t)


def stem(host_: Column) -> Column:
    """A host without its public suffix."""
    return F.regexp_replace(F.regexp_replace(host_, r"\.[^.]+$", ""), rf"\.({SECOND_LEVEL})$", "")


def page(c: Column) -> Column:
    """The identifying part of a page address of the professional network, however written; null if none."""
    t = F.regexp_extract(F.lower(blank_to_null(c)), r"linkedin\.[a-z.]+/(?:company|school|showcase|in|pub)/+([^/?#\s]+)", 1)
    return F.when(t != "", t)


def first_path(c: Column) -> Column:
    """Letters and digits of the first path segment of an address ('' if none)."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^\s*(?:[A-Za-z]+:/{1,3})?[^/?#\s]+/+([^/?#\s]+)", 1)), r"[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """A company's name without case, accents of composed letters, punctuation and legal form; null if nothing is left."""
    t = F.lower(F.regexp_replace(c, "['’]", ""))
    t = F.regexp_replace(t, r"(?U)[^\w]+", " ")
    t = F.trim(F.regexp_replace(F.trim(t), rf"(?: (?:{LEGAL}))+$", ""))
    t = F.regexp_replace(t, " ", "")
    return F.when(t != "", t)


def phone_key(c: Column) -> Column:
    """The digits of a phone number without extension; null for fewer than seven."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*(?:x|ext)\.?\s*\d+\s*$", ""), r"\D", "")
    return F.when(F.length(t) >= 7, t)


def place_key(c: Column) -> Column:
    """A place without case and punctuation; null if nothing is left."""
    t = F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "")
    return F.when(t != "", t)


def one_deletions(c: Column) -> Column:
    """The text and all that is left of it without one letter: two texts one edit or swap apart share an element."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))


def one_apart(a: Column, b: Column) -> Column:
    """Whether two texts are one edit, or one swap of neighbours, apart."""
    d = F.levenshtein(a, b)
    swap = (F.length(a) == F.length(b)) & (d == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    # A swap: the texts differ at two neighbouring places only.
    where = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return (d == 1) | (swap & (F.size(where) == 2) & (F.try_element_at(where, F.lit(2)) - F.try_element_at(where, F.lit(1)) == 1))
