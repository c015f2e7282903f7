"""Quantities written in different units and number styles, brought to canonical units.

A small grammar reads a text:   amount  := [open] term [range term] [open]
                                term    := unit* number unit*
                                unit    := currency | scale | period | counted thing
Units carry a dimension (a vector of exponents over person, money and time), a scale and an offset; a term's
unit is the product of its factors. The result is accepted when its dimension is the field's own, or is the
field's after the defaults of the field are multiplied in (a revenue without a period is one of a year).
Arithmetic is exact (fractions), rounding half up happens once at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction as Q

import pandas as pd
from pyspark.sql import DataFrame

from lodestrata.session import small_rows

DIMENSIONS = ("person", "money", "time")


@dataclass(frozen=True)
class Unit:
    """value_in_canonical = value * scale + offset; dims are exponents over DIMENSIONS."""

    scale: Q = Q(1)
    dims: tuple[int, int, int] = (0, 0, 0)
    offset: Q = Q(0)

    def __mul__(self, other: Unit) -> Unit:
        if self.offset and other.offset:
            raise ValueError("two units with offsets cannot be multiplied")
        return Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.dims, other.dims)), self.offset * other.scale + other.offset)

    def convert(self, x: Q) -> Q:
        return x * self.scale + self.offset


PERSON, YEARLY = (1, 0, 0), (0, 0, -1)
# Scales by word.
SCALES = {
    "dozen": 12, "doz": 12, "hundred": 100, "hundreds": 100, "x100": 100, "x1000": 1000,
    "k": 1000, "thousand": 1000, "thousands": 1000, "tsd": 1000, "mil": 1000, "'000": 1000, "000s": 1000,
    "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "crore": 10_000_000, "crores": 10_000_000,
    "m": 10**6, "mm": 10**6, "mn": 10**6, "mln": 10**6, "mio": 10**6, "million": 10**6, "millions": 10**6,
    "milhões": 10**6, "milhão": 10**6, "millones": 10**6, "millón": 10**6, "millionen": 10**6,
    "b": 10**9, "bn": 10**9, "bln": 10**9, "billion": 10**9, "billions": 10**9, "mrd": 10**9, "milliarden": 10**9, "milliards": 10**9,
    "tn": 10**12, "trillion": 10**12,
}
# Periods as times a year.
PERIODS = {
    "year": 1, "annual": 1, "annually": 1, "yearly": 1, "p.a": 1, "pa": 1, "annum": 1, "arr": 1, "jahr": 1,
    "month": 12, "monthly": 12, "mo": 12, "mrr": 12, "monat": 12, "quarter": 4, "quarterly": 4, "q": 4, "qtr": 4, "week": 52, "weekly": 52,
}
# Words for money, by currency code.
MONEY = {
    "us$": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "usd": "USD", "€": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP", "c$": "CAD", "ca$": "CAD", "a$": "AUD", "au$": "AUD",
    "₹": "INR", "rs": "INR", "rupees": "INR", "rupee": "INR", "r$": "BRL", "reais": "BRL", "¥": "JPY", "yen": "JPY", "jp¥": "JPY",
    "franc": "CHF", "francs": "CHF", "sfr": "CHF", "fr": "CHF", "kronor": "SEK", "krona": "SEK", "kr": "SEK",
}
# Adjectives that turn the word dollar into another currency.
DOLLARS = {"canadian": "CAD", "australian": "AUD", "us": "USD", "u.s": "USD", "american": "USD"}
# What is counted as a person.
PEOPLE = "person persons people ppl employee employees staff heads head headcount team fte ftes worker workers member members mitarbeiter mitarbeitende beschäftigte angestellte salarié salariés employés collaborateurs empleado empleados personas trabajadores dipendenti funcionários".split()
# Number words.
ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
# Words that open an amount upwards, close it upwards, join a range, or say nothing about it.
OPEN_UP = {"over", "above", "more", "+", "plus", "least", "exceeding", ">", "≥", "min", "minimum"}
RANGE = {"to", "-", "–", "—", "..", "…", "and", "bis", "until", "à"}
FILLER = {"about", "around", "approx", "approximately", "ca", "c", "circa", "~", "≈", "roughly", "nearly", "between", "from", "of", "or", "per", "/", "at", "than", ":", ",", ".", "(", ")", "in", "revenue", "umsatz", "turnover", "sales", "is", "the", "a", "p", "*", "est", "estimated", "reported", "figures", "given", "are", "stated", "amounts", "all", "annual", "total", "x"}

LEX = re.compile(
    r"""\s*(?:
    (?P<num>\d(?:[\d]|[.,'’\u00a0\u202f\u2009 ](?=\d))*(?:[eE]\+?\d+(?![A-Za-z]))?)
  | (?P<thousand>['’]000s?(?!\d))
  | (?P<times>[x×]\s?1000?(?!\d))
  | (?P<cur>(?:[A-Za-z]{1,2})?[$¥]|[€£₹])
  | (?P<pa>p\.\s?a\.?)
  | (?P<word>[^\W\d_]+(?:\.[^\W\d_]+)*)
  | (?P<sym>\.\.|…|[-–—+~≈<>≥≤/():,.*?&'’])
  )""",
    re.X,
)
STYLE = re.compile(r"[.,'’\u00a0\u202f\u2009 ]")
CONTEXT_MONEY = re.compile(r"(?:\b(?:revenue|turnover|figures|amounts?|sales|umsatz)\b[^.;]{0,60}?\bin)\s+([^.;]{1,60})", re.I)
CONTEXT_PEOPLE = re.compile(r"(?:\b(?:headcount|employees|staff|employee numbers?|workforce)\b[^.;]{0,40}?\bin)\s+((?:tens|dozens|hundreds|thousands)\b)", re.I)
BARE = re.compile(r"\d+")
MOST = 2**63 - 1


def read_number(text: str, scaled: bool, comma_decimal: bool = False) -> Q | None:
    """A number in any of the usual styles. scaled: a scale word stands by it, so a lone dot marks decimals."""
    text, _, power = re.sub("[Ee]", "e", text).partition("e")
    seps = STYLE.findall(text)
    groups = STYLE.split(text)
    if not seps:
        whole, part = text, ""
    else:
        last, tail = seps[-1], groups[-1]
        alike = all(len(g) == 3 for g in groups[1:])
        if len(set(seps)) > 1:
            decimal = last in ".,"
        elif len(seps) > 1:
            decimal = False
        elif last not in ".,":
            decimal = False
        elif last == ",":
            decimal = len(tail) != 3 or comma_decimal or groups[0] == "0"
        else:
            decimal = len(tail) != 3 or scaled or groups[0] == "0"
        if not decimal and not alike and not (last == "," and all(len(g) in (2, 3) for g in groups[1:])):
            return None
        whole, part = ("".join(groups[:-1]), tail) if decimal else ("".join(groups), "")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    if len(whole) > 4_000 or len(power.lstrip("+0")) > 3:
        return Q(10**4_000)  # beyond any bound of the result
    return Q(int(whole)) * 10 ** int(power or 0) + (Q(int(part[:4_000]), 10 ** len(part[:4_000])) * 10 ** int(power or 0) if part else 0)


class Grammar:
    """The reader of one field. rates: USD by currency code."""

    def __init__(self, field_dims: tuple[int, int, int], defaults: Unit, rates: dict[str, Q]):
        self.dims, self.defaults = field_dims, defaults
        self.money = field_dims[1] != 0
        self.rates = {**{k.lower(): k for k in rates}, **{k: v for k, v in MONEY.items() if v in rates}}
        self.value = rates

    def unit(self, word: str, before: str) -> Unit | None:
        """The unit a lower-case word stands for, in a money or in a people field."""
        w = word.rstrip(".")
        if w in ("dollar", "dollars") and before.rstrip(".") in DOLLARS:
            code = DOLLARS[before.rstrip(".")]
            return Unit(self.value[code], (0, 1, 0)) if code in self.value else None
        if self.money and w in self.rates:
            return Unit(self.value[self.rates[w]], (0, 1, 0))
        if self.money and len(w) == 4 and w[0] in "mkb" and w[1:] in self.rates:
            return Unit(Q(SCALES[w[0]]) * self.value[self.rates[w[1:]]], (0, 1, 0))
        if self.money and w in PERIODS:
            return Unit(Q(PERIODS[w]), YEARLY)
        if w in SCALES:
            return Unit(Q(SCALES[w]))
        if not self.money and w in PEOPLE:
            return Unit(Q(1), PERSON)
        return None

    def lex(self, text: str) -> list[tuple[str, str]] | None:
        out, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = LEX.match(text, at)
            if not m or m.end() == at:
                return None
            at, kind = m.end(), m.lastgroup
            value = m.group(kind).lower()
            if kind == "thousand":
                kind, value = "word", "'000"
            elif kind == "times":
                kind, value = "word", "x1000" if value.endswith("1000") else "x100"
            elif kind == "cur":
                kind = "word"
            elif kind == "pa":
                kind, value = "word", "p.a"
            out.append((kind, value))
        return out

    def words(self, tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Number words folded into numbers: sixty - eight, one hundred and five, thirty."""
        out: list[tuple[str, str]] = []
        i = 0
        while i < len(tokens):
            kind, v = tokens[i]
            if kind == "word" and (v in ONES or v in TENS):
                n = ONES.get(v, TENS.get(v))
                if v in TENS:
                    j = i + 1
                    if j < len(tokens) and tokens[j][1] == "-":
                        j += 1
                    if j < len(tokens) and 0 < ONES.get(tokens[j][1], 0) < 10:
                        n, i = n + ONES[tokens[j][1]], j
                out.append(("num", str(n)))
            else:
                out.append((kind, v))
            i += 1
        return out

    def parse(self, text: str, context: Unit | None = None) -> tuple[int, int] | None:
        """Low and high (-1: open upwards) in canonical units, or None if the text states no amount."""
        tokens = self.lex(text)
        if not tokens:
            return None
        tokens = self.words(tokens)
        numbers = [i for i, t in enumerate(tokens) if t[0] == "num"]
        if not 1 <= len(numbers) <= 2:
            return None
        terms: list[list] = []  # [number text, units]
        lead: list[Unit] = []
        opened = False
        before, ranged = "", False
        for i, (kind, v) in enumerate(tokens):
            if kind == "num":
                if terms and not ranged:
                    return None
                terms.append([v, lead])
                lead, ranged = [], False
            elif (u := self.unit(v, before)) is not None:
                # Before the first number, or after a range sign, a unit belongs to the number that follows.
                (lead if not terms or ranged else terms[-1][1]).append(u)
            elif v in OPEN_UP:
                opened = True
            elif v in RANGE and terms and len(numbers) == 2 and len(terms) == 1:
                ranged = True
            elif (v.rstrip(".") or v) in FILLER or v.rstrip(".") in DOLLARS or v in RANGE or v == "'":
                pass
            elif kind == "word" and self.harmless(v):
                pass
            else:
                return None
            before = v
        return self.finish(terms, opened, context)

    def harmless(self, word: str) -> bool:
        return not self.money and word in {"hq", "count", "size", "company", "full-time", "full", "time", "strong", "globally", "worldwide"}

    def finish(self, terms: list[list], opened: bool, context: Unit | None) -> tuple[int, int] | None:
        units = []
        for _, us in terms:
            u = Unit()
            seen: set[tuple[int, int, int]] = set()
            for x in us:
                if x.dims != (0, 0, 0) and x.dims in seen:
                    continue  # a unit stated twice (Rs. ... INR) counts once
                seen.add(x.dims)
                u = u * x
            units.append(u)
        if len(units) == 2:  # a range shares what only one of its ends states
            for a, b in ((0, 1), (1, 0)):
                for k in (1, 2, 0):
                    if units[b].dims[k] and not units[a].dims[k]:
                        units[a] = self.share(units[a], terms[b][1], k)
            plain = [all(x.dims != (0, 0, 0) for x in t[1]) for t in terms]
            if plain[0] and not plain[1]:
                for x in terms[1][1]:
                    if x.dims == (0, 0, 0):
                        units[0] = units[0] * x
        out = []
        for (digits, us), u in zip(terms, units):
            bare = u.dims == (0, 0, 0) and u.scale == 1
            if context is not None and bare:
                u = context
            scaled = any(x.dims == (0, 0, 0) and x.scale != 1 for x in us) or (context is not None and bare) or u.scale >= 1000 and u.dims == (0, 0, 0)
            comma = any(x.scale in (10**6, 10**9) for x in us) and "," in digits and "." not in digits and len(digits.split(",")[-1]) != 3
            n = read_number(digits, scaled, comma)
            if n is None:
                return None
            if self.money and u.dims[2] and not u.dims[1]:
                return None  # a period alone makes no amount (Q3)
            for k, d in enumerate(self.defaults.dims):
                if d and not u.dims[k]:
                    unit_dims = tuple(d if j == k else 0 for j in range(3))
                    u = u * Unit(Q(1), unit_dims)
            if u.dims != self.dims:
                return None
            out.append(int((u.convert(n) * 2 + 1) // 2))
        if len(out) == 1:
            return out[0], -1 if opened else out[0]
        low, high = sorted(out)
        return low, high

    @staticmethod
    def share(unit: Unit, others: list[Unit], k: int) -> Unit:
        for x in others:
            if x.dims[k]:
                return unit * x
        return unit

    def context(self, text: str | None) -> Unit | None:
        """The unit that a sentence elsewhere in the row gives to bare numbers of this field."""
        if not text:
            return None
        m = (CONTEXT_MONEY if self.money else CONTEXT_PEOPLE).search(text)
        tokens = self.lex(m.group(1)) if m else None
        if not tokens:
            return None
        out, before, seen = Unit(), "", set()
        for _, v in tokens:
            u = self.unit(v, before)
            before = v
            if u is not None and u.dims not in seen:
                seen.add(u.dims)
                out = out * u
        if self.money and not out.dims[1]:
            return None
        return out if seen else None


def grammars(rates: dict[str, Q]) -> dict[str, Grammar]:
    """The two fields of the problem: persons, and US dollars a year."""
    return {"employee_count": Grammar((1, 0, 0), Unit(Q(1), (1, 0, 0)), rates), "revenue": Grammar((0, 1, -1), Unit(Q(1), (0, 1, -1)), rates)}


def read_quantities(df: DataFrame, key: str, fields: list[str], context: str, rates: DataFrame) -> DataFrame:
    """row_id, field_name, low_value, high_value of every stated amount that is not already a bare canonical number.

    Null, empty and wordy cells state no amount; ties and repeated rows are read alike; other columns of df are
    never read. Amounts beyond the range of a bigint come out as its greatest value. rates is small by contract (one row a currency, 10,000 at most; more raises an error).
    """
    fx = {r[0]: Q(str(r[1])) for r in small_rows(rates.select("currency", "usd_per_unit").where("currency IS NOT NULL AND usd_per_unit IS NOT NULL"), 10_000)}
    fx.setdefault("USD", Q(1))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, memo = grammars(fx), {}
        for pdf in batches:
            rows = []
            contexts = pdf[context].tolist()
            for f in fields:
                g = by[f]
                for row, raw, near in zip(pdf[key].tolist(), pdf[f].tolist(), contexts):
                    if not raw:
                        continue
                    text = unicodedata.normalize("NFC", raw).strip()
                    if not any(c.isalnum() for c in text):
                        continue
                    unit = g.context(near)
                    if unit is None and BARE.fullmatch(text):
                        continue
                    if (f, text, unit) not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[f, text, unit] = g.parse(text, unit)
                    got = memo[f, text, unit]
                    if got and not (BARE.fullmatch(text) and unit is not None and len(text) < 30 and got == (int(text), int(text))):
                        rows.append((row, f, min(got[0], MOST), min(got[1], MOST)))
            yield pd.DataFrame(rows, columns=["row_id", "field_name", "low_value", "high_value"])

    return df.select(key, context, *fields).mapInPandas(read, "row_id bigint, field_name string, low_value bigint, high_value bigint").distinct()
