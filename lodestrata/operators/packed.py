"""Several values packed in one field: dialects chosen by minimum description length.

A dialect is a set of delimiters together with a quoting rule. The cost in bits of a parse is the cost of
naming the dialect, of every separator, and of every value. Value codes are learnt from the whole column: a
distributed count gives each value its code length -log2(share). A value with a share below 2**-16 is spelt
out instead, so at most 65,536 values carry a code of their own: that table is what the workers receive.
Each field is then parsed in one pass by its cheapest dialect.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import small_rows

# Delimiters by name; a spaced one needs blanks on both sides.
DELIMITERS = {
    "comma": r"[,，、]", "semicolon": r"[;；]", "pipe": r"\|", "slash": r"/", "amp": r"&", "plus": r"\+", "plus_spaced": r"(?<=\s)\+(?=\s)",
    "greater": r">", "dot": r"[·•]", "tab": r"\t", "line": r"[\r\n]", "blank": r"[ \u00a0]", "colon": r"(?<=\s):(?=\s)",
    "word": r"(?<=\s)(?:and|or|und|y|et)(?=\s)",
}
ANY_DELIMITER = r'[,，、;；|/&+>·•\t\r\n]|\s(?:and|or|und|y|et)\s|\s:\s'
MAIL_DELIMITER = r'[,，、;；|/&<>·•{}\[\]()"\'\s]|mailto:'
CODE_BITS = 16
SPELT = 64  # longer values are known to the workers by their hash, so that the table of codes stays small
ADDRESS = re.compile(r"[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+")
WRAPPED = re.compile(r"^\s*[\[{(](.*)[\]})]\s*$", re.S)


def value_codes(values: DataFrame) -> dict[str, float]:
    """Bits by value (see code_key). values(value): one row per rough piece of the whole column."""
    counts = values.where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    total = values.agg(F.count("*").alias("total"))
    often = counts.crossJoin(F.broadcast(total)).where(f"n >= 2 AND n * {2**CODE_BITS} >= total")  # one row
    key = F.when(F.length("value") <= SPELT, F.col("value")).otherwise(F.concat(F.lit("\0"), F.xxhash64("value").cast("string")))
    rows = small_rows(often.select(key.alias("value"), "n", "total"), 2**CODE_BITS)
    return {r["value"]: -math.log2(r["n"] / r["total"]) for r in rows}


def code_key(value: str) -> str:
    """What a value is called in the table of codes: itself, or the hash that Spark gives it if it is long."""
    if len(value) <= SPELT:
        return value
    h = xxhash.xxh64_intdigest(value.encode(), seed=42)
    return f"\0{h - (1 << 64) if h >> 63 else h}"


def rough_pieces(df: DataFrame, text: str, mail: bool = False) -> DataFrame:
    """Pieces at every delimiter there is, but for quoted ones kept whole: what the codes are learnt from.

    Of mail fields only whole addresses are values.
    """
    if mail:
        pieces = F.filter(F.split(text, MAIL_DELIMITER), lambda p: p.contains("@"))
        return df.where(F.col(text).isNotNull()).select(F.explode(pieces).alias("value")).select(F.lower("value").alias("value"))
    quoted = F.expr(f"regexp_extract_all({text}, '\"([^\"]*)\"', 1)")
    plain = F.split(F.regexp_replace(text, '"[^"]*"', "\n"), ANY_DELIMITER)
    return df.where(F.col(text).isNotNull()).select(F.explode(F.concat(quoted, plain)).alias("value")).select(F.lower(F.trim("value")).alias("value"))


def cut(text: str, pattern: re.Pattern | None, quoting: bool) -> tuple[list[str], int]:
    """The pieces between delimiters outside quotes, and how many separators there were. Linear in the text."""
    if pattern is None:
        return [text], 0
    shield = [m.span() for m in re.finditer(r'"[^"]*"', text)] if quoting else []
    out, start, k, n = [], 0, 0, 0
    for m in pattern.finditer(text):
        while k < len(shield) and shield[k][1] <= m.start():
            k += 1
        if k < len(shield) and shield[k][0] <= m.start():
            continue
        out.append(text[start : m.start()])
        start, n = m.end(), n + 1
    out.append(text[start:])
    return out, n


def families(names: list[str]) -> list[tuple[str, ...]]:
    """Candidate delimiter sets: all subsets of those present, the smaller ones first."""
    return [s for k in range(len(names) + 1) for s in combinations(names, k)]


class Reader:
    """Parses the strings of one field. kind: 'email' or 'token'."""

    def __init__(self, kind: str, codes: dict[str, float]):
        self.kind, self.codes = kind, codes
        self.patterns: dict[tuple[str, ...], re.Pattern | None] = {(): None}
        self.memo: dict[str, list[str]] = {}

    def pattern(self, names: tuple[str, ...]) -> re.Pattern | None:
        if names not in self.patterns:
            self.patterns[names] = re.compile("|".join(DELIMITERS[n] for n in names))
        return self.patterns[names]

    def bare(self, piece: str) -> tuple[str, float]:
        """The value a piece stands for ('' for none), and its cost in bits."""
        piece = piece.strip()
        if not piece:
            return "", 1.0
        if self.kind == "email":
            found = ADDRESS.findall(piece)
            if len(found) == 1:
                value = found[0].strip(".").lower()
                rest = len(re.sub(r"[\s<>()\[\]{}\"'“”:;,]", "", piece)) - len(found[0])
                # A name or label is cheap only in its proper form: Name <address>, label: address.
                at = piece.find(found[0])
                formed = at > 0 and piece[:at].rstrip()[-1:] in "<:(" and not piece[at + len(found[0]) :].strip(" >)]\"'")
                extra = 0 if rest <= 0 else 4 + 2 * rest if formed else 16 + 8 * rest
                return value, self.codes.get(code_key(value), 8 + 4 * len(value)) + extra
            return "", 16 + 8 * len(piece)
        quoted = len(piece) > 1 and piece[0] == piece[-1] == '"'
        value = piece.strip("\"'“”").strip().lower()
        if not value:
            return "", 2.0
        return value, self.codes.get(code_key(value), CODE_BITS + 5 * len(value)) + 2 * quoted + (40 if '"' in value else 0)

    def parse(self, text: str) -> list[str]:
        """The values of a field in order, by its cheapest dialect; ties go to the fewer delimiters, then to their order."""
        if text in self.memo:
            return self.memo[text]
        body = text
        if self.kind == "email" and (m := WRAPPED.match(text)):
            body = m.group(1)
        quotes = body.count('"')
        best: tuple[float, list[str]] | None = None
        for quoting in (True, False) if quotes % 2 else (quotes > 0,):
            # Only delimiters outside quotes can cut.
            open_ = re.sub(r'"[^"]*"', '"', body.strip()) if quoting else body.strip()
            names = [n for n, p in DELIMITERS.items() if re.search(p, open_)]
            for chosen in families(names):
                if best is not None and 3.0 * len(chosen) >= best[0]:
                    break
                pieces, n = cut(body, self.pattern(chosen), quoting)
                bits, values = 3.0 * len(chosen) + n * math.log2(len(chosen) + 1), []
                for p in pieces:
                    value, cost = self.bare(p)
                    bits += cost
                    if value:
                        values.append(value)
                    if best is not None and bits >= best[0]:
                        break
                else:
                    if best is None or bits < best[0]:
                        best = bits, values
        out = best[1] if best else []
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo[text] = out
        return out


def unpack(df: DataFrame, key: str, email: str, tokens: str) -> DataFrame:
    """company_id, field_name, pos, value of every packed email field and every packed token array.

    A row's email counts when it holds two or more addresses, its array when an element holds two or more tokens;
    then all its values come out, numbered from 1 over the whole field. Null arrays, null elements and empty
    places hold nothing; a repeated row repeats no output; other columns of df are never read.
    """
    src = df.select(F.col(key).alias("company_id"), F.col(email).alias("email"), F.col(tokens).alias("tokens"))
    mail_codes = value_codes(rough_pieces(src.select(F.col("email").alias("t")), "t", mail=True))
    token_codes = value_codes(rough_pieces(src.select(F.explode("tokens").alias("t")), "t"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mails, toks = Reader("email", mail_codes), Reader("token", token_codes)
        for pdf in batches:
            rows = []
            for cid, mail, arr in zip(pdf["company_id"].tolist(), pdf["email"].tolist(), pdf["tokens"].tolist()):
                if mail:
                    got = mails.parse(mail)
                    if len(got) > 1:
                        rows += [(cid, "email", i, v) for i, v in enumerate(got, 1)]
                if arr is not None and len(arr):
                    parts = [toks.parse(a) if a else [] for a in arr]
                    if any(len(p) > 1 for p in parts):
                        rows += [(cid, "source_tokens", i, v) for i, v in enumerate((v for p in parts for v in p), 1)]
            yield pd.DataFrame(rows, columns=["company_id", "field_name", "pos", "value"])

    # Rows that cannot hold two values never leave the JVM.
    maybe = F.coalesce(F.regexp_count("email", F.lit("@")) > 1, F.lit(False)) | F.coalesce(F.exists("tokens", lambda t: t.rlike(ANY_DELIMITER + "| ")), F.lit(False))
    return src.where(maybe).mapInPandas(read, "company_id string, field_name string, pos int, value string").distinct()
