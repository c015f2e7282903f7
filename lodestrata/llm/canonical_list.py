"""Free-entered values mapped to a canonical list.

Token-level repair: every distinct typed token is joined to the vocabulary of the reference list by edit
distance (a hash join on deletion neighbourhoods, verified by counting edits), then the repaired tokens are
combined by soft TF-IDF, which ranks the names of the entries. A value whose best name stays below the
threshold, or whose best name is one of a known thing outside the list, maps to no entry (0).

Names of an entry are its label, its note's phrases, the initials of its label and, for countries, what the JVM's
locale data call it in many languages; nothing else is known about any list.

The reference list is small by contract (10,000 rows at most, checked), so its vocabulary is the side of the join
that is broadcast; typed values of any number stay where they are. Work is done once a distinct value, then joined
back, so a value that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import small_rows

MAX_REFERENCE = 10_000
THRESHOLD = 0.62
# Words that say nothing about which entry is meant.
NOISE = set("the of and n amp in for a an company business industry sector general etc b2b mainly country hq headquarters earth based only group services republic kingdom state federation federal commonwealth peoples people s islamic democratic republique republica republik republika du de del la das sar und y et".split())
NOISE_WEIGHT = 0.12
# Languages whose country names are understood.
LANGUAGES = "en de es fr it pt nl sv da nb fi pl cs sk sl hu ro el tr uk he ar hi ur bn zh ja ko vi th id ms ga is".split()
OTHER_LANGUAGES = "en de es fr".split()

def fold(text: str) -> list[str]:
    """Words of a value: no accents, case, punctuation or entities; camel case apart, dotted initials joined."""
    text = text.replace("&amp;", "&")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = unicodedata.normalize("NFKC", text.replace("ß", "ss")).casefold().replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("ı", "i").replace("’", "").replace("'", " ")
    words = re.findall(r"[^\W_]+", text)
    out: list[str] = []
    run = ""
    for w in [*words, "\0"]:
        if len(w) == 1 and w.isalpha():
            run += w
            continue
        if run:
            out.extend([run] if len(run) > 1 else list(run))
            run = ""
        if w != "\0":
            out.append(w)
    return out


@dataclass(frozen=True)
class Name:
    """One way to call an entry (ref_id 0: something known that is not on the list)."""

    kind: str
    ref_id: int
    words: tuple[str, ...]
    label: bool = False
    initials: bool = False  # only as it stands: too short to be repaired


def country_names(spark: SparkSession, codes: dict[str, int]) -> list[tuple[int, str]]:
    """(ref_id, name) of all countries: codes and names of many languages by the JVM's locale data."""
    locale = spark._jvm.java.util.Locale
    spoken = {x: locale(x) for x in LANGUAGES}
    out = []
    for code in locale.getISOCountries():
        ref = codes.get(code, 0)
        here = locale("", code)
        out += [(ref, here.getDisplayCountry(spoken[x])) for x in (LANGUAGES if ref else OTHER_LANGUAGES)]
        out += [(ref, code), (ref, here.getISO3Country())]
    return out


def reference_names(spark: SparkSession, reference: DataFrame) -> list[Name]:
    """All names of all entries, the entry's own label first; a name of two entries is dropped where it is nobody's label."""
    rows = small_rows(reference.select("ref_id", "kind", "label", "code", "note").where("ref_id IS NOT NULL AND kind IS NOT NULL AND label IS NOT NULL"), MAX_REFERENCE)
    out: dict[tuple[str, tuple[str, ...]], Name] = {}
    clash: set[tuple[str, tuple[str, ...]]] = set()

    def add(kind: str, ref: int, text: str, label: bool = False, initials: bool = False) -> None:
        words = tuple(fold(text))
        if not words:
            return
        have = out.get((kind, words))
        if have is None or (label and not have.label):
            out[kind, words] = Name(kind, ref, words, label, initials)
        elif have.ref_id != ref and not have.label:
            clash.add((kind, words))

    for r in rows:
        add(r["kind"], r["ref_id"], r["label"], True)
    countries = {r["code"]: r["ref_id"] for r in rows if r["code"]}
    for kind in {r["kind"] for r in rows if r["code"]}:
        for ref, text in country_names(spark, countries):
            add(kind, ref, text)
    for r in rows:
        if r["code"]:
            add(r["kind"], r["ref_id"], f"{r['code']} {r['label']}")
            add(r["kind"], r["ref_id"], f"{r['label']} {r['code']}")
        for text in re.split(r"[,;()]|\band\b", r["note"] or ""):
            add(r["kind"], r["ref_id"], text)
            add(r["kind"], r["ref_id"], " ".join(re.sub(r"(ies|s)$", lambda m: "y" if m[0] == "ies" else "", w) if len(w) > 4 and not w.endswith("ss") else w for w in text.split()))
        words = fold(r["label"])
        if len(words) > 1:
            add(r["kind"], r["ref_id"], "".join(w[0] for w in words), initials=True)
    return [n for k, n in out.items() if k not in clash]


def deletions(word: str, most: int) -> set[str]:
    """The word, what is left of it without up to most letters, and, of long words, its letters sorted."""
    out = {word, "~" + "".join(sorted(word))} if len(word) > 5 and most else {word}
    last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def reach(word: str) -> int:
    """Edits that a word may have suffered: none below 3 letters, one below 5, else two; codes with digits none."""
    return 0 if len(word) < 3 or any(c.isdigit() for c in word) else 1 if len(word) < 5 else 2


def edits(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one edit."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def similarity(a: str, b: str) -> float:
    """Share of letters kept (0 beyond two edits); a plural costs hardly any."""
    if a == b:
        return 1.0
    if a + "s" == b or b + "s" == a:
        return 0.97
    d = edits(a, b)
    return 1 - d / max(len(a), len(b)) if d <= 2 else 0.0


def shortened(a: str, b: str) -> bool:
    """a abbreviates b: same first letter, fewer letters, all of them in b in the same order."""
    if not a or a[0] != b[0] or len(a) >= len(b):
        return False
    at = iter(b)
    return all(c in at for c in a)


class Vocabulary:
    """The words of one kind, found by what they have in common with a typed word but for a few letters."""

    LONG = 48  # longer words are compared one by one with those of about their length, as their deletions are many

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.exact = set(self.words)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        self.longest = max(map(len, self.words), default=0)
        hashes, where = [], []
        for i, w in enumerate(self.words):
            if len(w) > self.LONG:
                self.by_length[len(w)].append(w)
            else:
                some = [xxhash.xxh3_64_intdigest(d) for d in deletions(w, reach(w))]
                hashes += some
                where += [i] * len(some)
        h = np.array(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.where = h[order], np.array(where, np.int32)[order]

    def near(self, word: str) -> list[tuple[str, float]]:
        """(word of the vocabulary, similarity) for all within two edits, in alphabetical order."""
        most = reach(word)
        if not most or len(word) > self.longest + 2:
            return [(word, 1.0)] if word in self.exact else []
        found = {w for k in range(len(word) - 2, len(word) + 3) for w in self.by_length.get(k, ())}
        if len(word) <= self.LONG + 2:
            h = np.array([xxhash.xxh3_64_intdigest(d) for d in deletions(word, most)], np.uint64)
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            found.update(self.words[j] for a, b in zip(lo, hi) for j in self.where[a:b])
        return [(w, sim) for w in sorted(found) if (sim := similarity(word, w)) > 0]


class Ranker:
    """Ranks names for one value by soft TF-IDF over repaired tokens."""

    def __init__(self, names: list[Name], vocabularies: dict[str, Vocabulary], threshold: float):
        self.threshold = threshold
        self.names, self.vocabularies = names, vocabularies
        self.memo: dict[tuple[str, str], list[tuple[str, float]]] = {}
        self.by_word: dict[tuple[str, str], list[int]] = defaultdict(list)
        df: dict[tuple[str, str], set[int]] = defaultdict(set)
        for i, n in enumerate(names):
            for w in () if n.initials else set(n.words):
                self.by_word[n.kind, w].append(i)
                df[n.kind, w].add(n.ref_id if n.ref_id else -1 - i)
        self.idf = {k: math.log(1 + 60 / len(v)) for k, v in df.items()}
        self.top = math.log(61)
        self.whole: dict[tuple[str, str], int] = {}
        for i, n in enumerate(names):
            self.whole.setdefault((n.kind, "".join(n.words)), i)
        # Labels in alphabetical order, to complete what is cut off, and by first letters, to read abbreviations.
        self.spelt: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.initials: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, n in enumerate(names):
            if n.label:
                solid = [w for w in n.words if w not in NOISE]
                self.spelt[n.kind] += [("".join(n.words), n.ref_id), ("".join(solid), n.ref_id)]
                for words in {n.words, tuple(solid)}:
                    self.initials[n.kind, "".join(w[0] for w in words)].append(i)
        for some in self.spelt.values():
            some.sort()
        self.norm = [math.sqrt(sum(self.weight(n.kind, w) ** 2 for w in n.words)) for n in names]

    def near(self, kind: str, word: str) -> list[tuple[str, float]]:
        """The repairs of a token. Each distinct token is repaired once (remembered; the memory is emptied when large)."""
        if (kind, word) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[kind, word] = self.vocabularies[kind].near(word) if kind in self.vocabularies else []
        return self.memo[kind, word]

    def completed(self, kind: str, start: str) -> set[int]:
        """The entries whose label starts so."""
        some = self.spelt[kind]
        out, at = set(), bisect_left(some, (start, -1))
        while at < len(some) and some[at][0].startswith(start) and len(out) < 2:
            out.add(some[at][1])
            at += 1
        return out

    def weight(self, kind: str, word: str) -> float:
        w = self.idf.get((kind, word), self.top)
        return w * NOISE_WEIGHT if word in NOISE else w

    def rank(self, kind: str, value: str) -> tuple[int, float]:
        """(ref_id, score); 0 where no name reaches the threshold. Ties go to the smaller ref_id."""
        words = fold(value)
        near = {w: self.near(kind, w) for w in dict.fromkeys(words)}
        solid = [w for w in words if w not in NOISE] or words
        for key in ("".join(words), "".join(solid)):
            if (kind, key) in self.whole:
                return self.names[self.whole[kind, key]].ref_id, 1.0
        best = (0.0, 0, 0)
        # Names sharing a repaired token, by soft TF-IDF.
        scores: dict[int, dict[str, float]] = defaultdict(dict)
        for w in dict.fromkeys(words):
            for v, sim in near.get(w, ()):
                for i in self.by_word.get((kind, v), ()):
                    got = sim * self.weight(kind, v) * (NOISE_WEIGHT * self.top if w in NOISE else self.weight(kind, v))
                    if got > scores[i].get(v, 0):
                        scores[i][v] = got
        mine = 0.0
        for w in dict.fromkeys(words):
            known = [self.weight(kind, v) for v, _ in near.get(w, ())]
            mine += (self.top * NOISE_WEIGHT if w in NOISE else max(known, default=self.top)) ** 2
        mine = math.sqrt(mine)
        for i, parts in scores.items():
            n = self.names[i]
            score = sum(parts.values()) / (mine * self.norm[i]) if mine and self.norm[i] else 0.0
            best = max(best, (score, n.label, -n.ref_id), key=lambda x: (round(x[0], 9), x[1], x[2]))
        # The value run together or misspelt as a whole.
        for key in {"".join(words), "".join(solid)}:
            for v, sim in self.near(kind, key):
                if (kind, v) in self.whole and sim >= 0.75:
                    n = self.names[self.whole[kind, v]]
                    best = max(best, (sim, n.label, -n.ref_id))
        if best[0] >= 0.86:
            return -best[2], best[0]
        # Cut off, or abbreviated word by word: only where it names one label.
        joined = "".join(solid)
        if len(joined) >= 5:
            cut = self.completed(kind, "".join(words)) | self.completed(kind, joined)
            if len(cut) == 1:
                return cut.pop(), 0.9
        short = set()
        for given in (words, solid):
            if sum(map(len, given)) < 5:
                continue
            for i in self.initials.get((kind, "".join(w[0] for w in given)), ()):
                full = self.names[i].words
                for target in (list(full), [w for w in full if w not in NOISE]):
                    if len(target) == len(given) and all(a == b or (len(a) > 1 and shortened(a, b)) for a, b in zip(given, target)):
                        short.add(self.names[i].ref_id)
        if len(short) == 1:
            return short.pop(), 0.88
        # A place followed by the entry's own name, apart by punctuation.
        parts = [p for p in re.split(r"[,/()|;–-]", value) if p.strip()]
        if len(parts) > 1:
            inside = {self.names[self.whole[kind, "".join(fold(p))]].ref_id for p in parts if (kind, "".join(fold(p))) in self.whole and len("".join(fold(p))) > 3} - {0}
            if len(inside) == 1:
                return inside.pop(), 0.85
        return (-best[2], best[0]) if best[0] >= self.threshold else (0, best[0])


def map_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """kind, value, ref_id, score for every distinct value of a kind.

    values(kind, value): null and blank values are not mapped (dropped); every other one comes out once. Values
    without a single letter map to 0. reference(ref_id, kind, label, code, note); an empty one maps all to 0.
    """
    spark = values.sparkSession
    names = reference_names(spark, reference)
    spelt = {k: Vocabulary([w for n in names if n.kind == k and not n.initials for w in (*n.words, "".join(n.words))]) for k in {n.kind for n in names}}
    held = spark.sparkContext.broadcast((names, spelt))
    distinct = values.where("kind IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''").select("kind", "value").distinct()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = None
        for pdf in batches:
            ranker = ranker or Ranker(*held.value, threshold)
            rows = [(k, v, *ranker.rank(k, v)) for k, v in zip(pdf["kind"], pdf["value"])]
            yield pd.DataFrame(rows, columns=["kind", "value", "ref_id", "score"]).astype({"score": float})

    # Spread evenly: distinct values are few bytes but much work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(tasks).mapInPandas(rank, "kind string, value string, ref_id bigint, score double")


def map_columns(sources: list[tuple[str, DataFrame, str, str]], reference: DataFrame) -> DataFrame:
    """table_name, row_id, field_name, ref_id, score of every value that needs mapping.

    sources: (table name, table with row_id, column, kind). A value that is missing (null, empty, blank, a lone
    dash) or exactly a label of its kind needs none. Repeated rows come out once; extra columns are not read.
    """
    cells = None
    for name, df, column, kind in sources:
        one = df.select(F.lit(name).alias("table_name"), "row_id", F.lit(column).alias("field_name"), F.lit(kind).alias("kind"), F.col(column).alias("value"))
        cells = one if cells is None else cells.unionByName(one)
    cells = cells.where(~F.coalesce(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").isin("", "-"), F.lit(True)))
    labels = [(r["kind"], r["label"]) for r in small_rows(reference.select("kind", "label").where("kind IS NOT NULL AND label IS NOT NULL"), MAX_REFERENCE)]
    for kind in sorted({k for k, _ in labels}):
        cells = cells.where(~((F.col("kind") == kind) & F.col("value").isin([v for k, v in labels if k == kind])))
    mapped = map_values(cells.select("kind", "value"), reference)
    return cells.join(mapped, ["kind", "value"]).select("table_name", "row_id", "field_name", "ref_id", F.round("score", 4).alias("score")).distinct()
