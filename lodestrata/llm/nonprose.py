"""Keyword-stuffed and link-list pages, by a hidden Markov model over the segments of a text.

A text is cut into lines, long lines into sentences. Each segment is observed through a few binned features;
the Viterbi path labels it as prose, stuffed search terms, link list, tag list, menu or product list, and a page
is flagged when more than half of its words lie in segments that are not prose.

The model starts from the states' definitions (fixed values below, weighted as pseudo-counts) and is then
trained by hard expectation-maximisation on all documents. Texts are read once: of each segment its number of words and
its features, as one small number, are stored. Workers label these and count, the counts (a table of states by
combinations of bins, whatever the corpus) are summed, and the next labelling uses them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import stored

STATES = ("prose", "stuffed", "links", "tags", "menu", "products")
# Frequent function words of the corpus's four languages.
FUNCTION_WORDS = frozenset(
    """the a an of to and in for is are was were be been by with on at that this these we our you your it its has have had as or from their they not but which who will would
    could can if so than them there what when about into he she his her i i'm don't all any may must do does how said
    der die das den dem des ein eine einen einem einer und ist sind war hat haben wir sie er es ihr uns von zu zum zur im in mit für auf aus bei nach vor noch nicht auch dass als wie über bevor weil
    el la los las un una unos de del y o en que es son fue ha han por para con su sus se no más como pero antes sobre al lo desde muy esta este puede
    le la les un une des du de et ou est sont a ont nous vous il elle ils en que qui dans sur pour par avec plus pas ne se ce cette au aux avant depuis son sa ses leur""".split()
)
URL = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|<a\s[^<>]*>[^<]*</a>|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[\w¿¡\"'«“])")
SEPARATOR = re.compile(r"\s[|/»›>·•–-]\s|[|»›·•;,]\s?|\s{2,}|\t")
CODE = re.compile(r"^(?=.*\d)(?=.*[A-Za-z-])[\w-]+$")
INNER = re.compile(r"[|»›·•;,\t]|\s[/>–-]\s|\s\s")
MARK = re.compile(r"^(?:[-*•]|\d+[.)])\s+")
ENDS = frozenset('.!?…:»"”)')
EDGES = ".,;:!?()[]{}\"'«»“”|#*"
STRIP = lambda t: t.strip(EDGES)
DIGIT = re.compile(r"\d")
BINS = {"url": 4, "hash": 3, "stop": 4, "item": 4, "repeat": 4, "code": 3, "end": 2}
# Probabilities of each bin by state, the definition that training starts from.
START = {
    "prose": {"url": (94, 4, 1, 1), "hash": (97, 2, 1), "stop": (3, 10, 35, 52), "item": (70, 24, 4, 2), "repeat": (88, 9, 2, 1), "code": (92, 6, 2), "end": (12, 88)},
    "stuffed": {"url": (97, 1, 1, 1), "hash": (98, 1, 1), "stop": (60, 30, 9, 1), "item": (50, 15, 25, 10), "repeat": (2, 8, 25, 65), "code": (94, 5, 1), "end": (85, 15)},
    "links": {"url": (1, 2, 7, 90), "hash": (97, 2, 1), "stop": (88, 9, 2, 1), "item": (50, 20, 15, 15), "repeat": (60, 20, 10, 10), "code": (75, 15, 10), "end": (50, 50)},
    "tags": {"url": (97, 1, 1, 1), "hash": (33, 7, 60), "stop": (90, 8, 1, 1), "item": (10, 10, 40, 40), "repeat": (45, 25, 15, 15), "code": (85, 10, 5), "end": (92, 8)},
    "menu": {"url": (96, 2, 1, 1), "hash": (98, 1, 1), "stop": (85, 12, 2, 1), "item": (15, 10, 35, 40), "repeat": (45, 25, 15, 15), "code": (90, 8, 2), "end": (92, 8)},
    "products": {"url": (96, 2, 1, 1), "hash": (98, 1, 1), "stop": (94, 4, 1, 1), "item": (60, 15, 15, 10), "repeat": (60, 20, 10, 10), "code": (3, 17, 80), "end": (94, 6)},
}
STAY = 0.8
# The definition weighs as much as so many documents, or as this share of those counted if that is more: training on
# more documents knows the shares better, but must not drown the definition.
PRIOR, PRIOR_SHARE = 2_000.0, 0.1
SEEN = list(product(*map(range, BINS.values())))
CODES = {x: i for i, x in enumerate(SEEN)}
# Counts in one row: starts by state, moves by both states, segments by state and combination of bins.
SHAPES = ((len(STATES),), (len(STATES), len(STATES)), (len(STATES), len(SEEN)))
CUTS = np.cumsum([0] + [int(np.prod(x)) for x in SHAPES])


def segments(text: str) -> list[str]:
    """Lines with words; lines of several sentences are cut into them."""
    out = []
    for line in re.split(r"\r\n|\n|\r| | |\x0b|\x0c", text):
        if len(line) > 120:
            out += SENTENCE.split(line)
        else:
            out.append(line)
    return out


def level(x: float, *cuts: float) -> int:
    """How many of the cuts x exceeds."""
    return bisect_left(cuts, x)


class Bare(dict):
    """Words without the marks around them; '' for what is no word. Remembered, as words repeat."""

    def __missing__(self, token: str) -> str:
        t = STRIP(token)
        t = t if any(map(str.isalnum, t)) else ""
        if len(self) > 500_000:
            self.clear()
        if len(token) < 40:
            self[token] = t
        return t


BARE = Bare()


def words_of(segment: str) -> list[str]:
    """The words of a segment in lower case, without the marks around them."""
    return [t for t in map(BARE.__getitem__, segment.casefold().split()) if t]


def observe(segment: str, words: list[str], often: set[str]) -> tuple[int, ...]:
    """The binned features of a segment with words (see BINS). often: the words its page repeats."""
    n = len(words)
    linked = hashes = 0
    if "](" in segment or "://" in segment or "www." in segment or "href" in segment or ("." in segment and "/" in segment):
        linked = sum(sum(any(map(str.isalnum, t)) for t in m.group().split()) for m in URL.finditer(segment))
    if "#" in segment:
        hashes = sum(t.lstrip("*-(")[:1] == "#" for t in segment.split())
    stop = sum(map(FUNCTION_WORDS.__contains__, words))
    body = segment.strip()
    items = sum(any(map(str.isalnum, p)) for p in SEPARATOR.split(MARK.sub("", body))) if INNER.search(body) else 1
    short = n / items if items > 2 else 99.0
    repeat = sum(map(often.__contains__, words)) if often else 0
    codes, first = 0.0, False
    if DIGIT.search(segment) or "-" in segment:
        codes = sum(bool(CODE.match(t)) for t in words if not t.isalpha()) / n
        first = bool(CODE.match(words[0]))
    return (
        level(min(1.0, linked / n), 0.0, 0.25, 0.6),
        level(hashes / n, 0.0, 0.5),
        level(stop / n, 0.06, 0.14, 0.24),
        0 if short > 8 else 1 if short > 5 else 2 if short > 2 else 3,
        level(repeat / n, 0.12, 0.3, 0.5),
        2 if first and codes > 0.15 else 1 if codes > 0 else 0,
        int(segment.rstrip()[-1] in ENDS),
    )


def read(text: str | None) -> tuple[list[int], list[int]]:
    """Of each segment with words: its features' code and its number of words."""
    if not text:
        return [], []
    parts = [(s, w) for s in segments(text) if (w := words_of(s))]
    page = Counter()
    for _, w in parts:
        page.update(w)
    # Words that the page repeats far more than prose does; function words never count.
    least = max(3.0, 0.02 * page.total())
    often = {t for t, k in page.items() if k > least} - FUNCTION_WORDS
    return [CODES[observe(s, w, often)] for s, w in parts], [len(w) for _, w in parts]


class Model:
    """Log probabilities of starts, transitions and combinations of bins."""

    def __init__(self, counts: np.ndarray | None = None):
        k = len(STATES)
        begun, moved, seen = (np.zeros(x) if counts is None else counts[i:j].reshape(x) for x, i, j in zip(SHAPES, CUTS, CUTS[1:]))
        prior = max(PRIOR, PRIOR_SHARE * begun.sum())
        move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(move, STAY)
        move = move * prior + moved
        begin = np.array([0.5] + [0.1] * (k - 1)) * prior + begun
        self.begin = np.log(begin / begin.sum())
        self.move_to = np.ascontiguousarray(np.log(move / move.sum(1, keepdims=True)).T)
        self.emit = np.zeros((len(SEEN), k))
        for i, (f, size) in enumerate(BINS.items()):
            bins = np.array([x[i] for x in SEEN])
            p = np.array([START[s][f] for s in STATES]) / 100 * prior + np.stack([seen[:, bins == b].sum(1) for b in range(size)], 1)
            # However much is counted, a state keeps half of its definition.
            own = np.array([START[s][f] for s in STATES], float)
            p = 0.5 * p / p.sum(1, keepdims=True) + 0.5 * own / own.sum(1, keepdims=True)
            self.emit += np.log(p).T[bins]

    def viterbi(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The states of the segments of many documents, one after the other. starts: where each begins, and the end; none is empty.

        All documents take a step at once, the longest first, so those that go on are always the first.
        """
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[:-1][order], -lengths[order]
        path = np.empty(len(codes), np.int8)
        if not len(at):
            return path
        best, last, back = self.begin + self.emit[codes[at]], [], []
        for t in range(1, -left[0]):
            n = int(np.searchsorted(left, -t))
            last.append(best[n:].argmax(1))  # of those that end here
            ways = best[:n, None, :] + self.move_to
            back.append(ways.argmax(2).astype(np.int8))
            best = ways.max(2) + self.emit[codes[at[:n] + t]]
        state = best.argmax(1)
        for t in range(-left[0] - 1, 0, -1):
            n = len(state)
            path[at[:n] + t] = state
            state = np.concatenate([back[t - 1][np.arange(n), state], last[t - 1]])
        path[at] = state
        return path

    def label(self, text: str | None) -> list[tuple[int, int, tuple[int, ...]]]:
        """(state, words, features) of each segment with words."""
        codes, words = read(text)
        path = self.viterbi(np.array(codes, np.int64), np.array([0, len(codes)] if codes else [0]))
        return [(int(k), n, SEEN[c]) for k, n, c in zip(path, words, codes)]


def observed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, codes, words: the features' codes and numbers of words of a document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, ends = [], [], [0]
            for t in batch.column("text").to_pylist():
                c, w = read(t)
                codes += c
                words += w
                ends.append(len(codes))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, kind))) for x, kind in ((codes, np.int16), (words, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "codes", "words"])

    # Batches stay in Arrow, as pandas would make floats of ids beside a null one.
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.make_valid_utf8(text).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, codes array<smallint>, words array<int>")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists without nulls, one after the other, and where each begins, and the end."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0]


def train(seen: DataFrame, rounds: int = 1) -> Model:
    """The model after so many rounds of labelling and counting over all documents that observed() gave."""
    model = Model()
    for _ in range(rounds):
        held = seen.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, k = held.value, len(STATES)
            sums = np.zeros(CUTS[-1], np.int64)
            for batch in batches:
                codes, starts = flat(batch.column("codes"))
                starts = np.unique(starts)
                path = m.viterbi(codes, starts).astype(np.int64)
                inner = np.ones(len(path), bool)
                inner[starts[:-1]] = False
                to = np.flatnonzero(inner)
                each = (path[starts[:-1]], path[to - 1] * k + path[to], path * len(SEEN) + codes)
                sums += np.concatenate([np.bincount(x, minlength=j - i) for x, i, j in zip(each, CUTS, CUTS[1:])])
            what = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(sums[what])], ["what", "n"])

        counts = np.zeros(CUTS[-1])
        for r in seen.select("codes").mapInArrow(count, "what int, n bigint").groupBy("what").agg(F.sum("n").alias("n")).collect():
            counts[r["what"]] = r["n"]
        model = Model(counts)
    return model


def label_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, words, nonprose, kind (the state with most words), flagged, one row a document.

    Null, empty and wordless texts have no words and are not flagged; exactly half is not flagged either. Repeated
    rows come out as often as they come in; extra columns are not read.
    """
    seen = stored(observed(docs, key, text), "segments")
    held = seen.sparkSession.sparkContext.broadcast(train(seen, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = held.value, len(STATES)
        kinds = np.array([*STATES, None], object)
        for batch in batches:
            codes, starts = flat(batch.column("codes"))
            path = m.viterbi(codes, np.unique(starts))
            doc = np.repeat(np.arange(len(batch)), np.diff(starts))
            by = np.bincount(doc * k + path, flat(batch.column("words"))[0], len(batch) * k).astype(np.int64).reshape(-1, k)
            total = by.sum(1)
            kind = pa.array(kinds[np.where(total > 0, by.argmax(1), k)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(total - by[:, 0]), kind, pa.array(2 * (total - by[:, 0]) > total)], ["doc_id", "words", "nonprose", "kind", "flagged"])

    return seen.mapInArrow(run, "doc_id bigint, words bigint, nonprose bigint, kind string, flagged boolean")
