"""Evaluation texts leaking into training text, by greedy string tiling.

Texts and test items become word sequences without case, punctuation, markup, layout, invisible characters and
line-end hyphens. A rolling (Karp-Rabin) hash over the words of a document finds the seeds it shares with any
item. Matches grow from the seeds along their diagonal, across at most two replaced words; the longest is marked as a
tile first, and marked words are not used again: of a match that a tile covers in part, the free part remains. An item
has leaked where

* a tile spans 18 of its successive words or more, or
* tiles that follow each other closely do, with at most two words replaced, inserted or left out in all, or
* all tiles of a document together cover COVERED of its words, in whatever order they stand.

The held-out items are few by contract (MAX_ITEMS and MAX_BYTES at most, checked) and go to every worker; the corpus
is never shuffled, each document is read once as a whole. A seed of 6 words misses nothing: of 18 words with two
replaced, one run of 6 is always left.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import small_rows

MAX_ITEMS, MAX_BYTES = 100_000, 200_000_000
SEED, NEED, REPLACED = 6, 18, 2
COVERED = 0.8  # the share of an item that reordered passages must cover
BASE = np.uint64(1_000_003)

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
INLINE = "b|i|u|s|em|strong|span|a|font|code|mark|sub|sup|small|wbr|abbr|q|cite"
INLINE_TAG = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
# The same up to a length: what is longer may also be words between two signs.
SHORT_INLINE_TAG = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]{{0,400}})?/?>", re.I)
SHORT_TAG = re.compile(r"<!--.{0,2000}?-->|</?[a-zA-Z][^<>]{0,400}>", re.S)
LONG = re.compile(r"<!--|</?[a-zA-Z][^<>]{400,}>")
LINK = re.compile(r"\]\([^()\s]*\)")
HYPHEN_END = re.compile(r"[-‐‑¬][^\S\n]*\r?\n[\s>|*#]*")
HYPHEN = re.compile(r"[-‐‑‒'’]")
WORD = re.compile(r"[^\W_]+")


def without_comments(text: str) -> str:
    """A text without HTML comments of any length."""
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], " "]
        at = b + 3
    return "".join(out) + text[at:]


def readings(text: str | None) -> list[list[str]]:
    """The words of a text that count in a comparison; a second time with long tags read as words, if there are any."""
    if not text:
        return [[]]
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    texts = [text]
    if "<" in text:
        texts = [TAG.sub(" ", INLINE_TAG.sub("", without_comments(text)))]
        if LONG.search(text):
            texts.append(SHORT_TAG.sub(" ", SHORT_INLINE_TAG.sub("", text)))
    out = []
    for t in texts:
        if "](" in t:
            t = LINK.sub("] ", t)
        t = HYPHEN.sub("", HYPHEN_END.sub("", t))
        w = WORD.findall(t.casefold())
        if w not in out:
            out.append(w)
    return out


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k ids, modulo 2**64: each follows from the one before."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    for i in range(k):
        out = out * BASE + x[i : i + n]
    return out


class Items:
    """The held-out items, indexed by the hashes of their word windows."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED, need: int = NEED, replaced: int = REPLACED):
        self.seed, self.need, self.replaced = seed, need, replaced
        self.vocab: dict[str, int] = {}
        self.ids, self.text = [], []
        for item, text in rows:
            for w in readings(text):
                if w:
                    self.ids.append(item)
                    self.text.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64))
        hashes, where, at = [], [], []
        for i, t in enumerate(self.text):
            h = rolling(t, min(seed, len(t))) if len(t) >= seed else np.zeros(0, np.uint64)
            hashes.append(h)
            where.append(np.full(len(h), i))
            at.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.where = (np.concatenate(where) if where else h.astype(np.int64))[order].astype(np.int64)
        self.at = (np.concatenate(at) if at else h.astype(np.int64))[order].astype(np.int64)

    def seeds(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item index, place in item, place in document) of every shared window."""
        known = np.concatenate(([0], np.cumsum(doc > 0)))
        k = self.seed
        if len(doc) < k or not len(self.hash):
            return []
        full = np.flatnonzero(known[k:] - known[:-k] == k)
        if not len(full):
            return []
        h = rolling(doc, k)[full]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        out = []
        for j in np.flatnonzero(hi > lo):
            p = int(full[j])
            for e in range(lo[j], hi[j]):
                i, q = int(self.where[e]), int(self.at[e])
                if (self.text[i][q : q + k] == doc[p : p + k]).all():
                    out.append((i, q, p))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, longest span of item words without or with few changes, marked words, covered share) by item found in a text."""
        best: dict[int, tuple[int, int, int, float]] = {}
        for w in readings(text):
            for found in self.leaks_of(w):
                best[found[0]] = max(found, best.get(found[0], found))
        return list(best.values())

    def leaks_of(self, w: list[str]) -> list[tuple[int, int, int, float]]:
        """The same for one reading of a text (and every reading of an item)."""
        get = self.vocab.get
        doc = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        by: dict[int, set[int]] = {}
        for i, q, p in self.seeds(doc):
            by.setdefault(i, set()).add(p - q)
        out = []
        for i, diagonals in sorted(by.items()):
            tiles = self.tiles(self.text[i], doc, diagonals)
            n = len(self.text[i])
            marked = sum(t[3] for t in tiles)
            out.append((self.ids[i], self.span(tiles, n), marked, marked / n))
        return out

    def tiles(self, item: np.ndarray, doc: np.ndarray, diagonals: set[int]) -> list[tuple[int, int, int, int]]:
        """(start in item, end in item, start in document, words alike) of the tiles, the longest first.

        A tile is a stretch of a diagonal with at most REPLACED words that differ, and a run of SEED words alike. The
        queue holds every diagonal by the length its best stretch once had; as marks only shorten stretches, one
        that is still as long when its turn comes is the longest of all.
        """
        n = len(item)
        free_item, free_doc = np.ones(n, bool), np.ones(len(doc), bool)
        same = {}
        for d in diagonals:
            lo, hi = max(0, -d), min(n, len(doc) - d)
            same[d] = (lo, item[lo:hi] == doc[lo + d : hi + d])
        queue = []
        for d, (lo, alike) in same.items():
            if (best := self.stretch(alike, np.ones(len(alike), bool))) is not None:
                heapq.heappush(queue, (best[0] - best[1], lo + best[0], d, best))
        out = []
        while queue:
            size, _, d, (a, b) = heapq.heappop(queue)
            lo, alike = same[d]
            free = free_item[lo : lo + len(alike)] & free_doc[lo + d : lo + d + len(alike)]
            if not free[a:b].all():
                if (best := self.stretch(alike, free)) is not None:
                    heapq.heappush(queue, (best[0] - best[1], lo + best[0], d, best))
                continue
            free_item[lo + a : lo + b] = False
            free_doc[lo + a + d : lo + b + d] = False
            out.append((lo + a, lo + b, lo + a + d, int(alike[a:b].sum())))
            free[a:b] = False
            if (best := self.stretch(alike, free)) is not None:
                heapq.heappush(queue, (best[0] - best[1], lo + best[0], d, best))
        return out

    def stretch(self, alike: np.ndarray, free: np.ndarray) -> tuple[int, int] | None:
        """The longest stretch of free words, at most REPLACED of them not alike, that holds a run of SEED words alike; the first of equals."""
        good = alike & free
        runs = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0])))).reshape(-1, 2)
        if not len(runs) or (runs[:, 1] - runs[:, 0]).max() < self.seed:
            return None
        best = None
        taken = np.concatenate(([0], np.cumsum(~free)))
        for j in np.flatnonzero(runs[:, 1] - runs[:, 0] >= self.seed):
            # Runs around the long one, as far as few words between them differ and none is taken.
            for left in range(j, max(-1, int(j) - self.replaced - 1), -1):
                a = int(runs[left, 0])
                lost = int(runs[j, 0]) - a - int((runs[left:j, 1] - runs[left:j, 0]).sum())
                if lost > self.replaced or taken[runs[j, 0]] > taken[a]:
                    break
                right, b = int(j), int(runs[j, 1])
                while right + 1 < len(runs):
                    gap = int(runs[right + 1, 0] - runs[right, 1])
                    if lost + gap > self.replaced or taken[runs[right + 1, 0]] > taken[b]:
                        break
                    lost, right = lost + gap, right + 1
                    b = int(runs[right, 1])
                # Words that differ may also stand at the ends, where that makes the stretch long enough.
                before = next((k for k in range(min(self.replaced - lost, a)) if not free[a - 1 - k]), min(self.replaced - lost, a))
                short = self.need - (b - a)
                if 0 < short <= self.replaced - lost:
                    left_part = min(before, short)
                    if b + short - left_part <= len(free) and free[b : b + short - left_part].all():
                        a, b = a - left_part, b + short - left_part
                if best is None or b - a > best[1] - best[0]:
                    best = a, b
        return best

    def span(self, tiles: list[tuple[int, int, int, int]], n: int) -> int:
        """The most item words that a tile, or tiles in close order, span with few changes; 0 below the needed number."""
        need, most = (self.need, self.replaced) if n >= self.need else (n, 0)
        best, ends = 0, []
        for a, b, p, alike in sorted(tiles, key=lambda t: t[2]):
            here = [(b - a, b - a - alike)]
            for a0, b0, p0, q0, chains in ends[-3:]:
                gap = max(a - b0, p - q0)
                if a >= b0 and p >= q0 and gap <= most:
                    here += [(size + b - b0, lost + gap + b - a - alike) for size, lost in chains]
            here = [(size, lost) for size, lost in here if lost <= most]
            ends.append((a, b, p, p + b - a, here))
            best = max([best, *[size for size, _ in here]])
        return best if best >= need else 0


def tile(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, doc_id, longest, marked, covered for every document and item that share a seed.

    Null, empty and wordless texts and items match nothing; repeated rows come out once; an item of fewer than 18
    words leaks only as a whole, one of fewer than 6 not at all. Extra columns are not read.
    """
    rows = [(r[0], r[1]) for r in small_rows(items.select("item_id", "text").where("item_id IS NOT NULL").distinct(), MAX_ITEMS)]
    if sum(len(r[1] or "") for r in rows) > MAX_BYTES:
        raise ValueError(f"held-out items of more than {MAX_BYTES} characters")
    held = docs.sparkSession.sparkContext.broadcast(Items(sorted(rows, key=lambda r: (r[0], r[1] or ""))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for pdf in batches:
            out = [(i, d, longest, marked, share) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, longest, marked, share in index.leaks(t)]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "longest", "marked", "covered"])

    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.make_valid_utf8(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    return src.mapInPandas(run, "item_id bigint, doc_id bigint, longest int, marked int, covered double")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id of every leak: 18 successive words or more with at most two changed, or most of an item in any order."""
    return tile(docs, items).where(f"longest > 0 OR (covered >= {COVERED} AND marked >= {NEED})").select("item_id", "doc_id").distinct()
