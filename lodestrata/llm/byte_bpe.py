"""Encoding of a corpus by a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry
as a whole: two array reads and one comparison of bytes. Only the misses are merged, by a heap of pair ranks
over a doubly linked list of byte pieces, in O(n log n), however long a pre-token is. Nothing is shuffled:
the encoder is a projection over Arrow batches.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 200_000
MASK = (1 << 64) - 1


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies: below $TOKENIZERS_DIR, else where its package was installed."""
    root = os.environ.get("TOKENIZERS_DIR")
    return os.path.join(root, name) if root else importlib.import_module("public_tokenizers").path(name)


def public_pattern() -> str:
    """The split of texts into pre-tokens that belongs to the public vocabulary."""
    return importlib.import_module("public_tokenizers").PATTERN


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): key -> its position in a table without gaps.

    Keys fall into buckets by one half of a 64-bit hash; buckets of several keys are placed, largest first, by the
    first displacement that sends all their keys to free slots. A bucket of one key then takes any slot left over,
    whose number it stores (negative). Absent keys are told apart by the stored bytes.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            by[(h >> 32) % self.buckets].append(i)
        self.displace = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        free = bytearray(b"\1") * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            if len(by[b]) < 2:
                break
            d = 0
            while True:
                slots = [self.mix(hashes[i], d) for i in by[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for i, s in zip(by[b], slots):
                free[s], self.keys[s], self.values[s] = 0, keys[i], values[i]
        left = (s for s in range(self.n) if free[s])
        for b, own in enumerate(by):
            if len(own) == 1:
                s = next(left)
                self.displace[b], self.keys[s], self.values[s] = -1 - s, keys[own[0]], values[own[0]]

    def mix(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[(h >> 32) % self.buckets]
        s = self.mix(h, d) if d >= 0 else -1 - d
        return self.values[s] if self.keys[s] == key else -1


def read_vocabulary(path: str) -> PerfectHash:
    """The hash of a vocabulary file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return PerfectHash([base64.b64decode(k) for k, _ in pairs], [int(r) for _, r in pairs])


class Encoder:
    """Encodes texts by the ranks of a vocabulary."""

    def __init__(self, table: PerfectHash, pattern: str):
        self.table = table
        self.split = regex.compile(pattern)
        self.memo: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merges a pre-token outside the vocabulary: always the pair of the lowest rank, the leftmost of equals."""
        n = len(word)
        end = list(range(1, n + 1))  # the piece at i spans i..end[i]; -1 once merged away
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        get, heap = self.table.get, []
        for i in range(n - 1):
            if (r := get(word[i : i + 2])) >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if end[i] > 0 else n
            if end[i] < 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := get(word[i : end[nxt[j]]])) >= 0:
                    heapq.heappush(heap, (r, i, end[nxt[j]]))
            if (p := prev[i]) >= 0 and (r := get(word[p:stop])) >= 0:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(get(word[i : end[i]]))
            i = nxt[i]
        return out

    def token(self, word: str) -> list[int]:
        """The ids of one pre-token; remembered, as words repeat."""
        raw = word.encode("utf-8", "surrogatepass")
        r = self.table.get(raw)
        ids = [r] if r >= 0 else self.merge(raw)
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        memo, token = self.memo, self.token
        for word in self.split.findall(text):
            out += memo[word] if word in memo else token(word)
        return out


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids of every row. Null and empty texts get an empty list, all others are taken whole and unchanged.

    Repeated rows come out as often as they come in; bytes that are no UTF-8 are read as U+FFFD. Extra columns of
    df are not read.
    """
    pattern = pattern or public_pattern()
    # One vocabulary, of a size that does not depend on the corpus, read and hashed once.
    table = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(table.value, pattern)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            lengths = np.fromiter((len(x) for x in ids), np.int64, len(ids))
            # Lists of a batch may pass 2**31 values only if the batch's texts pass 2 GB, which Arrow forbids.
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            values = np.fromiter((v for x in ids for v in x), np.int32, int(lengths.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    src = df.select(F.col(key).cast("bigint").alias("doc_id"), F.make_valid_utf8(text).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, ids array<int>")
