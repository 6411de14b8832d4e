"""Benchmark decontamination by SimHash windows of the items' sizes.

Words are runs of letters, digits and underscores in lower case. Of a document, every window that has
as many words as an item and could share one of its five-word shingles gets a fingerprint of two times 64 bits; a
multi-index of the items' fingerprints (eight blocks of sixteen bits, of which one holds ``ERRORS`` errors at most) finds all items
within ``RADIUS`` bits of a window, and the similarity of the two bags of shingles, the sum of lesser over the sum of larger
counts, decides exactly. Bags of similarity 0.8 differ in 19 bits on average with a deviation of four.

Windows come from the shingles themselves: a window that shares none with an item has similarity 0, and one whose first shared shingle
stands elsewhere than in the item is no better than the window shifted by that; so only where a
shingle occurs (with up to ``SLACK`` words inserted or left out before it) windows are
formed. Benchmark items are taken in blocks of about ``BLOCK`` words, each a pass over the documents; a
block, some thirty bytes a word, is what is broadcast.

Defined results: null and empty texts match nothing and are kept; items that are null or without words match nothing; an
item of fewer than five words is one shingle; documents shorter than an item are one window; null and
repeated doc_ids are judged row by row; of an item's windows in a document the best is returned, the first of equals; an empty benchmark or no
documents give no matches. Other columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_column

SHINGLE, SIMILARITY, SLACK, BLOCK = 5, 0.8, 2, 1_000_000
BLOCKS, ERRORS = 8, 3
RADIUS = BLOCKS * ERRORS + BLOCKS - 1
_words = re.compile(r"\w+").findall
_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _M + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _print(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=-1, bitorder="little").sum(1, dtype=np.int32)
    return np.packbits(bits * 2 > shingles.shape[1], axis=-1, bitorder="little").view("<u8").ravel()


def prints(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes: two words of 64 bits each."""
    again = shingles * np.uint64(0xD6E8FEB86659FD93)
    return np.stack((_print(shingles), _print(again ^ (again >> np.uint64(32)))), 1)


def _parts(fingerprints: np.ndarray) -> np.ndarray:
    """Blocks of sixteen bits."""
    return np.ascontiguousarray(fingerprints).view("<u2").astype(np.int64)


#: All errors that a block of sixteen bits may hold.
_MASKS = np.array([sum(1 << i for i in bits) for n in range(ERRORS + 1) for bits in combinations(range(16), n)], np.int64)


class Index:
    """Of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, own, fingerprints = [], [], []
        sizes = []
        for i, text in items:
            if w := _words((text or "").lower()):
                self.ids.append(i)
                sizes.append(len(w))
                own.append(_rolled(_hashes(w), min(SHINGLE, len(w))))
                fingerprints.append(prints(own[-1][None])[0])
        self.sizes = np.array(sizes, np.int64)
        self.widths = sorted({min(SHINGLE, n) for n in sizes})
        self.prints = np.array(fingerprints, np.uint64).reshape(len(sizes), 2)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        h = join(own, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        offset = join([np.arange(len(x)) for x in own], np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.offset, self.item = h[order], offset[order].astype(np.int32), item[order].astype(np.int32)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[h >> np.uint64(64 - _BITS)] = True
        # bags: a shingle of an item and how often it has it, in the order of shingles
        pairs, times = np.unique(np.stack((self.h, self.item.astype(np.uint64)), 1), axis=0, return_counts=True)
        self.bag_h, self.bag_item, self.bag_n = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), times
        self.shingles = np.array([len(x) for x in own], np.int64)
        # of each block, the items in the order of its value, and where a value begins
        part = _parts(self.prints)
        self.order = [np.argsort(part[:, b], kind="stable") for b in range(BLOCKS)]
        self.begin = [np.searchsorted(part[o, b], np.arange((1 << 16) + 1)) for b, o in enumerate(self.order)]

    def within(self, fingerprint: np.ndarray) -> np.ndarray:
        """Items within RADIUS of a fingerprint: of eight blocks one holds ERRORS errors at most."""
        found = []
        for b, value in enumerate(_parts(fingerprint)):
            near = value ^ _MASKS
            lo, hi = self.begin[b][near], self.begin[b][near + 1]
            for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found.append(self.order[b][x:y])
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return found[np.bitwise_count(self.prints[found] ^ fingerprint).sum(1) <= RADIUS]

    def similarity(self, shingles: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Of a window's bag and the bags of items: the sum of lesser over the sum of larger counts."""
        own, times = np.unique(shingles, return_counts=True)
        lo, hi = np.searchsorted(self.bag_h, own), np.searchsorted(self.bag_h, own, side="right")
        at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        shared = np.bincount(self.bag_item[at], np.minimum(self.bag_n[at], np.repeat(times, hi - lo)), len(self.ids))[items]
        return shared / (len(shingles) + self.shingles[items] - shared)

    def windows(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(words, start) of each window that may be like an item."""
        out: set[tuple[int, int]] = set()
        for width in self.widths:
            runs = _rolled(h, width)
            at = np.flatnonzero(self.filter[runs >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(self.h, runs[at]), np.searchsorted(self.h, runs[at], side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for k in range(a, b):
                    n = int(self.sizes[self.item[k]])
                    if min(SHINGLE, n) != width:
                        continue
                    start = p - int(self.offset[k])
                    for s in range(start - SLACK, start + SLACK + 1):
                        out.add((min(n, len(h)), min(max(0, s), max(0, len(h) - n))))
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """item_id, start, words, distance, similarity of the items in a text."""
        words = _words(text.lower())
        if not words or not self.ids:
            return []
        h = _hashes(words)
        best: dict[int, tuple] = {}
        by_size: dict[int, list[int]] = {}
        for n, s in self.windows(h):
            by_size.setdefault(n, []).append(s)
        for n, starts in by_size.items():
            runs = _rolled(h, min(SHINGLE, n))
            view = np.lib.stride_tricks.sliding_window_view(runs, n - min(SHINGLE, n) + 1)
            starts = np.array(sorted(starts))
            for at in range(0, len(starts), 512):
                for s, p in zip(starts[at : at + 512].tolist(), prints(view[starts[at : at + 512]])):
                    items = self.within(p)
                    alike = self.similarity(view[s], items)
                    for k, x in zip(items[alike >= SIMILARITY].tolist(), alike[alike >= SIMILARITY].tolist()):
                        row = (-x, s, n, int(np.bitwise_count(self.prints[k] ^ p).sum()))
                        i = self.ids[k]
                        if i not in best or row < best[i]:
                            best[i] = row
        return [(i, s, n, d, -x) for i, (x, s, n, d) in sorted(best.items(), key=lambda kv: (kv[0] is None, kv[0]))]


def _blocks(benchmark: DataFrame, block: int):
    """Indexes of the items, a block at a time."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text"))
    size = own.agg(F.coalesce(F.sum(F.size(F.split("text", "\\W+"))), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // block))
    if parts > 1:
        own = materialize(own.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "benchmark")
    for k in range(parts):
        rows = (own.where(F.col("part") == k) if parts > 1 else own).collect()
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows]))


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start (word), words, distance, similarity for each item found in a row of docs."""
    schema = "doc_id long, item_id long, start int, words int, distance int, similarity double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    out = None
    for held in _blocks(benchmark, block):

        def run(batches, held=held):
            for batch in batches:
                for part in slices(batch):
                    rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for m in held.value.matches(t)]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "start", "words", "distance", "similarity"])

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, whose texts hold no benchmark item."""
    at = docs.columns.index("text")
    for held in _blocks(benchmark, block):

        def run(batches, held=held):
            for batch in batches:
                for part in slices(batch):
                    kept = [not held.value.matches(t or "") for t in part.column(at).to_pylist()]
                    yield part.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
