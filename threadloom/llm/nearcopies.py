"""Near copies of texts: SimHash candidates and an exact join of five-word shingles.

Texts link if the sets of their five-word shingles (words in lower case between white space; a text of fewer
words is one shingle) have a Jaccard similarity of ``SIMILARITY`` or more, whatever their lengths. Every link is
verified on the whole sets; shingles stand as 64-bit hashes.

The first candidates are each text and one other of its component by the tries of ``simhash``, which find fingerprints within two bits. So that no
pair is missed, others come from prefixes: in any one order of all shingles, two such texts share one of the first
n - ceil(0.8 n) + 1 of theirs. The order puts those last that are common in a sample, which changes the work, not the
result. Texts that share a shingle of their prefixes are first compared with one of them each; what that
links needs no further comparison, so that a large group of near copies isn't expanded into all its pairs. Then all
pairs of texts that are still in different components are compared, if their lengths and the places of the
shingle allow the similarity.

Before sets are compared, candidates must pass two signatures. The parities of a set's counts in 256 classes of shingles bound what two sets
can share from above, so that no similar pair is lost; they tell short texts apart, such as copies of one text that were changed in different places. And candidates must be within ``BITS`` bits by SimHash fingerprints of the sets. Sets of similarity 0.8 differ in ten
bits on average with a deviation of three, so that one pair in some ten thousand of the shortest texts may be lost here, and one in millions of longer ones.

The texts are read three times, in batches, and never shuffled but for those in candidate pairs. Of every text a fingerprint of each kind and the prefix are written.

Defined results: texts without words link with each other; null texts are empty ones; null and repeated doc_ids, repeated rows and other columns
are kept or dropped row by row as ``simhash.kept_rows`` says; no documents give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_node, materialize, shuffle_partitions, slices, text_column
from .components import components
from .decontaminate import _hashes, _print, _rolled

SHINGLE = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
PARITIES = ("p0", "p1", "p2", "p3")
#: Bits in which the sets' fingerprints may differ.
BITS = 24
#: For the order of shingles: one in so many texts at most is looked at, all below SAMPLE; shingles in COMMON of them come last, MOST at most.
ONE_IN, SAMPLE, COMMON, MOST = 16, 20_000, 8, 200_000


def shingles(text: str) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    words = text.encode().lower().split()
    return np.unique(_rolled(_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    p, q = SIMILARITY
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * q >= p * (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two similar texts share one, in the order of all shingles. own and common: sorted."""
    p, q = SIMILARITY
    n = len(own)
    if len(common) and n:
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate((own[~late], own[late]))
    return own[: n + (-p * n) // q + 1] if n else np.zeros(1, np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """256 bits: whether the number of shingles in each class is odd. As many as differ between two sets stand in one of them only, at least."""
    return np.packbits(np.bincount(own >> np.uint64(56), minlength=256) & 1).view(np.int64)


def _sharing(n, m, odd):
    """Whether sets of n and m shingles may be similar if odd parities differ."""
    p, q = SIMILARITY
    return (p + q) * (n + m - odd) >= 2 * p * (n + m)


def _possible(n, i, m, j):
    """Whether texts of n and m shingles may be similar if the first that they share has places i and j."""
    p, q = SIMILARITY
    return (p + q) * np.minimum(n - i, m - j) >= p * (n + m)


def _distinct(docs: DataFrame) -> DataFrame:
    """h, text of the different texts of docs."""
    return docs.select(F.xxhash64(text_column()).alias("h"), text_column().alias("text")).groupBy("h").agg(F.first("text").alias("text"))


def _sets(texts: DataFrame) -> DataFrame:
    """h, text to h, own (the shingles)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t) for t in part.column(1).to_pylist()])], ["h", "own"])

    return texts.mapInArrow(run, "h long, own array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _each(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _common(docs: DataFrame) -> np.ndarray:
    some = docs.where(F.pmod(F.xxhash64(text_column()), F.lit(max(1, min(ONE_IN, docs.count() // SAMPLE)))) == 0)
    found = _sets(_distinct(some)).select(F.explode("own").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST)
    return np.sort(np.array([r.s for r in found.select("s").collect()], np.int64).view(np.uint64))


def prints(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, h, fp (SimHash of three-word shingles), wide (of the set of five-word ones), p0 to p3 (its parities), n (shingles of the set) and first (its prefix) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(2).to_pylist()
                own = [shingles(t) for t in texts]
                fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
                wide = np.array([_print(x[None])[0] if len(x) else 0 for x in own], np.uint64).view(np.int64)
                odd = np.array([parities(x) for x in own])
                columns = [part.column(0), part.column(1), *(pa.array(x) for x in (fp, wide, *odd.T.copy())), pa.array([len(x) for x in own], pa.int64()), _lists([prefix(x, held.value) for x in own])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "fp", "wide", *PARITIES, "n", "first"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column()).alias("h"), text_column().alias("text"))
    return own.mapInArrow(run, "doc_id long, h long, fp long, wide long, p0 long, p1 long, p2 long, p3 long, n long, first array<long>")


def _other_tokens(held) -> np.ndarray:
    return np.flatnonzero(held[0] != held[0][-1])


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    return starts, np.append(starts[1:], len(token))


def _shared(prefixes: DataFrame) -> DataFrame:
    """prefixes: token, place (shingles of the text, and the token's place among them), h. Tokens that two texts or more share, with size, the number of these."""

    def run(token, place, h):
        starts, ends = _runs(token)
        size = np.repeat(ends - starts, ends - starts)
        kept = size > 1
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (token, place, h, size)], ["token", "place", "h", "size"])

    rows = prefixes.repartition(shuffle_partitions(prefixes.sparkSession), "token").sortWithinPartitions("token").select("token", "place", "h")
    return rows.mapInArrow(by_node(run, _other_tokens, 3), "token long, place long, h long, size long")


def _headed(groups: DataFrame) -> DataFrame:
    """u, v: each text of a token with the one to compare it with first: of those whose lengths allow the similarity the most central one, whose own prefix is shared most.
    Of a group of copies that is the text they were made of rather than one of them."""
    p, q = SIMILARITY

    def run(token, central, h, place):
        starts, ends = _runs(token)
        n, i = place >> 32, place & 0xFFFFFFFF
        head = np.repeat(starts, ends - starts)
        rest = np.flatnonzero((n * p > n[head] * q) | (n[head] * p > n * q))
        while len(rest):  # those that are too long or too short for the first get a head among themselves
            first = np.concatenate(([True], token[rest][1:] != token[rest][:-1]))
            head[rest] = rest[np.maximum.accumulate(np.where(first, np.arange(len(rest)), 0))]
            rest = rest[(n[rest] * p > n[head[rest]] * q) | (n[head[rest]] * p > n[rest] * q)]
        good = np.flatnonzero((head != np.arange(len(h))) & _possible(n, i, n[head], i[head]))
        pairs = np.stack((h[good], h[head[good]]), 1)
        pairs = np.unique(np.sort(pairs, 1), axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    central = groups.groupBy("h").agg((-F.sum("size")).alias("central"))
    rows = groups.join(central, "h").repartition(shuffle_partitions(groups.sparkSession), "token").sortWithinPartitions("token", "central", "h")
    return rows.select("token", "central", "h", "place").mapInArrow(by_node(run, _other_tokens, 4), "u long, v long")


def _apart(groups: DataFrame) -> DataFrame:
    """u, v: pairs of texts of one token that may be similar and have different roots. groups: token, place, h, wide, PARITIES, root."""
    p, q = SIMILARITY

    def run(token, place, h, wide, root, *odd):
        # bits of signed numbers are counted without their sign
        wide, odd = wide.view(np.uint64), np.stack([x.view(np.uint64) for x in odd], 1)
        starts, ends = _runs(token)
        n, i = place >> 32, place & 0xFFFFFFFF
        us, vs = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if (root[a:b] == root[a]).all():
                continue
            last = a + np.searchsorted(n[a:b] * p, n[a:b] * q, side="right")
            for x, end in zip(range(a, b), last.tolist()):
                at = slice(x + 1, end)
                near = np.flatnonzero((root[at] != root[x]) & (np.bitwise_count(wide[at] ^ wide[x]) <= BITS) & _possible(n[x], i[x], n[at], i[at]))
                near = near[_sharing(n[x], n[at][near], np.bitwise_count(odd[at][near] ^ odd[x]).sum(1))]
                if len(near):
                    us.append(np.full(len(near), h[x]))
                    vs.append(h[at][near])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    rows = groups.repartition(shuffle_partitions(groups.sparkSession), "token").sortWithinPartitions("token", "place", "h").select("token", "place", "h", "wide", "root", *PARITIES)
    return rows.mapInArrow(by_node(run, _other_tokens, 5 + len(PARITIES)), "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, few: int = simhash.FEW) -> DataFrame:
    """The pairs u, v of text hashes that have the similarity. Only texts of pairs are looked at; up to few of their hashes are broadcast, more are joined in a shuffle."""

    def run(batches):
        for batch in batches:
            good = [alike(a, b) for a, b in zip(_each(batch.column(2)), _each(batch.column(3)))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()
    own = docs.select(F.xxhash64(text_column()).alias("h"), text_column().alias("text")).join(F.broadcast(keys) if 2 * pairs.count() <= few else keys, "h", "left_semi")
    sets = materialize(_sets(own.groupBy("h").agg(F.first("text").alias("text"))), "shingles")
    of = lambda c: sets.select(F.col("h").alias(c), F.col("own").alias("of_" + c))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long")


def roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, h (xxhash64 of the text) and more of every row of docs; and h, root of every text that is linked to one of a lesser h: others are their own roots."""
    rows = materialize(prints(docs, _common(docs)), "prints")
    texts = materialize(rows.groupBy("h").agg(F.first(F.struct("fp", "wide", *PARITIES, "n", "first")).alias("x")).select("h", "x.*"), "texts")
    # each text with the least of its component by SimHash
    linked = simhash.rooted(rows.select("doc_id", "fp")).select("fp", "root")
    linked = texts.select("h", "fp").join(linked, "fp").select("h", "root")
    linked = linked.join(linked.groupBy("root").agg(F.min("h").alias("v")), "root").where("h <> v").select(F.col("v").alias("u"), F.col("h").alias("v"))
    tokens = texts.select("h", "n", F.posexplode("first").alias("i", "token")).select("token", (F.shiftleft("n", 32) + F.col("i")).alias("place"), "h")
    groups = materialize(_shared(tokens), "groups")
    prints_of = texts.select("h", "n", "wide", *PARITIES)
    first = _headed(groups).unionByName(linked).distinct()
    of = lambda c: prints_of.select(F.col("h").alias(c), F.struct("n", "wide", *PARITIES).alias("of_" + c))
    far = lambda c: F.bit_count(F.col("of_u")[c].bitwiseXOR(F.col("of_v")[c]))
    near = (far("wide") <= BITS) & _sharing(F.col("of_u.n"), F.col("of_v.n"), sum((far(c) for c in PARITIES[1:]), far(PARITIES[0])))
    first = materialize(first.join(of("u"), "u").join(of("v"), "v").where(near).select("u", "v"), "pairs")
    found = components(_verified(first, docs), "links").withColumnRenamed("node", "h")
    nodes = prints_of.drop("n").join(found, "h", "left").withColumn("root", F.coalesce("component", "h")).drop("component")
    left = groups.where("size > 2").select("token", "place", "h").join(nodes, "h")
    more = _verified(_apart(left).distinct().join(first, ["u", "v"], "left_anti"), docs)
    links = found.select(F.col("h").alias("u"), F.col("component").alias("v")).unionByName(more)
    return rows, components(links, "links").select(F.col("node").alias("h"), F.col("component").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of linked texts, all columns: see simhash.kept_rows."""
    rows, found = roots(docs)
    return simhash.kept_rows(docs, rows.select("doc_id", "h").join(found, "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root")))
