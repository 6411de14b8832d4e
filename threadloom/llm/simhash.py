"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are the leaves of a trie of their bits. The join walks pairs of nodes of
equal depth downwards together, counts the bits in which the two paths differ, and drops
a pair as soon as that passes the error budget.

The walk starts below the root. Of four 16-bit blocks two are free of errors in any two
fingerprints that differ in at most two bits, so in one of the six tries that put two
blocks first such a pair meets in the very same node of depth 32; each of these nodes is
a task of its own. A node with more than ``HOT`` leaves is split in the same way over its
other 32 bits into nodes of depth 48, which hold 65,536 different leaves at most, whatever
the input. Copies share a leaf, and each node hands on a spanning forest of its links, not
all pairs.

Near copies with more differences are another module's, ``nearcopies``.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; null doc_ids get a component, whose id is the least id that isn't null in it (null if there is none);
repeated rows are returned as often as they came; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_node, materialize, shuffle_partitions, slices, text_column
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Leaves of one node that one task takes at once.
HOT = 20_000
#: Node pairs that are walked at once.
FRONT = 400_000
#: Rows of two numbers that are broadcast at most.
FEW = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    return fingerprint_of_words(words, shingle)


def fingerprint_of_words(words: list[bytes], shingle: int = SHINGLE) -> int:
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        total += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, extra: Column | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and extra, a long to carry along, of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), part.column(2)], ["doc_id", "fp", "extra"])

    extra = F.lit(None) if extra is None else extra
    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text"), extra.cast("long").alias("extra")).mapInArrow(run, "doc_id long, fp long, extra long")


def _fixed_first(code: str, block: int, bits: int) -> list[tuple[int, object]]:
    """Of four blocks of the last 4 * bits bits of a column, each pair first and the others after: (number, column)."""
    part = [F.shiftrightunsigned(F.col(code), bits * (3 - i)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(4)]
    out = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        rest = [x for x in range(4) if x not in (i, j)]
        joined = part[i]
        for x in (j, *rest):
            joined = F.shiftleft(joined, bits).bitwiseOR(part[x])
        out.append((k + block, joined))
    return out


def trie_nodes(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fp (distinct) to its six nodes: trie and fixed bits (node, sub), code (bits in the trie's order), fp."""
    wide = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("code")) for k, c in _fixed_first("fp", 0, 16)))).alias("x"))
    wide = wide.select("fp", "x.code", (F.shiftrightunsigned("x.code", 32) * 8 + F.col("x.k")).alias("node"))
    sizes = wide.groupBy("node").count().where(F.col("count") > hot).select("node", F.lit(1).alias("split"))
    both = wide.join(sizes, "node", "left")
    cool = both.where("split is null").select("node", F.lit(-1).cast("long").alias("sub"), "code", "fp")
    low = (1 << 32) - 1
    deep = both.where("split is not null").withColumn("low", F.col("code").bitwiseAND(F.lit(low)))
    deep = deep.select("node", "fp", F.shiftrightunsigned("code", 32).alias("high"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("low")) for k, c in _fixed_first("low", 0, 8)))).alias("x"))
    deep = deep.select("node", (F.shiftrightunsigned("x.low", 16) * 8 + F.col("x.k")).alias("sub"), F.shiftleft("high", 32).bitwiseOR(F.col("x.low")).alias("code"), "fp")
    return cool.unionByName(deep)


def walk(code: np.ndarray, start: np.ndarray, end: np.ndarray, free: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of leaves within radius. code: sorted within each node [start, end), whose leaves share all but their last free bits."""
    done_a, done_b = [], []
    keep = end - start > 1
    stack = [(free - 1, start[keep], end[keep], start[keep], end[keep], np.zeros(int(keep.sum()), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, al, ah, bl, bh, e = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack += [(bit, *(x[:half] for x in (al, ah, bl, bh, e))), (bit, *(x[half:] for x in (al, ah, bl, bh, e)))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = np.bitwise_count(code[a] ^ code[b]) <= radius
            done_a.append(a[near])
            done_b.append(b[near])
            al, ah, bl, bh, e = (x[~single] for x in (al, ah, bl, bh, e))
        if not len(al) or bit < 0:
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((code >> np.uint64(bit)) & np.uint64(1) == 0)))
        z = zeros[bit]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        own = al == bl
        cross = ~own
        parts = [
            (al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1),
            tuple(x[cross] for x in (am, ah, bl, bm, e + 1)),
        ]
        al, ah, bl, bh, e = (np.concatenate(x) for x in zip(*parts))
        keep = (ah > al) & (bh > bl) & (e <= radius) & ~((al == bl) & (ah - al == 1))
        stack.append((bit - 1, *(x[keep] for x in (al, ah, bl, bh, e))))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(done_a), join(done_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that is linked with each of n places."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def trie_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: a spanning forest of the links within each node."""

    def links(node, sub, code, fp):
        code, fp = code.view(np.uint64), fp
        starts = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (sub[1:] != sub[:-1]))))
        ends = np.concatenate((starts[1:], [len(node)]))
        deep = sub[starts] >= 0
        pairs = [walk(code, starts[k], ends[k], free, radius) for k, free in ((~deep, 32), (deep, 16)) if k.any()]
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        label = forest(len(node), a, b)
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["u", "v"])

    run = by_node(links, lambda x: np.flatnonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1])), 4)
    n = shuffle_partitions(nodes.sparkSession)
    return nodes.repartition(n, "node", "sub").sortWithinPartitions("node", "sub", "code").select("node", "sub", "code", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs. radius: 2 at most."""
    prints, linked = _rooted(docs, shingle, radius, hot, None)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """fp, least (doc_id) and root (least fingerprint of the component) of each fingerprint. prints: doc_id, fp."""
    if not 0 <= radius <= 2:
        raise ValueError("the six tries hold all pairs up to a radius of 2")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(trie_links(trie_nodes(distinct.select("fp"), hot), radius), "links")
    # a component is known by its least fingerprint until the least document of it is found
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def _rooted(docs: DataFrame, shingle: int, radius: int, hot: int, extra: Column | None) -> tuple[DataFrame, DataFrame]:
    prints = materialize(fingerprints(docs, shingle, extra), "fingerprints")
    return prints, materialize(rooted(prints, radius, hot), "roots")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component of fingerprints, all columns: see kept_rows."""
    prints, linked = _rooted(docs, shingle, radius, HOT, F.xxhash64(text_column()))
    return kept_rows(docs, prints.join(linked.select("fp", "root"), "fp").select("doc_id", F.col("extra").alias("h"), "root"))


def kept_rows(docs: DataFrame, rows: DataFrame, few: int = FEW) -> DataFrame:
    """One row of docs for each root, all columns: that of the least doc_id, of rows that share it the one with the least text hash; of a root
    without any doc_id the row with the least text hash. rows: doc_id, h (xxhash64 of the text), root of every row of docs.

    Up to few rows that go are broadcast, more meet the documents in a shuffle; the result is the same.
    """
    none = F.lit(-(2**63))
    counted = rows.groupBy(F.coalesce("doc_id", none).alias("_d"), F.col("h").alias("_h"), "root").agg(F.count("*").alias("n"))
    # by component, as one doc_id may stand on rows of several
    least = counted.groupBy("root").agg(F.min(F.struct((F.col("_d") == none).alias("none"), "_d", "_h")).alias("x")).select("root", F.col("x._d").alias("_d"), F.col("x._h").alias("_h"), F.lit(True).alias("stays"))
    marked = counted.join(least, ["root", "_d", "_h"], "left")
    # rows that repeat an id with its text and stay: all but one of them go
    marks = materialize(marked.where("stays is null or n > 1").select("_d", "_h", F.col("stays").isNotNull().alias("repeated")), "marks")
    own = docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), none)).withColumn("_h", F.xxhash64(text_column()))
    met = own.join(F.broadcast(marks) if marks.count() <= few else marks, ["_d", "_h"], "left")
    once = met.where("repeated").dropDuplicates(["_d", "_h"])
    return met.where("repeated is null").unionByName(once).select(*docs.columns)
