"""Best-fit packing of documents' token pieces into sequences, improved by local search.

A document's ids and its end id are cut into pieces of ``size`` at most. Pieces are dealt into
groups of about ``group`` (so a task's work is bounded, and a group leaves about one sequence less than
full); each group is packed best-fit by falling length. Then sequences that aren't full are emptied, the
least filled first: a piece moves to another sequence, is exchanged for a shorter one, or two are exchanged for one, each step
raising the sum of squared fills, until the sequence is empty or no step is left; where the
sequence itself allows none, steps between other underfull ones make room. The search ends
at the group's lower bound, or once ``TRIES`` sequences in a row can't be emptied; every piece is placed either way.

Defined results: a null or empty text is its end id alone; null and repeated doc_ids and repeated rows are packed row
by row (pieces of the same number may then occur several times for an id); no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_column
from .tokens import encoder

SIZE = 2048
GROUP = 16_384
#: Effort of the search: sequences in a row that can't be emptied, steps for each, and other sequences that a step may leave.
TRIES, STEPS, NEAR = 8, 50, 8
END = 0


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    bins: list[list[int]] = []
    spaces: list[int] = []  # sorted, those above zero
    by_space: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(spaces, n)
        if k == len(spaces):
            b, space = len(bins), size
            bins.append([])
        else:
            space = spaces[k]
            b = by_space[space].pop()
            if not by_space[space]:
                del spaces[k]
                del by_space[space]
        bins[b].append(int(i))
        if rest := space - n:
            if rest not in by_space:
                insort(spaces, rest)
                by_space[rest] = []
            by_space[rest].append(b)
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], size: int, tries: int = TRIES) -> list[list[int]]:
    """Empties bins that aren't full by moves and exchanges."""
    at = np.full(len(lengths), -1)
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    for k, b in enumerate(bins):
        at[b] = k
    bound = -(-int(lengths.sum()) // size)
    used, failed = int((fill > 0).sum()), 0
    given_up: set[int] = set()
    while used > bound and failed < tries:
        open_ = np.flatnonzero((fill > 0) & (fill < size))
        open_ = [k for k in open_ if k not in given_up]
        if len(open_) < 2:
            break
        k = int(min(open_, key=lambda b: (fill[b], b)))
        kept = at.copy(), fill.copy()
        for _ in range(STEPS):
            if not fill[k]:
                break
            # steps out of the bin itself, else between others that leave one of them more space
            near = sorted((b for b in np.flatnonzero((fill > 0) & (fill < size)).tolist() if b != k), key=lambda b: (fill[b], b))
            if not any(_step(lengths, at, fill, b, size) for b in (k, *near[:NEAR])):
                break
        if fill[k]:
            at, fill = kept  # exchanges that don't empty the bin are undone: they'd only crumble others' space
            given_up.add(k)
            failed += 1
        else:
            used, failed = used - 1, 0
    out: dict[int, list[int]] = {}
    for i, b in enumerate(at):
        out.setdefault(int(b), []).append(i)
    return list(out.values())


def _step(lengths, at, fill, k, size) -> bool:
    """One step that moves length from bin k into a fuller one; False if there is none."""
    own = np.flatnonzero(at == k)
    own = own[np.argsort(-lengths[own], kind="stable")]
    space = np.where((fill > 0), size - fill, 0)
    space[k] = 0
    order = np.argsort(space, kind="stable")
    ranked = space[order]
    for i in own:  # a move into the tightest space
        j = int(np.searchsorted(ranked, lengths[i]))
        if j < len(ranked):
            b = int(order[j])
            fill[b] += lengths[i]
            fill[k] -= lengths[i]
            at[i] = b
            return True
    other = np.flatnonzero((at != k) & (space[at] > 0) & (fill[at] >= fill[k]))
    best, step = 0, None
    for i in own:
        gain = lengths[i] - lengths[other]
        gain = np.where((gain > 0) & (gain <= space[at[other]]), gain, 0)
        if len(gain) and (g := int(gain.max())) > best:
            best, step = g, ((i,), other[int(gain.argmax())])
    for x in range(min(len(own), 24)):
        for y in range(x + 1, min(len(own), 24)):
            gain = lengths[own[x]] + lengths[own[y]] - lengths[other]
            gain = np.where((gain > 0) & (gain <= space[at[other]]), gain, 0)
            if len(gain) and (g := int(gain.max())) > best:
                best, step = g, ((own[x], own[y]), other[int(gain.argmax())])
    if step is None:
        return False
    items, j = step
    b = int(at[j])
    fill[b] += best
    fill[k] -= best
    at[list(items)] = b
    at[j] = k
    return True


def pack(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Lists of places, each of at most size in all."""
    if not len(lengths):
        return []
    return improve(lengths, best_fit(lengths, size), size)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text)."""

    def run(batches):
        own, end = encoder(tokenizer), END.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, x in zip(part.column(0).to_pylist(), own.encode_all(part.column(1).to_pylist())):
                    x += end
                    for k, at in enumerate(range(0, len(x), 4 * size)):
                        cut = x[at : at + 4 * size]
                        rows.append((d, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = materialize(pieces(docs, tokenizer, size), "pieces")
    groups = max(1, -(-cut.count() // group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        n = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k, items in enumerate(pack(n, size)):
            sequence[items] = (int(rows["bucket"].iat[0]) << 32) + k
            offset[items] = np.cumsum(n[items]) - n[items]
        return rows.drop(columns="bucket").assign(sequence_id=sequence, offset=offset)

    # numbers of rows in the written table deal out any repeated id evenly
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
