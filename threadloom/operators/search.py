"""Substring search ranked by BM25 over all active segments.

Terms of three or more characters are case-folded phrases that must all occur; they are
counted with overlaps and ranked. Shorter terms must occur in the chosen text, with A-Z
folded only. Corpus statistics cover every active segment, whatever the filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_fold, fold, fold_term, occurrences, split_terms
from ..plans.scratch import materialize

K1, B = 1.2, 0.75
ROLES = {None: ("full_text", "turn"), "human": ("human_text", "human"), "assistant": ("assistant_text", "assistant")}
TEXTS = ("full_text", "human_text", "assistant_text")
RESULT = ("id", "turn_id", "conv_uuid", "conv_title", "date", "role", "text", "score", "source", "source_id", "ordinal")
#: Queries that share one scan.
BATCH = 64


@dataclass(frozen=True)
class Filters:
    after: str | None = None
    before: str | None = None
    role: str | None = None
    conv: str | None = None
    source: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.source:
            out &= F.col("source") == self.source
        if self.after:
            out &= F.col("ts") >= self.after
        if self.before:
            out &= F.col("ts") <= self.before
        if self.conv:
            out &= (F.col("conv_uuid") == self.conv) | F.contains(ascii_fold(F.col("conv_title")), F.lit(self.conv.translate(str.maketrans(UPPER, LOWER))))
        return out


def _check(query: str, role: str | None) -> None:
    if role not in ROLES:
        raise ValueError(f"role must be human or assistant, not {role!r}")
    if not query.split():
        raise ValueError("the query is blank")


def active(segments: DataFrame) -> DataFrame:
    return segments.where("active") if "active" in segments.columns else segments


def search_batch(segments: DataFrame, queries: list[tuple[str, str]], limit: int = 10, filters: Filters = Filters(), texts: bool = True) -> DataFrame:
    """query_id, rank and RESULT for each of (query_id, query); one scan for the statistics and one for the hits of each BATCH. No queries give no rows.

    texts=False: without text, by one scan for both, whose counts are written once.
    """
    for _, q in queries:
        _check(q, filters.role)
    parts = [_batch(active(segments), queries[i : i + BATCH], limit, filters, texts) for i in range(0, max(1, len(queries)), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def _batch(rows: DataFrame, queries: list[tuple[str, str]], limit: int, filters: Filters, texts: bool) -> DataFrame:
    column, role = ROLES[filters.role]
    split = {i: split_terms(q) for i, q in queries}
    terms = list(dict.fromkeys(fold_term(t) for long, _ in split.values() for t in long))
    brief = list(dict.fromkeys(t.translate(str.maketrans(UPPER, LOWER)) for _, short in split.values() for t in short))
    searched = [column] if filters.role else list(TEXTS)
    low = ascii_fold(F.col(column))
    counted = rows.withColumn("_in", F.array(*(F.contains(low, F.lit(t)) for t in brief)) if brief else F.lit(None).cast("array<boolean>"))
    result = [c for c in RESULT if texts or c != "text"]
    if terms:
        folded = counted.withColumns({f"_{c}": fold(F.col(c)) for c in searched})
        tf = [sum((occurrences(F.col(f"_{c}"), t) for c in searched[1:]), occurrences(F.col(f"_{searched[0]}"), t)) for t in terms]
        dl = sum((F.greatest(F.lit(0), F.length(c) - 2) for c in TEXTS[1:]), F.greatest(F.lit(0), F.length(TEXTS[0]) - 2))
        counted = folded.withColumn("_tf", F.array(*tf)).withColumn("_dl", dl)
        if not texts:
            counted = materialize(counted.select("id", "turn_id", "conv_uuid", "conv_title", "ts", "source", "source_id", "ordinal", "_in", "_tf", "_dl"), "counted")
        hits = [F.count_if(F.col("_tf")[k] > 0).alias(f"n{k}") for k in range(len(terms))]
        stats = counted.agg(F.count("*").alias("rows"), F.avg("_dl").alias("avgdl"), *hits).first()
        idf = []
        for k in range(len(terms)):
            n = stats[f"n{k}"]
            x = math.log((stats["rows"] - n + 0.5) / (n + 0.5)) if stats["rows"] else 0.0
            idf.append(x if x > 0 else 1e-6)
        length = K1 * (1 - B) + K1 * B * F.col("_dl") / float(stats["avgdl"] or 1.0)
    found = []
    for i, q in queries:
        long, short = split[i]
        ok, score = F.lit(True), F.lit(0.0)
        for t in long:
            k = terms.index(fold_term(t))
            n = F.col("_tf")[k]
            ok &= n > 0
            score += F.lit(idf[k]) * n * (K1 + 1) / (n + length)
        for t in short:
            ok &= F.col("_in")[brief.index(t.translate(str.maketrans(UPPER, LOWER)))]
        found.append(F.when(ok, F.struct(F.lit(i).alias("query_id"), score.alias("score"))))
    found = F.array(*found) if found else F.array().cast("array<struct<query_id:string,score:double>>")
    kept = counted.where(filters.condition()).withColumn("_hit", F.explode(F.filter(found, lambda x: x.isNotNull())))
    out = kept.select(
        F.col("_hit.query_id").alias("query_id"), "id", "turn_id", "conv_uuid", "conv_title", F.col("ts").alias("date"), F.lit(role).alias("role"),
        *([F.col(column).alias("text")] if texts else []), F.col("_hit.score").alias("score"), "source", "source_id", "ordinal",
    )
    # scores that differ by rounding only are ties
    order = [F.round("score", 9).desc(), F.desc("date"), F.asc("id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    out = out.withColumn("rank", rank)
    return (out if limit < 0 else out.where(F.col("rank") <= limit)).select("query_id", "rank", *result)


def search(segments: DataFrame, query: str, *, limit: int = 10, after=None, before=None, role=None, conv=None, source=None) -> DataFrame:
    """RESULT of one query, best first. limit below 0: all."""
    return search_batch(segments, [("q", query)], limit, Filters(after, before, role, conv, source)).drop("query_id").orderBy("rank")
