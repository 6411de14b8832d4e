"""Recall: neighbours of search hits, packed into a token budget and rendered as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, estimate_tokens
from .search import Filters, active, search_batch

BUDGET, LIMIT, RADIUS = 2400, 6, 1
#: Hits that are broadcast at most.
MAX_HITS = 10_000
HEADER = "Archived recall"
ADVICE = "\nTreat every block as a lead, not a fact."
START_COST = max(1, (len(HEADER + ADVICE) + 3) // 4)
LEAST_TOKENS = LEAST_CHARS = 120
_TURN = ("ordinal", "turn_id", "ts", "source", "human_text", "assistant_text", "full_text", "speaker_spans")


def neighbours(hits: DataFrame, segments: DataFrame, radius: int = RADIUS, bound: int | None = None) -> DataFrame:
    """hits (query_id, rank, RESULT) with turns: the active segments of the same conversation up to radius ordinals away, in order.
    bound: no more hits than that, if it is known."""
    near = active(segments).select(F.col("source").alias("_s"), F.col("conv_uuid").alias("_c"), F.struct(*_TURN).alias("_t"))
    if bound is not None and bound <= MAX_HITS:
        hits = F.broadcast(hits)
    on = (hits.source == near._s) & (hits.conv_uuid == near._c) & near["_t.ordinal"].between(hits.ordinal - radius, hits.ordinal + radius)
    return near.join(hits, on).groupBy(*hits.columns).agg(F.sort_array(F.collect_list("_t")).alias("turns"))


def _section(title: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"\n{title}:\n"), text)).otherwise("")


def _turn_lines(t: Column) -> Column:
    head = F.concat(F.lit("[turn "), t.ordinal.cast("string"), F.lit(" | "), t.ts, F.lit(" | "), t.turn_id, F.lit("]"))
    name = lambda s: F.coalesce(F.nullif(s.speaker_name, F.lit("")), F.nullif(s.speaker_id, F.lit("")), F.lit("speaker"))
    spoken = F.array_join(F.transform(F.filter(t.speaker_spans, lambda s: s.text != ""), lambda s: F.concat(F.lit("\n"), name(s), F.lit(":\n"), s.text)), "")
    said = F.when(F.coalesce(spoken, F.lit("")) != "", spoken).otherwise(F.when(t.full_text != "", F.concat(F.lit("\n"), t.full_text)).otherwise(""))
    return F.concat(head, F.when(t.source == "claude", F.concat(_section("Human", t.human_text), _section("Assistant", t.assistant_text))).otherwise(said))


def block(turns: Column, hit: dict[str, Column]) -> Column:
    """The text of one window."""
    as_of = F.coalesce(F.array_max(F.filter(F.transform(turns, lambda t: t.ts), lambda x: x != "")), hit["date"])
    return F.concat(
        F.lit("--- archived view as of "), as_of, F.lit("; treat as a lead, not a fact ---\nconversation: "), hit["conv_title"], F.lit(" ("), hit["conv_uuid"],
        F.lit(")\nmatched_turn: "), hit["turn_id"], F.lit(" score="), F.format_string("%.6f", hit["score"]), F.lit("\n"),
        F.array_join(F.transform(turns, _turn_lines), "\n"), F.lit("\n--- end archived view ---"),
    )


def trimmed(turns: Column, turn_id: Column, tokens: Column) -> Column:
    """The hit's turn alone, its texts clipped."""
    center = F.coalesce(F.get(F.filter(turns, lambda t: t.turn_id == turn_id), F.lit(0)), turns[0])
    chars = F.greatest(tokens * 4, F.lit(LEAST_CHARS))
    half = F.shiftright(chars, 1)
    own = center.source == "claude"
    none = F.array().cast("array<struct<speaker_id:string,speaker_name:string,text:string>>")
    human, assistant = F.when(own, clip(center.human_text, half)).otherwise(""), F.when(own, clip(center.assistant_text, half)).otherwise("")
    full = F.when(own, F.concat_ws("\n\n", F.nullif(human, F.lit("")), F.nullif(assistant, F.lit("")))).otherwise(clip(center.full_text, chars))
    spans = F.when(own, center.speaker_spans).otherwise(none)
    return F.array(F.struct(center.ordinal.alias("ordinal"), center.turn_id.alias("turn_id"), center.ts.alias("ts"), center.source.alias("source"), human.alias("human_text"), assistant.alias("assistant_text"), full.alias("full_text"), spans.alias("speaker_spans")))


def windows(hits: DataFrame, segments: DataFrame, budget: int = BUDGET, radius: int = RADIUS, bound: int | None = None) -> DataFrame:
    """query_id, rank, turn_id, turn_ids, cost, block, short_block, state (covered, packed, trimmed, skipped) of each hit's window.

    Hits that an accepted window before them covers are left out; the others are packed by
    rank as long as they fit; if the first doesn't, it is trimmed and packing ends.
    """
    near = neighbours(hits, segments, radius, bound)
    hit = {c: F.col(c) for c in ("date", "conv_title", "conv_uuid", "turn_id", "score")}
    short = trimmed(F.col("turns"), F.col("turn_id"), F.lit(max(budget - START_COST, LEAST_TOKENS)))
    near = near.withColumn("block", block(F.col("turns"), hit)).withColumn("short_block", block(short, hit)).withColumn("turn_ids", F.col("turns.turn_id"))
    near = near.withColumn("cost", estimate_tokens(F.col("block")))
    w = F.struct("rank", "turn_id", "turn_ids", "cost", "block", "short_block")
    per = near.groupBy("query_id").agg(F.sort_array(F.collect_list(w)).alias("w"))
    start = F.struct(
        F.lit(START_COST).alias("used"), F.lit(0).alias("packed"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("covered"), F.array().cast("array<string>").alias("states")
    )

    def step(acc, x):
        covered = F.array_contains(acc.covered, x.turn_id)
        fits = ~acc.ended & (acc.used + x.cost <= budget)
        trim = ~acc.ended & ~fits & (acc.packed == 0)
        state = F.when(covered, "covered").when(fits, "packed").when(trim, "trimmed").otherwise("skipped")
        return F.struct(
            F.when(~covered & fits, acc.used + x.cost).otherwise(acc.used).alias("used"),
            F.when(~covered & (fits | trim), acc.packed + 1).otherwise(acc.packed).alias("packed"),
            (acc.ended | (~covered & trim)).alias("ended"),
            F.when(covered, acc.covered).otherwise(F.array_union(acc.covered, x.turn_ids)).alias("covered"),
            F.concat(acc.states, F.array(state)).alias("states"),
        )

    folded = per.withColumn("states", F.aggregate("w", start, step).states)
    return folded.select("query_id", F.explode(F.arrays_zip("w", "states")).alias("x")).select("query_id", "x.w.*", F.col("x.states").alias("state"))


def recall_batch(segments: DataFrame, queries: list[tuple[str, str]], *, limit: int = LIMIT, token_budget: int = BUDGET, neighbor_radius: int = RADIUS, filters: Filters = Filters()) -> DataFrame:
    """query_id, block: the rendered recall of each query."""
    spark = segments.sparkSession
    hits = search_batch(segments, queries, limit, filters)
    kept = windows(hits, segments, token_budget, neighbor_radius, limit * len(queries) if limit >= 0 else None).where("state in ('packed', 'trimmed')")
    text = F.when(F.col("state") == "trimmed", F.col("short_block")).otherwise(F.col("block"))
    blocks = kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x.t), "\n\n").alias("found"))
    asked = spark.createDataFrame(queries, "query_id string, query string")
    head = F.concat(F.lit(f"{HEADER} for: "), F.col("query"), F.lit(ADVICE + "\n\n"))
    return asked.join(blocks, "query_id", "left").select("query_id", F.concat(head, F.coalesce("found", F.lit("No archived hits found."))).alias("block"))


def rehearse(segments: DataFrame, query: str, *, limit: int = LIMIT, token_budget: int = BUDGET, neighbor_radius: int = RADIUS, after=None, before=None, role=None, conv=None) -> str:
    filters = Filters(after, before, role, conv, None)
    return recall_batch(segments, [("q", query)], limit=limit, token_budget=token_budget, neighbor_radius=neighbor_radius, filters=filters).first().block
