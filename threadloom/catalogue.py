"""Queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import estimate_tokens, fold_term, preview
from .operators import assemble, merge, recall
from .operators.evaluate import EvalCase, eval_results, recall_at_k
from .operators.search import Filters, search_batch
from .plans.scratch import materialize
from .plans.store import SCHEMA
from .sources.tabular import conversation_messages, document_segments, event_messages

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANKS = _WS.replace(r"\t-\r", r"\t\x0b-\r")


def _norm_sql(c: str) -> str:
    c = rf"regexp_replace(nfc_normalize({c}), '\r\n?', chr(10), 'g')"
    c = rf"regexp_replace({c}, '[{_BLANKS}]+(\n|\z)', '\1', 'g')"
    return f"regexp_replace({c}, '\\A[{_WS}]+|[{_WS}]+\\z', '', 'g')"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark, d, where=None, **kw):
    rows = _table(spark, d, "conversations")
    return conversation_messages(rows.where(where) if where else rows, **kw)


def _segments(spark, d, where=None, **kw):
    """Turns with id and arrival by conversation and ordinal."""
    return _placed(assemble.turns(_messages(spark, d, where, **kw)))


def _placed(turns: DataFrame) -> DataFrame:
    place = F.substring("conv_uuid", 2, 20).cast("long") * (1 << 32) + F.col("ordinal")
    return turns.withColumn("arrival", place).withColumn("id", place)


_TS = "strftime(timestamp '2026-01-01' + to_days(cast(conv_id as integer)) + to_seconds(turn), '%Y-%m-%dT%H:%M:%SZ')"


def _seg_sql(where: str = "true", text: str = "text", msg_id: str = "'m' || turn") -> str:
    return f"""msg as (
  select conv_id, 'c' || conv_id as conv_uuid, 'Conversation ' || conv_id as conv_title, turn as pos, {msg_id} as msg_id,
    case role when 'user' then 'human' else role end as sender, {_norm_sql(text)} as text, {_TS} as ts
  from conversations where {where}
), own as (
  select *, lag(sender) over (partition by conv_id order by pos) as before from msg where sender in ('human', 'assistant')
), placed as (
  select *, sum(case when before is null or (sender = 'human' and before = 'assistant') then 1 else 0 end) over (partition by conv_id order by pos) - 1 as ordinal from own
), said as (
  select conv_id, conv_uuid, conv_title, cast(ordinal as integer) as ordinal, min(ts) as ts,
    coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (sender = 'human' and text <> ''), '') as human_text,
    coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (sender = 'assistant' and text <> ''), '') as assistant_text,
    '[' || string_agg('["' || conv_uuid || '","' || msg_id || '"]', ',' order by pos) || ']' as source_msg_ids,
    count(*) as messages, count(*) filter (sender = 'assistant') as replies
  from placed group by conv_id, conv_uuid, conv_title, ordinal
), full_ as (
  select *, concat_ws(chr(10) || chr(10), nullif(human_text, ''), nullif(assistant_text, '')) as full_text from said
), seg as (
  select *, conv_id * 4294967296 + ordinal as id, sha256(source_msg_ids) as source_key, sha256(full_text) as content_hash,
    'turn_' || substr(sha256(source_msg_ids), 1, 24) as turn_id, 'claude' as source
  from full_
)"""


_DOC_SQL = """seg as (
  select doc_id as id, 'd' || doc_id as turn_id, source as conv_uuid, source as conv_title, '' as ts, 0 as ordinal, '' as human_text, '' as assistant_text,
    coalesce(text, '') as full_text, 'documents' as source from documents
)"""


def _hits_sql(seg: str, queries: list[tuple[str, str]], limit: int, role: str | None = None, where: str = "true", name: str = "hits") -> str:
    """CTEs that end in name: query_id, rank and the results. Terms must not overlap themselves."""
    column = f"{role}_text" if role else "full_text"
    searched = [column] if role else ["full_text", "human_text", "assistant_text"]
    ctes, parts = [seg], []
    terms = list(dict.fromkeys(fold_term(t) for _, q in queries for t in q.split() if len(t) >= 3))
    count = lambda t: " + ".join(f"cast((length({c}) - length(replace(lower({c}), '{t}', ''))) / {len(t)} as bigint)" for c in searched)
    tf = "".join(f", {count(t)} as tf{k}" for k, t in enumerate(terms))
    ctes.append(f"counted as (select *, greatest(0, length(full_text) - 2) + greatest(0, length(human_text) - 2) + greatest(0, length(assistant_text) - 2) as dl{tf} from seg)")
    stats = "".join(f", count(*) filter (tf{k} > 0) as n{k}" for k in range(len(terms)))
    ctes.append(f"stats as (select count(*) as n, avg(dl) as avgdl{stats} from counted)")
    for i, q in queries:
        ok, score = [where], ["0.0"]
        for t in q.split():
            if len(t) < 3:
                ok.append(f"contains(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t.lower()}')")
                continue
            k = terms.index(fold_term(t))
            idf = f"ln((n - n{k} + 0.5) / (n{k} + 0.5))"
            score.append(f"(case when {idf} > 0 then {idf} else 1e-6 end) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
            ok.append(f"tf{k} > 0")
        parts.append(f"select '{i}' as query_id, id, turn_id, conv_uuid, conv_title, ts as date, {column} as text, cast({' + '.join(score)} as double) as score, source, ordinal from counted, stats where {' and '.join(ok)}")
    ctes.append(f"found as ({' union all '.join(parts)})")
    ctes.append(f"{name} as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, date desc, id) as rank from found) where rank <= {limit})")
    return ",\n".join(ctes)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "turn_id", "conv_uuid", "conv_title", "date", "role", "text", F.round("score", 6).alias("score"), "ordinal")


def _search(queries, limit=10, filters=Filters(), source=_segments):
    return lambda spark, d: _shown(search_batch(source(spark, d), queries, limit, filters))


def _search_sql(queries, limit=10, role=None, where="true", seg=None):
    shown = role or "turn"
    return f"with {_hits_sql(seg or _seg_sql(), queries, limit, role, where)}\nselect query_id, cast(rank as integer) as rank, turn_id, conv_uuid, conv_title, date, '{shown}' as role, text, round(score, 6) as score, ordinal from hits"


def _documents(spark, d):
    return document_segments(_table(spark, d, "documents"))


_TURN_COLUMNS = ("conv_uuid", "ordinal", "ts", "human_text", "assistant_text", "full_text")
_RUNS = "not (role = 'assistant' and turn % 3 = 0) and not (conv_id % 5 = 0 and turn = 0)"
_BATCH = [("a", "tion"), ("b", "ing the"), ("c", "reon"), ("d", "with"), ("e", "th and")]
_RECALL = [("a", "tion"), ("b", "ing the"), ("c", "nosuchterm")]


def turns_query(where=None, columns=_TURN_COLUMNS):
    return lambda spark, d: _segments(spark, d, where).select(*columns)


def messages_normalized(spark, d):
    return _messages(spark, d).where("sender in ('human', 'assistant')").select("conv_uuid", F.col("pos").cast("int").alias("pos"), "msg_id", "sender", "text", "ts")


def segments_sessionized(spark, d):
    out = assemble.session_digests(event_messages(_table(spark, d, "events")))
    return out.select("conv_uuid", "ordinal", "ts_start", "ts_end", "messages", "turn_id", "content_hash", F.array_join("participants", ",").alias("participants"))


def speaker_spans(spark, d):
    out = assemble.spans(assemble.session_ordinals(event_messages(_table(spark, d, "events"))))
    return out.select("conv_uuid", "ordinal", "span", "speaker_id", "speaker_name", "text", F.size("msgs").alias("messages"))


def kind_mapping(spark, d):
    return event_messages(_table(spark, d, "events")).groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def neighbor_windows(spark, d):
    seg = _segments(spark, d)
    near = recall.neighbours(search_batch(seg, _RECALL, 6), seg, bound=6 * len(_RECALL))
    return near.select("query_id", "rank", "turn_id", F.array_join(F.transform("turns.ordinal", lambda x: x.cast("string")), ",").alias("ordinals"), F.array_join("turns.turn_id", ",").alias("turn_ids"))


def recall_packed(spark, d):
    seg = _segments(spark, d)
    return recall.windows(search_batch(seg, _RECALL, 6), seg, 600, bound=6 * len(_RECALL)).select("query_id", "rank", "turn_id", "cost", "state")


def recall_block(spark, d):
    return recall.recall_batch(_segments(spark, d), _RECALL, token_budget=600)


def recall_trimmed(spark, d):
    return recall.recall_batch(_segments(spark, d), _RECALL, token_budget=130)


def _cases(spark, d):
    rows = [("tion", "c1", 0, 5), ("ing the", "c2", 1, 10), ("reon", "c3", 0, 10), ("with", "c4", 1, 10), ("th and", "c0", 0, 3)]
    import hashlib
    import json

    out = []
    for q, c, o, k in rows:
        ids = json.dumps([[c, f"m{2 * o + 1}"], [c, f"m{2 * o + 2}"]], separators=(",", ":"))
        out.append((EvalCase(q, ("turn_" + hashlib.sha256(ids.encode()).hexdigest()[:24],), k), ids))
    return out


def eval_recall_at_k(spark, d):
    return recall_at_k(eval_results(_segments(spark, d), [c for c, _ in _cases(spark, d)]))


def eval_misses(spark, d):
    return eval_results(_segments(spark, d), [c for c, _ in _cases(spark, d)]).where("not hit").select("case", "query", "k", F.size("returned").alias("returned"), F.array_join("expected", ",").alias("expected"))


def _eval_sql(tail: str) -> str:
    cases = _cases(None, None)
    hits = _hits_sql(_seg_sql(), [(str(i), c.query) for i, (c, _) in enumerate(cases)], 10)
    rows = ", ".join(f"({i}, '{c.query}', {c.k}, '{c.expected_turn_ids[0]}')" for i, (c, _) in enumerate(cases))
    return f"""with {hits},
cases("case", query, k, expected) as (values {rows}),
judged as (select "case", query, k, expected, coalesce(bool_or(turn_id = expected), false) as hit, count(turn_id) as returned
  from cases left join hits on query_id = cast("case" as varchar) and rank <= k group by all)
{tail}"""


def _loaded(spark, d, *versions):
    rows = spark.createDataFrame([], SCHEMA)
    for v in versions:
        rows, actions = merge.upsert(rows, _segments(spark, d, **v).drop("id"))
        rows = materialize(rows, "segments")
    return rows, actions


def _edit():
    return {"text": F.expr("if(conv_id % 7 = 0, concat(text, ' edited'), text)")}


def _regenerated():
    return {"msg_id": F.expr("if(conv_id % 5 = 0 and role = 'assistant', concat('x', cast(turn as string)), concat('m', cast(turn as string)))")}


def _counts(*versions):
    def run(spark, d):
        """The last load's actions; what it would write isn't needed."""
        *before, last = (v() for v in versions)
        stored = _loaded(spark, d, *before)[0] if before else spark.createDataFrame([], SCHEMA)
        return merge.action_counts(merge.decide(materialize(_segments(spark, d, **last), "incoming"), stored.where("active")))

    return run


def index_supersede_late_reply(spark, d):
    """Conversations whose last reply comes with the second load only."""
    rows = _table(spark, d, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    early = rows.join(last, "conv_id").where("not (turn = last and role = 'assistant')").drop("last")
    stored, _ = merge.upsert(spark.createDataFrame([], SCHEMA), _placed(assemble.turns(conversation_messages(early))).drop("id"))
    stored = materialize(stored, "segments")
    return merge.action_counts(merge.decide(materialize(_segments(spark, d), "incoming"), stored.where("active")))


def status_summary(spark, d):
    return merge.status(_loaded(spark, d, {}, _edit())[0])


def supersede_lineage(spark, d):
    return merge.lineage(_loaded(spark, d, {}, _edit())[0]).select("turn_id", "new_turn_id", "new_active", (F.col("content_hash") != F.col("new_hash")).alias("changed"), (F.col("superseded_by") > F.col("id")).alias("later"))


def supersede_regenerated(spark, d):
    rows = merge.lineage(_loaded(spark, d, {}, _regenerated())[0])
    return rows.select("conv_uuid", "ordinal", "turn_id", "new_turn_id", "new_active")


def result_preview(spark, d):
    return _segments(spark, d).select("turn_id", preview(F.col("full_text")).alias("preview"))


def token_estimate(spark, d):
    return _table(spark, d, "documents").select("doc_id", estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


_EVENTS_SQL = """ev as (
  select event_type as conv_uuid, event_id, 'u' || user_id as sender, 'value ' || cast(floor(value) as bigint) as text,
    cast(epoch(date_trunc('second', ts)) as bigint) as ep, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as iso from events
), gaps as (
  select *, lag(ep) over (partition by conv_uuid order by ep, event_id) as prev from ev
), numbered as (
  select *, cast(sum(case when ep - prev > 300 then 1 else 0 end) over (partition by conv_uuid order by ep, event_id) as integer) as ordinal from gaps
), turned as (
  select *, lag(sender) over (partition by conv_uuid, ordinal order by ep, event_id) as last from numbered
), spanned as (
  select *, cast(sum(case when last is not null and last <> sender then 1 else 0 end) over (partition by conv_uuid, ordinal order by ep, event_id) as integer) as span from turned
)"""

_SEARCH = {
    "search_long_bm25": ([("q", "tion")], {}),
    "search_role_human": ([("q", "with")], {"role": "human"}),
    "search_role_assistant": ([("q", "tion ing")], {"role": "assistant"}),
    "search_short_like": ([("q", "TI wh")], {}),
    "search_mixed_terms": ([("q", "tion wh")], {}),
    "search_multi_batch": (_BATCH, {}),
}
QUERIES = {name: _search(q, 10, Filters(**f)) for name, (q, f) in _SEARCH.items()}
ORACLE_SQL = {name: _search_sql(q, 10, f.get("role")) for name, (q, f) in _SEARCH.items()}

QUERIES |= {
    "search_documents_bm25": _search([("q", "rewh tion")], 10, source=_documents),
    "search_filters": _search([("q", "tion")], 10, Filters(after="2026-01-03", before="2026-02-20", conv="conversation 1", source="claude")),
    "messages_normalized": messages_normalized,
    "turns_assembled": turns_query(),
    "turns_assembled_runs": turns_query(_RUNS),
    "turn_identity": turns_query(columns=("turn_id", "source_key", "content_hash", "source_msg_ids", "conv_uuid", "ordinal")),
    "segments_sessionized": segments_sessionized,
    "speaker_spans": speaker_spans,
    "kind_mapping": kind_mapping,
    "neighbor_windows": neighbor_windows,
    "recall_packed": recall_packed,
    "recall_block": recall_block,
    "recall_trimmed": recall_trimmed,
    "eval_recall_at_k": eval_recall_at_k,
    "eval_misses": eval_misses,
    "index_first_load": _counts(dict),
    "index_reload_noop": _counts(dict, dict),
    "index_supersede_edit": _counts(dict, _edit),
    "index_supersede_overlap": _counts(dict, _regenerated),
    "index_supersede_late_reply": index_supersede_late_reply,
    "status_summary": status_summary,
    "supersede_lineage": supersede_lineage,
    "supersede_regenerated": supersede_regenerated,
    "result_preview": result_preview,
    "token_estimate": token_estimate,
}


def _turn_sql(human: str, assistant: str) -> str:
    section = lambda c, t: f"case when {c} <> '' then chr(10) || '{t}:' || chr(10) || {c} else '' end"
    return f"'[turn ' || s.ordinal || ' | ' || s.ts || ' | ' || s.turn_id || ']' || {section(human, 'Human')} || {section(assistant, 'Assistant')}"


def _window_sql(as_of: str, body: str) -> str:
    return f"""'--- archived view as of ' || {as_of} || '; treat as a lead, not a fact ---' || chr(10) || 'conversation: ' || title || ' (' || conv_uuid || ')' || chr(10)
    || 'matched_turn: ' || turn_id || ' score=' || printf('%.6f', score) || chr(10) || {body} || chr(10) || '--- end archived view ---'"""


def _clip_sql(c: str, most: int) -> str:
    return rf"case when length({c}) <= {most} then {c} else regexp_replace(substr({c}, 1, {max(0, most - 20)}), '[{_WS}]+\z', '') || chr(10) || '[truncated]' end"


def _block_sql(budget: int = 600) -> str:
    """One text for each window of near(query_id, rank, hit, turns): header, turns, end; and one of the hit's turn alone, clipped."""
    half = max(max(budget - recall.START_COST, recall.LEAST_TOKENS) * 4, recall.LEAST_CHARS) // 2
    short = _turn_sql(_clip_sql("s.human_text", half), _clip_sql("s.assistant_text", half))
    return f"""near as (
  select h.query_id, h.rank, h.turn_id, any_value(h.date) as date, any_value(h.conv_title) as title, any_value(h.conv_uuid) as conv_uuid, any_value(h.score) as score,
    max(s.ts) as as_of, list(s.turn_id order by s.ordinal, s.turn_id) as turn_ids, list(s.ordinal order by s.ordinal, s.turn_id) as ordinals,
    string_agg({_turn_sql('s.human_text', 's.assistant_text')}, chr(10) order by s.ordinal, s.turn_id) as body,
    string_agg({short}, '') filter (s.turn_id = h.turn_id) as short, max(s.ts) filter (s.turn_id = h.turn_id) as short_as_of
  from hits h join seg s on h.conv_uuid = s.conv_uuid and s.ordinal between h.ordinal - 1 and h.ordinal + 1 group by h.query_id, h.rank, h.turn_id
), win as (
  select *, {_window_sql('as_of', 'body')} as block, {_window_sql('short_as_of', 'short')} as short_block from near
), costed as (
  select *, greatest(1, (length(block) + 3) // 4) as cost, row_number() over (partition by query_id order by rank) as k from win
)"""


def _packed_sql(budget: int) -> str:
    return f"""walked as (
  select query_id, cast(0 as bigint) as k, cast(null as bigint) as rank, cast(null as varchar) as turn_id, cast(14 as bigint) as used, 0 as packed, false as over, cast([] as varchar[]) as covered, cast(null as bigint) as cost, 'start' as state
  from (select distinct query_id from costed)
  union all
  select w.query_id, c.k, c.rank, c.turn_id,
    case when list_contains(w.covered, c.turn_id) or w.over or w.used + c.cost > {budget} then w.used else w.used + c.cost end,
    case when list_contains(w.covered, c.turn_id) or w.over or (w.used + c.cost > {budget} and w.packed > 0) then w.packed else w.packed + 1 end,
    w.over or (not list_contains(w.covered, c.turn_id) and w.used + c.cost > {budget} and w.packed = 0),
    case when list_contains(w.covered, c.turn_id) then w.covered else list_concat(w.covered, c.turn_ids) end,
    c.cost,
    case when list_contains(w.covered, c.turn_id) then 'covered' when not w.over and w.used + c.cost <= {budget} then 'packed' when not w.over and w.packed = 0 then 'trimmed' else 'skipped' end
  from walked w join costed c on w.query_id = c.query_id and c.k = w.k + 1
)"""


_RECALL_HITS = _hits_sql(_seg_sql(), _RECALL, 6)
_N = "cast(count(*) as bigint)"
_EDITED = "count(*) filter (conv_id % 7 = 0)"
_REGEN = "count(*) filter (conv_id % 5 = 0 and replies > 0)"
_HEAD = "'Archived recall for: ' || q.query || chr(10) || 'Treat every block as a lead, not a fact.' || chr(10) || chr(10)"
_ASKED = "asked(query_id, query) as (values " + ", ".join(f"('{i}', '{q}')" for i, q in _RECALL) + ")"


def _recall_sql(budget: int) -> str:
    shown = "string_agg(case state when 'packed' then block else short_block end, chr(10) || chr(10) order by w.k)"
    return f"""with recursive {_RECALL_HITS},\n{_block_sql(budget)},\n{_packed_sql(budget)},\n{_ASKED},
kept as (select w.query_id, {shown} as body from walked w join costed c on w.query_id = c.query_id and w.k = c.k where state in ('packed', 'trimmed') group by 1)
select q.query_id, {_HEAD} || coalesce(body, 'No archived hits found.') as block from asked q left join kept using (query_id)"""


ORACLE_SQL |= {
    "search_documents_bm25": _search_sql([("q", "rewh tion")], 10, seg=_DOC_SQL),
    "search_filters": _search_sql([("q", "tion")], 10, where="ts >= '2026-01-03' and ts <= '2026-02-20' and contains(lower(conv_title), 'conversation 1') and source = 'claude'"),
    "messages_normalized": f"with {_seg_sql()} select conv_uuid, cast(pos as integer) as pos, msg_id, sender, text, ts from own",
    "turns_assembled": f"with {_seg_sql()} select {', '.join(_TURN_COLUMNS)} from seg",
    "turns_assembled_runs": f"with {_seg_sql(_RUNS)} select {', '.join(_TURN_COLUMNS)} from seg",
    "turn_identity": f"with {_seg_sql()} select turn_id, source_key, content_hash, source_msg_ids, conv_uuid, ordinal from seg",
    "segments_sessionized": f"""with {_EVENTS_SQL}, texts as (
  select conv_uuid, ordinal, min(ep) as a, min(iso) as ts_start, max(iso) as ts_end, cast(count(*) as integer) as messages, string_agg(text, chr(10) || chr(10) order by ep, event_id) as body,
    '[' || string_agg('["' || conv_uuid || '","e' || event_id || '"]', ',' order by ep, event_id) || ']' as ids from spanned group by conv_uuid, ordinal
), firsts as (select conv_uuid, ordinal, sender, min((ep, event_id)) as f from spanned group by all),
people as (select conv_uuid, ordinal, string_agg(sender, ',' order by f) as participants from firsts group by all)
select t.conv_uuid, t.ordinal, ts_start, ts_end, messages, 'turn_' || substr(sha256(ids), 1, 24) as turn_id, sha256(body) as content_hash, participants from texts t join people p on t.conv_uuid = p.conv_uuid and t.ordinal = p.ordinal""",
    "speaker_spans": f"with {_EVENTS_SQL} select conv_uuid, ordinal, span, sender as speaker_id, sender as speaker_name, string_agg(text, chr(10) || chr(10) order by ep, event_id) as text, cast(count(*) as integer) as messages from spanned group by conv_uuid, ordinal, span, sender",
    "kind_mapping": f"with {_EVENTS_SQL}, c as (select iso, cast(floor(value) as bigint) % 100 as code from events join ev using (event_id)) select case code when 80 then 'system' when 7 then 'rich' when 4 then 'file' when 25 then 'reply' when 99 then 'transfer' else 'text' end as kind, {_N} as n, min(iso) as first_ts from c group by 1",
    "neighbor_windows": f"with {_RECALL_HITS},\n{_block_sql()}\nselect query_id, cast(rank as integer) as rank, turn_id, array_to_string(ordinals, ',') as ordinals, array_to_string(turn_ids, ',') as turn_ids from near",
    "recall_packed": f"with recursive {_RECALL_HITS},\n{_block_sql()},\n{_packed_sql(600)}\nselect query_id, cast(rank as integer) as rank, turn_id, cast(cost as integer) as cost, state from walked where k > 0",
    "recall_block": _recall_sql(600),
    "recall_trimmed": _recall_sql(130),
    "eval_recall_at_k": _eval_sql("select count(*) as cases, count(*) filter (hit) as hits, avg(case when hit then 1.0 else 0.0 end) as recall_at_k from judged"),
    "eval_misses": _eval_sql('select cast("case" as integer) as "case", query, k, cast(returned as integer) as returned, expected from judged where not hit'),
    "index_first_load": f"with {_seg_sql()} select {_N} as turns_seen, {_N} as appended, cast(0 as bigint) as skipped, cast(0 as bigint) as superseded from seg",
    "index_reload_noop": f"with {_seg_sql()} select {_N} as turns_seen, cast(0 as bigint) as appended, {_N} as skipped, cast(0 as bigint) as superseded from seg",
    "index_supersede_edit": f"with {_seg_sql()} select {_N} as turns_seen, cast(0 as bigint) as appended, {_N} - {_EDITED} as skipped, {_EDITED} as superseded from seg",
    "index_supersede_overlap": f"with {_seg_sql()} select {_N} as turns_seen, {_REGEN.replace('replies > 0', 'replies = messages')} as appended, {_N} - {_REGEN} as skipped, {_REGEN.replace('replies > 0', 'replies > 0 and replies < messages')} as superseded from seg",
    "index_supersede_late_reply": f"""with {_seg_sql()}, ends as (select conv_id, arg_max(role, turn) as role from conversations group by 1),
tail as (select messages, role = 'assistant' and row_number() over (partition by conv_id order by ordinal desc) = 1 as late from seg join ends using (conv_id))
select {_N} as turns_seen, count(*) filter (late and messages = 1) as appended, count(*) filter (not late) as skipped, count(*) filter (late and messages > 1) as superseded from tail""",
    "status_summary": f"with {_seg_sql()} select {_N} + {_EDITED} as rows_total, {_N} as active_turns, {_EDITED} as superseded_turns, count(distinct conv_uuid) as conversations, cast(1 as bigint) as sources from seg",
    "supersede_lineage": f"with {_seg_sql()} select turn_id, turn_id as new_turn_id, true as new_active, true as changed, true as later from seg where conv_id % 7 = 0",
    "supersede_regenerated": f"""with {_seg_sql()}, again as (select conv_id, ordinal, 'turn_' || substr(sha256('[' || string_agg('["' || conv_uuid || '","' || case when sender = 'assistant' then 'x' else 'm' end || pos || '"]', ',' order by pos) || ']'), 1, 24) as new_turn_id from placed group by all)
select conv_uuid, seg.ordinal, turn_id, new_turn_id, true as new_active from seg join again on seg.conv_id = again.conv_id and seg.ordinal = again.ordinal where seg.conv_id % 5 = 0 and replies > 0 and replies < messages""",
    "result_preview": f"with {_seg_sql()}, p as (select turn_id, replace(full_text, chr(10), ' ') as t from seg) select turn_id, case when length(t) > 300 then substr(t, 1, 297) || '...' else t end as preview from p",
    "token_estimate": "select doc_id, cast(greatest(1, (length(coalesce(text, '')) + 3) // 4) as integer) as tokens from documents",
}
