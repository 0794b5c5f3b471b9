"""Queries over sources and normalisers: conversations written as records of each layout, read and normalized again.

The records of a layout are made from the given tables, in its own shape; what the sources and normalisers make of
them is compared with statements over the given tables.
"""

import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import aggregates, facets, joins, records
from tracemill.plans.registry import query, table
from tracemill.sources import jsonl, sqlite, store


def _id() -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))


def _stamp() -> Column:
    return F.concat(F.lit("2025-01-01T00:0"), F.col("turn").cast("string"), F.lit(":00Z"))


def _named(base: str) -> Column:
    """A text with the turn's id, as in ``call-7-1``."""
    return F.concat(F.lit(base), _id())


def _lines(turns: DataFrame, file: Column, made: list[tuple[int, Column | None, Column]]) -> DataFrame:
    """Log lines (file, block_start, position, value): of each turn those whose condition holds, by number."""
    listed = F.array(*(F.when(fine if fine is not None else F.lit(True), F.struct(F.lit(k).alias("k"), value.alias("value"))) for k, fine, value in made))
    rows = turns.select(file.alias("file"), F.col("turn"), F.explode(F.array_compact(listed)).alias("x"))
    return rows.select("file", F.lit(0).alias("block_start"), (F.col("turn") * 100 + F.col("x.k")).alias("position"), "x.value")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as project-tree logs, every fourth a sub-agent's, with all that such logs hold besides."""
    turn, role, text, lit = F.col("turn"), F.col("role"), F.col("text"), F.lit
    sub = F.col("conv_id") % 4 == 1
    folder = F.concat(lit("/logs/proj-"), (F.floor(F.col("conv_id") / 4) % 5).cast("string"), lit("/"))
    file = F.when(sub, F.concat(folder, (F.col("conv_id") - 1).cast("string"), lit("/subagents/agent-"), F.col("conv_id").cast("string"), lit(".jsonl"))).otherwise(F.concat(folder, F.col("conv_id").cast("string"), lit(".jsonl")))
    common = {"uuid": _named("u-"), "timestamp": _stamp(), "cwd": F.concat(lit("/w/"), (F.col("conv_id") % 5).cast("string")), "gitBranch": F.concat(lit("b"), turn.cast("string")), "version": lit("1.0")}
    spoken = F.when(turn % 5 == 2, F.concat(lit("<system-reminder>"), text)).otherwise(text)
    block = lambda kind, **more: F.to_variant_object(F.struct(lit(kind).alias("type"), *(c.alias(n) for n, c in more.items())))
    reply = F.array(
        block("thinking", thinking=_named("hm ")), block("text", text=text), block("tool_use", id=_named("call-"), name=lit("Bash"), input=F.struct(_named("run ").alias("command"))), block("text", text=_named("done ")),
    )
    answer = F.array(block("tool_result", tool_use_id=_named("call-"), content=F.array(F.struct(lit("text").alias("type"), _named("out ").alias("text"))), is_error=turn % 4 == 3))
    message = lambda who, content, **more: F.struct(lit(who).alias("role"), content.alias("content"), *(c.alias(n) for n, c in more.items()))
    usage = F.struct((turn + 1).alias("input_tokens"), lit(7).alias("output_tokens"))
    made = [
        (0, turn == 0, lit("  ")), (1, turn == 0, lit("{broken")), (2, None, lit('{"type":"api-request","x":1}')),
        (3, None, _json(type=lit("api-request-blob"), hash=_named("h"), message=message("user", text))),
        (4, turn == 0, _json(type=lit("api-request-blob"), hash=lit("e"), message=message("system", F.concat(lit("# Environment\ncwd: "), F.col("conv_id").cast("string"))))),
        (5, turn % 2 == 0, _json(type=lit("api-request-shape"), timestamp=_stamp(), shape=F.struct(F.concat(lit("S"), F.floor(turn / 4).cast("string")).alias("system"), F.array(F.struct(lit("Bash").alias("name"))).alias("tools")))),
        (6, role == "user", _json(type=lit("user"), **common, message=message("user", spoken))),
        (7, role == "assistant", _json(type=lit("assistant"), **common, message=message("assistant", reply, model=lit("m-one"), usage=usage))),
        (8, role == "assistant", _json(type=lit("user"), uuid=_named("r-"), timestamp=_stamp(), message=message("user", answer))),
        (9, role == "system", _json(type=lit("system"), **common, subtype=lit("compact_boundary"), content=text, compactMetadata=F.struct(lit("auto").alias("trigger"), (turn + 100).alias("preTokens")))),
        (10, turn % 3 == 1, _json(type=lit("attachment"), timestamp=_stamp(), attachment=F.struct(lit("queued_command").alias("type"), F.when(turn % 2 == 0, "<task-notification>x").otherwise(_named("queued ")).alias("prompt")))),
        (11, turn % 3 == 2, _json(type=lit("attachment"), timestamp=_stamp(), attachment=F.struct(lit("deferred_tools_delta").alias("type"), F.array(lit("a"), lit("b")).alias("addedNames")))),
        (12, turn == 1, _json(type=lit("pr-link"), prUrl=F.when(F.col("conv_id") % 2 == 0, "https://x.test/1").otherwise("javascript:1"), prRepository=lit("r"))),
        (13, turn == 2, _json(type=lit("strange"), timestamp=_stamp())), (14, turn == 2, _json(type=lit("mode"))), (15, turn == 2, _json(type=lit("custom-title"), customTitle=_named("title "))),
    ]
    return _lines(_turns(spark, sf_dir), file, made)


#: The records of those logs that are kept, numbered, in SQL.
_TREE = """
rec AS (
  SELECT conv_id, turn, role, text, k, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq
  FROM conversations, (SELECT unnest([4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]) AS k)
  WHERE (k = 4 AND turn = 0) OR (k = 5 AND turn % 2 = 0) OR (k = 6 AND role = 'user') OR (k IN (7, 8) AND role = 'assistant') OR (k = 9 AND role = 'system')
     OR (k = 10 AND turn % 3 = 1) OR (k = 11 AND turn % 3 = 2) OR (k = 12 AND turn = 1) OR (k IN (13, 14, 15) AND turn = 2)
),
keyed AS (SELECT *, CASE WHEN conv_id % 4 = 1 THEN 'agent-' ELSE '' END || conv_id AS session_key FROM rec)
"""


@query(f"""
WITH {_TREE},
prompts AS (SELECT session_key, conv_id, turn // 4 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM keyed WHERE k = 5 AND (turn % 4 = 0 OR NOT EXISTS (SELECT 1 FROM keyed x WHERE x.conv_id = keyed.conv_id AND x.k = 5 AND x.turn = keyed.turn - 2)))
SELECT session_key, -1::BIGINT AS seq, CASE WHEN n = 1 THEN 0 ELSE n END::BIGINT AS block, 'instructions' AS kind, CASE WHEN n = 1 THEN 'System prompt' ELSE 'System prompt (updated)' END AS label,
       'S' || s || chr(10) || chr(10) || '— Tools (1): Bash' AS text, NULL AS name, NULL AS call_id, NULL AS result, NULL::BOOLEAN AS is_error, NULL AS detail FROM prompts
UNION ALL SELECT session_key, -1, 1, 'instructions', 'Environment', '# Environment' || chr(10) || 'cwd: ' || conv_id, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 4
UNION ALL SELECT session_key, seq, 0, CASE WHEN turn % 5 = 2 THEN 'notice' ELSE 'user' END, CASE WHEN turn % 5 = 2 THEN 'System reminder' END, CASE WHEN turn % 5 = 2 THEN trim('<system-reminder>' || text) ELSE text END, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 6
UNION ALL SELECT session_key, seq, 0, 'reasoning', NULL, 'hm ' || id, NULL, NULL, NULL, NULL, 'in ' || (turn + 1) FROM keyed WHERE k = 7
UNION ALL SELECT session_key, seq, 1, 'assistant', NULL, text, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 7
UNION ALL SELECT session_key, seq, 2, 'tool', NULL, NULL, 'Bash', 'call-' || id, 'out ' || id, turn % 4 = 3, 'run ' || id FROM keyed WHERE k = 7
UNION ALL SELECT session_key, seq, 3, 'assistant', NULL, 'done ' || id, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 7
UNION ALL SELECT session_key, seq, 0, 'system', 'compact_boundary', text, NULL, NULL, NULL, NULL, 'auto' FROM keyed WHERE k = 9
UNION ALL SELECT session_key, seq, 0, CASE WHEN turn % 2 = 0 THEN 'notice' ELSE 'user' END, CASE WHEN turn % 2 = 0 THEN 'Background task' ELSE 'Queued' END, CASE WHEN turn % 2 = 0 THEN '<task-notification>x' ELSE 'queued ' || id END, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 10
UNION ALL SELECT session_key, seq, 0, 'attachment', 'deferred_tools_delta', NULL, NULL, NULL, NULL, NULL, '2' FROM keyed WHERE k = 11
UNION ALL SELECT session_key, seq, 0, 'attachment', 'pr-link', CASE WHEN conv_id % 2 = 0 THEN 'https://x.test/1' END, 'r', NULL, NULL, NULL, NULL FROM keyed WHERE k = 12
UNION ALL SELECT session_key, seq, 0, 'raw', 'strange', NULL, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE k = 13
""")
def tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project-tree logs as events."""
    raw = jsonl.tree_records(jsonl.raw_records(tree_lines(spark, sf_dir)))
    detail = F.coalesce(F.try_variant_get("payload", "$.trigger", "string"), F.nullif(F.try_variant_get("payload", "$.added_count", "string"), F.lit("0")), F.try_variant_get("input", "$.command", "string"), F.concat(F.lit("in "), F.try_variant_get("usage", "$.input", "string")))
    events = records.tree_events(raw)
    return events.select("session_key", "seq", F.col("block").cast("long").alias("block"), "kind", "label", "text", "name", "call_id", "result", "is_error", detail.alias("detail"))


@query(f"""
WITH {_TREE}
SELECT session_key, any_value('proj-' || (conv_id // 4 % 5)) AS project, any_value(CASE WHEN conv_id % 4 = 1 THEN (conv_id - 1)::VARCHAR END) AS parent_id, any_value(conv_id % 4 = 1) AS is_subagent, count(*)::BIGINT AS n_records
FROM keyed GROUP BY session_key
""")
def tree_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of project-tree logs tell, and how many records each log keeps."""
    raw = jsonl.tree_records(jsonl.raw_records(tree_lines(spark, sf_dir)))
    return raw.groupBy("session_key").agg(F.any_value("project").alias("project"), F.any_value("parent_id").alias("parent_id"), F.any_value("is_subagent").alias("is_subagent"), F.count("*").alias("n_records"))


@query(f"""
WITH {_TREE}
SELECT session_key, count(*)::BIGINT AS n_records, (count(*) FILTER (k = 6 AND turn % 5 <> 2) + count(*) FILTER (k = 10 AND turn % 2 = 1))::BIGINT AS n_user, count(*) FILTER (k = 7)::BIGINT AS n_assistant, count(*) FILTER (k = 7)::BIGINT AS n_tool,
       min('2025-01-01T00:0' || turn || ':00Z') FILTER (k NOT IN (4, 12, 14, 15)) AS first_ts, max('2025-01-01T00:0' || turn || ':00Z') FILTER (k NOT IN (4, 12, 14, 15)) AS last_ts,
       any_value('/w/' || (conv_id % 5)) AS cwd, arg_max('b' || turn, seq) FILTER (k IN (6, 7, 9)) AS git_branch, '1.0' AS version, coalesce(max(CASE WHEN k = 7 THEN 'm-one' END), '') AS model,
       coalesce(arg_max('title ' || id, seq) FILTER (k = 15), '') AS claude_title, coalesce(arg_max('title ' || id, seq) FILTER (k = 15), nullif(arg_min(CASE WHEN length(f) > 100 THEN substr(f, 1, 100) || '…' ELSE f END, seq) FILTER (k = 6 AND turn % 5 <> 2 AND f <> ''), ''), '(untitled session)') AS title
FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM keyed) GROUP BY session_key
""")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row for each project-tree log."""
    out = aggregates.tree_summary(jsonl.tree_records(jsonl.raw_records(tree_lines(spark, sf_dir))))
    return out.select("session_key", "n_records", "n_user", "n_assistant", "n_tool", "first_ts", "last_ts", "cwd", "git_branch", "version", "model", "claude_title", "title")


def _thread(conv: Column) -> Column:
    return F.concat(F.lpad(conv.cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000"))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rollout logs: even ones with mirrors of messages, odd ones with envelopes, every eighth + 1 a review."""
    turn, role, text, lit, conv = F.col("turn"), F.col("role"), F.col("text"), F.lit, F.col("conv_id")
    file = F.concat(lit("/rollouts/2025/01/01/rollout-2025-01-01T00-00-00-"), _thread(conv), lit(".jsonl"))
    line = lambda kind, **fields: _json(timestamp=_stamp(), type=lit(kind), payload=F.struct(*(c.alias(n) for n, c in fields.items())))
    said = lambda kind, **fields: line("event_msg", type=lit(kind), **fields)
    item = lambda kind, **fields: line("response_item", type=lit(kind), **fields)
    parts = lambda c, kind="input_text": F.array(F.struct(lit(kind).alias("type"), c.alias("text")))
    old, review = conv % 2 == 0, conv % 8 == 1
    asked = F.when(review, F.concat(lit('see Planned action JSON: {"tool":"'), _id(), lit('"} end'))).otherwise(text)
    told = F.when(review, F.concat(lit('{"outcome":"'), F.when(turn % 4 == 1, "allow").otherwise("deny"), lit('"}'))).otherwise(text)
    user, reply = role == "user", role == "assistant"
    completed = lambda kind, c: said("item_completed", item=F.struct(lit(kind).alias("type"), parts(c, "Text").alias("content")))
    made = [
        (0, turn == 0, line("session_meta", id=conv.cast("string"), cwd=F.concat(lit("/w/"), conv.cast("string")), source=F.when(review, '{"subagent":{"other":"guardian"}}').when(conv % 8 == 3, "cursor").otherwise("cli"), originator=lit("o"), parent_thread_id=F.when(review, (conv - 1).cast("string")), base_instructions=F.struct(lit("base").alias("text")))),
        (1, turn == 0, line("session_meta", id=lit("replayed"), thread_source=lit("user"), model_provider=lit("p"))),
        (2, turn == 0, item("message", role=lit("developer"), content=parts(F.concat(lit("rules "), conv.cast("string"))))),
        (3, user, line("turn_context", turn_id=_named("t-"), model=F.concat(lit("m"), turn.cast("string")), cwd=lit("/w"), approval_policy=lit("never"))),
        (4, user, said("task_started", turn_id=_named("t-"), model_context_window=lit(1000))),
        (5, user & old, said("user_message", message=asked)),
        (6, user & (~old | (turn % 3 == 0)), completed("UserMessage", asked)),
        (7, user, item("message", role=lit("user"), content=parts(F.concat(lit(" "), asked)))),
        (8, user, item("message", role=lit("user"), content=parts(F.concat(lit("<environment_context>"), _id())))),
        (9, reply, said("agent_reasoning", text=_named("think "))),
        (10, reply, item("reasoning", summary=F.array(F.struct(lit("summary_text").alias("type"), _named("think ").alias("text"))), encrypted_content=lit("zz"))),
        (11, reply, item("reasoning", summary=F.array().cast("array<struct<type:string,text:string>>"), encrypted_content=lit("zz"))),
        (12, reply & (turn % 2 == 1), said("agent_reasoning", text=lit("again and again"))),
        (13, reply & old, said("agent_message", message=told)), (14, reply & ~old, completed("AgentMessage", told)),
        (15, reply, item("message", role=lit("assistant"), content=parts(told, "output_text"))),
        (16, reply, item("function_call", name=lit("exec_command"), arguments=F.concat(lit('{"cmd":"ls '), _id(), lit('"}')), call_id=_named("c-"))),
        (17, reply, item("function_call_output", call_id=_named("c-"), output=lit("superseded"))), (18, reply, item("function_call_output", call_id=_named("c-"), output=_named("out "))),
        (19, reply & (turn % 4 == 1), item("custom_tool_call", name=lit("apply_patch"), input=F.concat(lit("*** Begin Patch\n*** Add File: f-"), _id(), lit(".txt\n*** End Patch")), call_id=_named("p-"))),
        (20, reply & (turn % 4 == 1), said("patch_apply_end", call_id=_named("p-"), stdout=_named("patched "), success=lit(True), changes=F.struct(F.struct(lit("add").alias("kind")).alias("f")))),
        (21, reply & (turn % 4 == 1), item("custom_tool_call_output", call_id=_named("p-"), output=lit(""))),
        (22, reply & (turn % 4 == 3), item("function_call", name=lit("exec"), arguments=lit('{"calls":[{"name":"a"},{"name":"b"}]}'), call_id=_named("x-"))),
        (23, reply & (turn % 4 == 3), item("function_call_output", call_id=_named("x-"), output=F.concat(lit('Wall time: 1\nOutput: {"output":"no '), _id(), lit('","exit_code":2}')))),
        (24, reply & (turn % 3 == 1), item("web_search_call", call_id=_named("w-"), action=F.struct(lit("other").alias("query")))),
        (25, reply & (turn % 3 == 1), said("web_search_end", call_id=_named("w-"), query=_named("find "))),
        (26, reply, said("token_count", info=F.struct(F.struct((turn + 1).alias("input_tokens")).alias("total_token_usage"), lit(9).alias("model_context_window")))),
        (27, reply, said("task_complete", turn_id=_named("t-"), duration_ms=turn * 10)), (28, turn == 1, said("new_kind", x=lit(1))), (29, turn == 1, said("turn_diff", x=lit(1))),
        (30, turn == 2, line("compacted", message=lit("")),),
    ]
    return _lines(_turns(spark, sf_dir), file, made)


def thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a thread table for every third conversation."""
    convs = _turns(spark, sf_dir).select("conv_id").distinct().where("conv_id % 3 = 0")
    return convs.select(_thread(F.col("conv_id")).alias("session_key"), F.concat(F.lit("T "), F.col("conv_id").cast("string")).alias("ai_title"), F.concat(F.lit("/row/"), F.col("conv_id").cast("string")).alias("cwd"))


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.raw_records(rollout_lines(spark, sf_dir)).withColumn("session_key", jsonl.rollout_key(F.col("file")))


#: The records of those logs, numbered, in SQL.
_ROLLOUT = """
rec AS (
  SELECT conv_id, turn, role, text, k, conv_id || '-' || turn AS id, lpad(conv_id::VARCHAR, 8, '0') || '-0000-0000-0000-000000000000' AS session_key, conv_id % 8 = 1 AS review, conv_id % 2 = 0 AS old,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq
  FROM conversations, (SELECT unnest(range(31)) AS k)
  WHERE (k <= 2 AND turn = 0) OR (k IN (3, 4, 7, 8) AND role = 'user') OR (k = 5 AND role = 'user' AND conv_id % 2 = 0) OR (k = 6 AND role = 'user' AND (conv_id % 2 = 1 OR turn % 3 = 0))
     OR (k IN (9, 10, 11, 15, 16, 17, 18, 26, 27) AND role = 'assistant') OR (k = 12 AND role = 'assistant' AND turn % 2 = 1) OR (k = 13 AND role = 'assistant' AND conv_id % 2 = 0)
     OR (k = 14 AND role = 'assistant' AND conv_id % 2 = 1) OR (k IN (19, 20, 21) AND role = 'assistant' AND turn % 4 = 1) OR (k IN (22, 23) AND role = 'assistant' AND turn % 4 = 3)
     OR (k IN (24, 25) AND role = 'assistant' AND turn % 3 = 1) OR (k IN (28, 29) AND turn = 1) OR (k = 30 AND turn = 2)
)
"""


@query(f"""
WITH {_ROLLOUT}, again AS (SELECT session_key, seq, count(*) OVER (PARTITION BY session_key ORDER BY seq) AS n FROM rec WHERE k IN (10, 12)),
thought AS (SELECT rec.*, lag(again.n) OVER (PARTITION BY rec.session_key, rec.k ORDER BY rec.seq) AS before, again.n FROM rec JOIN again USING (session_key, seq) WHERE rec.k = 12)
SELECT session_key, seq, 'instructions' AS kind, 'Base instructions' AS label, 'base' AS text, NULL AS name, NULL AS call_id, NULL AS result, NULL::BOOLEAN AS is_error, NULL AS model, NULL AS detail FROM rec WHERE k = 0
UNION ALL SELECT session_key, seq, 'instructions', 'Developer instructions', 'rules ' || conv_id, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k = 2
UNION ALL SELECT session_key, seq, 'context', NULL, NULL, NULL, 't-' || id, NULL, NULL, 'm' || turn, 'never' FROM rec WHERE k = 3
UNION ALL SELECT session_key, seq, 'status', 'started', NULL, NULL, 't-' || id, NULL, NULL, 'm' || turn, NULL FROM rec WHERE k = 4
UNION ALL SELECT session_key, seq, CASE WHEN review THEN 'guardian_request' ELSE 'user' END, NULL, CASE WHEN review THEN 'see Planned action JSON: {{"tool":"' || id || '"}} end' ELSE text END, NULL, NULL, NULL, NULL, NULL, CASE WHEN review THEN id END
  FROM rec WHERE k = 5 OR (k = 6 AND NOT old)
UNION ALL SELECT session_key, seq, 'instructions', 'Environment context', '<environment_context>' || id, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k = 8
UNION ALL SELECT session_key, seq, 'reasoning', 'encrypted', 'think ' || id, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k = 10
UNION ALL SELECT session_key, seq, 'reasoning', NULL, 'again and again', NULL, NULL, NULL, NULL, NULL, NULL FROM thought WHERE before IS NULL
UNION ALL SELECT session_key, seq, CASE WHEN review THEN 'guardian_decision' ELSE 'assistant' END, CASE WHEN review THEN CASE WHEN turn % 4 = 1 THEN 'allow' ELSE 'deny' END END,
  CASE WHEN review THEN '{{"outcome":"' || CASE WHEN turn % 4 = 1 THEN 'allow' ELSE 'deny' END || '"}}' ELSE text END, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k IN (13, 14)
UNION ALL SELECT session_key, seq, 'tool', 'ls ' || id, NULL, 'exec_command', 'c-' || id, 'out ' || id, false, NULL, NULL FROM rec WHERE k = 16
UNION ALL SELECT session_key, seq, 'tool', 'f-' || id || '.txt', NULL, 'apply_patch', 'p-' || id, 'patched ' || id, false, NULL, 'add' FROM rec WHERE k = 19
UNION ALL SELECT session_key, seq, 'tool', 'a · b', NULL, 'exec', 'x-' || id, 'no ' || id, true, NULL, NULL FROM rec WHERE k = 22
UNION ALL SELECT session_key, seq, 'web_call', NULL, 'find ' || id, NULL, 'w-' || id, NULL, NULL, NULL, NULL FROM rec WHERE k = 24
UNION ALL SELECT session_key, seq, 'web_search', NULL, 'find ' || id, NULL, 'w-' || id, NULL, NULL, NULL, NULL FROM rec WHERE k = 25
UNION ALL SELECT session_key, seq, 'tokens', NULL, NULL, NULL, NULL, NULL, NULL, NULL, (turn + 1)::VARCHAR FROM rec WHERE k = 26
UNION ALL SELECT session_key, seq, 'status', 'complete', NULL, NULL, 't-' || id, NULL, NULL, NULL, NULL FROM rec WHERE k = 27
UNION ALL SELECT session_key, seq, 'raw', 'event_msg/new_kind', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k = 28
UNION ALL SELECT session_key, seq, 'system', 'compact_boundary', 'Context compacted', NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE k = 30
""")
def rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as events."""
    events = records.rollout_events(_rollouts(spark, sf_dir))
    get = lambda c, path: F.try_variant_get(c, f"$.{path}", "string")
    detail = F.coalesce(get("payload", "approval_policy"), get("payload", "tool"), get("payload", "f.kind"), get("usage", "input_tokens"))
    return events.select("session_key", "seq", "kind", "label", "text", "name", "call_id", "result", "is_error", "model", detail.alias("detail"))


@query(f"""
WITH {_ROLLOUT}
SELECT session_key, conv_id::VARCHAR AS id, '/w/' || conv_id AS cwd, review AS is_subagent, CASE WHEN review THEN 'guardian' END AS subagent_type, CASE WHEN review THEN (conv_id - 1)::VARCHAR END AS parent_id,
       CASE WHEN conv_id % 8 = 3 THEN 'cursor' ELSE 'codex' END AS agent, 'p' AS model_provider FROM rec WHERE k = 0
""")
def rollout_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose log a rollout is, by its first session record."""
    return records.rollout_meta(_rollouts(spark, sf_dir)).select("session_key", "id", "cwd", "is_subagent", "subagent_type", "parent_id", "agent", "model_provider")


@query(f"""
WITH {_ROLLOUT},
msg AS (SELECT session_key, CASE WHEN k IN (5, 6) THEN 'user' ELSE 'assistant' END AS r, k IN (5, 13) AS mirror,
        CASE WHEN NOT review THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN k IN (5, 6) THEN id ELSE CASE WHEN turn % 4 = 1 THEN 'allow' ELSE 'deny' END END AS t FROM rec WHERE k IN (5, 6, 13, 14)),
n AS (SELECT session_key, r, t, greatest(count(*) FILTER (mirror), count(*) FILTER (NOT mirror)) AS n FROM msg GROUP BY ALL),
c AS (SELECT session_key, sum(n) FILTER (r = 'user') AS n_user, sum(n) FILTER (r = 'assistant') AS n_assistant FROM n GROUP BY session_key)
SELECT session_key, coalesce(n_user, 0)::BIGINT AS n_user, coalesce(n_assistant, 0)::BIGINT AS n_assistant, count(*) FILTER (k IN (16, 19, 22))::BIGINT AS n_tool, count(*) FILTER (k IN (9, 10, 11, 12))::BIGINT AS n_reasoning,
       count(*) FILTER (k IN (24, 25))::BIGINT AS n_web, count(*)::BIGINT AS n_records, coalesce(arg_min('m' || turn, seq) FILTER (k = 3), '') AS model, any_value('T ' || conv_id) FILTER (conv_id % 3 = 0) AS ai_title,
       any_value(CASE WHEN conv_id % 3 = 0 THEN '/row/' ELSE '/w/' END || conv_id) AS cwd
FROM rec LEFT JOIN c USING (session_key) GROUP BY session_key, n_user, n_assistant
""")
def rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row for each rollout, its messages counted once, its thread's row before its own fields."""
    out = aggregates.rollout_summary(_rollouts(spark, sf_dir), thread_rows(spark, sf_dir))
    return out.select("session_key", "n_user", "n_assistant", "n_tool", "n_reasoning", "n_web", "n_records", "model", "ai_title", "cwd")


@query("""
WITH p AS (SELECT conv_id, lpad(conv_id::VARCHAR, 8, '0') || '-0000-0000-0000-000000000000' AS key FROM conversations GROUP BY conv_id)
SELECT '/r/rollout-2025-01-01T00-00-00-' || key || '.jsonl' AS path, key AS session_key, conv_id % 2 = 1 AS archived FROM p
UNION ALL SELECT '/elsewhere/' || conv_id || '.jsonl', conv_id::VARCHAR, false FROM p WHERE conv_id % 5 = 0
""")
def rollout_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, archived and named rollouts, each path once."""
    convs = _turns(spark, sf_dir).select("conv_id").distinct()
    path = F.concat(F.lit("/r/rollout-2025-01-01T00-00-00-"), _thread(F.col("conv_id")), F.lit(".jsonl"))
    of = lambda fine, p=path: convs.where(fine).select(p.alias("path"))
    named = of("conv_id % 7 = 0").union(of("conv_id % 5 = 0", F.concat(F.lit("/elsewhere/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))))
    return jsonl.rollout_paths(of("conv_id % 2 = 0"), of("conv_id % 2 = 1"), named)


@query("""
SELECT conv_id, 'p' || (conv_id % 3) AS path, conv_id % 3 = 1 AS is_log FROM conversations GROUP BY conv_id
""")
def session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are session logs, by root, ending and depth."""
    convs = _turns(spark, sf_dir).select("conv_id").distinct()
    end = F.when(F.col("conv_id") % 3 == 0, "x/y/z.jsonl").when(F.col("conv_id") % 3 == 1, "x/y.jsonl").otherwise("x/y.json")
    return convs.select("conv_id", F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("path"), records.is_session_log(F.concat(F.lit("/root/"), end), "/root/", 2).alias("is_log"))


@query("""
WITH rec AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations)
SELECT conv_id::VARCHAR AS session_key, seq, 0::BIGINT AS block, 'user' AS kind, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, NULL AS name, NULL AS path FROM rec WHERE role = 'user'
UNION ALL SELECT conv_id::VARCHAR, seq, 0, 'assistant', text, NULL, NULL FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 1, 'tool', NULL, 'Read', 'f-' || id FROM rec WHERE role = 'assistant'
""")
def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossy exports as events."""
    path = F.try_variant_get("input", "$.file_path", "string")
    return _exports(spark, sf_dir).select("session_key", "seq", F.col("block").cast("long").alias("block"), "kind", "text", "name", path.alias("path"))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit, role = F.lit, F.col("role")
    file = F.concat(lit("/proj/agent-transcripts/"), F.col("conv_id").cast("string"), lit("/"), F.col("conv_id").cast("string"), lit(".jsonl"))
    asked = F.concat(lit("<timestamp>now</timestamp>\n<user_query>\n"), F.col("text"), lit("\n</user_query>"))
    call = F.to_variant_object(F.struct(lit("tool_use").alias("type"), lit("ReadFile").alias("name"), F.struct(_named("f-").alias("path")).alias("input")))
    said = F.to_variant_object(F.struct(lit("text").alias("type"), F.col("text").alias("text")))
    made = [
        (1, role == "user", _json(role=lit("user"), message=F.struct(asked.alias("content")))), (2, role == "assistant", _json(role=lit("assistant"), message=F.struct(F.array(said, call).alias("content")))),
        (3, role == "system", _json(role=lit("user"), message=F.struct(F.concat(lit("<user_info>"), F.col("text")).alias("content")))),
    ]
    raw = jsonl.raw_records(_lines(_turns(spark, sf_dir), file, made))
    keyed = raw.where(F.col("file").contains("/agent-transcripts/")).withColumn("session_key", F.regexp_extract("file", r"/([^/]+)\.jsonl$", 1))
    return records.export_events(keyed)


def _stores(rows: DataFrame, statements: list[str]) -> sqlite.Stores:
    """SQLite stores of rows (path, sql table number n, values array<string>), a store for each path."""

    def make(part: pd.DataFrame) -> pd.DataFrame:
        con = sqlite3.connect(":memory:")
        for statement in statements:
            con.execute(statement)
        for n, values in zip(part["n"], part["cells"], strict=True):
            table_ = statements[n].split()[2]
            con.execute(f"INSERT INTO {table_} VALUES ({', '.join('?' * len(values))})", list(values))
        con.commit()
        out = pd.DataFrame({"path": [part["path"].iloc[0]], "content": [con.serialize()]})
        con.close()
        return out

    ordered = rows.groupBy("path").applyInPandas(lambda part: make(part.sort_values("o")), "path string, content binary")
    return sqlite.Stores(ordered)


_IDE = "rec AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations WHERE role <> 'system')"


def ide_store(spark: SparkSession, sf_dir: str) -> sqlite.Stores:
    """IDE stores of 50 conversations each; system turns are bubbles that no header names."""
    turns, lit, conv = _turns(spark, sf_dir), F.lit, F.col("conv_id").cast("string")
    path = F.concat(lit("/ide/"), F.floor(F.col("conv_id") / 50).cast("string"), lit("/state.vscdb"))
    user = F.col("role") == "user"
    tool = F.when(F.col("role") == "assistant", F.struct(lit("read_file_v2").alias("name"), F.when(F.col("turn") % 4 == 3, "error").otherwise("completed").alias("status"), _named("k-").alias("toolCallId"), F.concat(lit('{"targetFile":"f-'), _id(), lit('"}')).alias("params"), F.concat(lit('{"contents":"out '), _id(), lit('"}')).alias("result")))
    bubble = _json(type=F.when(user, 1).otherwise(2), text=F.when(user, F.concat(lit("<user_query>"), F.col("text"), lit("</user_query>"))).otherwise(F.col("text")), createdAt=_stamp(), thinking=F.when(~user, F.struct(_named("hm ").alias("text"))), toolFormerData=tool, modelInfo=F.struct(lit("m-ide").alias("modelName")))
    bubbles = turns.select(path.alias("path"), F.lit(0).alias("n"), F.lit(1).alias("o"), F.array(F.concat(lit("bubbleId:"), conv, lit(":"), _id()), bubble).alias("cells"))
    headed = F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", _id().alias("bubbleId")))))
    listed = turns.groupBy("conv_id").agg(headed.alias("h"))
    composers = listed.select(path.alias("path"), F.lit(0).alias("n"), F.lit(0).alias("o"), F.array(F.concat(lit("composerData:"), conv), _json(fullConversationHeadersOnly=F.transform("h", lambda x: F.struct(x["bubbleId"].alias("bubbleId"))))).alias("cells"))
    return _stores(composers.unionByName(bubbles), ["CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value BLOB)"])


@query(f"""
WITH {_IDE}
SELECT conv_id::VARCHAR AS session_key, seq, 0::BIGINT AS block, 'user' AS kind, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, NULL AS name, NULL AS path, NULL AS result, NULL::BOOLEAN AS is_error FROM rec WHERE role = 'user'
UNION ALL SELECT conv_id::VARCHAR, seq, 0, 'reasoning', 'hm ' || id, NULL, NULL, NULL, NULL FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 1, 'assistant', text, NULL, NULL, NULL, NULL FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 2, 'tool', NULL, 'Read', 'f-' || id, 'out ' || id, turn % 4 = 3 FROM rec WHERE role = 'assistant'
""")
def ide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles of IDE stores as events."""
    events = records.bubble_events(*sqlite.ide_store(ide_store(spark, sf_dir)))
    return events.select("session_key", F.col("seq").cast("long").alias("seq"), F.col("block").cast("long").alias("block"), "kind", "text", "name", F.try_variant_get("input", "$.file_path", "string").alias("path"), "result", "is_error")


@query("SELECT conv_id::VARCHAR AS session_key, conv_id || '-' || turn AS bubble_id FROM conversations WHERE role = 'system'")
def ide_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles that no header names."""
    headers, bubbles = sqlite.ide_store(ide_store(spark, sf_dir))
    return joins.orphans(bubbles, headers, ["session_key", "bubble_id"]).select("session_key", "bubble_id")


@query(f"""
WITH {_IDE}
SELECT conv_id::VARCHAR AS session_key, (count(*) FILTER (role = 'user') + 3 * count(*) FILTER (role = 'assistant'))::BIGINT AS n_records, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant,
       count(*) FILTER (role = 'assistant')::BIGINT AS n_tool, min(turn) FILTER (true)::BIGINT AS first_turn, max(CASE WHEN role = 'assistant' THEN 'm-ide' END) AS model FROM rec GROUP BY conv_id
""")
def ide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a summary row for each IDE conversation."""
    events = records.bubble_events(*sqlite.ide_store(ide_store(spark, sf_dir)))
    out = aggregates.session_summary(events)
    return out.select("session_key", "n_records", "n_user", "n_assistant", "n_tool", F.substring("first_ts", 16, 1).cast("long").alias("first_turn"), "model")


@query("""
WITH rec AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations)
SELECT conv_id::VARCHAR AS session_key, seq, 0::BIGINT AS block, CASE WHEN turn % 5 = 2 THEN 'notice' ELSE 'user' END AS kind, CASE WHEN turn % 5 = 2 THEN CASE WHEN turn % 2 = 0 THEN 'Ignored' ELSE 'Injected' END END AS label, text, NULL AS name, NULL AS model,
       NULL AS result, NULL::BOOLEAN AS is_error, NULL AS detail FROM rec WHERE role = 'user'
UNION ALL SELECT conv_id::VARCHAR, seq, 1, 'attachment', 'file', NULL, 'a.png', NULL, 'inline', NULL, NULL FROM rec WHERE role = 'user' AND turn % 3 = 0
UNION ALL SELECT conv_id::VARCHAR, seq, 1, 'reasoning', 'encrypted', 'hm ' || id, NULL, 'p/m', NULL, NULL, NULL FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 2, 'assistant', NULL, text, NULL, 'p/m', NULL, NULL, NULL FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 3, 'tool', NULL, NULL, 'read', 'p/m', 'out ' || id, turn % 4 = 3, 'f-' || id FROM rec WHERE role = 'assistant'
UNION ALL SELECT conv_id::VARCHAR, seq, 1 << 30, 'notice', 'Error', 'Broken: no ' || id, NULL, NULL, NULL, NULL, NULL FROM rec WHERE role = 'assistant' AND turn % 4 = 3
UNION ALL SELECT conv_id::VARCHAR, seq, 0, 'raw', 'part/odd', NULL, NULL, 'p/m', NULL, NULL, NULL FROM rec WHERE role = 'system'
""")
def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-table store as events."""
    _, messages, parts = sqlite.three_tables(_three(spark, sf_dir))
    events = records.part_events(messages, parts)
    shown = F.when(F.col("label") == "file", F.lit(None).cast("string")).otherwise(F.col("text"))
    result = F.when(F.col("label") == "file", F.col("text")).otherwise(F.col("result"))
    return events.select("session_key", F.col("seq").cast("long").alias("seq"), F.col("block").cast("long").alias("block"), "kind", "label", shown.alias("text"), "name", "model", result.alias("result"), "is_error", F.try_variant_get("input", "$.file_path", "string").alias("detail"))


def _three(spark: SparkSession, sf_dir: str) -> sqlite.Stores:
    """One three-table store for 50 conversations; messages come in another order than their times."""
    turns, lit, conv, turn = _turns(spark, sf_dir), F.lit, F.col("conv_id").cast("string"), F.col("turn")
    path = F.concat(lit("/three/"), F.floor(F.col("conv_id") / 50).cast("string"), lit(".db"))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    fault = F.when(reply & (turn % 4 == 3), F.struct(lit("Broken").alias("name"), F.struct(_named("no ").alias("message")).alias("data")))
    message = _json(role=F.when(user, "user").otherwise("assistant"), providerID=lit("p"), modelID=lit("m"), tokens=F.struct((turn + 1).alias("input")), error=fault)
    messages = turns.select(path.alias("path"), F.lit(1).alias("n"), (9 - turn).alias("o"), F.array(_named("m-"), conv, F.concat(lit("1"), F.lpad(turn.cast("string"), 4, "0")), message).alias("cells"))
    part = lambda i, fine, value: F.when(fine, F.struct(F.concat(_named("p-"), lit(f"-{i}")).alias("id"), value.alias("data")))
    made = F.array(
        part(0, user, _json(type=lit("text"), text=F.col("text"), synthetic=F.when((turn % 5 == 2) & (turn % 2 == 1), True), ignored=F.when((turn % 5 == 2) & (turn % 2 == 0), True))),
        part(1, user & (turn % 3 == 0), _json(type=lit("file"), filename=lit("a.png"), mime=lit("image/png"), url=lit("data:image/png;base64,eA=="))),
        part(0, reply, _json(type=lit("step-start"))), part(1, reply, _json(type=lit("reasoning"), text=_named("hm "), metadata=F.struct(F.array(F.struct(lit("reasoning.encrypted").alias("type"))).alias("parts")))),
        part(2, reply, _json(type=lit("text"), text=F.col("text"))),
        part(3, reply, _json(type=lit("tool"), tool=lit("read"), callID=_named("k-"), state=F.struct(F.when(turn % 4 == 3, "error").otherwise("completed").alias("status"), F.struct(_named("f-").alias("filePath")).alias("input"), F.when(turn % 4 != 3, _named("out ")).alias("output"), F.when(turn % 4 == 3, _named("out ")).alias("error")))),
        part(0, F.col("role") == "system", _json(type=lit("odd"))),
    )
    parts = turns.select(path.alias("path"), _named("m-").alias("m"), conv.alias("s"), F.explode(F.array_compact(made)).alias("x")).select("path", F.lit(2).alias("n"), F.lit(5).cast("long").alias("o"), F.array("x.id", "m", "s", "x.data").alias("cells"))
    sessions = turns.select("conv_id").distinct().select(path.alias("path"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("o"), F.array(F.col("conv_id").cast("string"), lit(None).cast("string"), lit("/w"), _title(), lit("1"), F.col("conv_id").cast("string"), lit("5")).alias("cells"))
    tables = ["CREATE TABLE session (id, parent_id, directory, title, version, time_created INTEGER, time_updated INTEGER)", "CREATE TABLE message (id, session_id, time_created INTEGER, data)", "CREATE TABLE part (id, message_id, session_id, data)"]
    return _stores(messages.unionByName(parts).unionByName(sessions), tables)


def _title() -> Column:
    return F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("conv_id").cast("string")))


@query("""
WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_tool, arg_min(text, turn) FILTER (role = 'user') AS p FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, conv_id AS created, CASE WHEN conv_id % 3 = 0 THEN 'Mine ' || conv_id WHEN conv_id % 2 = 1 THEN 'Title ' || conv_id ELSE trim(p) END AS title,
       row_number() OVER (ORDER BY conv_id)::BIGINT AS place FROM s
""")
def store_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a three-table store under their titles: the custom one, their own, or the first prompt; by creation."""
    sessions, messages, parts = sqlite.three_tables(_three(spark, sf_dir))
    events = records.part_events(messages, parts)
    prompts = events.where("seq >= 0 and uuid is not null and kind in ('user', 'notice')").groupBy("session_key").agg(F.min_by("text", F.struct("seq", "block")).alias("prompt"))
    names = sessions.select(F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("three:"), "id"), F.concat(F.lit("other:"), "id"), F.concat(F.lit("blank:"), "id")), F.array(F.when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit(" Mine "), "id")).otherwise(" "), F.lit("x"), F.lit("")))).alias("value"))
    named = joins.named(sessions.withColumns({"agent": F.lit("three"), "parent": F.lit("")}), jsonl.named_entries(names))
    joined = named.join(prompts, named["id"] == prompts["session_key"], "left")
    titled = joined.select("id", F.col("time_created").alias("created"), records.effective_title(F.col("custom_title"), F.col("title"), F.col("prompt")).alias("title"))
    return facets.export_order(titled, "created", "id").select("id", "created", "title", "place")


_CHAT = """
rec AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq, k
        FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE k = 0 OR (k IN (1, 2) AND role = 'assistant') OR (k = 3 AND turn = 0))
"""


@query(f"""
WITH {_CHAT}
SELECT 'chat-' || conv_id AS session_key, seq, 1::BIGINT AS block, 'user' AS kind, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, NULL AS name, NULL AS pattern, NULL AS result, NULL::BOOLEAN AS is_error FROM rec WHERE k = 0 AND role = 'user'
UNION ALL SELECT 'chat-' || conv_id, seq, 0, 'reasoning', 'hm ' || id, NULL, NULL, NULL, NULL FROM rec WHERE k = 0 AND role = 'assistant'
UNION ALL SELECT 'chat-' || conv_id, seq, 1, 'assistant', text, NULL, NULL, NULL, NULL FROM rec WHERE k = 0 AND role = 'assistant'
UNION ALL SELECT 'chat-' || conv_id, seq, 2, 'tool', NULL, 'Grep', 'p ' || id, 'hit ' || id, turn % 4 = 3 FROM rec WHERE k = 0 AND role = 'assistant'
""")
def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of chat stores as events; copies of a message in a row come once."""
    return _chats(spark, sf_dir).select("session_key", "seq", F.col("block").cast("long").alias("block"), "kind", "text", "name", F.try_variant_get("input", "$.pattern", "string").alias("pattern"), "result", "is_error")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lit, role, turn = _turns(spark, sf_dir), F.lit, F.col("role"), F.col("turn")
    path = F.concat(lit("/chats/chat-"), F.col("conv_id").cast("string"), lit("/store.db"))
    block = lambda kind, **more: F.to_variant_object(F.struct(lit(kind).alias("type"), *(c.alias(n) for n, c in more.items())))
    reply = F.array(block("reasoning", text=_named("hm ")), block("text", text=F.col("text")), block("tool-call", toolCallId=_named("k-"), toolName=lit("rg"), args=F.struct(_named("p ").alias("pattern"))))
    answer = F.array(block("tool-result", toolCallId=_named("k-"), result=F.struct(_named("hit ").alias("output")), is_error=turn % 4 == 3))
    said = F.when(role == "system", _json(role=lit("user"), content=F.concat(lit("<user_info>"), F.col("text")))).when(role == "user", _json(role=lit("user"), content=F.concat(lit("<user_query>"), F.col("text"), lit("</user_query>")))).otherwise(_json(role=lit("assistant"), content=reply))
    made = F.array(
        F.struct(F.concat(_named("a-")).alias("id"), F.concat(lit("\x02\x01"), said).alias("data")), F.when(role == "assistant", F.struct(_named("b-").alias("id"), F.concat(said, lit("\x03")).alias("data"))),
        F.when(role == "assistant", F.struct(_named("c-").alias("id"), _json(role=lit("tool"), content=answer).alias("data"))), F.when(turn == 0, F.struct(_named("d-").alias("id"), lit("\x00\x01 no json").alias("data"))),
    )
    rows = turns.select(path.alias("path"), turn, F.posexplode(made).alias("k", "x")).where("x is not null").select("path", F.lit(0).alias("n"), (turn * 10 + F.col("k")).alias("o"), F.array("x.id", "x.data").alias("cells"))
    return records.blob_events(sqlite.blob_messages(_stores(rows, ["CREATE TABLE blobs (id TEXT, data BLOB)"])))


@query("""
SELECT '/r/' || conv_id AS path, CASE WHEN conv_id % 2 = 0 THEN 'row ' || conv_id ELSE 'log' END AS title, CASE WHEN conv_id % 3 = 0 THEN '/row' ELSE '/log' END AS cwd FROM conversations GROUP BY conv_id
""")
def thread_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a thread table, which lacks a column that is asked for, over the fields of logs."""
    convs, lit = _turns(spark, sf_dir).select("conv_id").distinct(), F.lit
    conv = F.col("conv_id").cast("string")
    cells = F.array(F.concat(lit("/r/"), conv), F.when(F.col("conv_id") % 2 == 0, F.concat(lit("row "), conv)), F.when(F.col("conv_id") % 3 == 0, lit("/row")))
    rows = convs.select(F.concat(lit("/t/"), (F.col("conv_id") % 4).cast("string"), lit(".sqlite")).alias("path"), lit(0).alias("n"), F.col("conv_id").alias("o"), cells.alias("cells"))
    threads = sqlite.thread_rows(_stores(rows, ["CREATE TABLE threads (path TEXT, title TEXT, cwd TEXT)"]), ["path", "title", "cwd", "name"])
    logs = convs.select(F.concat(lit("/r/"), conv).alias("path"), lit("log").alias("title"), lit("/log").alias("cwd"))
    return joins.overridden(logs, threads.where("name is null"), "path", ["title", "cwd"])


@query("""
SELECT conv_id, 'T' || conv_id AS title, CASE WHEN count(*) % 2 = 0 THEN '/b' ELSE '/a' END AS workspace FROM conversations GROUP BY conv_id
""")
def sidecar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar's JSON, plain or in hex digits, and the last workspace that a log's text names."""
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    plain = _json(title=F.concat(F.lit("T"), F.col("conv_id").cast("string")))
    given = F.when(F.col("conv_id") % 2 == 0, F.lower(F.hex(F.encode(plain, "UTF-8")))).otherwise(plain)
    text = F.concat(F.lit("x workspacePath=/a y\n"), F.when(F.col("n") % 2 == 0, "workspacePath=/b z").otherwise(""))
    return rows.select("conv_id", F.try_variant_get(jsonl.plain_or_hex(given), "$.title", "string").alias("title"), jsonl.last_workspace(text).alias("workspace"))


_CAPTURES = """
c AS (SELECT conv_id, 'k' || conv_id AS key, 's' || (conv_id % 3) AS source, CASE WHEN conv_id % 5 = 0 THEN 'deleted' ELSE 'active' END AS status, conv_id % 4 = 0 AS flagged FROM conversations GROUP BY conv_id),
e AS (SELECT turn::VARCHAR AS t, CASE WHEN turn % 3 = 0 THEN 'capture_gap' ELSE 'truncated' END AS type, CASE WHEN turn % 3 <> 0 THEN 'k' || conv_id END AS key FROM conversations)
"""


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A capture store's index and events, as its files would hold them."""
    turns = _turns(spark, sf_dir)
    conv = F.col("conv_id")
    entry = F.to_variant_object(F.struct(F.concat(F.lit("s"), (conv % 3).cast("string")).alias("source"), F.when(conv % 5 == 0, "deleted").otherwise("active").alias("status"), F.when(conv % 4 == 0, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>")).alias("flags")))
    files = turns.select("conv_id").distinct().select(F.to_json(F.struct(F.create_map(F.concat(F.lit("k"), conv.cast("string")), entry).alias("files"))).alias("value"))
    lines = turns.select(F.when(F.col("turn") == 4, "{half").otherwise(_json(t=F.col("turn").cast("string"), type=F.when(F.col("turn") % 3 == 0, "capture_gap").otherwise("truncated"), key=F.when(F.col("turn") % 3 != 0, F.concat(F.lit("k"), conv.cast("string"))))).alias("value"))
    return store.index_entries(files), store.event_records(lines)


@query(f"""
WITH {_CAPTURES} SELECT c.key, e.t, e.type FROM c LEFT JOIN (SELECT * FROM e WHERE t <> '4') e USING (key) WHERE flagged OR status = 'deleted'
UNION ALL SELECT key, t, type FROM e WHERE key IS NULL AND type = 'capture_gap' AND t <> '4'
""")
def flagged_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged or deleted captures with their events, and the store's own events."""
    return store.flagged_report(*_captures(spark, sf_dir)).select("key", "t", "type")


@query(f"""
WITH {_CAPTURES} SELECT source, count(*)::BIGINT AS n_files, count(*) FILTER (flagged)::BIGINT AS n_flagged, count(*) FILTER (status = 'deleted')::BIGINT AS n_deleted FROM c GROUP BY source
""")
def capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each source, how many are flagged or deleted."""
    return aggregates.capture_status(_captures(spark, sf_dir)[0])


@query("""
SELECT conv_id, turn, 'rs-' || conv_id || '-' || (turn - turn % 2) AS id, CASE WHEN turn % 4 < 2 THEN 'f-one' ELSE 'f-two' END AS format, 'zz' || turn AS data FROM conversations
WHERE turn % 3 <> 2 AND (turn % 2 = 0 OR (turn - 1) % 3 = 2 OR NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.turn = conversations.turn - 1))
""")
def encrypted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts whose provider left an opaque reasoning item, every other turn the one before's again; every third part is a tool's."""
    turn = F.col("turn")
    name = F.concat(F.lit("rs-"), F.col("conv_id").cast("string"), F.lit("-"), (turn - turn % 2).cast("string"))
    detail = lambda kind: F.struct(F.lit(kind).alias("type"), name.alias("id"), F.when(turn % 4 < 2, "f-one").otherwise("f-two").alias("format"), F.concat(F.lit("zz"), turn.cast("string")).alias("data"))
    metadata = F.struct(F.struct(F.lit(1).alias("x")).alias("other"), F.struct(F.array(detail("reasoning.summary"), detail("reasoning.encrypted")).alias("reasoning_details")).alias("provider"))
    parts = _turns(spark, sf_dir).select("conv_id", "turn", F.to_variant_object(F.struct(F.when(turn % 3 == 2, "tool").otherwise("reasoning").alias("type"), metadata.alias("metadata"))).alias("data"))
    return records.encrypted_items(parts, "conv_id", "turn")


@query("""
SELECT DISTINCT conv_id, conv_id % 3 = 1 AS is_subagent, CASE WHEN conv_id % 3 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'explore' ELSE 'cursor-cli' END END AS subagent_type,
       CASE WHEN conv_id % 3 = 1 THEN 'p' || conv_id END AS parent_id, CASE WHEN conv_id % 3 = 1 THEN CASE WHEN conv_id % 4 = 0 THEN 'root' ELSE 'p' || conv_id END END AS root_parent_id FROM conversations
""")
def store_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat stores' metadata, of which every third tells whose sub-agent it is, and every third but one tells nothing that counts."""
    conv = F.col("conv_id")
    info = F.struct(F.when(conv % 3 == 1, F.concat(F.lit("p"), conv.cast("string"))).otherwise("").alias("parentAgentId"), F.when(conv % 2 == 0, "explore").alias("typeName"), F.when(conv % 4 == 0, "root").alias("rootParentAgentId"))
    meta = _turns(spark, sf_dir).select("conv_id").distinct().select("conv_id", F.parse_json(F.to_json(F.struct(F.when(conv % 3 != 2, info).alias("subagentInfo"), F.lit("x").alias("name")))).alias("value"))
    return records.store_identity(meta).drop("value")


#: The title of a conversation in SQL: its first prompt, single-spaced and cut.
_ASKED = """
asked AS (SELECT conv_id, arg_min(trim(regexp_replace(text, '\\s+', ' ', 'g')), turn) AS f FROM conversations WHERE role = 'user' GROUP BY conv_id),
n AS (
  SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, any_value(CASE WHEN length(f) > 100 THEN substr(f, 1, 100) || '…' ELSE f END) AS title
  FROM conversations LEFT JOIN asked USING (conv_id) GROUP BY conv_id HAVING u + a > 0
)
"""
_SUMMED = ["session_key", "n_records", "n_user", "n_assistant", "n_tool", "n_web", "title"]


@query(f"""
WITH {_ASKED} SELECT conv_id::VARCHAR AS session_key, (u + 2 * a)::BIGINT AS n_records, u::BIGINT AS n_user, a::BIGINT AS n_assistant, a::BIGINT AS n_tool, 0::BIGINT AS n_web, coalesce(title, '') AS title FROM n
""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a summary row for each lossy export."""
    return aggregates.session_summary(_exports(spark, sf_dir)).select(*_SUMMED)


@query(f"""
WITH {_ASKED} SELECT 'chat-' || conv_id AS session_key, (u + 3 * a)::BIGINT AS n_records, u::BIGINT AS n_user, a::BIGINT AS n_assistant, a::BIGINT AS n_tool, 0::BIGINT AS n_web, coalesce(title, '') AS title FROM n
""")
def chat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a summary row for each chat store."""
    return aggregates.session_summary(_chats(spark, sf_dir)).select(*_SUMMED)
