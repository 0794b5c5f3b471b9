"""Queries over sessions: summaries, facets, order, unions, digests, conversion, quality."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import short_title, strip_tags
from tracemill.functions.values import model_family
from tracemill.operators import aggregates, convert, facets, joins, quality, records, sets, windows
from tracemill.plans.registry import FLAT, LOG, TURNS, log, query, table, turns

_SHORT = "CASE WHEN length({0}) > 100 THEN substr({0}, 1, 100) || '…' ELSE {0} END"


@query(f"""
WITH {TURNS}, flat AS (SELECT *, {FLAT.format("text")} AS f FROM turns)
SELECT session_key, count(*)::BIGINT AS n_records, count(*) FILTER (kind = 'user')::BIGINT AS n_user,
       count(*) FILTER (kind = 'assistant')::BIGINT AS n_assistant, count(*) FILTER (kind = 'tool')::BIGINT AS n_tool, 0::BIGINT AS n_web,
       min(seq)::BIGINT AS first_ts, max(seq)::BIGINT AS last_ts, min('m' || (seq % 3)) FILTER (kind = 'assistant') AS model, arg_max('/w/' || seq, seq) FILTER (seq % 2 = 0) AS cwd,
       coalesce(arg_min({_SHORT.format("f")}, seq) FILTER (kind = 'user' AND text IS NOT NULL), '') AS title
FROM flat GROUP BY session_key
""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row for each conversation."""
    seq = F.col("seq")
    model, cwd = F.when(F.col("kind") == "assistant", F.concat(F.lit("m"), (seq % 3).cast("string"))), F.when(seq % 2 == 0, F.concat(F.lit("/w/"), seq.cast("string")))
    return aggregates.session_summary(turns(spark, sf_dir).withColumns({"ts": seq, "model": model, "cwd": cwd, "name": F.lit(None).cast("string")}))


@query(f"""
WITH {LOG}
SELECT user_id, count(*)::BIGINT AS n_all, count(*) FILTER (event_type = 'view')::BIGINT AS n_view, count(*) FILTER (event_type = 'click')::BIGINT AS n_click,
       count(*) FILTER (event_type = 'purchase')::BIGINT AS n_purchase, count(*) FILTER (event_type = 'error')::BIGINT AS n_error,
       count(*) FILTER (event_type = 'signup')::BIGINT AS n_signup
FROM log GROUP BY user_id
""")
def summary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of event types by user."""
    return aggregates.tallies(log(spark, sf_dir), ["user_id"], F.col("event_type"), ["view", "click", "purchase", "error", "signup"])


@query("""
SELECT coalesce(lang, 'all') AS agent, count(*)::BIGINT AS n FROM documents
WHERE n_chars >= 500 AND source IN ('src1', 'src2', 'src3', 'src4') GROUP BY ROLLUP (lang)
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language under the other filters, and all of them."""
    docs = table(spark, sf_dir, "documents")
    return aggregates.faceted_counts(docs, "lang", (F.col("n_chars") >= 500) & facets.in_set("source", ["src1", "src2", "src3", "src4"]))


@query("""
SELECT source AS value, 'Other' AS family, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY source
""")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources, with the model family that their names tell."""
    docs = table(spark, sf_dir, "documents")
    return aggregates.facet_values(docs, "source", model_family(F.col("source")))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events
WHERE ts::DATE BETWEEN (SELECT min(ts)::DATE + 3 FROM events) AND (SELECT min(ts)::DATE + 9 FROM events) GROUP BY ALL
""")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one week, by local day and type."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("d")).scalar()
    day = F.to_date("ts")
    return events.where((day >= F.date_add(first, 3)) & (day <= F.date_add(first, 9))).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""
WITH s AS (
  SELECT conv_id AS id, count(*) * 1000 + conv_id % 97 AS recency, conv_id % 3 <> 0 AS is_subagent,
         CASE WHEN conv_id % 3 <> 0 THEN conv_id - conv_id % 3 END AS parent_id
  FROM conversations GROUP BY conv_id
),
r AS (
  SELECT s.id, s.recency, p.id IS NOT NULL AS nested, coalesce(p.recency, s.recency) AS top, coalesce(p.id, s.id) AS top_id, p.recency AS parent_recency
  FROM s LEFT JOIN s p ON s.parent_id = p.id AND NOT p.is_subagent
)
SELECT id, nested, row_number() OVER (ORDER BY top DESC, top_id, nested, recency DESC, id)::BIGINT AS place, parent_recency FROM r
""")
def hierarchy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by recency, children right after their parents."""
    counts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    child = F.col("id") % 3 != 0
    sessions = counts.select("id", (F.col("n") * 1000 + F.col("id") % 97).alias("recency"), child.alias("is_subagent"), F.when(child, F.col("id") - F.col("id") % 3).alias("parent_id"))
    linked = joins.with_parent(sessions, "id", "parent_id", ["recency"])
    placed = facets.hierarchy(linked.drop("parent_recency")).join(linked.select("id", "parent_recency"), "id")
    return placed.select("id", "nested", "place", "parent_recency")


@query("""
SELECT conv_id - conv_id % 3 AS parent_file, count(DISTINCT conv_id)::BIGINT AS n_children FROM conversations
WHERE conv_id % 3 <> 0 AND conv_id - conv_id % 3 IN (SELECT conv_id FROM conversations) GROUP BY 1
""")
def subagent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: children of each visible parent."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file")).distinct()
    child = F.col("file") % 3 != 0
    sessions = ids.select("file", child.alias("is_subagent"), F.when(child, F.col("file") - F.col("file") % 3).alias("parent_file"))
    return aggregates.children_per_parent(sessions, sessions.where("not is_subagent"))


@query("""
WITH s AS (
  SELECT doc_id, 0 AS r, source AS title, NULL AS lang FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 1, source || '/b', lang FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 2, source || '/c', upper(lang) FROM documents
)
SELECT doc_id, arg_min(title, r) AS title, arg_min(lang, r) FILTER (lang IS NOT NULL) AS lang FROM s GROUP BY doc_id
""")
def union_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of documents, the first that has one wins; a language that it lacks comes from the next."""
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("lang"))
    b = docs.where("doc_id % 3 = 0").select("doc_id", F.concat("source", F.lit("/b")).alias("title"), "lang")
    c = docs.select("doc_id", F.concat("source", F.lit("/c")).alias("title"), F.upper("lang").alias("lang"))
    return sets.union_by_precedence([a, b, c], "doc_id", ["lang"])


@query("""
SELECT source AS path FROM documents WHERE doc_id % 2 = 0 UNION SELECT source FROM documents UNION SELECT url FROM pages
""")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that any source names."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    path = docs.select(F.col("source").alias("path"))
    return sets.distinct_paths([docs.where("doc_id % 2 = 0").select(F.col("source").alias("path")), path, pages.select(F.col("url").alias("path"))], "path")


@query("""
WITH k AS (SELECT user_id, event_type, event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events)
SELECT user_id, event_type, k, min(event_id)::BIGINT AS event_id FROM k GROUP BY user_id, event_type, k
""")
def distinct_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events of a user and type with the same properties, the first."""
    kept = sets.distinct_json(log(spark, sf_dir).withColumn("props", F.to_json(F.struct("k"))), ["user_id", "event_type"], "event_id", "props")
    return kept.select("user_id", "event_type", "k", "event_id")


@query("""
WITH i AS (SELECT doc_id, doc_id % 7 AS fp FROM documents WHERE doc_id % 5 <> 0),
l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 ELSE doc_id % 7 END AS fp FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT l.doc_id AS a, i.doc_id AS b, l.fp = i.fp AS same FROM l FULL JOIN i USING (doc_id))
SELECT count(a)::BIGINT AS total, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND same)::BIGINT AS indexed,
       count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND NOT same)::BIGINT AS stale, count(*) FILTER (a IS NOT NULL AND b IS NULL)::BIGINT AS missing,
       count(*) FILTER (a IS NULL)::BIGINT AS vanished,
       CASE WHEN count(a) = count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND same) THEN 'ready' ELSE 'updating' END AS state
FROM b
""")
def search_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an index is."""
    docs = table(spark, sf_dir, "documents")
    fp = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 + 1).otherwise(F.col("doc_id") % 7)
    listed = docs.where("doc_id % 11 != 0").select("doc_id", fp.alias("fp"))
    return aggregates.index_status(listed, docs.where("doc_id % 5 != 0").select("doc_id", (F.col("doc_id") % 7).alias("fp")), "doc_id", "fp")


@query(f"""
WITH {TURNS}
SELECT session_key, seq, row_number() OVER (PARTITION BY session_key ORDER BY seq)::BIGINT AS number, substr({FLAT.format("text")}, 1, 80) AS label
FROM turns WHERE kind = 'user'
""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered prompts of each conversation."""
    return windows.outline(turns(spark, sf_dir), ["session_key"], ["seq"], "text", F.col("kind") == "user").select("session_key", "seq", F.col("number").cast("long"), "label")


@query(f"""
WITH {TURNS}, p AS (SELECT session_key, seq, CASE WHEN seq % 3 = 0 THEN text || chr(10) || '[image attached]' ELSE text END AS text FROM turns WHERE kind = 'user')
SELECT session_key, count(*)::BIGINT AS n_prompts,
       '## Session ' || session_key || chr(10) || chr(10) || string_agg('> ' || replace(text, chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY seq) AS markdown
FROM p WHERE trim(text) <> '' GROUP BY session_key
""")
def prompt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's prompts of each conversation as Markdown."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.when(F.col("seq") % 3 == 0, F.array(block("text", F.col("text")), block("image", F.lit(None).cast("string")))).otherwise(F.array(block("text", F.col("text"))))
    return convert.prompt_digest(turns(spark, sf_dir).withColumn("text", convert.prompt_text(blocks)))


@query(f"""
WITH {TURNS}
SELECT count(DISTINCT session_key)::BIGINT AS n_sessions, count(*)::BIGINT AS n_prompts FROM turns WHERE kind = 'user'
""")
def digest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and prompts of the digest."""
    return aggregates.digest_totals(turns(spark, sf_dir).where("kind = 'user'"))


@query(f"""
WITH {TURNS}
SELECT session_key, string_agg(upper(kind) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY seq) AS transcript FROM turns
WHERE kind IN ('user', 'assistant') GROUP BY session_key
""")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as plain text."""
    return convert.transcript(turns(spark, sf_dir), ["user", "assistant"])


#: Conversations as events with reasoning and tool calls: each reply is thought about first, and calls a tool, at times without a result.
_WORK = """
work AS (
  SELECT session_key, seq, 1 AS block, kind, text, NULL AS label, NULL AS name, NULL AS call_id, NULL AS result FROM turns
  UNION ALL SELECT session_key, seq, 0, 'reasoning', 'hm', CASE WHEN seq % 2 = 1 THEN 'encrypted' END, NULL, NULL, NULL FROM turns WHERE kind = 'assistant'
  UNION ALL SELECT session_key, seq, 2, 'tool', NULL, NULL, 'Bash', 'c' || seq, CASE WHEN seq % 4 <> 3 THEN 'out ' || seq END FROM turns WHERE kind = 'assistant'
),
rec AS (
  SELECT session_key, seq, block, 0 AS sub, 'message' AS record_type, CASE kind WHEN 'instructions' THEN 'developer' ELSE kind END AS role, text, NULL AS call_id, false AS encrypted FROM work WHERE kind IN ('user', 'assistant', 'instructions')
  UNION ALL SELECT session_key, seq, block, 1, 'event', kind, text, NULL, false FROM work WHERE kind IN ('user', 'assistant')
  UNION ALL SELECT session_key, seq, block, 0, 'reasoning', NULL, text, NULL, label IS NOT NULL FROM work WHERE kind = 'reasoning'
  UNION ALL SELECT session_key, seq, block, 0, 'function_call', NULL, name, call_id, false FROM work WHERE kind = 'tool'
  UNION ALL SELECT session_key, seq, block, 1, 'function_call_output', NULL, result, call_id, false FROM work WHERE kind = 'tool' AND result IS NOT NULL
)
"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, seq = F.lit(None).cast("string"), F.col("seq")
    event = lambda block, kind, text, label=none, name=none, call=none, result=none: F.struct(F.lit(block).alias("block"), kind.alias("kind"), text.alias("text"), label.alias("label"), name.alias("name"), call.alias("call_id"), result.alias("result"))
    reply = F.col("kind") == "assistant"
    number = seq.cast("string")
    made = F.array(
        event(1, F.col("kind"), F.col("text")), F.when(reply, event(0, F.lit("reasoning"), F.lit("hm"), F.when(seq % 2 == 1, "encrypted"))),
        F.when(reply, event(2, F.lit("tool"), none, none, F.lit("Bash"), F.concat(F.lit("c"), number), F.when(seq % 4 != 3, F.concat(F.lit("out "), number)))),
    )
    return turns(spark, sf_dir).select("session_key", "seq", F.explode(F.array_compact(made)).alias("e")).select("session_key", "seq", "e.*")


@query(f"""
WITH {TURNS}, {_WORK}
SELECT session_key, (row_number() OVER (PARTITION BY session_key ORDER BY seq, block, sub) - 1)::BIGINT AS line, record_type, role, text, call_id, encrypted FROM rec
""")
def rollout_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of another log format, with mirrored event messages, reasoning, calls and outputs."""
    return convert.rollout_records(_work(spark, sf_dir)).select("session_key", F.col("line").cast("long"), "record_type", "role", "text", "call_id", "encrypted")


@query(f"""
WITH {TURNS}, {_WORK}
SELECT session_key, count(*)::BIGINT AS n_records, count(*) FILTER (record_type = 'message')::BIGINT AS n_messages, count(*) FILTER (record_type = 'reasoning')::BIGINT AS n_reasoning, count(*) FILTER (encrypted)::BIGINT AS n_encrypted,
       (count(*) FILTER (record_type = 'function_call') - count(*) FILTER (record_type = 'function_call_output'))::BIGINT AS n_unfinished FROM rec GROUP BY session_key
""")
def rollout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion wrote, by session, with its reasoning, what of it is encrypted, and calls without an output."""
    return aggregates.conversion_report(convert.rollout_records(_work(spark, sf_dir)), ["session_key"])


@query(f"""
WITH {TURNS}, bad AS (
  SELECT session_key, seq, CASE WHEN seq % 5 = 3 THEN 'bogus' ELSE kind END AS kind, CASE WHEN (session_key + seq) % 7 = 0 THEN NULL ELSE text END AS text FROM turns
)
SELECT session_key, seq, unnest(list_filter([CASE WHEN kind NOT IN ('user', 'assistant', 'instructions') THEN 'kind' END,
  CASE WHEN kind IN ('user', 'assistant', 'instructions') AND text IS NULL THEN 'text' END], lambda x: x IS NOT NULL)) AS path
FROM bad WHERE kind = 'bogus' OR text IS NULL
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each violation of the event contract, in conversations with faults put in."""
    kind = F.when(F.col("seq") % 5 == 3, "bogus").otherwise(F.col("kind"))
    text = F.when((F.col("session_key") + F.col("seq")) % 7 == 0, None).otherwise(F.col("text"))
    return quality.violations(turns(spark, sf_dir).withColumns({"kind": kind, "text": text}), ["session_key", "seq"]).select("session_key", "seq", "path")


@query("""
SELECT page_id, lower(regexp_extract(html, '^\\s*<([a-zA-Z0-9_-]+)', 1)) AS tag, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain,
       CASE page_id % 5 WHEN 0 THEN 'Background task' WHEN 1 THEN 'Slash command' WHEN 2 THEN 'System reminder' WHEN 3 THEN 'Hook' END AS label FROM pages
""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag that a page begins with, its text without tags, and what it would be under an injected tag."""
    html, tags = F.col("html"), ("task-notification", "command-name", "system-reminder", "user-prompt-submit-hook", "div")
    tagged = F.concat(F.lit(" <"), F.element_at(F.array(*map(F.lit, tags)), (F.col("page_id") % 5 + 1).cast("int")), F.lit(">"), html)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(records.leading_tag(html)).alias("tag"), strip_tags(html).alias("plain"), records.notice_label(tagged).alias("label"))


@query("""
WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS path FROM pages)
SELECT page_id, trim(path) AS path, count(*)::BIGINT AS n FROM p GROUP BY ALL
""")
def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a text names, by a pattern."""
    pages = table(spark, sf_dir, "pages")
    paths = pages.select("page_id", F.explode(records.paths_named(F.col("html"), r'(?:href|src)="([^"]*)"')).alias("path"))
    return paths.groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT event_id, CASE WHEN event_type = 'view' THEN ['a' || ((props::JSON->>'$.k')), event_type] END AS queries, event_type AS query FROM events)
SELECT event_id, unnest(coalesce(queries, [query])) AS query FROM q
""")
def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: web queries, one a row, from a list or a single one."""
    df = log(spark, sf_dir)
    listed = F.when(F.col("event_type") == "view", F.array(F.concat(F.lit("a"), F.col("k").cast("string")), "event_type"))
    return records.flat_queries(df.select("event_id", listed.alias("queries"), F.col("event_type").alias("query")), ["event_id"])


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS f FROM d)
SELECT doc_id, CASE WHEN length(f) > 100 THEN substr(f, 1, 100) || '…' ELSE f END AS title FROM f
""")
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a title of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", short_title(F.coalesce("text", F.lit(""))).alias("title"))


@query("""
SELECT doc_id, source FROM documents WHERE contains(trim(regexp_replace(lower(concat_ws(' ', source, lang, doc_id::VARCHAR)), '\\s+', ' ', 'g')), 'src1 en')
""")
def metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose metadata hold the query."""
    from tracemill.operators.search import metadata_match as match

    return match(table(spark, sf_dir, "documents"), ["source", "lang", "doc_id"], " SRC1  en").select("doc_id", "source")


@query("""
WITH c AS (SELECT doc_id, text FROM documents WHERE length(trim(text)) > 0), k AS (SELECT item_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 40) AS key FROM benchmark),
f AS (SELECT key, min(item_id) AS item_id FROM k WHERE key <> '' GROUP BY key)
SELECT c.doc_id, f.item_id AS call_item_id FROM c LEFT JOIN f ON substr(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), 1, 40) = f.key
""")
def prefix_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, as sub-agents' prompts, with the first benchmark passage, as a call's prompt, that begins alike in 40 characters."""
    docs, items = table(spark, sf_dir, "documents").where("length(trim(text)) > 0"), table(spark, sf_dir, "benchmark")
    return joins.linked_by_prefix(docs, items, "text", "text", "item_id", ["item_id"], 40).select("doc_id", "call_item_id")


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM d WHERE n = 1
""")
def kept_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return windows.keep_earliest(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("""
SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 20
""")
def largest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty longest documents of each language."""
    return aggregates.ranked(table(spark, sf_dir, "documents"), ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 20).select("doc_id", "source", "n_chars")


#: What a session list tells of each conversation, in both languages.
_LISTED = """
listed AS (
  SELECT DISTINCT conv_id AS session_key, CASE WHEN conv_id % 3 = 0 THEN 'claude' WHEN conv_id % 3 = 1 THEN 'codex' ELSE 'other' END AS agent, CASE WHEN conv_id % 4 <> 0 THEN 'T ' || conv_id END AS title,
         '/w/' || conv_id % 5 AS cwd, CASE WHEN conv_id % 2 = 0 THEN 'main' END AS git_branch, '2025-02-0' || (1 + conv_id % 9) || ' 10:30' AS last_minute, conv_id % 7 = 6 AS is_subagent FROM conversations
)
"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    agent = F.when(conv % 3 == 0, "claude").when(conv % 3 == 1, "codex").otherwise("other")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        conv.alias("session_key"), agent.alias("agent"), F.when(conv % 4 != 0, F.concat(F.lit("T "), conv.cast("string"))).alias("title"), F.concat(F.lit("/w/"), (conv % 5).cast("string")).alias("cwd"),
        F.when(conv % 2 == 0, "main").alias("git_branch"), F.concat(F.lit("2025-02-0"), (1 + conv % 9).cast("string"), F.lit("T10:30:00Z")).alias("last_ts"), (conv % 7 == 6).alias("is_subagent"), F.lit("m-one").alias("model"),
    )


@query(f"""
WITH {TURNS}, {_LISTED},
p AS (SELECT session_key, seq, trim(text) AS text, CASE WHEN seq % 4 = 0 THEN '2025-01-0' || (1 + seq % 9) || ' 08:05' ELSE 'undated' END AS moment, (session_key + seq) % 5 = 2 AS abandoned FROM turns WHERE kind = 'user' AND trim(text) <> ''),
body AS (SELECT session_key, count(*) AS n, string_agg('### ' || moment || CASE WHEN abandoned THEN ' (abandoned branch)' ELSE '' END || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY seq) AS body FROM p GROUP BY session_key)
SELECT session_key, n::BIGINT AS n_prompts, '## [' || CASE agent WHEN 'claude' THEN 'Claude' WHEN 'codex' THEN 'Codex' ELSE agent END || '] ' || coalesce(title, '(untitled session)') || chr(10) || '- Project: ' || cwd || chr(10)
       || CASE WHEN git_branch IS NULL THEN '' ELSE '- Branch: ' || git_branch || chr(10) END || '- Last active: ' || last_minute || chr(10) || '- Session: ' || session_key || chr(10) || '- Prompts: ' || n || chr(10) || chr(10) || body AS markdown
FROM listed JOIN body USING (session_key) WHERE NOT is_subagent
""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each listed session in the digest of prompts."""
    ts = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("2025-01-0"), (1 + F.col("seq") % 9).cast("string"), F.lit("T08:05:00Z")))
    prompts = turns(spark, sf_dir).where("kind = 'user'").select("session_key", "seq", "text", ts.alias("ts"), ((F.col("session_key") + F.col("seq")) % 5 == 2).alias("abandoned"))
    return convert.prompt_sections(prompts, _listed(spark, sf_dir))


@query(f"""
WITH {TURNS}, {_LISTED}, p AS (SELECT session_key, count(*) AS n FROM turns WHERE kind = 'user' AND trim(text) <> '' AND seq % 4 = 0 AND 1 + seq % 9 >= 5 GROUP BY session_key)
SELECT count(*)::BIGINT AS n_sessions, coalesce(sum(n), 0)::BIGINT AS n_prompts,
       '# My prompts, since 2025-01-05' || chr(10) || chr(10) || coalesce(sum(n), 0)::BIGINT || ' prompts across ' || count(*) || ' sessions. Each `##` is one session; each `###` is one prompt with its local date and time.' || chr(10) AS markdown
FROM p JOIN listed USING (session_key) WHERE NOT is_subagent
""")
def digest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the digest of prompts since a day."""
    ts = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("2025-01-0"), (1 + F.col("seq") % 9).cast("string"), F.lit("T08:05:00Z")))
    prompts = turns(spark, sf_dir).where("kind = 'user'").select("session_key", "seq", "text", ts.alias("ts"), F.lit(False).alias("abandoned"))
    return convert.digest_head(convert.prompt_sections(prompts, _listed(spark, sf_dir), "2025-01-05"), "2025-01-05")


@query(f"""
WITH {TURNS}, {_LISTED}, {_WORK},
shown AS (
  SELECT *, CASE WHEN seq IN (2, 3) AND session_key % 3 = 1 THEN 1 WHEN seq = 4 AND session_key % 3 = 1 THEN 2 END AS branch FROM work WHERE kind IN ('user', 'assistant', 'reasoning', 'tool')
),
line AS (
  SELECT session_key, CASE WHEN branch IS NOT NULL THEN 1 ELSE seq END AS spot, coalesce(branch, 0) AS branch, seq, block,
         '## ' || CASE kind WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'reasoning' THEN 'Reasoning' ELSE 'Tool' END || CASE WHEN kind = 'assistant' AND seq % 4 = 1 THEN ' · m-two' ELSE '' END
         || CASE WHEN kind = 'tool' AND seq % 4 = 3 THEN ' · failed' ELSE '' END || CASE WHEN branch IS NOT NULL THEN ' · abandoned branch' ELSE '' END
         || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || text ELSE '' END || CASE WHEN kind = 'tool' THEN chr(10) || 'Tool: Bash' || chr(10) || 'command: run ' || seq || chr(10) || 'timeout: ' || seq ELSE '' END
         || CASE WHEN kind = 'user' AND seq % 4 = 0 THEN chr(10) || '[image]' ELSE '' END || chr(10) AS l FROM shown
  UNION ALL SELECT DISTINCT session_key, 1, branch, -1, 0, '## Abandoned branch ' || branch FROM shown WHERE branch IS NOT NULL
),
body AS (SELECT session_key, string_agg(l, chr(10) ORDER BY spot, branch, seq, block) AS body FROM line GROUP BY session_key)
SELECT session_key, regexp_replace('# ' || coalesce(title, '(untitled session)') || chr(10) || 'Project: ' || cwd || chr(10) || 'Model: m-one' || chr(10) || 'Session: ' || session_key || chr(10) || chr(10) || body, '\\s+$', '') || chr(10) AS transcript
FROM listed JOIN body USING (session_key)
""")
def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plain texts, with headers, models, failed calls, their arguments, images and abandoned branches."""
    kind, seq = F.col("kind"), F.col("seq")
    odd = F.col("session_key") % 3 == 1
    events = _work(spark, sf_dir).withColumns({
        "model": F.when((kind == "assistant") & (seq % 4 == 1), "m-two").when(kind == "assistant", convert.NO_MODEL), "status": F.when((kind == "tool") & (seq % 4 == 3), "failed"),
        "input": F.when(kind == "tool", F.to_variant_object(F.struct(seq.alias("timeout"), F.concat(F.lit("run "), seq.cast("string")).alias("command")))), "n_images": F.when((kind == "user") & (seq % 4 == 0), 1),
        "branch": F.when(odd & seq.isin(2, 3), 1).when(odd & (seq == 4), 2), "fork": F.lit(1).cast("long"),
    })
    return convert.transcript_documents(events, _listed(spark, sf_dir))


@query(f"""
WITH {TURNS}, e AS (SELECT session_key, seq % 6 AS c, 'events[' || (row_number() OVER (PARTITION BY session_key ORDER BY seq) - 1) || ']' AS path FROM turns)
SELECT session_key, path || p AS path, problem FROM e JOIN (VALUES
  (1, '.blocks[1]', 'text must be a text'), (1, '.blocks[2]', 'block type is unknown'), (1, '.blocks[3]', 'text of the result is missing'), (2, '', 'kind is unknown'), (3, '', 'input is missing'), (3, '', 'result is missing'),
  (4, '.groups[0][0]', 'text must be a text'), (4, '.groups[1]', 'group is no list'), (4, '.groups[0][1].groups[0][0].blocks[0]', 'block is no object'), (5, '', 'status is unknown')) AS v(k, p, problem) ON c = k
UNION ALL SELECT DISTINCT session_key, 'session', 'agent is unknown' FROM turns WHERE session_key % 3 = 1
UNION ALL SELECT DISTINCT session_key, 'session', 'title must be a text' FROM turns WHERE session_key % 4 = 2
""")
def session_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as whole sessions in JSON, with faults in events, blocks, results, and branches within branches."""
    code, text = F.col("seq") % 6, F.to_json(F.struct(F.col("text").alias("text")))
    fine = F.concat(F.lit('{"kind":"user",'), F.substring(text, 2, 1 << 30))
    event = (
        F.when(code == 0, fine).when(code == 1, F.lit('{"kind":"assistant","blocks":[{"type":"text","text":"a"},{"type":"thinking"},{"type":"odd"},{"type":"tool_use","name":"n","input":null,"result":{"images":[]}}]}'))
        .when(code == 2, F.lit('{"kind":"bogus"}')).when(code == 3, F.lit('{"kind":"tool","name":"n"}'))
        .when(code == 4, F.lit('{"kind":"branch","count":2,"groups":[[{"kind":"user","text":1},{"kind":"branch","count":1,"groups":[[{"kind":"user","blocks":[7]}]]}],"x"]}')).otherwise(F.lit('{"kind":"status","status":"odd"}'))
    )
    events = turns(spark, sf_dir).groupBy("session_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", event.alias("e")))), lambda x: x["e"]), ",").alias("events"))
    key = F.col("session_key")
    head = F.concat(F.lit('{"agent":"'), F.when(key % 3 == 1, "nobody").otherwise("codex"), F.lit('","id":"'), key.cast("string"), F.lit('","title":'), F.when(key % 4 == 2, "null").otherwise('"t"'), F.lit(',"meta":{},"events":['))
    return quality.session_violations(events.select("session_key", F.parse_json(F.concat(head, "events", F.lit("]}"))).alias("value")), "session_key")


@query(f"""
WITH {TURNS}, s AS (SELECT DISTINCT session_key FROM turns)
SELECT session_key, 'summary' AS path, 'cwd is missing' AS problem FROM s WHERE session_key % 5 = 1
UNION ALL SELECT session_key, 'summary', 'agent is unknown' FROM s WHERE session_key % 7 = 3
""")
def summary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in JSON with a field left out, or of an agent that isn't known."""
    key = F.col("session_key")
    given = [F.when((key % 5 == 1), None).otherwise("/w").alias(f) if f == "cwd" else F.when(key % 7 == 3, "x").otherwise("claude").alias(f) if f == "agent" else F.lit(0).alias(f) if f.startswith("n_") else F.lit("v").alias(f) for f in quality.SUMMARY_FIELDS]
    # to_json leaves nulls out
    rows = turns(spark, sf_dir).select("session_key").distinct().select("session_key", F.parse_json(F.to_json(F.struct(*given))).alias("value"))
    return quality.listed_violations(rows, "session_key")
