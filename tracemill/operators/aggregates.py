"""Summaries and tallies (A1-A18), all by grouped aggregates with map-side partials."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import short_title, single_spaced
from tracemill.operators.accumulate import Rules
from tracemill.operators.joins import overridden
from tracemill.operators.records import META, at, content_text, effective_title, message_columns, notice_label, rollout_identity

#: Kinds of web tools.
WEB_TOOLS = ("web_search", "web_fetch", "webfetch", "websearch")


def session_summary(events: DataFrame) -> DataFrame:
    """One row for each session_key of events (session_key, seq, kind, ts, text, model, cwd, name).

    The title is the first user text, the model the smallest name, cwd the last one given.
    """
    is_kind = lambda k: F.count_if(F.col("kind") == k)
    user = F.col("kind") == "user"
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    return events.groupBy("session_key").agg(
        F.count("*").alias("n_records"), is_kind("user").alias("n_user"), is_kind("assistant").alias("n_assistant"), is_kind("tool").alias("n_tool"),
        F.count_if((F.col("kind") == "tool") & F.lower("name").isin(*WEB_TOOLS)).alias("n_web"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("model").alias("model"), F.max_by("cwd", at("cwd")).alias("cwd"),
        F.coalesce(short_title(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("seq")))), F.lit("")).alias("title"),
    )


#: How a project-tree log's records, as ``tree_fields`` gives them, make its summary.
TREE = Rules("session_key", "seq", {
    "n_records": ("sum", "one"), "n_user": ("sum", "user"), "n_assistant": ("sum", "reply"), "n_tool": ("sum", "calls"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts"), "model": ("min", "model"),
    "cwd": ("last", "cwd"), "git_branch": ("last", "git_branch"), "version": ("last", "version"), "ai_title": ("last", "ai_title"), "claude_title": ("last", "claude_title"), "agent_name": ("last", "agent_name"), "first_prompt": ("first", "first"),
})
#: The same of rollouts, by ``rollout_fields``; a log's own description is that of its first session records.
ROLLOUT = Rules("session_key", "seq", {
    "n_records": ("sum", "one"), "n_tool": ("sum", "tool"), "n_reasoning": ("sum", "thought"), "n_web": ("sum", "web"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts"), "model": ("first", "model"),
    **{n: ("first", n) for n in META.values()},
}, {"n_user": "user", "n_assistant": "assistant"})


def tree_fields(raw: DataFrame, *more: str) -> DataFrame:
    """What a summary reads of project-tree records (session_key, seq, value, is_subagent, more...): a narrow row for each, without its content."""
    kind, text = at("type"), content_text(F.try_variant_get("value", "$.message.content", "variant"))
    side, meta = (F.coalesce(at(c, "boolean"), F.lit(False)) for c in ("isSidechain", "isMeta"))
    own = F.coalesce(text, F.lit("")) != ""
    asked = (kind == "user") & ~meta & own & notice_label(text).isNull() & (~side | F.col("is_subagent"))
    prompt = content_text(F.try_variant_get("value", "$.attachment.prompt", "variant"))
    queued = (kind == "attachment") & (at("attachment.type") == "queued_command") & (F.coalesce(prompt, F.lit("")) != "") & notice_label(prompt).isNull() & ~side
    calls = F.size(F.filter(F.try_variant_get("value", "$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"))
    shown = short_title(F.regexp_replace(text, "<[^>]+>", " "))
    first = F.when((kind == "user") & ~meta & ~side & own & notice_label(text).isNull(), shown)
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    given = lambda c: F.nullif(c, F.lit(""))
    return raw.select(
        "session_key", "seq", F.lit(1).cast("long").alias("one"), at("timestamp").alias("ts"), count(asked | queued).alias("user"), count(kind == "assistant").alias("reply"), F.when(kind == "assistant", F.coalesce(calls, F.lit(0))).cast("long").alias("calls"),
        F.when(kind == "assistant", at("message.model")).alias("model"), given(at("cwd")).alias("cwd"), given(at("gitBranch")).alias("git_branch"), given(at("version")).alias("version"), given(first).alias("first"),
        F.when(kind == "ai-title", given(at("aiTitle"))).alias("ai_title"), F.when(kind == "custom-title", given(at("customTitle"))).alias("claude_title"), F.when(kind == "agent-name", given(at("agentName"))).alias("agent_name"), *more,
    )


def tree_finish(sums: DataFrame) -> DataFrame:
    """Summaries of what ``TREE`` gathers: texts are never null, the title is the best there is."""
    out = sums.na.fill("", ["model", "cwd", "git_branch", "version", "ai_title", "claude_title", "agent_name"])
    return out.withColumn("title", effective_title(F.col("claude_title"), F.col("first_prompt"), F.col("ai_title"), F.lit("(untitled session)"))).drop("first_prompt")


def tree_summary(raw: DataFrame) -> DataFrame:
    """One row for each project-tree log of raw records (session_key, seq, value, is_subagent): counts, the latest place and titles.

    Users' own texts and queued prompts count, notices don't; a side chain's count in a sub-agent's log only.
    """
    return tree_finish(TREE.aggregate(tree_fields(raw)))


def rollout_fields(raw: DataFrame) -> DataFrame:
    """What a summary reads of rollout records (session_key, seq, value): a narrow row for each, messages by a hash of their text."""
    kind, sub = at("type"), at("payload.type")
    is_item, is_event = kind == "response_item", kind == "event_msg"
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    role, text, mirror = message_columns()
    return raw.select(
        "session_key", "seq", F.lit(1).cast("long").alias("one"), at("timestamp").alias("ts"), count(is_item & sub.isin("function_call", "custom_tool_call")).alias("tool"), count((is_item & (sub == "reasoning")) | (is_event & (sub == "agent_reasoning"))).alias("thought"),
        count((is_item & (sub == "web_search_call")) | (is_event & (sub == "web_search_end"))).alias("web"), F.when(kind == "turn_context", at("payload.model")).alias("model"), *(F.when(kind == "session_meta", at(f"payload.{k}")).alias(n) for k, n in META.items()),
        role.alias("role"), F.when(role.isNotNull(), F.xxhash64(single_spaced(text))).alias("message"), mirror.alias("mirror"),
    )


def rollout_finish(sums: DataFrame, threads: DataFrame) -> DataFrame:
    """Summaries of what ``ROLLOUT`` gathers, with the fields of the threads' rows over their own."""
    known = rollout_identity(sums).na.fill("", ["model"]).withColumn("ai_title", F.lit(None).cast("string"))
    return overridden(known, threads, "session_key", [c for c in ("ai_title", "cwd") if c in threads.columns])


def rollout_summary(raw: DataFrame, threads: DataFrame) -> DataFrame:
    """One row for each rollout of raw records: counts, the first session record's fields, the thread's row over them.

    A message that is there both as a mirror and as an envelope counts once (``multiset_count``). threads: session_key and any
    of ai_title, cwd.
    """
    return rollout_finish(ROLLOUT.aggregate(rollout_fields(raw)), threads)


def tallies(rows: DataFrame, by: list[str], column: Column, values: list[str]) -> DataFrame:
    """Per group, how many rows have each of some values."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_all"), *(F.count_if(column == v).alias(f"n_{v}") for v in values))


def multiset_count(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per ``by``, the size of two multisets without their common part: sum of a, of b, less the smaller of both."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(a, "_a").join(count(b, "_b"), keys, "full").na.fill(0, ["_a", "_b"])
    return both.groupBy(*by).agg(F.sum(F.col("_a") + F.col("_b") - F.least("_a", "_b")).alias("n"))


def facet_values(rows: DataFrame, value: str, family: Column) -> DataFrame:
    """Distinct values with their family and how many rows each has."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value"), family.alias("family")).agg(F.count("*").alias("n"))


def children_per_parent(sessions: DataFrame, visible: DataFrame) -> DataFrame:
    """A10: sub-agents of each visible parent file."""
    return sessions.where("is_subagent").join(visible.select(F.col("file").alias("parent_file")), "parent_file", "left_semi").groupBy("parent_file").agg(F.count("*").alias("n_children"))


def turn_fold(segments: DataFrame, by: list[str], order: str, anchor: Column, fields: list[str], kind: str) -> DataFrame:
    """Per segment with an anchor, the last value of each field, the last anchor's order, and its sorted distinct kinds."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    out = segments.groupBy(*by).agg(F.max(F.when(anchor, F.col(order))).alias("anchor"), *map(last, fields), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))
    return out.where("anchor is not null")


def conversion_report(records: DataFrame, by: list[str]) -> DataFrame:
    """Per session, records by type, calls without an output, encrypted reasoning."""
    n = lambda t: F.count_if(F.col("record_type") == t)
    return records.groupBy(*by).agg(
        F.count("*").alias("n_records"), n("message").alias("n_messages"), n("reasoning").alias("n_reasoning"), F.count_if(F.col("encrypted")).alias("n_encrypted"),
        (n("function_call") - n("function_call_output")).alias("n_unfinished"),
    )


def first_seen(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Per session, distinct values in the order first seen, comma-joined."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_at"))
    listed = F.sort_array(F.collect_list(F.struct("_at", value)))
    return firsts.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[value]), ",").alias("values"))


def index_status(listed: DataFrame, indexed: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Totals over all sessions: listed, indexed as they are, stale, missing, and whether all is done."""
    a, b = listed.select(key, F.col(fingerprint).alias("_a"), F.lit(1).alias("_l")), indexed.select(key, F.col(fingerprint).alias("_b"), F.lit(1).alias("_i"))
    both = a.join(b, key, "full")
    there, done = F.col("_l").isNotNull(), F.col("_i").isNotNull()
    counts = both.agg(F.count_if(there).alias("total"), F.count_if(there & done & F.col("_a").eqNullSafe(F.col("_b"))).alias("indexed"), F.count_if(there & done & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("stale"), F.count_if(there & ~done).alias("missing"), F.count_if(~there).alias("vanished"))
    return counts.withColumn("state", F.when(F.col("total") == F.col("indexed"), "ready").otherwise("updating"))


def content_fingerprint(rows: DataFrame, by: list[str], row: str, data: str) -> DataFrame:
    """How many rows there are, the last, and their total and largest size."""
    size = F.octet_length(data).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.max(row).alias("last_row"), F.sum(size).alias("total_bytes"), F.max(size).alias("largest_bytes"))


def capture_status(captures: DataFrame) -> DataFrame:
    """Per source, files, flagged files and those deleted."""
    return captures.groupBy("source").agg(F.count("*").alias("n_files"), F.count_if(F.size("flags") > 0).alias("n_flagged"), F.count_if(F.col("status") == "deleted").alias("n_deleted"))


def open_failures(changes: DataFrame, source: str, key: str, order: str) -> DataFrame:
    """(source, n_open, since) of access changes (source, key, order, change): files whose last change is a loss, and the first such loss."""
    last = changes.groupBy(source, key).agg(F.max_by("change", order).alias("_c"), F.max(order).alias("_at"))
    return last.where("_c = 'access_lost'").groupBy(source).agg(F.count("*").alias("n_open"), F.min("_at").alias("since"))


def digest_totals(prompts: DataFrame) -> DataFrame:
    """Sessions and prompts of a digest."""
    return prompts.agg(F.countDistinct("session_key").alias("n_sessions"), F.count("*").alias("n_prompts"))


def faceted_counts(sessions: DataFrame, agent: str, others: Column) -> DataFrame:
    """Sessions by agent under every filter but the agent's own, and the total as ``all``."""
    rolled = sessions.where(others).rollup(agent).agg(F.count("*").alias("n"), F.grouping(agent).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(agent)).alias("agent"), "n")


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
