"""Digests, transcripts and conversion to another log format."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.times import local_day, local_minute


def _listed(order: str, line: Column, fine: Column | None = None) -> Column:
    row = F.struct(order, line.alias("_line"))
    return F.transform(F.sort_array(F.collect_list(row if fine is None else F.when(fine, row))), lambda x: x["_line"])


def prompt_text(blocks: Column) -> Column:
    """Texts of an array<struct<type, text>> of blocks, and a mark for images."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    mark = F.when(F.exists(blocks, lambda b: b["type"] == "image"), F.array(F.lit("[image attached]"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(texts, mark), "\n")


def prompt_digest(events: DataFrame) -> DataFrame:
    """(session_key, n_prompts, markdown): the user's prompts of each session, quoted, in order."""
    prompts = events.where((F.col("kind") == "user") & (F.trim("text") != ""))
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    body = F.array_join(_listed("seq", quoted), "\n\n")
    return prompts.groupBy("session_key").agg(F.count("*").alias("n_prompts"), body.alias("_b")).select("session_key", "n_prompts", F.concat(F.lit("## Session "), F.col("session_key").cast("string"), F.lit("\n\n"), "_b").alias("markdown"))


def transcript(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(session_key, transcript): events of the kinds, each under its kind in capitals."""
    shown = events.where(F.col("kind").isin(*kinds))
    return shown.groupBy("session_key").agg(F.array_join(_listed("seq", F.concat(F.upper("kind"), F.lit(":\n"), F.coalesce("text", F.lit("")))), "\n\n").alias("transcript"))


# How transcripts and digests name kinds and agents, and the model of records that no model wrote.
KIND_LABELS = {"user": "User", "assistant": "Assistant", "reasoning": "Reasoning", "tool": "Tool"}
AGENT_LABELS = {"claude": "Claude", "codex": "Codex", "cursor": "Cursor", "opencode": "opencode"}
NO_MODEL = "<synthetic>"


def _named(labels: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[c], c, F.lit(""))


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or nulls where it isn't there; empty texts are nulls."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    return F.nullif(F.col(name), F.lit("")) if kind == "string" else F.col(name)


def call_lines(value: Column) -> Column:
    """The arguments of a tool call (VARIANT) as lines: a text's own, an object's as ``name: value`` by name."""
    pairs = F.map_entries(F.try_variant_get(value, "$", "map<string,string>"))
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(text, F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n"))


def transcript_documents(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_key, transcript): each session of ``sessions`` (session_key, title, cwd, model) that has any events as one plain text.

    events: session_key, seq, block, kind, text, and any of model, phase, status, name, input (VARIANT), n_images, fork and branch.
    User and assistant messages, reasoning and tool calls are shown, results and other kinds aren't. Each has a header with its
    model, phase and status. branch numbers the abandoned branches of a fork, the seq after which they stand; such a group comes
    under a heading of its own there, and its events say so.
    """
    kind, branch = F.col("kind"), _given(events, "branch", "int")
    shown = events.where(kind.isin(*KIND_LABELS)).withColumn("_branch", branch).withColumn("_fork", F.when(F.col("_branch").isNotNull(), _given(events, "fork", "long")))
    details = F.array_compact(F.array(F.nullif(_given(events, "model"), F.lit(NO_MODEL)), _given(events, "phase"), _given(events, "status"), F.when(F.col("_branch").isNotNull(), "abandoned branch")))
    head = F.concat_ws(" · ", F.concat(F.lit("## "), _named(KIND_LABELS, kind)), details)
    called = F.when(kind == "tool", F.concat(F.lit("Tool: "), F.coalesce(_given(events, "name"), F.lit("tool"))))
    given = F.when(kind == "tool", F.nullif(call_lines(F.col("input")), F.lit(""))) if "input" in events.columns else F.lit(None).cast("string")
    images = F.array_repeat(F.lit("[image]"), F.coalesce(_given(events, "n_images", "int"), F.lit(0)))
    lines = F.array_join(F.concat(F.array_compact(F.array(head, _given(events, "text"), called, given)), images), "\n")
    place = F.struct(F.coalesce("_fork", F.col("seq").cast("long")).alias("at"), F.coalesce("_branch", F.lit(0)).alias("branch"), F.col("seq").cast("long").alias("seq"), F.col("block").cast("long").alias("block"), lines.alias("line"))
    # a group's heading stands before its first event
    heading = F.concat(F.lit("## Abandoned branch "), F.col("branch").cast("string"))
    listed = shown.select("session_key", place.alias("p"))
    groups = listed.select("session_key", "p.at", "p.branch").where("branch > 0").distinct()
    headings = groups.select("session_key", F.struct("at", "branch", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("block"), heading.alias("line")).alias("p"))
    body = listed.unionByName(headings).groupBy("session_key").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    # a blank line ends each event, but no heading
    text = F.array_join(F.transform("ps", lambda x: F.concat(x["line"], F.when(x["seq"] < 0, F.lit("")).otherwise("\n"))), "\n")
    named = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(F.col(c), F.lit("")))
    top = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled session)"))), named("Project", "cwd"), named("Model", "model"), F.concat(F.lit("Session: "), F.col("session_key").cast("string")))
    return sessions.join(body, "session_key").select("session_key", F.concat(F.rtrim(F.regexp_replace(F.concat(top, F.lit("\n\n"), text), r"\s+\z", "")), F.lit("\n")).alias("transcript"))


def prompt_sections(prompts: DataFrame, sessions: DataFrame, since: str | None = None, through: str | None = None) -> DataFrame:
    """(session_key, n_prompts, markdown): a section for each session that has prompts within the days, with its head lines.

    prompts: session_key, seq, ts, text, abandoned. sessions: session_key, agent, title, cwd, git_branch, last_ts, is_subagent; only
    listed ones that are no sub-agents count. Days are those of the session zone; a prompt without a time counts when no day is asked for.
    """
    ts = lambda c: F.try_to_timestamp(F.col(c).cast("string"))
    day, minute = local_day(ts("ts")), local_minute(ts("ts"))
    asked = prompts.where(F.trim("text") != "").withColumn("_day", day)
    if since:
        asked = asked.where(F.col("_day") >= since)
    if through:
        asked = asked.where(F.col("_day") <= through)
    when = F.concat(F.coalesce(F.concat_ws(" ", "_day", minute), F.lit("")), F.lit(""))
    line = F.concat(F.lit("### "), F.coalesce(F.nullif(when, F.lit("")), F.lit("undated")), F.when(F.coalesce("abandoned", F.lit(False)), " (abandoned branch)").otherwise(""), F.lit("\n\n"), F.trim("text"), F.lit("\n"))
    body = asked.groupBy("session_key").agg(F.count("*").alias("n_prompts"), F.array_join(_listed("seq", line), "\n").alias("_body"))
    last = F.concat(F.lit("- Last active: "), local_day(ts("last_ts")), F.lit(" "), local_minute(ts("last_ts")))
    named = lambda label, c: F.concat(F.lit(f"- {label}: "), F.nullif(F.col(c), F.lit("")))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("(untitled session)"))
    top = F.concat_ws("\n", F.concat(F.lit("## ["), _named(AGENT_LABELS, F.col("agent")), F.lit("] "), title), named("Project", "cwd"), named("Branch", "git_branch"), last, F.concat(F.lit("- Session: "), F.col("session_key").cast("string")), F.concat(F.lit("- Prompts: "), F.col("n_prompts").cast("string")))
    listed = sessions.where(~F.coalesce("is_subagent", F.lit(False)))
    return listed.join(body, "session_key").select("session_key", "n_prompts", F.concat(top, F.lit("\n\n"), "_body").alias("markdown"))


def digest_head(sections: DataFrame, since: str | None = None, through: str | None = None) -> DataFrame:
    """(n_sessions, n_prompts, markdown): the digest's first lines, which its sections follow in the order that is wanted."""
    span = f"{since} to {through}" if since and through else f"since {since}" if since else f"through {through}" if through else "all time"
    counts = sections.agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("n_prompts"), F.lit(0)).cast("long").alias("n_prompts"))
    text = F.concat(F.lit(f"# My prompts, {span}\n\n"), F.col("n_prompts").cast("string"), F.lit(" prompts across "), F.col("n_sessions").cast("string"), F.lit(" sessions. Each `##` is one session; each `###` is one prompt with its local date and time.\n"))
    return counts.select("n_sessions", "n_prompts", text.alias("markdown"))


def rollout_records(events: DataFrame, mirrors: bool = True) -> DataFrame:
    """(session_key, line, record_type, role, text, call_id, encrypted) of events (session_key, seq, block, kind, text[, label, name, call_id, result]).

    Every message is a record, instructions being a developer's; mirrors: user and assistant messages come again as events.
    Reasoning keeps whether it is encrypted; a tool call has its output after it, if there is a result.
    """
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    kind, none = F.col("kind"), F.lit(None).cast("string")
    item = lambda sub, record, role, text, call, encrypted=F.lit(False): F.struct(F.lit(sub).alias("sub"), F.lit(record).alias("record_type"), role.alias("role"), text.alias("text"), call.alias("call_id"), encrypted.alias("encrypted"))
    role = F.when(kind == "instructions", "developer").otherwise(kind)
    made = F.array(
        F.when(kind.isin("user", "assistant", "instructions"), item(0, "message", role, F.col("text"), none)), F.when(kind.isin("user", "assistant") & F.lit(mirrors), item(1, "event", kind, F.col("text"), none)),
        F.when(kind == "reasoning", item(0, "reasoning", none, F.col("text"), none, F.coalesce(has("label") == "encrypted", F.lit(False)))),
        F.when(kind == "tool", item(0, "function_call", none, has("name"), has("call_id"))), F.when((kind == "tool") & has("result").isNotNull(), item(1, "function_call_output", none, has("result"), has("call_id"))),
    )
    block = F.col("block") if "block" in events.columns else F.lit(0)
    rows = events.select("session_key", "seq", block.alias("_block"), F.explode(F.array_compact(made)).alias("_r")).select("session_key", "seq", "_block", "_r.*")
    line = F.row_number().over(Window.partitionBy("session_key").orderBy("seq", "_block", "sub")) - 1
    return rows.withColumn("line", line).drop("seq", "_block", "sub")


def write_rollouts(records: DataFrame, path: str) -> None:
    """One JSON line for each record (session_key, day, line, ts, record_type, payload VARIANT), in folders by day and session."""
    value = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.col("record_type").alias("type"), "payload"))
    rows = records.select("day", "session_key", "line", value.alias("value")).repartition("day", "session_key").sortWithinPartitions("day", "session_key", "line")
    rows.drop("line").write.partitionBy("day", "session_key").text(path)
