"""Raw records to events, for the project-tree and rollout layouts and the stores.

A raw record is a row (session_key, seq, value), the JSON as VARIANT. Each record makes an array of events, which one
pass over the records explodes; (seq, block) is an event's place in its session, block counting the events of one record.
Results of tools, and records that only repeat others, meet the events by narrow joins. Records of unknown type come as
kind ``raw``; known bookkeeping is dropped.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import clip, instruction_label, single_spaced
from tracemill.functions.values import image_mime
from tracemill.operators.joins import merged_results
from tracemill.operators.windows import first_and_last, last_kept, occurrences, version_changes

#: Record types that carry nothing to show.
TREE_IGNORED = (
    "atis-latch", "bridge-session", "cost-state", "file-history-delta", "mode", "queue-operation", "session-owner", "summary", "tools-used", "api-request", "api-request-blob",
    "api-request-shape", "agent-name", "ai-title", "custom-title", "last-prompt", "permission-mode", "pr-link", "file-history-snapshot",
)
PART_IGNORED = ("agent", "snapshot", "step-start")
ROLLOUT_IGNORED = ("session_meta", "world_state", "turn_context")
EVENT_IGNORED = (
    "agent_message_delta", "agent_reasoning_delta", "agent_reasoning_raw_content", "agent_reasoning_raw_content_delta", "agent_reasoning_section_break", "context_compacted",
    "exec_command_begin", "exec_command_end", "exec_command_output_delta", "mcp_tool_call_begin", "mcp_tool_call_end", "patch_apply_begin", "patch_apply_end", "session_configured",
    "thread_rolled_back", "thread_settings_applied", "turn_diff",
)
#: Tool names of the IDE and CLI layouts by their common name.
TOOL_NAMES = {
    "run_terminal_command_v2": "Bash", "read_file_v2": "Read", "edit_file_v2": "Edit", "glob_file_search": "Glob", "ripgrep_raw_search": "Grep", "read_lints": "ReadLints",
    "todo_write": "TodoWrite", "delete_file": "Delete", "await": "AwaitShell", "semantic_search_full": "SemanticSearch", "web_search": "WebSearch", "ReadFile": "Read",
    "StrReplace": "Edit", "rg": "Grep", "Await": "AwaitShell", "ApplyPatch": "Edit",
}
#: Names of tool arguments by their common names, for each tool that has other ones.
ARGUMENT_NAMES = {
    "read_file_v2": {"targetFile": "file_path", "effectiveUri": "file_path"}, "edit_file_v2": {"relativeWorkspacePath": "file_path", "targetFile": "file_path"},
    "glob_file_search": {"globPattern": "pattern", "targetDirectory": "path"}, "ripgrep_raw_search": {"query": "pattern"}, "delete_file": {"relativeWorkspacePath": "path"},
    "semantic_search_full": {"targetDirectories": "target_directories"}, "web_search": {"searchTerm": "search_term", "query": "search_term"}, "Shell": {"working_directory": "workdir"},
    "Read": {"path": "file_path"}, "ReadFile": {"path": "file_path"}, "StrReplace": {"path": "file_path"}, "ApplyPatch": {"path": "file_path"}, "Write": {"path": "file_path", "contents": "content"},
    "Glob": {"glob_pattern": "pattern", "target_directory": "path"}, "Await": {"task_id": "shell_id"}, "AwaitShell": {"task_id": "shell_id"}, "WebSearch": {"query": "search_term"},
    "read": {"filePath": "file_path"}, "write": {"filePath": "file_path"}, "edit": {"filePath": "file_path", "oldString": "old_string", "newString": "new_string", "replaceAll": "replace_all"},
    "grep": {"include": "glob"}, "apply_patch": {"patchText": "patch"}, "lsp": {"filePath": "file_path"},
}
#: Labels of injected texts by the tag that they begin with.
NOTICE_LABELS = {
    "task-notification": "Background task", "command-name": "Slash command", "command-message": "Slash command", "command-args": "Slash command", "local-command-stdout": "Command output",
    "local-command-stderr": "Command output", "local-command-caveat": "Command caveat", "system-reminder": "System reminder", "user-prompt-submit-hook": "Hook",
}
#: Inline images up to so many characters are kept.
IMAGE_CHARS = 2_000_000
#: What a record makes of itself, and what its events share.
_ITEM = {
    "block": "int", "kind": "string", "label": "string", "text": "string", "model": "string", "call_id": "string", "name": "string", "input": "variant",
    "result": "string", "is_error": "boolean", "usage": "variant", "payload": "variant",
}
_SHARED = {"uuid": "string", "parent_uuid": "string", "ts": "string", "cwd": "string", "is_sidechain": "boolean"}
EVENT_COLUMNS = ("session_key", "seq", *_ITEM, *_SHARED)


def at(path: str, kind: str = "string", value: str = "value") -> Column:
    """The value at a path of a VARIANT column, null where there is none of the kind."""
    return F.try_variant_get(value, f"$.{path}", kind)


def leading_tag(text: Column) -> Column:
    """The name of the tag that a text begins with; empty without one."""
    return F.regexp_extract(text, r"^\s*<([a-zA-Z0-9_-]+)", 1)


def notice_label(text: Column) -> Column:
    """What an injected text is, by its tag; null for a user's own text."""
    tag, out = leading_tag(text), F.lit(None).cast("string")
    for name, label in NOTICE_LABELS.items():
        out = F.when(tag == name, label).otherwise(out)
    return out


def clean_prompt(text: Column) -> Column:
    """P10: a user's text without time stamps and reminders, and out of its query wrapper."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<timestamp>.*?</timestamp>", ""), r"(?is)<system_reminder>.*?</system_reminder>", "")
    inner = F.regexp_extract(bare, r"(?is)<user_query>(.*?)</user_query>", 1)
    return F.trim(F.regexp_replace(F.when(inner != "", inner).otherwise(bare), r"(?is)</?[a-z_]+>", ""), F.lit(" \n\t\r"))


def is_context_only(text: Column) -> Column:
    """A user message that only tells about the machine."""
    return F.startswith(F.ltrim(text), F.lit("<user_info>"))


def content_text(content: Column) -> Column:
    """The text of a content VARIANT: the string itself, or the texts of its blocks line by line."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.array_compact(F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string").isin("text", "input_text", "output_text"), F.try_variant_get(b, "$.text", "string"))))
    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(texts, "\n")), F.try_variant_get(content, "$", "string"))


def result_text(content: Column) -> Column:
    """A tool result's text: strings, text blocks, marks for images, other parts as JSON of at most 500 characters."""
    blocks = F.try_variant_get(content, "$", "array<variant>")

    def part(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        return F.when(kind.isin("text", "input_text", "output_text"), F.try_variant_get(b, "$.text", "string")).when(kind.isin("image", "input_image"), "[image]").otherwise(clip(F.to_json(b), 500))

    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(F.array_compact(F.transform(blocks, part)), "\n")), F.try_variant_get(content, "$", "string"), F.to_json(content))


def unwrapped_output(text: Column) -> tuple[Column, Column]:
    """The output of a nested JSON result after the last ``Output:``, and whether its exit code tells of an error; else the text."""
    tail = F.try_parse_json(F.trim(F.regexp_replace(text, r"(?s)^.*Output:\s*", "")))
    output = F.try_variant_get(tail, "$.output", "string")
    code = F.coalesce(F.try_variant_get(tail, "$.exit_code", "int"), F.try_variant_get(tail, "$.metadata.exit_code", "int"))
    return F.coalesce(output, text), output.isNotNull() & F.coalesce(code != 0, F.lit(False))


def tool_name(name: Column) -> Column:
    """The common name of a tool of the IDE and CLI layouts; its own if it has none."""
    return F.coalesce(F.try_element_at(_literal(TOOL_NAMES), name), name)


def _literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def tool_input(name: Column, value: Column) -> Column:
    """A tool's arguments (VARIANT) under their common names; an argument of the common name stands before its other name.

    What is no object stays as it is.
    """
    common = _literal({f"{tool}.{own}": name_ for tool, names in ARGUMENT_NAMES.items() for own, name_ in names.items()})
    to = lambda k: F.try_element_at(common, F.concat(F.coalesce(name, F.lit("")), F.lit("."), k))
    given = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    keys = F.transform(given, lambda e: F.coalesce(to(e["key"]), e["key"]))
    # of two arguments that come to one name, the first by its own name
    firsts = F.filter(given, lambda e, i: (F.array_position(keys, F.coalesce(to(e["key"]), e["key"])) == i + 1) & ~(to(e["key"]).isNotNull() & F.exists(given, lambda o: o["key"] == to(e["key"]))) | F.coalesce(F.exists(given, lambda o: to(o["key"]) == e["key"]), F.lit(False)))
    renamed = F.map_from_entries(F.transform(firsts, lambda e: F.struct(F.coalesce(to(e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.to_variant_object(renamed)).otherwise(value)


def review_request(text: Column, marker: str = "Planned action JSON:") -> Column:
    """P20: the VARIANT of the JSON object after the last marker, whatever follows its last brace; null without one."""
    tail = F.element_at(F.split(text, marker), -1)
    inner = F.regexp_replace(F.regexp_replace(tail, r"(?s)^[^{]*", ""), r"(?s)\}[^}]*$", "}")
    return F.when(F.contains(text, F.lit(marker)), F.try_parse_json(inner))


def review_decision(text: Column) -> Column:
    """P20: the VARIANT of a text that is a JSON object with the outcome allow or deny; null for any other."""
    value = F.try_parse_json(text)
    return F.when(F.try_variant_get(value, "$.outcome", "string").isin("allow", "deny"), value)


def image_class(uri: Column, most: int = IMAGE_CHARS) -> Column:
    """How an image is given: inline, omitted for its size, object (a path), or unknown."""
    return (
        F.when(F.startswith(uri, F.lit("data:image/")), F.when(F.length(uri) > most, "omitted").otherwise("inline"))
        .when(image_mime(uri).isNotNull(), "object").otherwise("unknown")
    )


def tool_label(name: Column, value: Column, most: int = 200) -> Column:
    """A line about a tool call: files of a patch, nested calls, the command, or what its arguments tell first.

    An object without a telling argument gives its first key by name, and the first line of its value.
    """
    get = lambda k, kind="string": F.try_variant_get(value, f"$.{k}", kind)
    cut = lambda c, n=most: F.substring(c, 1, n)
    is_text = F.schema_of_variant(value) == "STRING"
    text = F.when(is_text, F.try_variant_get(value, "$", "string"))
    files = paths_named(F.coalesce(text, get("input"), get("patch"), get("raw"), F.lit("")))
    calls = F.array_compact(F.transform(get("calls", "array<variant>"), lambda c: F.try_variant_get(c, "$.name", "string")))
    named = lambda *names: name.isin(*names)
    first = F.element_at(F.map_entries(F.try_variant_get(value, "$", "map<string,string>")), 1)
    line = F.concat(first["key"], F.lit(": "), F.substring(F.split_part(F.coalesce(first["value"], F.lit("null")), F.lit("\n"), F.lit(1)), 1, 160))
    return (
        F.when(named("apply_patch"), F.when(F.size(files) > 0, cut(F.array_join(files, ", "))).otherwise("patch"))
        .when(named("exec") & ~is_text, F.when(F.size(calls) > 0, cut(F.array_join(calls, " · "))).otherwise("orchestration code"))
        .when(is_text, cut(text))
        .when(named("exec_command", "shell"), cut(F.coalesce(get("cmd"), F.lit(""))))
        .when(named("write_stdin"), cut(F.coalesce(get("session_id"), F.lit("")), 80))
        .when(named("parallel"), F.concat(F.coalesce(F.size(get("tool_uses", "array<variant>")), F.lit(0)).cast("string"), F.lit(" tool calls")))
        .when(get("query").isNotNull(), cut(get("query"))).when(get("path").isNotNull(), cut(get("path"))).when(get("file").isNotNull(), cut(get("file")))
        .when(get("session_id").isNotNull(), F.concat(F.lit("session: "), cut(get("session_id"), 80)))
        .otherwise(F.coalesce(line, F.lit("")))
    )


def readable_text(value: Column) -> Column:
    """What a person would read of a raw record (VARIANT): texts, thoughts, tool calls and results, single-spaced.

    Content is a message's, else the first of a payload's that there is, else the record's own; results may hold blocks.
    """

    def block(b: Column, deep: bool) -> Column:
        get = lambda k, kind="string": F.try_variant_get(b, f"$.{k}", kind)
        kind = get("type")
        given = get("input", "variant")
        main = F.coalesce(*(F.try_variant_get(given, f"$.{k}", "string") for k in ("command", "file_path", "pattern", "query", "url", "prompt")), F.to_json(given), F.lit("null"))
        result = F.concat_ws(" ", F.lit("[result]"), walk(get("content", "variant"), False)) if deep else F.lit("[result]")
        return (
            F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(kind == "tool_use", F.concat(F.lit("["), F.coalesce(get("name"), F.lit("tool")), F.lit("] "), main))
            .when(kind == "tool_result", result).when(kind == "thinking", F.concat(F.lit("(thinking) "), F.coalesce(get("thinking"), F.lit("")))).otherwise(F.coalesce(get("text"), get("output_text"), get("input_text")))
        )

    def walk(content: Column, deep: bool = True) -> Column:
        blocks = F.try_variant_get(content, "$", "array<variant>")
        listed = F.array_join(F.array_compact(F.transform(blocks, lambda b: block(b, deep))), " ")
        return F.coalesce(listed, F.when(content.isNotNull(), block(content, deep)))

    get = lambda path: F.try_variant_get(value, f"$.{path}", "variant")
    filled = lambda c: F.when(~F.coalesce(F.to_json(c), F.lit("null")).isin("null", '""', "[]", "{}"), c)
    payload = F.concat_ws(" ", F.concat(F.lit("["), F.try_variant_get(value, "$.payload.name", "string"), F.lit("]")), walk(F.coalesce(*(filled(get(f"payload.{k}")) for k in ("content", "message", "text", "arguments", "output", "summary")))))
    text = F.when(get("message").isNotNull(), walk(get("message.content"))).when(get("payload").isNotNull(), payload).otherwise(walk(get("content")))
    return single_spaced(F.coalesce(text, F.lit("")))


def paths_named(text: Column, pattern: str = r"(?m)^\*{3} (?:(?:Add|Update|Delete) File|Move to): (.*)$") -> Column:
    """What a pattern's group finds, trimmed; by default the files that a patch touches."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))


def nested_calls(code: Column) -> Column:
    """Names of the tools that generated code calls, strings and comments blanked first."""
    masked = F.regexp_replace(code, r"""(?s)"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`|//[^\n]*|/\*.*?\*/""", " ")
    return F.regexp_extract_all(masked, F.lit(r"\btools\.([A-Za-z_]\w*)\s*\("), F.lit(1))


def flat_queries(searches: DataFrame, keys: list[str]) -> DataFrame:
    """P25: (keys..., query): a row for each of a search's queries, or for its single one."""
    return searches.select(*keys, F.explode(F.coalesce("queries", F.array("query"))).alias("query"))


def export_selection(sessions: DataFrame, ids: list[str], model: str | None, with_encrypted: bool) -> DataFrame:
    """Sessions to export: of the ids, if any, and of models that match; not drafts; with encrypted reasoning if asked."""
    out = sessions.where(F.col("n_records") > 0)
    out = out.where(F.col("id").isin(*ids)) if ids else out
    out = out.where(F.col("model").rlike(model)) if model else out
    return out.where("n_encrypted > 0") if with_encrypted else out


def is_session_log(path: Column, root: str, depth: int) -> Column:
    """Whether a path is a log below a root, so many parts deep."""
    return F.startswith(path, F.lit(root)) & F.endswith(path, F.lit(".jsonl")) & (F.size(F.split(F.substr(path, F.lit(len(root) + 1)), "/")) == depth)


def encrypted_items(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, id, format, data) of the opaque reasoning items that providers left on the reasoning parts (key, order, data VARIANT).

    Of a part the first such detail counts, in whichever provider's metadata it lies; the same metadata on parts of other kinds
    of a step are not looked at, and an item that comes again counts where it came first.
    """
    providers = F.map_values(F.try_variant_get("data", "$.metadata", "map<string,variant>"))
    details = F.flatten(F.transform(providers, lambda p: F.coalesce(F.try_variant_get(p, "$.reasoning_details", "array<variant>"), F.array().cast("array<variant>"))))
    first = F.get(F.filter(details, lambda d: F.try_variant_get(d, "$.type", "string") == "reasoning.encrypted"), F.lit(0))
    found = parts.where(F.try_variant_get("data", "$.type", "string") == "reasoning").select(key, order, first.alias("_d")).where("_d is not null")
    get = lambda name: F.try_variant_get("_d", f"$.{name}", "string").alias(name)
    items = found.select(key, order, get("id"), get("format"), get("data"))
    again = F.row_number().over(Window.partitionBy(key, F.coalesce("id", F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(order))
    return items.withColumn("_n", again).where("_n = 1").drop("_n")


def store_identity(meta: DataFrame) -> DataFrame:
    """Rows (value VARIANT, ...) of a chat store's metadata with whose sub-agent they are: is_subagent, subagent_type, parent_id, root_parent_id."""
    info = lambda name: F.nullif(F.try_variant_get("value", f"$.subagentInfo.{name}", "string"), F.lit(""))
    sub = info("parentAgentId").isNotNull()
    return meta.withColumns({
        "is_subagent": sub, "subagent_type": F.when(sub, F.coalesce(info("typeName"), F.lit("cursor-cli"))), "parent_id": F.when(sub, info("parentAgentId")), "root_parent_id": F.when(sub, F.coalesce(info("rootParentAgentId"), info("parentAgentId"))),
    })


def encrypted(metadata: Column) -> Column:
    """Whether a message's metadata (VARIANT array of parts) hold encrypted reasoning."""
    parts = F.try_variant_get(metadata, "$", "array<variant>")
    return F.coalesce(F.exists(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "reasoning.encrypted"), F.lit(False))


def safe_link(url: Column) -> Column:
    """An http or https address; null for any other."""
    return F.when(url.rlike("^https?://"), url)


def effective_title(custom: Column, *candidates: Column) -> Column:
    """The custom name, or the first candidate with a text; sources give theirs in their own order."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (custom, *candidates)))


_EMPTY = f"array<struct<{','.join(f'{c}:{k}' for c, k in _ITEM.items())}>>"


def _item(**columns) -> Column:
    """One event of a record, as a struct."""
    return F.struct(*((columns[c] if c in columns else F.lit(None)).cast(k).alias(c) for c, k in _ITEM.items()))


def _some(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(_EMPTY))


def _exploded(raw: DataFrame, items: Column, shared: dict[str, Column]) -> DataFrame:
    """The events of each record, in one pass."""
    rows = raw.select("session_key", "seq", *((shared[c] if c in shared else F.lit(None)).cast(k).alias(c) for c, k in _SHARED.items()), F.explode(items).alias("_e"))
    return rows.select("session_key", "seq", *(F.col(f"_e.{c}").alias(c) for c in _ITEM), *_SHARED)


def _variant(path: str, value: str = "value") -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _object(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*(c.alias(n) for n, c in fields.items())))


def _with_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the last result (session_key, call_id, seq, r, e) of their id."""
    last = results.where("call_id is not null").groupBy("session_key", "call_id").agg(F.max_by(F.struct("r", "e"), "seq").alias("_r"))
    joined = events.join(last, ["session_key", "call_id"], "left")
    tool = F.col("kind") == "tool"
    new = {"result": F.when(tool, F.coalesce("_r.r", "result")).otherwise(F.col("result")), "is_error": F.when(tool, F.coalesce("_r.e", "is_error")).otherwise(F.col("is_error"))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS))


def system_prompts(raw: DataFrame) -> DataFrame:
    """The system prompts that a project-tree log records, as instructions before all other events (seq -1).

    Each version whose text or tools differ from the one before; the first ``# Environment`` message stands second.
    """
    system = _variant("shape.system")
    tools = F.array_compact(F.transform(F.try_variant_get("value", "$.shape.tools", "array<variant>"), lambda t: F.try_variant_get(t, "$.name", "string")))
    shapes = raw.where(at("type") == "api-request-shape").select("session_key", "seq", at("timestamp").alias("ts"), F.coalesce(content_text(system), F.lit("")).alias("_t"), F.coalesce(tools, F.array().cast("array<string>")).alias("_tools"))
    changed = occurrences(version_changes(shapes.where("_t != '' or size(_tools) > 0"), ["session_key"], ["seq"], ["_t", "_tools"]), ["session_key"], ["seq"], "_n")
    text = F.concat("_t", F.when(F.size("_tools") > 0, F.concat(F.lit("\n\n— Tools ("), F.size("_tools").cast("string"), F.lit("): "), F.array_join("_tools", ", "))).otherwise(""))
    label = F.when(F.col("_n") == 1, "System prompt").otherwise("System prompt (updated)")
    versions = changed.select("session_key", "ts", label.alias("label"), text.alias("text"), F.when(F.col("_n") == 1, 0).otherwise(F.col("_n")).alias("block"))
    blobs = raw.where((at("type") == "api-request-blob") & (at("message.role") == "system")).select("session_key", "seq", content_text(_variant("message.content")).alias("text"))
    first = blobs.where(F.startswith("text", F.lit("# Environment\n"))).groupBy("session_key").agg(F.min_by("text", "seq").alias("text"))
    stamps = versions.where("block = 0").select("session_key", "ts")
    environment = first.join(stamps, "session_key", "left").select("session_key", "ts", F.lit("Environment").alias("label"), "text", F.when(F.col("ts").isNull(), 0).otherwise(1).alias("block"))
    every = versions.unionByName(environment)
    have = {"session_key": F.col("session_key"), "seq": F.lit(-1), "kind": F.lit("instructions"), **{c: F.col(c) for c in ("ts", "label", "text", "block")}}
    kinds = {"session_key": dict(raw.dtypes)["session_key"], "seq": dict(raw.dtypes)["seq"], **_ITEM, **_SHARED}
    return every.select(*((have[c] if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in EVENT_COLUMNS))


def _tree_shared() -> dict[str, Column]:
    return {"uuid": at("uuid"), "parent_uuid": at("parentUuid"), "ts": at("timestamp"), "cwd": at("cwd"), "is_sidechain": F.coalesce(at("isSidechain", "boolean"), F.lit(False))}


def tree_events(raw: DataFrame) -> DataFrame:
    """Events of project-tree records, by (seq, block).

    Prompts and notices; of assistant records each block in its order, the first with the usage; tool calls with their
    last results; compactions, queued prompts, attachments, links; the system prompts first.
    """
    kind, text = at("type"), content_text(_variant("message.content"))
    label = notice_label(text)
    skill = F.startswith(F.ltrim(text), F.lit("Base directory for this skill:"))
    meta = F.coalesce(at("isMeta", "boolean"), F.lit(False))
    blocks = F.try_variant_get("value", "$.message.content", "array<variant>")
    image = F.coalesce(F.exists(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "image"), F.lit(False))
    spoken = (
        F.when(meta & skill, _item(block=F.lit(0), kind=F.lit("instructions"), label=F.lit("Skill instructions"), text=text))
        .when(label.isNotNull() & ~image, _item(block=F.lit(0), kind=F.lit("notice"), label=label, text=F.trim(text)))
        .otherwise(_item(block=F.lit(0), kind=F.lit("user"), text=F.concat_ws("\n", text, F.when(image, "[image attached]"))))
    )
    prompts = _some((F.trim(F.coalesce(text, F.lit(""))) != "") | image, spoken)

    usage = _object(input=at("message.usage.input_tokens", "long"), output=at("message.usage.output_tokens", "long"), cache_read=at("message.usage.cache_read_input_tokens", "long"), cache_creation=at("message.usage.cache_creation_input_tokens", "long"))

    def reply(b: Column, i: Column) -> Column:
        get = lambda k, own="string": F.try_variant_get(b, f"$.{k}", own)
        own = F.when(get("type") == "text", "assistant").when(get("type") == "thinking", "reasoning").when(get("type") == "tool_use", "tool")
        return _item(block=i, kind=own, text=F.when(get("type") == "text", get("text")).when(get("type") == "thinking", get("thinking")), model=at("message.model"), call_id=get("id"), name=get("name"), input=get("input", "variant"), is_error=F.when(own == "tool", F.lit(False)), usage=F.when(i == 0, usage))

    whole = F.try_variant_get("value", "$.message.content", "string")
    replies = F.coalesce(F.filter(F.transform(blocks, reply), lambda e: e["kind"].isNotNull() & ((e["kind"] == "tool") | (F.coalesce(e["text"], F.lit("")) != ""))), _some(F.coalesce(whole, F.lit("")) != "", _item(block=F.lit(0), kind=F.lit("assistant"), text=whole, model=at("message.model"), usage=usage)))

    size = lambda path: F.coalesce(F.size(F.try_variant_get("value", f"$.{path}", "array<variant>")), F.lit(0))
    compact = _object(trigger=at("compactMetadata.trigger"), pre_tokens=at("compactMetadata.preTokens", "long"), post_tokens=at("compactMetadata.postTokens", "long"), duration_ms=at("compactMetadata.durationMs", "long"), preserved_messages=size("compactMetadata.preservedMessages.uuids"), discovered_tools=size("compactMetadata.preCompactDiscoveredTools"))
    boundary = at("subtype") == "compact_boundary"
    told = F.array(_item(block=F.lit(0), kind=F.lit("system"), label=at("subtype"), text=F.coalesce(F.nullif(at("content"), F.lit("")), at("subtype"), F.lit("")), payload=F.when(boundary & _variant("compactMetadata").isNotNull(), compact)))

    queued = content_text(_variant("attachment.prompt"))
    note = notice_label(queued)
    waiting = _some(F.trim(F.coalesce(queued, F.lit(""))) != "", F.when(note.isNotNull(), _item(block=F.lit(0), kind=F.lit("notice"), label=note, text=F.trim(queued))).otherwise(_item(block=F.lit(0), kind=F.lit("user"), label=F.lit("Queued"), text=queued)))
    shown = F.coalesce(at("attachment.displayPath"), F.element_at(F.split(at("attachment.filename"), "/"), -1))
    content = F.coalesce(at("attachment.content.file.content"), F.when(F.schema_of_variant(_variant("attachment.content")) == "STRING", at("attachment.content")))
    details = _object(hook_name=at("attachment.hookName"), command=at("attachment.command"), stdout=at("attachment.stdout"), stderr=at("attachment.stderr"), exit_code=at("attachment.exitCode", "int"), num_lines=F.coalesce(at("attachment.content.file.numLines", "int"), at("attachment.content.file.totalLines", "int")), added_count=size("attachment.addedNames"), removed_count=size("attachment.removedNames"), readded_count=size("attachment.readdedNames"))
    attached = F.array(_item(block=F.lit(0), kind=F.lit("attachment"), label=at("attachment.type"), name=shown, text=F.coalesce(content, at("attachment.stdout"), shown), payload=details))
    linked = F.array(_item(block=F.lit(0), kind=F.lit("attachment"), label=F.lit("pr-link"), name=at("prRepository"), text=safe_link(at("prUrl"))))
    items = (
        F.when(kind == "user", prompts).when(kind == "assistant", replies).when(kind == "system", told)
        .when(kind == "attachment", F.when(at("attachment.type") == "queued_command", waiting).otherwise(attached)).when(kind == "pr-link", linked)
        .when(~kind.isin(*TREE_IGNORED), F.array(_item(block=F.lit(0), kind=F.lit("raw"), label=kind, payload=F.col("value"))))
    )
    events = _exploded(raw, items, _tree_shared())
    answers = raw.where(kind == "user").select("session_key", "seq", F.explode(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")).alias("b"))
    results = answers.select("session_key", "seq", at("tool_use_id", value="b").alias("call_id"), result_text(_variant("content", "b")).alias("r"), F.coalesce(at("is_error", "boolean", "b"), F.lit(False)).alias("e"))
    return _with_results(events, results).unionByName(system_prompts(raw))


#: What a log's first session record tells of it, by column.
META = {
    "id": "id", "cwd": "cwd", "cli_version": "version", "source": "source", "originator": "originator", "thread_source": "thread_source", "model_provider": "model_provider",
    "parent_thread_id": "parent_thread_id", "parent_id": "own_parent",
}


def rollout_meta(raw: DataFrame) -> DataFrame:
    """One row per log with session records: its first values, is_subagent, subagent_type, parent_id and agent.

    A later session record, as a forked log replays its parent's, fills only what the first lacks.
    """
    get = {n: at(f"payload.{k}") for k, n in META.items()}
    rows = raw.where(at("type") == "session_meta").select("session_key", "seq", *(c.alias(n) for n, c in get.items()))
    meta = first_and_last(rows, ["session_key"], "seq", list(get), [])
    return rollout_identity(meta.select("session_key", *(F.col(f"first_{n}").alias(n) for n in get)))


def rollout_identity(meta: DataFrame) -> DataFrame:
    """Rows with the columns of META, and with is_subagent, subagent_type, parent_id and agent instead of those that tell them."""
    source = F.try_parse_json("source")
    sub = F.try_variant_get(source, "$.subagent", "variant")
    own = F.coalesce(F.when(F.schema_of_variant(sub) == "STRING", F.try_variant_get(sub, "$", "string")), *(F.nullif(F.try_variant_get(sub, f"$.{k}", "string"), F.lit("")) for k in ("other", "type", "name")), F.lit("subagent"))
    is_sub = (F.col("thread_source") == "subagent") | sub.isNotNull()
    agent = F.when((F.col("originator") == "cursor-ide") | (F.col("source") == "cursor"), "cursor").when((F.col("originator") == "opencode") | (F.col("source") == "opencode"), "opencode").otherwise("codex")
    return meta.withColumns({"is_subagent": F.coalesce(is_sub, F.lit(False)), "agent": agent}).withColumn("subagent_type", F.when(F.col("is_subagent"), own)).withColumn("parent_id", F.when(F.col("is_subagent"), F.coalesce("parent_thread_id", "own_parent"))).drop("parent_thread_id", "own_parent")


def forked_from(raw: DataFrame) -> DataFrame:
    """(session_key, parent_id, message_uuid) of logs that were forked: the last pointer counts."""
    get = lambda k: at(f"forkedFrom.{k}")
    rows = raw.where(F.coalesce(get("sessionId"), F.lit("")) != "").select("session_key", "seq", get("sessionId").alias("s"), get("messageUuid").alias("m"))
    last = rows.groupBy("session_key").agg(F.max_by(F.struct("s", "m"), "seq").alias("r"))
    return last.select("session_key", F.col("r.s").alias("parent_id"), F.col("r.m").alias("message_uuid"))


def message_columns() -> tuple[Column, Column, Column]:
    """Role and text of a rollout's record, and whether it is a mirror, else an envelope; the role is null where it is no message."""
    sub, item = at("payload.type"), at("payload.item.type")
    texts = F.array_compact(F.transform(F.try_variant_get("value", "$.payload.item.content", "array<variant>"), lambda b: F.nullif(F.try_variant_get(b, "$.text", "string"), F.lit(""))))
    role = F.when(sub == "user_message", "user").when(sub == "agent_message", "assistant").when((sub == "item_completed") & (item == "UserMessage"), "user").when((sub == "item_completed") & (item == "AgentMessage"), "assistant")
    text = F.when(sub == "item_completed", F.array_join(texts, "\n")).otherwise(at("payload.message"))
    return F.when(at("type") == "event_msg", role), F.coalesce(text, F.lit("")), ~F.coalesce(sub == "item_completed", F.lit(False))


def rollout_messages(raw: DataFrame) -> DataFrame:
    """(session_key, seq, role, text, origin) of a rollout's conversational messages: mirrors, and envelopes of finished items."""
    role, text, mirror = message_columns()
    return raw.where(role.isNotNull()).select("session_key", "seq", role.alias("role"), text.alias("text"), F.when(mirror, "mirror").otherwise("envelope").alias("origin"))


def mirrored_thoughts(raw: DataFrame) -> DataFrame:
    """(session_key, seq) of reasoning events that the parts of the reasoning item right after them repeat, all and in order."""
    order = Window.partitionBy("session_key").orderBy("seq")
    narrow = raw.select("session_key", "seq", F.when((at("type") == "event_msg") & (at("payload.type") == "agent_reasoning"), single_spaced(F.coalesce(at("payload.text"), F.lit("")))).alias("said"), F.when((at("type") == "response_item") & (at("payload.type") == "reasoning"), _summary_texts()).alias("parts"))
    numbered = narrow.withColumn("at", F.row_number().over(order))
    wanted = numbered.where("size(parts) > 0").select("session_key", F.col("at").alias("item"), F.size("parts").alias("n"), F.posexplode("parts").alias("j", "part"))
    wanted = wanted.select("session_key", "item", "n", (F.col("item") - F.col("n") + F.col("j")).alias("at"), single_spaced(F.col("part")).alias("part"))
    met = wanted.join(numbered.where("said is not null").select("session_key", "at", "seq", "said"), ["session_key", "at"]).where("said = part")
    full = met.groupBy("session_key", "item").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.collect_list("seq").alias("seqs")).where("k = n")
    return full.select("session_key", F.explode("seqs").alias("seq"))


def _summary_texts() -> Column:
    parts = F.transform(F.try_variant_get("value", "$.payload.summary", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    return F.filter(parts, lambda x: F.trim(x) != "")


def rollout_repeats(raw: DataFrame) -> DataFrame:
    """(session_key, seq) of rollout records that only repeat others.

    An envelope's message that a mirror has, occurrence by occurrence; a prompt's copy among the responses; reasoning that
    an item repeats, or that is one of the last eight kept.
    """
    messages = rollout_messages(raw).withColumn("key", single_spaced(F.col("text")))
    mirrors = messages.where("origin = 'mirror'").groupBy("session_key", "role", "key").agg(F.count("*").alias("n"))
    envelopes = occurrences(messages.where("origin = 'envelope'"), ["session_key", "role", "key"], ["seq"], "k").join(mirrors, ["session_key", "role", "key"])
    twice = envelopes.where("k <= n").select("session_key", "seq")
    copies = raw.where((at("type") == "response_item") & (at("payload.type") == "message") & (at("payload.role") == "user")).select("session_key", "seq", single_spaced(F.coalesce(content_text(_variant("payload.content")), F.lit(""))).alias("key"))
    copied = copies.join(messages.where("role = 'user' and text != ''").select("session_key", "key"), ["session_key", "key"], "left_semi").select("session_key", "seq")
    again = mirrored_thoughts(raw)
    sub, kind = at("payload.type"), at("type")
    text = F.when((kind == "event_msg") & (sub == "agent_reasoning"), at("payload.text")).when((kind == "response_item") & (sub == "reasoning"), _thought())
    thoughts = raw.select("session_key", "seq", single_spaced(text).alias("key")).where("key != ''").join(again, ["session_key", "seq"], "left_anti")
    kept = last_kept(thoughts, ["session_key"], ["seq"], "key", 8)
    near = thoughts.join(kept, ["session_key", "seq"], "left_anti").select("session_key", "seq")
    return twice.union(copied).union(again.select("session_key", "seq")).union(near)


def _thought() -> Column:
    return F.coalesce(F.nullif(content_text(_variant("payload.content")), F.lit("")), F.array_join(_summary_texts(), "\n\n"))


def rollout_results(raw: DataFrame) -> DataFrame:
    """(session_key, call_id, text, raw, is_error): a call's last output with what its patch event adds."""
    sub, keys = at("payload.type"), ["session_key", "call_id"]
    call = at("payload.call_id")
    last = lambda df, *columns: df.where("call_id is not null").groupBy(*keys).agg(F.max_by(F.struct(*columns), "seq").alias("r")).select(*keys, "r.*")
    outputs = raw.where((at("type") == "response_item") & sub.isin("function_call_output", "custom_tool_call_output"))
    outputs = last(outputs.select("session_key", "seq", call.alias("call_id"), result_text(_variant("payload.output")).alias("text"), F.lit(None).cast("variant").alias("raw"), F.coalesce(at("payload.is_error", "boolean"), F.lit(False)).alias("failed")), "text", "raw", "failed")
    patches = raw.where((at("type") == "event_msg") & (sub == "patch_apply_end"))
    joined = F.concat_ws("\n", F.nullif(at("payload.stdout"), F.lit("")), F.nullif(at("payload.stderr"), F.lit("")))
    patches = last(patches.select("session_key", "seq", call.alias("call_id"), joined.alias("text"), _variant("payload.changes").alias("raw"), (~F.coalesce(at("payload.success", "boolean"), F.lit(True))).alias("failed")), "text", "raw", "failed")
    errors = outputs.select(*keys, F.col("failed").alias("_o")).join(patches.select(*keys, F.col("failed").alias("_p")), keys, "full")
    return merged_results(outputs, patches, keys).join(errors, keys).select(*keys, "text", "raw", F.coalesce("_o", "_p").alias("is_error"))


def rollout_events(raw: DataFrame) -> DataFrame:
    """Events of rollout records, by (seq, block).

    Messages of either format once, injected instructions, reasoning that says something, tool calls with labels and merged
    results, web searches, turn contexts, status and token records; review sessions' requests and decisions.
    """
    kind, sub = at("type"), at("payload.type")
    item = at("payload.item.type")
    texts = F.array_compact(F.transform(F.try_variant_get("value", "$.payload.item.content", "array<variant>"), lambda b: F.nullif(F.try_variant_get(b, "$.text", "string"), F.lit(""))))
    message = F.when(sub == "item_completed", F.array_join(texts, "\n")).otherwise(F.coalesce(at("payload.message"), F.lit("")))
    role = F.when((sub == "user_message") | (item == "UserMessage"), "user").when((sub == "agent_message") | (item == "AgentMessage"), "assistant")
    spoken = _some((sub != "item_completed") | (F.trim(message) != ""), _item(block=F.lit(0), kind=role, text=message, label=at("payload.phase")))
    base = F.coalesce(at("payload.base_instructions.text"), F.when(F.schema_of_variant(_variant("payload.base_instructions")) == "STRING", F.coalesce(F.try_variant_get(F.try_parse_json(at("payload.base_instructions")), "$.text", "string"), at("payload.base_instructions"))))
    opened = _some(F.coalesce(base, F.lit("")) != "", _item(block=F.lit(0), kind=F.lit("instructions"), label=F.lit("Base instructions"), text=base))
    own = F.coalesce(at("payload.role"), F.lit(""))
    text = F.coalesce(content_text(_variant("payload.content")), F.lit(""))
    told = _some((F.trim(text) != "") & own.isin("developer", "system", "user"), _item(block=F.lit(0), kind=F.lit("instructions"), label=instruction_label(own, text), text=text))
    thought = F.coalesce(_thought(), F.lit(""))
    reasoned = _some(single_spaced(thought) != "", _item(block=F.lit(0), kind=F.lit("reasoning"), text=thought, label=F.when(F.coalesce(at("payload.encrypted_content"), F.lit("")) != "", "encrypted")))
    aloud = _some(single_spaced(F.coalesce(at("payload.text"), F.lit(""))) != "", _item(block=F.lit(0), kind=F.lit("reasoning"), text=at("payload.text")))
    name = F.coalesce(F.nullif(at("payload.name"), F.lit("")), F.lit("tool"))
    argument = F.when(sub == "function_call", at("payload.arguments")).otherwise(at("payload.input"))
    given = F.coalesce(F.try_parse_json(argument), F.try_variant_get(F.to_variant_object(F.struct(argument.alias("raw"))), "$.raw", "variant"))
    called = F.array(_item(block=F.lit(0), kind=F.lit("tool"), call_id=at("payload.call_id"), name=name, input=given, label=tool_label(name, given), is_error=F.lit(False), payload=_object(status=at("payload.status"), record=sub)))
    asked = F.array(_item(block=F.lit(0), kind=F.lit("web_call"), call_id=at("payload.call_id"), text=at("payload.action.query"), payload=_variant("payload.action")))
    searched = F.array(_item(block=F.lit(0), kind=F.lit("web_search"), call_id=at("payload.call_id"), text=at("payload.query"), payload=_variant("payload.action")))
    state = F.when(sub == "task_started", "started").when(sub == "task_complete", "complete").when(sub == "turn_aborted", "aborted")
    status = F.array(_item(block=F.lit(0), kind=F.lit("status"), label=state, call_id=at("payload.turn_id"), text=at("payload.reason"), payload=_object(turn_id=at("payload.turn_id"), duration_ms=at("payload.duration_ms", "long"), time_to_first_token_ms=at("payload.time_to_first_token_ms", "long"), context_window=at("payload.model_context_window", "long"))))
    counted = F.array(_item(block=F.lit(0), kind=F.lit("tokens"), usage=_variant("payload.info.total_token_usage"), payload=_object(context_window=at("payload.info.model_context_window", "long"), rate_limits=_variant("payload.rate_limits"))))
    used = F.array(_item(block=F.lit(0), kind=F.lit("tokens"), usage=F.coalesce(_variant("payload.turn_token_usage"), _variant("payload.usage")), payload=_object(turn_id=at("payload.turn_id"), response_id=at("payload.response_id"), thread=_variant("payload.thread_token_usage"))))
    context = F.array(_item(block=F.lit(0), kind=F.lit("context"), call_id=at("payload.turn_id"), model=at("payload.model"), payload=_object(turn_id=at("payload.turn_id"), cwd=at("payload.cwd"), effort=at("payload.effort"), approval_policy=at("payload.approval_policy"))))
    history = F.try_variant_get("value", "$.payload.replacement_history", "array<variant>")
    compact = F.array(_item(block=F.lit(0), kind=F.lit("system"), label=F.lit("compact_boundary"), text=F.coalesce(F.nullif(at("payload.message"), F.lit("")), F.lit("Context compacted")), payload=_object(replaced=F.coalesce(F.size(history), F.lit(0)), compactions=F.coalesce(F.size(F.filter(history, lambda h: F.try_variant_get(h, "$.type", "string") == "compaction")), F.lit(0)))))
    strange = lambda label, payload: F.array(_item(block=F.lit(0), kind=F.lit("raw"), label=label, payload=payload))
    none = F.array().cast(_EMPTY)
    heard = (
        F.when(role.isNotNull() & sub.isin("user_message", "agent_message", "item_completed"), spoken).when(sub == "item_completed", none).when(sub == "agent_reasoning", aloud).when(state.isNotNull(), status)
        .when(sub == "token_count", counted).when(sub == "web_search_end", searched).when(sub.isin(*EVENT_IGNORED), none).otherwise(strange(F.concat(F.lit("event_msg/"), F.coalesce(sub, F.lit(""))), _variant("payload")))
    )
    answered = (
        F.when(sub == "message", told).when(sub == "reasoning", reasoned).when(sub.isin("function_call", "custom_tool_call"), called).when(sub == "web_search_call", asked)
        .when(sub.isin("function_call_output", "custom_tool_call_output"), none).otherwise(strange(F.concat(F.lit("response_item/"), F.coalesce(sub, F.lit(""))), _variant("payload")))
    )
    items = (
        F.when(kind == "session_meta", opened).when(kind == "turn_context", context).when(kind == "token_usage_record", used).when(kind == "compacted", compact)
        .when(kind == "event_msg", heard).when(kind == "response_item", answered).when(kind.isin(*ROLLOUT_IGNORED), none).when(kind.isNotNull(), strange(kind, _variant("payload")))
    )
    events = _exploded(raw, items, {"ts": at("timestamp"), "cwd": at("payload.cwd")}).join(rollout_repeats(raw), ["session_key", "seq"], "left_anti")
    return _reviewed(_looked_up(_with_outputs(events, raw), raw), raw).select(*EVENT_COLUMNS)


def _with_outputs(events: DataFrame, raw: DataFrame) -> DataFrame:
    results = rollout_results(raw).select("session_key", "call_id", F.col("text").alias("_text"), F.col("raw").alias("_raw"), F.col("is_error").alias("_error"), F.lit("tool").alias("kind"))
    joined = events.join(results, ["session_key", "call_id", "kind"], "left")
    tool = F.col("kind") == "tool"
    inner, failed = unwrapped_output(F.col("_text"))
    text = F.when(F.col("name") == "exec", inner).otherwise(F.col("_text"))
    return joined.withColumns({"result": F.when(tool, text), "is_error": F.when(tool, F.coalesce(F.col("_error") | ((F.col("name") == "exec") & failed), F.lit(False))), "payload": F.when(tool, F.coalesce("_raw", "payload")).otherwise(F.col("payload"))}).drop("_text", "_raw", "_error")


def _looked_up(events: DataFrame, raw: DataFrame) -> DataFrame:
    """The model of a turn's context at its start. J25: the query of a web search's end at its call."""
    sub = at("payload.type")
    turns = raw.where((at("type") == "turn_context") & at("payload.turn_id").isNotNull()).groupBy("session_key", at("payload.turn_id").alias("call_id")).agg(F.max_by(at("payload.model"), "seq").alias("_model"))
    ends = raw.where((at("type") == "event_msg") & (sub == "web_search_end") & at("payload.call_id").isNotNull()).groupBy("session_key", at("payload.call_id").alias("call_id")).agg(F.max_by(at("payload.query"), "seq").alias("_query"))
    known = turns.withColumn("kind", F.lit("status")).unionByName(ends.withColumn("kind", F.lit("web_call")), allowMissingColumns=True)
    joined = events.join(known, ["session_key", "call_id", "kind"], "left")
    return joined.withColumns({"model": F.coalesce(F.when(F.col("label") == "started", F.col("_model")), "model"), "text": F.when(F.col("kind") == "web_call", F.coalesce("_query", "text")).otherwise(F.col("text"))}).drop("_model", "_query")


def _reviewed(events: DataFrame, raw: DataFrame) -> DataFrame:
    """P20: in review sessions, prompts that ask for a decision and replies that give one."""
    reviews = rollout_meta(raw).where("subagent_type = 'guardian'").select("session_key", F.lit(True).alias("_review"))
    joined = events.join(reviews, "session_key", "left")
    request, decision = (F.when(F.col("_review") & (F.col("kind") == k), f(F.col("text"))) for k, f in (("user", review_request), ("assistant", review_decision)))
    kind = F.when(request.isNotNull(), "guardian_request").when(decision.isNotNull(), "guardian_decision").otherwise(F.col("kind"))
    return joined.withColumns({"payload": F.coalesce(request, decision, F.col("payload")), "label": F.coalesce(F.try_variant_get(decision, "$.outcome", "string"), "label"), "kind": kind}).drop("_review")


def bubble_events(headers: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Events of IDE bubbles (session_key, bubble_id, value), in the order of headers (session_key, seq, bubble_id).

    Thoughts, the text and the tool call of one bubble stand in this order.
    """
    raw = headers.join(bubbles, ["session_key", "bubble_id"])
    user, model, name = at("type", "int") == 1, at("modelInfo.modelName"), at("toolFormerData.name")
    given = F.coalesce(_object_of("toolFormerData.params"), _object_of("toolFormerData.rawArgs"))
    text, thought = F.coalesce(at("text"), F.lit("")), F.coalesce(at("thinking.text"), F.lit(""))
    result = F.coalesce(F.try_parse_json(at("toolFormerData.result")), _variant("toolFormerData.result"))
    inner = F.coalesce(*(F.try_variant_get(result, f"$.{k}", "string") for k in ("output", "contents", "text")), at("toolFormerData.result"))
    failed = (at("toolFormerData.status") == "error") | F.coalesce(F.try_variant_get(result, "$.exitCode", "int") != 0, F.lit(False))
    tool = _item(block=F.lit(2), kind=F.lit("tool"), model=model, call_id=at("toolFormerData.toolCallId"), name=tool_name(name), input=tool_input(name, given), result=inner, is_error=F.coalesce(failed, F.lit(False)))
    items = F.when(user, _some(clean_prompt(text) != "", _item(block=F.lit(0), kind=F.lit("user"), text=clean_prompt(text)))).otherwise(
        F.concat(
            _some(F.trim(thought) != "", _item(block=F.lit(0), kind=F.lit("reasoning"), text=thought, model=model)), _some(F.trim(text) != "", _item(block=F.lit(1), kind=F.lit("assistant"), text=text, model=model)),
            _some(_variant("toolFormerData").isNotNull(), tool),
        )
    )
    return _exploded(raw, items, {"uuid": F.col("bubble_id"), "ts": at("createdAt")})


def _object_of(path: str) -> Column:
    """An object at a path, or the one that a text there holds."""
    given = _variant(path)
    parsed = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(at(path))).otherwise(given)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")) & (F.to_json(parsed) != "{}"), parsed)


def export_events(raw: DataFrame) -> DataFrame:
    """Events of a lossy export: cleaned prompts, replies, and tool calls without results; context is left out."""
    role, text = at("role"), F.coalesce(content_text(_variant("message.content")), F.lit(""))
    prompt = clean_prompt(text)
    blocks = F.try_variant_get("value", "$.message.content", "array<variant>")

    def reply(b: Column, i: Column) -> Column:
        get = lambda k, own="string": F.try_variant_get(b, f"$.{k}", own)
        tool = get("type") == "tool_use"
        return _item(block=i, kind=F.when(tool, "tool").when((get("type") == "text") & (F.trim(get("text")) != ""), "assistant"), text=F.when(~tool, get("text")), name=F.when(tool, tool_name(get("name"))), input=F.when(tool, tool_input(get("name"), get("input", "variant"))), is_error=F.when(tool, F.lit(False)))

    replies = F.coalesce(F.filter(F.transform(blocks, reply), lambda e: e["kind"].isNotNull()), _some(F.trim(text) != "", _item(block=F.lit(0), kind=F.lit("assistant"), text=text)))
    items = F.when((role == "user") & ~is_context_only(text) & (prompt != ""), F.array(_item(block=F.lit(0), kind=F.lit("user"), text=prompt))).when(role == "assistant", replies)
    return _exploded(raw, items, {})


def blob_events(raw: DataFrame) -> DataFrame:
    """Events of blob-store messages: prompts, reminders, replies with reasoning, tool calls with their last results.

    An assistant message equal to the one before it is left out.
    """
    role, text = at("role"), F.coalesce(content_text(_variant("content")), F.lit(""))
    asked = text.rlike("(?is)<user_query>.*?</user_query>")
    reminder = F.regexp_extract(text, r"(?is)<system_reminder>(.*?)</system_reminder>", 1)
    prompt, alone = clean_prompt(text), (reminder != "") & ~asked
    users = F.concat(_some(alone, _item(block=F.lit(0), kind=F.lit("notice"), label=F.lit("System reminder"), text=F.trim(reminder))), _some(prompt != "", _item(block=F.lit(1), kind=F.lit("user"), text=prompt)))
    blocks = F.try_variant_get("value", "$.content", "array<variant>")
    model = at("providerOptions.cursor.modelName")

    def reply(b: Column, i: Column) -> Column:
        get = lambda k, own="string": F.try_variant_get(b, f"$.{k}", own)
        kind = F.when(get("type") == "tool-call", "tool").when(get("type") == "reasoning", "reasoning").when((get("type") == "text") & (F.trim(get("text")) != ""), "assistant")
        name = F.coalesce(get("toolName"), get("name"), F.lit("tool"))
        given = F.coalesce(get("args", "variant"), get("input", "variant"))
        given = F.when(F.schema_of_variant(given) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(given, "$", "string")), given)).otherwise(given)
        return _item(block=i, kind=kind, text=F.when(kind != "tool", get("text")), model=model, call_id=F.when(kind == "tool", F.coalesce(get("toolCallId"), get("id"))), name=F.when(kind == "tool", tool_name(name)), input=F.when(kind == "tool", tool_input(name, given)), is_error=F.when(kind == "tool", F.lit(False)))

    replies = F.coalesce(F.filter(F.transform(blocks, reply), lambda e: e["kind"].isNotNull()), _some(F.trim(text) != "", _item(block=F.lit(0), kind=F.lit("assistant"), text=text, model=model)))
    items = F.when((role == "user") & ~(F.contains(text, F.lit("<user_info>")) & ~asked), users).when(role == "assistant", replies)
    before = F.lag(F.when(role == "assistant", F.xxhash64(F.to_json(_variant("content")))), 1).over(Window.partitionBy("session_key").orderBy("seq"))
    again = (role == "assistant") & F.coalesce(before == F.xxhash64(F.to_json(_variant("content"))), F.lit(False))
    spoken = raw.where(role.isin("user", "assistant")).withColumn("_again", again).where("not _again")
    parts = raw.where(role == "tool").select("session_key", "seq", at("id").alias("own"), F.explode(blocks).alias("b")).where(at("type", value="b") == "tool-result")
    results = parts.select("session_key", "seq", F.coalesce(at("toolCallId", value="b"), "own").alias("call_id"), _store_result(_variant("result", "b")).alias("r"), F.coalesce(at("is_error", "boolean", "b"), at("isError", "boolean", "b"), F.lit(False)).alias("e"))
    return _with_results(_exploded(spoken, items, {}), results)


def _store_result(result: Column) -> Column:
    is_object = F.startswith(F.schema_of_variant(result), F.lit("OBJECT"))
    inner = F.coalesce(*(F.try_variant_get(result, f"$.{k}", "string") for k in ("output", "text", "content", "stdout")))
    return F.coalesce(F.when(is_object, F.coalesce(inner, F.to_json(result))), F.try_variant_get(result, "$", "string"), F.lit(""))


def part_events(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Events of the three-table store: parts (id, message_id, data) of messages (id, session_id, time_created, data).

    seq is the message's place by time and id, block the part's by id: the parts of a message are the blocks of its turn, and
    the turn's usage stands at its first part. A message's error comes after its parts.
    """
    kinds = {r: F.try_parse_json("data") for r in ("message",)}
    told = messages.select(F.col("id").alias("message_id"), F.col("session_id").alias("session_key"), "time_created", kinds["message"].alias("message"))
    placed = told.withColumn("seq", F.row_number().over(Window.partitionBy("session_key").orderBy("time_created", "message_id")) - 1)
    joined = parts.select(F.col("id").alias("part_id"), "message_id", F.try_parse_json("data").alias("value")).join(placed, "message_id")
    raw = joined.withColumn("n", F.row_number().over(Window.partitionBy("message_id").orderBy("part_id")) - 1)
    get = lambda path, own="string": F.try_variant_get("message", f"$.{path}", own)
    kind, user, text = at("type"), get("role") == "user", F.coalesce(at("text"), F.lit(""))
    label = F.when(F.coalesce(at("ignored", "boolean"), F.lit(False)), "Ignored").when(F.coalesce(at("synthetic", "boolean"), F.lit(False)), "Injected")
    model = F.nullif(F.concat_ws("/", F.nullif(get("providerID"), F.lit("")), F.nullif(get("modelID"), F.lit(""))), F.lit(""))
    usage = F.when((F.col("n") == 0) & ~user, _object(input=get("tokens.input", "long"), output=get("tokens.output", "long"), reasoning=get("tokens.reasoning", "long"), cache_read=get("tokens.cache.read", "long"), cache_write=get("tokens.cache.write", "long")))
    common = {"block": F.col("n"), "model": F.when(~user, model), "usage": usage}
    spoken = _some(text != "", _item(kind=F.when(user & label.isNotNull(), "notice").when(user, "user").otherwise("assistant"), label=F.when(user, label), text=text, **common))
    thought = _some(text != "", _item(kind=F.lit("reasoning"), text=text, label=F.when(encrypted(F.try_variant_get("value", "$.metadata.parts", "variant")) | at("metadata.openai.reasoningEncryptedContent").isNotNull(), "encrypted"), **common))
    tool = F.array(_item(kind=F.lit("tool"), call_id=at("callID"), name=at("tool"), input=tool_input(at("tool"), _variant("state.input")), result=F.coalesce(at("state.output"), at("state.error")), is_error=F.coalesce(at("state.status") == "error", F.lit(False)), **common))
    file = F.array(_item(kind=F.lit("attachment"), label=F.lit("file"), name=at("filename"), text=image_class(at("url")), payload=_object(mime=at("mime")), **common))
    task = F.array(_item(kind=F.lit("instructions"), label=F.concat(F.lit("Subtask → @"), F.coalesce(at("agent"), F.lit("agent")), F.coalesce(F.concat(F.lit(" ("), F.nullif(at("description"), F.lit("")), F.lit(")")), F.lit(""))), text=F.coalesce(at("prompt"), F.lit("")), **common))
    overflow = F.coalesce(at("overflow", "boolean"), F.lit(False))
    compact = F.array(_item(kind=F.lit("system"), label=F.lit("compact_boundary"), text=F.concat(F.lit("Context compacted"), F.when(overflow, " (context overflow)").otherwise("")), payload=_object(trigger=F.when(F.coalesce(at("auto", "boolean"), F.lit(False)), "auto").otherwise("manual"), overflow=overflow), **common))
    retry = F.array(_item(kind=F.lit("notice"), label=F.concat(F.lit("Retry (attempt "), F.coalesce(at("attempt"), F.lit("None")), F.lit(")")), text=F.coalesce(at("error.message"), at("error")), **common))
    strange = F.array(_item(kind=F.lit("raw"), label=F.concat(F.lit("part/"), F.coalesce(kind, F.lit(""))), payload=F.col("value"), **common))
    items = (
        F.when(kind == "text", spoken).when((kind == "reasoning") & ~user, thought).when((kind == "tool") & ~user, tool).when((kind == "file") & user, file).when((kind == "subtask") & user, task)
        .when(kind == "compaction", compact).when((kind == "retry") & ~user, retry).when(kind.isin("step-finish", "patch", *PART_IGNORED), F.array().cast(_EMPTY)).otherwise(strange)
    )
    shared = {"uuid": F.col("part_id"), "parent_uuid": F.col("message_id"), "ts": F.col("time_created")}
    failed = placed.where(F.try_variant_get("message", "$.error", "variant").isNotNull()).withColumn("value", F.col("message"))
    error = F.concat_ws(": ", F.nullif(get("error.name"), F.lit("")), F.nullif(F.coalesce(get("error.data.message"), get("error.message")), F.lit("")))
    errors = _exploded(failed, F.array(_item(block=F.lit(1 << 30), kind=F.lit("notice"), label=F.lit("Error"), text=error)), {"parent_uuid": F.col("message_id"), "ts": F.col("time_created")})
    return _exploded(raw, items, shared).unionByName(errors)
