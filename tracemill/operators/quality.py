"""Checks of the event contract."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of events and the fields that each must have.
REQUIRED = {
    "user": ["text"], "assistant": ["text"], "reasoning": ["text"], "tool": ["name"], "web_search": [], "web_call": [], "instructions": ["text"], "system": ["text"], "notice": ["label", "text"],
    "attachment": ["label"], "guardian_request": ["payload"], "guardian_decision": [], "status": ["label"], "context": [], "tokens": ["payload"], "raw": ["label", "payload"], "branch": [],
}


def violations(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path): one row for each field of an event that breaks the contract: its kind, or a required field that is null."""
    rules: list[Column] = [F.when(~F.coalesce(F.col("kind").isin(*REQUIRED), F.lit(False)), "kind")]
    for field in sorted({f for fields in REQUIRED.values() for f in fields}):
        if field in events.columns:
            kinds = [k for k, fields in REQUIRED.items() if field in fields]
            rules.append(F.when(F.col("kind").isin(*kinds) & F.col(field).isNull(), field))
    return events.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("path"))


def summary_violations(summaries: DataFrame, required: list[str], key: str) -> DataFrame:
    """(key, path): required fields of summaries that are null, and counts below zero."""
    rules = [F.when(F.col(c).isNull(), c) for c in required] + [F.when(F.col(c) < 0, c) for c in required if c.startswith("n_")]
    return summaries.select(key, F.explode(F.array_compact(F.array(*rules))).alias("path"))


# What blocks, states, outcomes and agents there are, and what a summary must have.
BLOCK_TYPES, STATES, OUTCOMES, AGENTS = ("text", "thinking", "image", "tool_use"), ("started", "complete", "aborted"), ("allow", "deny"), ("claude", "codex", "cursor", "opencode")
SUMMARY_FIELDS = ("agent", "id", "file", "title", "cwd", "git_branch", "version", "first_ts", "last_ts", "n_user", "n_assistant", "n_tool", "n_web", "n_records", "model", "mtime")


class _Json:
    """Tests of a VARIANT's fields."""

    def __init__(self, value: Column):
        self.value = value

    def get(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "variant")

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "string")

    def lacks(self, *names: str) -> Column:
        """None of the fields is there, be it with a null."""
        return reduce(lambda a, b: a & b, (self.get(n).isNull() for n in names))

    def isnt(self, name: str, kind: str, optional: bool = False) -> Column:
        """The field is of another type, or not there unless it may be."""
        other = ~F.startswith(F.schema_of_variant(self.get(name)), F.lit(kind))
        return F.coalesce(other, F.lit(not optional))

    def outside(self, name: str, values: tuple[str, ...]) -> Column:
        return self.isnt(name, "STRING") | ~F.coalesce(self.text(name).isin(*values), F.lit(False))

    def empty(self, name: str) -> Column:
        """The field is no array, or has no elements."""
        return self.isnt(name, "ARRAY") | (F.coalesce(F.size(F.try_variant_get(self.value, f"$.{name}", "array<variant>")), F.lit(0)) == 0)


def _broken(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(broken, problem) for broken, problem in rules)))


def _event_problems(value: Column) -> Column:
    """Problems of an event itself, not of the blocks or events within it."""
    ev = _Json(value)
    kind = F.coalesce(F.when(~ev.isnt("kind", "STRING"), ev.text("kind")), F.lit(""))
    flat = ev.lacks("blocks")
    rules = {
        ("user", "assistant"): [(~flat & ev.empty("blocks"), "blocks must be a list that isn't empty"), (flat & ev.isnt("text", "STRING"), "text must be a text")],
        ("reasoning",): [(ev.isnt("text", "STRING"), "text must be a text"), (ev.isnt("has_encrypted", "BOOLEAN"), "has_encrypted must be a truth value")],
        ("tool",): [(ev.isnt("name", "STRING"), "name must be a text"), (ev.lacks("input"), "input is missing"), (ev.lacks("result"), "result is missing"), (ev.isnt("summary", "STRING", True), "summary must be a text")],
        ("web_search", "web_call"): [(ev.lacks("query", "action"), "query or action is missing")],
        ("instructions",): [(ev.isnt(f, "STRING"), f"{f} must be a text") for f in ("role", "label", "text")],
        ("system",): [(ev.isnt("text", "STRING"), "text must be a text"), (F.coalesce(ev.text("subtype") == "compact_boundary", F.lit(False)) & ev.isnt("compaction", "OBJECT"), "compaction must be an object")],
        ("notice",): [(ev.isnt(f, "STRING"), f"{f} must be a text") for f in ("label", "text")],
        ("attachment",): [(ev.lacks("att_type"), "att_type is missing")],
        ("guardian_request",): [(ev.isnt("request", "OBJECT"), "request must be an object")],
        ("guardian_decision",): [(ev.outside("outcome", OUTCOMES), "outcome is unknown")],
        ("status",): [(ev.outside("status", STATES), "status is unknown")],
        ("context",): [(ev.lacks("turn_id"), "turn_id is missing")],
        ("tokens",): [(ev.isnt("usage", "OBJECT"), "usage must be an object")],
        ("raw",): [(ev.lacks(f), f"{f} is missing") for f in ("record_type", "payload")],
        ("branch",): [(ev.empty("groups"), "groups must be a list that isn't empty"), (ev.isnt("count", "BIGINT"), "count must be a whole number")],
    }
    own = F.array().cast("array<string>")
    for kinds, listed in rules.items():
        own = F.when(kind.isin(*kinds), _broken(listed)).otherwise(own)
    known = kind.isin(*(k for kinds in rules for k in kinds))
    return F.when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.array(F.lit("event is no object"))).when(~known, F.array(F.lit("kind is unknown"))).otherwise(own)


def _block_problems(value: Column) -> Column:
    b, result = _Json(value), _Json(F.try_variant_get(value, "$.result", "variant"))
    kind = F.coalesce(b.text("type"), F.lit(""))
    answered = (kind == "tool_use") & F.coalesce(F.schema_of_variant(result.value) != "VOID", F.lit(False))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(result.value), F.lit("OBJECT")), F.lit(False))
    rules = [
        (~kind.isin(*BLOCK_TYPES), "block type is unknown"), (kind.isin("text", "thinking") & b.isnt("text", "STRING"), "text must be a text"), ((kind == "image") & b.isnt("data_uri", "STRING", True), "data_uri must be a text"),
        ((kind == "tool_use") & b.lacks("name"), "name is missing"), ((kind == "tool_use") & b.lacks("input"), "input is missing"), (answered & ~is_object, "result must be an object or null"),
        (answered & is_object & result.lacks("text"), "text of the result is missing"), (answered & is_object & result.isnt("images", "ARRAY", True), "images of the result must be a list"),
    ]
    return F.when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.array(F.lit("block is no object"))).otherwise(_broken(rules))


def _elements(rows: DataFrame, key: str, name: str, of: str) -> DataFrame:
    """(key, path, value) of the elements of a field's list, at their paths."""
    listed = F.try_variant_get("value", f"$.{name}", "array<variant>")
    return rows.select(key, "path", F.posexplode(listed).alias("_i", "value")).select(key, F.concat("path", F.lit(f"{of}["), F.col("_i").cast("string"), F.lit("]")).alias("path"), "value")


def session_violations(sessions: DataFrame, key: str) -> DataFrame:
    """(key, path, problem): what breaks the contract in whole sessions (key, value VARIANT), however deep, a row for each.

    Events are checked level by level: those of abandoned branches lie in groups within a branch event, and may hold branches
    again. A level is one pass over the branch events of the one above.
    """
    top = _Json(F.col("value"))
    rules = [(top.outside("agent", AGENTS), "agent is unknown"), (top.isnt("id", "STRING") | F.coalesce(top.text("id") == "", F.lit(False)), "id must be a text"), (top.isnt("title", "STRING"), "title must be a text"), (top.isnt("meta", "OBJECT"), "meta must be an object"), (top.isnt("events", "ARRAY"), "events must be a list")]
    problems = lambda rows, listed: rows.select(key, "path", F.explode(listed).alias("problem"))
    found = [problems(sessions.select(key, F.lit("session").alias("path"), "value"), _broken(rules))]
    events = _elements(sessions.select(key, F.lit("").alias("path"), "value"), key, "events", "events")
    while True:
        found.append(problems(events, _event_problems(F.col("value"))))
        kind = F.try_variant_get("value", "$.kind", "string")
        blocks = _elements(events.where(kind.isin("user", "assistant")), key, "blocks", ".blocks")
        found.append(problems(blocks, _block_problems(F.col("value"))))
        groups = _elements(events.where(kind == "branch"), key, "groups", ".groups")
        if groups.isEmpty():
            return reduce(DataFrame.unionByName, found)
        lists = F.startswith(F.schema_of_variant("value"), F.lit("ARRAY"))
        found.append(problems(groups.where(~lists), F.array(F.lit("group is no list"))))
        inner = groups.where(lists).select(key, "path", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("_i", "value"))
        events = inner.select(key, F.concat("path", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("path"), "value")


def listed_violations(summaries: DataFrame, key: str) -> DataFrame:
    """(key, path, problem) of summaries as JSON (key, value VARIANT): fields that are missing, an unknown agent."""
    s = _Json(F.col("value"))
    rules = [*((s.lacks(f), f"{f} is missing") for f in SUMMARY_FIELDS), (s.outside("agent", AGENTS), "agent is unknown")]
    return summaries.select(key, F.lit("summary").alias("path"), F.explode(_broken(rules)).alias("problem"))


def no_violations(found: list[DataFrame]) -> bool:
    """Whether none of the checks found anything."""
    return reduce(lambda a, b: a and b, (df.isEmpty() for df in found), True)
