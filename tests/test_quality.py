"""The event contract's rules, one by one, in sessions given as JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import quality

CASES = [
    ({"kind": "user", "text": "x"}, []), ({"kind": "user", "blocks": []}, [("", "blocks must be a list that isn't empty")]), ({"kind": "assistant"}, [("", "text must be a text")]),
    ({"kind": "assistant", "blocks": [{"type": "image", "data_uri": 1}, {"type": "tool_use", "result": 3}, "x"]}, [(".blocks[0]", "data_uri must be a text"), (".blocks[1]", "name is missing"), (".blocks[1]", "input is missing"), (".blocks[1]", "result must be an object or null"), (".blocks[2]", "block is no object")]),
    ({"kind": "user", "blocks": [{"type": "tool_use", "name": "n", "input": None, "result": {"text": None, "images": {}}}]}, [(".blocks[0]", "images of the result must be a list")]),
    ({"kind": "user", "blocks": [{"type": "tool_use", "name": "n", "input": {}, "result": None}, {"type": "image"}]}, []), ({"kind": "reasoning", "text": "x", "has_encrypted": 1}, [("", "has_encrypted must be a truth value")]),
    ({"kind": "tool", "name": 1, "input": None, "result": None, "summary": []}, [("", "name must be a text"), ("", "summary must be a text")]), ({"kind": "web_call", "action": None}, []), ({"kind": "web_search"}, [("", "query or action is missing")]),
    ({"kind": "system", "text": "x", "subtype": "compact_boundary"}, [("", "compaction must be an object")]), ({"kind": "guardian_decision", "outcome": "maybe"}, [("", "outcome is unknown")]), ({"kind": "tokens", "usage": []}, [("", "usage must be an object")]),
    ({"kind": "raw", "payload": None}, [("", "record_type is missing")]), ({"kind": "branch", "groups": [], "count": "1"}, [("", "groups must be a list that isn't empty"), ("", "count must be a whole number")]), ({"kind": 7}, [("", "kind is unknown")]), ("x", [("", "event is no object")]),
]


def _got(spark, sessions):
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(sessions)], "k long, v string").select("k", F.parse_json("v").alias("value"))
    return sorted(map(tuple, quality.session_violations(df, "k").collect()))


def test_each_rule(spark):
    sessions = [{"agent": "codex", "id": "i", "title": "t", "meta": {}, "events": [ev]} for ev, _ in CASES]
    assert _got(spark, sessions) == sorted((i, f"events[0]{path}", problem) for i, (_, want) in enumerate(CASES) for path, problem in want)


@pytest.mark.parametrize("deep", [1, 3])
def test_branches_within_branches(spark, deep):
    event, path = {"kind": "bogus"}, ""
    for _ in range(deep):
        event, path = {"kind": "branch", "count": 1, "groups": [[{"kind": "user", "text": "x"}, event]]}, f".groups[0][1]{path}"
    session = {"agent": "codex", "id": "i", "title": "t", "meta": {}, "events": [{"kind": "user", "text": "x"}, event]}
    assert _got(spark, [session]) == [(0, f"events[1]{path}", "kind is unknown")]


def test_sessions_themselves(spark):
    assert [p for _, _, p in _got(spark, [{"agent": "x", "id": "", "events": {}}])] == sorted(["agent is unknown", "id must be a text", "title must be a text", "meta must be an object", "events must be a list"])
    whole = dict.fromkeys(quality.SUMMARY_FIELDS, None) | {"agent": "codex"}
    df = spark.createDataFrame([(0, json.dumps(whole)), (1, "{}")], "k long, v string").select("k", F.parse_json("v").alias("value"))
    got = quality.listed_violations(df, "k").collect()
    assert {r.k for r in got} == {1} and len(got) == len(quality.SUMMARY_FIELDS) + 1
