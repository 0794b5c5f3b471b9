"""Logs and stores of our own making, read and normalized."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracemill.operators import convert, quality, records, search
from tracemill.sources import jsonl, sqlite, store, tail
from tracemill.sources.sqlite import Stores


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def _says(kind, uuid, content, parent=None, **more):
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "timestamp": f"2025-01-01T00:00:0{uuid[-1]}Z", "cwd": "/workspace/example-project", "message": {"role": kind, "content": content} | more}


@pytest.fixture
def tree(tmp_path):
    _write(tmp_path / "-workspace-example-project/s1.jsonl", [
        _says("user", "u1", "Please list the files"), "", "{broken", '{"type":"api-request","x":1}', '{"type":"api-request-blob","hash":"h","message":{"role":"user","content":"x"}}',
        '{"type":"api-request-blob","hash":"h","message":{"role":"system","content":"# Environment\\ncwd: /w"}}', '{"type":"api-request-shape","timestamp":"t0","shape":{"system":"Be good","tools":[{"name":"Bash"}]}}',
        _says("assistant", "u2", [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "text", "text": "I will."}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "pwd"}}], "u1", id="m1", model="m-one"),
        _says("user", "u3", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a.txt"}], "is_error": False}], "u2"),
        _says("user", "u4", "<system-reminder>be brief</system-reminder>", "u3"), {"type": "strange", "uuid": "u5", "timestamp": "x"}, {"type": "pr-link", "prUrl": "javascript:1", "prRepository": "r"},
    ])
    _write(tmp_path / "-workspace-example-project/s1/subagents/agent-9.jsonl", [_says("user", "u1", "Sub task")])
    return str(tmp_path)


def test_tree_logs(spark, tree):
    raw = jsonl.tree_logs(spark, tree)
    assert {(r.session_key, r.parent_id, r.project) for r in raw.select("session_key", "parent_id", "project").distinct().collect()} == {("s1", None, "-workspace-example-project"), ("agent-9", "s1", "-workspace-example-project")}
    events = records.tree_events(raw).where("session_key = 's1'").orderBy("seq", "block").collect()
    got = [(e.seq, e.block, e.kind, e.text, e.label) for e in events]
    assert got == [
        (-1, 0, "instructions", "Be good\n\n— Tools (1): Bash", "System prompt"), (-1, 1, "instructions", "# Environment\ncwd: /w", "Environment"), (0, 0, "user", "Please list the files", None),
        (3, 0, "reasoning", "hm", None), (3, 1, "tool", None, None), (3, 2, "assistant", "I will.", None), (3, 3, "tool", None, None),
        (5, 0, "notice", "<system-reminder>be brief</system-reminder>", "System reminder"), (6, 0, "raw", None, "strange"), (7, 0, "attachment", None, "pr-link"),
    ]
    call = next(e for e in events if e.kind == "tool")
    assert (call.name, call.result, call.is_error, call.call_id) == ("Bash", "a.txt", False, "t1")
    assert quality.violations(records.tree_events(raw), ["session_key", "seq"]).isEmpty()
    found = search.segments(search.event_text(records.tree_events(raw))).where("session_key = 's1'").first()
    assert found.user_text == "Please list the files" and found.rest_text.startswith("/workspace/example-project") and "ls" in found.rest_text


def test_layouts_at_once(spark, tree, tmp_path):
    from tracemill.sources import registry

    def keep(df, name):
        df.write.parquet(f"file://{tmp_path}/kept/{name}")
        return spark.read.parquet(f"file://{tmp_path}/kept/{name}")

    events, broken = registry.all_events(spark, {"tree": tree, "exports": str(tmp_path / "none"), "chats": tree}, keep)
    assert sorted(broken) == ["exports"] and {r.origin for r in events.select("origin").distinct().collect()} == {"tree"}


def test_rollout_logs(spark, tmp_path):
    name = "rollout-2025-01-01T00-00-00-01234567-89ab-cdef-0123-456789abcdef.jsonl"
    line = lambda kind, **payload: {"timestamp": "2025-01-01T00:00:00Z", "type": kind, "payload": payload}
    rows = [
        line("session_meta", id="x"), line("event_msg", type="user_message", message="Do  it"), line("response_item", type="message", role="user", content=[{"type": "input_text", "text": "Do it"}]),
        line("response_item", type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>x</environment_context>"}]), line("response_item", type="reasoning", summary=[{"type": "summary_text", "text": "why"}], encrypted_content="zz"),
        line("response_item", type="function_call", name="exec", arguments='{"cmd":"ls"}', call_id="c1"), line("response_item", type="function_call_output", call_id="c1", output='Output: {"output":"no","metadata":{"exit_code":2}}'),
        line("response_item", type="new_thing"), line("event_msg", type="task_complete", turn_id="t"),
    ]
    _write(tmp_path / "live/2025/01/01" / name, rows)
    _write(tmp_path / "old" / name, rows[:2])
    raw = jsonl.rollout_logs(spark, [str(tmp_path / "live"), str(tmp_path / "old")])
    assert raw.count() == len(rows)
    events = records.rollout_events(raw).collect()
    assert sorted((e.kind, e.text or "", e.label or "") for e in events if e.kind not in ("tool",)) == [("instructions", "<environment_context>x</environment_context>", "Environment context"), ("raw", "", "response_item/new_thing"), ("reasoning", "why", "encrypted"), ("status", "", "complete"), ("user", "Do  it", "")]
    call = next(e for e in events if e.kind == "tool")
    assert (call.name, call.result, call.is_error, call.label) == ("exec", "no", True, "orchestration code")


def test_stores(spark, tmp_path):
    ide, three, chat = tmp_path / "state.vscdb", tmp_path / "three.db", tmp_path / "w/chat-1/store.db"
    chat.parent.mkdir(parents=True)
    con = sqlite3.connect(ide)
    con.execute("CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value BLOB)")
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [
        ("composerData:c1", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "b2", "type": 1}, {"bubbleId": "b1", "type": 2}]})), ("bubbleId:c1:b1", json.dumps({"type": 2, "text": "reply"})),
        ("bubbleId:c1:b2", json.dumps({"type": 1, "text": "<user_query>ask</user_query>"})), ("other", "x"),
    ])
    con.commit()
    con.close()
    events = records.bubble_events(*sqlite.ide_store(Stores.below(spark, str(tmp_path), "*.vscdb"))).orderBy("seq").collect()
    assert [(e.seq, e.kind, e.text) for e in events] == [(0, "user", "ask"), (1, "assistant", "reply")]
    con = sqlite3.connect(three)
    con.execute("CREATE TABLE session (id, parent_id, directory, title, version, time_created, time_updated)")
    con.execute("CREATE TABLE message (id, session_id, time_created, data)")
    con.execute("CREATE TABLE part (id, message_id, session_id, data)")
    con.execute("INSERT INTO session VALUES ('s', NULL, '/w', 'New session - 1', '1', 1, 2)")
    con.execute("INSERT INTO message VALUES ('m1', 's', 5, '{\"role\":\"user\"}'), ('m2', 's', 6, '{\"role\":\"assistant\",\"providerID\":\"p\",\"modelID\":\"m\"}')")
    con.executemany("INSERT INTO part VALUES (?, ?, 's', ?)", [("p1", "m1", '{"type":"text","text":"hi"}'), ("p2", "m1", '{"type":"text","text":"aux","synthetic":true}'), ("p3", "m2", '{"type":"tool","tool":"read","callID":"c","state":{"status":"error","input":{"filePath":"a"},"error":"gone"}}'), ("p4", "m2", '{"type":"step-start"}')])
    con.commit()
    con.close()
    _, messages, parts = sqlite.three_tables(Stores.below(spark, str(tmp_path), "three.db"))
    events = records.part_events(messages, parts).withColumn("input", F.to_json("input")).orderBy("seq", "block").collect()
    assert [(e.kind, e.text, e.label, e.model) for e in events] == [("user", "hi", None, None), ("notice", "aux", "Injected", None), ("tool", None, None, "p/m")]
    assert (events[2].name, events[2].input, events[2].result, events[2].is_error) == ("read", '{"file_path":"a"}', "gone", True)
    con = sqlite3.connect(chat)
    con.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
    con.executemany("INSERT INTO blobs VALUES (?, ?)", [("a", b'{"role":"user","content":"<user_info>x"}'), ("b", b'\x02\x01{"role":"assistant","content":[{"type":"text","text":"yes"},{"type":"tool-call","toolCallId":"k","toolName":"rg","args":{"pattern":"z"}}]}'), ("c", b'{"role":"tool","content":[{"type":"tool-result","toolCallId":"k","result":"hit"}]}'), ("d", b"\x00\x01")])
    con.commit()
    con.close()
    events = records.blob_events(sqlite.blob_messages(Stores.below(spark, str(tmp_path), "store.db"))).collect()
    assert sorted((e.kind, e.text or "", e.name or "", e.result or "") for e in events) == [("assistant", "yes", "", ""), ("tool", "", "Grep", "hit")]


def test_names_sidecars_and_captures(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"a:1": " One ", "b:2": 3, "c:3": " "}))
    assert [tuple(r) for r in jsonl.custom_names(spark, str(tmp_path / "names.json")).collect()] == [("a:1", "One")]
    (tmp_path / "side").mkdir()
    (tmp_path / "side/meta.json").write_text('{"title":"T","cwd":"/w","createdAtMs":5}')
    assert jsonl.sidecars(spark, str(tmp_path / "side")).select("title", "cwd", "created_ms").first() == ("T", "/w", 5)
    row = spark.range(1).select(F.to_json(jsonl.plain_or_hex(F.lit(b'{"a":1}'.hex()))), F.to_json(jsonl.plain_or_hex(F.lit('{"b":2}'))), jsonl.last_workspace(F.lit("workspacePath=/a x\nworkspacePath=/b"))).first()
    assert tuple(row) == ('{"a":1}', '{"b":2}', "/b")
    (tmp_path / "index.json").write_text(json.dumps({"files": {"k1": {"source": "s", "status": "active", "flags": ["truncated"]}, "k2": {"source": "s", "status": "active", "flags": []}}}))
    _write(tmp_path / "events.jsonl", [{"t": "1", "type": "truncated", "key": "k1"}, "{"])
    index, events = store.capture_index(spark, str(tmp_path / "index.json")), store.capture_events(spark, str(tmp_path / "events.jsonl"))
    assert [(r.key, r.type) for r in store.flagged_report(index, events).collect()] == [("k1", "truncated")]


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "table")
    store.replace_by_key(path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    out = store.replace_by_key(path, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_keyed_table(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    opened = lambda: store.KeyedTable(spark, f"file://{tmp_path}/keyed", "k", schema, buckets=4)
    want = {}
    for n in range(3):
        rows = {i: f"{n}.{i}" for i in range(n * 5, n * 5 + 12)}
        opened().upsert(spark.createDataFrame(list(rows.items()), schema))
        want |= rows
        assert {r.k: r.v for r in opened().read().collect()} == want and opened().read().count() == len(want)
    opened().upsert(spark.createDataFrame([], schema))
    assert opened().buckets.version == 3 and opened().read().count() == len(want)


def test_late_copies_count_once(spark, tmp_path):
    from tracemill.streaming import summary

    rows = [(i, i % 3, "view" if i % 2 else "click", f"2025-01-01 00:00:{i:02d}") for i in range(40)]
    for n, part in enumerate((rows[:25], rows[10:], rows[30:])):
        spark.createDataFrame(part, "event_id int, user int, kind string, t string").selectExpr("*", "cast(t as timestamp) AS ts").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("event_id int, user int, kind string, t string, ts timestamp").parquet(f"file://{tmp_path}/in")
        counted = summary.running_tallies(stream, ["user"], "kind", ["view"], "event_id", "ts")
        got = summary.run_available(counted, f"file://{tmp_path}/table", f"file://{tmp_path}/at", "user").collect()
        seen = {r[0]: r for r in (*rows[:25], *(rows if n else []))}.values()
        assert {(r.user, r.n_all, r.n_view) for r in got} == {(u, sum(r[1] == u for r in seen), sum(r[1] == u and r[2] == "view" for r in seen)) for u in range(3)}


def test_write_rollouts(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2025-01-01", i, "t", "message", json.dumps({"n": i})) for i in range(3)], "session_key string, day string, line int, ts string, record_type string, p string")
    convert.write_rollouts(rows.select("session_key", "day", "line", "ts", "record_type", F.parse_json("p").alias("payload")), str(tmp_path / "out"))
    text = next((tmp_path / "out/day=2025-01-01/session_key=s").glob("part-*")).read_text().splitlines()
    assert [json.loads(x)["payload"]["n"] for x in text] == [0, 1, 2]


def test_tail(spark, tmp_path):
    file, rows = tmp_path / "log.jsonl", []
    file.write_text("one\ntwo\nhal")
    reader = lambda: tail.TailReader(str(tmp_path / "*.jsonl"), str(tmp_path / "state"))
    lines = lambda r, a, b: [x[1:] for p in r.partitions(a, b) for x in r.read(p)]
    own = reader()
    first = own.latestOffset()
    assert lines(own, own.initialOffset(), first) == [(0, "one", 0), (4, "two", 0)]
    # a half-written line waits, and nothing new is no new offset
    assert own.latestOffset() == first
    with file.open("a") as more:
        more.write("f\nnew\n")
    second = own.latestOffset()
    assert lines(own, first, second) == [(8, "half", 0), (13, "new", 0)]
    # a restart knows what was read, and reads a batch again as it was
    again = reader()
    assert again.latestOffset() == second and lines(again, first, second) == [(8, "half", 0), (13, "new", 0)]
    # the bytes before the stop changed while the file grew
    file.write_text("one\ntwo\nhalf\nNEW\nmore\n")
    third = again.latestOffset()
    assert lines(again, second, third) == [(-1, None, 1), (0, "one", 1), (4, "two", 1), (8, "half", 1), (13, "NEW", 1), (17, "more", 1)]
    file.write_text("")
    fourth = again.latestOffset()
    assert lines(again, third, fourth) == [(-1, None, 2)]
    file.write_text("gone\n")
    assert lines(again, fourth, again.latestOffset()) == [(0, "gone", 2)]
    spark.dataSource.register(tail.TailSource)
    out = tmp_path / "out"
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "*.jsonl")).option("state", str(tmp_path / "other")).load()
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        query.processAllAvailable()
        rows = [r.value for r in spark.read.parquet(str(out)).collect()]
    finally:
        query.stop()
    assert rows == ["gone"]


def test_tail_pieces_and_records(tmp_path, monkeypatch):
    """A large file is read by several tasks, each line once; records of change are gathered."""
    monkeypatch.setattr(tail, "PIECE", 50)
    monkeypatch.setattr(tail, "TRIGGERS", 3)
    rng, file, want = random.Random(6), tmp_path / "a.jsonl", []
    reader = tail.TailReader(str(tmp_path / "*.jsonl"), str(tmp_path / "state"))
    at = reader.initialOffset()
    for n in range(12):
        new = ["é" * rng.randint(0, 90) + str(n) for _ in range(20)]
        with file.open("a") as more:
            more.writelines(x + "\n" for x in new)
        want += new
        now = reader.latestOffset()
        spans = reader.partitions(at, now)
        assert len(spans) > 1 and [v for p in spans for _, _, v, _ in reader.read(p)] == new
        at = now
        reader.commit(at)
        if n % 4 == 3:
            reader = tail.TailReader(str(tmp_path / "*.jsonl"), str(tmp_path / "state"))
    assert len(list((tmp_path / "state").glob("*"))) <= 6


def test_captures_are_ordered_over_frames(spark, tmp_path):
    from tracemill.streaming import capture

    rng = random.Random(8)
    shots = [(i % 3 % 2, i, rng.randint(0, 1), rng.randint(0, 3), rng.random() < 0.7) for i in range(400)]
    shots = [(str(p), *rest) for p, *rest in shots]
    schema = "path string, event_id long, identity long, size long, prefix_same boolean"
    mixed = rng.sample(shots, len(shots))
    for i in range(4):
        spark.createDataFrame(mixed[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wanted, last = set(), {}
    for path, event_id, identity, size, same in shots:
        old = last.get(path)
        change = capture.change_of(old, identity, size, same)
        last[path] = (identity, size, (old[2] if old else 0) + (change in ("truncated", "rewritten", "replaced", "started")))
        wanted.add((path, event_id, change, last[path][2]))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = capture.changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("path", "event_id", "change", "generation").collect()} == wanted


def test_deletions_by_timer(spark, tmp_path):
    from tracemill.streaming import capture

    polls = [(0, "ab"), (10, "ab"), (20, "a"), (30, "a"), (40, "a"), (50, "ab"), (60, "ab"), (70, "ab")]
    events = []
    for t, seen in polls:
        rows = [(x, t) for x in seen]
        spark.createDataFrame(rows, "path string, t int").selectExpr("path", "timestamp_seconds(t) AS seen").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("path string, seen timestamp").parquet(f"file://{tmp_path}/in")
        out = capture.deletions(stream, 20)
        out.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        events = sorted((r.last_seen // 1000, r.path, r.event) for r in spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out").collect())
    assert events == [(10, "b", "deleted"), (50, "b", "found")]


def test_tail_deals_many_small_files_to_few_tasks(tmp_path):
    """Tasks follow the bytes: a thousand small files are read by fewer than a hundred tasks, each line once."""
    for n in range(1000):
        (tmp_path / f"{n:04}.jsonl").write_text(f"a{n}\nb{n}\n")
    reader = tail.TailReader(str(tmp_path / "*.jsonl"), str(tmp_path / "state"))
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) < 100 and sorted(v for t in tasks for _, _, v, _ in reader.read(t)) == sorted(x for n in range(1000) for x in (f"a{n}", f"b{n}"))


def test_stores_are_not_gathered_into_arrow_batches(spark, tmp_path):
    """Each store is a large value: 200 of them of 200 KB go through Python a few at a time, with their rows."""
    import sqlite3

    from tracemill.sources import sqlite

    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (a TEXT)")
    con.executemany("INSERT INTO t VALUES (?)", [("x" * 1000,)] * 200)
    files = spark.createDataFrame([(f"s{n}",) for n in range(200)], "path string").coalesce(1).withColumn("content", F.lit(bytearray(con.serialize())))
    rows = sqlite.Stores(files).rows("SELECT a, length(a) FROM t", "a string, n long")
    assert "InPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.agg(F.count("*"), F.countDistinct("store"), F.sum("n")).first()[:] == (40_000, 200, 40_000_000)
