"""Operators that SQL doesn't check, against plain restatements of their rules on random data."""

import random

from pyspark.sql import functions as F

from tracemill.functions.checkpoints import with_checkpoints
from tracemill.functions.text import normalized
from tracemill.operators import aggregates, capture, facets, joins, records, search, sets, tree, windows
from tracemill.operators.index import SearchIndex


def test_last_kept(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.randrange(14)) for s in range(6) for i in range(300)]
    want = []
    for s in range(6):
        kept = []
        for _, i, v in (r for r in rows if r[0] == s):
            if v not in kept[-8:]:
                kept.append(v)
                want.append((s, i))
    rng.shuffle(rows)
    got = windows.last_kept(spark.createDataFrame(rows, "s int, i int, v int"), ["s"], ["i"], "v").select("s", "i").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fold_against_a_walk(spark):
    with_checkpoints(spark)
    rng, rows, tips, want = random.Random(2), [], [], {}
    for s in range(12):
        n = rng.randint(1, 150)
        parent = [None] + [i - 1 if rng.random() < 0.9 else rng.randrange(i) for i in range(1, n)]
        tip = n - 1
        rows += [(s, i, p, i) for i, p in enumerate(parent)]
        tips.append((s, tip))
        path, at = set(), tip
        while at is not None:
            path.add(at)
            at = parent[at]
        groups: dict = {}
        for i in range(n):
            if i in path:
                want[s, i] = (True, None, None)
                continue
            root = i
            while parent[root] not in path:
                root = parent[root]
            fork = groups.setdefault(parent[root], [])
            if root not in fork:
                fork.append(root)
            want[s, i] = (False, parent[root], fork.index(root) + 1)
    edges = spark.createDataFrame(rows, "session int, node int, parent int, first_idx int")
    got = tree.fold(edges, spark.createDataFrame(tips, "session int, tip int")).collect()
    assert {(r.session, r.node): (r.is_active, r.branch_id, r.branch_group) for r in got} == want


def test_jumping_ends_on_a_cycle(spark):
    with_checkpoints(spark)
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], "session int, node int, parent int")
    assert tree.jumped(edges).where("node = 3").first().root == 3


def test_turn_groups(spark):
    with_checkpoints(spark)
    rows = [
        (1, 0, "u", None, "user", None, None, None), (1, 1, "a", "u", "assistant", "m1", "c", None), (1, 2, "r", "a", "result", None, None, "c"),
        (1, 3, "x", "r", "meta", None, None, None), (1, 4, "y", "x", "meta", None, None, None), (1, 5, "v", "y", "user", None, None, None), (1, 6, "z", "v", "meta", None, None, None),
    ]
    df = spark.createDataFrame(rows, "session int, seq int, uuid string, parent string, kind string, message_id string, call_id string, owner_call string")
    got = {r.uuid: r.node for r in tree.turn_groups(df).collect()}
    assert got == {"u": "u:u", "a": "m:m1", "r": "m:m1", "x": "m:m1", "y": "m:m1", "v": "u:v", "z": "o:z"}


def test_chunks_equal_the_whole(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["ab", "É", " ", "\n", "’", "ﬁ", "​"], k=rng.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in search.chunks(df, ["i"], "t", 16).collect():
        got.setdefault(r.i, []).append((r.src_start, r.norm_start, r.norm_at, r.chunk, r.norm))
    for i, t in enumerate(texts):
        parts = sorted(got.get(i, []))
        whole = normalized(t)
        assert "".join(c for *_, c, _ in parts) == t and all(c.endswith("\n") for *_, c, _ in parts[:-1])
        assert " ".join(n for *_, n in parts if n) == whole
        assert all(whole[a : a + len(n)] == n and whole.encode()[b : b + len(n.encode())] == n.encode() for _, b, a, _, n in parts)


def test_index_is_refreshed_by_fingerprint(spark, tmp_path):
    rng = random.Random(9)
    texts = {i: "\n".join(" ".join(rng.choices(["Über", "the", "  ﬁne", "“quote”", "x"], k=9)) for _ in range(rng.randint(0, 6))) for i in range(40)}
    opened = lambda: SearchIndex(spark, f"file://{tmp_path}/index", buckets=4, chunk=80)
    asked = []

    def load(some):
        asked.append(sorted(r.file for r in some.collect()))
        return spark.createDataFrame([(i, t[:5], t) for i, t in texts.items()], "file long, user_text string, rest_text string").join(some, "file", "left_semi")

    def listed(prints):
        return spark.createDataFrame(list(prints.items()), "file long, fingerprint string")

    prints = {i: "a" for i in range(40)}
    assert opened().refresh(listed(prints), load) and not opened().refresh(listed(prints), load)
    texts[3] += "\nthe the"
    del prints[7]
    prints |= {3: "b", 99: "a"}
    texts[99] = "the end"
    index = opened()
    assert index.refresh(listed(prints), load) and asked == [list(range(40)), [3, 99]] and index.buckets.version == 2
    want = {i: (normalized(texts[i][:5]).count("the"), normalized(texts[i]).count("the")) for i in prints}
    hits = opened().search("  THE ")
    assert {r.file: (r.n_user, r.n_rest) for r in hits.collect()} == {i: n for i, n in want.items() if any(n)}
    for r in index.located("the", hits).collect():
        source, base = (texts[r.file][:5], 0) if r.segment == "user" else (texts[r.file], len(texts[r.file][:5]))
        begin, end = search.found_in(source, "the")
        assert (r.position, r.snippet) == (base + begin, search.context(source, begin, end))
    assert index.refresh(listed({}), load) and index.docs().isEmpty() and opened().search("the").isEmpty()


def test_located(spark):
    df = spark.createDataFrame([(1, "", "Über  ﬁne   THE “quote” end"), (2, "the title", "x"), (3, "no", "nothing")], "i long, a string, b string")
    got = {r.i: (r.tier, r.position) for r in search.located(df, ["a", "b"], F.lit("the")).collect()}
    assert got == {1: (1, 12), 2: (0, 0), 3: (None, None)}


def test_numbered_is_a_total_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(50)) for i in range(2000)]
    got = facets.numbered(spark.createDataFrame(rows, "i int, k int"), [F.col("k").desc(), F.col("i")], "n").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and sorted(r.n for r in got) == list(range(1, 2001))


def test_numbers_within_large_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), i, "x" * (i % 7)) for i in rng.sample(range(3000), 3000)]
    got = windows.numbered_within(spark.createDataFrame(rows, "g string, i int, t string").repartition(7), ["g"], ["i"], "n").collect()
    for g in "ab":
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == sorted(i for x, i, _ in rows if x == g) and {r.n for r in got if r.g == g} == set(range(sum(x == g for x, *_ in rows)))


def test_joins_of_small_tables(spark):
    sql = lambda q: spark.sql(q)
    sessions = sql("SELECT 'a' AS agent, '' AS parent, '1' AS id, 'live' AS title UNION ALL SELECT 'a', 'p', '2', NULL")
    names = sql("SELECT 'a:p:2' AS key, 'mine' AS name")
    assert {r.id: r.custom_title for r in joins.named(sessions, names).collect()} == {"1": None, "2": "mine"}
    both = joins.live_with_captures(sql("SELECT 'x' AS path"), sql("SELECT 'x' AS path, 1 AS k UNION ALL SELECT 'y', 2"), "path")
    assert {(r.path, r.live, r.k) for r in both.collect()} == {("x", True, 1), ("y", False, 2)}
    found = joins.dereferenced(sql("SELECT 1 AS s, array('h2', 'no', 'h1') AS hs"), sql("SELECT 'h1' AS id, 'one' AS data UNION ALL SELECT 'h2', 'two'"), "s", "hs").first()
    assert (found.found, found.missing) == (["two", "one"], 1)
    over = joins.overridden(sql("SELECT 'p' AS path, 'old' AS title, 'x' AS cwd"), sql("SELECT 'p' AS path, 'new' AS title, CAST(NULL AS STRING) AS cwd"), "path", ["title", "cwd"]).first()
    assert (over.title, over.cwd) == ("new", "x")
    prompts = sql("SELECT 1 AS s, 'a  b' AS t")
    assert [r.t for r in joins.unrepeated(sql("SELECT 1 AS s, 'a b' AS t UNION ALL SELECT 1, 'c'"), prompts, ["s"], "t").collect()] == ["c"]
    again = joins.recreated_from(sql("SELECT 'k1' AS key, '/p' AS path, 1 AS t, 5 AS deleted_at UNION ALL SELECT 'k2', '/p', 6, NULL"))
    assert {r.key: r.recreated_from for r in again.collect()} == {"k1": None, "k2": "k1"}
    moved = joins.moved_to(sql("SELECT 7 AS ino, '/a' AS path"), sql("SELECT 7 AS ino, '/b' AS path"), ["ino"]).first()
    assert tuple(moved) == ("/a", "/b")
    assert sets.current_version(sql("SELECT '1' AS version UNION ALL SELECT '2'"), "2").count() == 1
    late = capture.deletions(sql("SELECT 's' AS source, explode(array(10, 20, 30)) AS t"), sql("SELECT 's' AS source, '/a' AS path, 10 AS last_seen UNION ALL SELECT 's', '/b', 20"), ["source"])
    assert [tuple(r) for r in late.collect()] == [("s", "/a", 10, 30)]
    marks = aggregates.capture_status(sql("SELECT 's' AS source, array('x') AS flags, 'active' AS status UNION ALL SELECT 's', array(), 'deleted'")).first()
    assert tuple(marks) == ("s", 2, 1, 1)


def test_record_columns(spark):
    row = spark.sql("""SELECT parse_json('{"command":"ls  -l"}') AS v""").select(
        records.clean_prompt(F.lit("<timestamp>x</timestamp><user_query>\nask me\n</user_query>")), records.nested_calls(F.lit("tools.a(1) // tools.b()\n'tools.c()' tools.d ()")),
        records.paths_named(F.lit("*** Add File: a.txt\n*** Move to:  b.txt ")), F.to_json(records.review_request(F.lit('say Planned action JSON: {"ok":true} thanks'))), records.image_class(F.lit("data:image/png;base64,xx")),
        records.safe_link(F.lit("javascript:x")), records.encrypted(F.parse_json(F.lit('[{"type":"reasoning.encrypted"}]'))), records.tool_label(F.lit("shell"), F.parse_json(F.lit('{"cmd":"ls  -l"}'))),
    )
    assert tuple(row.first()) == ("ask me", ["a", "d"], ["a.txt", "b.txt"], '{"ok":true}', "inline", None, True, "ls  -l")


def test_more_record_columns(spark):
    value = lambda x: F.parse_json(F.lit(x))
    row = spark.range(1).select(
        F.to_json(records.tool_input(F.lit("edit"), value('{"filePath":"a","oldString":"b","x":1}'))), F.to_json(records.tool_input(F.lit("Read"), value('{"path":"a","file_path":"b"}'))),
        F.to_json(records.tool_input(F.lit("other"), value('{"filePath":"a"}'))), F.to_json(records.tool_input(F.lit("Read"), value('"text"'))),
        records.tool_label(F.lit("apply_patch"), value('"*** Add File: a.txt\\n*** Move to: b"')), records.tool_label(F.lit("exec"), value('{"calls":[{"name":"a"},{"name":"b"}]}')), records.tool_label(F.lit("x"), value('{"k":"one\\ntwo"}')),
        records.readable_text(value('{"message":{"content":[{"type":"text","text":"a  b"},{"type":"tool_use","name":"Bash","input":{"command":"ls"}},{"type":"tool_result","content":[{"type":"text","text":"out"}]},{"type":"thinking","thinking":"hm"}]}}')),
        records.readable_text(value('{"payload":{"name":"exec","content":[],"arguments":"run it"}}')), records.readable_text(value('{"content":"plain"}')), records.readable_text(value("[]")), F.to_json(records.review_decision(F.lit('{"outcome":"deny"}'))), records.review_decision(F.lit("no")).isNull(),
    )
    assert tuple(row.first()) == (
        '{"file_path":"a","old_string":"b","x":1}', '{"file_path":"b"}', '{"filePath":"a"}', '"text"', "a.txt, b", "a · b", "k: one", "a b [Bash] ls [result] out (thinking) hm",
        "[exec] run it", "plain", "", '{"outcome":"deny"}', True,
    )


def test_containment(spark):
    wholes = ["one two three four five six seven eight nine", "alpha beta gamma", "x y"]
    texts = ["wo three four five six seven eigh", "two three nine four five six seven", "beta", "pha beta gam", "y", "three four five six seven", "zz", "beta"]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "s int, k int, t string")
    right = spark.createDataFrame([(1, i, w) for i, w in enumerate(wholes)], "s int, whole_key int, w string")
    want = {(i, j) for i, t in enumerate(texts) for j, w in enumerate(wholes) if t in w}
    for by in (["s"], []):
        assert {tuple(r) for r in joins.containing(left, right, by, "k", "t", "w").collect()} == want
    none = right.where("whole_key = 99")
    assert sorted(r.k for r in joins.uncontained(left, none, ["s"], "k", "t", "w").collect()) == [0, 1, 3, 4, 6]


def test_sources_break_alone(spark, tmp_path):
    fine, odd = str(tmp_path / "fine"), str(tmp_path / "odd")
    spark.range(3).write.parquet(fine)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/x.parquet").write_text("no parquet")
    keep = lambda df, name: spark.createDataFrame(df.collect(), df.schema)
    got, broken = sets.union_available({"a": lambda: spark.read.parquet(fine), "b": lambda: spark.read.parquet(str(tmp_path / "none")), "c": lambda: spark.read.schema("id long").parquet(odd)}, keep)
    assert got.count() == 3 and sorted(broken) == ["b", "c"]


def test_chains_are_reconciled(spark):
    links = [(1, i, 10 * i, f"h{i}") for i in range(1, 5)] + [(2, 1, 5, "z1"), (2, 2, 9, "z2")]
    actual = spark.createDataFrame(links, "g int, link int, end long, head string")
    recorded = spark.createDataFrame([*links[:2], (2, 1, 5, "other")], "g int, link int, end long, head string")
    got = sorted((r.g, r.link, r.added) for r in capture.reconciled(recorded, actual, "g").collect())
    assert got == [(1, 1, False), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, False)]


def test_binary_records():
    from tracemill.operators import binary

    assert binary.fields(bytes.fromhex("0a0161" + "100c" + "1d01020304")) == [(1, b"a"), (2, 12), (3, b"\x01\x02\x03\x04")]
    assert binary.fields(b"\x0a\x05a") is None and binary.fields(b"\x0a") is None and binary.fields(b"\x07") is None and binary.fields(b"") == []
    frame = lambda tag, data: bytes([tag, len(data)]) + data
    many = b"".join(frame(0x0A, f"row {i}".encode()) for i in range(9))
    record = frame(0x2A, frame(0x0A, b"asked") + frame(0x12, many + frame(0x12, frame(0x0A, "é ü".encode())) + frame(0x0A, b"\xff\xfe")))
    import base64

    assert binary.result_of(base64.b64encode(record).decode()) == "\n".join([*(f"row {i}" for i in range(9)), "é ü"])
    assert binary.result_of(None) == binary.result_of("no base64!") == ""


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_cut_in_their_rows(spark):
    """No shuffle, and no Python but for what NFKC might change; sums hold beyond a block of them."""
    texts = ["", "x" * 40, "".join(f"line {i} É\n\n" for i in range(900)), "a\n" * 700 + "b", "\n" * 20 + "\U0001f600" * 5 + " ﬁ\n" + " " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2).cache()
    made = search.chunks(df, ["i"], "t", 6)
    assert "Exchange" not in _plan(made).split("InMemoryTableScan")[0] and "MapInPandas" not in _plan(made)
    got = {}
    for r in made.collect():
        got.setdefault(r.i, []).append((r.n, r.src_start, r.norm_start, r.norm_at, r.chunk, r.norm))
    assert len(got[2]) > 600 and 0 not in got
    for i, t in enumerate(texts):
        start, norms, n = 0, [], 0
        for n, (k, src, low, at, chunk, norm) in enumerate(sorted(got.get(i, []))):
            stop = t.find("\n", start + 5)
            want = t[start : stop + 1 if stop >= 0 else len(t)]
            whole = " ".join(norms)
            taken = (len(whole.encode()) + bool(norms and norm), len(whole) + bool(norms and norm))
            assert (k, src, chunk, norm, low, at) == (n, start, want, normalized(want), *taken)
            start += len(want)
            norms += [norm] if norm else []
        assert start == len(t)


def test_located_in_the_index_shuffles_nothing(spark, tmp_path):
    texts = spark.createDataFrame([(i, "the user", f"words of {i}\n" * 9 + "que  la") for i in range(30)], "file long, user_text string, rest_text string")
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=2, chunk=40)
    listed = texts.select("file", F.lit("a").alias("fingerprint"))
    assert index.refresh(listed, lambda some: texts.join(some, "file", "left_semi"), texts.withColumn("fingerprint", F.lit("a")))
    found = index.located("que la")
    assert "Exchange" not in _plan(found) and {r.position - 8 for r in found.where("file < 10").collect()} == {99}
    assert index.chunks().where("segment = 'rest'").groupBy("file").count().where("count < 3").isEmpty()


def test_matches_in_plain_texts_are_found_by_one_walk(monkeypatch):
    """A plain text is normalized once, not for each step of a search; the ends are those of the search."""
    rng, calls = random.Random(12), []
    monkeypatch.setattr(search, "normalized", lambda x: calls.append(x) or normalized(x))
    for _ in range(300):
        source = "".join(rng.choices(["ab", "Éa", " ", "\n\t", "\x1c", "B"], k=rng.randint(0, 40)))
        needle = normalized("".join(rng.choices(["ab", "éa", " ", "b"], k=3)))
        calls.clear()
        got = search.found_in(source, needle)
        assert len(calls) == 1
        place = normalized(source).find(needle) if needle else -1
        reach = lambda size: next(n for n in range(len(source) + 1) if len(normalized(source[:n])) >= size)  # noqa: B023, E731
        assert got == (None if place < 0 else (reach(place + 1) - 1, reach(place + len(needle))))
    assert search.found_in("aİ the", "the") == (3, 6)
