"""Streams with keyed state against plain loops: summaries in any order, withdrawn records, chains that go on after a stop."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators.accumulate import Rules
from tracemill.streaming.accumulate import Accumulator, Summaries, keyed_state, summaries
from tracemill.streaming.chain import Chain, chains
from tracemill.streaming.summary import run_available

RULES = Rules("k", "n", {"all": ("sum", "one"), "low": ("min", "a"), "high": ("max", "a"), "first": ("first", "b"), "last": ("last", "b")}, {"users": "user", "others": "other"})
SCHEMA = "k string, n long, one long, a string, b string, role string, message long, mirror boolean"


def _records(rng, count):
    def record(n):
        role = rng.choice(["user", "other", None])
        return (f"k{n % 5}", n * 7000, 1, rng.choice([None, "x", "y", "z"]), rng.choice([None, None, f"b{n}"]), role, rng.randint(1, 6) if role else None, rng.random() < 0.5 if role else None)

    return [record(n) for n in range(count)]


def _plain(records):
    out = {}
    for k in {r[0] for r in records}:
        own = sorted(r for r in records if r[0] == k)
        a, b = [r[3] for r in own if r[3]], [r[4] for r in own if r[4]]
        said = {role: sum(max(sum(r[7] for r in own if r[5:7] == (role, m)), sum(not r[7] for r in own if r[5:7] == (role, m))) for m in range(1, 7)) for role in ("user", "other")}
        out[k] = (len(own), min(a, default=None), max(a, default=None), b[0] if b else None, b[-1] if b else None, said["user"], said["other"])
    return out


@pytest.fixture
def few_rows(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    yield
    spark.conf.set(name, before)


def test_rules_in_one_batch(spark):
    records = _records(random.Random(1), 300)
    assert {r[0]: tuple(r)[1:] for r in RULES.aggregate(spark.createDataFrame(records, SCHEMA)).collect()} == _plain(records)
    assert RULES.aggregate(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_accumulator_in_any_order():
    rng = random.Random(2)
    records = [r for r in _records(rng, 200) if r[0] == "k1"]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for _ in range(5):
        rng.shuffle(records)
        held = None
        for at in range(0, len(records), 7):
            sums = Accumulator(RULES, held)
            sums.feed(pd.DataFrame(records[at : at + 7], columns=columns))
            held = sums.state()
        assert tuple(Accumulator(RULES, held).finish())[:5] == _plain(records)["k1"][:5]


def test_summaries_of_shuffled_batches(spark, tmp_path, few_rows):
    """Copies come apart, mirrors and envelopes too; each batch is a stream of its own that goes on from the checkpoint."""
    rng = random.Random(3)
    records = _records(rng, 120)
    twice = rng.sample(records * 2, 240)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for n in range(3):
        spark.createDataFrame(twice[n::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with keyed_state(spark):
            got = run_available(summaries(stream, RULES), f"file://{tmp_path}/table", f"{tmp_path}/at", "k")
        seen = list({r[1]: r for part in range(n + 1) for r in twice[part::3]}.values())
        assert {r.k: (r["all"], r.low, r.high, r.first, r.last, r.users, r.others) for r in got.collect()} == _plain(seen)


def test_a_new_version_withdraws_what_was_fed(spark, tmp_path, few_rows):
    rng = random.Random(4)
    old, new = _records(rng, 60), [r for r in _records(rng, 60) if r[0] != "k4"]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(f"{SCHEMA}, version long").parquet(f"{tmp_path}/in")
    mark = [("k3", -1, 1, "mark", "mark", None, None, None, 2)]
    for rows in ([(*r, 0) for r in old], [(*r, 1) for r in new] + [(*r, 0) for r in old[:30]], mark):
        spark.createDataFrame(rng.sample(rows, len(rows)), f"{SCHEMA}, version long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with keyed_state(spark):
            got = run_available(summaries(stream, RULES, version="version"), f"file://{tmp_path}/table", f"{tmp_path}/at", "k")
    want = _plain(new) | {"k4": _plain(old)["k4"], "k3": (0, None, None, None, None, 0, 0)}
    assert {r.k: (r["all"], r.low, r.high, r.first, r.last, r.users, r.others) for r in got.collect()} == want


def _chain(seed, spans):
    head, end, out = bytes.fromhex(seed), 0, []
    for n, data in enumerate(spans, 1):
        head, end = hashlib.sha256(head + data).digest(), end + len(data)
        out.append((n, end, head.hex()))
    return out


def test_chains_of_growing_files(spark, tmp_path, few_rows):
    rng, seeds = random.Random(5), {p: hashlib.sha256(p.encode()).hexdigest() for p in "abc"}
    files = {p: [rng.randbytes(rng.randint(1, 9)) for _ in range(40)] for p in "abc"}
    spans = []
    for p, parts in files.items():
        at = 0
        for n, data in enumerate(parts):
            spans.append((p, n, at, data, seeds[p]))
            at += len(data)
    # b: the tenth span comes again, then the file is rewritten from there on; c is begun anew
    at = sum(map(len, files["b"][:10]))
    spans += [("b", 40, at, files["b"][10], seeds["b"]), ("b", 41, at, b"other", seeds["b"]), ("b", 42, at + 5, b"more", seeds["b"]), ("c", 40, 0, b"new", seeds["c"])]
    schema = "path string, n long, at long, data binary, seed string"
    (tmp_path / "in").mkdir()
    stream, mixed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), rng.sample(spans, len(spans))
    for part in (mixed[:50], mixed[50:90], mixed[90:] + mixed[:20]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # each time a stream that was stopped goes on from its checkpoint
        with keyed_state(spark):
            chains(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("path", "generation", "link").collect()
    want = {(p, 0): _chain(seeds[p], files[p]) for p in "abc"}
    want["b", 1] = _chain(seeds["b"], [*files["b"][:10], b"other", b"more"])[10:]
    want["c", 1] = _chain(seeds["c"], [b"new"])
    for (p, g), links in want.items():
        assert [(r.link, r.end, r["head"]) for r in got if (r.path, r.generation) == (p, g)] == links
    assert sorted((r.path, r.generation, r.link) for r in got if r.change == "rewritten") == [("b", 1, 11), ("c", 1, 1)] and len(got) == sum(map(len, want.values()))
    assert spark.createDataFrame([], schema).select(F.count("*")).first()[0] == 0


class _Map:
    """A map state that counts the calls it gets."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        own = self.held
        return {"containsKey": own.__contains__, "getValue": own.get, "updateValue": own.__setitem__, "removeKey": lambda k: own.pop(k, None), "keys": lambda: list(own)}[name]


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, _Map())

    def calls(self):
        return sum(m.calls for m in self.states.values())


def test_chains_ask_the_state_by_blocks():
    """1,000 spans in three mixed frames: far fewer calls than spans, the links of a plain loop, and a rewrite many blocks back."""
    rng, seed, path = random.Random(9), hashlib.sha256(b"s").hexdigest(), 7
    parts = [rng.randbytes(rng.choice([0, 1, 30, 400])) for _ in range(1000)]
    spans, at = [], 0
    for n, data in enumerate(parts):
        spans.append((path, n, at, data, seed))
        at += len(data)
    mixed, handle = rng.sample(spans, len(spans)), _Handle()
    frames = [pd.DataFrame(x, columns=["path", "n", "at", "data", "seed"]) for x in (mixed[:400], mixed[400:700], mixed[700:] + mixed[:50])]
    own = Chain("long")
    own.init(handle)
    got = [tuple(r) for f in frames for out in own.handleInputRows((0,), iter([f]), None) for r in out.itertuples(index=False)]
    assert [(link, end, head) for _, _, link, end, head, _ in got] == _chain(seed, parts) and handle.calls() < 300
    assert not handle.states["early"].held
    # a copy of a span, then other bytes from there on, so that later links count no more
    k = next(n for n in range(100, 1000) if parts[n])
    begin = sum(map(len, parts[:k]))
    more = pd.DataFrame([(path, 1000, begin, parts[k], seed), (path, 1001, begin, b"new", seed), (path, 1002, begin + 3, b"end", seed)], columns=frames[0].columns)
    got = [tuple(r) for out in own.handleInputRows((0,), iter([more]), None) for r in out.itertuples(index=False)]
    assert [(g, link, end, head) for _, g, link, end, head, _ in got] == [(1, *x) for x in _chain(seed, [*parts[:k], b"new", b"end"])[k:]]
    assert max(b for _, b in handle.states["links"].held) == begin >> 14


def test_summaries_ask_the_state_by_buckets():
    """Copies and both forms of messages over frames, with far fewer calls than records; buckets of messages double."""
    rng, handle = random.Random(10), _Handle()
    rows = []
    for n in range(6000):
        message = rng.getrandbits(63) - (1 << 62) if n % 2 == 0 else rows[-1][6]
        rows.append((f"k{n // 2 % 2}", n, 1, None, f"b{n}", "user", message, n % 2 == 0))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    twice = rng.sample(rows * 2, len(rows) * 2)
    own = Summaries(RULES, "string", 1000, None)
    own.init(handle)
    for n in range(0, len(twice), 3000):
        frame = pd.DataFrame([(*r[:6], str(r[6]), r[7]) for r in twice[n : n + 3000]], columns=columns)
        out = list(own.handleInputRows((0,), iter([frame]), None))
    last = {r[0]: tuple(r)[1:] for f in out for r in f.itertuples(index=False)}
    assert all(last[k] == (3000, None, None, min((r[1], r[4]) for r in rows if r[0] == k)[1], max((r[1], r[4]) for r in rows if r[0] == k)[1], 1500, 0) for k in last)
    assert last and handle.calls() < len(twice) / 10 and len({b for *_, b in handle.states["messages"].held}) >= 4
