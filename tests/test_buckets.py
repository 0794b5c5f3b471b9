"""Tables in growing buckets: splits, what an upsert writes, manifests that are read half-written, readers across states."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import manifest, write_manifest
from tracemill.operators.index import SearchIndex
from tracemill.sources.buckets import Buckets, bucket_of, parent
from tracemill.sources.store import KeyedTable

SCHEMA = "k long, v string"


def test_bucket_of_follows_the_number(spark):
    keys = spark.range(3000)
    rows = keys.select("id", *(bucket_of("id", n).alias(f"b{n}") for n in range(1, 20))).collect()
    for n in range(1, 19):
        for r in rows:
            old, new = r[f"b{n}"], r[f"b{n + 1}"]
            assert 0 <= old < n and (new == old or (new == n and parent(n, n) == old))
    assert parent(13, 3) == 1 and parent(2, 3) == 2 and parent(0, 1) == 0
    # even shares
    assert max(sum(r["b16"] == b for r in rows) for b in range(16)) < 3000 / 16 * 1.4


def _table(spark, path, target=2000):
    return KeyedTable(spark, f"file://{path}/t", "k", spark.createDataFrame([], SCHEMA).schema, target=target)


def _rows(spark, ids, text):
    return spark.createDataFrame([(i, f"{text}{i}" * 20) for i in ids], SCHEMA)


def test_buckets_follow_the_bytes(spark, tmp_path):
    want, counts = {}, []
    for n in range(4):
        ids = range(n * 300, n * 300 + 400)
        _table(spark, tmp_path).upsert(_rows(spark, ids, str(n)))
        want |= {i: f"{n}{i}" * 20 for i in ids}
        counts.append(_table(spark, tmp_path).buckets.count)
        assert {r.k: r.v for r in _table(spark, tmp_path).read().collect()} == want
    assert counts == sorted(counts) and counts[0] > 1 and counts[-1] > counts[0]
    table = _table(spark, tmp_path)
    # each key lies in its bucket, and a bucket in one file at most
    held = table.read().select("k", bucket_of("k", table.buckets.count).alias("b"), F.regexp_extract(F.input_file_name(), r"bucket=(\d+)/", 1).cast("int").alias("at"), F.input_file_name().alias("f"))
    assert held.where("b != at").isEmpty() and held.select("at", "f").distinct().count() == held.select("at").distinct().count() <= table.buckets.count
    # one key changes one bucket, where no split is due
    table.buckets.target = 1 << 40
    before = dict(table.buckets.folders)
    table.upsert(_rows(spark, [5], "new"))
    assert sum(before[b] != f for b, f in table.buckets.folders.items()) == 1


def test_half_written_manifests_do_not_count(spark, tmp_path):
    _table(spark, tmp_path).upsert(_rows(spark, range(9), "a"))
    version = _table(spark, tmp_path).buckets.version
    (tmp_path / f"t/manifest-{version + 1}/_temporary").mkdir(parents=True)
    (tmp_path / "t/_writing-x").write_text("{")
    assert _table(spark, tmp_path).buckets.version == version and _table(spark, tmp_path).read().count() == 9
    assert manifest(spark, f"file://{tmp_path}/none") == (0, None)
    write_manifest(spark, f"file://{tmp_path}/m", 1, '{"a": "é"}')
    assert manifest(spark, f"file://{tmp_path}/m") == (1, '{"a": "é"}')
    # two writers of one state: the second is told
    with pytest.raises(FileExistsError):
        write_manifest(spark, f"file://{tmp_path}/t", version + 1, "{}")


def test_reads_planned_before_an_upsert(spark, tmp_path):
    _table(spark, tmp_path).upsert(_rows(spark, range(50), "a"))
    old = _table(spark, tmp_path).read()
    _table(spark, tmp_path).upsert(_rows(spark, range(50), "b"))
    _table(spark, tmp_path).upsert(_rows(spark, range(20), "c"))
    assert old.count() == 50 and old.where("v like 'a%'").count() == 50
    for n in range(3):
        _table(spark, tmp_path).upsert(_rows(spark, range(9), str(n)))
    # older states are cleared away
    held = {p.parent.parent.name for p in (tmp_path / "t").glob("state-*/bucket=*/*.parquet")}
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 3 and "state-1" not in held


def test_search_planned_before_a_refresh(spark, tmp_path):
    def load(some):
        return some.select("file", F.lit("").alias("user_text"), F.concat(F.lit("the words of "), F.col("file").cast("string")).alias("rest_text"))

    def listed(prints):
        return spark.createDataFrame(list(prints.items()), "file long, fingerprint string")

    index = SearchIndex(spark, f"file://{tmp_path}/i", target=3000)
    assert index.refresh(listed(dict.fromkeys(range(200), "a")), load) and index.buckets.count > 2
    before, count = index.search("words"), index.buckets.count
    assert SearchIndex(spark, f"file://{tmp_path}/i", target=3000).refresh(listed(dict.fromkeys(range(200), "b")), load)
    assert before.count() == 200
    # one changed document: one bucket
    index = SearchIndex(spark, f"file://{tmp_path}/i", target=1 << 40)
    folders = dict(index.buckets.folders)
    assert index.refresh(listed(dict.fromkeys(range(199), "b") | {199: "c"}), load) and index.buckets.count >= count
    assert sum(folders[b] != f for b, f in index.buckets.folders.items()) == 1 and index.search("words of 199").count() == 1


def test_buckets_of_an_empty_path(spark, tmp_path):
    empty = Buckets(spark, f"file://{tmp_path}/e")
    assert (empty.version, empty.count, empty.paths(), empty.wanted(0)) == (0, 1, [], 1)
