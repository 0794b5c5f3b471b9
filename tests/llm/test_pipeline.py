"""The corpus pipeline end to end: each stage against a plain restatement on what the one before kept."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import LOWER, _base, _ratios
from tests.llm.test_pairs import _roots
from tracemill.llm import lines, rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _texts():
    rng = random.Random(31)
    words = [f"{a}{b}" for a in ("sea", "win", "riv", "sto", "lig", "fie") for b in ("a", "be", "co", "du", "er", "fi", "go")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    common = prose(12)
    base = ["\n".join([prose(80), common, prose(70)]) for _ in range(30)]
    near = [t.replace(t.split()[20], "changed", 1) for t in base[:10]]
    private = [f"{prose(60)} write to user{i}@mail.test or 10.0.0.{i} now" for i in range(8)]
    junk = [" ".join(rng.choices(["buy", "now"], k=80)) for _ in range(5)]
    return base + near + base[:3] + private + junk + [None, "", "short text", common, "\n\n"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(_texts())]
    rows += [rows[0], (None, rows[5][1], None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 51), 0) for i in range(60)] + [(None, None, None)], LABELS).write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def _again(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("llr", F.lit("clash"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "private_data", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)

    before = docs.collect()
    one = _again(spark, stages["quality_rules"](spark, docs, folder), f"file://{tmp_path}/1")
    base = {r.doc_id: r.base_failed for r in rules.base_columns(docs).collect()}
    trusted = {i for i, r in enumerate(before) if r.doc_id is not None and r.doc_id < 51}
    ratios = _ratios([r.text for r in before], trusted)
    keep = [r for r, x in zip(before, ratios, strict=True) if r.text and not rules_fail(r.text) and x >= rules.THRESHOLD]
    assert one.columns == docs.columns and Counter(one.collect()) == Counter(keep) and base

    two = _again(spark, stages["line_dedup"](spark, one, folder), f"file://{tmp_path}/2")
    key = lambda x: x.strip(lines.BLANKS).translate(LOWER)
    often = Counter(k for r in keep for k in {key(x) for x in r.text.split("\n")} - {""})
    kept = ["\n".join(x for x in r.text.split("\n") if often[key(x)] < 10) for r in keep]
    assert any(n >= 10 for n in often.values()) and Counter(r.text for r in two.collect()) == Counter(t for t in kept if t)
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = _again(spark, stages["simhash_near_dedup"](spark, two, folder), f"file://{tmp_path}/3")
    rows = sorted(two.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [set(simhash.shingle_hashes(r.text, 5, 42).tolist()) for r in rows]
    roots = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    groups = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        groups[root].append(r.doc_id)
    want = sorted(min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g))
    assert sorted(r.doc_id for r in three.collect() if r.doc_id is not None) == want and len(want) < len(rows)

    four = _again(spark, stages["private_data"](spark, three, folder), f"file://{tmp_path}/4")
    out = {r.doc_id: r.text for r in four.collect()}
    for r in three.collect():
        counts, _ = _base(r.text)
        assert len(re.findall(r"\[EMAIL\]", out[r.doc_id])) >= counts[0] and "@" not in out[r.doc_id] and (sum(counts) or out[r.doc_id] == r.text)

    pieces = stages["best_fit_packing"](spark, four, folder).collect()
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
    assert {p.doc_id for p in pieces} == set(out)

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((p.doc_id, p.piece, p.length, p.ids_crc32) for p in whole) == Counter((p.doc_id, p.piece, p.length, p.ids_crc32) for p in pieces)


def rules_fail(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often, repeat = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            repeat |= {k, k + 1, k + 2}
    return len(words) < 50 or 100 * len(repeat) > 50 * len(words)


def test_nothing_to_do(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).isEmpty()
