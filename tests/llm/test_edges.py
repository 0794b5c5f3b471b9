"""Edges of single operators: recall near a similarity, labels of any type, null ids, half-written states."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import capfilter, lines, quality_net, simhash


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_similar_texts(spark, similarity):
    """Pairs of sets of 100 to 1,000 shingles at a Jaccard similarity of just so much, as the pipeline's stage looks for them."""
    rng, texts, n = random.Random(int(100 * similarity)), [], 300
    for pair in range(n):
        size = rng.choice([100, 300, 1000])
        # of two sets of a size, c words in common give c / (2 size - c)
        common = -(-2 * size * similarity // (1 + similarity))
        base = [f"p{pair}w{i}" for i in range(size)]
        texts += [" ".join(base), " ".join(base[: int(common)] + [f"q{pair}w{i}" for i in range(size - int(common))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 1, 128, 30, simhash.two_segment_keys, 0.8).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    found = sum(got[2 * i + 1] == 2 * i for i in range(n)) / n
    print(f"recall at {similarity}: {found:.3f}")
    assert found >= 0.9


def test_labels_of_any_type(spark):
    rows = [(i, [1.0, i / 1000], label) for i, label in enumerate(["a", "a", "b", None, "b", "9" * 30])]
    got = {r.vec_id: r.component_id for r in capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 5}
    wide = [(i, [1.0, i / 1000], label) for i, label in enumerate([2**40, 2**40, 2**40 + 1])]
    got = {r.vec_id: r.component_id for r in capfilter.near_duplicates(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_large_ids_beside_nulls(spark):
    ids = [2**53 + 1, None, 2**53 + 3]
    df = spark.createDataFrame([(i, f"some words {i}") for i in ids], "doc_id long, text string").coalesce(1)
    got = quality_net.score(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted(((r.doc_id, r.held_out) for r in got), key=str) == sorted(((i, quality_net.fold_of(i) == 0) for i in ids), key=str)


def test_half_written_runs_do_not_count(spark, tmp_path):
    docs = spark.createDataFrame([(f"x\ny{i}",) for i in range(9)], "text string")
    runs = lines.LineRuns(spark, f"file://{tmp_path}/runs", 4)
    runs.add_documents(docs)
    runs.close()
    (tmp_path / f"runs/manifest-{runs.version + 1}/_temporary").mkdir(parents=True)
    again = lines.LineRuns(spark, f"file://{tmp_path}/runs", 4)
    assert again.version == runs.version and again.frequent().count() == 1
    # runs that a merge has replaced stay for one state more
    planned = again._merged([n for level in again.levels for n in level]).where(F.col("n") >= 4)
    (tmp_path / f"runs/manifest-{runs.version + 1}/_temporary").rmdir()
    (tmp_path / f"runs/manifest-{runs.version + 1}").rmdir()
    again.add_documents(docs)
    assert again.merged and planned.count() == 1 and again.frequent().count() == 1
    again.close()
    assert np.array(again.levels, dtype=object).size
