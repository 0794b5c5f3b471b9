"""Scalar functions on vectors of their own."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.functions import times, values

VECTORS = [
    ("Bob’s  ‘note’", "bob's 'note'"), ("“Quote” «and» ″more‶", '"quote" "and" "more"'), ("x‐y—z−1", "x-y-z-1"), ("Ｗｉｄｅ ﬁn…", "wide fin..."), ("ÉTUDE", "étude"),
    ("a\u0085b\u001cc d", "a b c d"), ("﻿hid​den soft­hyphen", "hidden softhyphen"), ("  C++ != C#\t\n--flag ", "c++ != c#; --flag".replace(";", "")), ("", ""), (None, None),
]


def test_normalize_vectors(spark):
    rows = spark.createDataFrame(list(enumerate(x for x, _ in VECTORS)), "i int, t string").select("i", T.normalize_search_text(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: y for i, (_, y) in enumerate(VECTORS)}


def test_normalize_random(spark):
    rng, signs = random.Random(7), "aB éß’“—­​\n\t ﬁＸ1-'\""
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)]
    table = str.maketrans({**dict.fromkeys(T.SINGLE_QUOTES, "'"), **dict.fromkeys(T.DOUBLE_QUOTES, '"'), **dict.fromkeys(T.DASHES, "-"), **dict.fromkeys(T.INVISIBLE, None)})
    want = [" ".join(unicodedata.normalize("NFKC", t.translate(table)).translate(table).lower().split()) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalize_search_text(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == want


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: T.short_title(F.lit(" a  b\n" + "c" * 200), 10), "a b cccccc…"),
        (lambda: T.clip(F.lit("abcdef"), 4), "abc…"),
        (lambda: T.short_path(F.lit("/home/me/work/repo")), ".../work/repo"),
        (lambda: T.strip_tags(F.lit("<p>a <b>b</b></p> ")), "a b"),
        (lambda: T.slug(F.lit("Hello, World!")), "hello-world"),
        (lambda: T.slug(F.lit("!!!")), "session"),
        (lambda: T.count_occurrences(F.lit("aaaa"), F.lit("aa")), 2),
        (lambda: T.count_occurrences(F.lit("aaaa"), F.lit("")), 0),
        (lambda: T.error_text(F.lit("E"), F.lit("")), "E"),
        (lambda: times.millis_to_iso(F.lit(1_700_000_000_123)), "2023-11-14T22:13:20.123Z"),
        (lambda: times.millis_to_iso(F.lit(0)), ""),
        (lambda: times.to_millis(F.lit("2023-11-14T22:13:20Z")), 1_700_000_000_000),
        (lambda: times.to_millis(F.lit("1700000000123")), 1_700_000_000_123),
        (lambda: times.to_millis(F.lit("never")), None),
        (lambda: times.relative_age(F.lit(7300)), "2h ago"),
        (lambda: times.byte_size(F.lit(2048)), "2.0 KB"),
        (lambda: values.short_model(F.lit("vendor/claude-x-20250101")), "x"),
        (lambda: values.model_family(F.lit("vendor/gpt-x")), "GPT"),
        (lambda: values.model_family(F.lit("what")), "Other"),
        (lambda: values.image_mime(F.lit("a/B.PNG")), "image/png"),
        (lambda: values.hex_image(F.lit("89504e4700")), "data:image/png;base64,iVBORwA="),
        (lambda: values.hex_image(F.lit("00")), None),
        (lambda: values.provider_model(F.lit(""), F.lit("m")), "m"),
        (lambda: values.valid_key(F.lit("..")), False),
        (lambda: values.valid_generation(F.lit("g0001")), True),
        (lambda: T.instruction_label(F.lit("user"), F.lit(" <environment_context>x")), "Environment context"),
    ],
)
def test_scalars(spark, make, want):
    assert spark.range(1).select(make()).first()[0] == want


def test_sizes_round_halves_up_as_their_sql_does(spark):
    """Halves of a tenth go up, in the query's SQL too: 0.25 MB is 0.3 MB."""
    import duckdb

    from tracemill.functions.times import byte_size
    from tracemill.plans.columns import _TENTHS

    want = {1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1792: "1.8 KB", 1279: "1.2 KB", (1 << 20) - 1: "1024.0 KB", 512 * 2560: "1.3 MB", 9 << 18: "2.3 MB", 5 << 28: "1.3 GB", (1 << 62) + (1 << 28): "4294967296.3 GB"}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", byte_size(F.col("n")).alias("s")).collect()
    assert dict(map(tuple, rows)) == want
    for n, text in want.items():
        unit = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}.get(text.split()[1])
        if unit:
            assert duckdb.connect().execute(f"SELECT {_TENTHS.format(unit)} FROM (SELECT {n}::BIGINT AS size)").fetchone()[0] == text.split()[0]
