"""Comparison of bytes by blocks against plain prefixes, of values and of files read in place."""

import random

from tracemill.operators import compare


def _plain(a, b):
    if a is None or b is None:
        return ("untracked" if a is None else "deleted", None if a is None else len(a), None if b is None else len(b), None)
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    state = "verified" if a == b else "ahead" if common == len(a) else "modified"
    return (state, len(a), len(b), None if a == b else common)


def _pairs():
    rng, out = random.Random(7), []
    for i in range(120):
        a = rng.randbytes(rng.choice([0, 1, 7, 8, 9, 64, 500, 1500]))
        edit = bytearray(a)
        if edit:
            edit[rng.randrange(len(edit))] ^= 1
        out.append((i, rng.choice([a, a, None]), rng.choice([a, bytes(edit), a + b"more", a[: len(a) // 2], b"", None])))
    return out


def test_as_plain_prefixes(spark):
    pairs = _pairs()
    df = spark.createDataFrame([(i, None if a is None else bytearray(a), None if b is None else bytearray(b)) for i, a, b in pairs], "k long, a binary, b binary")
    got = compare.compare_bytes(compare.blocks_of(df, "k", "a", 8), compare.blocks_of(df, "k", "b", 8), "k", 8)
    assert {r.k: tuple(r)[1:] for r in got.collect()} == {i: _plain(a, b) for i, a, b in pairs if (a, b) != (None, None)}
    assert compare.compare_bytes(compare.blocks_of(df.limit(0), "k", "a"), compare.blocks_of(df.limit(0), "k", "b"), "k").isEmpty()


def test_files_in_place(spark, tmp_path):
    pairs = [(i, a, b) for i, a, b in _pairs() if a is not None and b is not None]
    for i, a, b in pairs:
        (tmp_path / f"a{i}").write_bytes(a)
        (tmp_path / f"b{i}").write_bytes(b)
    sides = (spark.createDataFrame([(i, f"{tmp_path}/{side}{i}", len(x)) for i, *both in pairs for x in [both["ab".index(side)]]], "k long, path string, length long") for side in "ab")
    got = compare.compare_bytes(*(compare.file_blocks(files, "k", 100) for files in sides), "k", 100)
    assert {r.k: tuple(r)[1:] for r in got.collect()} == {i: _plain(a, b) for i, a, b in pairs}
