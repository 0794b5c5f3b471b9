"""Periodic runs against plain scans of every period."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import runs

SCHEMA = "doc_id long, text string, runs string, start int, h int, words string"


def plain(words):
    """Every run: for each period the stretches in which words so far apart agree; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words, h = runs.WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    found = plain(words)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in found)
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def _words(rng):
    word = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
    unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
    return word + (unit * 8)[: rng.randint(0, 8 * len(unit))] + [rng.choice("abcdefgh") for _ in range(5)]


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        words = _words(rng)
        assert runs.runs(words) == plain(words), words
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.runs(list(fibonacci[-1])) == plain(list(fibonacci[-1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=70))
def test_runs_over_two_letters(words):
    assert runs.runs(words) == plain(words)


def test_long_texts():
    unit = [str(i) for i in range(30_000)]
    assert runs.runs(unit * 4) == [(0, 120_000, 30_000)]
    assert runs.runs(["x"] * 100_000) == [(0, 100_000, 1)]
    assert runs.runs([*unit, "x", *unit]) == []


def test_query_against_plain(spark):
    rng = random.Random(2)
    texts = [(i, rng.choice(["", "\n", "x "]) + rng.choice([" ", "\t", " \x0b\n"]).join(_words(rng)) + rng.choice(["", " "])) for i in range(400)]
    texts += [(400, None), (401, ""), (402, " \n "), (403, "une deux​trois\x85 " * 9), (None, "a b c " * 9), (7, "a b c " * 9), (7, "a b c " * 9), (2**60, "long " * 3000)]
    df = spark.createDataFrame([(*t, "clash", 1, 2, "w") for t in texts], SCHEMA)
    got = runs.digests(runs.periodic_runs(runs.with_planted_runs(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*t) for t in texts), key=str)
    assert runs.digests(runs.periodic_runs(runs.with_planted_runs(df.limit(0)))).isEmpty()
