"""Tokenizing and packing: exact ids, round trips, gapless places."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tracemill.llm import bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
SIGNS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "ß", "日本", "!", "?", "<|endoftext|>", "''", " '", "\U0001f600", "\x85", "\x1c", "​", "́", "x" * 30]
#: A word over two letters and its complement: they collide under any polynomial hash modulo 2^64.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(8192))
COLLIDING = [t for n in (1024, 2048, 8192) for w in (THUE[:n],) for t in (w, w.translate(str.maketrans("ab", "ba")), f"{w} {w.translate(str.maketrans('ab', 'ba'))}")]
SCHEMA = "doc_id long, text string, ids string, piece int, offset int"


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rng = random.Random(8)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(800)] + ["", None, "a" * 3000, " " * 700, "word " * 20000, "\n" * 50 + "x", "a <|endoftext|> b", *COLLIDING]


def test_encode_as_the_library(spark, exact):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(df, RANKS).collect()}
    assert ids == {i: exact.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(df, RANKS), RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip(df, RANKS).collect():
        own = exact.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS).isEmpty()


def test_forgetting_words(exact):
    from tracemill.llm.pretoken import Words, portions

    words, texts = Words(bpe.encoder(RANKS).encode, most=20), [t or "" for t in _texts()]
    out = []
    for part in portions(texts, 500):
        ids, bounds = words.tokens(part)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert out == [exact.encode_ordinary(t) for t in texts]


def test_colliding_keys_are_told_apart():
    from tracemill.llm.pretoken import Words, keys, points_of

    points, bounds = points_of(COLLIDING[:2])
    assert len(set(keys(points, bounds[:-1], bounds[1:]).tolist())) == 1
    for first, second in ((0, 1), (1, 0)):
        words = Words(bpe.encoder(RANKS).encode)
        for i in (first, second):
            ids, _ = words.tokens([COLLIDING[i]])
            assert bpe.encoder(RANKS).decode(ids).decode() == COLLIDING[i]


def test_plan_fills_exactly_where_sums_allow():
    sums = packing.Sums(np.bincount([700, 600, 300, 300, 200, 50], minlength=1001))
    assert sums.complement(300) == (300,) and sums.complement(900) == (700, 200) and sums.complement(950) == (700, 200, 50) and sums.complement(999) == () and sums.complement(850) == (600, 200, 50)
    sums.have[200] = 0
    assert sums.complement(900) == (600, 300) and sums.complement(650) == (600, 50) and sums.complement(600) == (600,)


def test_plan_uses_all():
    rng = np.random.default_rng(1)
    for most, n in ((10, 40), (64, 500), (2048, 4000)):
        lengths = np.clip(rng.lognormal(np.log(most / 4), 1, n).astype(int), 1, most)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        recipes = packing.plan(counts, most)
        used = defaultdict(int)
        for parts, times in recipes:
            assert sum(parts) <= most and times > 0
            for x in parts:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in recipes) <= 1.03 * -(-lengths.sum() // most) + 2
    assert packing.plan({}, 10) == []
    assert sorted(packing.plan({7: 1, 2: 1, 1: 1, 10: 2, 5: 2}, 10)) == [((5, 5), 1), ((7, 2, 1), 1), ((10,), 2)]


def test_spans():
    assert packing.spans(5, 8) == [(0, 5)] and packing.spans(8, 8) == [(0, 8)] and packing.spans(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.spans(16, 8) == [(0, 8), (8, 8)]


def test_pack(spark):
    texts = [t for t in _texts() for _ in range(2)]
    df = spark.createDataFrame([(None if i == 3 else i, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), 256, with_ids=True)
    got = rows.collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, places = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        own = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[None if i == 3 else i], key=lambda r: r.piece)
        assert [x for r in parts for x in r.ids] == own and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 256 for r in parts[1:]) and [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in parts)
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 256
    made = packing.sequences(rows).collect()
    assert len(made) == len(places) and sum(len(r.ids) for r in made) == sum(r.length for r in got)
    assert packing.pack(df.limit(0), P.path("byte_bpe_50k.json")).isEmpty()


def test_long_pretokens(exact):
    """Rows by themselves: random letters, repeats that overlap, and a million letters."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "".join(rng.choices("etaoin", k=50_000)), "a" * 10_001, "aab" * 5000, "日本" * 3000, THUE]
    for word, ids in zip(words, bpe.encoder(RANKS).encode(words), strict=True):
        assert ids.tolist() == exact.encode_ordinary(word)
    assert len(bpe.encoder(RANKS).encode(["".join(rng.choices("abcdefgh", k=1_000_000))])[0]) > 100_000
