"""Near-duplicates of texts and vectors against brute force, and the cases at the edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import capfilter, golay, simhash
from tracemill.llm.components import components

DOCS = "doc_id long, text string, component_id int, fingerprint string"


def _roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    roots = _roots(500, [e for e in edges if None not in e])
    assert got == {i: roots[i] for i in got} and set(got) == {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_golay_neighbours_meet():
    index, near, new = golay.tables()
    assert len(set(index.tolist())) > 1000 and (1 + new.sum(axis=1)).max() <= 6
    keys = lambda x: {int(index[x]), *near[x].tolist()}
    rng = random.Random(1)
    for _ in range(2000):
        x = rng.randrange(1 << 16)
        y = x ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16))
        assert keys(x) & keys(y)


@pytest.mark.parametrize("keys, bits", [(simhash.one_flip_keys, 3), (simhash.two_segment_keys, 8)])
def test_keys_meet(keys, bits):
    rng = random.Random(2)
    a = [rng.getrandbits(64) for _ in range(400)]
    b = [x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, bits))) for x in a]
    both = []
    for values in (a, b):
        row, key = keys(np.array(values, dtype=np.uint64))
        both.append([set(key[row == i].tolist()) for i in range(len(values))])
    assert all(x & y for x, y in zip(*both, strict=True))


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 400))) for _ in range(60)]
    near = [t.replace(t.split()[len(t.split()) // 2], "changed", 1) for t in base]
    return base + near + base[:10] + ["", "   ", None, "one", "One two", "ONE two", "é É", base[0].upper(), "long " * 30000]


def test_near_duplicates(spark):
    texts = _texts()
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [simhash.fingerprint(t, 3, 64)[0] for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert [got[i].component_id for i in range(len(texts))] == _roots(len(texts), edges)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    assert got[130].fingerprint == "0" * 16


def test_fingerprint_by_bits():
    import xxhash

    words = "a B c d E".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    assert simhash.fingerprint("a B\tc d E", 3, 64)[0] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)


@pytest.mark.parametrize("salted", [False, True])
def test_blocks_of_one_key(spark, monkeypatch, salted):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    if salted:
        monkeypatch.setattr(simhash, "SAMPLED", 1)
    rng = random.Random(9)
    core = rng.getrandbits(64)
    prints = sorted({core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)})
    df = spark.createDataFrame([(f"{x:016x}",) for x in prints], "fingerprint string")
    edges = [(int(r.u, 16), int(r.v, 16)) for r in simhash.links(df, 64, 3).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    place = {x: i for i, x in enumerate(prints)}
    brute = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert _roots(len(prints), [(place[a], place[b]) for a, b in edges]) == _roots(len(prints), brute)


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d", 1, ""), (None, None, 1, ""), (3, "a b c d", 1, ""), (3, "a b c d", 1, "")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (None, None), (3, 3), (3, 3)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).isEmpty()


def test_stage_settings_find_similar_texts(spark):
    rng = random.Random(4)
    words = [f"x{i}" for i in range(5000)]
    base = [rng.choices(words, k=400) for _ in range(40)]
    near = [[w if i not in (100, 300) else "other" for i, w in enumerate(t)] for t in base]
    rows = [(i, " ".join(t)) for i, t in enumerate(base + near)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 128, 19, simhash.two_segment_keys).collect()}
    assert sum(got[i + 40] == i for i in range(40)) >= 39 and all(got[i] == i for i in range(40))


def test_nearest_forest_keeps_smaller_radii():
    rng = random.Random(11)
    core = rng.getrandbits(64)
    prints = np.array([[core ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6)))] for _ in range(70)], dtype=np.uint64)
    i, j = simhash.nearest_forest(prints, 9)
    far = np.bitwise_count(prints ^ prints.T)
    for radius in (2, 4, 6, 9):
        near = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if far[a, b] <= radius]
        assert _roots(70, near) == _roots(70, np.argwhere(np.triu(far <= radius, 1)).tolist())


def test_similarity_is_exact(spark):
    rng = random.Random(12)
    words = [f"x{i}" for i in range(5000)]
    base = [rng.choices(words, k=300) for _ in range(30)]
    # two changed words leave a similarity of .936, eight of .765
    close = [[w if i not in (50, 150) else "o" for i, w in enumerate(t)] for t in base]
    loose = [[w if i % 35 else "p" for i, w in enumerate(t)] for t in base]
    rows = [(i, " ".join(t)) for i, t in enumerate(base + close + loose)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 128, 30, simhash.two_segment_keys, 0.8).collect()}
    assert all(got[i] == i for i in range(30)) and sum(got[i + 30] == i for i in range(30)) >= 29 and all(got[i] == i for i in range(60, 90))


def _vectors():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 16))
    near = base + 0.03 * rng.standard_normal(base.shape)
    hub = rng.standard_normal(16) + 0.02 * rng.standard_normal((60, 16))
    return np.concatenate([base, near, hub, base[:20], 3 * base[20:30]]).astype(np.float32)


def test_one_key_over_many_blocks(spark, monkeypatch):
    """No task of a hot key holds more than a block, or more than two in a pair, however many meet."""
    one_key = lambda low: (np.arange(len(low)), np.zeros(len(low), dtype=np.uint64))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng, most = random.Random(13), {}
    for n in (200, 800):
        prints = [rng.getrandbits(64) for _ in range(n)]
        prints += [x ^ (1 << rng.randrange(64)) for x in prints[:50]]
        df = spark.createDataFrame([(f"{x:016x}",) for x in set(prints)], "fingerprint string")
        salts = simhash.hot_keys(df, 1, one_key)
        assert salts and max(salts.values()) <= -(-len(prints) // 16)
        held = df.mapInArrow(simhash._deal(1, one_key, salts), "key long, p0 long").groupBy("key").count()
        most[n] = held.agg(F.max("count")).first()[0]
        got = {(int(r.u, 16), int(r.v, 16)) for r in simhash.links(df, 64, 1, one_key).collect()}
        assert all((a, b) in got or (b, a) in got for a, b in zip(prints[:50], prints[n:], strict=True) if a != b)
    assert most[800] < 3 * most[200]


def test_directions_follow_the_label():
    assert capfilter.words_for(100_000) == capfilter.WORDS and capfilter.words_for(10**9) > 2000
    rng = np.random.default_rng(14)
    for dims, words in ((16, 80), (64, 80), (64, 640), (384, 80), (768, 300)):
        x = rng.standard_normal((300, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)  # pairs at exactly 0.98
        sets = []
        for v in (x, y):
            row, found = capfilter.decode(v, words)
            sets.append([set(found[row == i].tolist()) for i in range(len(v))])
        assert sum(bool(a & b) for a, b in zip(*sets, strict=True)) >= 0.985 * len(x), (dims, words)


@pytest.mark.parametrize("salted", [False, True])
def test_vectors(spark, monkeypatch, salted):
    monkeypatch.setattr(capfilter, "BLOCK", 16)
    if salted:
        monkeypatch.setattr(capfilter, "SAMPLED", 1)
    v = _vectors()
    label = np.where(np.arange(len(v)) >= 300, 1, np.arange(len(v)) % 150 % 2)
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, v[0].tolist(), None), (904, [], 1), (905, [1.0, None], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    rows = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilter.near_duplicates(df).collect()}
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    roots = _roots(len(v), np.argwhere(np.triu(link)).tolist())
    assert {i: got[i] for i in range(len(v))} == {i: (int(link[i].sum()), roots[i], roots[i] == i) for i in range(len(v))}
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert capfilter.near_duplicates(df.limit(0)).isEmpty()


def _jaccard_edges(texts, words, least):
    sets = [set(simhash.shingle_hashes(t, words, 42).tolist()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def _clusters(rng, clusters, variants, size):
    """Texts of disjoint five-word lines: a set of shingles with some exchanged, so that pairs lie about 0.8."""
    pool = iter(range(10**6))
    texts = []
    for _ in range(clusters):
        base = [f"b{next(pool)}" for _ in range(size)]
        for _ in range(variants):
            changed = set(rng.sample(range(size), round(size * rng.uniform(0.045, 0.07))))
            texts.append(" ".join(f"c{next(pool)}" if i in changed else w for i, w in enumerate(base)))
    return texts


def test_every_candidate_is_compared(spark, monkeypatch):
    # one-word shingles; all meet under one key, so that recall is that of the comparison alone
    one_key = lambda low: (np.arange(len(low)), np.zeros(len(low), dtype=np.uint64))
    texts = _clusters(random.Random(21), 3, 40, 200)
    edges = _jaccard_edges(texts, 1, 0.8)
    assert len(edges) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4096, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SKETCH_BLOCK", block)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 1, 128, 30, one_key, 0.8).collect()}
        assert [got[i] for i in range(len(texts))] == _roots(len(texts), edges)


def test_a_group_of_unlike_texts_makes_no_pairs(spark):
    """Near copies of one text that are too unlike each other: connected by candidates, compared, and not written as pairs."""
    rng = random.Random(22)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(f"c{n}_{i}" if i in set(rng.sample(range(200), 44)) else w for i, w in enumerate(base)) for n in range(120)]
    hashes = [sorted(set(simhash.shingle_hashes(t, 1, 42).astype("<u8").view("<i8").tolist())) for t in texts]
    left = spark.createDataFrame([(f"{i:048x}", "w", f"{i:048x}") for i in range(120)], "node string, whole string, root string")
    sets = spark.createDataFrame([(f"{i:048x}", h) for i, h in enumerate(hashes)], "fingerprint string, hashes array<long>")
    alike = lambda i, j: len(set(hashes[i]) & set(hashes[j])) / len(set(hashes[i]) | set(hashes[j]))
    assert max(alike(i, j) for i in range(120) for j in range(i)) < 0.8
    assert simhash.sketched_pairs(left, sets, 0.8).count() < 120 * 119 / 2 / 10


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(23)
    radius = simhash.sketch_radius(0.8)
    for size in (20, 60, 300):
        far = []
        for _ in range(400):
            a = rng.integers(0, 1 << 62, size)
            b = a.copy()
            b[: size // 9] = rng.integers(0, 1 << 62, size // 9)  # eight of nine in common: a similarity of 0.8
            x, y = (np.frombuffer(simhash.sketch(v), dtype=np.uint64) for v in (a, b))
            far.append(int(np.bitwise_count(x ^ y).sum()))
        assert max(far) <= radius and np.mean(far) > 0.6 * radius


def test_similarity_is_over_sets(spark):
    line = " ".join(f"z{i}" for i in range(12))
    copies = [x for n in range(20) for x in [" ".join(f"q{n}_{i}" for i in range(196)) + f"\n{line}"] for x in (x, x + f"\n{line}" * 9)]
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 128, 30, simhash.two_segment_keys, 0.8).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(20)) >= 19 and all(got[2 * i] == 2 * i for i in range(20))


def test_one_fingerprint_is_compared():
    # repeats of one shingle no longer decide the bits, and other texts of the same bits are another value
    a, b = "hot " * 500 + " ".join(f"a{i}" for i in range(50)), "hot " * 500 + " ".join(f"b{i}" for i in range(50))
    assert simhash.fingerprint(a, 1, 128) == simhash.fingerprint(b, 1, 128)
    assert simhash.fingerprint(a, 1, 128, True) != simhash.fingerprint(b, 1, 128, True)
    assert simhash.fingerprint(a, 1, 128, True) == simhash.fingerprint(a + " hot", 1, 128, True)
