"""Quality, lines, language model, private data and licences against plain restatements, and the cases at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.llm import interp, licences, lines, pii, quality_net, rules

DOCS = "doc_id long, text string, kept string, lang string, own string"
BLANK = "[\\x20\\x09-\\x0D]"
LOWER = str.maketrans(lines.UPPER, lines.LOWER)


def _docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", "en", "o") for i, t in enumerate(texts)], DOCS)


def _prose(rng, n):
    return [" ".join(rng.choices(["the", "of", "Sea", "wind", "é", "river", "stone", "and", "light"], k=rng.randint(60, 200))) + "." for _ in range(n)]


def _junk(rng, n):
    return [" | ".join(rng.choices(["buy", "now", "win", "xx"], k=rng.randint(60, 120))) for _ in range(n)]


ODD = [None, "", "   ", "\n\n", "a", "A b\n a B \n\tx", "é É\n É é", "word " * 30000, "x\n" * 3000]


def test_lines(spark):
    rng = random.Random(1)
    pool = ["Common line", " common LINE\t", "rare", "", "  ", "É", "é", "a|b"]
    texts = ["\n".join(rng.choices(pool + [f"own {i}"], k=rng.randint(0, 6))) for i in range(60)] + ODD
    key = lambda x: x.strip(lines.BLANKS).translate(LOWER)
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} - {""})
    hot = {k for k, n in count.items() if n >= 10}
    got = {r.doc_id: r for r in lines.drop_frequent_lines(_docs(spark, texts)).collect()}
    assert hot and len(got) == len(texts)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        keep = [x for x in own if key(x) not in hot]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept, got[i].own) == (len(own), len(own) - len(keep), "\n".join(keep), "o")
    assert lines.drop_frequent_lines(_docs(spark, texts).limit(0)).isEmpty()


def test_lines_of_repeated_rows(spark):
    df = _docs(spark, ["same\nother"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.n_dropped, r.kept) for r in lines.drop_frequent_lines(df).collect()} == {(2, "")}


def test_runs_are_levelled_and_outlive_a_session(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    for n in range(5):
        runs = lines.LineRuns(spark, path, min_docs=4, fanout=2)  # opened anew for each batch
        runs.add(spark.createDataFrame([(1, 0, 1), (2, 0, 3 if n == 0 else 1), (10 + n, 0, 1)], "h long, g long, n long"))
        runs.close()
    runs = lines.LineRuns(spark, path, min_docs=4, fanout=2)
    assert sorted(r.h for r in runs.frequent().collect()) == [1, 2] and [len(x) for x in runs.levels] == [1, 0, 1]
    # a decided key is no longer counted: the last batch left its run without key 2
    last = runs._run(runs.levels[0][0])
    assert sorted(r.h for r in last.collect()) == [14]
    with pytest.raises(ValueError, match="min_docs=4"):
        lines.LineRuns(spark, path, min_docs=5)
    plan = runs._merged(runs.levels[0] + runs.levels[2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_batches_in_two_calls_equal_one(spark, tmp_path):
    rng = random.Random(11)
    texts = ["\n".join(rng.choices([f"line {i}" for i in range(40)], k=12)) for _ in range(60)]
    halves = [_docs(spark, texts[:25]), _docs(spark, texts[25:], 25)]
    two = lines.LineRuns(spark, f"file://{tmp_path}/two", min_docs=16)
    for half in halves:
        two.add_documents(half)
    one = lines.LineRuns(spark, f"file://{tmp_path}/one", min_docs=16)
    one.add_documents(halves[0].union(halves[1]))
    got = [sorted(map(tuple, x.frequent().collect())) for x in (two, one)]
    count = Counter(x for t in texts for x in set(t.split("\n")))
    assert got[0] == got[1] and len(got[0]) == sum(n >= 16 for n in count.values()) > 0
    two.close()
    one.close()


def test_rule_counts(spark):
    rng = random.Random(2)
    texts = ODD + ["#$ a |\n#$ a |\nx"] + [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(80)]
    got = {r.doc_id: r for r in rules.base_columns(_docs(spark, texts).withColumn("n_words", F.lit("clash"))).collect()}
    for i, t in enumerate(t or "" for t in texts):
        words, shown = re.findall("[^\\x20\\x09-\\x0D]+", t), [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, repeat = Counter(windows), set()
        for k, w in enumerate(windows):
            if often[w] > 1:
                repeat |= {k, k + 1, k + 2}
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(shown) - len(set(shown)), len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert got[i].own == "o"


def test_rules_tell_junk(spark):
    rng = random.Random(3)
    good, bad = _prose(rng, 120), _junk(rng, 30)
    docs = _docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(i, 0) for i in range(120, 140)] + [(None, 1)], "doc_id long, quality int")
    out = rules.quality_rules(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    unrepeated = [i for i in range(120) if not got[i].base_failed]
    assert unrepeated and all(got[i].kept for i in unrepeated) and not any(got[i].kept for i in range(120, 150)) and all(got[i].llr < got[j].llr for i in range(120, 150) for j in range(120))
    assert out.where("kept").count() == sum(r.kept for r in got.values())
    assert rules.quality_rules(docs.limit(0), labels).isEmpty() and {r.llr for r in rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def _ratios(texts, trusted):
    """The log-likelihood ratio of each text by plain counts of hashed n-grams."""
    import regex
    import xxhash

    def grams(t):
        words = regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+", t or "")
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, words[1:], strict=False)]
        return [(h - (1 << 64) * (h >> 63)) % rules.BUCKETS for h in one + two]

    every = [grams(t) for t in texts]
    corpus, target = Counter(g for x in every for g in x), Counter(g for i, x in enumerate(every) if i in trusted for g in x)
    n, m = sum(corpus.values()), sum(target.values())
    weight = lambda g: math.log((target[g] + 0.5) / (m + 0.5 * rules.BUCKETS)) - math.log((corpus[g] + 0.5) / (n + 0.5 * rules.BUCKETS))
    return [sum(map(weight, x)) / len(x) if x and m else 0.0 for x in every]


def test_ratio_against_plain_counts(spark):
    rng = random.Random(18)
    texts = _prose(rng, 40) + _junk(rng, 20) + ["déjà vu 日本 — x1", "a", None, "", "same same"] + ["word, " * 3000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)] + [(None, 1), (1, 1), (10_000, 1)], "doc_id long, quality int")
    want = _ratios(texts, {i for i in range(50) if i % 3 > 0})
    got = {r.doc_id: r for r in rules.quality_rules(_docs(spark, texts).withColumn("llr", F.lit("clash")), labels).collect()}
    assert [got[i].llr for i in range(len(texts))] == pytest.approx(want)
    assert all(got[i].kept == (not got[i].base_failed and want[i] >= rules.THRESHOLD) for i in range(len(texts)))


def test_classifier_on_labelled_prose(spark):
    """Held-out documents that differ in the order of their words only: the pooled products of neighbours tell them."""
    rng = random.Random(19)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    good = [" ".join(x for _ in range(60) for x in (rng.choice(nouns), rng.choice(verbs))) for _ in range(250)]
    mixed = [t.split() for t in good]
    for words in mixed:
        rng.shuffle(words)
    texts = [x for pair in zip(good, map(" ".join, mixed), strict=True) for x in pair]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(500)], "doc_id long, quality int")
    docs = _docs(spark, texts).withColumnsRenamed({"kept": "features", "lang": "score"})
    docs = docs.union(docs.where("doc_id < 3"))
    rows = quality_net.score(docs, labels).collect()
    got = {}
    for r in rows:
        assert got.setdefault(r.doc_id, r.score) == pytest.approx(r.score)
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 503 and sum((got[i] >= 0.5) == (i % 2 == 0) for i in held) >= 0.9 * len(held)


def test_classifier(spark):
    rng = random.Random(4)
    good, bad = _prose(rng, 150), _junk(rng, 150)
    docs = _docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 300)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_net.score(docs, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i in got) and len(got) == 300 + len(ODD)
    assert sum(got[i].predicted == int(i < 150) for i in held) >= 0.95 * len(held)
    assert {r.score for r in quality_net.score(docs, labels.limit(0)).collect()} == {0.5} and quality_net.score(docs.limit(0), labels).isEmpty()


def test_language_model(spark):
    rng = random.Random(5)
    texts = _prose(rng, 200) + ODD + ["Unseen words only", "the of"]
    count, read = Counter(), [(t or "").translate(LOWER) for t in texts]
    tokens = [re.findall("[^\\x20\\x09-\\x0D]+", t) + [None] for t in read]
    for i, t in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 10:
            count.update(t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in interp.score(_docs(spark, texts), block_bytes=3000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0 and math.isfinite(r.score)
    whole = {r.doc_id: r.score for r in interp.score(_docs(spark, texts)).collect()}
    assert all(whole[i] == pytest.approx(got[i].score, rel=1e-6) for i in whole)
    assert interp.score(_docs(spark, texts).limit(0)).isEmpty()


def _interpolated(tokens, folds):
    """The model by plain counts: (score of each text, probability of a word after a context)."""
    import numpy as np

    kept, held = (Counter(), Counter()), (Counter(), Counter())
    pairs = lambda t: list(zip([None, *t[:-1]], t, strict=True))
    for t, fold in zip(tokens, folds, strict=True):
        if fold:
            words, two = held if fold == 1 else kept
            words.update(t)
            two.update(pairs(t))
    cells, n = Counter(), sum(kept[0].values())
    for t, fold in zip(tokens, folds, strict=True):
        if fold == 1:
            for c, w in pairs(t):
                context, p, q = kept[0][c], kept[1][c, w] / max(kept[0][c], 1), kept[0][w] / max(n, 1)
                cells[int(interp._bucket(np.array([context]))[0]), int(interp._level(np.array([p]))[0]), int(interp._level(np.array([q]))[0])] += 1
    mix = interp.learn(np.array([(*k, v) for k, v in cells.items()], dtype=np.int64).reshape(-1, 4), 1 / (len(kept[0]) + 1))
    words, two = kept[0] + held[0], kept[1] + held[1]
    total, types = sum(words.values()), len(words)

    def chance(c, w):
        a, b, d = mix[int(interp._bucket(np.array([words[c]]))[0])]
        p = a * two[c, w] / max(words[c], 1) + b * words[w] / max(total, 1) + d / (types + 1)
        return p / (1 - a * (words[c] == 0) - b * (total == 0))

    return [sum(math.log10(chance(c, w)) for c, w in pairs(t)) for t in tokens], chance, words


def test_language_model_against_plain_counts(spark):
    rng = random.Random(20)
    words = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(4000)]
    texts = [" ".join(words[i : i + rng.randint(0, 60)]) for i in range(0, 4000, 40)] + [None, "", "never seen", "W1 w2\tw3", "long " * 30000]
    tokens = [re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOWER)) + [None] for t in texts]
    folds = [min(zlib.crc32(str(i).encode()) % 10, 2) for i in range(len(texts))]
    want, chance, known = _interpolated(tokens, folds)
    got = {r.doc_id: r.score for r in interp.score(_docs(spark, texts), block_bytes=4000).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)
    for context in (None, "w1", "w3", "never"):  # every known word, and one share for all unknown ones
        assert sum(chance(context, w) for w in known) + chance(context, "none such") == pytest.approx(1)


def test_lm_weights():
    import numpy as np

    cells = np.array([[1, 9, 30, 100], [1, 0, 30, 10], [5, 9, 30, 1000]])
    mix = interp.learn(cells, 1e-4)
    assert mix.shape == (interp.CONTEXTS, 3) and np.allclose(mix.sum(axis=1), 1) and (mix > 0).all() and mix[5, 0] > mix[1, 0]


FIXED = ["a@b.c_d@e.f x 1.2.3.4.5 999.1.1.1 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (377) 555-0271, +12 3", "", None, "5 5 5 5555", "tel +49 30 1234567.", "@ a@b a@b.c. x@y.z@w.v 1.1.1.1.1.1.1.1", "é" * 50 + " mail me: q@r.st", "9" * 30000, "a@" * 3000]


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def _base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = []
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out.append([f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if fine(m[0])])
    return [len(x) for x in out], hashlib.sha256(",".join(x for k in out for x in k).encode()).hexdigest()


def test_private_spans(spark):
    rng = random.Random(6)
    loose = ["".join(rng.choices("ab@.1234+-() _%", k=rng.randint(0, 40))) for _ in range(300)]
    texts = FIXED + loose
    got = {r.doc_id: r for r in pii.digests(pii.private_spans(_docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert ([got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone], got[i].base_sha256) == _base(t), t
    assert pii.private_spans(_docs(spark, texts).limit(0)).isEmpty()


def _accepted(edges):
    """The rounds of ``confident_patterns`` by plain loops; edges: (value, kind or None, pattern)."""
    kind, beside = {}, {}
    for value, k, pattern in edges:
        beside.setdefault(pattern, set()).add(value)
        if k and (value, pattern) not in kind or k and k < kind[value, pattern]:
            kind[value, pattern] = k
    beside = {p: v for p, v in beside.items() if len(v) >= pii.SUPPORT}
    accepted = {}
    while True:
        chance = {}
        for p, (k, c) in accepted.items():
            for v in beside[p]:
                chance.setdefault(v, {}).setdefault(k, []).append(min(c, 1.0))
        guess = {}
        for v, kinds in chance.items():
            guess[v] = max((1 - math.exp(sum(math.log(1.0001 - c) for c in cs)), k) for k, cs in kinds.items())
        fresh = {}
        for p, values in beside.items():
            support, known = Counter(), 0
            for v in values:
                if (v, p) in kind:
                    support[kind[v, p]] += 1
                elif v in guess:
                    support[guess[v][1]] += guess[v][0]
                else:
                    continue
                known += 1
            whole = sum(support.values()) + pii.UNKNOWN * (len(values) - known)
            for k, n in support.items():
                if p not in accepted and n >= pii.SUPPORT and n / whole >= pii.CONFIDENCE:
                    fresh[p] = (k, n / whole)
        if not fresh:
            return accepted
        accepted |= fresh


def test_rounds_against_plain_loops(spark):
    rng = random.Random(16)
    rows = []
    for n in range(400):
        near = rng.choice(["mail", "call", "id", "see"])
        known = rng.random() < {"mail": 0.95, "call": 0.6, "id": 0.05, "see": 0.3}[near]
        kind = ("email" if near != "call" else "phone") if known else "other"
        patterns = [near, f"{rng.choice(['my', 'to'])} {near}"]
        rows.append((f"v{rng.randrange(220)}{kind[0]}", kind, patterns))
    # a chain: each link's values are half known only after the one before is accepted
    rows += [(f"c{i}", "email", ["first"]) for i in range(8)] + [(f"x{i}", "other", ["first", "second"]) for i in range(6)] + [(f"y{i}", "other", ["second", "third"]) for i in range(6)] + [(f"z{i}", "other", ["third"]) for i in range(6)]
    want = _accepted([(v, None if k == "other" else k, p) for v, k, ps in rows for p in ps])
    shape = "array<struct<kind:string,value:string,patterns:array<string>>>"
    df = spark.createDataFrame([([(k, v, ps)] if k != "other" else [], [(k, v, ps)] if k == "other" else []) for v, k, ps in rows], f"spans {shape}, others {shape}")
    got = {r.pattern: (r.kind, r.confidence) for r in pii.confident_patterns(df).collect()}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()} and "second" in got
    assert all(got[p][1] == pytest.approx(want[p][1]) for p in want)


def test_context_has_no_reach(spark):
    far = "phone:" + " " * 5000
    df = _docs(spark, [f"Reach {n} under {far}+1 (377) 555-02{n:02d} or so" for n in range(20)] + [f"Again under {far}555-0271x or so", f"{'w' * 4000}: under {far}555-0272x"])
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[20] == f"Again under {far}[PHONE] or so" and got[21].endswith(f"under {far}[PHONE]")


def test_contexts_find_the_unseen(spark):
    seeds = [f"Reach {n} under phone: +1 (377) 555-02{n:02d} or so" for n in range(20)]
    unseen, clean = ["Again under phone: 555-0271x or so"], ["Nothing 12345678 to see", "phone call at noon"]
    df = _docs(spark, seeds + unseen + clean)
    got = {r.doc_id: r.spans for r in pii.digests(pii.private_spans(df)).collect()}
    start = unseen[0].index("555")
    assert got[20] == f"phone:{start}:{start + 9}" and got[21] == got[22] == ""
    texts = {r.doc_id: r for r in pii.redact(df.withColumn("spans", F.lit(1))).collect()}
    assert texts[0].text == "Reach 0 under phone: [PHONE] or so" and texts[20].text == "Again under phone: [PHONE] or so" and texts[21].text == clean[0] and texts[21].spans == 1


def test_contexts_find_other_shapes(spark):
    hidden = ["030 123 4567", "(0377) 555 0271", "john.doe99", "ABC/def12", "jane.doe", "QxRtYuWz"]
    seeds = [f"Reach {n} under phone: +1 (377) 555-02{n:02d} or so" for n in range(20)]
    df = _docs(spark, seeds + [f"Again under phone: {v} or so" for v in hidden] + ["Nothing 030 123 4567 to john.doe"])
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert [got[20 + i] for i in range(len(hidden))] == ["Again under phone: [PHONE] or so"] * len(hidden)
    assert got[20 + len(hidden)] == "Nothing 030 123 4567 to john.doe"
    # strangers without number do not follow from a few known values
    many = _docs(spark, seeds + [f"Again under phone: x{i}y{i} or so" for i in range(1000, 1100)])
    assert not any("[PHONE]" in r.text for r in pii.redact(many).where("doc_id >= 20").collect())


def test_licences(spark):
    rng = random.Random(7)
    lines_ = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "This tool: Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    texts = _prose(rng, 40) + [f"{_prose(rng, 1)[0]}\n{x}" for x in lines_.values()] + ["a\nLicensed under the house license of Acme.", None, "", "\n".join([lines_["mit"], lines_["gpl-3.0"], lines_["mit"]])]
    wrapped = ["the wind and the river stone\nThis work is licensed under the GNU General\nPublic License, version 3. And light.", "of the sea " * 30 + "released under the MIT License and the wind " + "of stone " * 30]
    siblings = {"This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0", "Released under the BSD 2-Clause License.": "bsd-2-clause", "This work is licensed under the GNU General Public License, version 9.": ""}
    both = [texts[41], texts[41]]
    got = {}
    rows = texts + wrapped + list(siblings) + ["light wind " * 40000 + lines_["mit"]]
    df = _docs(spark, rows).withColumnsRenamed({"kept": "family", "lang": "words", "own": "features"})
    df = df.union(spark.createDataFrame([(900, both[0], "", "", ""), (900, both[1], "", "", "")], df.schema))
    for r in licences.scan(df).collect():
        assert got.setdefault(r.doc_id, (r.n_paragraphs, r.families)) == (r.n_paragraphs, r.families)
    assert all(got[i] == (0, "") for i in range(40)) and [got[40 + i] for i in range(4)] == [(1, f) for f in lines_]
    assert got[44] == got[45] == got[46] == (0, "") and got[47] == (3, "gpl-3.0,mit")
    assert got[48] == (1, "gpl-3.0") and got[49] == (1, "mit")
    assert [got[50 + i][1] for i in range(4)] == list(siblings.values()) and got[54] == (1, "mit") and got[900] == got[41]
    assert licences.scan(df.limit(0)).isEmpty()


def test_licences_held_out(spark):
    """Notices in words that no training row has, amid prose of other words: families found, and none in plain prose."""
    rng = random.Random(17)
    prose = lambda n: " ".join(rng.choices(["the", "of", "Sea", "wind", "river", "stone", "and", "light", "under", "work", "public", "version"], k=n))
    texts, want = [], []
    for family, names in licences.NAMES.items():
        texts.append(f"{prose(40)}. The code in here may be used under {names[0]} by all. {prose(30)}.")
        want.append(family)
    texts += [prose(120) + "." for _ in range(60)]
    want += [""] * 60
    got = {r.doc_id: r.families for r in licences.scan(_docs(spark, texts)).collect()}
    assert sum(got[i] == w for i, w in enumerate(want[: len(licences.NAMES)])) >= 0.9 * len(licences.NAMES) and all(got[i] == "" for i in range(len(licences.NAMES), len(texts)))
