"""Runs of repeated words (operator 11).

A run is a stretch of consecutive words with a smallest period q, at least 2 q long, that neither neighbour extends. The words
of a text are appended one by one: the path from the appended prefix's state to the root of its suffix automaton's links
is accessed in a link-cut tree whose preferred paths are segments of one colour, the last end at which the segment's
words occurred. An appended end at a distance of at most a segment's length from the last one closes a square, and each
square is extended to its run. Then the whole path takes the new end as its colour.
"""

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.pretoken import portions

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Words that a run has at least. Windows of GRAM words cover a run of so many with windows that occur twice.
LEAST, GRAM = 12, 5


def automaton(words: list[int]) -> tuple[array, array, array]:
    """The suffix automaton of words: each state's length and link, and the state of each prefix.

    Most states have one way out, which lies in two arrays; the others' ways lie in dictionaries besides.
    """
    length, link, way, to, ways, ends, last = array("l", [0]), array("l", [-1]), array("l", [-1]), array("l", [-1]), {}, array("l"), 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        way.append(-1)
        to.append(-1)
        state, met = last, -1
        while state != -1:
            if way[state] == word:
                met = to[state]
                break
            if way[state] == -1:
                way[state], to[state] = word, new
            else:
                more = ways.get(state)
                if more is None:
                    ways[state] = {word: new}
                elif word in more:
                    met = more[word]
                    break
                else:
                    more[word] = new
            state = link[state]
        if met != -1:
            if length[state] + 1 == length[met]:
                link[new] = met
            else:
                copy = len(length)
                length.append(length[state] + 1)
                link.append(link[met])
                way.append(way[met])
                to.append(to[met])
                if met in ways:
                    ways[copy] = dict(ways[met])
                link[met] = link[new] = copy
                while state != -1:
                    if way[state] == word:
                        if to[state] != met:
                            break
                        to[state] = copy
                    else:
                        more = ways.get(state)
                        if more is None or more.get(word) != met:
                            break
                        more[word] = copy
                    state = link[state]
        last = new
        ends.append(new)
    return length, link, ends


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(period, end) of squares: at each end within a run from its second period on, the run's smallest period is among them."""
    length, above, ends = automaton(words)
    n = len(length)
    left, right, colour = array("l", [-1]) * n, array("l", [-1]) * n, array("l", [-1]) * n
    for end, state in enumerate(ends):
        below, at = -1, state
        while at != -1:
            # splay: at becomes the root of the tree that holds its segment, and takes over the segment's colour
            top = at
            while True:
                up = above[at]
                if up == -1 or (left[up] != at and right[up] != at):
                    break
                over = above[up]
                inner = over != -1 and (left[over] == up or right[over] == up)
                top = up if not inner else over
                if inner:
                    turn = (up, at) if (left[over] == up) == (left[up] == at) else (at, at)
                else:
                    turn = (at,)
                for node in turn:
                    parent = above[node]
                    grand = above[parent]
                    if left[parent] == node:
                        child = right[node]
                        left[parent], right[node] = child, parent
                    else:
                        child = left[node]
                        right[parent], left[node] = child, parent
                    if child != -1:
                        above[child] = parent
                    above[parent], above[node] = node, grand
                    if grand != -1:
                        if left[grand] == parent:
                            left[grand] = node
                        elif right[grand] == parent:
                            right[grand] = node
            last = colour[at] = colour[top]
            if last >= 0 and end - last <= length[at]:
                yield end - last, end
            # what lies deeper on the old segment keeps its colour
            deeper = right[at]
            if deeper != -1:
                colour[deeper] = last
            right[at] = below
            below, at = at, above[at]
        colour[below] = end


def _runs(words: list[int]) -> dict[tuple[int, int], int]:
    """The smallest period of each run, by its first and last place."""
    found, reach, n = {}, {}, len(words)
    for period, end in squares(words):
        if reach.get(period, -1) >= end:
            continue
        stop = end + 1
        while stop < n and words[stop] == words[stop - period]:
            stop += 1
        start = end - 2 * period + 1
        while start > 0 and words[start - 1] == words[start - 1 + period]:
            start -= 1
        reach[period] = stop - 1
        if stop - start >= LEAST:
            found[start, stop] = min(period, found.get((start, stop), period))
    return found


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least LEAST words, by start, then period.

    Every word of such a run lies in a window of GRAM words that occurs again, as the run repeats: stretches without such
    windows are passed over.
    """
    n = len(words)
    if n < LEAST:
        return []
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=n)
    if len(number) == n:
        return []
    key = np.zeros(n - GRAM + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(key)] + np.uint64(1)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    alike = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][alike]] = again[order[:-1][alike]] = True
    if not again.any():
        return []
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, np.nonzero(again)[0], 1)
    np.add.at(inside, np.nonzero(again)[0] + GRAM, -1)
    covered = np.concatenate([[0], np.cumsum(inside[:-1]) > 0, [0]]).astype(np.int8)
    edges = np.diff(covered)
    out = []
    for a, b in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist(), strict=True):
        if b - a >= LEAST:
            dense = np.unique(ids[a:b], return_inverse=True)[1].tolist()
            out += [(a + start, stop - start, period) for (start, stop), period in _runs(dense).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    if not found:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) per row of ``docs`` (doc_id, text).

    Words are stretches without blanks (tab to carriage return), numbered from 0; runs have at least 12 words and twice their
    smallest period, in order of start and period. collapsed: the words that lie in no run after its first period, joined by
    a blank. A null or empty text has no runs and an empty ``collapsed``. Repeated rows stay; other columns are not read. A
    text is worked on by one task; memory is linear in it, time too but for a logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                words = [WORD.findall(text) for text in part]
                found = [runs(w) for w in words]
                flat = np.array([r for f in found for r in f], dtype=np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                kept = pa.array([_collapsed(w, f) for w, f in zip(words, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(bounds, rows), kept], ["doc_id", "runs", "collapsed"])
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of a tenth of the documents, chosen by a checksum of doc_id, whose words repeat from a place on.

    h, the checksum of the decimal doc_id, is divisible by 10, g is a tenth of it: of n words each word i from a = g % n on
    becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Other texts are as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` with the longest run (of equal ones that of the smallest start, then period) and digests instead of texts."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
