"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 1).

A fingerprint is cut into 16-bit segments. Each segment decodes to the indices of nearby Golay codewords, a few
keys that survive bit errors. By the pigeonhole principle the errors of a linked pair leave some group of segments
with few of them, so that the pair meets under a key of that group. Distinct fingerprints are dealt by key, and
those that meet are verified on all bits.

Documents of one fingerprint are one class from the start; where similarity decides, those of one set of shingles are,
and the fingerprint is over distinct shingles. Fingerprints that meet under a key are not paired
with each other: a walk over them gives a spanning forest, which links what all pairs would link. Under a key no task
holds more than ``BLOCK`` fingerprints: where more meet they become numbered blocks, and pairs of block numbers, joined
with the blocks, are walked by tasks of their own. Keys that a sample shows to be hot are salted before they meet.
"""

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import golay
from tracemill.llm.components import components
from tracemill.llm.store import parts, small_batches, stored

BLOCK = 4096
#: One in so many fingerprints is looked at for hot keys; the hottest so many are salted. Others may be hot and still
#: give whole results: their blocks are then cut by one task.
SAMPLED, HOT = 64, 10_000
#: Keys take so many bits at most; a salt stands above them.
KEY_BITS = 40
_HEX = 16


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of space-joined words, A-Z lower-cased; fewer words give the whole sequence, none nothing."""
    found = (text or "").encode().lower().split()
    if len(found) > words:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    else:
        shingles = [b" ".join(found)] if found else []
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles]), dtype=">u8")


def set_hash(hashes: np.ndarray) -> int:
    """XXH64 of a sorted array of distinct shingle hashes."""
    return xxhash.xxh64_intdigest(hashes.astype(">u8").tobytes(), 42)


def fingerprint(text: str | None, words: int, bits: int, distinct: bool = False) -> list[int]:
    """64-bit halves of the SimHash: a bit is 1 if set in over half of the shingles' hashes.

    ``distinct`` counts each shingle once, and adds a half that is a hash of the set of shingles.
    """
    halves, content = [], []
    for seed in range(42, 42 + bits // 64):
        h, count = shingle_hashes(text, words, seed), np.zeros(64, dtype=np.int64)
        if distinct:
            h = np.unique(h)
            content = content or [set_hash(h)]
        for i in range(0, len(h), 65536):
            bytes_ = h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        halves.append(int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]))
    return halves + content


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs``; hex digits, the last half first.

    A null or empty text, or one of white space, has fingerprint zero. Repeated rows stay; other columns are not read.
    With ``distinct``, 16 digits that hash the set of shingles come before the fingerprint.
    """
    digits = _HEX * (bits // 64 + distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for text in batch.column(1):
                low, *high = fingerprint(text.as_py(), words, bits, distinct)
                values.append(f"{sum(x << 64 * i for i, x in enumerate([low, *high])):0{digits}x}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _segments(low: np.ndarray) -> list[np.ndarray]:
    return [((low >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]


def one_flip_keys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): codeword indices of three of the four segments, at most one of them of a one-bit neighbour.

    Three errors leave some three segments with two at most; a word one bit from both is then decoded by both.
    """
    index, near, new = golay.tables()
    segments, rows, keys = _segments(low), [], []
    for n, group in enumerate(combinations(range(4), 3)):
        base = np.full(len(low), n, dtype=np.uint64)
        for s in group:
            base = (base << np.uint64(12)) | index[segments[s]]
        rows.append(np.arange(len(low)))
        keys.append(base)
        for place, s in enumerate(group):
            shift = np.uint64(12 * (2 - place))
            row, bit = np.nonzero(new[segments[s]])
            own = segments[s][row]
            rows.append(row)
            keys.append(base[row] ^ ((index[own] ^ near[own, bit]) << shift))
    return np.concatenate(rows), np.concatenate(keys)


def two_segment_keys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every nearby codeword index of one segment with every one of another, for each two of the four.

    A pair meets if two of its segments have at most two errors each; up to eight errors always leave two such.
    """
    index, near, new = golay.tables()
    segments, rows, keys = _segments(low), [], []
    lists = [np.concatenate([index[s][:, None], near[s]], axis=1) for s in segments]
    there = [np.concatenate([np.ones((len(low), 1), dtype=bool), new[s]], axis=1) for s in segments]
    for n, (a, b) in enumerate(combinations(range(4), 2)):
        for i in range(17):
            row = np.nonzero(there[a][:, i])[0]
            at, bit = np.nonzero(there[b][row])
            row = row[at]
            rows.append(row)
            keys.append(((np.uint64(n) << np.uint64(12) | lists[a][row, i]) << np.uint64(12)) | lists[b][row, bit])
    return np.concatenate(rows), np.concatenate(keys)


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links fingerprints (rows) at ``radius`` or fewer differing bits."""
    left, begin, end = np.arange(len(prints)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            take = max(1, 2_000_000 // len(left))
            part, front = front[:take], front[take:]
            near = np.bitwise_count(prints[part][:, None, :] ^ prints[left][None, :, :]).sum(axis=2, dtype=np.int16) <= radius
            hit = near.any(axis=0)
            begin.append(part[near[:, hit].argmax(axis=0)])
            end.append(left[hit])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *begin]), np.concatenate([none, *end])


def nearest_forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, but of least total distance: what any smaller radius links, its edges link as well."""
    n = len(prints)
    left, best, via = np.arange(1, n), np.full(n, 1 << 14, dtype=np.int32), np.zeros(n, dtype=np.int64)
    at, begin, end = 0, [], []
    while len(left):
        far = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.int32)
        closer = far < best[left]
        best[left[closer]], via[left[closer]] = far[closer], at
        i = int(best[left].argmin())
        at = int(left[i])
        if best[at] <= radius:
            begin.append(via[at])
            end.append(at)
        left = np.delete(left, i)
    return np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)


def _edge_rows(halves: int) -> str:
    return ", ".join(f"{x}{i} long" for x in "uv" for i in range(halves)) + ", key long, number long, block binary"


def _as_batch(u: np.ndarray, v: np.ndarray, block: tuple | None = None) -> pa.RecordBatch:
    """Edges, and after them a block (key, number, its rows) if there is one."""
    halves, n = u.shape[1], len(u)
    more = np.zeros(int(block is not None), np.int64)
    columns = {f"{name}{i}": pa.array(np.concatenate([x[:, i].view(np.int64), more])) for name, x in (("u", u), ("v", v)) for i in range(halves)}
    for i, (name, kind) in enumerate((("key", pa.int64()), ("number", pa.int64()), ("block", pa.binary()))):
        columns[name] = pa.array([None] * n + ([block[i]] if block else []), kind)
    return pa.RecordBatch.from_pydict(columns)


def _meet(halves: int, width: int, columns: int, radius: int, walk):
    """Over rows (key with salt, values) in order: what ``walk`` links of those that meet under a key, or blocks of the key.

    A key that is salted (its salt is above 0) or has more than ``BLOCK`` rows gives blocks, numbered within the key.
    """
    none = np.zeros((0, columns), dtype=np.uint64)
    no_edge = none[:, :width]

    def small(prints: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        two = begins[ends - begins == 2]
        two = two[np.bitwise_count(prints[two, :halves] ^ prints[two + 1, :halves]).sum(axis=1) <= radius]
        u, v = [prints[two, :width]], [prints[two + 1, :width]]
        for b, e in zip(begins[ends - begins > 2], ends[ends - begins > 2], strict=True):
            # most keys bring strangers together: a look at all pairs of a few is cheaper than a walk
            if e - b <= 32 and np.count_nonzero(np.bitwise_count(prints[b:e, None, :halves] ^ prints[None, b:e, :halves]).sum(axis=2) <= radius) == e - b:
                continue
            for x, y in walk(prints[b:e], None):
                u.append(x)
                v.append(y)
        return np.concatenate(u), np.concatenate(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number = None, none, 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of what is held under the key, till less than a block is left; the last one whatever its size."""
            nonlocal held, number
            while len(held) > BLOCK or last and len(held):
                yield _as_batch(no_edge, no_edge, (now[0], (now[1] << 32) + number, held[:BLOCK].tobytes()))
                held, number = held[BLOCK:], number + 1

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if number or now[1]:
                yield from cut(True)
            else:
                for u, v in walk(held, None):
                    yield _as_batch(u, v)

        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            prints = np.stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(columns)], axis=1)
            begins = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
            ends = np.append(begins[1:], len(keys))
            whole = np.ones(len(begins), dtype=bool)  # unsalted keys that lie within this batch
            whole[[0, -1]] = False
            whole &= (keys[begins] >> KEY_BITS == 0) & (ends - begins <= BLOCK)
            yield _as_batch(*small(prints, begins[whole], ends[whole]))
            for b, e in zip(begins[~whole], ends[~whole], strict=True):
                own = (int(keys[b]) & ((1 << KEY_BITS) - 1), int(keys[b]) >> KEY_BITS)
                if own != now:
                    if now is not None:
                        yield from closed()
                    now, held, number = own, none, 0
                held = np.concatenate([held, prints[b:e]])
                yield from cut(False)
        if now is not None:
            yield from closed()

    return run


def _deal(width: int, keys, salts: dict[int, int] | None = None):
    """Rows (key with salt, values) of values in hex digits, a row for each of their keys."""
    hot = np.array(sorted(salts or {}), dtype=np.int64)
    shares = np.array([(salts or {})[k] for k in hot.tolist()], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = [int(x, 16) for x in batch.column(0).slice(at, 2000).to_pylist()]
                parts_ = [np.array([(x >> 64 * i) & 0xFFFF_FFFF_FFFF_FFFF for x in part], dtype=np.uint64) for i in range(width)]
                row, key = keys(parts_[0])
                key = key.view(np.int64)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    found = np.nonzero(hot[place] == key)[0]
                    with np.errstate(over="ignore"):
                        mixed = sum(p * np.uint64(0x9E3779B97F4A7C15 + 2 * i) for i, p in enumerate(parts_))[row[found]]
                    key[found] += (((mixed >> np.uint64(33)) % shares[place[found]]).astype(np.int64) + 1) << KEY_BITS
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[row].view(np.int64)) for c in parts_)], ["key", *(f"p{i}" for i in range(len(parts_)))])

    return run


def hot_keys(prints: DataFrame, width: int, keys) -> dict[int, int]:
    """How many salts each of the hottest keys gets: about one for every four blocks of values that a sample lets expect."""
    schema = ", ".join(f"{c} long" for c in ("key", *(f"p{i}" for i in range(width))))
    some = prints.where(F.pmod(F.xxhash64("fingerprint"), F.lit(SAMPLED)) == 0).mapInArrow(_deal(width, keys), schema)
    most = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > 4 * BLOCK).orderBy(F.desc("n"), "key").limit(HOT)
    return {r["key"]: -(-r["n"] * SAMPLED // (4 * BLOCK)) for r in most.collect()}


def block_pairs(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., number, other, block_a, block_b) of every two numbers of blocks (by..., number, block) with the same ``by``.

    Numbers are paired first, and the pairs meet the blocks by them. A block's pair with itself has no block_b.
    """
    numbers = blocks.select(*by, "number")
    pairs = numbers.join(numbers.withColumnRenamed("number", "other"), by).where("number <= other")
    first = pairs.join(blocks.withColumnRenamed("block", "block_a"), [*by, "number"])
    second = blocks.select(*by, F.col("number").alias("other"), F.col("block").alias("block_b"))
    own = first.where("number = other").select(*by, "number", "other", "block_a", F.lit(None).cast("binary").alias("block_b"))
    return own.unionByName(first.where("number < other").join(second, [*by, "other"]).select(*by, "number", "other", "block_a", "block_b"))


def links(prints: DataFrame, bits: int, radius: int, keys=one_flip_keys, tree=forest, more: int = 0) -> DataFrame:
    """(u, v): a spanning forest, for each key, of the distinct values in ``prints`` (fingerprint); stored.

    ``more`` halves before the ``bits`` tell values apart, but count for no distance.
    """
    spark, halves = prints.sparkSession, bits // 64
    width = halves + more
    names = [f"p{i}" for i in range(width)]

    def walk(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        both = a if b is None else np.concatenate([a, b])
        i, j = tree(both[:, :halves], radius)
        yield both[i], both[j]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("block_a"), batch.column("block_b"), strict=True):
                left, right = (np.frombuffer(x.as_py(), dtype=np.uint64).reshape(-1, width) if x.is_valid else None for x in (a, b))
                for u, v in walk(left, right):
                    yield _as_batch(u, v)

    values = prints.select("fingerprint").distinct()
    dealt = values.mapInArrow(_deal(width, keys, hot_keys(values, width, keys)), ", ".join(f"{c} long" for c in ("key", *names)))
    n = parts(spark)
    met = stored(dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(halves, width, width, radius, walk), _edge_rows(width)), "met")
    blocks = met.where("block is not null").select("key", "number", "block")
    text = lambda side: F.concat(*(F.lpad(F.lower(F.hex(f"{side}{i}")), _HEX, "0") for i in reversed(range(width))))
    found = met.where("block is null")
    if not blocks.isEmpty():
        with small_batches(spark, 8):
            found = found.unionByName(stored(block_pairs(blocks, ["key"]).repartition(n, "key", "number", "other").mapInArrow(solve, _edge_rows(width)), "met"))
    return found.select(text("u").alias("u"), text("v").alias("v")).distinct()


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(fingerprint, hashes array<long>) per row of ``docs`` (fingerprint, text): the distinct hashes of its shingles.

    Rows whose fingerprint begins with the hash of another set are left out: rows of one doc_id may differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(shingle_hashes(t.as_py(), words, 42).astype("<u8"))
                if int(name[:_HEX], 16) == set_hash(h):
                    names.append(name)
                    sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sets, pa.list_(pa.int64()))], ["fingerprint", "hashes"])

    return docs.select("fingerprint", F.col("text").cast("string")).mapInArrow(run, "fingerprint string, hashes array<long>")


def sets_of(edges: DataFrame, prints: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(fingerprint, hashes) of the values in ``edges`` (u, v); a row of the smallest doc_id stands for its value."""
    nodes = edges.select(F.col("u").alias("fingerprint")).union(edges.select("v")).distinct()
    chosen = prints.join(nodes, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("doc_id").alias("_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(chosen, "_id")
    return shingle_sets(texts, words).dropDuplicates(["fingerprint"])


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``edges`` (u, v) of fingerprints whose ``sets`` (fingerprint, hashes) have at least this Jaccard similarity."""
    one = edges.join(sets.select(F.col("fingerprint").alias("u"), F.col("hashes").alias("a")), "u")
    both = one.join(sets.select(F.col("fingerprint").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


#: Bits of the sketches that tell whether two sets of shingles can be as similar as wanted; values of a block of them.
SKETCH, SKETCH_BLOCK = 4096, 1024


def sketch(hashes: np.ndarray) -> bytes:
    """A SimHash of ``SKETCH`` bits of a set of 64-bit hashes, whose further hashes are mixed from the first."""
    out = []
    with np.errstate(over="ignore"):
        for i in range(SKETCH // 64):
            h = hashes.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i) + np.uint64(i)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            count = np.zeros(64, dtype=np.int64)
            for at in range(0, len(h), 65536):
                count += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(np.packbits(2 * count > len(h), bitorder="little").tobytes())
    return b"".join(out)


def sketch_radius(similarity: float) -> int:
    """Bits that sketches of sets of such a Jaccard similarity differ in at most, but for one pair in 100,000 or so.

    The cosine of such sets is at least 2s / (1 + s), and each bit differs with the angle's share of a half turn; 4.5 deviations are added.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    return min(SKETCH, ceil(SKETCH * p + 4.5 * (SKETCH * p * (1 - p)) ** 0.5))


def sketched_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of values in ``left`` (node, whole, root) of one whole, but different roots, whose sketches are near enough; stored.

    All values of a whole are compared with each other, by blocks of about ``SKETCH_BLOCK`` in tasks, and only near ones are
    written: a whole of values that are not alike costs comparisons, but no rows.
    """
    spark, radius, width = left.sparkSession, sketch_radius(similarity), SKETCH // 8
    digits = len(left.first()["node"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [sketch(np.array(h.values.to_numpy())) if h.is_valid else bytes(width) for h in batch.column(3)]
            rows = [n.encode() + r.encode() + d for n, r, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["whole", "node", "row"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("block_a"), batch.column("block_b"), strict=True):
                one, two = (np.frombuffer(x.as_py(), dtype=np.uint8).reshape(-1, 2 * digits + width) if x.is_valid else None for x in (a, b))
                other = one if two is None else two
                bits = [np.ascontiguousarray(x[:, 2 * digits :]).view(np.uint64) for x in (one, other)]
                names = [[bytes(x[i]).decode() for i in range(len(x))] for x in (one[:, :digits], other[:, :digits])]
                roots = [np.ascontiguousarray(x[:, digits : 2 * digits]).view(f"S{digits}").ravel() for x in (one, other)]
                u, v = [], []
                for at in range(0, len(one), 32):
                    near = np.bitwise_count(bits[0][at : at + 32, None, :] ^ bits[1][None, :, :]).sum(axis=2, dtype=np.int32) <= radius
                    i, j = np.nonzero(near & (roots[0][at : at + 32, None] != roots[1][None, :]))
                    i += at
                    if two is None:
                        i, j = i[i < j], j[i < j]
                    u += [names[0][x] for x in i]
                    v += [names[1][x] for x in j]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])

    rows = left.join(sets.withColumnRenamed("fingerprint", "node"), "node").select("whole", "node", "root", "hashes").mapInArrow(draw, "whole string, node string, row binary")
    sizes = left.groupBy("whole").agg(F.ceil(F.count("*") / SKETCH_BLOCK).alias("n"))
    dealt = rows.join(sizes, "whole").select("whole", F.pmod(F.xxhash64("node"), "n").alias("number"), "row")
    blocks = stored(dealt.groupBy("whole", "number").agg(F.array_join(F.transform(F.collect_list("row"), F.hex), "").alias("rows")).select("whole", "number", F.unhex("rows").alias("block")), "sketches")
    with small_batches(spark, 16):
        return stored(block_pairs(blocks, ["whole"]).repartition(parts(spark), "whole", "number", "other").mapInArrow(solve, "u string, v string"), "near")


def similar_roots(prints: DataFrame, docs: DataFrame, words: int, bits: int, radius: int, keys, similarity: float) -> DataFrame:
    """(node, root) of sets of shingles, by ``fingerprints`` with ``distinct``, linked by pairs that candidates connect and that are as similar.

    A forest per key is verified first and joins most. What it leaves apart, though candidates connect it, is compared fully,
    by sketches (``sketched_pairs``), and what is near is verified.
    """
    edges = stored(links(prints, bits, radius, keys, nearest_forest, 1), "candidates")
    sets = stored(sets_of(edges, prints, docs, words), "shingles")
    sure = stored(similar(edges, sets, similarity), "similar")
    roots = stored(components(sure), "roots")
    known = components(edges).withColumnRenamed("root", "whole").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known, "wholes")
    torn = known.groupBy("whole").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("whole")
    left = stored(known.join(torn, "whole", "left_semi").select("node", "whole", "root"), "apart")
    if left.isEmpty():
        return roots
    pairs = sketched_pairs(left, sets, similarity).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    tried = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = stored(similar(pairs.join(tried, ["u", "v"], "left_anti"), sets, similarity), "similar")
    return roots if more.isEmpty() else components(sure.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, keys=one_flip_keys, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``: documents linked at ``radius`` or fewer bits, transitively.

    ``one_flip_keys`` find every pair up to 3 bits apart; ``two_segment_keys`` every pair up to 8 in the first
    64 bits, and most above. With a ``similarity``, the radius is that of candidates: of the values that candidates
    connect, those link whose shingle sets are as similar (``similar_roots``); fingerprints are then
    over distinct shingles, and texts of one fingerprint are compared like others. component_id is the smallest doc_id of the
    component, null if all in it are null. Null, empty and blank texts have fingerprint zero and link like any other;
    an empty table gives no rows; repeated rows stay, each with its component.
    """
    prints = stored(fingerprints(docs, words, bits, similarity is not None), "fingerprints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    if similarity is None:
        roots = components(links(prints, bits, radius, keys))
    else:
        roots = similar_roots(prints, docs, words, bits, radius, keys, similarity)
    classes = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    classes = stored(classes, "classes")
    first = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(first, "root").select("fingerprint", "component_id")
    digits = F.substring("fingerprint", -_HEX * bits // 64, _HEX * bits // 64)
    return prints.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")
