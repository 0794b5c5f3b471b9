"""Embedding near-duplicates by spherical-cap filters (operator 2).

A filter is a direction from a structured random product code: after a random rotation a vector's coordinates fall
into two blocks, each block has its own random unit codewords, and every pair of codewords is one direction. Each
vector is list-decoded to all directions that it exceeds: codewords of the first block that cannot reach the
threshold with the best one of the second are cut off first. Near vectors exceed the same directions, so vectors meet
by filter and are verified by their cosine in double precision.

Exact copies collapse to one class first. Under a filter no pairs are written: a block of vectors yields, for each,
the number of its links (a link counts under the smallest filter that both have, so once in all) and the edges of a
spanning forest. Under a filter no task holds more than ``BLOCK`` vectors: where more meet they become numbered blocks,
and pairs of block numbers, joined with the blocks, are solved by tasks of their own. Filters that a sample shows to be
hot are salted before they meet. There are the more directions the larger the largest label is, so that buckets keep
their size.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracemill.llm.components import components
from tracemill.llm.simhash import block_pairs
from tracemill.llm.store import parts, small_batches, stored

BLOCK = 1024
#: Codes, codewords in a block of 32 dimensions or more at least, and the filters that a vector exceeds on average.
CODES, WORDS, EXPECTED = 6, 80, 25
#: One in so many vectors is looked at for hot filters; the hottest so many are salted. Others may be hot and still give
#: whole results: their blocks are then cut by one task.
SAMPLED, HOT = 16, 10_000
_ROW = "label long, filter int, salt int, id long, size long, filters binary, vector binary"


def words_for(largest: int) -> int:
    """Codewords in a block, so that of so many vectors about ``BLOCK`` at most exceed a direction on average."""
    return max(WORDS, ceil((largest * EXPECTED / (CODES * BLOCK)) ** 0.5))


@lru_cache(32)
def setting(dims: int, words: int = WORDS) -> tuple[int, float]:
    """Codewords in a block, and the threshold that ``EXPECTED`` of all directions' inner products with a unit vector reach."""
    count = max(4, min(words, words * dims // 64))
    share = min(0.5, EXPECTED / (CODES * count**2))
    return count, min(0.95, NormalDist().inv_cdf(1 - share) / dims**0.5)


@lru_cache(32)
def _code(dims: int, n: int, words: int) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]]]:
    """A rotation, and the slice and unit codewords of both blocks; the same on every machine."""
    rng, count = np.random.default_rng([dims, n]), setting(dims, words)[0]
    rotation, half, blocks = np.linalg.qr(rng.standard_normal((dims, dims)))[0], (dims + 1) // 2, []
    for part in (slice(0, half), slice(half, dims)):
        code = rng.standard_normal((count, max(part.stop - part.start, 1)))
        blocks.append((part, (code / np.linalg.norm(code, axis=1, keepdims=True))[:, : part.stop - part.start]))
    return rotation, blocks


def decode(vectors: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction whose inner product with a unit vector reaches the threshold.

    The nearest direction of each code always counts, so that no vector is without a filter.
    """
    rows, found, (count, threshold) = [], [], setting(vectors.shape[1], words)
    for n in range(CODES):
        rotation, blocks = _code(vectors.shape[1], n, words)
        turned = vectors @ rotation
        a, b = (turned[:, part] @ code.T / np.sqrt(2) for part, code in blocks)
        need = np.minimum(threshold, a.max(axis=1) + b.max(axis=1) - 1e-12)
        row, first = np.nonzero(a >= (need - b.max(axis=1))[:, None])
        at, second = np.nonzero(a[row, first][:, None] + b[row] >= need[row][:, None])
        rows.append(row[at])
        found.append(((n * count + first[at]) * count + second).astype(np.int32))
    return np.concatenate(rows), np.concatenate(found)


def _block(filter_: int, ids: np.ndarray, sizes: np.ndarray, filters: list[np.ndarray], vectors: np.ndarray, split: int, cosine: float) -> tuple:
    """Links added to each vector, and forest edges; split: rows from there on meet only those before (0: all meet)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if split:
        near[:split, :split] = near[split:, split:] = False
    begin, end, left = [], [], np.nonzero(near.any(axis=0))[0]
    if not len(left):
        return np.zeros(len(ids), dtype=np.int64), ids[:0], ids[:0]
    lower = [f[f < filter_] for f in filters]
    names, place = np.unique(np.concatenate(lower), return_inverse=True)
    has = np.zeros((len(ids), len(names)), dtype=np.float32)
    has[np.repeat(np.arange(len(ids)), [len(x) for x in lower]), place] = 1
    first = near & (has @ has.T == 0)
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = near[front[0], left]
            begin.append(np.repeat(front[0], hit.sum()))
            end.append(left[hit])
            front, left = np.concatenate([front[1:], left[hit]]), left[~hit]
    edge = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begin, end)]
    return first @ sizes, ids[edge[0]], ids[edge[1]]


def _result(ids=(), links=(), u=(), v=(), block=None) -> pa.RecordBatch:
    n, m, k = len(ids), len(u), int(block is not None)
    column = lambda a, b, c, kind: pa.array([*a, *b, *c], kind)
    no = lambda x: [None] * x
    last = lambda i: [block[i]] if block else []
    return pa.RecordBatch.from_pydict({
        "id": column(ids, no(m), no(k), pa.int64()), "links": column(links, no(m), no(k), pa.int64()),
        "u": column(no(n), u, no(k), pa.int64()), "v": column(no(n), v, no(k), pa.int64()),
        "label": column(no(n), no(m), last(0), pa.int64()), "filter": column(no(n), no(m), last(1), pa.int32()),
        "number": column(no(n), no(m), last(2), pa.int64()), "block": column(no(n), no(m), last(3), pa.binary()),
    })


_RESULT = "id long, links long, u long, v long, label long, filter int, number long, block binary"


def _solve(filter_: int, a: pa.Table, b: pa.Table | None, cosine: float) -> Iterator[pa.RecordBatch]:
    whole = pa.concat_tables([a, b]) if b is not None else a
    raw = [np.frombuffer(x, dtype=np.float64) for x in whole.column("vector").to_pylist()]
    length = np.array([len(x) for x in raw])
    for n in np.unique(length):
        rows = np.nonzero(length == n)[0]
        split = int((rows < len(a)).sum()) if b is not None else 0
        if len(rows) < 2 or b is not None and split in (0, len(rows)):
            continue
        part = whole.take(pa.array(rows))
        ids, sizes = part.column("id").to_numpy(), part.column("size").to_numpy()
        filters = [np.frombuffer(x, dtype=np.int32) for x in part.column("filters").to_pylist()]
        links, u, v = _block(filter_, ids, sizes, filters, np.stack([raw[i] for i in rows]), split, cosine)
        got = np.nonzero(links)[0]
        yield _result(ids[got], links[got], u, v)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine in double precision is at least
    ``cosine``; those of different lengths do not. Null, empty and zero vectors, and vectors with null, NaN or
    infinite components, link with nothing. Repeated rows are vectors of their own. n_links counts the linked rows;
    component_id is the smallest vec_id of the component; kept: it is this row's. An empty table gives no rows.
    """
    names = ("vec_id", "embedding", "label")
    embedding = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    # whole numbers stand for themselves, other labels are known by a hash
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select(F.col("vec_id").cast("long"), embedding.alias("embedding"), label.alias("label")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    same = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("a", F.when(F.col("fine"), F.xxhash64("label", same))).withColumn("b", F.when(F.col("fine"), F.xxhash64(F.lit(1), same, "label")))
    classes = rows.where("fine").groupBy("a", "b").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = stored(classes.withColumn("id", F.xxhash64("a", "b")), "classes")
    found = stored(_meetings(classes, cosine), "cap_links")
    degree = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "id")
    known = stored(classes.select("a", "b", "id", "first", "size").join(degree, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "classes")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("a", "b", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("fine").select(names[0], "a", "b").join(known, ["a", "b"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _deal(words: int, salts: dict[tuple[int, int], int]):
    """A row for each direction that a vector exceeds, with all its directions; salted where the direction is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                raw = [np.array(x, dtype=np.float64) for x in part.column("embedding").to_pylist()]
                length = np.array([len(x) for x in raw])
                for n in np.unique(length):
                    rows = np.nonzero(length == n)[0]
                    own = np.stack([raw[i] for i in rows])
                    own /= np.abs(own).max(axis=1, keepdims=True)
                    row, filter_ = decode(own / np.linalg.norm(own, axis=1, keepdims=True), words)
                    order = np.lexsort((filter_, row))
                    row, filter_ = row[order], filter_[order]
                    lists = [x.tobytes() for x in np.split(filter_, np.nonzero(np.diff(row))[0] + 1)]
                    take = pa.array(rows[row])
                    labels, ids = part.column("label").take(take), part.column("id").take(take)
                    salt = np.zeros(len(row), dtype=np.int32)
                    if salts:
                        share = np.array([salts.get(x, 0) for x in zip(labels.to_pylist(), filter_.tolist(), strict=True)], dtype=np.int64)
                        salt = np.where(share > 0, (ids.to_numpy() >> 20) % np.maximum(share, 1) + 1, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        labels, pa.array(filter_, pa.int32()), pa.array(salt), ids, part.column("size").take(take),
                        pa.array([lists[i] for i in row], pa.binary()), pa.array([own[i].tobytes() for i in row], pa.binary()),
                    ], ["label", "filter", "salt", "id", "size", "filters", "vector"])

    return run


def _meet(cosine: float):
    """Over rows in order of label, filter and salt: what vectors that meet link, or blocks of a filter that many or salted ones exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, number = None, [], 0, 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, number
            if rows > BLOCK or last and rows:
                whole = pa.concat_tables(held)
                at = 0
                while len(whole) - at > BLOCK or last and at < len(whole):
                    yield _result(block=(now[0], now[1], (now[2] << 32) + number, _packed(whole.slice(at, BLOCK).combine_chunks())))
                    at, number = at + BLOCK, number + 1
                held = [whole.slice(at).combine_chunks()] if at < len(whole) else []
                rows = max(len(whole) - at, 0)

        def closed() -> Iterator[pa.RecordBatch]:
            if number or now[2]:
                yield from cut(True)
            elif rows > 1:
                yield from _solve(now[1], pa.concat_tables(held), None, cosine)

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            rest = pa.Table.from_batches([batch]).select(["id", "size", "filters", "vector"])
            begins = np.concatenate([[0], np.nonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))[0] + 1])
            for b, e in zip(begins, np.append(begins[1:], len(batch)), strict=True):
                own = tuple(int(k[b]) for k in keys)
                if own != now:
                    if now is not None:
                        yield from closed()
                    now, held, rows, number = own, [], 0, 0
                held.append(rest.slice(b, e - b))
                rows += e - b
                yield from cut(False)
        if now is not None:
            yield from closed()

    return run


def hot_filters(classes: DataFrame, words: int) -> dict[tuple[int, int], int]:
    """How many salts each of the hottest filters of a label gets: about one for every four blocks that a sample lets expect."""
    some = classes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("id", "size", "embedding", "label").mapInArrow(_deal(words, {}), _ROW)
    most = some.groupBy("label", "filter").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > 4 * BLOCK).orderBy(F.desc("n"), "label", "filter").limit(HOT)
    return {(r["label"], r["filter"]): -(-r["n"] * SAMPLED // (4 * BLOCK)) for r in most.collect()}


def _meetings(classes: DataFrame, cosine: float) -> DataFrame:
    """Counts of links by id, and forest edges (u, v), of classes (id, size, embedding, label)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for filter_, a, b in zip(*(batch.column(c) for c in ("filter", "block_a", "block_b")), strict=True):
                yield from _solve(filter_.as_py(), _opened(a.as_py()), _opened(b.as_py()) if b.is_valid else None, cosine)

    n = parts(classes.sparkSession)
    words = words_for(classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    dealt = classes.select("id", "size", "embedding", "label").mapInArrow(_deal(words, hot_filters(classes, words)), _ROW)
    order = ["label", "filter", "salt"]
    met = stored(dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(_meet(cosine), _RESULT), "cap_met")
    blocks = met.where("block is not null").select("label", "filter", "number", "block")
    found = met.where("block is null").select("id", "links", "u", "v")
    if not blocks.isEmpty():
        with small_batches(classes.sparkSession, 4):
            pairs = block_pairs(blocks, ["label", "filter"]).repartition(n, "label", "filter", "number", "other")
            found = found.unionByName(stored(pairs.mapInArrow(solve, _RESULT), "cap_met").select("id", "links", "u", "v"))
    return found.groupBy("id", "u", "v").agg(F.sum("links").alias("links"))
