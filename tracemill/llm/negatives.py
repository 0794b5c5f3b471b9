"""Hard-negative mining (operator 13).

All vectors get one more component that brings them to one norm, so that inner products bound distances. They are dealt to
cells: the label's bucket and the nearest of some pivots, whose covering radii are the tree's upper levels. A cell's rows
lie in blocks of bounded size, each with cover trees built in a task: nested nets with the covering radius of every node.
An anchor visits the blocks that its cells leave open, descends level by level through nodes whose bounds reach its window,
and takes the leaves best first, with exact inner products, until none can better what it has.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.store import parts, small_batches, stored

#: Buckets of labels, pivots at most, rows that a block has on average, anchors that travel together, rows of a leaf, rows of the pivots' sample.
BUCKETS, PIVOTS, BLOCK, GROUP, LEAF, SAMPLE = 32, 128, 2048, 512, 24, 4096
_DEALT = "vec_id long, label string, bucket int, pivot int, distance double, vector binary"


def _augmented(x: np.ndarray, norm2: float) -> np.ndarray:
    """Rows with a component that makes every squared norm ``norm2``."""
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def _stacked(column: pa.Array) -> np.ndarray:
    """Packed vectors as rows; shorter ones are padded by zeros."""
    raw = [np.frombuffer(x, dtype="<f8") for x in column.to_pylist()]
    out = np.zeros((len(raw), max(map(len, raw), default=0)))
    for row, x in zip(out, raw, strict=True):
        row[: len(x)] = x
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def net(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The farthest-first order of up to ``most`` rows, each one's distance to those before it, and every row's nearest.

    The rows whose distance is at least half the radius, a quarter, and so on are nets of each other: a cover tree's levels.
    """
    order, gaps, near = [0], [np.inf], np.zeros(len(x), dtype=np.int64)
    gap = np.linalg.norm(x - x[0], axis=1)
    while len(order) < min(most, len(x)):
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
        own = np.linalg.norm(x - x[at], axis=1)
        closer = own < gap
        near[closer] = len(order)
        order.append(at)
        gaps.append(float(gap[at]))
        gap = np.minimum(gap, own)
    return np.array(order), np.array(gaps), near


def tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """An order of rows, and levels of (row of the centre, covering radius, first child with the end); the last level's children are rows.

    x: augmented vectors. Each node of a level holds its own centre again on the next one.
    """
    order, gaps, near = net(x, -(-len(x) // LEAF))
    levels, size = [1], gaps[1] if len(gaps) > 1 else 0.0
    while levels[-1] < len(order):
        size /= 2
        levels.append(max(int((gaps >= size).sum()), levels[-1]))
    levels = sorted(set(levels))
    # the node of every row on each level, from the leaves up: a centre that the level above lacks goes to its nearest there
    place = [near]
    for low in levels[-2::-1]:
        high = levels[levels.index(low) + 1]
        up = np.arange(high)
        some = order[low:high]
        up[low:] = np.linalg.norm(x[some][:, None, :] - x[order[:low]][None, :, :], axis=2).argmin(axis=1) if high * low * x.shape[1] < 1 << 24 else [int(np.linalg.norm(x[order[:low]] - x[i], axis=1).argmin()) for i in some]
        place.append(up[place[-1]])
    place = place[::-1]
    rows = np.lexsort(place[::-1])
    out = []
    for i, own in enumerate(place):
        own = own[rows]
        first = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
        centre = order[own[first]]
        ends = np.append(first[1:], len(rows))
        radius = np.array([np.linalg.norm(x[rows[a:b]] - x[c], axis=1).max() for a, b, c in zip(first, ends, centre, strict=True)])
        out.append((centre, radius, np.append(first, len(rows))))
    # children as places on the next level instead of rows
    for i in range(len(out) - 1):
        out[i] = (out[i][0], out[i][1], np.searchsorted(out[i + 1][2], out[i][2]))
    return rows, out


class Block:
    """Rows of a block with a cover tree for each label, ready to be asked."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm2: float):
        self.ids, self.labels, self.x, self.trees = ids, labels, x, []
        wide = _augmented(x, norm2)
        for label in np.unique(labels):
            own = np.nonzero(labels == label)[0]
            rows, levels = tree(wide[own])
            self.trees.append((label, own[rows], [(own[centre], radius, bounds) for centre, radius, bounds in levels]))

    def leaves(self, q: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Pairs of an anchor and a leaf that its window reaches: the anchor, the leaf, and the leaves' rows."""
        reach, anchor, leaf, rows, count = np.linalg.norm(q, axis=1), [], [], [], 0
        for label, order, levels in self.trees:
            a = np.nonzero((labels == label) == same)[0]
            node = np.zeros(len(a), dtype=np.int64)
            for depth, (centre, radius, bounds) in enumerate(levels):
                if depth:
                    width = last[node + 1] - last[node]
                    a, node = np.repeat(a, width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(last[node], width)
                if not len(a):
                    break
                some, place = np.unique(a, return_inverse=True)
                middle = (q[some] @ self.x[centre].T)[place, node]
                slack = reach[a] * radius[node] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
                fit = (middle + slack >= low[a]) & (middle - slack <= high[a])
                a, node, last = a[fit], node[fit], bounds
                best = (middle + slack)[fit]
            if len(a):
                anchor.append(np.stack([a, node + count, best]))
            rows += [order[b:e] for b, e in zip(levels[-1][2][:-1], levels[-1][2][1:], strict=True)]
            count = len(rows)
        whole = np.concatenate(anchor, axis=1) if anchor else np.zeros((3, 0))
        best = whole[2]
        a, leaf = whole[0].astype(np.int64), whole[1].astype(np.int64)
        rank = np.lexsort((-best, a))
        return a[rank], leaf[rank], best[rank], rows

    def ask(self, q: np.ndarray, anchors: np.ndarray, labels: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, score) of the k best rows of each window (anchor's number in ``window``, low <= score <= high).

        Rows have the anchor's label if ``same``, another one else, and never its vec_id. Equal scores go by vec_id.
        """
        widest = np.full(len(q), np.inf), np.full(len(q), -np.inf)
        np.minimum.at(widest[0], window, low)
        np.maximum.at(widest[1], window, high)
        a, leaf, best, rows = self.leaves(q, labels, same, *widest)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        floor = low.copy()
        order = np.argsort(window, kind="stable")
        begin = np.searchsorted(window[order], np.arange(len(q) + 1))
        wave, done = 1, np.searchsorted(a, np.arange(len(q) + 1))[:-1]
        stop = np.searchsorted(a, np.arange(len(q) + 1))[1:]
        while True:
            # the next leaves of each anchor, best first, that can still better one of its windows
            need = np.full(len(q), np.inf)
            np.minimum.at(need, window, floor)
            more = np.minimum(stop - done, wave)
            take = np.repeat(done, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            done = done + more
            if not len(take):
                break
            take = take[best[take] >= need[a[take]]]
            by_leaf = take[np.argsort(leaf[take], kind="stable")]
            new = []
            edges = np.nonzero(np.diff(leaf[by_leaf]))[0] + 1
            for some in np.split(by_leaf, edges) if len(by_leaf) else []:
                own, members = a[some], rows[leaf[some[0]]]
                score = q[own] @ self.x[members].T
                i, j = np.nonzero(score >= need[own][:, None])
                if not len(i):
                    continue
                score, i, j = score[i, j], own[i], members[j]
                other = self.ids[j] != anchors[i]
                score, i, j = score[other], i[other], j[other]
                width = begin[i + 1] - begin[i]
                w = order[np.repeat(begin[i], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
                score, j = np.repeat(score, width), np.repeat(j, width)
                fit = (score >= floor[w]) & (score <= high[w])
                new.append((w[fit], j[fit], score[fit]))
            if new:
                w, j, score = (np.concatenate([h, *(n[c] for n in new)]) for c, h in enumerate(held))
                rank = np.lexsort((self.ids[j], -score, w))
                w, j, score = w[rank], j[rank], score[rank]
                place = np.arange(len(w)) - np.searchsorted(w, w)
                full = place == k - 1
                floor[w[full]] = np.maximum(floor[w[full]], score[full])
                held = [w[place < k], j[place < k], score[place < k]]
            wave *= 2
        return tuple(held)


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays of any shapes in one value."""
    sink = pa.BufferOutputStream()
    fields = [pa.field(n, pa.binary(), metadata={"of": f"{a.dtype.str}|{','.join(map(str, a.shape))}"}) for n, a in arrays.items()]
    with pa.ipc.new_stream(sink, pa.schema(fields)) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays.values()], schema=pa.schema(fields)))
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    out = {}
    for field in table.schema:
        kind, shape = field.metadata[b"of"].decode().split("|")
        data = table.column(field.name)[0].as_py()
        out[field.name] = (np.frombuffer(data, dtype=kind) if data else np.zeros(0, kind)).reshape([int(n) for n in shape.split(",")])
    return out


def _strings(values: list[str]) -> np.ndarray:
    return np.array(values, dtype=object).astype("U") if values else np.zeros(0, "U1")


def _deal(pivots: np.ndarray, norm2: float):
    """The nearest pivot of each row, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                wide = _augmented(_wide(_stacked(part.column("vector")), pivots.shape[1] - 1), norm2)
                distance = np.sqrt(np.maximum(2 * norm2 - 2 * wide @ pivots.T, 0))
                nearest = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id"), part.column("label"), part.column("bucket"), pa.array(nearest.astype(np.int32)),
                    pa.array(np.linalg.norm(wide - pivots[nearest], axis=1)), part.column("vector"),
                ], ["vec_id", "label", "bucket", "pivot", "distance", "vector"])

    return run


class Forest:
    """Vectors (vec_id, label, vector) in blocks, and the balls of their cells; ``rows`` holds them dealt.

    Pivots are found on at most SAMPLE rows; all rows are indexed. Driver: the sample, and a row for each of the
    BUCKETS * PIVOTS cells at most.
    """

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        self.spark, self.n = spark, parts(spark)
        vectors = vectors.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
        size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        count, norm2, self.width, buckets = vectors.agg(F.count("*"), F.max(size), F.max(F.size("vector")), F.count_distinct("bucket")).first()
        self.count, self.norm2, self.width = count, (norm2 or 0.0) * (1 + 1e-9), self.width or 0
        packed = vectors.select("vec_id", "label", "bucket", "vector").mapInArrow(_pack, "vec_id long, label string, bucket int, vector binary")
        sample = [r["vector"] for r in packed.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(SAMPLE).select("vector").collect()]
        wide = _augmented(_wide(_stacked(pa.array(sample, pa.binary())), self.width), self.norm2) if sample else np.zeros((1, self.width + 1))
        self.pivots = wide[net(wide, int(np.clip(count // (2 * BLOCK * max(buckets, 1)), 1, PIVOTS)))[0]]
        self.rows = stored(packed.mapInArrow(_deal(self.pivots, self.norm2), _DEALT), "dealt_vectors")
        cells, first = [], 0
        for r in self.rows.groupBy("bucket", "pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).orderBy("bucket", "pivot").collect():
            blocks = -(-r["n"] // BLOCK)
            cells.append((r["bucket"], r["pivot"], r["radius"], first, blocks))
            first += blocks
        self.cells = cells
        known = spark.createDataFrame([(b, p, f, n) for b, p, _, f, n in cells], "bucket int, pivot int, first long, blocks long")
        placed = self.rows.join(F.broadcast(known), ["bucket", "pivot"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        norm2, width = self.norm2, self.width

        def build(table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").to_numpy()
            data = _packed(ids=ids, labels=_strings(table.column("label").to_pylist()), x=_wide(_stacked(table.column("vector").combine_chunks()), width), norm2=np.array([norm2]))
            return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

        self.blocks = stored(placed.select("block", "vec_id", "label", "vector").repartition(self.n, "block").groupBy("block").applyInArrow(build, "block long, data binary"), "vector_blocks")

    def best(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, window, vec_id, score): the k best rows, score descending then vec_id, of each window.

        asks: (anchor_id, label, bucket, vector, windows array<struct<window long, low double, high double>>), a row an anchor.
        """
        cells, pivots, norm2, width = self.cells, self.pivots, self.norm2, self.width
        bucket, pivot, radius = (np.array([c[i] for c in cells]) for i in range(3))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Anchors in groups, to each block of every cell that one of their windows may reach."""
            for batch in batches:
                for at in range(0, len(batch), GROUP):
                    part = batch.slice(at, GROUP)
                    q, own = _wide(_stacked(part.column("vector")), width), part.column("bucket").to_numpy()
                    ids, labels = part.column("anchor_id").to_numpy(), _strings(part.column("label").to_pylist())
                    windows = part.column("windows")
                    count = np.diff(windows.offsets.to_numpy())
                    flat = windows.flatten()
                    of = np.repeat(np.arange(len(part)), count)
                    number, low, high = (flat.field(i).to_numpy() for i in range(3))
                    middle, slack = q @ pivots[:, :-1].T, np.linalg.norm(q, axis=1)
                    for b, p, r, first, blocks in zip(bucket, pivot, radius, (c[3] for c in cells), (c[4] for c in cells), strict=True):
                        reach = slack * r * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle[:, p]))
                        fit = (middle[of, p] + reach[of] >= low) & (middle[of, p] - reach[of] <= high)
                        if same:
                            fit &= own[of] == b
                        if not fit.any():
                            continue
                        some, place = np.unique(of[fit], return_inverse=True)
                        data = _packed(q=q[some], ids=ids[some], labels=labels[some], of=place, number=number[fit], low=low[fit], high=high[fit])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + blocks)), pa.array([data] * blocks, pa.binary())], ["block", "data"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Over rows in order of block, the block's own before those that ask it."""
            now, held = None, None
            for batch in batches:
                for block, asked, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    data = _opened(data.as_py())
                    if not asked:
                        now, held = block, data
                        continue
                    if block != now:
                        raise ValueError(f"block {block} is asked, but isn't there")
                    if isinstance(held, dict):
                        held = Block(held["ids"], held["labels"], held["x"], float(held["norm2"][0]))
                    w, row, score = held.ask(data["q"], data["ids"], data["labels"], data["of"], data["low"], data["high"], k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(data["ids"][data["of"][w]]), pa.array(data["number"][w]), pa.array(held.ids[row]), pa.array(score)], ["anchor_id", "window", "vec_id", "score"])

        with small_batches(self.spark, 8):
            sent = asks.select("anchor_id", "label", "bucket", "vector", "windows").mapInArrow(send, "block long, data binary")
            both = self.blocks.select("block", F.lit(False).alias("asked"), "data").unionByName(sent.select("block", F.lit(True).alias("asked"), "data"))
            met = both.repartition(self.n, "block").sortWithinPartitions("block", "asked").mapInArrow(meet, "anchor_id long, window long, vec_id long, score double")
            met = stored(met, "vectors_met")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(x, dtype="<f8").tobytes() for x in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], ["vec_id", "label", "bucket", "vector"])


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    anchor: which rows are anchors, a condition on vec_id. A row's score is its inner product with the anchor; higher ones
    come first, ties by smaller vec_id. An anchor's positives are its first rows of the same label; for each of
    them the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned.
    Components are whole numbers: scores are exact below 2^53, beyond that doubles, cut to 64 bits. Rows with a null
    vec_id, label, vector or component, or one that isn't finite, take no part; of rows with one vec_id the one with the
    smallest label, then vector, does. Shorter vectors count as filled up by zeros. An empty table gives no rows.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", F.col("r.embedding").alias("vector"))
    forest = Forest(stored(rows, "whole_vectors"))
    window = lambda number, a, b: F.struct(number.cast("long").alias("window"), a.cast("double").alias("low"), b.cast("double").alias("high"))
    asks = forest.rows.where(anchor).withColumnRenamed("vec_id", "anchor_id").drop("pivot", "distance")
    first = stored(forest.best(asks.withColumn("windows", F.array(window(F.lit(0), F.lit(float("-inf")), F.lit(float("inf"))))), positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    some = first.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window(F.col("positive_id"), F.col("positive_score") * low / 100, F.col("positive_score") * high / 100)).alias("windows"))
    found = forest.best(asks.join(some, "anchor_id"), negatives, False)
    out = found.withColumnRenamed("window", "positive_id").join(first, ["anchor_id", "positive_id"])
    whole = lambda score: F.least(F.greatest(F.col(score), F.lit(-9.223372036854775e18)), F.lit(9.223372036854774e18)).cast("long")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), whole("positive_score").alias("positive_score"), whole("score").alias("negative_score"))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): components scaled by 256 and rounded down, labels of every seventh vec_id moved on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # doubles from 2^53 on are whole numbers already
    embedding = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x * 256) < F.lit(2.0**53), F.floor(x * 256).cast("double")).otherwise(x * 256))
    return vectors.select("vec_id", label.alias("label"), embedding.alias("embedding"))
