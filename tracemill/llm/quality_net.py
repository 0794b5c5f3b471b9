"""Quality classifier on random-indexing word vectors (operator 4).

Every word bucket has a sparse random index vector; its context vector is the sum of the index vectors of the words
around it, over all documents. A document pools its words' context vectors by mean, deviation, and the mean products
of words one and two places apart. A two-layer network learns the label from those, and a temperature fitted on rows set aside calibrates
its probabilities.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.pretoken import portions
from tracemill.llm.store import parts, stored

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 15, 32, 4, 2
#: Context vectors travel in slabs of so many buckets.
SLAB = 256
#: At most so many labelled rows, the first by a hash, fit the network.
SAMPLE = 20_000
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+")


def fold_of(doc_id: int | None) -> int:
    """crc32 of the decimal digits mod 5; a null doc_id counts as the text ``null``."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 5


def buckets_of(text: str, known: dict[str, int]) -> np.ndarray:
    """Bucket of each run of letters, of digits and of other signs. ``known`` keeps those met before, while few enough."""
    words = _TOKEN.findall(text)
    try:
        return np.array([known[w] for w in words], dtype=np.int64)
    except KeyError:
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode()) % BUCKETS
        return np.array([known[w] for w in words], dtype=np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's random index vector; the same on every machine."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(docs: list[np.ndarray], places: np.ndarray, signs: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into`` (flat, buckets by dimensions) the index vectors of all words up to ``WINDOW`` places away."""
    gap = np.full(WINDOW, -1, dtype=np.int64)
    flat = np.concatenate([x for d in docs for x in (d, gap)])
    for step in range(1, WINDOW + 1):
        a, b = flat[:-step], flat[step:]
        fine = (a >= 0) & (b >= 0)
        a, b = a[fine], b[fine]
        for word, other in ((a, b), (b, a)):
            for k in range(NONZERO):
                into += np.bincount(word * DIMS + places[other, k], signs[other, k], minlength=len(into))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, learned from every row of ``docs``: ``BUCKETS * DIMS`` numbers, whatever the rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        known, into = {}, np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for part in portions([x or "" for x in batch.column(0).to_pylist()], 3_000_000):
                context_sums([buckets_of(t, known) for t in part], places, signs, into)
        slabs = into.astype(np.float32).reshape(-1, SLAB * DIMS)
        some = np.nonzero(slabs.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slabs[i].tobytes() for i in some], pa.binary())], ["slab", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, total = None, None
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != slab:
                    if slab is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slab", "sums"])
                    slab, total = at, np.zeros(SLAB * DIMS)
                total += np.frombuffer(sums.as_py(), dtype=np.float32)
        if slab is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slab", "sums"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(gather, "slab int, sums binary")
    sums = sums.repartition(parts(docs.sparkSession), "slab").sortWithinPartitions("slab").mapInArrow(add, "slab int, sums binary")
    out = np.zeros((BUCKETS // SLAB, SLAB * DIMS))
    for row in sums.collect():
        out[row["slab"]] = np.frombuffer(row["sums"], dtype=np.float64)
    out = out.reshape(BUCKETS, DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features array<float>) per row: mean and deviation of the words' vectors, and mean products at one and two places; zeros without words."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            out = np.zeros((len(batch), 4 * DIMS), dtype=np.float32)
            for i, text in enumerate(batch.column(1)):
                own = buckets_of(text.as_py() or "", known)
                if len(own):
                    rows = held.value[own]
                    out[i, :DIMS], out[i, DIMS : 2 * DIMS] = rows.mean(axis=0), rows.std(axis=0)
                    for step in range(1, min(len(own), 3)):
                        out[i, (1 + step) * DIMS : (2 + step) * DIMS] = (rows[step:] * rows[:-step]).mean(axis=0)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * 4 * DIMS), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, features array<float>")


class Network:
    """Two layers, trained by Adam on the mean cross-entropy, with a temperature fitted on a fifth that is set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self._scaled(x)
        aside = np.arange(len(x)) % 5 == 4
        a, b = x[~aside], y[~aside].astype(np.float64)
        w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for at in range(0, len(a), 128):
                part = order[at : at + 128]
                h = np.maximum(a[part] @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - b[part]) / len(part)
                back = np.outer(d, w[2]) * (h > 0)
                step += 1
                for i, g in enumerate((a[part].T @ back + 1e-3 * w[0], back.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if aside.any():
            z, t = self._logit(x[aside]), y[aside]
            loss = lambda k: np.logaddexp(0, np.where(t == 1, -z, z) / k).mean()
            self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) / self.scale

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -500, 500)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Vectors are learned from all texts; the network from rows of ``labels`` (doc_id, quality 0 or 1) whose
    crc32(doc_id as text) mod 5 is not 0, at most ``SAMPLE`` of them, the first by a hash. Other columns are never
    read. A null or empty text has zero features and is scored like any other; repeated rows are scored alike; an empty
    table gives no rows. Without labels of both kinds, all scores are the share of label 1, or a half.
    """
    features = stored(pooled(docs, word_vectors(docs)), "features")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(5))
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(fold != 0)
    # rows by a hash below the share that gives so many; a little less, and the limit only guards the bound
    part = min(1.0, 0.95 * SAMPLE / max(1, marked.count()))
    some = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * part))
    rows = features.join(some, "doc_id").limit(SAMPLE).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    y = rows["quality"].to_numpy()
    share = float(y.mean()) if len(y) else 0.5
    network = Network(np.stack(rows["features"].to_list()), y) if len(set(y)) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = network(np.array(batch.column("features").to_pylist(), dtype=np.float64)) if network else np.full(len(batch), share)
            held = [fold_of(x) == 0 for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
