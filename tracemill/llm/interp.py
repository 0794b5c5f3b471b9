"""Language-model scoring by deleted interpolation (operator 7).

The model mixes maximum-likelihood estimates of word pairs, of words and of a uniform choice. The weights depend on
how often the pair's first word occurs, by buckets of that frequency. They are learned by expectation-maximisation on
counts of held-out documents, whose own counts are deleted from the estimates meanwhile; the final estimates use all
training documents.

No table of counts is broadcast. Documents are packed into blocks; each block asks for the counts of its distinct
words and pairs, dealt by hash into cells. A cell sums what all blocks counted and answers each block in the order it
asked, and the answers meet the block's texts again, where every token is scored.
"""

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.store import parts, stored

#: Folds of crc32(doc_id as text) mod 10: 0 is scored only, 1 gives the held-out counts, the rest the deleted estimates.
TEST, HELD, KEPT = 0, 1, 2
#: Context frequencies share a bucket by the power of two; the last bucket holds all above.
CONTEXTS = 24
#: Cells of the histogram that expectation-maximisation reads, per bucket and estimate: eighths of a power of two.
STEPS = 8
DEPTH = 40 * STEPS
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a text's end among its words; no UTF-8 text holds this byte.
_END = b"\xff"


def fold_of(doc_id: int | None) -> int:
    """crc32 of the decimal digits mod 10; a null doc_id counts as the text ``null``."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 10


class Lexicon(dict):
    """A number for each word met, and the 64-bit hashes of words by number; odd, as keys of pairs are even."""

    def __init__(self):
        self.hashes = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, 7) | 1)
        return number

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, pair key, document, whether the first) of every token: words, A-Z lower-cased, and an end after each text.

        A pair's first word is the token before; that of a text's first token is the end.
        """
        if len(self) > 150_000:
            self.clear()
            self.hashes = []
        words = b"".join(t + b" \xff " for t in texts).lower().split()
        token = np.array(self.hashes, dtype=np.uint64)[number] if len(number := np.array(list(map(self.__getitem__, words)), dtype=np.int64)) else np.zeros(0, np.uint64)
        end = number == self[_END]
        first = np.concatenate([[True], end[:-1]])[: len(end)]
        with np.errstate(over="ignore"):
            key = (np.roll(token, 1) * _PAIR) ^ (token * np.uint64(0xC2B2AE3D27D4EB4F))
            key = (key ^ (key >> np.uint64(31))) * _PAIR
        # 48 bits of a pair, at the top as in a word's hash
        return token, key & np.uint64(0xFFFF_FFFF_FFFF_0000), np.cumsum(end) - end, first


def _squeezed(values: np.ndarray, ordered: bool = False) -> bytes:
    """64-bit numbers, their bytes place by place, compressed; of ordered ones their differences."""
    values = values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)
    steps = np.diff(values, prepend=0) if ordered else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _restored(data: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return np.cumsum(values) if ordered else values


_ASK = "place string, cell int, block string, fold int, asked binary, counted binary, docs binary"
_ANSWER = "block string, fold int, cell int, kept binary, held binary, docs binary"


def _ask(cells: int, size: int):
    """Blocks of about ``size`` bytes of text, all of one kind of fold: what they ask of each cell, and their texts."""

    def emit(name: str, fold: int, ids: list, texts: list[bytes], words: Lexicon) -> Iterator[pa.RecordBatch]:
        token, pair, _, _ = words.read(texts)
        key, n = np.unique(np.concatenate([token, pair]), return_counts=True)
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
        cell = (key >> np.uint64(40)).astype(np.int64) * cells >> 24
        cut = np.searchsorted(cell, np.arange(cells + 1))
        rows = np.nonzero(np.diff(cut))[0].tolist()
        asked = [_squeezed(key[cut[c] : cut[c + 1]], ordered=True) for c in rows]
        counted = [_squeezed(n[cut[c] : cut[c + 1]]) if fold != TEST else None for c in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([name, *map(str, rows)]), pa.array([-1, *rows], pa.int32()), pa.array([name] * (len(rows) + 1)), pa.array([fold] * (len(rows) + 1), pa.int32()),
            pa.array([None, *asked], pa.binary()), pa.array([None, *counted], pa.binary()), pa.array([packed] + [None] * len(rows), pa.binary()),
        ], [c.split()[0] for c in _ASK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon()
        names = (f"{TaskContext.get().partitionId()}-{i}" for i in count())
        held = {fold: ([], [], 0) for fold in (TEST, HELD, KEPT)}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, raw = doc_id.as_py(), (text.as_py() or "").encode()
                fold = min(fold_of(doc_id), KEPT)
                ids, texts, have = held[fold]
                ids.append(doc_id)
                texts.append(raw)
                held[fold] = (ids, texts, have + len(raw) + 8)
                if held[fold][2] >= size:
                    yield from emit(next(names), fold, ids, texts, words)
                    held[fold] = ([], [], 0)
        for fold, (ids, texts, _) in held.items():
            if ids:
                yield from emit(next(names), fold, ids, texts, words)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, without a batch's worth of Python objects."""
    for batch in batches:
        names, columns = batch.schema.names, batch.columns
        for i in range(len(batch)):
            yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell, whose rows are together: counts in the kept and in the held-out training documents, for each block's keys.

    A cell's totals go under no block; a block's texts pass through.
    """

    def row(block, fold, cell, kept=None, held=None, docs=None) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((block, fold, cell, kept, held, docs), kinds, strict=True)], [c.split()[0] for c in _ANSWER.split(", ")])

    def closed(cell: int, rows: list[dict]):
        asked = [_restored(r["asked"], ordered=True).view(np.uint64) for r in rows]
        key, back = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.zeros((2, len(key)), dtype=np.int64)
        place = np.split(back, np.cumsum([len(x) for x in asked])[:-1])
        for r, mine in zip(rows, place, strict=True):
            if r["fold"] != TEST:
                sums[int(r["fold"] == HELD), mine] += _restored(r["counted"])
        for r, mine in zip(rows, place, strict=True):
            yield row(r["block"], r["fold"], cell, _squeezed(sums[0][mine]), _squeezed(sums[1][mine]))
        word = (key & np.uint64(1)) == 1
        totals = [sums[0][word].sum(), sums[1][word].sum(), (sums[0][word] > 0).sum(), (sums[:, word].sum(axis=0) > 0).sum()]
        yield row(None, None, cell, np.array(totals, dtype=np.int64).tobytes())

    cell, rows = None, []
    for r in _rows(batches):
        if r["docs"] is not None:
            yield row(r["block"], r["fold"], -1, docs=r["docs"])
            continue
        if rows and r["cell"] != cell:
            yield from closed(cell, rows)
            rows = []
        cell = r["cell"]
        rows.append(r)
    if rows:
        yield from closed(cell, rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(fold, doc_ids, token, context and pair counts in kept and in held-out documents, document of each token) of each block.

    A block's rows are together: its texts, and what the cells answered, by cell; so the answers are in order of the keys.
    """

    def closed(rows: list[dict], words: Lexicon):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(next(r["docs"] for r in rows if r["docs"] is not None))).read_all()
        token, pair, doc, first = words.read(table.column("text").to_pylist())
        _, place = np.unique(np.concatenate([token, pair]), return_inverse=True)
        own, pairs = place[: len(token)], place[len(token) :]
        # the token before, and before a text's first the end, which is the last token of all
        context = np.where(first, own[-1], np.roll(own, 1))
        answers = sorted(((r["cell"], r) for r in rows if r["docs"] is None), key=lambda x: x[0])
        counts = [np.concatenate([_restored(r[name]) for _, r in answers]) for name in ("kept", "held")]
        return rows[0]["fold"], table.column("doc_id"), [c[own] for c in counts], [c[context] for c in counts], [c[pairs] for c in counts], doc

    name, rows, words = None, [], Lexicon()
    for r in _rows(batches):
        if rows and r["block"] != name:
            yield closed(rows, words)
            rows = []
        name = r["block"]
        rows.append(r)
    if rows:
        yield closed(rows, words)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + (context > 0), CONTEXTS - 1)


def _estimates(token: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), token / max(n, 1)


def _level(p: np.ndarray) -> np.ndarray:
    """The histogram's step of a probability; 0 is none."""
    return np.where(p > 0, np.clip(np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), 0, DEPTH - 2) + 1, 0).astype(np.int64)


def learn(cells: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """Weights (bucket, [pair, word, uniform]) by expectation-maximisation on rows (bucket, pair step, word step, count).

    Buckets without held-out tokens, and the weights of pairs in the bucket of unseen contexts, follow the
    mean over all buckets.
    """
    value = lambda step: np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)
    bucket, weight = cells[:, 0], cells[:, 3].astype(np.float64)
    p = np.stack([value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), uniform)], axis=1)
    mix = np.full((CONTEXTS, 3), 1 / 3)
    total = np.bincount(bucket, weight, minlength=CONTEXTS)
    for _ in range(rounds):
        part = p * mix[bucket]
        part *= (weight / part.sum(axis=1))[:, None]
        got = np.stack([np.bincount(bucket, part[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        every = (got.sum(axis=0) + 1e-3) / (got.sum() + 3e-3)
        # a little of the mean keeps every weight above zero
        mix = (got + every) / (total + 1)[:, None]
    return mix


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, block_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The model learns from rows whose crc32(doc_id as text) mod 10 is not 0; a null doc_id is the text ``null``. Tokens
    are words, A-Z lower-cased, and one end. n_known counts tokens seen in training, base_score is the unigram
    log10 probability with 0.1 added to every count, score the model's log10 probability of the text. A null or empty
    text is its end alone. Repeated rows are counted and scored each; an empty table gives no rows. Without any training
    row all probability is uniform.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << max(8, int(size // 4_000_000).bit_length())
    asks = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ask(cells, block_bytes), _ASK)
    answers = stored(asks.repartition(n, "place").sortWithinPartitions("cell").mapInArrow(_answer, _ANSWER), "lm_answers")
    totals = np.array([np.frombuffer(r[0], dtype=np.int64) for r in answers.where("block is null").select("kept").collect()] or [[0] * 4]).sum(axis=0)
    kept, every, types_kept, types = int(totals[0]), int(totals[0] + totals[1]), int(totals[2]), int(totals[3])
    parcels = answers.where("block is not null")

    def together(fold=None) -> DataFrame:
        rows = parcels if fold is None else parcels.where(F.col("fold") == fold)
        return rows.repartition(n, "block").sortWithinPartitions("block")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, token, context, pair, _ in _blocks(batches):
            bigram, unigram = _estimates(token[0], context[0], pair[0], kept)
            code = (_bucket(context[0]) * DEPTH + _level(bigram)) * DEPTH + _level(unigram)
            code, times = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], ["code", "n"])

    held = together(HELD).mapInArrow(spread, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = [(r["code"] // DEPTH // DEPTH, r["code"] // DEPTH % DEPTH, r["code"] % DEPTH, r["n"]) for r in held.collect()]
    mix = learn(np.array(rows, dtype=np.int64).reshape(-1, 4), 1 / (types_kept + 1))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, ids, token, context, pair, doc in _blocks(batches):
            token, context, pair = token[0] + token[1], context[0] + context[1], pair[0] + pair[1]
            bigram, unigram = _estimates(token, context, pair, every)
            weights = mix[_bucket(context)]
            p = weights[:, 0] * bigram + weights[:, 1] * unigram + weights[:, 2] / (types + 1)
            # where an estimate has no counts, its weight goes to the others
            p /= 1 - weights[:, 0] * (context == 0) - weights[:, 1] * (every == 0)
            base = np.log10((token + 0.1) / (every + 0.1 * (types + 1)))
            each = lambda x=None: np.bincount(doc, x, minlength=len(ids))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                pa.chunked_array(ids).combine_chunks(), pa.array([fold == TEST] * len(ids)), pa.array(each().astype(np.int64)), pa.array(each(token > 0).astype(np.int64)),
                pa.array([every] * len(ids), pa.int64()), pa.array(each(base)), pa.array(each(np.log10(p))),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together().mapInArrow(final, _SCORE)
