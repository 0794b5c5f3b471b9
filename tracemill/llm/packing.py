"""Best-fit packing of documents into token sequences by exact-complement hashing (operator 9).

Only the lengths of pieces decide a packing, and there are no more lengths than tokens in a sequence. So Spark counts
pieces by length, a plan is made over those counts, and each piece finds its place by its rank within its length.
"""

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.pretoken import Words, portions
from tracemill.llm.store import stored

_TOKENIZERS: dict = {}
#: Pieces of one length are ranked in groups of about so many, so that a common length isn't one task's.
GROUP = 10_000


def _tokenizer(path: str):
    """The ``tokenizers`` library's tokenizer of a file, which each Python worker reads once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class Tokens:
    """Token ids of texts as the library's ``encode`` with add_special_tokens=False gives them.

    A text without any of the tokenizer's added tokens is cut into pre-tokens, of which each distinct one is encoded
    once. A text that holds the string of one, such as ``<|endoftext|>``, which the library takes out before it cuts,
    goes to the library whole.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.words = Words(lambda words: [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)])

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        ids, bounds = self.words.tokens(["" if i in whole else t for i, t in enumerate(texts)])
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield whole[i] if i in whole else ids[a:b]


def spans(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``most`` after one that may be shorter."""
    first = length % most or most
    return [(0, min(first, length)), *((at, most) for at in range(first, length, most))]


def pieces(docs: DataFrame, path: str, most: int, end: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's tokens by the tokenizer file at ``path``, then ``end``.

    A null or empty text is the one token ``end``. Only documents of more than ``most`` tokens are cut.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            row = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                rows, columns = [], [[] for _ in kinds]
                for ids in tokens(part):
                    own = np.append(ids, end).astype("<u4")
                    for n, (start, length) in enumerate(spans(len(own), most)):
                        now = own[start : start + length]
                        rows.append(row)
                        for column, x in zip(columns, (n, start, length, zlib.crc32(now.tobytes()), now.astype(np.int32)), strict=False):
                            column.append(x)
                    row += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Sums:
    """Index of the sums of one, two and three lengths, by sum; ``have`` counts the pieces of each length.

    Pairs lie under their sum by the longer length downwards; a triple lies under its sum as its longest length and the
    sum of the other two. The index has at most ``most`` times ``most`` entries of each kind, whatever the pieces.
    """

    def __init__(self, have: np.ndarray):
        self.have, most = have, len(have) - 1
        there = np.nonzero(have[:most])[0]
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, np.ndarray] = {}
        for total in range(2, most):
            x = there[(2 * there >= total) & (there < total)][::-1]
            if len(x := x[have[total - x] > 0]):
                self.pairs[total] = x
        paired = np.zeros(most + 1, dtype=bool)
        paired[list(self.pairs)] = True
        for total in range(3, most):
            x = there[(3 * there >= total) & (there < total - 1)][::-1]
            if len(x := x[paired[total - x]]):
                self.triples[total] = x

    def _pair(self, total: int) -> tuple[int, ...]:
        x = self.pairs.get(total)
        if x is None:
            return ()
        fit = (self.have[x] > 0) & (self.have[total - x] > 0) & ((2 * x != total) | (self.have[x] > 1))
        at = int(fit.argmax())
        if not fit[at]:
            if not (self.have[x] > 0).any():
                del self.pairs[total]
            return ()
        return int(x[at]), total - int(x[at])

    def complement(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that are there and sum to ``gap``, the longest first; none without."""
        if self.have[gap]:
            return (gap,)
        if found := self._pair(gap):
            return found
        for x in self.triples.get(gap, ()):
            if self.have[x]:
                self.have[x] -= 1
                rest = self._pair(gap - int(x))
                self.have[x] += 1
                if rest:
                    return (int(x), *rest)
        return ()


def plan(counts: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): sequences that use up ``counts`` of pieces by length.

    From the longest length on, the gap beside it is filled exactly by one, two or three available lengths whose
    sum it is (``Sums``), as often as all of them are there. What finds no exact complement goes, longest first, to the
    open sequence that it leaves the smallest gap in. Open sequences alike are kept together with their number.
    """
    have, out = np.zeros(most + 1, dtype=np.int64), []
    for length, n in counts.items():
        have[length] += n
    if have[most]:
        out.append(((most,), int(have[most])))
        have[most] = 0
    sums, left = Sums(have), {}
    for length in range(most - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            fill = sums.complement(most - length)
            have[length] += 1
            if not fill:
                left[length] = int(have[length])
                have[length] = 0
                break
            use = defaultdict(int)
            for x in (length, *fill):
                use[x] += 1
            times = int(min(have[x] // n for x, n in use.items()))
            for x, n in use.items():
                have[x] -= n * times
            out.append(((length, *fill), times))
    opened: dict[int, list] = defaultdict(list)  # by gap: lengths and how many sequences
    for length, n in left.items():
        while n:
            gap = min((g for g, rows in opened.items() if g >= length and rows), default=None)
            if gap is None:
                opened[most - length].append([(length,), n])
                break
            lengths, there = opened[gap].pop()
            times = min(n, there)
            if there > times:
                opened[gap].append([lengths, there - times])
            opened[gap - length].append([(*lengths, length), times])
            n -= times
    return out + [(lengths, n) for rows in opened.values() for lengths, n in rows]


def places(recipes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): where pieces of a length go, by rank from 0."""
    used, rows, sequence = defaultdict(int), [], 0
    for lengths, times in recipes:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def place(cut: DataFrame, most: int) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset; at most ``most`` tokens in a sequence.

    What reaches the driver is one number for each length. The plan's places, which are broadcast, depend on ``most``
    and not on the rows: at most one step for each length and entry of its sums. Pieces of a length are ranked
    in groups of about ``GROUP``; of the groups' sizes, one row for so many pieces, the join's way is Spark's choice.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    to = spark.createDataFrame(places(plan(counts, most)), "at_length long, lo long, hi long, sequence long, offset long")
    salts = spark.createDataFrame([(length, -(-n // GROUP)) for length, n in counts.items()], "l long, salts long")
    salted = cut.join(F.broadcast(salts), F.col("length") == F.col("l")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("l", "salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(sizes, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("before") + F.col("own"))
    found = ranked.join(F.broadcast(to), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select(*cut.columns, (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str, most: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Every row's pieces with sequence_id and offset: all documents in as few sequences of ``most`` tokens as found.

    A document is its ids by the tokenizer file at ``path``, as ``Tokens`` gives them, and then ``end``; null and empty
    texts are that one token. Offsets within a sequence are gapless from 0. Repeated rows are packed each; an empty table gives no rows.
    with_ids: each piece also carries its ids, see ``sequences``.
    """
    return place(stored(pieces(docs, path, most, end, with_ids), "pieces"), most)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, of pieces with ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))
