"""Byte-level BPE encoding and decoding (operator 3).

Distinct pre-tokens are encoded together: bucketed by length into padded numpy matrices with a row each. In every
round every row merges its leftmost pair of minimum rank, found by a hash table of pairs, and the columns after it
move up. Rows without a pair leave the matrix.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.pretoken import Words, portions

_NONE = np.int32(1 << 30)
#: Rows of more bytes are merged by themselves, all pairs of one rank in a round.
LONG = 2048
_ENCODERS: dict[str, "Bpe"] = {}


class Pairs:
    """Merged ranks of adjacent pairs of ranks in an open-addressed hash table, and rows merged by it."""

    def __init__(self, ranks: dict):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.bits = max(len(merged) * 4, 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        pair, rank = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64), np.array(merged, dtype=np.int32)
        slot = self._slot(pair)
        while len(pair):
            free = self.keys[slot] == -1
            _, one = np.unique(slot[free], return_index=True)
            taken = np.nonzero(free)[0][one]
            self.keys[slot[taken]], self.ranks[slot[taken]] = pair[taken], rank[taken]
            rest = np.ones(len(pair), dtype=bool)
            rest[taken] = False
            pair, rank, slot = pair[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a large number where it doesn't merge (-1 on either side pads)."""
        pair = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(pair.shape, _NONE, dtype=np.int32)
        flat, result = pair.ravel(), out.ravel()
        todo = np.nonzero((left.ravel() >= 0) & (right.ravel() >= 0))[0]
        slot = self._slot(flat[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == flat[todo]
            result[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return result.reshape(pair.shape)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row, merged till nothing merges.

        All pairs of minimum rank are merged in one round, from the left. That is what merging them one by one gives, unless a
        pair that a merge makes has a smaller rank still: then the leftmost is merged alone.
        """
        ranks = self.lookup(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.nonzero(ranks == best)[0]
            if len(at) > 1:
                # of pairs that overlap in a run, every other one
                first = np.concatenate([[True], np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.nonzero(first)[0][np.cumsum(first) - 1]) % 2 == 0]
            while True:
                keep = np.ones(len(ids), dtype=bool)
                keep[at + 1] = False
                new = ids.copy()
                new[at] = best
                new, kept = new[keep], ranks[keep[1:]]
                place = at - np.arange(len(at))
                before, after = place[place > 0] - 1, place[place < len(new) - 1]
                left, right = self.lookup(new[before], new[before + 1]), self.lookup(new[after], new[after + 1])
                if len(at) == 1 or min(left.min(initial=_NONE), right.min(initial=_NONE)) > best:
                    break
                at = at[:1]
            kept[before], kept[after] = left, right
            ids, ranks = new, kept
        return ids

    def _merge(self, ids: np.ndarray, out: list, rows: np.ndarray) -> None:
        """Ids of rows (padded by -1 at the right), merged till nothing merges, into out by rows."""
        ranks = self.lookup(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), dtype=np.int64)
            best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), _NONE)
            done = best == _NONE
            for i in np.nonzero(done)[0]:
                row = ids[i]
                out[rows[i]] = row[row >= 0]
            if done.any():
                ids, ranks, rows, at, best = ids[~done], ranks[~done], rows[~done], at[~done], best[~done]
                if not len(ids):
                    return
            n, width = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            keep = np.ones((n, width), dtype=bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), dtype=bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            before = np.nonzero(at > 0)[0]
            ranks[before, at[before] - 1] = self.lookup(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.nonzero(at < width - 2)[0]
            ranks[after, at[after]] = self.lookup(ids[after, at[after]], ids[after, at[after] + 1])

    def merge(self, flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Merged rows, given their ranks on end and how many each has."""
        out, begin = [None] * len(size), np.cumsum(size) - size
        # buckets: up to 4, 8, 16 and so on
        bucket = np.maximum(np.ceil(np.log2(np.maximum(size, 1))).astype(int), 2)
        for b in np.unique(bucket):
            rows = np.nonzero(bucket == b)[0]
            if 1 << int(b) > LONG:
                for i in rows:
                    out[i] = self.merge_long(flat[begin[i] : begin[i] + size[i]])
                continue
            step = max(1, (1 << 20) >> int(b))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                column = np.arange(int(size[part].max()))
                there = column < size[part][:, None]
                ids = np.full(there.shape, -1, dtype=np.int32)
                ids[there] = flat[(begin[part][:, None] + column)[there]]
                self._merge(ids, out, part)
        return out


class Bpe(Pairs):
    """Ranks of byte tokens, of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        super().__init__(ranks)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return self.merge(self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.array([len(x) for x in raw], dtype=np.int64))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encoder(path: str) -> Bpe:
    """The encoder of a rank file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Bpe(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``, without special tokens; a null or empty text has no ids.

    path: a rank file (base64 token, rank) at the same place on every executor. Repeated rows stay; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(encoder(path).encode)
        for batch in batches:
            at = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                ids, bounds = words.tokens(part)
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), column], ["doc_id", "ids"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) per row of ``tokens`` (doc_id, ids); null ids are none. Ids must be the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            out = [bpe.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, int)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: digests of ``encode`` and of the decoded ids, in one pass.

    ids are hashed as little-endian unsigned 32-bit integers. Nulls and repeats as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        words = Words(bpe.encode)
        for batch in batches:
            at = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                ids, bounds = words.tokens(part)
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
