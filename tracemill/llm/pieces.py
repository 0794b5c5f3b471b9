"""SentencePiece encoding and decoding of BPE models (operator 12).

A text is normalised by the longest prefixes that the model's compiled character map holds, while the source byte of
every normalised character is kept; so every piece is projected back to a span of the text's bytes. The normalised text
is cut wherever no piece of the vocabulary could lie across, and each distinct part is merged once.
"""

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tracemill.llm.bpe import Pairs
from tracemill.llm.pretoken import gathered, points_of, portions

SPACE = "▁"
#: Kinds of pieces, as model files number them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MODELS: dict[str, "Pieces"] = {}


def compiled_map(blob: bytes) -> dict[str, str]:
    """Source prefixes and what replaces them: all keys of the map's double-array trie, level by level.

    The blob is the trie's size, its 32-bit units, then the targets, each ended by a zero byte. A unit holds a label (low
    byte, sign bit), a mark for a key's end (bit 8) and the distance to its children (from bit 10; bit 9 scales it).
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64), blob[4 + size :]
    shift = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels, found = np.arange(1, 256), {}
    base, prefix = np.array([shift(units[0])]), [b""]
    while len(base):
        child = base[:, None] ^ labels
        there = child < len(units)
        there[there] = (units[child[there]] & 0x800000FF) == np.broadcast_to(labels, child.shape)[there]
        row, label = np.nonzero(there)
        unit = units[child[row, label]]
        prefix = [prefix[r] + bytes([labels[c]]) for r, c in zip(row, label, strict=True)]
        base = child[row, label] ^ shift(unit)
        for i in np.nonzero(unit & 256)[0]:
            at = int(units[base[i]]) & 0x7FFFFFFF
            found[prefix[i].decode()] = targets[at : targets.index(b"\0", at)].decode()
    return found


def _by_first(keys) -> dict[str, list[str]]:
    """Keys by their first character, longest first."""
    out: dict[str, list[str]] = {}
    for key in sorted(keys, key=len, reverse=True):
        out.setdefault(key[0], []).append(key)
    return out


def _byte_starts(text: str) -> np.ndarray:
    """The byte at which each character of the text begins, and the text's size in bytes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])


class Normalizer:
    """What a model does to a text before it is cut: replaced prefixes, spaces, and a space in front."""

    def __init__(self, spec, own: tuple[str, ...] = (), suffix: bool = False):
        self.map, self.own = compiled_map(spec.precompiled_charsmap), _by_first(own)
        self.keys = _by_first(self.map)
        self.dummy, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.space = SPACE if spec.escape_whitespaces else " "

    def _prefixes(self, text: str) -> Iterator[tuple[str, int]]:
        """The text in prefixes, as they are replaced, with the number of characters that each takes."""
        at = 0
        while at < len(text):
            own = next((k for k in self.own.get(text[at], ()) if text.startswith(k, at)), None)
            key = own or next((k for k in self.keys.get(text[at], ()) if text.startswith(k, at)), None)
            yield (text[at], 1) if key is None else (key if own else self.map[key], len(key))
            at += 1 if key is None else len(key)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its characters and of its end."""
        starts = _byte_starts(text)
        if not text:
            return "", starts
        if not (self.map or self.own or self.squeeze or self.suffix):
            return (self.space if self.dummy else "") + text.replace(" ", self.space), starts if not self.dummy else np.concatenate([[0], starts])
        parts, at = [], 0
        for new, taken in self._prefixes(text):
            parts.append((new, int(starts[at])))
            at += taken
        end, out, source = int(starts[-1]), [], []
        if self.squeeze:
            lead = next((i for i, (new, _) in enumerate(parts) if new.strip(" ")), None)
            if lead is None:
                # white space alone
                return "", np.array([0])
            # heading prefixes that are one space each go
            lead = next(i for i, (new, _) in enumerate(parts) if new != " ")
            parts = parts[lead:]
        if self.dummy and not self.suffix:
            out.append(self.space)
            source.append(parts[0][1])
        spaced = self.squeeze
        for new, place in parts:
            if spaced:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", self.space))
                source.extend([place] * len(new))
                spaced = self.squeeze and new.endswith(" ")
        whole = "".join(out)
        if self.squeeze:
            bare = whole.rstrip(self.space)
            if len(bare) < len(whole):
                end, whole, source = source[len(bare)], bare, source[: len(bare)]
        if self.dummy and self.suffix:
            whole, source = whole + self.space, [*source, end]
        return whole, np.array([*source, end], dtype=np.int64)


class Pieces:
    """A model's vocabulary, normaliser and merges.

    most: parts of texts that are remembered with their pieces; forgetting costs time only.
    """

    def __init__(self, path: str, most: int = 400_000):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are read")
        kinds = [p.type for p in model.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.surface = model.trainer_spec.unk_surface
        ids = {p.piece: i for i, p in reversed(list(enumerate(model.pieces)))}
        self.begin, self.end = (ids.get(x, self.unknown) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.id, self.kinds = ids, kinds
        joined = [p for p in model.pieces if p.type in (NORMAL, USER, UNUSED)]
        self.cost = {p.piece: -p.score for p in reversed(joined)}
        self.own = tuple(p.piece for p in joined if p.type == USER)
        self.unused = {p.piece for p in joined if p.type == UNUSED}
        self.bytes = [ids[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.normalize = Normalizer(model.normalizer_spec, self.own, model.trainer_spec.treat_whitespace_as_suffix)
        self.denormalize = Normalizer(model.denormalizer_spec) if model.denormalizer_spec.precompiled_charsmap else None
        self.bare = model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.text = [{CONTROL: "", UNKNOWN: self.surface}.get(p.type, p.piece.replace(SPACE, " ")) for p in model.pieces]
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else self.text[i].encode() for i, p in enumerate(model.pieces)]
        self.raw_size = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.raw_at, self.raw_flat = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.spaced = [p.type in (NORMAL, USER, UNUSED) and p.piece.startswith(SPACE) for p in model.pieces]
        # a text may be cut between two characters that no piece holds side by side
        letters = sorted({c for p in joined if len(p.piece) > 1 for c in p.piece})
        number = {c: i for i, c in enumerate(letters, 1)}
        self.letter = np.zeros(0x110000, dtype=np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.side = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for p in joined:
            for a, b in zip(p.piece, p.piece[1:], strict=False):
                self.side[number[a], number[b]] = True
        self.first = _by_first(self.own)
        # matrices know neither fixed symbols nor pieces to be split again; parts that could make pieces of one score go by the heap
        order = sorted(self.cost, key=self.cost.get)
        self.plain = not self.own and not self.unused
        alike = Counter(self.cost[p] for p in order if len(p) > 1)
        tied = sorted({a + b for p in order if alike[self.cost[p]] > 1 for a, b in zip(p, p[1:], strict=False)})
        self.tied = re.compile("|".join(map(re.escape, tied)) or "(?!)")
        self.rank_id = self.rank_size = np.zeros(0, np.int64)
        if self.plain:
            ranks = {piece: i for i, piece in enumerate(order)}
            for c in letters:
                ranks.setdefault(c, len(ranks))
            self.pairs = Pairs(ranks)
            self.rank_id = np.array([ids[p] if i < len(order) else -1 for i, p in enumerate(ranks)], dtype=np.int64)
            self.rank_size = np.array([len(p) for p in ranks], dtype=np.int64)
            self.rank_of = np.full(0x110000, -1, dtype=np.int32)
            for piece, rank in ranks.items():
                if len(piece) == 1:
                    self.rank_of[ord(piece)] = rank
        self.most, self.characters = most, 20 * most
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.slot, self.held = {}, 0
        self.at, self.count, self.ids, self.sizes = none, none, none, none

    def _symbols(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        while at < len(text):
            own = next((k for k in self.first.get(text[at], ()) if text.startswith(k, at)), None)
            yield own or text[at], own is not None
            at += len(own or text[at])

    def _split(self, text: str) -> list[str]:
        """The pieces of a part: its best-scored adjacent pair is joined, leftmost on ties, till none can be."""
        symbols, frozen = map(list, zip(*self._symbols(text), strict=True)) if self.own else (list(text), None)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap, made, cost = [], {}, self.cost

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and not (frozen and (frozen[i] or frozen[j])):
                both = symbols[i] + symbols[j]
                if both in cost:
                    heapq.heappush(heap, (cost[both], i, len(both), j))
                    if both in self.unused:
                        made[both] = symbols[i], symbols[j]

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, size, j = heapq.heappop(heap)
            if symbols[i] is None or j >= len(symbols) or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = []
        stack = [s for s in reversed(symbols) if s is not None]
        while stack:
            piece = stack.pop()
            if piece in self.unused and piece in made:
                stack += reversed(made[piece])
            else:
                out.append(piece)
        return out

    def merged(self, text: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids of a part, and how many of its characters each takes; of several bytes of one character the last takes it."""
        ids, sizes = [], []
        for piece in self._split(text):
            found = self.id.get(piece, self.unknown)
            if found != self.unknown or self.bytes is None:
                ids.append(found)
                sizes.append(len(piece))
            else:
                raw = piece.encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(piece)]
        return tuple(ids), tuple(sizes)

    def _learn(self, parts: list[str]) -> None:
        """Pieces of new parts, found together in padded matrices where the vocabulary allows it."""
        joined = [p for p in parts if self.plain and len(p) > 1 and not self.tied.search(p)]
        flat, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if joined:
            points, bounds = points_of(joined)
            rows = self.pairs.merge(self.rank_of[points], np.diff(bounds))
            flat, count = np.concatenate(rows), np.array([len(x) for x in rows], dtype=np.int64)
        # characters that are parts of pieces, but none themselves, leave a part to be merged by itself
        odd = np.zeros(len(joined), dtype=bool)
        odd[np.repeat(np.arange(len(joined)), count)[self.rank_id[flat] < 0]] = True
        flat, count = flat[~np.repeat(odd, count)], count[~odd]
        known = [p for p, o in zip(joined, odd.tolist(), strict=True) if not o]
        rest = list(set(parts).difference(known))
        own = list(map(self.merged, rest))
        count = np.concatenate([count, np.array([len(x) for x, _ in own], dtype=np.int64)])
        self.slot.update(zip(known + rest, range(len(self.slot), len(self.slot) + len(parts)), strict=True))
        self.held += sum(map(len, parts))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, self.rank_id[flat], np.fromiter(chain.from_iterable(x for x, _ in own), dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, self.rank_size[flat], np.fromiter(chain.from_iterable(x for _, x in own), dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: ids with begin and end, and the span (first byte, byte after the last) of each in its UTF-8."""
        texts = [self.normalize(text) for text in texts]
        whole = "".join(text for text, _ in texts)
        points, bounds = points_of([text for text, _ in texts])
        if len(points):
            letter = self.letter[points]
            fresh = np.concatenate([[True], ~self.side[letter[:-1], letter[1:]] if self.plain else np.zeros(len(points) - 1, dtype=bool)])
            fresh[bounds[:-1][np.diff(bounds) > 0]] = True
            begins = np.nonzero(fresh)[0]
            stops = np.append(begins[1:], len(points))
            parts = [whole[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
            new = set(parts).difference(self.slot)
            if self.slot and (len(self.slot) + len(new) > self.most or self.held > self.characters):
                self._clear()
                new = set(parts)
            if new:
                self._learn(list(new))
            slot = np.fromiter(map(self.slot.__getitem__, parts), dtype=np.int64, count=len(parts))
            take = gathered(self.at[slot], self.count[slot])
            ids, stop = self.ids[take], np.cumsum(self.sizes[take])
            before = np.concatenate([[0], np.cumsum(self.count[slot])])[np.searchsorted(begins, bounds)]
        else:
            ids, stop, before = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        return [self._spanned(ids[a:b], stop[a:b] - begin, source) for (_, source), a, b, begin in zip(texts, before[:-1], before[1:], bounds[:-1], strict=True)]

    def _spanned(self, ids: np.ndarray, stop: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        if self.bytes is None and len(ids):
            # unknown pieces on end are one
            fresh = np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])
            last = np.append(np.nonzero(fresh)[0][1:] - 1, len(ids) - 1)
            ids, start, stop = ids[fresh], start[fresh], stop[last]
        edge = int(source[-1])
        return np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32), np.concatenate([[[0, 0]], np.stack([source[start], source[stop]], axis=1), [[edge, edge]]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, each by itself."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.kinds)):
            raise ValueError("an id is none of the model's pieces")
        lead, skip = "", 0
        if self.bare:
            # the space that encoding put in front goes, once, or every leading one where spaces are squeezed
            while skip < len(ids) and self.kinds[ids[skip]] == CONTROL:
                skip += 1
            while not lead and skip < len(ids) and self.spaced[ids[skip]]:
                lead, skip = self.text[ids[skip]][1:], skip + 1
                if not self.squeeze:
                    break
        rest = ids[skip:]
        raw = self.raw_flat[gathered(self.raw_at[rest], self.raw_size[rest])].tobytes()
        try:
            text = lead + raw.decode()
        except UnicodeDecodeError:
            text = lead + "".join(self._mended(rest.tolist()))
        return self.denormalize(text)[0] if self.denormalize else text

    def _mended(self, ids: list[int]) -> Iterator[str]:
        held = b""
        for i in chain(ids, [None]):
            if i is not None and self.kinds[i] == BYTE:
                held += self.raw[i]
                continue
            while held:
                try:
                    text = held.decode()
                    held = b""
                    yield text
                except UnicodeDecodeError as bad:
                    yield held[: bad.start].decode() + "�"
                    held = held[bad.start + 1 :]
            if i is not None:
                yield self.text[i]


def pieces(path: str) -> Pieces:
    """The model of a file, read once in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, pieces array<struct<id, begin, stop>>) per row of ``docs``: ids with begin and end ids, and byte spans.

    path: a BPE model file at the same place on every executor. A null or empty text has the begin and end ids alone.
    A span is of the source text's UTF-8, stop exclusive; the begin id's is empty at 0, the end id's at the end of what was
    read; of a character in several byte pieces the last has the span. Repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            at = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                ids, spans = zip(*model.encode(part), strict=True)
                whole = np.concatenate(spans)
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(ids).astype(np.int32)), pa.array(whole[:, 0]), pa.array(whole[:, 1])], ["id", "begin", "stop"])
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(bounds, rows)], ["doc_id", "pieces"])
                at += len(part)

    return _rows(docs).mapInArrow(run, "doc_id long, pieces array<struct<id: int, begin: long, stop: long>>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) per row of ``tokens`` (doc_id, ids array<int>); null ids are none. Ids must be the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) per row: digests of ``encode`` and ``decode`` in one pass.

    ids are hashed as little-endian unsigned 32-bit integers, spans as pairs of little-endian signed 64-bit ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            at = 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                own = model.encode(part)
                hexed = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), pa.array([len(ids) for ids, _ in own], pa.int64()), hexed(ids.astype("<u4").tobytes() for ids, _ in own),
                    hexed(model.decode(ids).encode() for ids, _ in own), hexed(spans.astype("<i8").tobytes() for _, spans in own),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
                at += len(part)

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
