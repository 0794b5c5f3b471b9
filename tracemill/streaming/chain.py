"""Hash chains over the bytes that are appended to files, as a stream with keyed state."""

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["path", "generation", "link", "end", "head", "change"]
#: Hashes of paths by which files are grouped: a frame holds what came of many files, and a file's spans of a batch go together.
SHARDS = 4096
#: Spans that wait lie together by 64 numbers, links by 16 KB of the file: an entry of the state each.
_EARLY, _LINKS = 6, 14
_SPAN, _LINK = struct.Struct("<qqq"), struct.Struct("<qqq32s32s")
#: Links that one frame of results holds, and blocks of a file that are held before they are written.
_ROWS, _HELD = 10_000, 64


def _spans(data: bytes) -> dict[int, tuple[int, bytes]]:
    out, place = {}, 0
    while place < len(data):
        n, at, size = _SPAN.unpack_from(data, place)
        place += _SPAN.size + size
        out[n] = at, data[place - size : place]
    return out


class _Blocks:
    """Entries of a file in a map state of blocks of bytes; what has changed is written by ``save``."""

    def __init__(self, state, path, last: int):
        #: No block beyond ``last`` has been written before.
        self.state, self.path, self.last = state, path, last
        self.held, self.changed = {}, set()

    def get(self, block: int) -> bytearray:
        if block not in self.held:
            there = block <= self.last and self.state.containsKey((self.path, block))
            self.held[block] = bytearray(self.state.getValue((self.path, block))[0] if there else b"")
        return self.held[block]

    def put(self, block: int, data: bytes) -> None:
        self.held[block] = bytearray(data)
        self.changed.add(block)

    def add(self, block: int, data: bytes) -> None:
        self.get(block).extend(data)
        self.changed.add(block)

    def save(self) -> None:
        for block in self.changed:
            if self.held[block]:
                self.state.updateValue((self.path, block), (bytes(self.held[block]),))
            elif block <= self.last and self.state.containsKey((self.path, block)):
                self.state.removeKey((self.path, block))
        self.last = max([self.last, *self.changed])
        self.held, self.changed = {}, set()


class Chain(StatefulProcessor):
    """The chains of a shard's files: each span that comes is hashed into its file's head and is gone.

    State, by path: the open generation, the number of the span that is due, the last link, its end and its head, and how many
    spans wait; in blocks, spans that have come before their turn; and of each link of the open generation where it begins and
    ends, and the heads before and after it. A span that lies where a link lies is a copy if it gives the same head; otherwise
    the file was rewritten from there on, the generation is closed, and the next one goes on from the head before that link,
    over all bytes that the file now has. A file's state is read and written once a frame, in few blocks.
    """

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getMapState("now", f"path {self.kind}", "generation long, due long, link long, end long, head binary, waiting long, top long")
        self.early = handle.getMapState("early", f"path {self.kind}, block long", "spans binary")
        self.links = handle.getMapState("links", f"path {self.kind}, block long", "links binary")

    def _file(self, path, spans: dict[int, tuple[int, bytes]], seed: str) -> Iterator[tuple]:
        """The links that a frame's spans of a file make."""
        held = self.now.getValue((path,)) if self.now.containsKey((path,)) else None
        # top: the highest number that has waited
        generation, due, link, end, head, waiting, top = held if held is not None else (0, 0, 0, 0, bytes.fromhex(seed), 0, -1)
        head = bytes(head)
        spans = {n: span for n, span in spans.items() if n >= due}
        early, links = _Blocks(self.early, path, top >> _EARLY), _Blocks(self.links, path, end - 1 >> _LINKS)
        block, waits = -1, {}
        while spans or waiting:
            if waiting and due >> _EARLY != block:
                if block >= 0:
                    early.put(block, b"")
                block = due >> _EARLY
                waits = _spans(bytes(early.get(block)))
            old = waits.pop(due, None)
            waiting -= old is not None
            span = spans.pop(due, old)
            if span is None:
                break
            at, data = span
            change = "appended"
            if at < end:
                found = next((x for x in _LINK.iter_unpack(bytes(links.get(at >> _LINKS))) if x[0] == at), None)
                if found is None:
                    raise ValueError(f"span {due} of {path} begins within a link, at {at}")
                _, place, stop, before, after = found
                if stop - at == len(data) and hashlib.sha256(before + data).digest() == after:
                    change = None
                else:
                    # links from here on are of the closed generation
                    for gone in range(at >> _LINKS, (end - 1 >> _LINKS) + 1):
                        links.put(gone, b"".join(_LINK.pack(*x) for x in _LINK.iter_unpack(bytes(links.get(gone))) if x[0] < at) if gone == at >> _LINKS else b"")
                    generation, link, end, head, change = generation + 1, place - 1, at, before, "rewritten"
            elif at > end:
                raise ValueError(f"span {due} of {path} begins at {at}, but {end} is the end of what came before")
            if change is not None:
                before, link, end = head, link + 1, at + len(data)
                head = hashlib.sha256(before + data).digest()
                # a span without bytes is a link, but nothing can lie in its place
                if data:
                    links.add(at >> _LINKS, _LINK.pack(at, link, end, before, head))
                    if len(links.held) > _HELD:
                        links.save()
                yield (path, generation, link, end, head.hex(), change)
            due += 1
        if block >= 0:
            early.put(block, b"".join(_SPAN.pack(n, at, len(data)) + data for n, (at, data) in waits.items()))
        for number in {n >> _EARLY for n in spans}:
            own = _spans(bytes(early.get(number)))
            new = {n: span for n, span in spans.items() if n >> _EARLY == number}
            waiting += len(new.keys() - own.keys())
            early.put(number, b"".join(_SPAN.pack(n, at, len(data)) + data for n, (at, data) in (own | new).items()))
        early.save()
        links.save()
        self.now.updateValue((path,), (generation, due, link, end, head, waiting, max([top, *spans])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            files, seeds, out = {}, {}, []
            for path, n, at, data, seed in zip(*(frame[c].tolist() for c in ("path", "n", "at", "data", "seed")), strict=True):
                files.setdefault(path, {})[int(n)] = int(at), bytes(data)
                seeds[path] = seed
            for path, spans in files.items():
                for row in self._file(path, spans, seeds[path]):
                    out.append(row)
                    if len(out) == _ROWS:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def chains(spans: DataFrame) -> DataFrame:
    """(path, generation, link, end, head, change) of a stream of spans (path, n, at, data binary, seed).

    n: a file's spans numbered from 0 in the order in which they were read; at: the byte at which a span begins; seed: 64 hex
    digits, the head before the first link, the same for all spans of a file. Spans may come in any order and in any batches:
    each waits for its turn. A repeated number is no span any more and is left out. Once a stream is run again from its
    checkpoint, chains go on from the recorded head. Frames are Arrow batches, however much of a file a batch brings. To be
    written in append mode, started within ``keyed_state``.
    """
    kind = dict(spans.dtypes)["path"]
    rows = spans.selectExpr("path", "cast(n as long) AS n", "cast(at as long) AS at", "cast(data as binary) AS data", "seed").withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(SHARDS)))
    return rows.groupBy("shard").transformWithStateInPandas(Chain(kind), f"path {kind}, generation long, link long, end long, head string, change string", "Append", "None")
