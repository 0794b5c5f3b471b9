"""A stream of the lines that are appended to files (S3, T13): Spark's own file stream reads each file once only."""

import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes at a file's begin, and before the place where reading stopped, that must be as they were for reading to go on.
ENDS = 4096
#: Bytes that one task reads at most, but for the end of its last line; triggers whose records are gathered into one.
PIECE, TRIGGERS = 64 << 20, 64
#: What opening a file counts as, in bytes, and so many tasks at least, if there are files for them, that a trigger's spans are dealt to.
OPEN, TASKS = 64 << 10, 64


def stamp_of(path: str) -> list[int]:
    """What changes when a file does (F25): its size, time and identity."""
    now = os.stat(path)
    return [now.st_size, now.st_mtime_ns, now.st_ino]


def _hash(file, begin: int, end: int) -> str:
    file.seek(begin)
    return hashlib.sha256(file.read(end - begin)).hexdigest()


def last_line_end(file, size: int) -> int:
    """The end of the last whole line among the first ``size`` bytes."""
    at = size
    while at > 0:
        begin = max(0, at - 65536)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def step(path: str, old: dict | None) -> tuple[dict, dict | None]:
    """A file's new state, and the span to read: begin, end and version, or none.

    The version is how often the file was begun anew: when it has shrunk, or either end of what was read is no longer as it was.
    """
    stamp = stamp_of(path)
    with open(path, "rb") as file:
        fresh = old is not None and (stamp[0] < old["end"] or _hash(file, 0, old["n"]) != old["head"] or _hash(file, max(0, old["end"] - ENDS), old["end"]) != old["tail"])
        begin = old["end"] if old is not None and not fresh else 0
        version = old["version"] + fresh if old is not None else 0
        end = last_line_end(file, stamp[0])
        n = min(ENDS, end)
        state = {"end": end, "n": n, "head": _hash(file, 0, n), "tail": _hash(file, max(0, end - ENDS), end), "stamp": stamp, "version": version}
    return state, {"begin": begin, "end": end, "version": version, "fresh": fresh} if fresh or end > begin else None


@dataclass
class Span:
    path: str
    begin: int
    end: int
    #: Where the bytes that this task reads begin and end: it takes the lines that begin among them.
    low: int
    high: int
    version: int
    fresh: bool


@dataclass
class Spans(InputPartition):
    """What one task reads: many small files' spans, or a piece of a large one."""

    spans: list[Span]


def dealt(spans: list[Span]) -> list[Spans]:
    """Spans in order, so many to a task that tasks have about the same bytes, ``PIECE`` at most unless one alone has more."""
    sizes = [s.high - s.low + OPEN for s in spans]
    most, out, held = min(PIECE, max(1, sum(sizes) // TASKS)), [], 0
    for span, size in zip(spans, sizes, strict=True):
        if not out or held + size > most:
            out.append(Spans([]))
            held = 0
        out[-1].spans.append(span)
        held += size
    return out


class TailReader(DataSourceStreamReader):
    """Offsets are numbers of records of change in a folder: what each trigger found new, by file, with the files' states.

    So the checkpoint holds one number however many files there are, a batch that is run again reads the same spans, and a
    restart gathers the states from the records. Records of many triggers are gathered into one once they are done.
    """

    def __init__(self, pattern: str, folder: str):
        self.pattern, self.folder = pattern, folder
        self.known, self.at = None, 0

    def _records(self, kind: str) -> list[int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(int(n[len(kind) : -6]) for n in names if n.startswith(kind) and n.endswith(".jsonl"))

    def _read(self, name: str) -> Iterator[dict]:
        with open(f"{self.folder}/{name}.jsonl", encoding="utf-8") as file:
            yield from map(json.loads, file)

    def _write(self, name: str, rows: Iterator[dict]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as file:
            file.writelines(json.dumps(row) + "\n" for row in rows)
        os.replace(part, f"{self.folder}/{name}.jsonl")

    def _restore(self) -> None:
        if self.known is None:
            bases, changes = self._records("base-"), self._records("change-")
            self.at = bases[-1] if bases else 0
            self.known = {row["path"]: row["state"] for row in self._read(f"base-{self.at}")} if bases else {}
            for n in (n for n in changes if n > self.at):
                self.known |= {row["path"]: row["state"] for row in self._read(f"change-{n}")}
                self.at = n

    def initialOffset(self) -> dict:
        return {"change": 0}

    def latestOffset(self) -> dict:
        """Files are listed each time; only those whose stamp has changed are opened."""
        self._restore()
        found = []
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            old = self.known.get(path)
            if os.path.isfile(path) and (old is None or old["stamp"] != stamp_of(path)):
                state, span = step(path, old)
                if span or old is None or state != old:
                    found.append({"path": path, "state": state, "span": span})
        if found:
            self._write(f"change-{self.at + 1}", iter(found))
            self.at += 1
            self.known |= {row["path"]: row["state"] for row in found}
        return {"change": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Tasks follow the bytes, not the number of files."""
        out = []
        for n in range(start["change"] + 1, end["change"] + 1):
            for row in self._read(f"change-{n}"):
                if row["span"]:
                    s = row["span"]
                    lows = range(s["begin"], max(s["end"], s["begin"] + 1), PIECE)
                    out += [Span(row["path"], s["begin"], s["end"], low, min(low + PIECE, s["end"]), s["version"], s["fresh"] and low == s["begin"]) for low in lows]
        return dealt(out)

    def read(self, partition: Spans) -> Iterator[tuple]:
        for span in partition.spans:
            yield from self._lines(span)

    def _lines(self, partition: Span) -> Iterator[tuple]:
        if partition.fresh:
            yield (partition.path, -1, None, partition.version)
        with open(partition.path, "rb") as file:
            at = partition.low
            if at > partition.begin:
                # the line that holds the byte before is another task's
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < partition.high:
                line = file.readline(partition.end - at)
                if not line.endswith(b"\n"):
                    # the file was cut meanwhile: the next trigger begins it anew
                    break
                yield (partition.path, at, line[:-1].decode("utf-8", "replace"), partition.version)
                at += len(line)

    def commit(self, end: dict) -> None:
        """Gathers the states of what is done, every so many triggers; the records before go."""
        bases = self._records("base-")
        if end["change"] - (bases[-1] if bases else 0) < TRIGGERS:
            return
        known = {row["path"]: row["state"] for row in self._read(f"base-{bases[-1]}")} if bases else {}
        for n in (n for n in self._records("change-") if n <= end["change"]):
            known |= {row["path"]: row["state"] for row in self._read(f"change-{n}")}
        self._write(f"base-{end['change']}", ({"path": p, "state": s} for p, s in known.items()))
        # the last batch's records stay: it may be run again
        for name in [*(f"base-{n}" for n in bases), *(f"change-{n}" for n in self._records("change-") if n < end["change"])]:
            os.remove(f"{self.folder}/{name}.jsonl")


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", glob).option("state", folder)``: (file, at, value, version) for each whole line appended.

    A half-written last line waits for its end. A file that has shrunk, or whose first bytes or whose last ones before the stop
    are no longer those that were read, is read anew: a row without a value at -1, with the next version, says that lines of
    smaller versions no longer count. Paths must be visible to the driver and to all executors; the state's folder, to the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at long, value string, version long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options["path"], self.options["state"])
