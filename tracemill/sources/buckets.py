"""Tables in buckets of a key's hash whose number follows the bytes (S14, S16, X4), with a manifest that switches states.

Buckets grow by linear hashing: of N buckets a hash's lowest bits name one, by one bit more where that many are in use already.
So the bucket is an expression of N, a table grows from N to M by splitting the buckets that the new numbers come from,
and a write's tasks are the buckets that it touches.
"""

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import delete, file_system, manifest, write_manifest

#: Bytes of Parquet that a bucket has on average at most.
TARGET = 128 << 20
#: States before the present one whose files stay, for readers that have planned, but not finished, a read.
KEEP = 2


def bucket_of(key: Column | str, count: int) -> Column:
    """The bucket of a key among ``count``."""
    bits = count.bit_length()
    wide, narrow = (F.xxhash64(key).bitwiseAND(F.lit((1 << b) - 1)) for b in (bits, bits - 1))
    return F.when(wide < count, wide).otherwise(narrow).cast("int")


def parent(bucket: int, count: int) -> int:
    """Of ``count`` buckets the one that holds the keys which a larger number of buckets would put into ``bucket``."""
    while bucket >= count:
        bucket -= 1 << bucket.bit_length() - 1
    return bucket


class Buckets:
    """Which folder counts for each bucket, and how large it is; some tables may share the buckets of a key.

    ``extra`` is whatever the owner wants to remember with a state. Driver: an entry a bucket, so one for each ``target`` bytes.
    """

    def __init__(self, spark: SparkSession, path: str, tables: tuple[str, ...] = ("",), target: int = TARGET, least: int = 1):
        self.spark, self.path, self.tables, self.target = spark, path, tables, target
        self.version, text = manifest(spark, path)
        state = json.loads(text) if text else {"count": least, "folders": {}, "sizes": {}, "dead": [], "extra": {}}
        self.count, self.dead, self.extra = state["count"], state["dead"], state["extra"]
        self.folders, self.sizes = ({int(b): x for b, x in state[name].items()} for name in ("folders", "sizes"))

    def paths(self, table: str = "", some: Iterable[int] | None = None) -> list[str]:
        chosen = self.folders if some is None else set(some) & set(self.folders)
        return [f"{self._at(table, self.folders[b])}/bucket={b}" for b in sorted(chosen)]

    def _at(self, table: str, folder: str) -> str:
        return "/".join(x for x in (self.path, table, folder) if x)

    def wanted(self, more: int) -> int:
        """How many buckets there should be when so many bytes come."""
        return max(self.count, -(-(sum(self.sizes.values()) + more) // self.target))

    def splitting(self, count: int) -> set[int]:
        """The buckets that give keys away when there are ``count``."""
        return {parent(b, self.count) for b in range(self.count, count)}

    def next_folder(self) -> str:
        return f"state-{self.version + 1}"

    def write(self, table: str, rows: DataFrame, key: str, count: int, touched: int) -> None:
        """Writes rows into the next folder by their buckets; a task for each that is touched."""
        rows = rows.withColumn("bucket", bucket_of(key, count))
        rows.repartition(max(touched, 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at(table, self.next_folder()))

    def commit(self, gone: set[int], count: int) -> None:
        """Makes the written folder count in place of the buckets ``gone``, whose files go when they are KEEP states old."""
        folder, sizes = self.next_folder(), {}
        fs = file_system(self.spark, self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in self.tables:
            where = path(self._at(table, folder))
            for x in fs.listStatus(where) if fs.exists(where) else []:
                if x.getPath().getName().startswith("bucket="):
                    b = int(x.getPath().getName()[7:])
                    sizes[b] = sizes.get(b, 0) + fs.getContentSummary(x.getPath()).getLength()
        old = [f"{self._at(t, self.folders[b])}/bucket={b}" for b in sorted(gone) if b in self.folders for t in self.tables]
        self.folders = {b: f for b, f in self.folders.items() if b not in gone} | dict.fromkeys(sizes, folder)
        self.sizes = {b: n for b, n in self.sizes.items() if b not in gone} | sizes
        self.count, self.version = count, self.version + 1
        past = [d for d in self.dead if d[0] <= self.version - KEEP]
        self.dead = [d for d in self.dead if d[0] > self.version - KEEP] + ([[self.version, old]] if old else [])
        state = {"count": count, "folders": self.folders, "sizes": self.sizes, "dead": self.dead, "extra": self.extra}
        write_manifest(self.spark, self.path, self.version, json.dumps(state))
        delete(self.spark, *(p for _, paths in past for p in paths), f"{self.path}/manifest-{self.version - KEEP - 1}")
