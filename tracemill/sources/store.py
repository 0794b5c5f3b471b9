"""Capture stores (S13, S19) and stored tables that are replaced by key."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.functions.checkpoints import delete, file_system
from tracemill.operators.facets import flagged_capture, store_events
from tracemill.operators.sets import upsert
from tracemill.sources.buckets import TARGET, Buckets, bucket_of


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, source, parser, path, status, flags, deleted_at, recreated_from) of an index file's map."""
    return index_entries(spark.read.option("wholetext", "true").text(path))


def index_entries(whole: DataFrame) -> DataFrame:
    """The entries of index files (value)."""
    entries = F.explode(F.map_entries(F.try_variant_get(F.try_parse_json("value"), "$.files", "map<string,variant>")))
    rows = whole.select(entries.alias("e")).select("e.key", F.col("e.value").alias("v"))
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind).alias(name)
    return rows.select("key", get("source"), get("parser"), get("path"), get("status"), F.coalesce(get("flags", "array<string>"), F.array().cast("array<string>")).alias("flags"), get("deleted_at"), get("recreated_from"))


def capture_events(spark: SparkSession, path: str) -> DataFrame:
    """(t, type, key, path, detail) of an event log; broken lines are dropped."""
    return event_records(spark.read.text(path))


def event_records(lines: DataFrame) -> DataFrame:
    """The records of event log lines (value)."""
    value = F.try_parse_json("value")
    get = lambda name: F.try_variant_get(value, f"$.{name}", "string").alias(name)
    return lines.where(value.isNotNull()).select(get("t"), get("type"), get("key"), get("path"), F.try_variant_get(value, "$.detail", "variant").alias("detail"))


def flagged_report(index: DataFrame, events: DataFrame) -> DataFrame:
    """Flagged captures with their events, one row each, and the store-wide events, whose key is null."""
    own = index.where(flagged_capture()).select("key").join(events.select("key", "t", "type"), "key", "left")
    return own.unionByName(store_events(events).select("key", "t", "type"))


class KeyedTable:
    """A stored table of one row a key, in buckets of the key; an upsert writes anew only the buckets of its keys.

    Readers see the state before an upsert or after it; a read that is planned before two more is still good.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 1, target: int = TARGET):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.buckets = Buckets(spark, path, target=target, least=buckets)

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        some = self.buckets.paths(some=buckets)
        return self.spark.read.schema(self.schema).parquet(*some) if some else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame) -> None:
        """Puts rows, one a key, in place of those of the same keys."""
        scratch = f"{self.path}/new-{self.buckets.next_folder()}"
        new.select(*self.schema.names).write.mode("overwrite").parquet(scratch)
        given = self.spark.read.schema(self.schema).parquet(scratch)
        own = {r[0] for r in given.select(bucket_of(self.key, self.buckets.count).alias("b")).distinct().collect()}
        if own:
            size = file_system(self.spark, scratch).getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(scratch)).getLength()
            count = self.buckets.wanted(size)
            touched = own | self.buckets.splitting(count)
            self.buckets.write("", upsert(self.read(touched), given, self.key), self.key, count, len(touched) + count - self.buckets.count)
            self.buckets.commit(touched, count)
        delete(self.spark, scratch)


def replace_by_key(path: str, new: DataFrame, key: str) -> DataFrame:
    """A small stored table with new rows in place of those of the same keys, as a new version beside the old.

    The result is written to ``<path>/version-<n>``; readers take the highest n, so none sees a half-written table. For a
    table of many documents see ``operators.index``, which rewrites only the parts that hold a changed key.
    """
    spark = new.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(x.getPath().getName()[8:]) for x in fs.listStatus(files) if x.getPath().getName().startswith("version-")] if fs.exists(files) else []
    last = max(found, default=None)
    merged = new if last is None else upsert(spark.read.parquet(f"{path}/version-{last}").select(*new.columns), new, key)
    target = f"{path}/version-{0 if last is None else last + 1}"
    merged.write.parquet(target)
    return spark.read.parquet(target)
