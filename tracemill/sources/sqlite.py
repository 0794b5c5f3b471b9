"""Rows of many SQLite stores (S6-S8, S10): a task opens each store in place, or in memory where only Spark can read it."""

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Stores:
    """Many stores as one: ``files`` has a row for each, its path and, unless tasks open it in place, its content."""

    def __init__(self, files: DataFrame):
        self.files, self.spark = files, files.sparkSession

    @classmethod
    def below(cls, spark: SparkSession, path: str, glob: str = "*.db") -> "Stores":
        """The stores below a path whose names match.

        On a file system that all machines mount, stores are opened where they are, whatever their size; from any other,
        a store comes as one value, so 2 GB at most.
        """
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        return cls(files.select("path") if where.getScheme() == "file" else files.select("path", "content"))

    def rows(self, sql: str, schema: str) -> DataFrame:
        """Rows of a SELECT over every store, with the store's path as ``store``; schema is that of the SELECT.

        Filters and projections belong in the statement: they then run inside each store. Stores that lack the table
        give no rows. One task reads a store; many stores spread over tasks.
        """

        def rows_of(store: str, content: bytes | None) -> Iterator[tuple]:
            if content is None:
                con = sqlite3.connect(f"file:{store.removeprefix('file:')}?mode=ro", uri=True)
            else:
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
            try:
                for row in con.execute(sql):
                    yield (store, *row)
            except sqlite3.OperationalError as e:
                if "no such table" not in str(e):
                    raise
            finally:
                con.close()

        def run(files: Iterator[Row]) -> Iterator[tuple]:
            for file in files:
                yield from rows_of(file["path"], bytes(file["content"]) if "content" in file else None)

        # rows of an RDD are handed over by their bytes; an Arrow batch holds 10,000 rows, and a row is a whole store
        return self.spark.createDataFrame(self.files.rdd.mapPartitions(run), f"store string, {schema}", verifySchema=False)


def kv_rows(stores: Stores, prefix: str, table: str = "cursorDiskKV") -> DataFrame:
    """(store, key, a, b, value VARIANT) of keys with a prefix; a and b are the key's second and third parts."""
    low = prefix.replace("'", "''")
    # a range of keys, which the store's index serves; LIKE would not
    rows = stores.rows(f"SELECT key, CAST(value AS TEXT) FROM {table} WHERE key >= '{low}' AND key < '{low[:-1]}{chr(ord(low[-1]) + 1)}'", "key string, text string")
    part = lambda n: F.split_part("key", F.lit(":"), F.lit(n))
    return rows.select("store", "key", part(2).alias("a"), part(3).alias("b"), F.try_parse_json("text").alias("value"), "text")


def ide_store(stores: Stores) -> tuple[DataFrame, DataFrame]:
    """Headers (session_key, seq, bubble_id) and bubbles (session_key, bubble_id, value) of IDE stores."""
    composers = kv_rows(stores, "composerData:")
    listed = F.try_variant_get("value", "$.fullConversationHeadersOnly", "array<variant>")
    headers = composers.select(F.col("a").alias("session_key"), F.posexplode(listed).alias("seq", "h")).select("session_key", "seq", F.try_variant_get("h", "$.bubbleId", "string").alias("bubble_id"))
    return headers, kv_rows(stores, "bubbleId:").select(F.col("a").alias("session_key"), F.col("b").alias("bubble_id"), "value")


def three_tables(stores: Stores) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and parts of a three-table store."""
    get = lambda sql, schema: stores.rows(sql, schema).drop("store")
    return (
        get("SELECT id, parent_id, directory, title, version, time_created, time_updated FROM session", "id string, parent_id string, directory string, title string, version string, time_created long, time_updated long"),
        get("SELECT id, session_id, time_created, data FROM message", "id string, session_id string, time_created long, data string"),
        get("SELECT id, message_id, session_id, data FROM part", "id string, message_id string, session_id string, data string"),
    )


def thread_rows(stores: Stores, columns: list[str]) -> DataFrame:
    """Rows of the thread table as text; a column that a store lacks is null there."""
    have = stores.rows("SELECT name FROM pragma_table_info('threads')", "name string").groupBy("store").agg(F.collect_set("name").alias("have"))
    # SQLite reads an unknown name in double quotes as a text, so the name comes back where there is no such column
    rows = stores.rows(f"SELECT {', '.join(f'CAST(\"{c}\" AS TEXT)' for c in columns)} FROM threads", ", ".join(f"{c} string" for c in columns))
    return rows.join(have, "store").select("store", *(F.when(F.array_contains("have", c), F.col(c)).alias(c) for c in columns))


def blob_messages(stores: Stores) -> DataFrame:
    """(session_key, seq, value) of role messages in chat stores: the JSON objects with a role that blobs hold.

    A blob may frame its JSON with other bytes; what lies from the first ``{"role"`` or ``{"id"`` to the last brace counts.
    The session is the store's folder.
    """
    rows = stores.rows("SELECT rowid - 1, id, CAST(data AS TEXT) FROM blobs ORDER BY rowid", "seq long, id string, text string")
    inner = F.regexp_extract("text", r'(?s)(\{"(?:role|id)".*\})', 1)
    parsed = rows.select(F.regexp_extract("store", r"/([^/]+)/store\.db$", 1).alias("session_key"), "seq", F.try_parse_json(inner).alias("value"))
    return parsed.where(F.try_variant_get("value", "$.role", "string").isNotNull())
