"""Line dedup by levelled sorted runs of line hashes (operator 5), in DataFrame operations only."""

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import manifest, write_manifest
from tracemill.llm.store import deleted, new_folder, parts, stored

#: What is stripped from a line's ends and what separates words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text):
    """``text`` with A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text):
    """The key of each \\n-split line: stripped and A-Z lower-cased; a null text is one empty line."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS)))


def _hashes(key) -> list:
    """128 bits in two columns."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


class LineRuns:
    """Counts of documents by line hash, in sorted runs on levels, in a folder that outlives the session.

    A run is a table in buckets of (h, g), each sorted, so that runs meet by merge joins without a shuffle. A new batch is
    merge-anti-joined with what the runs already hold ``min_docs`` times or more, since such a key is decided, and what is
    left becomes a run of its own. A level of ``fanout`` runs is merged into one of the next level.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int, fanout: int = 2):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.buckets, self.levels, self.merged, self._tables = parts(spark), [[]], [], {}
        self.version, text = manifest(spark, path)
        if text:
            state = json.loads(text)
            self.buckets, self.levels, self.merged = state["buckets"], state["levels"], state["merged"]
            if state["min_docs"] != min_docs:
                raise ValueError(f"the runs at {path} are of min_docs={state['min_docs']}")

    def _write(self, counts: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = f"tracemill_{name[4:]}"
        counts.repartition(self.buckets, "h", "g").write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        self._tables[name] = table
        return name

    def _run(self, name: str) -> DataFrame:
        """(h, g, n) of a run."""
        if name not in self._tables:
            self._tables[name] = f"tracemill_{name[4:]}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._tables[name]} (h BIGINT, g BIGINT, n BIGINT) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self._tables[name])

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' keys with the sum of their counts, by full merge joins."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m").hint("merge"), ["h", "g"], "full")
            return both.select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(merge, map(self._run, names))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name, f'tracemill_{name[4:]}')}")
            deleted(self.spark, f"{self.path}/{name}")

    def _commit(self, old: list[str]) -> None:
        """Writes which runs count; merged ones go when the next state is written, so that readers of this one can end."""
        gone, self.merged = self.merged, old
        self.version += 1
        write_manifest(self.spark, self.path, self.version, json.dumps({"buckets": self.buckets, "min_docs": self.min_docs, "levels": self.levels, "merged": old}))
        self._forget(gone)
        deleted(self.spark, f"{self.path}/manifest-{self.version - 2}")

    def add(self, counts: DataFrame) -> None:
        """Takes the counts (h, g, n) of a batch of documents, each key once."""
        for name in (n for level in self.levels for n in level):
            sealed = self._run(name).where(F.col("n") >= self.min_docs).select("h", "g")
            counts = counts.join(sealed.hint("merge"), ["h", "g"], "left_anti")
        self.levels[0].append(self._write(counts))
        level, old = 0, []
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            merged = self._write(self._merged(names))
            old += names
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)
        self._commit(old)

    def add_documents(self, docs: DataFrame) -> None:
        """Takes a batch of documents (text): counts in how many each non-empty line key is, and adds those counts."""
        keys = docs.select(F.explode(F.array_distinct(line_keys(F.col("text").cast("string")))).alias("key")).where("key != ''")
        self.add(keys.select(*_hashes("key")).groupBy("h", "g").agg(F.count("*").alias("n")))

    def frequent(self) -> DataFrame:
        """(h, g) of every key in ``min_docs`` documents or more so far, each once; stored."""
        names = [name for level in self.levels for name in level]
        return stored(self._merged(names).where(F.col("n") >= self.min_docs).select("h", "g"), "frequent")

    def close(self) -> None:
        """Takes the runs out of the session's catalog; the files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = 4) -> DataFrame:
    """(h, g): hashes of the non-empty line keys found in at least ``min_docs`` rows of ``docs``.

    The documents come in batches by a hash of their doc_id, one after the other, as a growing corpus would.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "line_runs")
    runs = LineRuns(spark, path, min_docs)
    for batch in range(batches):
        runs.add_documents(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))
    out = runs.frequent()
    runs.close()
    deleted(spark, path)
    return out


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with three more columns: n_lines, n_dropped, and kept, the text without its frequent lines.

    A line's key is the line with blanks stripped at both ends and A-Z lower-cased. Keys of one code point or more
    that are found in at least ``min_docs`` rows lose all their lines; the other lines stay, joined by a line feed. A
    null or empty text is one empty line and stays empty. Rows alike in doc_id and text count as a document each and
    get the same result. Columns of ``docs`` named like the three new ones are replaced.
    """
    names = ("n_lines", "n_dropped", "kept")
    others = [c for c in docs.columns if c not in (*names, "text")]
    docs = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("own"), "doc_id", F.col("text").cast("string"))
    row = [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("twin")]
    frequent = frequent_lines(docs.select("doc_id", "text"), min_docs)
    placed = docs.select(*row, F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).where("key != ''").select("row", "twin", "pos", *_hashes("key"))
    hits = placed.join(frequent, ["h", "g"], "left_semi").groupBy("row", "twin").agg(F.collect_set("pos").alias("gone"))
    split = docs.select("own", "text", *row).join(hits, ["row", "twin"], "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return split.select(*(F.col("text" if c == "text" else f"own.`{c}`").alias(c) for c in (*others, "text")), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
