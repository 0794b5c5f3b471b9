"""Queries that run as streams over all that is there, and return the tables that they leave."""

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import shared_folder
from tracemill.operators import aggregates
from tracemill.plans import layouts
from tracemill.plans.registry import LOG, ORACLE_SQL, query
from tracemill.sources import jsonl, tail
from tracemill.streaming.accumulate import keyed_state, summaries
from tracemill.streaming.capture import changes, gaps_between, uptimes
from tracemill.streaming.chain import chains
from tracemill.streaming.summary import run_available, running_tallies
from tracemill.streaming.throttle import throttled


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(ORACLE_SQL["summary_events"])
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of a stream of events, each of which comes twice, equal to those of one batch."""
    folder = _folder(spark)
    twice = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    counted = running_tallies(twice, ["user_id"], "event_type", ["view", "click", "purchase", "error", "signup"], "event_id", "ts")
    return run_available(counted, f"{folder}/table", f"{folder}/checkpoint", "user_id")


@query(ORACLE_SQL["snapshot_classify"])
def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of snapshots, classified with keyed state."""
    folder, k = _folder(spark), F.get_json_object("props", "$.k").cast("long")
    shots = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), "event_id", F.floor(k / 40).alias("identity"), (k % 50).alias("size"), (k % 3 != 0).alias("prefix_same"))
    out = changes(shots)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/table").select(F.col("path").cast("long").alias("path"), "event_id", "change")


def _shuffled(lines: DataFrame, folder: str, files: int = 6) -> DataFrame:
    """A stream of log lines, each of which comes twice, dealt to files by a hash; two files make a micro-batch."""
    twice = lines.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    twice.repartition(files, F.xxhash64("file", "position", "copy")).drop("copy").write.parquet(f"{folder}/lines")
    return lines.sparkSession.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/lines")


@query(ORACLE_SQL["tree_summary"])
def stream_tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project-tree logs as a stream of lines in any order, twice each; the summaries are those of the whole logs."""
    folder = _folder(spark)
    records = jsonl.tree_records(jsonl.placed_records(_shuffled(layouts.tree_lines(spark, sf_dir), folder), "position"))
    with keyed_state(spark):
        sums = run_available(summaries(aggregates.tree_fields(records), aggregates.TREE), f"{folder}/table", f"{folder}/checkpoint", "session_key")
    out = aggregates.tree_finish(sums)
    return out.select("session_key", "n_records", "n_user", "n_assistant", "n_tool", "first_ts", "last_ts", "cwd", "git_branch", "version", "model", "claude_title", "title")


@query(ORACLE_SQL["rollout_summary"])
def stream_rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as such a stream; a message counts once, though its mirror and its envelope come in different batches."""
    folder = _folder(spark)
    records = jsonl.placed_records(_shuffled(layouts.rollout_lines(spark, sf_dir), folder), "position").withColumn("session_key", jsonl.rollout_key(F.col("file")))
    with keyed_state(spark):
        sums = run_available(summaries(aggregates.rollout_fields(records), aggregates.ROLLOUT), f"{folder}/table", f"{folder}/checkpoint", "session_key")
    out = aggregates.rollout_finish(sums, layouts.thread_rows(spark, sf_dir))
    return out.select("session_key", "n_user", "n_assistant", "n_tool", "n_reasoning", "n_web", "n_records", "model", "ai_title", "cwd")


def _seed() -> Column:
    return F.sha2(F.concat(F.lit("t:"), F.col("path").cast("string")).cast("binary"), 256)


@query("""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents WHERE text IS NOT NULL
),
c AS (
  SELECT doc_id, 1 AS link, strlen(line)::BIGINT AS "end", sha256('t:' || doc_id) AS before, sha256(unhex(sha256('t:' || doc_id)) || encode(line)) AS head FROM l WHERE n = 1
  UNION ALL SELECT c.doc_id, c.link + 1, c."end" + strlen(l.line), c.head, sha256(unhex(c.head) || encode(l.line)) FROM c JOIN l ON l.doc_id = c.doc_id AND l.n = c.link + 1
)
SELECT doc_id, 0::BIGINT AS generation, link::BIGINT AS link, "end", head, 'appended' AS change FROM c
UNION ALL SELECT c.doc_id, 1, c.link, c."end" + 1, sha256(unhex(c.before) || encode('!' || line)), 'rewritten' FROM c JOIN l ON l.doc_id = c.doc_id AND l.n = c.link WHERE c.link = l.m AND c.doc_id % 3 = 0 AND line <> ''
""")
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of ``hash_chain`` over a stream of documents' lines in any order; of every third document the last
    line comes again, then with another byte before it, which opens a generation."""
    folder = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    lines = docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("size", F.octet_length("line"))
    order = Window.partitionBy("path").orderBy("n")
    # offsets are sums over the narrow sizes of a document's lines
    places = lines.select("path", "n", (F.sum("size").over(order) - F.col("size")).alias("at"), (F.lead("n").over(order).isNull() & (F.col("path") % 3 == 0) & (F.col("size") > 0)).alias("last"))
    whole = lines.join(places, ["path", "n"])
    more = F.when(F.col("last"), F.array(F.struct(F.lit(1).alias("m"), F.col("line").alias("data")), F.struct(F.lit(2).alias("m"), F.concat(F.lit("!"), "line").alias("data")))).otherwise(F.array())
    spans = whole.select("path", "at", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("m"), F.col("line").alias("data"))), more)).alias("s"), "n")
    spans = spans.select("path", (F.col("n") + F.col("s.m")).alias("n"), "at", F.col("s.data").cast("binary").alias("data"), _seed().alias("seed"))
    spans.repartition(6, F.xxhash64("path", "n")).write.parquet(f"{folder}/spans")
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/spans")
    out = chains(stream)
    with keyed_state(spark):
        out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/table").withColumnRenamed("path", "doc_id")


def _put(lines: DataFrame, mode: str) -> None:
    """Writes lines (path, position, value) into their files, in order, or at their ends; a file's lines go to one task."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if file is not None:
                        file.close()
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    now, file = path, open(path, mode, encoding="utf-8")  # noqa: SIM115
                file.write(value + "\n")
        if file is not None:
            file.close()
        yield from ()

    lines.repartition("path").sortWithinPartitions("path", "position").select("path", "value").mapInArrow(put, "done int").write.format("noop").mode("overwrite").save()


@query(ORACLE_SQL["tree_summary"])
def tail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project-tree logs written as files, tailed, and tailed again after they have grown.

    At first the files hold the first two turns' lines. Every third one's last line is another one then, which is changed when the
    file grows: it is read anew, and its summary has nothing of the line that is gone. The shared folder must be mounted.
    """
    folder = _folder(spark)
    place = folder.removeprefix("file:").replace("//", "/") if folder.startswith("file:") else folder
    lines = layouts.tree_lines(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{place}/logs"), "file"))
    early = F.col("position") < 200
    edited = F.pmod(F.xxhash64("file"), F.lit(3)) == 0
    wrong = lines.where(early & edited).select("path").distinct().select("path", F.lit(199).alias("position"), F.lit('{"type":"user","message":{"content":"to be withdrawn"},"cwd":"/gone","timestamp":"2024-01-01"}').alias("value"))
    spark.dataSource.register(tail.TailSource)
    stream = spark.readStream.format("tail").option("path", f"{place}/logs/**/*.jsonl").option("state", f"{place}/tail").load()
    records = jsonl.tree_records(jsonl.placed_records(stream, "at"))
    with keyed_state(spark):
        counted = summaries(aggregates.tree_fields(records.withColumnRenamed("version", "begun"), "begun"), aggregates.TREE, version="begun")
        _put(lines.where(early).select("path", "position", "value").unionByName(wrong), "w")
        run_available(counted, f"{folder}/table", f"{folder}/checkpoint", "session_key")
        _put(lines.where(~early & ~edited), "a")
        _put(lines.where(edited), "w")
        out = aggregates.tree_finish(run_available(counted, f"{folder}/table", f"{folder}/checkpoint", "session_key"))
    return out.select("session_key", "n_records", "n_user", "n_assistant", "n_tool", "first_ts", "last_ts", "cwd", "git_branch", "version", "model", "claude_title", "title")


def _far(events: DataFrame, path: str) -> None:
    """Adds a row without a user, so late that all that waits for the clock is due."""
    late = events.agg((F.max("ts") + F.expr("INTERVAL 5000 DAYS")).alias("ts"))
    late.select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), "ts").coalesce(1).write.mode("append").parquet(path)


def _mixed_events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events' users and times as a stream in any order, and after all of them one that moves the clock far ahead."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3, F.xxhash64("user_id", "ts")).write.parquet(f"{folder}/events")
    _far(events, f"{folder}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")


def _appended(out: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, and reads what it has written."""
    out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/table")


@query(ORACLE_SQL["downtime_gaps"])
def stream_downtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: gaps between the session windows of heartbeats that come in any order, late ones among them."""
    folder = _folder(spark)
    spells = _appended(uptimes(_mixed_events(spark, sf_dir, folder), ["user_id"], "ts", "1 day", "4000 days"), folder)
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType
    return gaps_between(spells.where("user_id is not null"), ["user_id"]).select("user_id", *(F.col(c).cast(kind).alias(c) for c in ("gap_start", "gap_end")))


@query(f"""
WITH RECURSIVE {LOG}, t AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM log),
c AS (
  SELECT user_id, min(t) AS out_ms FROM t GROUP BY user_id
  UNION ALL SELECT c.user_id, greatest(c.out_ms + 86400000, (SELECT min(t.t) FROM t WHERE t.user_id = c.user_id AND t.t > c.out_ms)) FROM c
  WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = c.user_id AND t.t > c.out_ms)
)
SELECT c.user_id, max(t.t) AS changed_ms, c.out_ms FROM c JOIN t ON t.user_id = c.user_id AND t.t <= c.out_ms GROUP BY c.user_id, c.out_ms
""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' events as changes of documents, each handed on at once or, at most daily, when its time is up."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # changes come in order, over several batches
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    bounds = [low + (high - low) * n / 3 for n in range(1, 3)]
    for n in range(3):
        some = [*([F.col("ts") > bounds[n - 1]] if n else []), *([F.col("ts") <= bounds[n]] if n < 2 else [])]
        events.where(reduce(lambda x, y: x & y, some)).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    _far(events, f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    with keyed_state(spark, timers=True):
        return _appended(throttled(stream, "user_id", "ts", 86400), folder).where("user_id is not null")
