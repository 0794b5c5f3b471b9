"""JSONL logs (S1, S2, S4, S5, S9, S11, S12): lines with their file and order, parsed to VARIANT."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.sets import distinct_paths
from tracemill.operators.windows import file_sequence

# How the lines of bulky records begin that nothing shows. Of logged messages only those whose own role
# is known not to be the system's may go: a line of any other layout is parsed.
REQUEST = '{"type":"api-request"'
OTHER_BLOB = r'^\{"type":"api-request-blob"(?:,"\w+":"[^"\\]*")*,"message":\{"role":"(?:user|assistant|tool)"[,}]'


def read_lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines (file, block_start, position, value) of all files below a root whose names match; their order is kept in two columns."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("position"), "value")


def not_bulky(value: Column | str = "value") -> Column:
    """Lines to parse; put before the parse, so that the others are never parsed."""
    value = F.col(value) if isinstance(value, str) else value
    return (F.trim(value) != "") & ~F.startswith(value, F.lit(REQUEST)) & ~value.rlike(OTHER_BLOB)


def raw_records(lines: DataFrame) -> DataFrame:
    """(file, seq, value VARIANT): the records of each file numbered from 0; blank, bulky and broken lines don't count."""
    parsed = lines.where(not_bulky()).withColumn("value", F.try_parse_json("value")).where("value is not null")
    return file_sequence(parsed).select("file", "seq", "value")


def placed_records(lines: DataFrame, place: str) -> DataFrame:
    """(file, seq, value VARIANT, ...) of a stream of lines, whose place in the file stands for its number; the same lines don't count.

    A line at a place below 0, as the tail source marks a file that is begun anew, stays though it has no value.
    """
    mark = F.col(place) < 0
    parsed = lines.where(mark | not_bulky()).withColumn("value", F.try_parse_json("value")).where(mark | F.col("value").isNotNull())
    return parsed.withColumn("seq", F.col(place).cast("long"))


def tree_logs(spark: SparkSession, root: str) -> DataFrame:
    """Raw records of ``<root>/<project>/<session>.jsonl`` and of its ``subagents``, with session_key, project and parent_id."""
    return tree_records(raw_records(read_lines(spark, root)))


def tree_records(records: DataFrame) -> DataFrame:
    """Records (file, ...) with what their path tells: session_key, project, parent_id and is_subagent."""
    sub = F.regexp_extract("file", r"/([^/]+)/([^/]+)/subagents/([^/]+)\.jsonl$", 2)
    project = F.coalesce(F.nullif(F.regexp_extract("file", r"/([^/]+)/[^/]+/subagents/[^/]+$", 1), F.lit("")), F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))
    key = F.regexp_extract("file", r"/([^/]+)\.jsonl$", 1)
    return records.withColumns({"session_key": key, "project": project, "parent_id": F.nullif(sub, F.lit("")), "is_subagent": sub != ""})


def rollout_logs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Raw records of ``rollout-<time>-<uuid>.jsonl`` files below live and archived roots; a file's records come once."""
    records = None
    for root in roots:
        own = raw_records(read_lines(spark, root, "rollout-*.jsonl")).withColumn("_root", F.lit(roots.index(root)))
        records = own if records is None else records.unionByName(own)
    keyed = records.withColumn("session_key", rollout_key(F.col("file")))
    first = keyed.groupBy("session_key").agg(F.min("_root").alias("_first"))
    return keyed.join(first, "session_key").where("_root = _first").drop("_root", "_first")


def rollout_key(path: Column) -> Column:
    """The thread id at the end of a rollout's file name; without one the name."""
    key = F.regexp_extract(path, r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    return F.when(key != "", key).otherwise(F.regexp_extract(path, r"([^/]+)\.jsonl$", 1))


def rollout_paths(live: DataFrame, archived: DataFrame, named: DataFrame) -> DataFrame:
    """(path, session_key, archived) of rollouts below both roots or named by a thread table, each path once."""
    every = distinct_paths([live, archived, named], "path")
    old = archived.select("path", F.lit(True).alias("archived")).distinct()
    return every.join(old, "path", "left").select("path", rollout_key(F.col("path")).alias("session_key"), F.coalesce("archived", F.lit(False)).alias("archived"))


def export_logs(spark: SparkSession, root: str) -> DataFrame:
    """Raw records of ``<project>/agent-transcripts/<id>/<id>.jsonl``."""
    records = raw_records(read_lines(spark, root)).where(F.col("file").contains("/agent-transcripts/"))
    return records.withColumn("session_key", F.regexp_extract("file", r"/([^/]+)\.jsonl$", 1))


def custom_names(spark: SparkSession, path: str) -> DataFrame:
    """(key, name) of a JSON object of names; values that are no text, or blank, are dropped."""
    return named_entries(spark.read.option("wholetext", "true").text(path))


def named_entries(whole: DataFrame) -> DataFrame:
    """The entries of JSON objects (value)."""
    entries = F.explode(F.map_entries(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")))
    rows = whole.select(entries.alias("e")).select("e.key", F.col("e.value").alias("v"))
    text = rows.where(F.schema_of_variant("v") == "STRING").select("key", F.trim(F.try_variant_get("v", "$", "string")).alias("name"))
    return text.where("name != ''")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(folder, title, cwd, created_ms, updated_ms) of ``meta.json`` files below a root."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").text(root)
    value = F.try_parse_json("value")
    get = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    return whole.select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1).alias("folder"), get("title", "string").alias("title"), get("cwd", "string").alias("cwd"), get("createdAtMs", "long").alias("created_ms"), get("updatedAtMs", "long").alias("updated_ms"))


def plain_or_hex(text: Column) -> Column:
    """The VARIANT of a JSON text, or of one given as hex digits."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.decode(F.when(text.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(text)), "UTF-8")))


def last_workspace(log: Column) -> Column:
    """The last ``workspacePath=`` of a log's text."""
    return F.element_at(F.regexp_extract_all(log, F.lit(r"workspacePath=(\S+)"), F.lit(1)), -1)
