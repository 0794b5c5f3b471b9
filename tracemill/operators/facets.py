"""Filters and orders of session lists."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import with_checkpoints

#: What a hit that only metadata gave counts.
METADATA_SCORE = 0.5


def in_set(column: str, values: list[str]) -> Column:
    """The column is one of the values; an empty set is no constraint."""
    return F.col(column).isin(*values) if values else F.lit(True)


def session_filter(agents=(), models=(), directories=(), first_day=None, last_day=None, flagged=False) -> Column:
    """All of the given constraints on sessions (agent, model, cwd, last_ts, flags); days are local and inclusive."""
    day = F.to_date("last_ts")
    out = in_set("agent", list(agents)) & in_set("model", list(models)) & in_set("cwd", list(directories))
    out = out & (day >= F.lit(first_day).cast("date")) if first_day else out
    out = out & (day <= F.lit(last_day).cast("date")) if last_day else out
    return out & flagged_capture() if flagged else out


def flagged_capture() -> Column:
    """A capture with flags, or of a deleted file."""
    return (F.size("flags") > 0) | (F.col("status") == "deleted")


def store_events(events: DataFrame) -> DataFrame:
    """Events of the whole store."""
    return events.where(F.col("key").isNull() & F.col("type").isin("capture_gap", "access_lost", "access_restored", "unreadable"))


def recency(last_ts: Column, mtime: Column) -> Column:
    """O1: seconds since the epoch of the last record, else of the file, else 0."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(last_ts)) / 1e6, mtime.cast("double"), F.lit(0.0))


def hierarchy(sessions: DataFrame) -> DataFrame:
    """O2: sessions (id, parent_id, is_subagent, recency) with nested and place, from 1: each child after its parent.

    A child whose parent is missing or itself a child has a place of its own. The places are one total order, which Spark
    makes by ranges of the sort key: numbering each range and adding what the ranges before it hold.
    """
    parents = sessions.where("not is_subagent").select(F.col("id").alias("_pid"), F.col("recency").alias("_pr"))
    joined = sessions.join(parents, F.col("parent_id") == F.col("_pid"), "left")
    nested = F.col("_pid").isNotNull()
    keyed = joined.withColumns({"nested": nested, "_top": F.coalesce("_pr", "recency"), "_id": F.coalesce("_pid", "id")}).drop("_pid", "_pr")
    return numbered(keyed, [F.col("_top").desc(), F.col("_id"), F.col("nested"), F.col("recency").desc(), F.col("id")], "place").drop("_top", "_id")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the row's number, from 1, in a total order, without one task holding all rows.

    The ranges are written once, as both their sizes and their rows are read.
    """
    with_checkpoints(df.sparkSession)
    counted = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counted = counted.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = counted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def relevance(*keys: str) -> list[Column]:
    """O3's order: best score first, then the earliest position, then keys."""
    return [F.col("score").desc(), F.col("position"), *map(F.col, keys)]


def relevance_and_age(*keys: str) -> list[Column]:
    """O4's order: by score, hits of metadata alone at a half, then the newest, then keys."""
    return [F.coalesce("score", F.lit(METADATA_SCORE)).desc(), F.col("mtime").desc(), *map(F.col, keys)]


def by_relevance(hits: DataFrame, *keys: str) -> DataFrame:
    """O3: best score first, then the earliest position, then by keys."""
    return hits.orderBy(*relevance(*keys))


def by_relevance_and_age(sessions: DataFrame, *keys: str) -> DataFrame:
    """Hits by score, those of metadata alone at a half, then the newest, then by keys."""
    return sessions.orderBy(*relevance_and_age(*keys))


def work_order(pending: DataFrame, mtime: str, key: str, size: int) -> DataFrame:
    """Sessions to index, the newest first, with their batch from 0 of ``size`` each."""
    placed = numbered(pending, [F.col(mtime).desc(), F.col(key)], "_n")
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def export_order(sessions: DataFrame, created: str, key: str) -> DataFrame:
    """Sessions with place, from 1, by the time of their creation, those without one first."""
    return numbered(sessions, [F.coalesce(created, F.lit(0)), F.col(key)], "place")
