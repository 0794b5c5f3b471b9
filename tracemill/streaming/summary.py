"""Incremental session summaries (T1) and refresh of a stored table."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracemill.sources.store import KeyedTable


def running_tallies(stream: DataFrame, by: list[str], column: str, values: list[str], record: str | None = None, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Per group, counts of some values so far; counts don't depend on the order in which records arrive.

    With ``record``, the column that tells records apart, a copy that comes within ``delay`` of the first by ``ts`` doesn't
    count again; what must be remembered for that is bounded by the delay.
    """
    if record is not None:
        stream = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([record])
    return stream.groupBy(*by).agg(F.count("*").alias("n_all"), *(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def run_available(counted: DataFrame, path: str, checkpoint: str, key: str) -> DataFrame:
    """Runs a stream over all that is there; each batch upserts the groups that it has changed into a table by ``key`` (S16). Returns the table."""
    spark, schema = counted.sparkSession, counted.schema

    def save(batch: DataFrame, _: int) -> None:
        KeyedTable(batch.sparkSession, path, key, schema).upsert(batch)

    counted.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return KeyedTable(spark, path, key, schema).read()


def refresh_every(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30) -> StreamingQuery:
    """Hands what has changed to ``refresh`` at most every so many seconds, each key's last row only."""

    def once(batch: DataFrame, number: int) -> None:
        refresh(batch.groupBy("file").agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*"), number)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
