"""Window operators over the records of a session.

``by`` names the columns of a session, ``order`` those of the order within it. Nothing gathers a session into one
Python object but ``last_kept``, where keeping a value depends on what was kept before.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.checkpoints import with_checkpoints


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def file_sequence(lines: DataFrame) -> DataFrame:
    """``lines`` read with ``sources.jsonl.read_lines`` with seq, the line's number in its file from 0."""
    order = Window.partitionBy("file").orderBy("block_start", "position")
    return lines.withColumn("seq", F.row_number().over(order) - 1)


def consecutive_dedup(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(_over(by, order))
    first = F.row_number().over(_over(by, order)) == 1
    return df.withColumn("_same", ~first & before.eqNullSafe(F.col(value))).where("not _same").drop("_same")


def last_kept(df: DataFrame, by: list[str], order: list[str], value: str, depth: int = 8) -> DataFrame:
    """Rows whose value is not among the last ``depth`` kept values of the session.

    Sorted partitions are scanned a batch at a time; only ``depth`` values are held, however long a session is.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, kept = None, []
        for batch in batches:
            take = []
            for now, x in zip(batch[by].itertuples(index=False, name=None), batch[value], strict=True):
                if now != session:
                    session, kept = now, []
                fresh = x not in kept
                take.append(fresh)
                if fresh:
                    kept = [*kept[-(depth - 1) :], x] if depth > 1 else [x]
            yield batch[take]

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(scan, df.schema)


def mirrored_tuples(df: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """``df`` with mirrored, whether the row's k values up to it equal the k before those."""
    window = _over(by, order).rowsBetween(-(2 * k - 1), 0)
    df = df.withColumn("_last", F.collect_list(F.coalesce(F.col(value).cast("string"), F.lit("\0"))).over(window))
    same = F.when(F.size("_last") == 2 * k, F.slice("_last", 1, k) == F.slice("_last", k + 1, k)).otherwise(F.lit(False))
    return df.withColumn("mirrored", same).drop("_last")


def fill_forward(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, up to the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def fill_backward(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The next value that is not null, from the row on."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(_over(by, order).rowsBetween(0, Window.unboundedFollowing)))


def turn_segments(df: DataFrame, by: list[str], order: list[str], kind: str) -> DataFrame:
    """Anchors, starts and ends with their segment from 0.

    kind is ``anchor``, ``started``, ``complete`` or ``aborted``; other rows are left out. A start opens a segment if the
    row before it is an anchor; a row after an end opens one too.
    """
    df = df.where(F.col(kind).isin("anchor", "started", "complete", "aborted"))
    before = F.lag(kind).over(_over(by, order))
    opens = ((F.col(kind) == "started") & (before == "anchor")) | before.isin("complete", "aborted")
    return df.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("segment", F.sum("_opens").over(_over(by, order))).drop("_opens")


def run_groups(df: DataFrame, by: list[str], order: list[str], kind: str, alone: list[str]) -> DataFrame:
    """``df`` with run (numbered from 0) and mark: start, mid, end or single.

    Neighbours of one kind form a run; kinds in ``alone`` never group.
    """
    window = _over(by, order)
    joins = F.coalesce((F.lag(kind).over(window) == F.col(kind)) & ~F.col(kind).isin(*alone), F.lit(False))
    df = df.withColumn("_joins", joins).withColumn("_next", F.coalesce(F.lead("_joins").over(window), F.lit(False)))
    mark = F.when(F.col("_joins") & F.col("_next"), "mid").when(F.col("_joins"), "end").when(F.col("_next"), "start").otherwise("single")
    return df.withColumn("run", F.sum((~F.col("_joins")).cast("long")).over(window) - 1).withColumn("mark", mark).drop("_joins", "_next")


def keep_earliest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of equal ``by``; long texts in ``by`` are grouped by a hash of 128 bits, and rows tied in ``order`` by all columns."""
    hashes = [F.xxhash64(*by).alias("_h"), F.xxhash64(F.lit(1), *by).alias("_g")]
    first = F.min_by(F.struct(*df.columns), F.struct(*order, *(c for c in df.columns if c not in order and c not in by)))
    return df.groupBy(*hashes).agg(first.alias("_row")).select("_row.*")


def occurrences(df: DataFrame, by: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """``df`` with the number, from 1, of the row among those of equal ``by``."""
    return df.withColumn(name, F.row_number().over(_over(by, order)))


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the row's number, from 0, among those of equal ``by``, where a group may be too large for one task.

    Keys alone are dealt by ranges and written once; a range numbers its own rows and adds what the ranges before it hold
    of the group. The number then meets the row by its keys, which must tell rows apart.
    """
    with_checkpoints(df.sparkSession)
    keys = [*by, *order]
    dealt = df.select(*keys).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = local.join(sizes.select("_part", *by, before.alias("_before")), ["_part", *by]).select(*keys, (F.col("_before") + F.col("_local")).alias(name))
    return df.join(placed, keys)


def beyond_mirrors(rows: DataFrame, mirrors: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows in excess of the number of mirrors with the same ``by``."""
    counts = mirrors.groupBy(*by).agg(F.count("*").alias("_mirrors"))
    numbered = occurrences(rows, by, order, "_n").join(counts, by, "left")
    return numbered.where(F.col("_n") > F.coalesce("_mirrors", F.lit(0))).drop("_n", "_mirrors")


def first_prompt(df: DataFrame, by: list[str], order: str, text: str, fine: Column, name: str = "first_prompt") -> DataFrame:
    """Per session, the first text that qualifies."""
    return df.groupBy(*by).agg(F.min_by(F.when(fine, F.col(text)), F.when(fine, F.col(order))).alias(name))


def outline(df: DataFrame, by: list[str], order: list[str], text: str, top: Column, most: int = 80) -> DataFrame:
    """Top-level prompts numbered from 1, with a label of ``most`` characters."""
    rows = df.where(top)
    label = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
    return rows.withColumn("number", F.row_number().over(_over(by, order))).withColumn("label", label)


def best_generation(generations: DataFrame, key: str, size: str, index: str) -> DataFrame:
    """The largest generation of each capture, the earliest of equals."""
    order = Window.partitionBy(key).orderBy(F.col(size).desc(), F.col(index))
    return generations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def version_changes(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows where the values together differ from the row before; a session's first row is one."""
    now = F.struct(*values)
    before = F.lag(now).over(_over(by, order))
    return df.withColumn("_changed", ~before.eqNullSafe(now)).where("_changed").drop("_changed")


def generation_pairs(generations: DataFrame, key: str, index: str, columns: list[str]) -> DataFrame:
    """Each generation with what follows it, as next_*; the last has none."""
    window = Window.partitionBy(key).orderBy(index)
    return generations.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).where(F.col(f"next_{index}").isNotNull() if index in columns else F.lit(True))


def first_and_last(df: DataFrame, by: list[str], order: str, first: list[str], last: list[str]) -> DataFrame:
    """Per session, the first value of some columns and the last of others, nulls left out."""
    when = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return df.groupBy(*by).agg(*(F.min_by(c, when(c)).alias(f"first_{c}") for c in first), *(F.max_by(c, when(c)).alias(f"last_{c}") for c in last))
