"""Comparison of captured and live bytes by digests of fixed blocks (T9): where two files begin to differ, without reading them whole."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block, and children of a node of the tree above them.
BLOCK, FANOUT = 1 << 16, 16


def blocks_of(df: DataFrame, key: str, data: str, size: int = BLOCK) -> DataFrame:
    """(key, block from 0, data) of values cut into blocks; an empty value has one empty block, a null none."""
    value = F.col(data).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(value) / size) - 1, F.lit(0))
    rows = df.where(F.col(data).isNotNull()).select(key, value.alias("_v"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    return rows.select(key, "block", F.expr(f"substring(_v, cast(block * {size} + 1 as int), {size})").alias("data"))


def file_blocks(files: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(key, block, data) of files (key, path, length) on a mounted file system, each block read in place, however large the file."""
    kind = dict(files.dtypes)[key]
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    rows = files.select(key, "path", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part, out = batch.slice(at, 64), []
                for path, block in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    with open(path, "rb") as file:
                        file.seek(block * size)
                        out.append(file.read(size))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.binary())], [key, "block", "data"])

    return rows.mapInArrow(read, f"`{key}` {kind}, block long, data binary")


def digest_levels(blocks: DataFrame, key: str, levels: int) -> list[DataFrame]:
    """Digests (key, at, digest) of blocks, then of every FANOUT of those in order, and so on: one frame a level, the root last."""
    out = [blocks.select(key, F.col("block").alias("at"), F.sha2("data", 256).alias("digest"))]
    for _ in range(levels):
        parent = F.floor(F.col("at") / FANOUT).cast("long")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        out.append(out[-1].groupBy(key, parent.alias("parent")).agg(F.sha2(joined.cast("binary"), 256).alias("digest")).withColumnRenamed("parent", "at"))
    return out


def compare_bytes(captured: DataFrame, live: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(key, state, captured_bytes, live_bytes, first_difference) of blocks (key, block, data), which both sides cut alike.

    ``untracked`` without a capture, ``deleted`` without a live file, ``verified`` when alike, ``ahead`` when the live one goes on after
    all that was captured, else ``modified``. first_difference is the first byte, from 0, that the two don't share, null when alike
    or alone. Trees of digests are walked from the roots, a narrow join a level; of two files that differ, one block each is read.
    """
    measured = lambda df, name: df.groupBy(key).agg(F.sum(F.octet_length("data")).alias(name), F.max("block").alias(f"_{name}"))
    sizes = measured(captured, "captured_bytes").join(measured(live, "live_bytes"), key, "full")
    most = sizes.agg(F.max(F.greatest("_captured_bytes", "_live_bytes"))).first()[0] or 0
    levels = 1
    while FANOUT**levels <= most:
        levels += 1
    ours, theirs = digest_levels(captured, key, levels), digest_levels(live, key, levels)
    differ = ours[-1].select(key, "at", F.col("digest").alias("_a")).join(theirs[-1].select(key, "at", F.col("digest").alias("_b")), [key, "at"]).where("_a != _b").select(key, "at")
    for a, b in zip(ours[-2::-1], theirs[-2::-1], strict=True):
        below = differ.select(key, F.explode(F.sequence(F.col("at") * FANOUT, F.col("at") * FANOUT + FANOUT - 1)).alias("at"))
        both = below.join(a.withColumnRenamed("digest", "_a"), [key, "at"], "left").join(b.withColumnRenamed("digest", "_b"), [key, "at"], "left")
        differ = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).groupBy(key).agg(F.min("at").alias("at"))
    block = lambda df, name: df.select(key, F.col("block").alias("at"), F.coalesce("data", F.lit(b"")).alias(name))
    pairs = differ.join(block(captured, "_x"), [key, "at"], "left").join(block(live, "_y"), [key, "at"], "left")
    shorter = F.least(F.coalesce(F.octet_length("_x"), F.lit(0)), F.coalesce(F.octet_length("_y"), F.lit(0)))
    spot = F.expr("try_element_at(filter(sequence(1, _n), i -> substring(_x, i, 1) != substring(_y, i, 1)), 1) - 1")
    first = pairs.withColumn("_n", shorter).select(key, (F.col("at") * size + F.when(F.col("_n") > 0, F.coalesce(spot, F.col("_n"))).otherwise(0)).alias("first_difference"))
    state = (
        F.when(F.col("captured_bytes").isNull(), "untracked").when(F.col("live_bytes").isNull(), "deleted").when(F.col("first_difference").isNull(), "verified")
        .when((F.col("first_difference") == F.col("captured_bytes")) & (F.col("live_bytes") > F.col("captured_bytes")), "ahead").otherwise("modified")
    )
    return sizes.join(first, key, "left").select(key, state.alias("state"), "captured_bytes", "live_bytes", "first_difference")
