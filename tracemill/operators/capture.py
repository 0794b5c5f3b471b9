"""Audit of append-only files: line diffs, change classes, gaps, hash chains, comparison."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.sets import surplus


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line): a trailing line feed makes no last empty line; an empty text has none."""
    cut = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n\\z", "")
    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\n", -1))
    return df.select(key, F.posexplode(lines).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def line_diff(captured: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """U4: (key, side, line_no, line): ``missing`` lines of the capture, ``extra`` ones of the live file, by multiset."""
    missing = surplus(captured, live, [key], "line", "line_no").withColumn("side", F.lit("missing"))
    extra = surplus(live, captured, [key], "line", "line_no").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def diff_tally(captured: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Per key, lines of both sides, missing, extra, the common prefix and the first line that differs (null if none)."""
    both = captured.select(key, "line_no", F.col("line").alias("_a")).join(live.select(key, "line_no", F.col("line").alias("_b")), [key, "line_no"], "full")
    first = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("line_no")))
    counts = both.groupBy(key).agg(F.count("_a").alias("n_captured"), F.count("_b").alias("n_live"), first.alias("first_diff_line"))
    sides = line_diff(captured, live, key).groupBy(key).agg(F.count_if(F.col("side") == "missing").alias("n_missing"), F.count_if(F.col("side") == "extra").alias("n_extra"))
    out = counts.join(sides, key, "left").na.fill(0, ["n_missing", "n_extra"])
    prefix = F.when(F.col("first_diff_line").isNull(), F.least("n_captured", "n_live")).otherwise(F.col("first_diff_line") - 1)
    return out.withColumn("n_common_prefix", prefix.cast("long"))


def change_class(before: dict[str, Column], now: dict[str, Column]) -> Column:
    """What became of a file between two snapshots (identity, size, prefix_same: the old bytes begin the new ones).

    In this order: another identity with all old bytes kept is ``inode_changed``, any other ``replaced``; without
    an open capture ``started`` if there are bytes, else ``empty``; smaller is ``truncated``; other bytes within the old
    length ``rewritten``; more bytes ``appended``; else ``same``.
    """
    moved = ~before["identity"].eqNullSafe(now["identity"])
    same = F.coalesce(now["prefix_same"], F.lit(False))
    return (
        F.when(before["size"].isNotNull() & moved, F.when(same & (now["size"] >= before["size"]), "inode_changed").otherwise("replaced"))
        .when(before["size"].isNull() | (before["size"] == 0), F.when(now["size"] > 0, "started").otherwise("empty"))
        .when(now["size"] < before["size"], "truncated")
        .when(~same, "rewritten")
        .when(now["size"] > before["size"], "appended")
        .otherwise("same")
    )


def classify_snapshots(snapshots: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Snapshots (path, identity, size, prefix_same) with change, each against the one before at its path."""
    window = Window.partitionBy(path).orderBy(*order)
    before = {c: F.lag(c).over(window) for c in ("identity", "size")}
    return snapshots.withColumn("change", change_class(before, {c: F.col(c) for c in ("identity", "size", "prefix_same")}))


def deletions(polls: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """T4: files (by..., path, last_seen) missing for one whole poll after the first that missed them, with deleted_at.

    polls (by..., t) as they ran, for each source; a file was last seen by the poll at last_seen. So the polls are
    numbered once, and the second after it is found by its number.
    """
    numbered = polls.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    seen = files.join(numbered.select(*by, F.col("t").alias("last_seen"), (F.col("_n") + 2).alias("_n")), [*by, "last_seen"])
    return seen.join(numbered.select(*by, "_n", F.col("t").alias("deleted_at")), [*by, "_n"]).select(*by, "path", "last_seen", "deleted_at")


def reconciled(recorded: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Recorded links (key, link, end, head) of a chain, and after them those of the bytes that lie beyond its last one.

    actual: ``chain_links`` over all bytes there are. Links are added only where the last recorded one is among the
    actual ones; a chain that differs is left as it is, for ``verify_chain`` to tell.
    """
    last = recorded.groupBy(key).agg(F.max_by(F.struct("link", "end", "head"), "link").alias("_l"))
    sound = last.join(actual.select(key, F.col("link").alias("_k"), F.col("end").alias("_e"), F.col("head").alias("_h")), key).where("_l.link = _k and _l.end = _e and _l.head = _h").select(key, "_k")
    more = actual.join(sound, key).where("link > _k").select(key, "link", "end", "head", F.lit(True).alias("added"))
    return recorded.select(key, "link", "end", "head", F.lit(False).alias("added")).unionByName(more)


def downtime_gaps(beats: DataFrame, by: list[str], t: str, order: list[str], most: Column) -> DataFrame:
    """T5: (by..., gap_start, gap_end): neighbouring heartbeats further apart than ``most`` seconds."""
    window = Window.partitionBy(*by).orderBy(*order)
    df = beats.withColumn("gap_start", F.lag(t).over(window)).withColumnRenamed(t, "gap_end")
    apart = F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))
    return df.where(apart > most.cast("long") * 1_000_000).select(*by, "gap_start", "gap_end")


def access_changes(polls: DataFrame, by: list[str], order: list[str], ok: str) -> DataFrame:
    """Polls where a source was lost or restored, against the poll before; a first poll counts if it failed."""
    before = F.lag(ok, 1, True).over(Window.partitionBy(*by).orderBy(*order))
    df = polls.withColumn("_before", before).where(F.col("_before") != F.col(ok))
    return df.withColumn("change", F.when(F.col(ok), "access_restored").otherwise("access_lost")).drop("_before")


def chain_links(chunks: DataFrame, key: str, order: str, data: str, seed: Column) -> DataFrame:
    """(key, link from 1, end, head): the hash chain over a generation's chunks, each head over all bytes before it.

    A chain is sequential, so each sorted partition is scanned once, a batch at a time, holding one head; generations spread
    over tasks. seed is an expression over the key.
    """
    kind = dict(chunks.dtypes)[key]
    rows = chunks.select(key, order, F.col(data).cast("binary").alias("_data"), seed.alias("_seed"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, end, link = None, b"", 0, 0
        for batch in batches:
            out = [[], [], [], []]
            for k, chunk, first in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if k != now or not link:
                    now, head, end, link = k, bytes.fromhex(first.as_py()), 0, 0
                chunk = chunk.as_py() or b""
                head, end, link = hashlib.sha256(head + chunk).digest(), end + len(chunk), link + 1
                for column, x in zip(out, (k, link, end, head.hex()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], [key, "link", "end", "head"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(scan, f"`{key}` {kind}, link int, end long, head string")


def verify_chain(recorded: DataFrame, actual: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Per key, the state of recorded links (link, end, head) against ``chain_links`` and the bytes there are (size).

    ``malformed`` heads, ``short`` data, ``mismatch``, ``uncovered`` bytes past the last link, or ``ok``; the first that holds.
    """
    a = actual.select(key, "link", F.col("end").alias("_end"), F.col("head").alias("_head"))
    both = recorded.join(a, [key, "link"], "left").join(sizes, key, "left")
    bad = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    state = (
        F.when(bad(~F.coalesce(F.col("head").rlike("^[0-9a-f]{64}$"), F.lit(False))), "malformed")
        .when(bad(F.col("end") > F.coalesce("size", F.lit(0))), "short")
        .when(bad(~F.col("head").eqNullSafe(F.col("_head")) | ~F.col("end").eqNullSafe(F.col("_end"))), "mismatch")
        .when(F.max("end") < F.max("size"), "uncovered")
        .otherwise("ok")
    )
    return both.groupBy(key).agg(state.alias("state"), F.count("*").alias("n_links"))


def compare_state(captured: Column, live: Column) -> Column:
    """What a live text is to its capture: untracked, deleted, verified, ahead or modified."""
    return (
        F.when(captured.isNull(), "untracked").when(live.isNull(), "deleted").when(live == captured, "verified")
        .when(F.startswith(live, captured), "ahead").otherwise("modified")
    )


def explained(pairs: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Closed generations (key, gen, next_gen) with the lines that the next one misses and adds; lines by (key, gen)."""
    name = lambda gen: F.concat_ws("/", key, gen)
    old = pairs.join(lines, [key, "gen"]).select(name("gen").alias("pair"), "line_no", "line")
    new = pairs.select(key, "gen", F.col("next_gen").alias("_g")).join(lines.withColumnRenamed("gen", "_g"), [key, "_g"]).select(name("gen").alias("pair"), "line_no", "line")
    return line_diff(old, new, "pair").groupBy("pair").agg(F.count_if(F.col("side") == "missing").alias("n_missing"), F.count_if(F.col("side") == "extra").alias("n_extra"))


def edit_delta(edits: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_added, n_removed): lines that an edit's two snapshots have beyond each other, by multiset; both 0 without a change."""
    diff = line_diff(lines_of(edits, key, before), lines_of(edits, key, after), key).groupBy(key).agg(F.count_if(F.col("side") == "extra").alias("n_added"), F.count_if(F.col("side") == "missing").alias("n_removed"))
    return edits.select(key).join(diff, key, "left").na.fill(0, ["n_added", "n_removed"])


def generations(changes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, generation, at): how often a document's fingerprint has changed, and where last; changes (key, order, fingerprint)."""
    before = F.lag("fingerprint").over(Window.partitionBy(key).orderBy(order))
    moved = changes.withColumn("_new", ~before.eqNullSafe(F.col("fingerprint")) | (F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1))
    return moved.groupBy(key).agg(F.count_if("_new").alias("generation"), F.max(F.when(F.col("_new"), F.col(order))).alias("at"))


def alive(status: DataFrame, now: Column, stale: int = 30) -> DataFrame:
    """Status (last_poll) with running: a heartbeat of at most ``stale`` seconds ago."""
    return status.withColumn("running", now.cast("timestamp").cast("double") - F.col("last_poll").cast("timestamp").cast("double") <= stale)


def capture_index(events: DataFrame) -> DataFrame:
    """Per key of events (key, t, type), the latest state, its flags and how many generations it has had."""
    flags = ("truncated", "rewritten", "replaced", "deleted", "recreated")
    state = F.max_by(F.when(F.col("type") == "deleted", "deleted").otherwise("active"), "t")
    return events.where("key is not null").groupBy("key").agg(
        state.alias("status"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("type").isin(*flags), F.col("type")))), ",").alias("flags"),
        (F.lit(1) + F.count_if(F.col("type").isin("truncated", "rewritten", "replaced"))).alias("n_generations"),
    )
