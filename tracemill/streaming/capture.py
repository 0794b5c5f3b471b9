"""Change capture as a stream of snapshots (T2-T4, T16): keyed state instead of a window over the past."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "identity long, size long, generation long"
#: Rows of a frame that is given back.
FRAME = 10_000
EVENTS = "path string, event_id long, change string, generation long"


def change_of(old: tuple | None, identity: int, size: int, same: bool) -> str:
    """What became of a file, by the rules of ``operators.capture.change_class``; old is its last identity and size."""
    if old is not None and old[0] != identity:
        return "inode_changed" if same and size >= old[1] else "replaced"
    if old is None or old[1] == 0:
        return "started" if size > 0 else "empty"
    if size < old[1]:
        return "truncated"
    if not same:
        return "rewritten"
    return "appended" if size > old[1] else "same"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get if state.exists else None
    generation = old[2] if old else 0
    # a path's rows of a micro-batch come in several frames, in any order: the order is over all of them
    whole = pd.concat(list(batches), ignore_index=True).sort_values("event_id")
    for at in range(0, len(whole), FRAME):
        rows = []
        for r in whole.iloc[at : at + FRAME].itertuples(index=False):
            change = change_of(old, r.identity, r.size, r.prefix_same)
            generation += change in ("truncated", "rewritten", "replaced", "started")
            old = (r.identity, r.size, generation)
            rows.append((key[0], r.event_id, change, generation))
        yield pd.DataFrame(rows, columns=["path", "event_id", "change", "generation"])
    if old:
        state.update(old)


def changes(snapshots: DataFrame) -> DataFrame:
    """(path, event_id, change, generation) of a stream of snapshots (path, event_id, identity, size, prefix_same).

    Each path's last state is kept between batches; snapshots of a path are taken in order of event_id within a batch.
    A path's snapshots of one batch are held in memory by the task that steps through them.
    """
    return snapshots.groupBy("path").applyInPandasWithState(_step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def _watched(grace: int):
    """One file's sightings: an event when none has come for ``grace`` milliseconds of event time, and one when it is found again."""

    def event(path: str, last: int, kind: str) -> pd.DataFrame:
        return pd.DataFrame([(path, last, kind)], columns=["path", "last_seen", "event"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gone = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((last, True))
            yield event(key[0], last, "deleted")
            return
        seen = [int(t) for batch in batches for t in batch["seen_ms"]]
        now = max([*seen, *([last] if last is not None else [])])
        if gone and now > last:
            yield event(key[0], now, "found")
            gone = False
        if now + grace > state.getCurrentWatermarkMs():
            state.update((now, gone))
            if not gone:
                state.setTimeoutTimestamp(now + grace)
        elif not gone:
            state.update((now, True))
            yield event(key[0], now, "deleted")

    return step


def deletions(sightings: DataFrame, grace: int, late: str = "0 seconds") -> DataFrame:
    """T4: (path, last_seen ms, event) of a stream of sightings (path string, seen timestamp): ``deleted`` when a timer of
    ``grace`` seconds, a whole poll after the first that missed the file, runs out by event time; ``found`` when it is back.

    A file's state is its last sighting and whether it is gone.
    """
    rows = sightings.withWatermark("seen", late).select("path", "seen", F.unix_millis("seen").alias("seen_ms"))
    return rows.groupBy("path").applyInPandasWithState(_watched(grace * 1000), "path string, last_seen long, event string", "last long, gone boolean", "append", GroupStateTimeout.EventTimeTimeout)


def uptimes(beats: DataFrame, by: list[str], t: str, most: str, late: str = "0 seconds") -> DataFrame:
    """T5: (by..., up_from, up_to) of a stream of heartbeats (by..., t timestamp): spells without a gap of more than ``most``.

    A spell is given once the watermark says that no heartbeat can prolong it; to be written in append mode.
    """
    spell = F.session_window(t, most).alias("_spell")
    return beats.withWatermark(t, late).groupBy(*by, spell).agg(F.min(t).alias("up_from"), F.max(t).alias("up_to")).drop("_spell")


def gaps_between(spells: DataFrame, by: list[str]) -> DataFrame:
    """T5: (by..., gap_start, gap_end) between a key's spells, as ``operators.capture.downtime_gaps`` gives them of single heartbeats."""
    before = F.lag("up_to").over(Window.partitionBy(*by).orderBy("up_from"))
    return spells.select(*by, before.alias("gap_start"), F.col("up_from").alias("gap_end")).where("gap_start is not null")
