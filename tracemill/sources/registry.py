"""All layouts under one name each (E1): a root of logs or stores to events, and several roots at once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.operators import records, sets
from tracemill.sources import jsonl, sqlite
from tracemill.sources.sqlite import Stores

#: By layout: events of all sessions below a root.
LAYOUTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tree": lambda spark, root: records.tree_events(jsonl.tree_logs(spark, root)),
    "rollouts": lambda spark, root: records.rollout_events(jsonl.rollout_logs(spark, [root])),
    "exports": lambda spark, root: records.export_events(jsonl.export_logs(spark, root)),
    "ide": lambda spark, root: records.bubble_events(*sqlite.ide_store(Stores.below(spark, root, "*.vscdb"))),
    "chats": lambda spark, root: records.blob_events(sqlite.blob_messages(Stores.below(spark, root, "store.db"))),
    "three": lambda spark, root: records.part_events(*sqlite.three_tables(Stores.below(spark, root))[1:]),
}


def all_events(spark: SparkSession, roots: dict[str, str], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Events of all layouts that can be read (origin names the layout), and what was wrong with the others.

    roots: by layout. keep: writes a source's events and reads them again, see ``sets.union_available``.
    """
    return sets.union_available({name: lambda name=name, root=root: LAYOUTS[name](spark, root) for name, root in roots.items()}, keep)
