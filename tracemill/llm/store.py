"""Tables that cut lineage, in the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own:
        _own["path"] = tempfile.mkdtemp(prefix="tracemill-")
        atexit.register(shutil.rmtree, _own["path"], True)
    return f"file://{_own['path']}"


#: Folders that this process has written and not deleted yet, in order.
_written: list[str] = []


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared one."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there goes with ``scratch`` or at the end of the process."""
    if not _written:
        atexit.register(_leave)
    _written.append(f"{shared_folder(spark)}/tracemill/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _leave() -> None:
    """Deletes what is left, while the JVM still answers."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            deleted(spark, *_written)
    except Exception:  # the process ends: what can't be deleted now is left to the folder's owner
        _written.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Within it, tables may be stored; at its end all are deleted but those handed to the function that it yields."""
    before, kept = set(_written), []
    yield kept.append
    deleted(spark, *(p for p in list(_written) if p not in before and p not in {df._tracemill_path for df in kept}))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: later stages, and retries after a lost executor, start there.

    The files stay in the shared folder until ``dropped`` is called, a ``scratch`` ends, or the process does.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracemill_path = path
    return back


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within it, jobs hand Python so many rows at a time at most: rows that hold a block each are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        deleted(df.sparkSession, df._tracemill_path)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
