"""The shared folder in which checkpoints cut lineage and stored tables lie."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, in local mode only, a temporary one for this process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own:
        _own["path"] = tempfile.mkdtemp(prefix="tracemill-shared-")
        atexit.register(shutil.rmtree, _own["path"], True)
    return f"file://{_own['path']}"


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder below the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return spark


def file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number and the text of the newest whole manifest of a folder; 0 and None without one."""
    fs, where = file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in fs.listStatus(where) if x.isFile()] if fs.exists(where) else []
    found = [int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit()]
    return (max(found), spark.read.text(f"{path}/manifest-{max(found)}").first()[0]) if found else (0, None)


def write_manifest(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Writes a folder's manifest, a file of one line: under another name first, so that it is there whole or not at all."""
    fs, Path = file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    part = Path(f"{path}/_writing-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(Path(f"{path}/manifest-{number}")) or not fs.rename(part, Path(f"{path}/manifest-{number}")):
        raise FileExistsError(f"manifest {number} of {path} was written by another")


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
