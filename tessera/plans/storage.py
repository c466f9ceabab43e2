"""Intermediate tables in a folder that every executor reaches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST = 200_000  # rows of two or three numbers that may be broadcast

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all
    executors are in this process (tests). On a cluster each would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own[0]


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is put there goes when the application ends, or at ``clear``."""
    if not _made:
        atexit.register(clear)
    path = f"{shared_folder(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` and reads it back, so that its lineage ends in files that outlive
    executors. They go when the application ends, or at ``clear``. The rows are counted
    as they are written; see ``rows``. With ``by``, a filter on that column reads the
    files of its value only."""
    spark = df.sparkSession
    path = folder(spark, tag)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = seen.get["rows"]
    return out


def rows(written: DataFrame) -> int:
    """The rows of a table that ``cut`` returned."""
    return written._rows


def small_enough(written: DataFrame, most: int = BROADCAST) -> DataFrame:
    """The written table, marked for broadcast if it has ``most`` rows at most; else as
    it is, and joined by shuffling."""
    return F.broadcast(written) if rows(written) <= most else written


def clear() -> None:
    """Deletes the tables written so far; results that read them end with that."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the application may have ended
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a file with this text at ``path``, whole or not at all; False if there is one
    already. The text goes to a file of its own, which is then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(conf)
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(own, to, options)
        return True
    except Exception as e:
        fs.delete(own, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Names of the files that ``publish`` put into a folder, with their paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {n: f"{path}/{n}" for n in names if not n.endswith((".tmp", ".crc"))}


def read_text(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(x & 0xFF for x in stream.readAllBytes()).decode()
    finally:
        stream.close()


def subfolders(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the folders in a folder, with the milliseconds of their last change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at) if s.isDirectory()}


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
