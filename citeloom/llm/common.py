"""Shared helpers of the training-data operators: texts, shared scratch folders, materialised steps.

Nothing outside ``citeloom.llm`` imports this package.
"""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters (the same set ``bytes.split()`` uses).
SPACES = " \t\n\x0b\f\r"
#: Spark's own switch: an execution's shuffle files go when it ends; a stored step never needs them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as wanted (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names none, one machine alone (a local master, as in tests) gets a temporary
    folder; on a cluster that is an error. The folder goes when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession, wanted: int) -> int:
    """How many partitions to deal ``wanted`` parts of work to: the session's own number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, 50_000))


def size_of(df: DataFrame) -> int:
    """Spark's own estimate of a plan's bytes (for files, what they take), 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def tidy(go):
    """``go`` for mapInArrow; after a task's last batch its worker gives back the memory that it has no more
    use for, since workers live on from stage to stage beside those of the next operator."""

    def run(batches):
        yield from go(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


_lock, _inside, _before = threading.Lock(), 0, None


@contextmanager
def _own_shuffles_end(spark: SparkSession):
    """Executions that begin inside drop their shuffle files when they end. The switch is the session's:
    it is on while any step is being written and set back after the last; for another query that begins
    meanwhile it means no more than that its own shuffle files go as soon as it has ended."""
    global _inside, _before
    with _lock:
        if not _inside:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _inside += 1
    try:
        yield
    finally:
        with _lock:
            _inside -= 1
            if not _inside:
                spark.conf.set(CLEANUP, _before) if _before is not None else spark.conf.unset(CLEANUP)


def _place(spark: SparkSession, path: str):
    """A path and its file system, Hadoop's, wherever it lives."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``dropped`` deletes the step once nothing reads it any more; what is left goes when the JVM ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    with _own_shuffles_end(spark):
        df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Delete stored steps. Nothing may read them later: not a DataFrame that is still to run either."""
    for step in steps:
        place, system = _place(step.sparkSession, step._stored_at)
        system.delete(place, True)
