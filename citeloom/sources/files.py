"""Files through Hadoop's file systems: any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, by name, or the file itself."""
    place, system = _at(spark, path)
    if system.getFileStatus(place).isFile():
        return [path]
    found = [f.getPath() for f in system.listStatus(place) if f.isFile() and f.getLen() > 0]
    return sorted(str(f.toString()) for f in found if f.getName()[0] not in "_.")


def first_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes:
    """The first bytes of a file, or of a folder's first data file; no more of it is read."""
    files = data_files(spark, path)
    if not files:
        return b""
    place, system = _at(spark, files[0])
    stream = system.open(place)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, deleted when the JVM ends. Where the session names none,
    one machine alone (a local master, as in tests) gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place, system = _at(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path
