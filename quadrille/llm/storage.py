"""Shared storage for intermediate tables, and joins whose small side is broadcast only behind a check of its size."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a new temporary one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_ending: set[str] = set()


def _tables(spark: SparkSession) -> str:
    """The application's folder for stored tables; it goes when the driver's Python ends, with all that a lazy result still read."""
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _ending:
        _ending.add(folder)
        atexit.register(_emptied, spark.sparkContext._jvm, folder)
    return folder


def _emptied(jvm, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone; nothing else depends on it
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: it cuts lineage and survives lost executors.

    The table stays until ``drop_stored``, or until the driver's Python ends.
    """
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of at most a few dozen bytes that may be broadcast: tens of MB.
BROADCAST_ROWS = 500_000


def bounded(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is, for a shuffle join."""
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side
