"""Lineage cuts that survive a lost executor.

A cut writes the frame as Parquet below ``spark.checkpoint.dir`` (the folder all executors share) and reads it
back: smaller than an RDD checkpoint, and later readers still prune its columns.  What is written is removed when the
session ends.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on one machine, if none is set, a temporary folder of the session.

    Executors on other machines don't see such a folder, so there the setting is required.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which exists and is removed when the session's JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


_turn = 0


def forget() -> None:
    """Compute anew what ``compute_or_load`` stored so far."""
    global _turn
    _turn += 1


def compute_or_load(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written the first time and read by later queries of the session over the same inputs.

    It is found by a fingerprint of its name and of each input's path, size, number of files and time of change, so a
    changed input is computed anew, and so is what a failed write left.
    """
    there = [spark.sparkContext.applicationId, str(_turn), name]
    for path in inputs:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = store.getContentSummary(hadoop)
        there += [path, str(size.getLength()), str(size.getFileCount()), str(store.getFileStatus(hadoop).getModificationTime())]
    at = f"{shared_dir(spark)}/tessella-{name}-{hashlib.sha256(chr(0).join(there).encode()).hexdigest()[:32]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
        until_exit(spark, at)
    return spark.read.parquet(at)


def fits(df: DataFrame, rows: int, mb: int = 32) -> bool:
    """Whether ``df`` has at most ``rows`` rows, whose texts and lists take at most ``mb`` MB: what a driver can broadcast.

    It goes by the rows themselves, since the planner's estimate is that of a compressed file.
    """
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    sizes = df.select(sum(wide, F.lit(0).cast("long")).alias("size")).limit(rows + 1)
    n, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= rows and size <= mb * 1_000_000


def broadcast_up_to(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows and ``fits``; else to be joined by a shuffle."""
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def task_count(spark: SparkSession) -> int:
    """Tasks for work that is heavy per row, so that small data still keeps every core busy."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
