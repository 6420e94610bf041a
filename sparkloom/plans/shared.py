"""Intermediate results in the shared folder, and sizes from plan statistics."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of one row a key up to which it is broadcast, by count.
MAX_BROADCAST_ROWS = 200_000
#: Bytes of its files up to which such a table is (long texts make few rows large).
MAX_BROADCAST_BYTES = 16 << 20
#: Rows of one key from which the key's rows are joined without a shuffle.
HOT_ROWS = 1_000
#: Seconds between two collections of garbage on the driver, which let go of the shuffle files of plans that are over.
GC_SECONDS = 10.0
_last_gc = [0.0]


def folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, where it is unset and the master local (tests), one made here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            at = have.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all machines share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
            spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again.

    Cuts the lineage, so a lost executor costs no more than the stages after it.  Spark deletes the
    shuffle files of what led here when the driver collects its garbage, which is asked for now and
    then.  Tables go when the application ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/sparkloom/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    del df
    atexit.register(_remove, spark, path)
    if time.monotonic() - _last_gc[0] > GC_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _last_gc[0] = time.monotonic()
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the application has ended already
        return


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the input as Spark's plan statistics estimate them (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` bytes, and no fewer than the session's shuffle partitions.

    Spark gives a plan of unknown size (rows made in the program) an absurd one; those get the session's number.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, size // each + 1)) if size < 1 << 55 else least


def is_small(table: DataFrame, most: int | None = None) -> bool:
    """Whether a written table may be broadcast, by the size of its files and its rows."""
    return plan_bytes(table) <= MAX_BROADCAST_BYTES and table.count() <= (MAX_BROADCAST_ROWS if most is None else most)


def by_rows(table: DataFrame) -> DataFrame:
    """The table as a side of a join: broadcast while it has few rows by count, else sorted.  Spark by itself goes by the bytes of compressed files, and broadcasts what is many times larger on the driver."""
    return F.broadcast(table) if is_small(table) else table.hint("merge")


def join_by_size(big: DataFrame, small: DataFrame, keys: list[str], size: str, what: str = "sizes") -> DataFrame:
    """big inner-joined with small, which has one row a key and in ``size`` the key's rows in big; no key's rows meet in one task.

    A small table of few rows is broadcast.  Of a larger one only the keys of most rows are
    (``MAX_BROADCAST_ROWS`` of them at most); those left have 1 / MAX_BROADCAST_ROWS of all rows
    or ``HOT_ROWS`` each at most, and are shuffled.
    """
    small = written(small, what)
    if is_small(small):
        return big.join(F.broadcast(small.drop(size)), keys)
    hot = written(small.where(F.col(size) > HOT_ROWS).orderBy(F.desc(size), *keys).limit(MAX_BROADCAST_ROWS), f"hot-{what}")
    few = F.broadcast(hot.select(*keys))
    rest = big.join(few, keys, "left_anti").join(small.join(few, keys, "left_anti").drop(size).hint("merge"), keys)
    return big.join(F.broadcast(hot.drop(size)), keys).unionByName(rest.select(*big.columns, *[c for c in small.columns if c not in (*keys, size)])) if not hot.isEmpty() else rest


def dealt_join(a: DataFrame, b: DataFrame, keys: list[str], by: str, parts: int = 16) -> DataFrame:
    """a inner-joined with b on keys of few values: a's rows of a key are dealt to so many tasks by a hash of column ``by``, each of which gets all of b's.

    Statistics don't see that b is taken ``parts`` times, so neither side is left to Spark to broadcast.
    """
    left = a.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    right = b.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right.hint("merge"), [*keys, "__part"]).drop("__part")
