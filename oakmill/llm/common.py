"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can read.

    Only where the session names none (a local session, as in tests) is a folder of this machine
    used; a session of several machines without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"oakmill-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    It cuts the lineage as checkpoint() does, survives lost executors, and keeps columnar statistics
    and pruning for whatever reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*held: DataFrame) -> None:
    """Deletes what ``written`` wrote for these, once nothing that is still to be run reads it. Their plans go from the
    driver's memory too, and with them the shuffle files that only those could read."""
    for df in held:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release()
    if held:
        held[0].sparkSession.sparkContext._jvm.System.gc()


def whole_text(name: str = "text"):
    """The text column, a null counting as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``groups`` (unique keys, ``size``: how many of the ``total`` rows have the key).

    Groups above a ``share``-th of all rows, so fewer than ``share`` of them, are broadcast; in the join
    of the others no key has more rows than that.
    """
    limit = max(1, total // share)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    big = rows.join(F.broadcast(hot), keys)
    return big.unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, "left"))


def join_split(rows: DataFrame, side: DataFrame, key: str, other: str, counted: DataFrame, share: int = 1000, least: int = 1000) -> DataFrame:
    """``rows`` joined to ``side`` (unique ``key``), whose rows may be long.

    A key with more than a ``share``-th of all rows (and more than ``least``) is split: its rows are dealt to parts by a
    hash of ``other``, and its row of ``side`` is repeated for each part. That makes at most ``share`` repeats in all;
    fewer than ``share`` keys are broadcast, without their texts. ``counted`` has the keys of ``rows`` (a written table).
    """
    limit = max(least, counted.count() // share)
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    each = side.join(F.broadcast(hot), key, "left")
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(each, [key, "part"]).drop("part")


def release() -> None:
    """Gives freed memory back to the system. Python workers serve one task after the other, and what a big
    task leaves in the allocators would stay with the worker and add up with the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run):
    """A function over batches that gives back its memory when its task is done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
