"""Session settings and the two helpers every wide step uses."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # state of streams on the executors' disks, not in their heaps
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # building a plan of many expressions is slow while each call looks up its place in the source
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session_builder(app_name: str = "wardlake", **conf: str) -> SparkSession.Builder:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used with a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="wardlake-")
    spark.sparkContext.setCheckpointDir(local)
    return local


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds while a write runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder.

    Used where several branches read one expensive result: the corpus is then
    scanned once, lost executors cost no rescan, and the readers prune columns.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    table = spark.read.schema(df.schema).parquet(target)
    table.stored_at = target
    return table


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin meanwhile remove their shuffle files as they end, not when the driver collects its garbage."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def _delete(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` stored, when nothing will read them any more."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def released(*tables: DataFrame) -> None:
    """The same, as soon as no variable holds the table any more."""
    for table in tables:
        weakref.finalize(table, _delete, table.sparkSession, table.stored_at).atexit = False


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[Column],
    salts: int = 16,
) -> DataFrame:
    """Join a large, possibly skewed side with a much smaller one.

    A hot key's left rows go to ``salts`` tasks instead of one; each right row is
    repeated ``salts`` times. Whether the right side is broadcast instead is left to
    Spark, which checks its size.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
