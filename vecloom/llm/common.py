"""Helpers that the operators share: reading tables, shared scratch tables, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a class for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: A written table replaces what its making shuffled; texts go to Python in small batches.
_WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. One of our own is set only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vecloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables written as Parquet in the shared folder, to cut lineage.

    Parquet in shared storage survives the loss of any executor, is columnar
    and compressed, and gives the planner true sizes. ``drop`` frees a table as
    soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vecloom/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = {k: conf.get(k, None) for k in _WHILE_SAVING}
        for k, v in _WHILE_SAVING.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def keep(self, name: str) -> None:
        """Free every table but one."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for entry in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
            if entry.getPath().getName() != name:
                _delete(self.spark, entry.getPath().toString())

    def close(self) -> None:
        _delete(self.spark, self.root)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join with the right side broadcast only if it was counted and has at most ``rows`` rows; else by shuffle."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def uniform_key(seed: int, *cols: Column) -> Column:
    """A 64-bit pseudo-random key that depends on values only, so that reruns agree."""
    return F.xxhash64(F.lit(seed), *cols)


CLASHES_TO_BROADCAST = 200_000


def clashes(df: DataFrame) -> DataFrame | None:
    """The values of ``cid`` that stand for several values of ``check``, or None if there are none."""
    apart = df.groupBy("cid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("cid", F.lit(True).alias("_clash"))
    return apart if apart.limit(1).count() else None


def settled(df: DataFrame, apart: DataFrame | None) -> DataFrame:
    """``df`` with a ``cid`` of its own for each ``check``: 64-bit hashes identify only together with another 64 bits."""
    if apart is None:
        return df
    own = F.when(F.col("_clash"), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
    return join_bounded(df, apart, "cid", "left", CLASHES_TO_BROADCAST).withColumn("cid", own).drop("_clash").select(*df.columns)
