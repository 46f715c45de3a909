"""Scratch space and small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, column: str, k: int) -> DataFrame:
    """At most k rows of df, those with the smallest hashes of a column: a bounded sample that any run draws alike.

    A cut at about four times the share needed comes first, so that no more than that is sorted or gathered, whatever the
    number of partitions.
    """
    share = min(1.0, 4 * k / max(df.count(), 1))
    h = F.xxhash64(column)
    near = df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return near.orderBy(F.pmod(h, F.lit(1 << 30)), h, column).limit(k)
