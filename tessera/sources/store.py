"""Measurement tables on shared storage: wide rows, commits and what is pending.

Data goes first, the commit row last; a reader sees committed keys only. Columns may differ from write to write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import content_key

PROVENANCE = ["program", "firmware", "analyzer", "source", "state_index", "stimulus", "settle_frames"]
PARAMS = [f"p{i}" for i in range(1, 13)]
SCHEMA_VERSION = 1


def wide(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Records with `params` (array of 12) and `metrics` (map) as one column a value; an absent metric is null."""
    return records.select(*PROVENANCE, *[F.get("params", F.lit(i)).alias(c) for i, c in enumerate(PARAMS)], *[F.col("metrics").getItem(m).alias(m) for m in metrics])


def narrow(rows: DataFrame) -> DataFrame:
    """Inverse of wide: every other column that is not null is a metric."""
    names = [c for c in rows.columns if c not in PROVENANCE and c not in PARAMS]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in names]), lambda x: x["v"].isNotNull())
    return rows.select(*PROVENANCE, F.array(*PARAMS).alias("params"), F.map_from_entries(pairs).alias("metrics"))


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Union over differing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class ResultStore:
    """Results under one folder: data/ partitioned by program and key, commits/ as a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame:
        kind = "program string, key string, rows long, schema_version int, at timestamp"
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/commits")
        except AnalysisException:  # nothing is committed yet
            return self.spark.createDataFrame([], kind)

    def put(self, rows: DataFrame, *, firmware: str = "firmware") -> None:
        """Write the rows of each program under its key, then commit the key; what lay under the key before is replaced.

        So a run that ended between data and commit, and is repeated, leaves its rows once. Rows without any are an error; a
        program without rows is not committed. The commit counts what was written.
        """
        if rows.isEmpty():
            raise ValueError("no rows to store")
        keyed = rows.withColumn("key", content_key(F.col("program"), F.lit("name_firmware"), F.col(firmware)))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program", "key").parquet(f"{self.path}/data")
        keys = keyed.select("program", "key").distinct()
        written = self._data().join(keys, ["program", "key"], "left_semi").groupBy("program", "key").agg(F.count("*").alias("rows"))
        written.select("program", "key", "rows", F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/commits")

    def _data(self) -> DataFrame:
        data = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/data")
        return data.withColumns({c: F.col(c).cast("string") for c in ("program", "key")})

    def has(self, wanted: DataFrame) -> DataFrame:
        """wanted (program, firmware) with `stored`: is it committed under its key?"""
        keyed = wanted.withColumn("key", content_key(F.col("program"), F.lit("name_firmware"), F.col("firmware")))
        known = self.committed().select("program", "key", F.lit(True).alias("stored"))
        return keyed.join(known, ["program", "key"], "left").withColumn("stored", F.coalesce("stored", F.lit(False))).drop("key")

    def committed(self) -> DataFrame:
        """Latest usable commit of each program; those of a newer schema are passed over."""
        usable = self._commits().where(F.col("schema_version") <= SCHEMA_VERSION)
        return usable.groupBy("program").agg(F.max_by(F.struct("key", "rows", "at"), "at").alias("c")).select("program", "c.*")

    def get(self) -> DataFrame:
        """Rows under committed keys."""
        return self._data().join(self.committed().select("program", "key"), ["program", "key"], "left_semi")

    def pending(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted (program, firmware) without a commit under their key."""
        keyed = wanted.withColumn("key", content_key(F.col("program"), F.lit("name_firmware"), F.col("firmware")))
        return keyed.join(self.committed().select("program", "key"), ["program", "key"], "left_anti").drop("key")
