"""Readers of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """event_id, user_id, event_type, value and t, the time in microseconds; only the given types if any."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("t"))
    return e.where(F.col("event_type").isin(*types)) if types else e


def r6(c: Column | str) -> Column:
    """Rounded for comparison between engines."""
    return F.round(c, 6)
