"""Queries through the result store: what was put, committed and is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import register
from tessera.plans.tables import table
from tessera.session import shared_path
from tessera.sources.store import PARAMS, ResultStore, narrow, wide


def _store(spark: SparkSession) -> ResultStore:
    return ResultStore(spark, shared_path(spark, "store"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    fixed = {"firmware": "1", "analyzer": "frames", "source": "hw", "stimulus": "clip"}
    return li.select(
        F.col("l_returnflag").alias("program"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.col("l_orderkey").cast("int").alias("state_index"), F.lit(2).alias("settle_frames"),
        *[(F.col("l_quantity").cast("int") if p == "p1" else F.lit(0)).alias(p) for p in PARAMS], F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"),
    )


@register("SELECT l_returnflag AS program, count(*) AS rows, cast(sum(cast(l_quantity AS INT)) AS BIGINT) AS p1, round(sum(l_discount), 4) AS discount, count(*) FILTER (l_tax > 0.04) AS taxed FROM lineitem GROUP BY 1")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines put into the store in two runs, the first cut short, and got back: each row once."""
    store, rows = _store(spark), _records(spark, d)
    store.put(rows.where("p1 <= 10"))
    store.put(rows)
    back = wide(narrow(store.get().drop("key")), ["discount", "tax"])
    return back.groupBy("program").agg(F.count("*").alias("rows"), F.sum("p1").alias("p1"), F.round(F.sum("discount"), 4).alias("discount"), F.count("tax").alias("taxed"))


@register("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT n_name AS program, k IS NOT NULL AS stored, n AS rows FROM nation LEFT JOIN s ON k = n_nationkey
""")
def store_commits(spark: SparkSession, d: str) -> DataFrame:
    """Nations as programs: which have a commit (suppliers with a balance over 5000 are their rows), and how many rows it counts."""
    store, nation = _store(spark), table(spark, d, "nation")
    rows = table(spark, d, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("program"), F.lit("1").alias("firmware"), "s_suppkey", "s_acctbal")
    store.put(rows)
    wanted = nation.select(F.col("n_name").alias("program"), F.lit("1").alias("firmware"))
    return store.has(wanted).select("program", "stored").join(store.committed().select("program", "rows"), "program", "left")


@register("SELECT n_name AS program FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def store_pending(spark: SparkSession, d: str) -> DataFrame:
    """Nations without a commit."""
    store, nation = _store(spark), table(spark, d, "nation")
    rows = table(spark, d, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("program"), F.lit("1").alias("firmware"), "s_suppkey")
    store.put(rows)
    return store.pending(nation.select(F.col("n_name").alias("program"), F.lit("1").alias("firmware"))).select("program")
