"""The corpus pipeline: five stages over `documents`, each one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its input. run()
writes each stage's rows as Parquet in the shared folder and hands the next stage what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_classifier, quality_rules, simhash, suffix_dedup
from tessera.llm._common import scratch
from tessera.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    model = quality_classifier.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.score(F.col("text")) >= 0.3)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship(spark)
    ratio = quality_rules.fit_ratio(docs, _labels(spark, sf_dir))
    # a row travels as one struct, so no name of its own can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return quality_rules.apply_rules(rows, ratio).where("rules.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs)


#: a repeated passage is one of at least this many words; byte strings of so many words of three letters and a space
#: are sought, as the index works on bytes. (The 400 bytes of the op9 query bind that query; many passages are shorter.)
PASSAGE_WORDS = 50
PASSAGE_BYTES = 200


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share; n_chars follows the text."""
    ship(spark)
    out = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of the documents and their bins."""
    ship(spark)
    return packing.best_fit(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("packing", pack),
]

#: models, fingerprints and suffix order are beyond SQL; the tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
