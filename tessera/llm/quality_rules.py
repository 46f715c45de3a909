"""Quality rules: base counts and a hashed n-gram log-likelihood ratio with a fixed threshold.

A document is kept if its base counts pass and the mean over its hashed word unigrams and bigrams of
log p(bucket | trusted) - log p(bucket | raw corpus) is at least `threshold`. The raw multinomial counts every n-gram
of every document, the trusted multinomial those of every document whose label marks it as good. Its prior grows with
its counts, and the unit of the ratio is set by the trusted documents themselves: each is scored by the counts of the
other folds, and the low end of those scores is put at the threshold. So neither the size of the input nor the number
of labels moves the scale.

Defined cases: a null or empty text has no words, fails the base rules and has ratio 0. Without trusted documents in two
folds that pass the base rules every ratio is 0, so only the base rules decide (threshold <= 0). Labels of one doc_id that disagree count as their
smallest. Rows that repeat are scored alike, each for itself. Input columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored
from tessera.llm._text import RangeHash, Texts, U, Words, mix, repeated, texts, unzipped, zipped

N_BUCKETS = 1 << 14
THRESHOLD = -0.045
#: trusted documents are scored by the other folds; so many of them may fall below the threshold, less a margin
FOLDS, LOW, MARGIN = 8, 0.002, 0.005
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def bigrams(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word pairs within a text, and the text of each."""
    same = words.text[1:] == words.text[:-1]
    return mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[same], words.text[1:][same]


def base_counts(t: Texts, words: Words, hashes: RangeHash, h: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of each text of a chunk."""
    n = len(t)
    inside = ~t.is_space()
    lead = (t.buf & 0xC0) != 0x80
    line_at = np.zeros(len(t.buf) + 1, bool)
    line_at[t.offsets[:-1]] = True
    line_at[1:] |= t.buf == 10
    line_at[t.offsets[1:][t.sizes > 0]] = True
    start = np.flatnonzero(line_at[:-1])
    end = np.append(start[1:], len(t.buf)) if len(start) else start
    text = np.searchsorted(t.offsets, start, "right") - 1
    seen = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    with_word = seen[end] > seen[start]
    start, end, text = start[with_word], end[with_word], text[with_word]
    end = np.where(t.buf[end - 1] == 10, end - 1, end)
    keys = hashes.of(start, end) ^ mix(text.astype(np.uint64) + U(1))
    order = np.argsort(keys, kind="stable")
    dup = order[1:][keys[order][1:] == keys[order][:-1]]
    out = {"n_words": words.count(n), "word_chars": t.per_text(inside & lead), "n_symbols": t.per_text(_SYMBOL[t.buf]), "n_dup_lines": np.bincount(text[dup], minlength=n).astype(np.int64)}
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        at = np.flatnonzero(words.text[2:] == words.text[:-2])
        windows = mix((h[at] * U(0x9E3779B97F4A7C15) + h[at + 1]) * U(0xC2B2AE3D27D4EB4F) + h[at + 2]) ^ mix(words.text[at].astype(np.uint64) + U(1))
        again = at[repeated(windows)]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(words.text[covered], minlength=n).astype(np.int64)
    return out


def _buckets(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each unigram and bigram."""
    pairs, text = bigrams(words, h)
    shift = U(64 - (N_BUCKETS.bit_length() - 1))
    return (np.concatenate([h, pairs]) >> shift).astype(np.int64), np.concatenate([words.text, text])


def count_buckets(docs: DataFrame, text: str, fold: str, folds: int = 1) -> np.ndarray:
    """Counts (folds, N_BUCKETS) of the n-grams of all rows, by a column with the number of the row's fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(folds * N_BUCKETS, np.int64)
        for batch in batches:
            of = np.asarray(batch.column(1), np.int64)
            at = 0
            for t in texts(batch.column(0)):
                words = t.words()
                bucket, own = _buckets(words, RangeHash(t.buf).of(words.start, words.end))
                counts += np.bincount(of[at : at + len(t)][own] * N_BUCKETS + bucket, minlength=len(counts))
                at += len(t)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    found = docs.select(F.col(text), F.col(fold)).mapInArrow(count, "bucket long, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(folds * N_BUCKETS)
    out[rows["bucket"]] = rows["n"]
    return out.reshape(folds, N_BUCKETS)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids with quality 1."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id")


def log_ratio(good: np.ndarray, share: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratio of trusted counts against raw shares, with the raw shares as a prior of `smoothing` times the trusted counts."""
    total = good.sum()
    return np.log((good / total + smoothing * share) / (1 + smoothing) / share) if total else np.zeros(N_BUCKETS)


def low_score(trusted: DataFrame, ratios: np.ndarray, usable: np.ndarray) -> float | None:
    """The LOW quantile of the scores of trusted rows (_text, _fold) that pass the base rules, each by its fold's ratios."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.asarray(batch.column(1), np.int64)
            at = 0
            for t in texts(batch.column(0)):
                words, hashes = t.words(), RangeHash(t.buf)
                h = hashes.of(words.start, words.end)
                counts = base_counts(t, words, hashes, h)
                bucket, own = _buckets(words, h)
                fold = of[at : at + len(t)]
                mean = np.bincount(own, ratios[fold[own], bucket], minlength=len(t)) / np.maximum(np.bincount(own, minlength=len(t)), 1)
                passed = (counts["n_words"] >= 50) & (100 * counts["n_repeat_words"] <= 50 * counts["n_words"]) & usable[fold]
                yield pa.RecordBatch.from_arrays([pa.array(mean[passed])], ["score"])
                at += len(t)

    scores = trusted.select("_text", "_fold").mapInArrow(score, "score double")
    return scores.agg(F.percentile_approx("score", F.lit(LOW), F.lit(100_000))).first()[0]


def fit_ratio(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", smoothing: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio of each bucket, trusted documents against the raw corpus, in units that put the threshold at THRESHOLD.

    Equal texts share a fold, so no text is scored by its own copy. The trusted texts come from a shuffled join, to which
    texts travel compressed.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    ids = trusted_ids(labels).withColumnRenamed("doc_id", "_id")
    fold = F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int").alias("_fold")
    packed = rows.select("_id", fold, zipped(F.col("_text")).alias("_z"))
    trusted = stored(packed.join(ids.hint("shuffle_hash"), "_id", "left_semi").select(unzipped(F.col("_z")).alias("_text"), "_fold"), "quality-trusted")
    by_fold = count_buckets(trusted, "_text", "_fold", FOLDS)
    good = by_fold.sum(0)
    if not good.sum():
        return np.zeros(N_BUCKETS)
    raw = count_buckets(rows.withColumn("_fold", F.lit(0)), "_text", "_fold")[0]
    share = (raw + 0.5) / (raw.sum() + 0.5 * N_BUCKETS)
    others = good - by_fold
    low = low_score(trusted, np.array([log_ratio(g, share, smoothing) for g in others]), others.sum(1) > 0)
    if low is None:
        return np.zeros(N_BUCKETS)
    return log_ratio(good, share, smoothing) * (THRESHOLD / (min(low, 0.0) - MARGIN))


def rules(text: Column | str, ratio: np.ndarray) -> Column:
    """Struct of the base counts and the length-normalised ratio of a text column."""
    kind = pa.struct([*((k, pa.int64()) for k in BASE), ("ratio", pa.float64())])

    @F.arrow_udf("struct<" + ", ".join(f"{k}: bigint" for k in BASE) + ", ratio: double>")
    def score(column: pa.Array) -> pa.Array:
        made = []
        for t in texts(column):
            words, hashes = t.words(), RangeHash(t.buf)
            h = hashes.of(words.start, words.end)
            counts = base_counts(t, words, hashes, h)
            bucket, own = _buckets(words, h)
            n = np.bincount(own, minlength=len(t))
            counts["ratio"] = np.bincount(own, ratio[bucket], minlength=len(t)) / np.maximum(n, 1)
            made.append(pa.StructArray.from_arrays([pa.array(counts[k]) for k in (*BASE, "ratio")], fields=list(kind)))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return score(text)


def apply_rules(docs: DataFrame, ratio: np.ndarray, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column `rules`: counts, ratio, base_failed, kept; a column of that name is replaced."""
    out = docs.withColumn("rules", rules(F.col(text), ratio))
    failed = (F.col("rules.n_words") < 50) | (100 * F.col("rules.n_repeat_words") > 50 * F.col("rules.n_words"))
    out = out.withColumn("rules", F.col("rules").withField("base_failed", failed))
    return out.withColumn("rules", F.col("rules").withField("kept", ~F.col("rules.base_failed") & (F.col("rules.ratio") >= threshold)))
