"""Principal response: the first principal component of a table's metrics as one number a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import kept


def moments(df: DataFrame, vector: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of a vector column, as one aggregate: what reaches the driver is d + d * d numbers,
    whatever the rows. Rows with nulls or other lengths than most batches' first must not occur."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                column = batch.column(0)
                x = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                own = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["m"])

    part = df.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(parts, "m array<double>")
    sums = part.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r.v for r in sorted(sums, key=lambda r: r.i)])
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2) if len(flat) else 0
    return (float(flat[0]) if d else 0.0), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def principal_response(df: DataFrame, vector: str, standardised: bool = True) -> DataFrame:
    """df with `response`: the projection of the centred (and standardised) vectors on their first principal axis.

    The axis is signed so that its largest loading is positive. Vectors are arrays of one length; a row with a null vector or a
    null or non-finite component has a null response and does not count. The spread of a constant component counts as 1.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = kept(df.withColumn("_sound", sound))
    n, s, q = moments(rows.where("_sound"), vector)
    if not n:
        return rows.withColumn("response", F.lit(None).cast("double")).drop("_sound")
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0)) if standardised else np.ones(len(mean))
    spread[spread < 1e-12] = 1.0
    axis = np.linalg.eigh(cov / np.outer(spread, spread))[1][:, -1]
    axis = axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0) / spread
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(a)) for a in axis]), lambda v, a: v * a), F.lit(0.0), lambda c, v: c + v)
    return rows.withColumn("response", F.when(F.col("_sound"), dot - float(mean @ axis))).drop("_sound")
