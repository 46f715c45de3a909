"""Experiment designs: generators of settings as DataFrames. Sizes are those of the design, not of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_at_a_time(levels: DataFrame, base: DataFrame, *, param: str, value: str) -> DataFrame:
    """For each (param, value) of levels the whole base vector (param, parked) with that one value changed.

    Returns run (number of the setting), param, value: one row a parameter and run.
    """
    runs = levels.select(F.struct(param, value).alias("_set")).distinct()
    # a design has few runs; base vectors are as long as there are parameters
    return runs.join(F.broadcast(base)).select(F.col(f"_set.{param}").alias("varied"), F.col(f"_set.{value}").alias("level"), F.col(param), F.when(F.col(param) == F.col(f"_set.{param}"), F.col(f"_set.{value}")).otherwise(F.col("parked")).alias("setting"))


def raster(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Two-dimensional raster, every other row reversed: step, r, c."""
    cell = spark.range(rows * columns)
    r = F.floor(F.col("id") / columns)
    c = F.when(r % 2 == 0, F.col("id") % columns).otherwise(columns - 1 - F.col("id") % columns)
    return cell.select(F.col("id").alias("step"), r.alias("r"), c.alias("c"))


#: fixed values: primitive polynomials (degree, inner coefficients) and first direction numbers of Sobol dimensions 2..6
_SOBOL = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)))


def direction_numbers(dim: int, bits: int = 30) -> list[int]:
    """Direction numbers of an unscrambled Sobol dimension (0-based), scaled to `bits`."""
    if dim == 0:
        return [1 << (bits - 1 - k) for k in range(bits)]
    degree, inner, m = _SOBOL[dim - 1]
    m = list(m)
    for k in range(degree, bits):
        new = m[k - degree] ^ (m[k - degree] << degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [v << (bits - 1 - k) for k, v in enumerate(m[:bits])]


def sobol_value(i: Column, dim: int, bits: int = 30) -> Column:
    """Value in [0, 1) of point i: the direction numbers of the set bits of its Gray code, combined by xor."""
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    out = F.lit(0).cast("long")
    for k, v in enumerate(direction_numbers(dim, bits)):
        out = out.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long")) * F.lit(v).cast("long"))
    return out / F.lit(float(1 << bits))


def apportion(weights: DataFrame, *, key: str, weight: str, total: int) -> DataFrame:
    """Whole shares of `total` in proportion to the weights by largest remainders, ties to the smaller key."""
    from pyspark.sql import Window

    every = Window.partitionBy()
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(every)
    base = weights.select(key, F.floor(exact).alias("share"), (exact - F.floor(exact)).alias("_rest"))
    left = F.lit(total) - F.sum("share").over(every)
    order = F.row_number().over(Window.orderBy(F.round(F.col("_rest"), 9).desc(), key))
    return base.withColumn("_left", left).withColumn("_k", order).select(key, (F.col("share") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).alias("share"))
