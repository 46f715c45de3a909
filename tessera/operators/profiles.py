"""A program's profile as one nested document: parameters, interactions, lock maps and ranges, saved and loaded with a version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fit
from tessera.operators.robust import mode_smallest
from tessera.session import kept

PROFILE_VERSION = 2


def lock_maps(rows: DataFrame, *, key: list[str], params: list[str], winding: str, strength: str, least_levels: int = 4, most: int = 4) -> DataFrame:
    """The widest stretch locked at each ratio, for every pair of densely set parameters: key, a, b, p, q, level, centre, width,
    mean and levels.

    A pair is looked at where all other parameters hold their most frequent value, if at least half of least_levels squared rows
    do. Along b, at each level of a, consecutive levels locked at one ratio are a stretch (rows of one setting are averaged). Of
    equally wide ones that at the greatest level of a, then the last along b, counts. A parameter is dense with least_levels values.
    """
    flat = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("long").alias("level")) for p in params]))
    levels = rows.select(*key, flat.alias("l")).select(*key, "l.*")
    dense = levels.groupBy(*key).agg(*[F.count_distinct(F.when(F.col("param") == p, F.col("level"))).alias(f"_n_{p}") for p in params])
    modes = mode_smallest(levels, key=[*key, "param"], value="level").groupBy(*key).agg(*[F.max(F.when(F.col("param") == p, F.col("mode"))).alias(f"_m_{p}") for p in params])
    known = rows.join(dense.join(modes, key), key)
    wanted = []
    for i, a in enumerate(params):
        for b in params[i + 1 :]:
            others = [F.col(o).cast("long") == F.col(f"_m_{o}") for o in params if o not in (a, b)]
            fit_for = reduce(lambda x, y: x & y, others, (F.col(f"_n_{a}") >= least_levels) & (F.col(f"_n_{b}") >= least_levels))
            wanted.append(F.when(fit_for, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("long").alias("level"), F.col(b).cast("long").alias("at"))))
    pairs = known.select(*key, F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("x"), F.col(winding).alias("w"), F.col(strength).alias("s")).select(*key, "x.*", "w", "s")
    line = pairs.groupBy(*key, "a", "b", "level", "at").agg(F.avg("w").alias("w"), F.avg("s").alias("s"), F.count("*").alias("n"))
    enough = line.groupBy(*key, "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least_levels**2 // 2).drop("n")
    line = line.join(enough, [*key, "a", "b"], "left_semi").withColumn("w", F.round("w", 9))
    line = line.withColumnsRenamed({"a": "_pa", "b": "_pb"})
    found = fit.tongues(line, key=[*key, "_pa", "_pb", "level"], at="at", winding="w", strength="s", most=most).withColumnsRenamed({"_pa": "a", "_pb": "b"})
    best = F.max_by(F.struct("level", "centre", "width", "mean", "levels"), F.struct("width", "level", "centre"))
    return found.groupBy(*key, "a", "b", "p", "q").agg(best.alias("t")).select(*key, "a", "b", "p", "q", "t.*")


def fit_profile(rows: DataFrame, *, key: str, params: list[str], metrics: list[str], signatures: dict[str, dict[str, float]], response: str, winding: str, strength: str, keep: list[str], specs: DataFrame | None = None, least_strength: float = 0.05) -> DataFrame:
    """One row a key: `profile`, a struct of rows, parameters, interactions, lock_maps and metrics.

    rows hold the key, parameter settings, metrics, the row's identity (`keep`), the response whose interactions are sought, and
    the winding and strength of the lock maps. specs (param, name) gives parameters their names, `param` itself where it has
    none. Interactions under least_strength are left out. Its parts are aggregates of few rows a key; the rows themselves are read
    by each part and not gathered.
    """
    matrix = fit.metric_matrix(fit.long_metrics(rows, keep=[key, *params, *keep], metrics=metrics), key=[key])
    curves = kept(fit.level_curves(matrix, key=[key], params=params))  # a few numbers a level, read by all that follow
    fits = fit.parameter_fits(curves, key=[key])
    axes = fit.assigned_axes(fit.effects(curves, key=[key]), key=[key], signatures=signatures)
    named = fits.join(axes, [key, "param"])
    named = named.join(specs.select("param", "name"), "param", "left") if specs is not None else named.withColumn("name", F.lit(None).cast("string"))
    ordered = lambda df, name, *columns: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    fields = ["param", F.coalesce("name", "param").alias("name"), "levels", "kind", "driver", "sensitivity", "rho", "monotonic", "cliffs", "dead_from", "dead_to", "axis", "similarity"]
    parts = [ordered(named, "parameters", *fields)]
    strong = fit.pair_strengths(rows, key=[key], params=params, y=response).where(F.col("strength") >= least_strength)
    parts.append(ordered(strong, "interactions", "a", "b", "cells", "strength"))
    parts.append(ordered(lock_maps(rows, key=[key], params=params, winding=winding, strength=strength), "lock_maps", "a", "b", "p", "q", "level", "centre", "width", "mean", "levels"))
    scales = curves.select(key, "metric", "span").distinct()
    parts.append(ordered(scales, "metrics", "metric", "span"))
    whole = rows.groupBy(key).agg(F.count("*").alias("rows"))
    for part in parts:
        whole = whole.join(part, key, "left")
    lists = [F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)).alias(c) for c in ("parameters", "interactions", "lock_maps", "metrics")]
    return whole.select(key, F.struct("rows", *lists).alias("profile"))


def save_profiles(profiles: DataFrame, path: str, *, key: str, version: int = PROFILE_VERSION) -> None:
    """Write profiles with the version of their form, one folder a key; a key's earlier profile is replaced, others stay."""
    made = profiles.select(F.col(key).alias("program"), F.lit(version).alias("schema_version"), "profile")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program").parquet(path)


def load_profiles(spark: SparkSession, path: str, program: str | None = None) -> DataFrame:
    """program and profile of all that were saved, or of one; a profile of a newer form is an error."""
    found = spark.read.option("mergeSchema", True).parquet(path).withColumn("program", F.col("program").cast("string"))
    found = found if program is None else found.where(F.col("program") == program)
    newest = found.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > PROFILE_VERSION:
        raise ValueError(f"profile form {newest} is newer than {PROFILE_VERSION}")
    if program is not None and newest is None:
        raise KeyError(program)
    return found.select("program", "profile")
