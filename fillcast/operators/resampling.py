"""Intervals of error metrics from resampled rows: every replicate draws n of n rows with replacement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.config import DEFAULTS, Settings
from fillcast.operators.metrics import _y, complete_pairs, replicate_bounds
from fillcast.operators.ordered import stored

# Different errors a bucket holds on average, and replicates drawn at a time.
BUCKET_VALUES, DRAWN_AT_ONCE = 4096, 50
# A group is cut into at most two to this power of buckets; beyond that its buckets grow.
DEEPEST = 20


def row_bootstrap(
    df: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", predicted: str = "predicted",
    settings: Settings = DEFAULTS, rounds: int | None = None, bucket_values: int = BUCKET_VALUES,
) -> DataFrame:
    """Percentile intervals of RMSE and MAE, per group if `by` is given, as from a plain row bootstrap.

    RMSE and MAE need a row's error alone, so rows are counted by error first (map-side). A
    group's errors go to buckets by their hash. A replicate's n draws are split over the buckets
    by a binary tree of binomial draws, seeded by node, which every bucket follows from the root
    to itself, and then over the errors in the bucket by a multinomial draw. So nothing depends on
    partitioning, order or lost tasks, and a row with any number of copies is one weighted value.
    The work is replicates x different errors; `bootstrap_intervals` costs replicates x 4,096.
    A group without complete pairs gives no row, and too few replicates give NULL.
    """
    n, seed = rounds or settings.bootstrap_rounds, settings.seed
    _, _, error = _y(actual, predicted)
    keys = list(by)
    # -0.0 and 0.0 are one error
    values = stored(complete_pairs(df, actual, predicted).groupBy(*keys, (error.cast("double") + F.lit(0.0)).alias("_e")).agg(
        F.count(F.lit(1)).alias("_n")))
    groups = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).select(
        *keys, F.least(F.greatest(F.ceil(F.log2(F.col("_k") / bucket_values)), F.lit(0)), F.lit(DEEPEST)).cast("int").alias("_depth"))
    hashed = F.pmod(F.xxhash64(F.lit(seed), "_e"), F.lit(1 << DEEPEST))
    placed = stored(_join(values, groups, keys).withColumn("_hash", hashed).withColumn(
        "_bucket", F.expr(f"shiftright(_hash, {DEEPEST} - _depth)")).drop("_hash"))
    paths = _paths(placed.groupBy(*keys, "_depth", "_bucket").agg(F.sum("_n").alias("_n")), keys)

    schema = T.StructType([f for f in df.schema if f.name in keys] + [
        T.StructField("_round", T.IntegerType()), T.StructField("_sq", T.DoubleType()), T.StructField("_ab", T.DoubleType()),
        T.StructField("_draws", T.LongType())])
    at_once = DRAWN_AT_ONCE

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Sums over one bucket's part of every replicate."""
        rows = rows.sort_values("_e")
        bucket, path, group = key[-1], rows["_path"].iloc[0], int(rows["_group"].iloc[0]) & (2**63 - 1)
        draws = np.full(n, path[0]["all"], dtype=np.int64)
        for level, step in enumerate(path):
            if step["left"] is None:  # the bucket itself
                break
            left = np.random.default_rng([seed, group, level, int(step["node"])]).binomial(draws, step["left"] / step["all"])
            draws = draws - left if step["goes_right"] else left
        counts, e = rows["_n"].to_numpy(dtype=np.float64), rows["_e"].to_numpy()
        share, both = counts / counts.sum(), np.column_stack([e * e, np.abs(e)])
        rng = np.random.default_rng([seed, group, len(path), int(bucket), 1])
        sums = np.vstack([rng.multinomial(draws[i:i + at_once], share) @ both for i in range(0, n, at_once)])
        out = {k: [v] * n for k, v in zip(keys, key)}
        return pd.DataFrame({**out, "_round": np.arange(n), "_sq": sums[:, 0], "_ab": sums[:, 1], "_draws": draws})

    group = F.xxhash64(F.lit(seed), *keys)
    drawn = _join(placed.drop("_depth"), paths, [*keys, "_bucket"]).withColumn("_group", group).groupBy(*keys, "_bucket").applyInPandas(draw, schema)
    total = F.sum("_draws")
    per_round = drawn.groupBy(*keys, "_round").agg(
        F.sqrt(F.sum("_sq") / total).alias("_rmse"), (F.sum("_ab") / total).alias("_mae"))
    return replicate_bounds(per_round, by, settings)


def _paths(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Per bucket the nodes from the root down: rows below, rows on the left, and the way taken."""
    level = F.explode(F.sequence(F.lit(0), F.col("_depth"))).alias("_level")
    steps = buckets.select(*keys, "_depth", "_bucket", "_n", level).withColumn("_node", F.expr("shiftright(_bucket, _depth - _level)"))
    nodes = steps.groupBy(*keys, "_level", "_node").agg(
        F.sum("_n").alias("all"),
        F.sum(F.when(F.col("_level") < F.col("_depth"), F.when(_bit() == 0, F.col("_n")).otherwise(0))).alias("left"))
    step = F.struct("_level", F.col("_node").alias("node"), "all", "left", (_bit() == 1).alias("goes_right"))
    found = _join(steps.drop("_n"), nodes, [*keys, "_level", "_node"])
    return found.groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(step)).alias("_path"))  # at most DEEPEST + 1 steps


def _bit():
    """Whether a bucket lies right of its node at `_level`; 0 at the bucket itself."""
    return F.when(F.col("_level") < F.col("_depth"), F.expr("shiftright(_bucket, greatest(_depth - _level - 1, 0)) & 1")).otherwise(0)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that are equal or both NULL; `right` has one row a key (without keys: one row)."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])
