"""Checks on a feature table: enough history, no leakage, correlated columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.operators.emptying import KEY, time_order
from fillcast.operators.ordered import LongSeries, positions


def sample_counts(df: DataFrame, min_samples: int, key: str = "container_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples")).withColumn(
        "kept", F.col("n_samples") >= min_samples)


def keep_frequent(df: DataFrame, min_samples: int, key: str = "container_id") -> DataFrame:
    """Rows of entities with at least `min_samples` rows."""
    kept = sample_counts(df, min_samples, key).filter("kept").select(key)
    return df.join(kept, key, "left_semi")


def dropped_entities(df: DataFrame, min_samples: int, key: str = "container_id") -> DataFrame:
    return sample_counts(df, min_samples, key).filter(~F.col("kept")).select(key, "n_samples")


def filter_summary(df: DataFrame, min_samples: int, key: str = "container_id") -> DataFrame:
    return sample_counts(df, min_samples, key).agg(
        F.lit(min_samples).alias("min_samples"),
        F.count_if("kept").alias("kept_containers"),
        F.count_if(~F.col("kept")).alias("dropped_containers"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_samples"))), F.lit(0)).alias("kept_rows"),
        F.coalesce(F.sum("n_samples"), F.lit(0)).alias("original_rows"))


LEAKAGE_MIN_ROWS = 3


def leakage_issues(df: DataFrame, features: list[str], long: LongSeries | None = None) -> DataFrame:
    """Every lag column that is set in a container's first row, counted over all containers."""
    lags = [c for c in features if "lag" in c.lower() and c in df.columns]
    sizes = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAKAGE_MIN_ROWS).select(*KEY)
    slim = df.select(*KEY, "measured_at_utc", "percent_calculated", *lags)
    first = positions(slim, KEY, time_order(), long).filter("_pos = 1").join(sizes, KEY, "left_semi")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().cast("int").alias("issue")) for c in lags])
    return first.select(F.inline(pairs)).groupBy("feature").agg(
        F.sum("issue").alias("n_issues"), F.count(F.lit(1)).alias("n_containers"))


def has_no_leakage(df: DataFrame, features: list[str], long: LongSeries | None = None) -> bool:
    return not (leakage_issues(df, features, long).agg(F.sum("n_issues")).first()[0] or 0)


MOMENTS = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are known.

    With some 180 columns there are 16,000 pairs, too many for one aggregate each. Every
    task reduces its rows to one matrix of sums per kind (matrix products over Arrow
    batches) and emits one row per pair; the exchange only adds those up. The columns are
    shifted by their means first, which keeps the sums well conditioned.
    """
    names = [c for c in columns if c in df.columns]
    numbers = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    means = numbers.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in numbers.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    size = len(names)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, x = (np.zeros((size, size)) for _ in range(4))
        seen = False
        for batch in batches:
            values = batch.to_numpy(dtype=float) - shift
            known = ~np.isnan(values)
            values = np.where(known, values, 0.0)
            known = known.astype(float)
            n += known.T @ known
            s += values.T @ known          # sum of i where j is known
            q += (values * values).T @ known
            x += values.T @ values
            seen = True
        if seen:
            i, j = np.triu_indices(size, 1)
            yield pd.DataFrame({
                "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
                "sii": q[i, j], "sjj": q[j, i], "sij": x[i, j]})

    sums = numbers.mapInPandas(partial_sums, MOMENTS).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    labels = F.array(*[F.lit(c) for c in names])
    n, si, sj = F.col("n"), F.col("si"), F.col("sj")
    spread = (F.col("sii") - si * si / n) * (F.col("sjj") - sj * sj / n)
    together = (F.col("sij") - si * sj / n)
    return sums.filter(n > 1).select(
        F.get(labels, F.col("i")).alias("feature_a"), F.get(labels, F.col("j")).alias("feature_b"),
        F.when(spread > 0, F.least(F.abs(together / F.sqrt(spread)), F.lit(1.0))).alias("abs_corr"))


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    limit = settings.correlation_threshold if threshold is None else threshold
    return pair_correlations(df, columns).filter(F.col("abs_corr") > limit)
