"""Detection of emptying events in the raw readings, and its threshold grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import flag, hours_between
from fillcast.operators.ordered import LongSeries, on_both, over_series, series_quantile

KEY = ["container_id"]
QUANTILE = 0.10


def time_order() -> list[Column]:
    """Reading order; the fill level breaks ties between readings of one instant."""
    return [F.col("measured_at_utc"), F.col("percent_calculated")]


def _with_neighbours(df: DataFrame, keys: list[str], look_ahead: bool) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*time_order())
    new = {
        "pct_prev": F.lag("percent_calculated").over(window),
        "time_prev": F.lag("measured_at_utc").over(window),
    }
    if look_ahead:
        new["pct_next"] = F.lead("percent_calculated").over(window)
    return df.withColumns(new)


def _with_changes(df: DataFrame, look_ahead: bool, long: LongSeries | None) -> DataFrame:
    """Previous reading, change, gap, and the container's 10 % quantile of changes."""
    linked = over_series(
        df, KEY, time_order(), lambda part, keys: _with_neighbours(part, keys, look_ahead),
        back=1, ahead=1 if look_ahead else 0, long=long,
    ).withColumns({
        "pct_change": F.col("percent_calculated") - F.col("pct_prev"),
        "hours_since_prev": hours_between(F.col("time_prev"), F.col("measured_at_utc")),
    })
    whole = Window.partitionBy(*KEY)
    return on_both(
        linked, long,
        lambda part: part.withColumn("_drop_quantile", F.percentile("pct_change", F.lit(QUANTILE)).over(whole)),
        lambda part: part.join(
            F.broadcast(series_quantile(part, KEY, "pct_change", QUANTILE, "_drop_quantile", long)), KEY, "left"),
    )


def _is_emptied(drop: float, low_after: float, high_before: float, settings: Settings) -> Column:
    return (
        (F.col("pct_change") <= F.greatest(F.col("_drop_quantile"), F.lit(drop)))
        & (F.col("hours_since_prev") <= settings.max_gap_hours)
        & (F.col("percent_calculated") < low_after)
        & (F.col("pct_prev") > high_before)
    )


def detect_collections(
    df: DataFrame, drop_threshold: float | None = None, low_after: float | None = None,
    high_before: float | None = None, use_future_check: bool | None = None,
    settings: Settings = DEFAULTS, long: LongSeries | None = None,
) -> DataFrame:
    """Mark the readings right after an emptying with `is_collection` = 1."""
    future = settings.use_future_check if use_future_check is None else use_future_check
    emptied = _is_emptied(
        settings.drop_threshold if drop_threshold is None else drop_threshold,
        settings.low_after if low_after is None else low_after,
        settings.high_before if high_before is None else high_before,
        settings,
    )
    if future:
        following = F.col("pct_next")
        emptied &= following.isNull() | ((following < 70) & (following < F.col("pct_prev")))
    changed = _with_changes(df, future, long)
    return changed.withColumn("is_collection", flag(emptied)).drop("pct_next", "_drop_quantile")


def threshold_sensitivity(
    df: DataFrame, settings: Settings = DEFAULTS, long: LongSeries | None = None
) -> DataFrame:
    """Number of detected emptyings for every pair of drop and low-after thresholds.

    One detection pass: each pair is a conditional count in a single aggregate, turned
    into rows afterwards.
    """
    pairs = [(d, a) for d in settings.grid_drop_thresholds for a in settings.grid_low_after]
    counts = [
        F.count_if(_is_emptied(d, a, settings.high_before, settings)).alias(f"n_{i}")
        for i, (d, a) in enumerate(pairs)
    ]
    # counting per container first makes the container count a plain count
    changed = _with_changes(df, False, long).groupBy(*KEY).agg(*counts)
    total = changed.agg(
        F.count(F.lit(1)).alias("n_containers"), *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(pairs))])
    rows = F.array(*[
        F.struct(F.lit(d).alias("drop_threshold"), F.lit(a).alias("low_after_threshold"),
                 F.col(f"n_{i}").alias("n_collections"))
        for i, (d, a) in enumerate(pairs)
    ])
    return total.select("n_containers", F.inline(rows)).select(
        "drop_threshold", "low_after_threshold", "n_collections",
        (F.col("n_collections") / F.nullif(F.col("n_containers"), F.lit(0))).alias("collections_per_container"))
