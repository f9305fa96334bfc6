"""The dataset of emptying events and its lag, rolling and history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import calendar_fields
from fillcast.operators.emptying import KEY, time_order
from fillcast.operators.ordered import LongSeries, history_stats, over_series, positions


def create_event_dataset(df: DataFrame) -> DataFrame:
    """Detected emptyings with the fill level before them as `target`, plus calendar fields."""
    return (
        df.filter((F.col("is_collection") == 1) & F.col("pct_prev").isNotNull())
        .withColumn("target", F.col("pct_prev"))
        .withColumns(calendar_fields(F.col("measured_at_utc"), detailed=True))
    )


def add_missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns if c in df.columns})


def _with_recent(df: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """Lags and rolling statistics over the last events, all on one window order.

    Day gaps are differences of neighbouring dates, so a lagged gap is the difference
    of two lagged dates and a mean of gaps is a telescoped date difference. That keeps
    every window one level deep.
    """
    window = Window.partitionBy(*keys).orderBy(*time_order())
    new = {f"target_lag_{k}": F.lag("target", k).over(window) for k in settings.event_lags}
    new["days_since_prev_collection"] = F.datediff("date", F.lag("date").over(window))
    for k in settings.interval_lags:
        new[f"interval_lag_{k}"] = F.datediff(F.lag("date", k).over(window), F.lag("date", k + 1).over(window))
    for k in settings.event_windows:
        frame = window.rowsBetween(-k, -1)
        new[f"target_roll_mean_{k}"] = F.avg("target").over(frame)
        new[f"target_roll_std_{k}"] = F.stddev_samp("target").over(frame)
        new[f"target_roll_max_{k}"] = F.max("target").over(frame)
        # gaps of the k previous events span the k + 1 previous dates
        dates = window.rowsBetween(-k - 1, -1)
        new[f"interval_roll_mean_{k}"] = F.datediff(F.max("date").over(dates), F.min("date").over(dates)) / F.nullif(
            F.count("date").over(dates) - 1, F.lit(0))
    return df.withColumns(new)


def add_event_features(df: DataFrame, settings: Settings = DEFAULTS, long: LongSeries | None = None) -> DataFrame:
    """Target lags, interval lags, rolling statistics, same-weekday lag, trend, rate, history."""
    order = time_order()
    reach = max(*settings.event_lags, max(settings.event_windows) + 1, max(settings.interval_lags) + 1)
    out = over_series(df, KEY, order, lambda part, keys: _with_recent(part, keys, settings), back=reach, long=long)
    out = history_stats(out, KEY, order, "target", "container_hist_mean", "container_hist_std", long)

    def same_weekday(part: DataFrame, keys: list[str]) -> DataFrame:
        return part.withColumn(
            "target_same_dow", F.lag("target").over(Window.partitionBy(*keys).orderBy(*order)))

    out = over_series(out, [*KEY, "day_of_week"], order, same_weekday, back=1, long=long)
    out = out.withColumns({
        "target_trend": F.col("target_lag_1") - F.col("target_lag_2"),
        "fill_rate": F.col("target_lag_1") / F.nullif(F.col("interval_lag_1"), F.lit(0)),
    })
    return add_missing_indicators(out, ["target_lag_1", "target_lag_2", "target_lag_3", "target_same_dow"])


def first_rows_per_series(df: DataFrame, n: int, long: LongSeries | None = None) -> DataFrame:
    """The first `n` rows of every container in time order."""
    order = [*time_order(), F.xxhash64(*df.columns)]
    return positions(df, KEY, order, long).filter(F.col("_pos") <= n).drop("_pos")
