"""The regular grid: resampling, horizon targets, grid features and time to threshold.

A container has at most one row per step, so its row count on the grid is bounded by
the observed time span however often it reports. Plain windows by container are safe
here; only the step that builds the grid meets the raw readings, and it is an aggregate
with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import calendar_fields, clip, flag
from fillcast.operators.emptying import KEY

# Attributes carried from the first reading that has them.
CARRIED = ("container_type", "trash_type", "district", "district_num", "capacity_class", "latitude", "longitude")


def grid_window() -> Window:
    return Window.partitionBy(*KEY).orderBy("measured_at_utc")


def resample_time_series(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Last reading per step, carried forward over at most `fill_limit` empty steps.

    Steps that stay empty are not kept, so each filled step is produced straight from
    the observed step before it, by its distance to the next one. No calendar of steps is
    generated and joined.
    """
    ts, fill = F.col("measured_at_utc"), F.col("percent_calculated")
    step = F.expr(f"INTERVAL {settings.step_hours} HOURS")
    carried = [c for c in CARRIED if c in df.columns]
    place = F.struct(ts, fill)
    binned = df.groupBy(*KEY, F.window(ts, f"{settings.step_hours} hours").getField("start").alias("_bin")).agg(
        F.max_by(fill, F.when(fill.isNotNull(), place)).alias("percent_calculated"),
        F.count(fill).alias("_filled"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in carried],
    )
    ordered = Window.partitionBy(*KEY).orderBy("_bin")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_values = binned.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in carried}) if carried else binned
    # the grid ends at the container's last reading, whether or not that one has a value
    bounded = first_values.withColumn("_end", F.max("_bin").over(whole)).filter(F.col("_filled") > 0)
    spread = bounded.withColumn(
        "_last",
        F.least(
            F.col("_bin") + step * F.lit(settings.fill_limit),
            F.coalesce(F.lead("_bin").over(ordered) - step, F.col("_end")),
        ),
    )
    return spread.select(
        *KEY, F.explode(F.sequence("_bin", "_last", step)).alias("measured_at_utc"), "percent_calculated", *carried)


def create_time_dataset(df: DataFrame, horizon_hours: int = 24, settings: Settings = DEFAULTS) -> DataFrame:
    """Grid rows with the fill level `horizon_hours / step` rows later as `target`."""
    grid = resample_time_series(df, settings)
    ahead = horizon_hours // settings.step_hours
    return (
        grid.withColumn("target", F.lead("percent_calculated", ahead).over(grid_window()))
        .filter(F.col("target").isNotNull())
        .withColumns(calendar_fields(F.col("measured_at_utc")))
    )


def add_time_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Lags, differences, rolling statistics, drop flags and the mean of all earlier fills."""
    window, fill = grid_window(), F.col("percent_calculated")
    day = 24 // settings.step_hours

    def lagged(k: int) -> Column:
        return F.lag("percent_calculated", k).over(window)

    new = {"current_fill": fill} | {f"fill_lag_{k}": lagged(k) for k in settings.grid_lags}
    new |= {"fill_diff_1": fill - lagged(1), "fill_lag_24h": lagged(day), "fill_diff_24h": fill - lagged(day)}
    for k in settings.grid_windows:
        frame = window.rowsBetween(-k, -1)
        new[f"fill_roll_mean_{k}"] = F.avg(fill).over(frame)
        new[f"fill_roll_std_{k}"] = F.stddev_samp(fill).over(frame)
    new["container_fill_mean"] = F.avg(fill).over(window.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumns(new)
    out = out.withColumn("had_drop", flag(F.col("fill_diff_1") < -25))
    return out.withColumn(
        "had_drop_24h", F.coalesce(F.max("had_drop").over(window.rowsBetween(-day, -1)), F.lit(0)))


def label_time_to_threshold(grid: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hours until the fill level reaches the threshold, unless a sharp drop comes first.

    The next reaching row and the next drop row are minima over the later rows (frames of
    a descending order, one pass). A row that both drops and reaches counts as a drop. The
    scan looks at most `scan_rows` rows ahead, and never less than `max_days`.
    """
    reach = max(settings.scan_rows, -(-settings.max_days * 24 // settings.step_hours))
    window, fill = grid_window(), F.col("percent_calculated")
    row = F.row_number().over(window)
    full = fill >= settings.fill_threshold
    dropped = fill < F.lag("percent_calculated").over(window) - settings.scan_drop
    marked = grid.withColumns({"_row": row, "_hit": F.when(full, row), "_drop": F.when(dropped, row)})
    later = Window.partitionBy(*KEY).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumns({"_next_hit": F.min("_hit").over(later), "_next_drop": F.min("_drop").over(later)})
    distance = F.col("_next_hit") - F.col("_row")
    free = F.col("_next_drop").isNull() | (F.col("_next_hit") < F.col("_next_drop"))
    return seen.withColumn(
        "time_to_threshold_hours",
        F.when(full, F.lit(0.0)).when(
            (distance <= reach) & free, (distance * settings.step_hours).cast("double")),
    ).drop("_row", "_hit", "_drop", "_next_hit", "_next_drop")


def create_threshold_dataset(grid: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows with 0 < time to threshold <= `max_days`, in days as `target`."""
    hours = F.col("time_to_threshold_hours")
    return (
        label_time_to_threshold(grid, settings)
        .filter((hours > 0) & (hours <= settings.max_days * 24))
        .withColumn("target", hours / 24)
    )


def threshold_coverage(grid: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Share of containers with at least one labelled row (the selection bias of the dataset)."""
    per_container = label_time_to_threshold(grid, settings).groupBy(*KEY).agg(
        F.max(F.col("time_to_threshold_hours").isNotNull().cast("int")).alias("_labelled"))
    return per_container.agg(
        F.count(F.lit(1)).alias("n_containers_total"),
        F.coalesce(F.sum("_labelled"), F.lit(0)).alias("n_containers_with_ttt"),
    ).select(
        "*",
        F.coalesce(
            F.lit(100.0) * F.col("n_containers_with_ttt") / F.nullif(F.col("n_containers_total"), F.lit(0)), F.lit(0.0)
        ).alias("coverage_pct"),
        F.lit(settings.fill_threshold).alias("threshold"))


def add_threshold_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Gap to the threshold, lags over the labelled rows, 24 h change, rate, linear estimate."""
    window, fill = grid_window(), F.col("percent_calculated")
    day = 24 // settings.step_hours
    lags = [k for k in (1, 2, day, 2 * day) if f"fill_lag_{k}" not in df.columns]
    out = df.withColumns(
        {"current_fill": fill, "fill_gap": settings.fill_threshold - fill}
        | {f"fill_lag_{k}": F.lag("percent_calculated", k).over(window) for k in lags})
    out = out.withColumn("fill_change_24h", fill - F.col(f"fill_lag_{day}"))
    out = out.withColumn("fill_rate_per_hour", F.col("fill_change_24h") / 24)
    daily = F.nullif(F.col("fill_rate_per_hour"), F.lit(0.0)) * 24
    out = out.withColumn("estimated_time_linear", clip(F.col("fill_gap") / daily, 0, settings.max_days))
    fields = calendar_fields(F.col("measured_at_utc"))
    missing = {c: fields[c] for c in ("hour", "day_of_week", "is_weekend") if c not in df.columns}
    return out.withColumns(missing) if missing else out
