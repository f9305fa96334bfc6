"""Queries on emptying detection, event features, the grid and time to threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import (
    CHECKED, clean, detected, event_features, event_rows, grid_rows, long_series, threshold_rows, time_features, time_rows)
from fillcast.catalog.registry import query
from fillcast.operators import emptying, events, grid, screening

KEYS = "container_id:i measured_at_utc:u"


@query("t01_detect_collections", KEYS + " pct_prev:f pct_change:f hours_since_prev:f is_collection:i", "SELECT * FROM detected", ("detected",))
def detect_collections(spark, sf) -> DataFrame:
    return detected(spark, sf)


@query("t01b_collections_per_container", "container_id:i n_collections:i mean_fill_before:f", """
SELECT container_id, sum(is_collection) AS n_collections, avg(CASE WHEN is_collection = 1 THEN pct_prev END) AS mean_fill_before
FROM detected GROUP BY 1""", ("detected",))
def collections_per_container(spark, sf) -> DataFrame:
    hit = F.col("is_collection") == 1
    return detected(spark, sf).groupBy("container_id").agg(
        F.sum("is_collection").alias("n_collections"), F.avg(F.when(hit, F.col("pct_prev"))).alias("mean_fill_before"))


@query("t02_future_check", KEYS + " is_collection:i", """
SELECT *, CASE WHEN is_collection = 1 AND (pct_next IS NULL OR (pct_next < 70 AND pct_next < pct_prev)) THEN 1 ELSE 0 END AS is_collection
FROM (SELECT d.* EXCLUDE (is_collection), d.is_collection FROM detected d)""".replace("*, CASE", "* EXCLUDE (is_collection), CASE"), ("detected",))
def future_check(spark, sf) -> DataFrame:
    return emptying.detect_collections(clean(spark, sf), use_future_check=True, long=long_series(spark, sf))


@query("t03_threshold_sensitivity", "drop_threshold:f low_after_threshold:f n_collections:i collections_per_container:f", """
SELECT d AS drop_threshold, a AS low_after_threshold,
       count(*) FILTER (WHERE c.pct_change <= greatest(l.p10, d) AND c.hours_since_prev <= 168 AND c.percent_calculated < a AND c.pct_prev > 40) AS n_collections,
       count(*) FILTER (WHERE c.pct_change <= greatest(l.p10, d) AND c.hours_since_prev <= 168 AND c.percent_calculated < a AND c.pct_prev > 40)
         / CAST(count(DISTINCT c.container_id) AS DOUBLE) AS collections_per_container
FROM changed c JOIN limits l ON l.container_id = c.container_id,
     (SELECT unnest([-20.0, -25.0, -30.0, -35.0, -40.0]) AS d) x, (SELECT unnest([40.0, 45.0, 50.0, 55.0, 60.0]) AS a) y
GROUP BY 1, 2""", ("changed", "limits"))
def threshold_sensitivity(spark, sf) -> DataFrame:
    return emptying.threshold_sensitivity(clean(spark, sf), long=long_series(spark, sf))


@query("t04_resample", KEYS + " percent_calculated:f", "SELECT * FROM grid", ("grid",))
def resample(spark, sf) -> DataFrame:
    return grid_rows(spark, sf)


@query("t05_forward_fill_counts", "container_id:i n_rows:i n_filled:i", """
SELECT g.container_id, count(*) AS n_rows, count(*) FILTER (WHERE b.slot IS NULL) AS n_filled
FROM grid g LEFT JOIN (SELECT DISTINCT container_id, time_bucket(INTERVAL 6 HOURS, measured_at_utc) AS slot FROM clean) b
  ON b.container_id = g.container_id AND b.slot = g.measured_at_utc GROUP BY 1""", ("grid", "clean"))
def forward_fill_counts(spark, sf) -> DataFrame:
    observed = clean(spark, sf).select("container_id", F.window("measured_at_utc", "6 hours").getField("start").alias("slot")).distinct()
    rows = grid_rows(spark, sf).groupBy("container_id").agg(F.count(F.lit(1)).alias("n_rows"))
    seen = observed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_seen"))
    return rows.join(seen, "container_id").withColumn("n_filled", F.col("n_rows") - F.col("n_seen"))


@query("t06_carried_attributes", KEYS + " container_type:s trash_type:s district:s district_num:f capacity_class:s latitude:f longitude:f",
       "SELECT g.measured_at_utc, c.* FROM grid g JOIN carried c ON c.container_id = g.container_id", ("grid", "carried"))
def carried_attributes(spark, sf) -> DataFrame:
    return grid_rows(spark, sf)


@query("t07_event_dataset", KEYS + " target:f percent_calculated:f trash_type:s", "SELECT * FROM ev", ("ev",))
def event_dataset(spark, sf) -> DataFrame:
    return event_rows(spark, sf)


@query("t08_target_lags", KEYS + " " + " ".join(f"target_lag_{k}:f" for k in range(1, 11)), "SELECT * FROM evf", ("evf",))
def target_lags(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t09_interval_lags", KEYS + " days_since_prev_collection:i interval_lag_1:i interval_lag_2:i interval_lag_3:i", "SELECT * FROM evf", ("evf",))
def interval_lags(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t10_event_rolling", KEYS + " " + " ".join(
    f"target_roll_mean_{k}:f target_roll_std_{k}:f target_roll_max_{k}:f interval_roll_mean_{k}:f" for k in (3, 5, 7)), "SELECT * FROM evf", ("evf",))
def event_rolling(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t11_same_weekday", KEYS + " target_same_dow:f target_same_dow_missing:i target_lag_3_missing:i", "SELECT * FROM evf", ("evf",))
def same_weekday(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t12_trend_and_rate", KEYS + " target_trend:f fill_rate:f", "SELECT * FROM evf", ("evf",))
def trend_and_rate(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t13_expanding_history", KEYS + " container_hist_mean:f container_hist_std:f", "SELECT * FROM evf", ("evf",))
def expanding_history(spark, sf) -> DataFrame:
    return event_features(spark, sf)


@query("t14_horizon_target", KEYS + " percent_calculated:f target:f trash_type:s", "SELECT * FROM timed", ("timed",))
def horizon_target(spark, sf) -> DataFrame:
    return time_rows(spark, sf)


_W = "OVER (PARTITION BY container_id ORDER BY measured_at_utc"
_GRID_LAGS = (1, 2, 3, 6, 12, 24, 48)


@query("t15_grid_lags", KEYS + " current_fill:f fill_diff_1:f fill_lag_24h:f fill_diff_24h:f " + " ".join(f"fill_lag_{k}:f" for k in _GRID_LAGS),
       f"""SELECT *, percent_calculated AS current_fill, percent_calculated - lag(percent_calculated) {_W}) AS fill_diff_1,
              lag(percent_calculated, 4) {_W}) AS fill_lag_24h, percent_calculated - lag(percent_calculated, 4) {_W}) AS fill_diff_24h,
              {', '.join(f'lag(percent_calculated, {k}) {_W}) AS fill_lag_{k}' for k in _GRID_LAGS)} FROM timed""", ("timed",))
def grid_lags(spark, sf) -> DataFrame:
    return time_features(spark, sf)


@query("t16_grid_rolling", KEYS + " " + " ".join(f"fill_roll_mean_{k}:f fill_roll_std_{k}:f" for k in (6, 12, 24)),
       "SELECT *, " + ", ".join(
           f"avg(percent_calculated) {_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS fill_roll_mean_{k}, "
           f"stddev_samp(percent_calculated) {_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS fill_roll_std_{k}" for k in (6, 12, 24)) + " FROM timed", ("timed",))
def grid_rolling(spark, sf) -> DataFrame:
    return time_features(spark, sf)


@query("t17_drop_flags", KEYS + " had_drop:i had_drop_24h:i", f"""
SELECT *, coalesce(max(had_drop) {_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS had_drop_24h
FROM (SELECT *, CASE WHEN percent_calculated - lag(percent_calculated) {_W}) < -25 THEN 1 ELSE 0 END AS had_drop FROM timed)""", ("timed",))
def drop_flags(spark, sf) -> DataFrame:
    return time_features(spark, sf)


@query("t18_expanding_fill_mean", KEYS + " container_fill_mean:f",
       f"SELECT *, avg(percent_calculated) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS container_fill_mean FROM timed", ("timed",))
def expanding_fill_mean(spark, sf) -> DataFrame:
    return time_features(spark, sf)


@query("t19_time_to_threshold", KEYS + " percent_calculated:f time_to_threshold_hours:f", "SELECT * FROM labelled", ("labelled",))
def time_to_threshold(spark, sf) -> DataFrame:
    return grid.label_time_to_threshold(grid_rows(spark, sf))


@query("t20_threshold_dataset", KEYS + " target:f", "SELECT * FROM ttt", ("ttt",))
def threshold_dataset(spark, sf) -> DataFrame:
    return threshold_rows(spark, sf)


@query("t21_threshold_coverage", "n_containers_total:i n_containers_with_ttt:i coverage_pct:f threshold:f", """
SELECT count(DISTINCT container_id) AS n_containers_total,
       count(DISTINCT CASE WHEN time_to_threshold_hours IS NOT NULL THEN container_id END) AS n_containers_with_ttt,
       100.0 * count(DISTINCT CASE WHEN time_to_threshold_hours IS NOT NULL THEN container_id END) / count(DISTINCT container_id) AS coverage_pct,
       85.0 AS threshold FROM labelled""", ("labelled",))
def threshold_coverage(spark, sf) -> DataFrame:
    return grid.threshold_coverage(grid_rows(spark, sf))


@query("t22_threshold_features", KEYS + " fill_gap:f fill_lag_1:f fill_lag_2:f fill_lag_4:f fill_lag_8:f fill_change_24h:f fill_rate_per_hour:f estimated_time_linear:f hour:i day_of_week:i is_weekend:i",
       """SELECT *, hour(measured_at_utc) AS hour, isodow(measured_at_utc) - 1 AS day_of_week,
                 CASE WHEN isodow(measured_at_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM ttt_features""", ("ttt_features",))
def threshold_features(spark, sf) -> DataFrame:
    return grid.add_threshold_features(threshold_rows(spark, sf))


@query("t23_keep_frequent", KEYS + " target:f", "SELECT * FROM ev WHERE container_id IN (SELECT container_id FROM ev GROUP BY 1 HAVING count(*) >= 10)", ("ev",))
def keep_frequent(spark, sf) -> DataFrame:
    return screening.keep_frequent(event_rows(spark, sf), 10)


@query("t23b_dropped_entities", "container_id:i n_samples:i", "SELECT container_id, count(*) AS n_samples FROM ev GROUP BY 1 HAVING count(*) < 10", ("ev",))
def dropped_entities(spark, sf) -> DataFrame:
    return screening.dropped_entities(event_rows(spark, sf), 10)


@query("t23c_filter_summary", "min_samples:i kept_containers:i dropped_containers:i kept_rows:i original_rows:i", """
SELECT 10 AS min_samples, count(*) FILTER (WHERE n >= 10) AS kept_containers, count(*) FILTER (WHERE n < 10) AS dropped_containers,
       sum(CASE WHEN n >= 10 THEN n ELSE 0 END) AS kept_rows, sum(n) AS original_rows
FROM (SELECT container_id, count(*) AS n FROM ev GROUP BY 1)""", ("ev",))
def filter_summary(spark, sf) -> DataFrame:
    return screening.filter_summary(event_rows(spark, sf), 10)


@query("t24_leakage_check", "feature:s n_issues:i n_containers:i", """
SELECT feature, sum(issue) AS n_issues, count(*) AS n_containers FROM (
  SELECT container_id, unnest(['target_lag_1', 'target_lag_2', 'target_lag_3', 'target_lag_4', 'target_lag_5', 'target_lag_6', 'target_lag_7', 'target_lag_8', 'target_lag_9', 'target_lag_10']) AS feature,
         unnest([target_lag_1 IS NOT NULL, target_lag_2 IS NOT NULL, target_lag_3 IS NOT NULL, target_lag_4 IS NOT NULL, target_lag_5 IS NOT NULL, target_lag_6 IS NOT NULL, target_lag_7 IS NOT NULL, target_lag_8 IS NOT NULL, target_lag_9 IS NOT NULL, target_lag_10 IS NOT NULL])::INT AS issue
  FROM (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS rn, count(*) OVER (PARTITION BY container_id) AS n FROM evf)
  WHERE rn = 1 AND n >= 3) GROUP BY 1""", ("evf",))
def leakage_check(spark, sf) -> DataFrame:
    rows = event_features(spark, sf)
    return screening.leakage_issues(rows, [f"target_lag_{k}" for k in range(1, 11)], long_series(spark, sf))


@query("t25_first_rows_per_container", KEYS + " target:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS rn FROM ev) WHERE rn <= 5""", ("ev",))
def first_rows_per_container(spark, sf) -> DataFrame:
    return events.first_rows_per_series(event_rows(spark, sf), 5, long_series(spark, sf))
