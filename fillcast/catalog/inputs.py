"""The given tables as this library's inputs: readings and weather derived from `events`,
holiday years from `orders`, categories from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillcast.catalog.registry import part
from fillcast.config import DEFAULTS
from fillcast.functions.columns import clip
from fillcast.operators import baselines, cleaning, emptying, events, grid
from fillcast.operators.ordered import LongSeries, find_long_series
from fillcast.sources.tables import normalise_weather

# The tables have about 58 readings and 90 grid rows per container, so the entity filters
# are set lower than their defaults.
CHECKED = DEFAULTS.with_(min_events=8, min_grid_rows=50)

READINGS = """
SELECT user_id AS container_id, ts AS measured_at_utc, value AS percent_calculated,
       CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'neznamy'
            WHEN event_type = 'signup' THEN 'Bio' ELSE event_type END AS trash_type,
       CASE user_id % 4 WHEN 0 THEN '1100 Nadzemni' WHEN 1 THEN '2300 Nadzemni'
                        WHEN 2 THEN '3000 Podzemni SV' ELSE NULL END AS container_type,
       concat('praha-', CAST(user_id % 10 + 1 AS VARCHAR(4))) AS district,
       CAST(50000 + (user_id * 37 % 200) AS DOUBLE) / 1000 AS latitude,
       CAST(14000 + (user_id * 53 % 900) AS DOUBLE) / 1000 AS longitude,
       CAST(event_id % 97 - 35 AS DOUBLE) AS temperature,
       CAST(event_id % 7 AS INT) AS firealarm,
       CAST(event_id % 101 AS DOUBLE) AS humidity
FROM events
"""

WEATHER_COLUMNS = (
    "CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k * 7 % 40 - 8 AS DOUBLE) END AS tavg",
    "CAST(k * 7 % 40 - 12 AS DOUBLE) AS tmin",
    "CAST(k * 7 % 40 - 3 AS DOUBLE) AS tmax",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(greatest(k * 5 % 13 - 6, 0) AS DOUBLE) * 1.5 END AS prcp",
    "CAST(k * 11 % 60 AS DOUBLE) AS wspd",
    "CAST(990 + k * 13 % 40 AS DOUBLE) AS pres",
)
WEATHER_VALUES = ", ".join(WEATHER_COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READINGS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_readings(raw_readings(spark, sf_dir).drop("humidity"))


def clean_with_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_readings(raw_readings(spark, sf_dir))


_PROFILES: dict[tuple[str, str], LongSeries | None] = {}


def long_series(spark: SparkSession, sf_dir: str) -> LongSeries | None:
    """Long containers of a data set; looked up once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PROFILES:
        ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("container_id"))
        _PROFILES[key] = find_long_series(ids)
    return _PROFILES[key]


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emptying.detect_collections(clean(spark, sf_dir), long=long_series(spark, sf_dir))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.create_event_dataset(detected(spark, sf_dir))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.add_event_features(event_rows(spark, sf_dir), long=long_series(spark, sf_dir))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resample_time_series(clean(spark, sf_dir))


def time_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.create_time_dataset(clean(spark, sf_dir))


def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.add_time_features(time_rows(spark, sf_dir))


def threshold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.create_threshold_dataset(grid_rows(spark, sf_dir))


def weather_daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "events").select(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("k")).distinct()
    return k.selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(k AS INT)) AS time", *WEATHER_COLUMNS)


def weather_fine_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2024-01-01 03:00:00'"), F.col("ts"))
    k = table(spark, sf_dir, "events").filter(
        F.col("ts") >= F.expr("timestamp_ntz'2024-01-01 03:00:00'")).select(F.floor(hours / 5).cast("long").alias("k")).distinct()
    return k.selectExpr("timestamp_ntz'2024-01-01 03:00:00' + make_dt_interval(0, CAST(5 * k AS INT)) AS time", *WEATHER_COLUMNS)


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_weather(weather_daily_raw(spark, sf_dir))


def weather_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_weather(weather_fine_raw(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-free 24-hour prediction: a mix of the current and the previous fill level."""
    mix = F.col("percent_calculated") * 0.7 + F.col("fill_lag_1") * 0.3
    return time_features(spark, sf_dir).select(
        "container_id", "measured_at_utc", "trash_type", F.col("target").alias("actual"), clip(mix, 0, 100).alias("predicted"),
        clip(F.col("percent_calculated"), 0, 100).alias("baseline"))


def day_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = grid.add_threshold_features(threshold_rows(spark, sf_dir))
    return baselines.linear_extrapolation(labelled).select("container_id", "measured_at_utc", "actual", "predicted")


# -- the same inputs as SQL ------------------------------------------------------

part("readings", READINGS)
part("kept", """
SELECT container_id, measured_at_utc, percent_calculated, trash_type, container_type, district, latitude, longitude,
       CASE WHEN temperature >= -30 AND temperature <= 50 THEN temperature END AS temperature,
       CASE WHEN firealarm > 0 THEN 1 ELSE 0 END AS firealarm, humidity,
       CAST(nullif(regexp_extract(district, 'praha-([0-9]+)', 1), '') AS DOUBLE) AS district_num
FROM readings
WHERE trash_type IS NOT NULL AND trash_type <> 'neznamy' AND percent_calculated >= 0 AND percent_calculated <= 100
""", "readings")
part("classes", """
SELECT container_id, mode_type,
       CASE WHEN cap IS NULL THEN 'unknown' WHEN cap <= 2150 THEN 'low' WHEN cap >= 2500 THEN 'high' ELSE 'medium' END AS capacity_class
FROM (SELECT i.container_id, t.container_type AS mode_type,
             CAST(nullif(regexp_extract(t.container_type, '^\\s*([0-9]+)', 1), '') AS DOUBLE) AS cap
      FROM (SELECT DISTINCT container_id FROM kept) i
      LEFT JOIN (SELECT container_id, container_type,
                        row_number() OVER (PARTITION BY container_id ORDER BY count(*) DESC, container_type) AS rn
                 FROM kept WHERE container_type IS NOT NULL GROUP BY container_id, container_type) t
        ON t.container_id = i.container_id AND t.rn = 1)
""", "kept")
part("clean", "SELECT k.*, c.capacity_class FROM kept k JOIN classes c ON c.container_id = k.container_id", "kept", "classes")
part("changed", """
SELECT *, percent_calculated - pct_prev AS pct_change, date_diff('microsecond', time_prev, measured_at_utc) / 3600000000.0 AS hours_since_prev
FROM (SELECT *, lag(percent_calculated) OVER w AS pct_prev, lag(measured_at_utc) OVER w AS time_prev,
             lead(percent_calculated) OVER w AS pct_next
      FROM clean WINDOW w AS (PARTITION BY container_id ORDER BY measured_at_utc, percent_calculated))
""", "clean")
part("limits", "SELECT container_id, quantile_cont(pct_change, 0.1) AS p10 FROM changed GROUP BY container_id", "changed")
part("detected", """
SELECT c.*, CASE WHEN pct_change <= greatest(p10, -30) AND hours_since_prev <= 168 AND percent_calculated < 50 AND pct_prev > 40
                 THEN 1 ELSE 0 END AS is_collection
FROM changed c JOIN limits l ON l.container_id = c.container_id
""", "changed", "limits")
part("ev", """
SELECT *, pct_prev AS target, CAST(measured_at_utc AS DATE) AS date, hour(measured_at_utc) AS hour,
       isodow(measured_at_utc) - 1 AS day_of_week, day(measured_at_utc) AS day_of_month, month(measured_at_utc) AS month,
       week(measured_at_utc) AS week_of_year, CASE WHEN isodow(measured_at_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM detected WHERE is_collection = 1 AND pct_prev IS NOT NULL
""", "detected")
part("ev_gaps", """
SELECT *, date_diff('day', lag(date) OVER w, date) AS days_since_prev_collection
FROM ev WINDOW w AS (PARTITION BY container_id ORDER BY measured_at_utc)
""", "ev")
_lags = ", ".join(f"lag(target, {k}) OVER w AS target_lag_{k}" for k in range(1, 11))
_gaps = ", ".join(f"lag(days_since_prev_collection, {k}) OVER w AS interval_lag_{k}" for k in (1, 2, 3))
_rolls = ", ".join(
    f"avg(target) OVER w{k} AS target_roll_mean_{k}, stddev_samp(target) OVER w{k} AS target_roll_std_{k}, "
    f"max(target) OVER w{k} AS target_roll_max_{k}, avg(days_since_prev_collection) OVER w{k} AS interval_roll_mean_{k}"
    for k in (3, 5, 7))
_frames = ", ".join(
    f"w{k} AS (PARTITION BY container_id ORDER BY measured_at_utc ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 5, 7))
part("evf", f"""
SELECT *, target_lag_1 - target_lag_2 AS target_trend, target_lag_1 / nullif(interval_lag_1, 0) AS fill_rate,
       CASE WHEN target_same_dow IS NULL THEN 1 ELSE 0 END AS target_same_dow_missing,
       CASE WHEN target_lag_3 IS NULL THEN 1 ELSE 0 END AS target_lag_3_missing
FROM (SELECT *, {_lags}, {_gaps}, {_rolls},
             avg(target) OVER past AS container_hist_mean, stddev_samp(target) OVER past AS container_hist_std,
             lag(target) OVER (PARTITION BY container_id, day_of_week ORDER BY measured_at_utc) AS target_same_dow
      FROM ev_gaps
      WINDOW w AS (PARTITION BY container_id ORDER BY measured_at_utc), {_frames},
             past AS (PARTITION BY container_id ORDER BY measured_at_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""", "ev_gaps")
part("grid", """
SELECT container_id, measured_at_utc, percent_calculated
FROM (SELECT s.container_id, s.slot AS measured_at_utc,
             last_value(b.fill IGNORE NULLS) OVER (PARTITION BY s.container_id ORDER BY s.slot
                                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS percent_calculated
      FROM (SELECT container_id, unnest(generate_series(min(slot), max(slot), INTERVAL 6 HOURS)) AS slot
            FROM (SELECT container_id, time_bucket(INTERVAL 6 HOURS, measured_at_utc) AS slot FROM clean)
            GROUP BY container_id) s
      LEFT JOIN (SELECT container_id, time_bucket(INTERVAL 6 HOURS, measured_at_utc) AS slot, arg_max(percent_calculated, measured_at_utc) AS fill
                 FROM clean GROUP BY 1, 2) b
        ON b.container_id = s.container_id AND b.slot = s.slot)
WHERE percent_calculated IS NOT NULL
""", "clean")
part("carried", """
SELECT container_id, arg_min(container_type, measured_at_utc) AS container_type, arg_min(trash_type, measured_at_utc) AS trash_type,
       arg_min(district, measured_at_utc) AS district, arg_min(district_num, measured_at_utc) AS district_num,
       arg_min(capacity_class, measured_at_utc) AS capacity_class, arg_min(latitude, measured_at_utc) AS latitude,
       arg_min(longitude, measured_at_utc) AS longitude
FROM clean GROUP BY container_id
""", "clean")
part("timed", """
SELECT * FROM (
  SELECT g.*, c.trash_type, lead(g.percent_calculated, 4) OVER (PARTITION BY g.container_id ORDER BY g.measured_at_utc) AS target,
         CAST(g.measured_at_utc AS DATE) AS date, hour(g.measured_at_utc) AS hour, isodow(g.measured_at_utc) - 1 AS day_of_week,
         month(g.measured_at_utc) AS month, CASE WHEN isodow(g.measured_at_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend
  FROM grid g JOIN carried c ON c.container_id = g.container_id)
WHERE target IS NOT NULL
""", "grid", "carried")
part("predicted", """
SELECT container_id, measured_at_utc, trash_type, target AS actual,
       CASE WHEN lag_1 IS NOT NULL THEN least(greatest(percent_calculated * 0.7 + lag_1 * 0.3, 0), 100) END AS predicted,
       least(greatest(percent_calculated, 0), 100) AS baseline
FROM (SELECT *, lag(percent_calculated) OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS lag_1 FROM timed)
""", "timed")
part("pairs", "SELECT *, actual - predicted AS e FROM predicted WHERE actual IS NOT NULL AND predicted IS NOT NULL", "predicted")
part("numbered", """
SELECT *, row_number() OVER w AS i,
       CASE WHEN percent_calculated < lag(percent_calculated) OVER w - 25 THEN 1 ELSE 0 END AS fell
FROM grid WINDOW w AS (PARTITION BY container_id ORDER BY measured_at_utc)
""", "grid")
part("labelled", """
SELECT a.container_id, a.measured_at_utc, a.percent_calculated,
       CASE WHEN a.percent_calculated >= 85 THEN 0.0
            WHEN f.hit IS NOT NULL AND (f.fall IS NULL OR f.hit < f.fall) THEN (f.hit - a.i) * 6.0 END AS time_to_threshold_hours
FROM numbered a
LEFT JOIN (SELECT x.container_id, x.i, min(CASE WHEN y.percent_calculated >= 85 THEN y.i END) AS hit,
                  min(CASE WHEN y.fell = 1 THEN y.i END) AS fall
           FROM numbered x JOIN numbered y ON y.container_id = x.container_id AND y.i > x.i AND y.i <= x.i + 99
           GROUP BY x.container_id, x.i) f
  ON f.container_id = a.container_id AND f.i = a.i
""", "numbered")
part("ttt", """
SELECT *, time_to_threshold_hours / 24 AS target FROM labelled
WHERE time_to_threshold_hours > 0 AND time_to_threshold_hours <= 336
""", "labelled")
part("ttt_features", """
SELECT *, 85 - percent_calculated AS fill_gap, percent_calculated - fill_lag_4 AS fill_change_24h,
       (percent_calculated - fill_lag_4) / 24 AS fill_rate_per_hour,
       CASE WHEN fill_lag_4 IS NOT NULL AND percent_calculated <> fill_lag_4
            THEN least(greatest((85 - percent_calculated) / ((percent_calculated - fill_lag_4) / 24 * 24), 0), 14) END AS estimated_time_linear
FROM (SELECT *, lag(percent_calculated, 1) OVER w AS fill_lag_1, lag(percent_calculated, 2) OVER w AS fill_lag_2,
             lag(percent_calculated, 4) OVER w AS fill_lag_4, lag(percent_calculated, 8) OVER w AS fill_lag_8
      FROM ttt WINDOW w AS (PARTITION BY container_id ORDER BY measured_at_utc))
""", "ttt")
part("day_pairs", """
SELECT container_id, measured_at_utc, target AS actual,
       least(greatest(coalesce(estimated_time_linear, (SELECT avg(target) FROM ttt_features)), 0), 14) AS predicted
FROM ttt_features
""", "ttt_features")
_normal = """time AS weather_time, tavg AS temperature, tmin AS temp_min, tmax AS temp_max, tmax - tmin AS temp_daily_range_src,
       coalesce(prcp, 0.0) AS precipitation, wspd / 3.6 AS wind_speed, pres AS pressure"""
part("days_raw", f"""
SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * k AS time, {WEATHER_VALUES}
FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS k FROM events)
""")
part("days", f"SELECT {_normal} FROM days_raw", "days_raw")
part("fine_raw", f"""
SELECT TIMESTAMP '2024-01-01 03:00:00' + INTERVAL 1 HOUR * (5 * k) AS time, {WEATHER_VALUES}
FROM (SELECT DISTINCT CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01 03:00:00', ts) / 18000000000.0) AS BIGINT) AS k
      FROM events WHERE ts >= TIMESTAMP '2024-01-01 03:00:00')
""")
part("fine", f"SELECT {_normal} FROM fine_raw", "fine_raw")
