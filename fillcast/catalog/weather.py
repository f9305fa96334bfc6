"""Queries on weather: normalising, joining, gap handling and every feature family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import (
    clean, clean_with_humidity, event_rows, long_series, raw_readings, time_rows, weather_daily, weather_daily_raw,
    weather_fine, weather_fine_raw)
from fillcast.catalog.registry import part, query
from fillcast.config import DEFAULTS
from fillcast.operators import cleaning, emptying, events, grid
from fillcast.operators import weather as wx
from fillcast.sources.tables import normalise_weather

KEYS = "container_id:i measured_at_utc:u"
VALUES = "temperature:f precipitation:f wind_speed:f pressure:f"
NORMAL = "weather_time:u " + VALUES + " temp_min:f temp_max:f temp_daily_range_src:f"
FILL = DEFAULTS.with_(weather_override=False)
MERGED = DEFAULTS.with_(weather_broadcast_rows=0, block_rows=100_000)


# -- check SQL --------------------------------------------------------------------

part("joined_days", """
SELECT c.* EXCLUDE (temperature), w.temperature, w.precipitation, w.wind_speed, w.pressure, w.temp_min, w.temp_max, w.temp_daily_range_src
FROM clean c LEFT JOIN days w ON CAST(w.weather_time AS DATE) = CAST(c.measured_at_utc AS DATE)""", "clean", "days")
part("joined_fine", """
SELECT c.* EXCLUDE (temperature), w.temperature, w.precipitation, w.wind_speed, w.pressure, w.temp_min, w.temp_max, w.temp_daily_range_src
FROM clean c ASOF LEFT JOIN fine w ON c.measured_at_utc >= w.weather_time""", "clean", "fine")


def _ensured(source: str) -> str:
    flags = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in ("temperature", "precipitation", "wind_speed", "pressure"))
    fills = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY measured_at_utc ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("temperature", "wind_speed", "pressure"))
    return f"""SELECT * EXCLUDE (temperature, precipitation, wind_speed, pressure), coalesce(precipitation, 0.0) AS precipitation, {fills}, {flags} FROM {source}"""


part("ready_fine", _ensured("joined_fine"), "joined_fine")
part("ev_joined", """
SELECT e.* EXCLUDE (temperature), w.temperature, w.precipitation, w.wind_speed, w.pressure
FROM ev e ASOF LEFT JOIN fine w ON e.measured_at_utc >= w.weather_time""", "ev", "fine")
part("ev_ready", _ensured("ev_joined"), "ev_joined")
part("grid_joined", """
SELECT t.*, w.temperature, w.precipitation, w.wind_speed, w.pressure
FROM timed t LEFT JOIN days w ON CAST(w.weather_time AS DATE) = t.date""", "timed", "days")
part("grid_ready", _ensured("grid_joined"), "grid_joined")

_FLAGS = """
       CASE WHEN temperature <= 0 THEN 1 ELSE 0 END AS temp_freezing, CASE WHEN temperature < 5 THEN 1 ELSE 0 END AS temp_cold,
       CASE WHEN temperature >= 5 AND temperature < 20 THEN 1 ELSE 0 END AS temp_mild,
       CASE WHEN temperature >= 20 AND temperature < 30 THEN 1 ELSE 0 END AS temp_warm, CASE WHEN temperature >= 30 THEN 1 ELSE 0 END AS temp_hot,
       CASE WHEN precipitation > 0 THEN 1 ELSE 0 END AS is_raining,
       CASE WHEN precipitation > 0 AND precipitation < 2.5 THEN 1 ELSE 0 END AS rain_light,
       CASE WHEN precipitation >= 2.5 AND precipitation < 7.5 THEN 1 ELSE 0 END AS rain_moderate,
       CASE WHEN precipitation >= 7.5 THEN 1 ELSE 0 END AS rain_heavy,
       CASE WHEN wind_speed < 2 THEN 1 ELSE 0 END AS wind_calm, CASE WHEN wind_speed >= 2 AND wind_speed < 8 THEN 1 ELSE 0 END AS wind_moderate,
       CASE WHEN wind_speed >= 8 THEN 1 ELSE 0 END AS wind_strong,
       CASE WHEN pressure < 1000 THEN 1 ELSE 0 END AS pressure_low, CASE WHEN pressure > 1020 THEN 1 ELSE 0 END AS pressure_high"""
part("ev_flags", f"SELECT *, {_FLAGS} FROM ev_ready", "ev_ready")
part("grid_flags", f"SELECT *, {_FLAGS} FROM grid_ready", "grid_ready")

_W = "OVER (PARTITION BY container_id ORDER BY measured_at_utc"


def _roll(f: str, c: str, k: int) -> str:
    return f"{f}({c}) {_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) {_W})"


TIMED = [(1, "6h"), (2, "12h"), (4, "24h"), (8, "48h")]
EVENTS = [(3, "3_event"), (5, "5_event"), (7, "7_event")]
EVENT_LAGS = [(k, f"{k}_event") for k in (1, 2, 3)]


# -- Spark side -------------------------------------------------------------------

def events_with_weather(spark, sf) -> DataFrame:
    return wx.ensure_weather_columns(wx.merge_weather(event_rows(spark, sf), weather_fine(spark, sf)))


def grid_with_weather(spark, sf) -> DataFrame:
    return wx.ensure_weather_columns(wx.merge_weather(time_rows(spark, sf), weather_daily(spark, sf)))


def event_families(spark, sf, *families) -> DataFrame:
    return wx.add_weather_families(
        events_with_weather(spark, sf), wx.frames_for("event"), families or tuple(wx.FAMILIES), long_series(spark, sf))


def grid_families(spark, sf, *families) -> DataFrame:
    return wx.add_weather_families(grid_with_weather(spark, sf), wx.frames_for("time", 6), families or tuple(wx.FAMILIES))


@query("w01_normalise_daily", NORMAL, "SELECT * FROM days", ("days",))
def normalise_daily(spark, sf) -> DataFrame:
    return weather_daily(spark, sf)


@query("w01b_normalise_without_average", NORMAL, """
SELECT time AS weather_time, (tmin + tmax) / 2 AS temperature, tmin AS temp_min, tmax AS temp_max, tmax - tmin AS temp_daily_range_src,
       NULL AS precipitation, wspd / 3.6 AS wind_speed, pres AS pressure FROM fine_raw""", ("fine_raw",))
def normalise_without_average(spark, sf) -> DataFrame:
    return normalise_weather(weather_fine_raw(spark, sf).drop("tavg", "prcp"))


@query("w02_deduplicate", NORMAL, "SELECT * FROM fine", ("fine",))
def deduplicate(spark, sf) -> DataFrame:
    raw = weather_fine_raw(spark, sf)
    older = raw.withColumns({"tavg": F.lit(-99.0), "prcp": F.lit(None).cast("double")}).filter(F.col("tavg") < F.coalesce(raw["tavg"], F.lit(-100.0)))
    return normalise_weather(older.unionByName(raw))


@query("w03_granularity", "source:s n_rows:i is_daily:i", """
SELECT 'days' AS source, count(*) AS n_rows, CAST(bool_and(weather_time = date_trunc('day', weather_time)) AS INT) AS is_daily FROM days
UNION ALL SELECT 'fine', count(*), CAST(bool_and(weather_time = date_trunc('day', weather_time)) AS INT) FROM fine""", ("days", "fine"))
def granularity(spark, sf) -> DataFrame:
    daily = F.bool_and(F.col("weather_time") == F.date_trunc("day", "weather_time")).cast("int")
    parts = [t.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n_rows"), daily.alias("is_daily"))
             for n, t in (("days", weather_daily(spark, sf)), ("fine", weather_fine(spark, sf)))]
    return parts[0].unionByName(parts[1])


@query("w04_date_join", KEYS + " " + VALUES + " temp_min:f temp_max:f temp_daily_range_src:f", "SELECT * FROM joined_days", ("joined_days",))
def date_join(spark, sf) -> DataFrame:
    return wx.merge_weather(clean(spark, sf), weather_daily(spark, sf))


@query("w05_asof_join", KEYS + " " + VALUES + " temp_min:f temp_max:f temp_daily_range_src:f", "SELECT * FROM joined_fine", ("joined_fine",))
def asof_join(spark, sf) -> DataFrame:
    return wx.merge_weather(clean(spark, sf), weather_fine(spark, sf))


@query("w05b_asof_merge", KEYS + " " + VALUES + " temp_min:f temp_max:f temp_daily_range_src:f", "SELECT * FROM joined_fine", ("joined_fine",))
def asof_merge(spark, sf) -> DataFrame:
    return wx.merge_weather(clean(spark, sf), weather_fine(spark, sf), MERGED)


@query("w06_fill_existing", KEYS + " " + VALUES, """
SELECT c.container_id, c.measured_at_utc, coalesce(c.temperature, w.temperature) AS temperature, w.precipitation, w.wind_speed, w.pressure
FROM clean c ASOF LEFT JOIN fine w ON c.measured_at_utc >= w.weather_time""", ("clean", "fine"))
def fill_existing(spark, sf) -> DataFrame:
    return wx.merge_weather(clean(spark, sf), weather_fine(spark, sf), FILL)


@query("w07_coverage", "temperature_coverage:f precipitation_coverage:f wind_speed_coverage:f pressure_coverage:f", """
SELECT avg(CAST(temperature IS NOT NULL AS INT)) AS temperature_coverage, avg(CAST(precipitation IS NOT NULL AS INT)) AS precipitation_coverage,
       avg(CAST(wind_speed IS NOT NULL AS INT)) AS wind_speed_coverage, avg(CAST(pressure IS NOT NULL AS INT)) AS pressure_coverage
FROM joined_fine""", ("joined_fine",))
def coverage(spark, sf) -> DataFrame:
    return wx.weather_coverage(wx.merge_weather(clean(spark, sf), weather_fine(spark, sf)))


MISSING = "temperature_missing:i precipitation_missing:i wind_speed_missing:i pressure_missing:i"


@query("w08_forward_fill", f"{KEYS} {VALUES} {MISSING}", "SELECT * FROM ready_fine", ("ready_fine",))
def forward_fill(spark, sf) -> DataFrame:
    return wx.ensure_weather_columns(wx.merge_weather(clean(spark, sf), weather_fine(spark, sf)))


@query("w08b_forward_fill_readings", f"{KEYS} {VALUES} {MISSING}", """
SELECT * EXCLUDE (temperature), last_value(temperature IGNORE NULLS) OVER (ORDER BY measured_at_utc ROWS UNBOUNDED PRECEDING) AS temperature,
       CASE WHEN temperature IS NULL THEN 1 ELSE 0 END AS temperature_missing, 0.0 AS precipitation, NULL AS wind_speed, NULL AS pressure,
       1 AS precipitation_missing, 1 AS wind_speed_missing, 1 AS pressure_missing FROM clean""", ("clean",))
def forward_fill_readings(spark, sf) -> DataFrame:
    return wx.ensure_weather_columns(clean(spark, sf))


@query("w09_temperature_flags", KEYS + " temp_freezing:i temp_cold:i temp_mild:i temp_warm:i temp_hot:i temp_squared:f temp_abs_deviation:f",
       "SELECT *, temperature * temperature AS temp_squared, abs(temperature - 15) AS temp_abs_deviation FROM ev_flags", ("ev_flags",))
def temperature_flags(spark, sf) -> DataFrame:
    return event_families(spark, sf, "temperature")


@query("w10_temperature_anomaly", KEYS + " temp_anomaly:f temp_above_normal:i temp_below_normal:i", """
SELECT *, CASE WHEN temp_anomaly > 5 THEN 1 ELSE 0 END AS temp_above_normal, CASE WHEN temp_anomaly < -5 THEN 1 ELSE 0 END AS temp_below_normal
FROM (SELECT *, temperature - (10 + 10 * sin(2 * pi() * (dayofyear(measured_at_utc) - 100) / 365.0)) AS temp_anomaly FROM ev_ready)""", ("ev_ready",))
def temperature_anomaly(spark, sf) -> DataFrame:
    return event_families(spark, sf, "temperature")


@query("w11_temperature_lags_time", KEYS + " temp_lag_6h:f temp_lag_12h:f temp_lag_24h:f temp_change_6h:f temp_change_24h:f", f"""
SELECT *, {_lag('temperature', 1)} AS temp_lag_6h, {_lag('temperature', 2)} AS temp_lag_12h, {_lag('temperature', 4)} AS temp_lag_24h,
       temperature - {_lag('temperature', 1)} AS temp_change_6h, temperature - {_lag('temperature', 4)} AS temp_change_24h FROM grid_ready""", ("grid_ready",))
def temperature_lags_time(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "temperature")


@query("w11b_temperature_lags_event", KEYS + " temp_lag_1_event:f temp_lag_2_event:f temp_lag_3_event:f temp_change_1_event:f", f"""
SELECT *, {', '.join(f"{_lag('temperature', k)} AS temp_lag_{x}" for k, x in EVENT_LAGS)},
       temperature - {_lag('temperature', 1)} AS temp_change_1_event FROM ev_ready""", ("ev_ready",))
def temperature_lags_event(spark, sf) -> DataFrame:
    return event_families(spark, sf, "temperature")


def _temp_rolls(pairs) -> str:
    names = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    return ", ".join(f"{_roll(f, 'temperature', k)} AS temp_roll_{n}_{x}" for k, x in pairs for n, f in names.items())


def _temp_spec(pairs) -> str:
    return " ".join(f"temp_roll_{n}_{x}:f" for _, x in pairs for n in ("mean", "std", "max", "min"))


@query("w12_temperature_rolling_time", f"{KEYS} {_temp_spec(TIMED)} temp_daily_range:f",
       f"SELECT *, temp_roll_max_24h - temp_roll_min_24h AS temp_daily_range FROM (SELECT *, {_temp_rolls(TIMED)} FROM grid_ready)", ("grid_ready",))
def temperature_rolling_time(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "temperature")


@query("w12b_temperature_rolling_event", f"{KEYS} {_temp_spec(EVENTS)}", f"SELECT *, {_temp_rolls(EVENTS)} FROM ev_ready", ("ev_ready",))
def temperature_rolling_event(spark, sf) -> DataFrame:
    return event_families(spark, sf, "temperature")


@query("w13_rain_flags", KEYS + " is_raining:i rain_light:i rain_moderate:i rain_heavy:i", "SELECT * FROM grid_flags", ("grid_flags",))
def rain_flags(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "precipitation")


@query("w14_rain_history_time", KEYS + " precip_lag_6h:f precip_lag_12h:f precip_lag_24h:f " +
       " ".join(f"rained_last_{x}:i" for _, x in TIMED) + " precip_sum_6h:f precip_sum_24h:f precip_sum_48h:f",
       f"""SELECT *, {', '.join(f"{_lag('precipitation', k)} AS precip_lag_{x}" for k, x in TIMED[:3])},
              {', '.join(f"coalesce({_roll('max', 'is_raining', k)}, 0) AS rained_last_{x}" for k, x in TIMED)},
              {', '.join(f"{_roll('sum', 'precipitation', k)} AS precip_sum_{x}" for k, x in (TIMED[0], TIMED[2], TIMED[3]))} FROM grid_flags""", ("grid_flags",))
def rain_history_time(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "precipitation")


@query("w14b_rain_history_event", KEYS + " " + " ".join(f"precip_lag_{x}:f" for _, x in EVENT_LAGS) + " " +
       " ".join(f"rained_last_{x}:i precip_sum_{x}:f" for _, x in EVENTS),
       f"""SELECT *, {', '.join(f"{_lag('precipitation', k)} AS precip_lag_{x}" for k, x in EVENT_LAGS)},
              {', '.join(f"coalesce({_roll('max', 'is_raining', k)}, 0) AS rained_last_{x}, {_roll('sum', 'precipitation', k)} AS precip_sum_{x}" for k, x in EVENTS)}
           FROM ev_flags""", ("ev_flags",))
def rain_history_event(spark, sf) -> DataFrame:
    return event_families(spark, sf, "precipitation")


def _dry(source: str, scale: int, cap: int, name: str) -> str:
    return f"""
SELECT *, least((row_number() OVER (PARTITION BY container_id, island ORDER BY measured_at_utc) - 1) * {scale}, {cap}) AS {name}
FROM (SELECT *, sum(is_raining) {_W} ROWS UNBOUNDED PRECEDING) AS island FROM {source})"""


@query("w15_dry_hours", KEYS + " dry_hours:i", _dry("grid_flags", 6, 168, "dry_hours"), ("grid_flags",))
def dry_hours(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "precipitation")


@query("w15b_dry_events", KEYS + " dry_events:i", _dry("ev_flags", 1, 50, "dry_events"), ("ev_flags",))
def dry_events(spark, sf) -> DataFrame:
    return event_families(spark, sf, "precipitation")


def events_with_humidity(spark, sf) -> DataFrame:
    rows = events.create_event_dataset(emptying.detect_collections(clean_with_humidity(spark, sf), long=long_series(spark, sf)))
    return wx.ensure_weather_columns(wx.merge_weather(rows, weather_fine(spark, sf)))


@query("w16_humidity", KEYS + " humidity_low:i humidity_comfortable:i humidity_high:i humidity_change_1_event:f " +
       " ".join(f"humidity_roll_mean_{x}:f" for _, x in EVENTS),
       f"""SELECT *, CASE WHEN humidity < 40 THEN 1 ELSE 0 END AS humidity_low, CASE WHEN humidity >= 40 AND humidity <= 80 THEN 1 ELSE 0 END AS humidity_comfortable,
              CASE WHEN humidity > 80 THEN 1 ELSE 0 END AS humidity_high, humidity - {_lag('humidity', 1)} AS humidity_change_1_event,
              {', '.join(f"{_roll('avg', 'humidity', k)} AS humidity_roll_mean_{x}" for k, x in EVENTS)} FROM ev""", ("ev",))
def humidity(spark, sf) -> DataFrame:
    return wx.add_weather_families(events_with_humidity(spark, sf), wx.frames_for("event"), ("humidity",), long_series(spark, sf))


@query("w17_wind_time", KEYS + " wind_calm:i wind_moderate:i wind_strong:i wind_roll_mean_6h:f wind_roll_max_6h:f wind_roll_mean_24h:f wind_roll_max_24h:f", f"""
SELECT *, {', '.join(f"{_roll('avg', 'wind_speed', k)} AS wind_roll_mean_{x}, {_roll('max', 'wind_speed', k)} AS wind_roll_max_{x}" for k, x in (TIMED[0], TIMED[2]))}
FROM grid_flags""", ("grid_flags",))
def wind_time(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "wind")


@query("w17b_wind_event", KEYS + " " + " ".join(f"wind_roll_mean_{x}:f wind_roll_max_{x}:f" for _, x in EVENTS), f"""
SELECT *, {', '.join(f"{_roll('avg', 'wind_speed', k)} AS wind_roll_mean_{x}, {_roll('max', 'wind_speed', k)} AS wind_roll_max_{x}" for k, x in EVENTS)}
FROM ev_flags""", ("ev_flags",))
def wind_event(spark, sf) -> DataFrame:
    return event_families(spark, sf, "wind")


@query("w18_pressure_time", KEYS + " pressure_low:i pressure_high:i pressure_change_24h:f",
       f"SELECT *, pressure - {_lag('pressure', 4)} AS pressure_change_24h FROM grid_flags", ("grid_flags",))
def pressure_time(spark, sf) -> DataFrame:
    return grid_families(spark, sf, "pressure")


@query("w18b_pressure_event", KEYS + " pressure_change_1_event:f pressure_falling_event:i pressure_rising_event:i", f"""
SELECT *, CASE WHEN c < -3 THEN 1 ELSE 0 END AS pressure_falling_event, CASE WHEN c > 3 THEN 1 ELSE 0 END AS pressure_rising_event, c AS pressure_change_1_event
FROM (SELECT *, pressure - {_lag('pressure', 1)} AS c FROM ev_flags)""", ("ev_flags",))
def pressure_event(spark, sf) -> DataFrame:
    return event_families(spark, sf, "pressure")


@query("w18c_pressure_three_hours", KEYS + " pressure_change_3h:f pressure_falling:i pressure_rising:i pressure_change_24h:f", f"""
SELECT *, CASE WHEN c < -3 THEN 1 ELSE 0 END AS pressure_falling, CASE WHEN c > 3 THEN 1 ELSE 0 END AS pressure_rising, c AS pressure_change_3h
FROM (SELECT *, pressure - {_lag('pressure', 1)} AS c, pressure - {_lag('pressure', 8)} AS pressure_change_24h FROM grid_flags)""", ("grid_flags",))
def pressure_three_hours(spark, sf) -> DataFrame:
    return wx.add_weather_families(grid_with_weather(spark, sf), wx.frames_for("time", 3), ("pressure",))


_CHILL = """CASE WHEN temperature <= 10 AND wind_speed * 3.6 > 4.8
                THEN 13.12 + 0.6215 * temperature - 11.37 * power(wind_speed * 3.6, 0.16) + 0.3965 * temperature * power(wind_speed * 3.6, 0.16)
                ELSE temperature END"""


@query("w19_comfort", KEYS + " heat_index:f wind_chill:f apparent_temp:f weather_comfort_score:f weather_comfortable:i weather_uncomfortable:i", f"""
SELECT *, CASE WHEN temperature >= 20 THEN heat_index WHEN temperature <= 10 THEN wind_chill ELSE temperature END AS apparent_temp,
       CASE WHEN weather_comfort_score >= 60 THEN 1 ELSE 0 END AS weather_comfortable, CASE WHEN weather_comfort_score < 40 THEN 1 ELSE 0 END AS weather_uncomfortable
FROM (SELECT *, {_CHILL} AS wind_chill,
             CASE WHEN temperature >= 20 THEN -8.78 + 1.61 * temperature + 2.34 * humidity - 0.09 * temperature * humidity ELSE temperature END AS heat_index,
             CASE WHEN temperature IS NOT NULL AND humidity IS NOT NULL AND wind_speed IS NOT NULL THEN least(greatest(
               (100 - least(abs(temperature - 21) * 4, 100) + 100 - least(abs(humidity - 50) * 1.5, 100) + 100 - least(abs(wind_speed - 2.5) * 15, 100)) / 3, 0), 100)
             END AS weather_comfort_score
      FROM ev_ready)""", ("ev_ready",))
def comfort(spark, sf) -> DataFrame:
    return wx.add_comfort_features(events_with_humidity(spark, sf))


@query("w19b_comfort_without_humidity", KEYS + " wind_chill:f", f"SELECT *, {_CHILL} AS wind_chill FROM grid_ready", ("grid_ready",))
def comfort_without_humidity(spark, sf) -> DataFrame:
    return wx.add_comfort_features(grid_with_weather(spark, sf))


INTERACTIONS = ("weather_good weather_bad weekend_good_weather weekend_rainy weekend_warm organic_hot_weather organic_cold_weather "
                "season_winter season_spring season_summer season_autumn")


@query("w20_interactions", KEYS + " " + " ".join(f"{c}:i" for c in INTERACTIONS.split()), """
SELECT *, 1 - weather_good AS weather_bad, is_weekend * weather_good AS weekend_good_weather, is_weekend * is_raining AS weekend_rainy,
       is_weekend * temp_warm AS weekend_warm, organic * temp_hot AS organic_hot_weather, organic * temp_cold AS organic_cold_weather,
       CAST(month IN (12, 1, 2) AS INT) AS season_winter, CAST(month IN (3, 4, 5) AS INT) AS season_spring,
       CAST(month IN (6, 7, 8) AS INT) AS season_summer, CAST(month IN (9, 10, 11) AS INT) AS season_autumn
FROM (SELECT *, CAST(coalesce(regexp_matches(lower(trash_type), 'bio|organic|food|kompost'), false) AS INT) AS organic,
             CASE WHEN temperature >= 15 AND temperature <= 28 AND is_raining = 0 AND wind_strong = 0 THEN 1 ELSE 0 END AS weather_good FROM ev_flags)""", ("ev_flags",))
def interactions(spark, sf) -> DataFrame:
    return wx.add_weather_interactions(event_families(spark, sf))


@query("w21_all_weather_event", KEYS + " temp_roll_mean_3_event:f precip_sum_5_event:f wind_roll_max_7_event:f dry_events:i wind_chill:f weekend_rainy:i", f"""
SELECT *, {_roll('avg', 'temperature', 3)} AS temp_roll_mean_3_event, {_roll('sum', 'precipitation', 5)} AS precip_sum_5_event,
       {_roll('max', 'wind_speed', 7)} AS wind_roll_max_7_event, {_CHILL} AS wind_chill, is_weekend * is_raining AS weekend_rainy
FROM ({_dry('ev_flags', 1, 50, 'dry_events')})""", ("ev_flags",))
def all_weather_event(spark, sf) -> DataFrame:
    return wx.add_all_weather_features(event_rows(spark, sf), weather_fine(spark, sf), long=long_series(spark, sf))


@query("w21b_all_weather_time", KEYS + " temp_roll_mean_48h:f precip_sum_24h:f wind_roll_max_24h:f dry_hours:i pressure_change_24h:f", f"""
SELECT *, {_roll('avg', 'temperature', 8)} AS temp_roll_mean_48h, {_roll('sum', 'precipitation', 4)} AS precip_sum_24h,
       {_roll('max', 'wind_speed', 4)} AS wind_roll_max_24h, pressure - {_lag('pressure', 4)} AS pressure_change_24h
FROM ({_dry('grid_flags', 6, 168, 'dry_hours')})""", ("grid_flags",))
def all_weather_time(spark, sf) -> DataFrame:
    return wx.add_all_weather_features(time_rows(spark, sf), weather_daily(spark, sf), step_hours=6)


@query("w22_drop_weather_columns", "column:s n_rows:i", """
SELECT unnest(['container_id', 'measured_at_utc', 'percent_calculated', 'is_weekend', 'dry_hours']) AS "column", (SELECT count(*) FROM timed) AS n_rows""", ("timed",))
def drop_weather_columns(spark, sf) -> DataFrame:
    full = wx.add_all_weather_features(time_rows(spark, sf), weather_daily(spark, sf), step_hours=6)
    kept = wx.drop_weather_named(full)
    names = [c for c in kept.columns if c in ("container_id", "measured_at_utc", "percent_calculated", "is_weekend", "dry_hours")
             or wx.weather_named([c])]
    return kept.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column"), "n_rows")


_IMPACT = ("temperature", "precipitation", "wind_speed", "pressure", "temp_cold", "temp_warm", "is_raining", "wind_strong", "pressure_low")


@query("w23_weather_impact", "feature:s n:i correlation:f", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, corr({c}, target) AS correlation FROM ev_flags WHERE {c} IS NOT NULL HAVING corr({c}, target) IS NOT NULL AND isfinite(corr({c}, target))"
    for c in _IMPACT), ("ev_flags",))
def weather_impact(spark, sf) -> DataFrame:
    return wx.weather_impact(event_families(spark, sf)).filter(F.col("feature").isin(*_IMPACT))


@query("w23b_weather_groups", "grouping:s level:s mean:f std:f n:i", """
SELECT 'temperature' AS grouping, level, avg(target) AS mean, stddev_samp(target) AS std, count(*) AS n FROM (
  SELECT target, unnest(['Cold', 'Warm', 'Hot']) AS level, unnest([temp_cold, temp_warm, temp_hot]) AS hit FROM ev_flags) WHERE hit = 1 GROUP BY level
UNION ALL SELECT 'rain', CASE is_raining WHEN 0 THEN 'Dry' ELSE 'Rainy' END, avg(target), stddev_samp(target), count(*) FROM ev_flags GROUP BY is_raining""", ("ev_flags",))
def weather_groups(spark, sf) -> DataFrame:
    return wx.weather_groups(event_families(spark, sf))
