"""Queries on cleaning, sources, calendar, space and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import (
    CHECKED, clean, event_rows, raw_readings, table, weather_daily_raw)
from fillcast.catalog.registry import query
from fillcast.functions import columns as fx
from fillcast.operators import calendar, cleaning, encode, events, grid, spatial
from fillcast.operators.ordered import shared_folder
from fillcast.sources import tables

KEYS = "container_id:i measured_at_utc:u"


def _out_dir(spark) -> str:
    """A new folder for a round trip through a file, below the shared folder."""
    return shared_folder(spark)


@query("s01_readings_csv", KEYS + " percent_calculated:f trash_type:s container_type:s district:s latitude:f longitude:f temperature:f firealarm:f",
       "SELECT * FROM readings", ("readings",))
def readings_csv(spark, sf) -> DataFrame:
    path = f"{_out_dir(spark)}/readings.csv"
    tables.write_table(raw_readings(spark, sf), path)
    return tables.read_readings(spark, path)


@query("s02_weather_csv", "weather_time:u temperature:f precipitation:f wind_speed:f pressure:f", "SELECT * FROM days", ("days",))
def weather_csv(spark, sf) -> DataFrame:
    path = f"{_out_dir(spark)}/weather.csv"
    tables.write_table(weather_daily_raw(spark, sf), path)
    return tables.read_weather(spark, path)


@query("s03_table_sink_csv", "trash_type:s n:i", "SELECT trash_type, count(*) AS n FROM clean GROUP BY 1", ("clean",))
def table_sink_csv(spark, sf) -> DataFrame:
    path = f"{_out_dir(spark)}/counts.csv"
    tables.write_table(clean(spark, sf).groupBy("trash_type").agg(F.count(F.lit(1)).alias("n")), path, single_file=True)
    return tables.read_table(spark, path, "trash_type string, n long")


@query("s04_table_sink_json", "capacity_class:s n:i mean_fill:f",
       "SELECT capacity_class, count(*) AS n, avg(percent_calculated) AS mean_fill FROM clean GROUP BY 1", ("clean",))
def table_sink_json(spark, sf) -> DataFrame:
    path = f"{_out_dir(spark)}/classes.json"
    counts = clean(spark, sf).groupBy("capacity_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("percent_calculated").alias("mean_fill"))
    tables.write_table(counts, path, "json", single_file=True)
    return tables.read_table(spark, path, "capacity_class string, n long, mean_fill double", "json")


@query("f01_known_type", KEYS + " trash_type:s", "SELECT * FROM readings WHERE trash_type IS NOT NULL AND trash_type <> 'neznamy'", ("readings",))
def known_type(spark, sf) -> DataFrame:
    return raw_readings(spark, sf).filter(cleaning.known_type())


@query("f02_valid_fill", KEYS + " percent_calculated:f",
       "SELECT * FROM readings WHERE percent_calculated >= 0 AND percent_calculated <= 100", ("readings",))
def valid_fill(spark, sf) -> DataFrame:
    return raw_readings(spark, sf).filter(cleaning.valid_fill())


@query("f03_null_outliers", "container_id:i n_outliers:i n_left:i",
       """SELECT container_id, count(*) FILTER (WHERE temperature < -30 OR temperature > 50) AS n_outliers,
                 count(*) FILTER (WHERE temperature >= -30 AND temperature <= 50) AS n_left FROM readings GROUP BY 1""", ("readings",))
def null_outliers(spark, sf) -> DataFrame:
    cut = fx.null_outside(F.col("temperature"), *cleaning.TEMPERATURE_RANGE)
    return raw_readings(spark, sf).groupBy("container_id").agg(
        F.count_if(F.col("temperature").isNotNull() & cut.isNull()).alias("n_outliers"), F.count(cut).alias("n_left"))


@query("f04_binary_alarm", "firealarm:i n:i", "SELECT firealarm, count(*) AS n FROM kept GROUP BY 1", ("kept",))
def binary_alarm(spark, sf) -> DataFrame:
    return clean(spark, sf).groupBy("firealarm").agg(F.count(F.lit(1)).alias("n"))


@query("f05_leading_number", "container_type:s capacity:f n:i",
       r"""SELECT container_type, CAST(nullif(regexp_extract(container_type, '^\s*([0-9]+)', 1), '') AS DOUBLE) AS capacity, count(*) AS n
           FROM readings GROUP BY 1, 2""", ("readings",))
def leading_number(spark, sf) -> DataFrame:
    return raw_readings(spark, sf).groupBy("container_type", fx.leading_number(F.col("container_type")).alias("capacity")).agg(
        F.count(F.lit(1)).alias("n"))


@query("f06_capacity_bucket", "bucket:s n:i",
       """SELECT CASE WHEN c IS NULL THEN 'unknown' WHEN c <= 2150 THEN 'low' WHEN c >= 2500 THEN 'high' ELSE 'medium' END AS bucket, count(*) AS n
          FROM (SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 100.0 END AS c FROM part) GROUP BY 1""")
def capacity_bucket(spark, sf) -> DataFrame:
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 100.0)
    return table(spark, sf, "part").groupBy(fx.capacity_bucket(size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_capacity_class", KEYS + " capacity_class:s", "SELECT * FROM clean", ("clean",))
def capacity_class(spark, sf) -> DataFrame:
    return clean(spark, sf)


@query("f08_district_number", "district:s district_num:f n:i", "SELECT district, district_num, count(*) AS n FROM kept GROUP BY 1, 2", ("kept",))
def district_number(spark, sf) -> DataFrame:
    return clean(spark, sf).groupBy("district", "district_num").agg(F.count(F.lit(1)).alias("n"))


@query("f09_load_audit", "rows_read:i dropped_type:i dropped_fill:i nulled_temperature:i rows_kept:i containers_kept:i",
       """SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT t) AS dropped_type, count(*) FILTER (WHERE t AND NOT f) AS dropped_fill,
                 count(*) FILTER (WHERE t AND f AND (temperature < -30 OR temperature > 50)) AS nulled_temperature,
                 count(*) FILTER (WHERE t AND f) AS rows_kept, count(DISTINCT CASE WHEN t AND f THEN container_id END) AS containers_kept
          FROM (SELECT *, coalesce(trash_type <> 'neznamy', false) AS t,
                       coalesce(percent_calculated >= 0 AND percent_calculated <= 100, false) AS f FROM readings)""", ("readings",))
def load_audit(spark, sf) -> DataFrame:
    return cleaning.load_audit(raw_readings(spark, sf))


@query("f09b_containers_per_class", "capacity_class:s n_containers:i",
       "SELECT capacity_class, count(DISTINCT container_id) AS n_containers FROM clean GROUP BY 1", ("clean",))
def containers_per_class(spark, sf) -> DataFrame:
    return cleaning.containers_per_class(clean(spark, sf))


@query("f00_clean_readings", KEYS + " percent_calculated:f trash_type:s container_type:s latitude:f longitude:f temperature:f firealarm:i district_num:f capacity_class:s",
       "SELECT * FROM clean", ("clean",))
def clean_readings(spark, sf) -> DataFrame:
    return clean(spark, sf)


@query("f10_event_calendar", KEYS + " date:d hour:i day_of_week:i day_of_month:i month:i week_of_year:i is_weekend:i", "SELECT * FROM ev", ("ev",))
def event_calendar(spark, sf) -> DataFrame:
    return event_rows(spark, sf)


@query("f10b_order_calendar", "o_orderkey:i day_of_week:i week_of_year:i month:i",
       "SELECT o_orderkey, isodow(o_orderdate) - 1 AS day_of_week, week(o_orderdate) AS week_of_year, month(o_orderdate) AS month FROM orders")
def order_calendar(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumns(fx.calendar_fields(F.col("o_orderdate").cast("timestamp_ntz"), detailed=True))


@query("f11_grid_calendar", KEYS + " date:d hour:i day_of_week:i month:i is_weekend:i", "SELECT * FROM timed", ("timed",))
def grid_calendar(spark, sf) -> DataFrame:
    return grid.create_time_dataset(clean(spark, sf))


@query("f12_missing_indicators", KEYS + " container_type_missing:i temperature_missing:i",
       """SELECT *, CASE WHEN container_type IS NULL THEN 1 ELSE 0 END AS container_type_missing,
                 CASE WHEN temperature IS NULL THEN 1 ELSE 0 END AS temperature_missing FROM clean""", ("clean",))
def missing_indicators(spark, sf) -> DataFrame:
    return events.add_missing_indicators(clean(spark, sf), ["container_type", "temperature", "not_there"])


@query("f13_feature_columns", "feature:s n_rows:i",
       """SELECT unnest(['latitude', 'longitude', 'temperature', 'firealarm', 'district_num']) AS feature, (SELECT count(*) FROM clean) AS n_rows""", ("clean",))
def feature_columns(spark, sf) -> DataFrame:
    df = clean(spark, sf)
    names = F.array(*[F.lit(c) for c in encode.feature_columns(df)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(names).alias("feature"), "n_rows")


@query("f14_safe_names", "trash_type_Bio_odpad:i plain:i",
       "SELECT CASE WHEN trash_type = 'Bio' THEN 1 ELSE 0 END AS \"trash_type_Bio_odpad\", container_id AS plain FROM clean", ("clean",))
def safe_names(spark, sf) -> DataFrame:
    odd = clean(spark, sf).select((F.col("trash_type") == "Bio").cast("int").alias("trash_type_Bio odpad"), F.col("container_id").alias("plain"))
    return encode.sanitize_names(odd)[0]


_week = ", ".join(f"sin(2 * pi() * {k} * day_of_week / 7.0) AS fourier_week_sin_{k}, cos(2 * pi() * {k} * day_of_week / 7.0) AS fourier_week_cos_{k}" for k in (1, 2, 3))
_day = ", ".join(f"sin(2 * pi() * {k} * hour / 24.0) AS fourier_day_sin_{k}, cos(2 * pi() * {k} * hour / 24.0) AS fourier_day_cos_{k}" for k in (1, 2))
_fourier = " ".join(f"fourier_{p}_{t}_{k}:f" for p, n in (("week", 3), ("day", 2)) for k in range(1, n + 1) for t in ("sin", "cos"))


@query("f15_fourier", KEYS + " " + _fourier, f"SELECT *, {_week}, {_day} FROM timed", ("timed",))
def fourier(spark, sf) -> DataFrame:
    return fx.add_fourier_features(grid.create_time_dataset(clean(spark, sf)))


@query("f16_geo_projection", KEYS + " lat:f lon:f geo_bin_lat:f geo_bin_lon:f dist_from_center:f",
       """SELECT *, latitude AS lat, longitude AS lon, round_even(latitude * 1000, 0) / 1000 AS geo_bin_lat, round_even(longitude * 1000, 0) / 1000 AS geo_bin_lon,
                 sqrt(power(latitude - 50.0812, 2) + power(longitude - 14.4269, 2)) * 111 AS dist_from_center FROM clean""", ("clean",))
def geo_projection(spark, sf) -> DataFrame:
    return fx.add_position_features(clean(spark, sf))


@query("f17_clip", KEYS + " clipped:f", "SELECT *, CASE WHEN temperature IS NULL THEN NULL ELSE least(greatest(temperature, 0), 14) END AS clipped FROM clean", ("clean",))
def clip(spark, sf) -> DataFrame:
    return clean(spark, sf).withColumn("clipped", fx.clip(F.col("temperature"), 0, 14))


# -- holidays -------------------------------------------------------------------

_EASTER = """
SELECT y AS year, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter
FROM (SELECT y, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l
      FROM (SELECT y, c, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i
            FROM (SELECT y, c, g, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h
                  FROM (SELECT y, y // 100 AS c, y % 19 AS g FROM ({years})))))
"""
_FIXED = "[" + ", ".join(f"[{m}, {d}]" for m, d in fx.FIXED_HOLIDAYS) + "]"
_ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"
_HOLIDAYS = f"""
SELECT make_date(y.y, f.md[1], f.md[2]) AS holiday
FROM (SELECT unnest(generate_series(min(year(date)), max(year(date)))) AS y FROM ({{dates}})) y, (SELECT unnest({_FIXED}) AS md) f
UNION ALL
SELECT unnest([easter - 2, easter + 1]) AS holiday
FROM ({_EASTER.format(years="SELECT unnest(generate_series(min(year(date)), max(year(date)))) AS y FROM ({dates})")})
"""


@query("h01_easter", "year:i easter:d",
       "SELECT year, CAST(easter AS DATE) AS easter FROM (" + _EASTER.format(years="SELECT DISTINCT 1900 + k AS y FROM (SELECT o_custkey % 400 AS k FROM orders)") + ")")
def easter(spark, sf) -> DataFrame:
    years = table(spark, sf, "orders").select((F.lit(1900) + F.col("o_custkey") % 400).cast("int").alias("year")).distinct()
    return calendar.easter_dates(years)


@query("h02_holidays", "holiday:d", f"SELECT CAST(holiday AS DATE) AS holiday FROM ({_HOLIDAYS.format(dates=_ORDER_DAYS)})")
def holidays(spark, sf) -> DataFrame:
    return calendar.holiday_dates(table(spark, sf, "orders").select(F.col("o_orderdate").alias("date")))


def _holiday_sql(rows: str, dates: str, key: str) -> str:
    return f"""
SELECT r.*, CASE WHEN d.days = 0 THEN 1 ELSE 0 END AS is_holiday, d.days AS days_to_holiday, CASE WHEN d.days <= 3 THEN 1 ELSE 0 END AS is_near_holiday
FROM ({rows}) r JOIN (SELECT date, min(abs(date_diff('day', date, CAST(holiday AS DATE)))) AS days
                      FROM ({dates}), ({_HOLIDAYS.format(dates=dates)}) GROUP BY date) d ON d.date = r.{key}"""


@query("h03_holiday_features", "o_orderkey:i is_holiday:i days_to_holiday:i is_near_holiday:i",
       _holiday_sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders", _ORDER_DAYS, "date"))
def holiday_features(spark, sf) -> DataFrame:
    return calendar.add_holiday_features(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")))


@query("h03b_event_holidays", KEYS + " is_holiday:i days_to_holiday:i is_near_holiday:i",
       _holiday_sql("SELECT container_id, measured_at_utc, date FROM ev", "SELECT DISTINCT date FROM ev", "date"), ("ev",))
def event_holidays(spark, sf) -> DataFrame:
    return calendar.add_holiday_features(event_rows(spark, sf))


# -- space and categories ---------------------------------------------------------

@query("g01_spatial_clusters", "n_clusters:i n_containers:i", """
SELECT least(60, count(DISTINCT container_id)) AS n_clusters, count(DISTINCT container_id) AS n_containers FROM clean
""", ("clean",))
def spatial_clusters(spark, sf) -> DataFrame:
    found = spatial.cluster_containers(clean(spark, sf), CHECKED)
    return found.agg(F.countDistinct("geo_cluster").alias("n_clusters"), F.countDistinct("container_id").alias("n_containers"))


def _brands(spark, sf) -> DataFrame:
    part_rows = table(spark, sf, "part")
    return part_rows.select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("district"),
                            F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("trash_type"))


_BRANDS = """SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_brand ELSE '_unknown_' END AS district,
       CASE WHEN p_partkey % 7 <> 0 THEN p_type ELSE '_unknown_' END AS trash_type FROM part"""
_ENCODED = f"""
SELECT b.p_partkey, 'district' AS source, CASE WHEN t.district IS NOT NULL THEN b.district ELSE '_other_' END AS category
FROM ({_BRANDS}) b LEFT JOIN (SELECT district FROM ({_BRANDS}) GROUP BY 1 ORDER BY count(*) DESC, district LIMIT 8) t ON t.district = b.district
UNION ALL SELECT p_partkey, 'trash_type' AS source, trash_type AS category FROM ({_BRANDS})
"""


def _long_form(encoded: DataFrame, encoder: encode.CategoryEncoder, key: str) -> DataFrame:
    """(row, column, category) for every output that is 1."""
    hits = F.array(*[
        F.when(F.col(f"`{n}`") == 1, F.struct(F.lit(e.column).alias("source"), F.lit(c).alias("category")))
        for e in encoder.encodings for n, c in zip(e.names, e.categories)])
    return encoded.select(key, F.inline(F.array_compact(hits)))


@query("e01_fit_encoder", "p_partkey:i source:s category:s", _ENCODED)
def fit_encoder(spark, sf) -> DataFrame:
    rows = _brands(spark, sf)
    encoder = encode.CategoryEncoder.fit(rows)
    return _long_form(encoder.transform(rows), encoder, "p_partkey")


@query("e02_apply_encoder", "container_id:i source:s category:s n:i", """
SELECT container_id, source, category, count(*) AS n FROM (
  SELECT c.container_id, 'trash_type' AS source, c.trash_type AS category FROM clean c
    WHERE c.trash_type IN (SELECT trash_type FROM clean WHERE container_id % 3 = 0)
  UNION ALL SELECT c.container_id, 'district', c.district FROM clean c WHERE c.district IN (SELECT district FROM clean WHERE container_id % 3 = 0)
  UNION ALL SELECT c.container_id, 'capacity_class', c.capacity_class FROM clean c
    WHERE c.capacity_class IN (SELECT capacity_class FROM clean WHERE container_id % 3 = 0)
  UNION ALL SELECT c.container_id, 'container_type', coalesce(c.container_type, '_unknown_') FROM clean c
    WHERE coalesce(c.container_type, '_unknown_') IN (SELECT coalesce(container_type, '_unknown_') FROM clean WHERE container_id % 3 = 0))
GROUP BY 1, 2, 3""", ("clean",))
def apply_encoder(spark, sf) -> DataFrame:
    rows = clean(spark, sf)
    encoder = encode.CategoryEncoder.fit(rows.filter("container_id % 3 = 0"))
    found = _long_form(encoder.transform(rows), encoder, "container_id")
    return found.groupBy("container_id", "source", "category").agg(F.count(F.lit(1)).alias("n"))


@query("e03_encoder_report", "column:s n_unique:i strategy:s n_outputs:i", f"""
SELECT 'district' AS "column", count(DISTINCT district) AS n_unique, 'top_k_ohe' AS strategy, 9 AS n_outputs FROM ({_BRANDS})
UNION ALL SELECT 'trash_type', count(DISTINCT trash_type), 'full_ohe', count(DISTINCT trash_type) FROM ({_BRANDS})""")
def encoder_report(spark, sf) -> DataFrame:
    rows = _brands(spark, sf)
    return encode.CategoryEncoder.fit(rows).report(rows)
