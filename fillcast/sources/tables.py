"""Reading and writing of tables: readings, weather, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.functions.columns import finite

# The columns a readings table has to have, and the optional ones with their types.
REQUIRED = ("container_id", "measured_at_utc", "percent_calculated", "trash_type")
READING_TYPES = {
    "container_id": "bigint", "measured_at_utc": "timestamp_ntz", "percent_calculated": "double",
    "trash_type": "string", "container_type": "string", "district": "string", "latitude": "double",
    "longitude": "double", "capacity": "double", "temperature": "double", "firealarm": "double",
}


def utc_instant(text: Column) -> Column:
    """Timestamp text as UTC wall-clock time; text with an offset is shifted to UTC first."""
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def _to_utc(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz"))
    if isinstance(kind, T.DateType):
        return F.col(column).cast("timestamp_ntz")
    return utc_instant(F.trim(F.col(column)))


def conform_readings(df: DataFrame) -> DataFrame:
    """Check the mandatory columns, fix types, turn NaN into NULL. Other columns pass through."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"readings lack the columns {missing}")

    def typed(name: str) -> Column:
        kind = READING_TYPES.get(name)
        if kind is None:
            return F.col(name)
        if kind == "timestamp_ntz":
            return _to_utc(df, name).alias(name)
        value = F.col(name).cast(kind)
        return (finite(value) if kind == "double" else value).alias(name)

    return df.select(*[typed(c) for c in df.columns])


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings from CSV (with header) or parquet. No sort: order is named where it matters.

    A missing path raises Spark's own path-not-found error. CSV columns are read as text
    by the header and cast, which needs no schema inference pass.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz", ".txt")):
        return conform_readings(spark.read.csv(path, header=True))
    return conform_readings(spark.read.parquet(path))


# Accepted names of the time column, in order of preference.
WEATHER_TIME_NAMES = ("time", "date", "datetime", "Date", "DATE")
KMH_PER_MS = 3.6
WEATHER_COLUMNS = ("temperature", "precipitation", "wind_speed", "pressure")
WEATHER_EXTRAS = ("temp_min", "temp_max", "temp_daily_range_src", "snow", "sunshine_min")


def read_weather(spark: SparkSession, path: str) -> DataFrame | None:
    """Weather table from CSV or parquet, normalised; None without file or time column."""
    try:
        reader = spark.read.option("header", True)
        raw = reader.csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing path means "no weather"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return normalise_weather(raw)


def normalise_weather(raw: DataFrame) -> DataFrame | None:
    """Meteorological columns under the library's names, one row per `weather_time`."""
    # Spark resolves names without regard to case, so compare exactly here
    time_name = next((n for n in WEATHER_TIME_NAMES if n in raw.columns), None)
    if time_name is None:
        return None
    has = set(raw.columns)

    def number(name: str) -> Column:
        return finite(F.col(name).cast("double"))

    none = F.lit(None).cast("double")
    if "tavg" in has:
        temperature = number("tavg")
    elif {"tmin", "tmax"} <= has:
        temperature = (number("tmin") + number("tmax")) / 2.0
    else:
        temperature = number("temperature") if "temperature" in has else none
    low = number("tmin") if "tmin" in has else number("temp_min") if "temp_min" in has else None
    high = number("tmax") if "tmax" in has else number("temp_max") if "temp_max" in has else None

    def renamed(source: str, target: str, convert=lambda c: c) -> Column:
        if source in has:
            return convert(number(source))
        return number(target) if target in has else none

    out = {
        "temperature": temperature,
        "precipitation": renamed("prcp", "precipitation", lambda c: F.coalesce(c, F.lit(0.0))),
        "wind_speed": renamed("wspd", "wind_speed", lambda c: c / KMH_PER_MS),
        "pressure": renamed("pres", "pressure"),
    }
    if low is not None:
        out["temp_min"] = low
    if high is not None:
        out["temp_max"] = high
    if low is not None and high is not None:
        out["temp_daily_range_src"] = high - low
    if "snow" in has:
        out["snow"] = number("snow")
    if "tsun" in has:
        out["sunshine_min"] = number("tsun")
    elif "sunshine_min" in has:
        out["sunshine_min"] = number("sunshine_min")
    table = raw.select(_to_utc(raw, time_name).alias("weather_time"), *[c.alias(n) for n, c in out.items()])
    # duplicates of one instant: the greatest row wins, so the choice is repeatable
    values = F.struct(*out)
    return (
        table.filter(F.col("weather_time").isNotNull())
        .groupBy("weather_time").agg(F.max(values).alias("_row"))
        .select("weather_time", "_row.*")
    )


# -- sinks --------------------------------------------------------------------

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the default text format drops microseconds


def write_table(df: DataFrame, path: str, kind: str = "csv", single_file: bool = False) -> str:
    """Write a result table; `single_file` is for the small report tables only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("timestampNTZFormat", MICROS).option("timestampFormat", MICROS)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    """Read a written result table back with its schema (no inference pass)."""
    reader = spark.read.schema(schema).option("timestampNTZFormat", MICROS)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    return reader.json(path) if kind == "json" else reader.parquet(path)
