"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3_600_000_000.0)


def days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def clip(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def null_outside(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def finite(value: Column) -> Column:
    """NaN as NULL, so that comparisons and aggregates skip it."""
    return F.when(~F.isnan(value), value)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the pairs where both are known; NULL for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


# -- cleaning -----------------------------------------------------------------

def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).cast("double")


def district_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"praha-(\d+)", 1), F.lit("")).cast("double")


def capacity_bucket(capacity: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(capacity.isNull(), "unknown")
        .when(capacity <= settings.capacity_low_max, "low")
        .when(capacity >= settings.capacity_high_min, "high")
        .otherwise("medium")
    )


# -- calendar -----------------------------------------------------------------

def calendar_fields(ts: Column, detailed: bool = False) -> dict[str, Column]:
    """Calendar fields of a timestamp; Monday is day 0."""
    fields = {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }
    if detailed:
        fields["day_of_month"] = F.dayofmonth(ts)
        fields["week_of_year"] = F.weekofyear(ts)
    return fields


def _harmonics(prefix: str, phase: Column, count: int) -> dict[str, Column]:
    out = {}
    for k in range(1, count + 1):
        angle = phase * F.lit(2.0 * math.pi * k)
        out[f"{prefix}_sin_{k}"] = F.sin(angle)
        out[f"{prefix}_cos_{k}"] = F.cos(angle)
    return out


def add_fourier_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Weekly and daily harmonics of whichever of `day_of_week` and `hour` the frame has."""
    new: dict[str, Column] = {}
    if "day_of_week" in df.columns:
        new |= _harmonics("fourier_week", F.col("day_of_week") / 7.0, settings.weekly_harmonics)
    if "hour" in df.columns:
        new |= _harmonics("fourier_day", F.col("hour") / 24.0, settings.daily_harmonics)
    return df.withColumns(new) if new else df


def easter_sunday(year: Column) -> Column:
    """Easter Sunday by Gauss's rule with its two late-April corrections."""
    def div(a, b):
        return F.floor(a / F.lit(b)).cast("int")

    century = div(year, 100)
    moon = (15 - div(century * 8 + 13, 25) + century - div(century, 4)) % 30
    sunday = (4 + century - div(century, 4)) % 7
    full = ((year % 19) * 19 + moon) % 30
    rest = ((year % 4) * 2 + (year % 7) * 4 + full * 6 + sunday) % 7
    week_early = (rest == 6) & ((full == 29) | ((full == 28) & ((moon * 11 + 11) % 30 < 19)))
    return F.date_add(
        F.make_date(year, F.lit(3), F.lit(22)),
        (full + rest - F.when(week_early, 7).otherwise(0)).cast("int"),
    )


# The public holidays with a fixed date, as (month, day).
FIXED_HOLIDAYS = (
    (1, 1), (5, 1), (5, 8), (7, 5), (7, 6), (9, 28),
    (10, 28), (11, 17), (12, 24), (12, 25), (12, 26),
)


def holidays_of_year(year: Column) -> Column:
    """Array with the 13 holidays of a year (11 fixed ones, Good Friday, Easter Monday)."""
    easter = easter_sunday(year)
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return F.array(*fixed, F.date_sub(easter, 2), F.date_add(easter, 1))


# -- space --------------------------------------------------------------------

KM_PER_DEGREE = 111.0


def add_position_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Coordinates, three-decimal cells and the distance to the centre; no-op without coordinates."""
    if not {"latitude", "longitude"} <= set(df.columns):
        return df
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns({
        "lat": lat,
        "lon": lon,
        "geo_bin_lat": F.rint(lat * 1000.0) / 1000.0,
        "geo_bin_lon": F.rint(lon * 1000.0) / 1000.0,
        "dist_from_center": F.sqrt(
            F.pow(lat - settings.center_lat, 2) + F.pow(lon - settings.center_lon, 2)
        ) * KM_PER_DEGREE,
    })
