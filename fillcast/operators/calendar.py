"""The holiday dimension and the features joined from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.functions.columns import easter_sunday, holidays_of_year

FAR_FROM_HOLIDAY = 30
NEAR_DAYS = 3


def easter_dates(years: DataFrame) -> DataFrame:
    """Easter Sunday for every row of a frame with an integer `year`."""
    return years.select("year", easter_sunday(F.col("year")).alias("easter"))


def _year_span(df: DataFrame, date_col: str) -> DataFrame:
    year = F.year(date_col)
    return df.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year")).filter("first_year IS NOT NULL")


def _holiday_list(span: DataFrame) -> DataFrame:
    years = F.sequence("first_year", "last_year")
    return span.withColumn("_holidays", F.flatten(F.transform(years, holidays_of_year)))


def holiday_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """All holidays of the years the frame covers."""
    return _holiday_list(_year_span(df, date_col)).select(F.explode("_holidays").alias("holiday"))


def holiday_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """One row per day of the covered years with the distance to the nearest holiday.

    The holidays are those of the data's own years: the days after Christmas do not see
    next New Year unless the data reaches it.
    """
    days = F.sequence(
        F.make_date("first_year", F.lit(1), F.lit(1)), F.make_date("last_year", F.lit(12), F.lit(31)))
    each = _holiday_list(_year_span(df, date_col)).select(F.explode(days).alias("_date"), "_holidays")
    return each.select(
        "_date",
        F.array_min(F.transform("_holidays", lambda h: F.abs(F.datediff(h, F.col("_date"))))).alias("_distance"))


def add_holiday_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """`is_holiday`, `days_to_holiday` and `is_near_holiday` by a join on the date.

    The calendar has 366 rows per covered year at most, whatever the data's size, so it
    is broadcast.
    """
    if date_col not in df.columns:
        return df
    calendar = F.broadcast(holiday_calendar(df, date_col))
    out = df.withColumn("_date", F.to_date(date_col)).join(calendar, "_date", "left")
    distance = F.coalesce(F.col("_distance"), F.lit(FAR_FROM_HOLIDAY))
    return out.withColumns({
        "is_holiday": (distance == 0).cast("int"),
        "days_to_holiday": distance,
        "is_near_holiday": (distance <= NEAR_DAYS).cast("int"),
    }).drop("_date", "_distance")
