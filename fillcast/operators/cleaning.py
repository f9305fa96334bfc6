"""Cleaning of raw readings and the attributes derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import (
    capacity_bucket, district_number, flag, leading_number, null_outside)
from fillcast.sources.tables import conform_readings

UNKNOWN_TYPE = "neznamy"
TEMPERATURE_RANGE = (-30.0, 50.0)


def known_type() -> Column:
    return F.col("trash_type").isNotNull() & (F.col("trash_type") != UNKNOWN_TYPE)


def valid_fill() -> Column:
    return F.col("percent_calculated").between(0, 100)


def add_capacity_class(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Capacity class of each container from its most frequent container type.

    The counts per (container, type) combine map-side, so a container with very many
    readings is no larger than any other one after the first exchange. The join is left
    to the optimizer: the number of containers grows with the data.
    """
    out = df.drop("capacity_class")
    if "container_type" not in df.columns:
        return out.withColumn("capacity_class", F.lit("unknown"))
    most = (
        df.filter(F.col("container_type").isNotNull())
        .groupBy("container_id", "container_type").count()
        .groupBy("container_id")
        .agg(F.min_by("container_type", F.struct(-F.col("count"), F.col("container_type"))).alias("_type"))
        .select("container_id", capacity_bucket(leading_number(F.col("_type")), settings).alias("_class"))
    )
    return (
        out.join(most, "container_id", "left")
        .withColumn("capacity_class", F.coalesce("_class", F.lit("unknown"))).drop("_class")
    )


def clean_readings(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop unknown types and invalid fills, null out outliers, derive class and district number."""
    df = conform_readings(raw).filter(known_type() & valid_fill())
    has = set(df.columns)
    temperature = null_outside(F.col("temperature"), *TEMPERATURE_RANGE) if "temperature" in has else F.lit(None).cast("double")
    alarm = flag(F.col("firealarm") > 0) if "firealarm" in has else F.lit(0)
    district = district_number(F.col("district")) if "district" in has else F.lit(None).cast("double")
    df = df.withColumns({"temperature": temperature, "firealarm": alarm, "district_num": district})
    return add_capacity_class(df, settings)


def load_audit(raw: DataFrame) -> DataFrame:
    """Rows removed by each rule, rows and containers kept: one pass over the raw readings."""
    df = conform_readings(raw)
    typed, filled = known_type(), valid_fill()
    kept = F.coalesce(typed & filled, F.lit(False))
    hot = F.col("temperature").isNotNull() & ~F.col("temperature").between(*TEMPERATURE_RANGE)
    per_container = df.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~F.coalesce(typed, F.lit(False))).alias("dropped_type"),
        F.count_if(F.coalesce(typed, F.lit(False)) & ~F.coalesce(filled, F.lit(False))).alias("dropped_fill"),
        (F.count_if(kept & hot) if "temperature" in df.columns else F.lit(0)).alias("nulled_temperature"),
        F.count_if(kept).alias("rows_kept"),
    )
    names = ("rows_read", "dropped_type", "dropped_fill", "nulled_temperature", "rows_kept")
    return per_container.agg(
        *[F.sum(n).alias(n) for n in names], F.count_if(F.col("rows_kept") > 0).alias("containers_kept"))


def containers_per_class(clean: DataFrame) -> DataFrame:
    return clean.groupBy("capacity_class").agg(F.countDistinct("container_id").alias("n_containers"))
