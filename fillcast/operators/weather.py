"""Weather: joining a weather table to readings and the features derived from it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import correlation, flag, null_outside
from fillcast.operators.cleaning import TEMPERATURE_RANGE
from fillcast.operators.emptying import KEY, time_order
from fillcast.operators.ordered import (
    LongSeries, global_last_known, merge_as_of, over_series, positions, running_extreme, stored)
from fillcast.sources.tables import KMH_PER_MS, WEATHER_COLUMNS, WEATHER_EXTRAS

MATCH_KEY = "_weather_key"


@dataclass(frozen=True)
class WeatherProfile:
    """What the join has to know about the weather table; one small aggregate."""

    rows: int
    daily: bool
    last_day: object


def profile_weather(weather: DataFrame) -> WeatherProfile:
    row = weather.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("weather_time") == F.date_trunc("day", "weather_time")).alias("daily"),
        F.max(F.to_date("weather_time")).alias("last"),
    ).first()
    return WeatherProfile(row["n"], bool(row["daily"]), row["last"])


def match_weather(
    df: DataFrame, weather: DataFrame, profile: WeatherProfile, settings: Settings = DEFAULTS
) -> DataFrame:
    """Weather values of each reading as `<name>_weather` columns, plus the match key.

    Daily weather joins on the date. Finer weather joins as-of: each weather row is valid until
    the next one. Up to `weather_broadcast_rows` weather rows (counted by the profile) are
    broadcast, listed under every day their interval touches, so the readings do not move; above
    that both sides are merged along time (`merge_as_of`). A reading without a time, or before
    the first weather row, keeps NULLs; a weather row without a time matches nothing.
    """
    small = profile.rows <= settings.weather_broadcast_rows
    values = [c for c in weather.columns if c != "weather_time"]
    named = [F.col(c).alias(f"{c}_weather") for c in values]
    ts = F.col("measured_at_utc")
    if profile.daily:
        days = weather.select(F.to_date("weather_time").alias("_day"), *named)
        out = df.withColumn("_day", F.to_date(ts)).join(F.broadcast(days) if small else days, "_day", "left")
        return out.withColumnRenamed("_day", MATCH_KEY)
    if not small:
        found = merge_as_of(df, weather.select("weather_time", *named), "measured_at_utc", "weather_time", settings.block_rows)
        return found.withColumnRenamed("weather_time", MATCH_KEY)
    last = F.lit(profile.last_day)
    # the weather table is one series with one row per instant, and small here
    until = F.lead("weather_time").over(Window.partitionBy(F.lit(0)).orderBy("weather_time"))
    spans = weather.select(F.col("weather_time"), until.alias("_until"), *named).withColumn(
        "_day", F.explode(F.sequence(F.to_date("weather_time"), F.coalesce(F.to_date("_until"), last))))
    left = df.withColumn("_day", F.least(F.to_date(ts), last))
    right = F.broadcast(spans)
    hit = (
        (left["_day"] == right["_day"]) & (left["measured_at_utc"] >= right["weather_time"])
        & (right["_until"].isNull() | (left["measured_at_utc"] < right["_until"]))
    )
    return left.join(right, hit, "left").drop("_day", "_until").withColumnRenamed("weather_time", MATCH_KEY)


def merge_weather(
    df: DataFrame, weather: DataFrame, settings: Settings = DEFAULTS, profile: WeatherProfile | None = None
) -> DataFrame:
    """Join the weather table; its values replace existing columns, or only fill their gaps."""
    out = match_weather(df, weather, profile or profile_weather(weather), settings)
    new = {}
    for name in (*WEATHER_COLUMNS, *WEATHER_EXTRAS):
        source = f"{name}_weather"
        if source in out.columns:
            keep = name in df.columns and not settings.weather_override
            new[name] = F.coalesce(F.col(name), F.col(source)) if keep else F.col(source)
    if "temperature" in new or "temperature" in out.columns:
        new["temperature"] = null_outside(new.get("temperature", F.col("temperature")), *TEMPERATURE_RANGE)
    return out.withColumns(new).drop(*[c for c in out.columns if c.endswith("_weather")])


def weather_coverage(df: DataFrame) -> DataFrame:
    """Share of readings with a value, per weather column."""
    return df.agg(*[
        F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage") for c in WEATHER_COLUMNS if c in df.columns])


def ensure_weather_columns(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Missing flags, zero precipitation for gaps, forward fill of the rest in time order.

    The fill runs over all containers together. When the values came from the weather
    table they depend on the match key alone, so the distinct keys are filled (a table no
    longer than the weather itself) and joined back; the readings are neither shuffled
    nor sorted. Otherwise the fill runs over distinct instants.
    """
    none = F.lit(None).cast("double")
    out = df.withColumns({c: none for c in WEATHER_COLUMNS if c not in df.columns})
    out = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in WEATHER_COLUMNS})
    out = out.withColumn("precipitation", F.coalesce("precipitation", F.lit(0.0)))
    carried = [c for c in WEATHER_COLUMNS if c != "precipitation"]
    if MATCH_KEY in df.columns and settings.weather_override:
        seen = stored(out.filter(F.col(MATCH_KEY).isNotNull()).groupBy(MATCH_KEY).agg(*[F.first(c).alias(c) for c in carried]))
        # ordered by the weather's own instants: one row per weather row at most
        filled = global_last_known(seen, [F.col(MATCH_KEY)], {f"_f_{c}": F.col(c) for c in carried}, settings.block_rows)
        filled = filled.drop(*carried)
        out = out.join(filled, MATCH_KEY, "left")
        out = out.withColumns({c: F.col(f"_f_{c}") for c in carried})
        return out.drop(MATCH_KEY, *[f"_f_{c}" for c in carried])
    out = out.drop(MATCH_KEY)
    ts = F.col("measured_at_utc")
    instants = stored(out.groupBy(ts).agg(*[F.max(c).alias(c) for c in carried]))
    instants = global_last_known(
        instants, [ts], {f"_f_{c}": F.col(c) for c in carried}, settings.block_rows, exclusive=True).drop(*carried)
    out = out.join(instants, "measured_at_utc", "left")
    out = out.withColumns({c: F.coalesce(c, f"_f_{c}") for c in carried})
    return out.drop(*[f"_f_{c}" for c in carried])


# -- features -----------------------------------------------------------------

@dataclass(frozen=True)
class Frames:
    """Window lengths in rows with the suffix their columns carry.

    Hour windows are used on the grid when they are whole multiples of its step; event
    windows count events.
    """

    settings: Settings
    step_hours: int | None

    @property
    def timed(self) -> bool:
        return self.step_hours is not None

    def hours(self, lengths) -> list[tuple[int, str]]:
        step = self.step_hours
        return [(h // step, f"{h}h") for h in lengths if h % step == 0 and h >= step]

    def events(self) -> list[tuple[int, str]]:
        return [(k, f"{k}_event") for k in self.settings.event_windows]

    def lags(self, hours) -> list[tuple[int, str]]:
        return self.hours(hours) if self.timed else [(k, f"{k}_event") for k in self.settings.weather_event_lags]

    def rolls(self, hours) -> list[tuple[int, str]]:
        return self.hours(hours) if self.timed else self.events()

    def day(self) -> int:
        return 24 // self.step_hours

    def reach(self) -> int:
        if not self.timed:
            return max(*self.settings.event_windows, *self.settings.weather_event_lags)
        return max([k for k, _ in self.hours((*self.settings.weather_lags, *self.settings.weather_windows, 24))] or [1])


def frames_for(mode: str = "auto", step_hours: int | None = None, settings: Settings = DEFAULTS) -> Frames:
    if mode == "auto":
        mode = "time" if step_hours is not None else "event"
    if mode == "time" and step_hours is None:
        raise ValueError("step_hours is needed in time mode")
    return Frames(settings, step_hours if mode == "time" else None)


def _temperature_flags(s: Settings) -> dict[str, Column]:
    t = F.col("temperature")
    season = 10 + 10 * F.sin(F.lit(2 * math.pi) * (F.dayofyear("measured_at_utc") - 100) / 365)
    anomaly = t - season
    return {
        "temp_freezing": flag(t <= s.temp_freezing),
        "temp_cold": flag(t < s.temp_cold),
        "temp_mild": flag((t >= s.temp_cold) & (t < s.temp_warm)),
        "temp_warm": flag((t >= s.temp_warm) & (t < s.temp_hot)),
        "temp_hot": flag(t >= s.temp_hot),
        "temp_squared": t * t,
        "temp_abs_deviation": F.abs(t - 15),
        "temp_anomaly": anomaly,
        "temp_above_normal": flag(anomaly > 5),
        "temp_below_normal": flag(anomaly < -5),
    }


def _lag(column: str, k: int, window) -> Column:
    return F.lag(column, k).over(window)


def _roll(function, column: str, k: int, window) -> Column:
    return function(column).over(window.rowsBetween(-k, -1))


def _change(column: str, k: int, window) -> Column:
    return F.col(column) - _lag(column, k, window)


def _temperature_frames(window, frames: Frames) -> dict[str, Column]:
    s = frames.settings
    new = {f"temp_lag_{x}": _lag("temperature", k, window) for k, x in frames.lags(s.weather_lags)}
    if frames.timed:
        new[f"temp_change_{frames.step_hours}h"] = _change("temperature", 1, window)
        if frames.day() >= 1:
            new["temp_change_24h"] = _change("temperature", frames.day(), window)
    else:
        new["temp_change_1_event"] = _change("temperature", 1, window)
    rolls = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    for k, x in frames.rolls(s.weather_windows):
        new |= {f"temp_roll_{n}_{x}": _roll(f, "temperature", k, window) for n, f in rolls.items()}
    if {"temp_roll_max_24h", "temp_roll_min_24h"} <= new.keys():
        new["temp_daily_range"] = new["temp_roll_max_24h"] - new["temp_roll_min_24h"]
    return new


def _rain_flags(s: Settings) -> dict[str, Column]:
    p = F.coalesce(F.col("precipitation"), F.lit(0.0))
    return {
        "is_raining": flag(p > 0),
        "rain_light": flag((p > 0) & (p < s.rain_light)),
        "rain_moderate": flag((p >= s.rain_light) & (p < s.rain_moderate)),
        "rain_heavy": flag(p >= s.rain_moderate),
    }


def _rain_frames(window, frames: Frames) -> dict[str, Column]:
    new = {f"precip_lag_{x}": _lag("precipitation", k, window) for k, x in frames.lags((1, 6, 12, 24))}
    for k, x in frames.rolls((6, 12, 24, 48)):
        new[f"rained_last_{x}"] = F.coalesce(_roll(F.max, "is_raining", k, window), F.lit(0))
    for k, x in frames.rolls((6, 24, 48)):
        new[f"precip_sum_{x}"] = _roll(F.sum, "precipitation", k, window)
    return new


def add_dry_run(df: DataFrame, frames: Frames, long: LongSeries | None = None) -> DataFrame:
    """Rows since the last rainy row (from 0 at the start of the series), in hours or events."""
    placed = positions(df, KEY, time_order(), long, name="_row")
    placed = running_extreme(
        placed, KEY, time_order(), F.when(F.col("is_raining") == 1, F.col("_row")), "_rain", long=long)
    dry = F.col("_row") - F.coalesce(F.col("_rain"), F.lit(1))
    if frames.timed:
        placed = placed.withColumn("dry_hours", F.least(dry * frames.step_hours, F.lit(168)))
    else:
        placed = placed.withColumn("dry_events", F.least(dry, F.lit(50)))
    return placed.drop("_row", "_rain")


def _humidity_flags(s: Settings) -> dict[str, Column]:
    h = F.col("humidity")
    return {
        "humidity_low": flag(h < s.humidity_low),
        "humidity_comfortable": flag((h >= s.humidity_low) & (h <= s.humidity_high)),
        "humidity_high": flag(h > s.humidity_high),
    }


def _humidity_frames(window, frames: Frames) -> dict[str, Column]:
    new = {f"humidity_roll_mean_{x}": _roll(F.avg, "humidity", k, window) for k, x in frames.rolls((6, 24))}
    if not frames.timed:
        new["humidity_change_1_event"] = _change("humidity", 1, window)
    elif frames.day() >= 1:
        new["humidity_change_24h"] = _change("humidity", frames.day(), window)
    return new


def _wind_flags(s: Settings) -> dict[str, Column]:
    w = F.col("wind_speed")
    return {
        "wind_calm": flag(w < s.wind_calm),
        "wind_moderate": flag((w >= s.wind_calm) & (w < s.wind_moderate)),
        "wind_strong": flag(w >= s.wind_moderate),
    }


def _wind_frames(window, frames: Frames) -> dict[str, Column]:
    new = {}
    for k, x in frames.rolls((6, 24)):
        new[f"wind_roll_mean_{x}"] = _roll(F.avg, "wind_speed", k, window)
        new[f"wind_roll_max_{x}"] = _roll(F.max, "wind_speed", k, window)
    return new


def _pressure_flags(s: Settings) -> dict[str, Column]:
    p = F.col("pressure")
    return {"pressure_low": flag(p < s.pressure_low), "pressure_high": flag(p > s.pressure_high)}


def _pressure_frames(window, frames: Frames) -> dict[str, Column]:
    def tendency(change: str, k: int, suffix: str) -> dict[str, Column]:
        c = _change("pressure", k, window)
        return {change: c, f"pressure_falling{suffix}": flag(c < -3), f"pressure_rising{suffix}": flag(c > 3)}

    if not frames.timed:
        return tendency("pressure_change_1_event", 1, "_event")
    new = {}
    if 3 % frames.step_hours == 0:
        new |= tendency("pressure_change_3h", 3 // frames.step_hours, "")
    if frames.day() >= 1:
        new["pressure_change_24h"] = _change("pressure", frames.day(), window)
    return new


# family -> (needed column, row-level columns, columns over neighbouring rows)
FAMILIES = {
    "temperature": ("temperature", _temperature_flags, _temperature_frames),
    "precipitation": ("precipitation", _rain_flags, _rain_frames),
    "humidity": ("humidity", _humidity_flags, _humidity_frames),
    "wind": ("wind_speed", _wind_flags, _wind_frames),
    "pressure": ("pressure", _pressure_flags, _pressure_frames),
}


def add_weather_families(
    df: DataFrame, frames: Frames, families: tuple[str, ...] = tuple(FAMILIES), long: LongSeries | None = None
) -> DataFrame:
    """Row-level and windowed features of the named families, all on one window order."""
    present = [FAMILIES[f] for f in families if FAMILIES[f][0] in df.columns]
    rows = {}
    for _, flags, _ in present:
        rows |= flags(frames.settings)
    out = df.withColumns(rows) if rows else df
    if "container_id" not in df.columns or not present:
        return out

    def add(part: DataFrame, keys: list[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*time_order())
        new = {}
        for _, _, over in present:
            new |= over(window, frames)
        return part.withColumns(new)

    out = over_series(out, KEY, time_order(), add, back=frames.reach(), long=long)
    return add_dry_run(out, frames, long) if "is_raining" in rows else out


def add_comfort_features(df: DataFrame) -> DataFrame:
    """Heat index, wind chill, apparent temperature and comfort score, as far as inputs exist."""
    has = set(df.columns)
    warm, moist, windy = "temperature" in has, "humidity" in has, "wind_speed" in has
    t, h, w = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    new: dict[str, Column] = {}
    if warm and moist:
        new["heat_index"] = F.when(t >= 20, -8.78 + 1.61 * t + 2.34 * h - 0.09 * t * h).otherwise(t)
    if warm and windy:
        kmh = w * KMH_PER_MS
        power = F.pow(kmh, F.lit(0.16))
        new["wind_chill"] = F.when(
            (t <= 10) & (kmh > 4.8), 13.12 + 0.6215 * t - 11.37 * power + 0.3965 * t * power).otherwise(t)
    if "heat_index" in new and "wind_chill" in new:
        new["apparent_temp"] = F.when(t >= 20, new["heat_index"]).when(t <= 10, new["wind_chill"]).otherwise(t)
    if warm and moist and windy:
        def score(value: Column, best: float, slope: float) -> Column:
            return F.when(value.isNotNull(), 100 - F.least(F.abs(value - best) * slope, F.lit(100.0)))
        total = (score(t, 21, 4.0) + score(h, 50, 1.5) + score(w, 2.5, 15.0)) / 3
        new["weather_comfort_score"] = total
        new["weather_comfortable"] = flag(total >= 60)
        new["weather_uncomfortable"] = flag(total < 40)
    return df.withColumns(new) if new else df


ORGANIC = "bio|organic|food|kompost"
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def add_weather_interactions(df: DataFrame) -> DataFrame:
    """Good/bad weather, its products with weekend, organic waste and holiday, and seasons."""
    has = set(df.columns)
    one = lambda name: F.col(name) == 1
    new: dict[str, Column] = {}
    if "is_weekend" in has:
        weekend = one("is_weekend")
    else:
        weekend = F.weekday("measured_at_utc") >= 5
        new["is_weekend"] = flag(weekend)
    parts = []
    if "temperature" in has:
        parts.append(F.coalesce(F.col("temperature").between(15, 28), F.lit(False)))
    if "is_raining" in has:
        parts.append(~one("is_raining"))
    if "wind_strong" in has:
        parts.append(~one("wind_strong"))
    good = None
    if parts:
        good = parts[0]
        for p in parts[1:]:
            good = good & p
        new |= {"weather_good": flag(good), "weather_bad": flag(~good), "weekend_good_weather": flag(weekend & good)}
    if "is_raining" in has:
        new["weekend_rainy"] = flag(weekend & one("is_raining"))
    if "temp_warm" in has:
        new["weekend_warm"] = flag(weekend & one("temp_warm"))
    if "trash_type" in has:
        organic = F.lower("trash_type").rlike(ORGANIC)
        for name, source in (("organic_hot_weather", "temp_hot"), ("organic_cold_weather", "temp_cold")):
            if source in has:
                new[name] = flag(organic & one(source))
    if "is_holiday" in has and good is not None:
        new["holiday_good_weather"] = flag(one("is_holiday") & good)
    month = F.month("measured_at_utc")
    new |= {f"season_{name}": flag(month.isin(*months)) for name, months in SEASONS.items()}
    return df.withColumns(new)


def add_all_weather_features(
    df: DataFrame, weather: DataFrame | None, mode: str = "auto", step_hours: int | None = None,
    settings: Settings = DEFAULTS, long: LongSeries | None = None, profile: WeatherProfile | None = None,
) -> DataFrame:
    """Join, gap handling and every feature family; returns the input when there is no weather."""
    if weather is None:
        return df
    frames = frames_for(mode, step_hours, settings)
    joined = ensure_weather_columns(merge_weather(df, weather, settings, profile), settings)
    out = add_weather_families(joined, frames, long=long)
    return add_weather_interactions(add_comfort_features(out))


# Name fragments of weather columns; the impact analysis leaves the last two out.
WEATHER_TERMS = ("temp", "precip", "rain", "humid", "wind", "press", "weather", "comfort", "season", "heat", "chill")


def weather_named(columns: list[str], terms: tuple[str, ...] = WEATHER_TERMS) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in terms)]


def drop_weather_named(df: DataFrame) -> DataFrame:
    return df.drop(*weather_named(df.columns))


# -- impact analysis --------------------------------------------------------------

IMPACT_TERMS = WEATHER_TERMS[:9]
MIN_IMPACT_PAIRS = 100
SIGNIFICANT = 0.05


def weather_impact(df: DataFrame, target: str = "target") -> DataFrame:
    """Pearson correlation with the target for every weather column with over 100 pairs.

    Every row becomes one (column, value, target) entry per weather column, and entries
    combine map-side, so only sums travel. The p-value is the normal tail of the t
    statistic, which over 100 pairs justify.
    """
    types = {f.name: f.dataType for f in df.schema}
    names = [c for c in weather_named(df.columns, IMPACT_TERMS) if isinstance(types[c], T.NumericType)]
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in names])
    x, y = F.col("_x"), F.col("_y")
    pairs = df.select(F.col(target).cast("double").alias("_y"), F.inline(entries)).filter(x.isNotNull() & y.isNotNull())
    out = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("correlation"))
    r, n = F.col("correlation"), F.col("n")
    out = out.filter((n > MIN_IMPACT_PAIRS) & r.isNotNull())
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-15)))
    out = out.withColumn("p_value", _normal_tail(t))
    return out.withColumn("significant", F.col("p_value") < SIGNIFICANT)


def _normal_tail(t: Column) -> Column:
    """2 (1 - Phi(t)) for t >= 0, with a relative error below 1.2e-7 (Chebyshev fit of erfc)."""
    z = t / math.sqrt(2.0)
    k = 1.0 / (1.0 + 0.5 * z)
    # Coefficients of the published fit.
    series = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = F.lit(series[-1])
    for c in reversed(series[:-1]):
        total = total * k + F.lit(c)
    return k * F.exp(-z * z + total)


def weather_groups(df: DataFrame, target: str = "target") -> DataFrame:
    """Mean, deviation and count of the target in cold/warm/hot and in dry/rainy rows."""
    y = F.col(target)
    groups: list[tuple[str, str, Column]] = []
    if {"temp_cold", "temp_warm"} <= set(df.columns):
        groups += [("temperature", n, F.col(c) == 1) for n, c in (("Cold", "temp_cold"), ("Warm", "temp_warm"), ("Hot", "temp_hot"))
                   if c in df.columns]
    if "is_raining" in df.columns:
        groups += [("rain", n, F.col("is_raining") == v) for n, v in (("Dry", 0), ("Rainy", 1))]
    aggregates = []
    for i, (_, _, hit) in enumerate(groups):
        v = F.when(hit, y)
        aggregates += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.count_if(hit).alias(f"n{i}")]
    rows = F.array(*[
        F.struct(F.lit(g).alias("grouping"), F.lit(level).alias("level"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"n{i}").alias("n")) for i, (g, level, _) in enumerate(groups)])
    return df.agg(*aggregates).select(F.inline(rows)).filter("n > 0")
