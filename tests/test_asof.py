"""The merge along time against pandas, with hot days, ties, NULLs and empty sides."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS
from fillcast.operators import ordered
from fillcast.operators import weather as wx

LEFT = "id long, at timestamp_ntz"
RIGHT = "since timestamp_ntz, v double"


def sides(seed=0, n=3000, hot_instant=True):
    """Two thirds of the readings on one day, half of these at one instant."""
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    minutes = rng.integers(0, 60 * 24 * 60, n)
    minutes[: 2 * n // 3] = 30 * 1440 + rng.integers(0, 1440, 2 * n // 3)
    if hot_instant:
        minutes[: n // 3] = 30 * 1440 + 600
    left = pd.DataFrame({"id": np.arange(n), "at": start + pd.to_timedelta(minutes, unit="min")})
    since = np.unique(rng.integers(3 * 1440, 60 * 1440, 700))
    right = pd.DataFrame({"since": start + pd.to_timedelta(since, unit="min"), "v": rng.normal(size=len(since))})
    right.loc[rng.random(len(right)) < 0.1, "v"] = np.nan
    return left, right


def frames(spark, left, right):
    lefts = spark.createDataFrame([(int(i), None if pd.isna(t) else t.to_pydatetime()) for i, t in left.itertuples(index=False)], LEFT)
    rights = spark.createDataFrame(
        [(None if pd.isna(t) else t.to_pydatetime(), None if pd.isna(v) else float(v)) for t, v in right.itertuples(index=False)], RIGHT)
    return lefts, rights


@pytest.mark.parametrize("block_rows", [300, 10**6])
def test_merge_equals_pandas(spark, block_rows):
    left, right = sides()
    out = ordered.merge_as_of(*frames(spark, left, right), "at", "since", block_rows).orderBy("id").collect()
    want = pd.merge_asof(left.sort_values("at"), right.sort_values("since"), left_on="at", right_on="since").sort_values("id")
    assert len(out) == len(left)
    for r, w in zip(out, want.itertuples(index=False)):
        assert (r["since"] is None) == pd.isna(w.since) and (r["since"] is None or r["since"] == w.since)
        # a NULL of the last row is its value: it is not filled from an earlier row
        assert (r["v"] is None) == pd.isna(w.v) and (r["v"] is None or r["v"] == w.v)


@pytest.mark.parametrize("block_rows", [1, 10**6])
def test_merge_without_times_or_rows(spark, block_rows):
    left = pd.DataFrame({"id": [1, 2, 3, 3], "at": [pd.NaT, pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-03"), pd.Timestamp("2024-01-03")]})
    right = pd.DataFrame({"since": [pd.NaT, pd.Timestamp("2024-01-02")], "v": [9.0, 1.0]})
    lefts, rights = frames(spark, left, right)
    got = ordered.merge_as_of(lefts, rights, "at", "since", block_rows).select("id", "v").collect()
    assert sorted((r["id"], r["v"]) for r in got if r["v"] is not None) == [(3, 1.0), (3, 1.0)] and len(got) == 4
    assert [r["v"] for r in ordered.merge_as_of(lefts, rights.limit(0), "at", "since", block_rows).collect()] == [None] * 4
    assert ordered.merge_as_of(lefts.limit(0), rights, "at", "since", block_rows).count() == 0


def test_hot_day_and_instant_spread(spark):
    left, right = sides(1, 6000)
    lefts, _ = frames(spark, left, right)
    placed, _, _ = ordered.in_chunks(lefts, [], [F.col("at")], {"w": F.col("id")}, 6000, 600)
    sizes = sorted(r["count"] for r in placed.groupBy("_chunk").count().collect())
    assert len(sizes) >= 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_both_ways_of_matching_weather_agree(spark):
    left, right = sides(2, 800)
    lefts, rights = frames(spark, left, right)
    readings = lefts.withColumnRenamed("at", "measured_at_utc").withColumn("container_id", F.col("id") % 7)
    weather = rights.select(F.col("since").alias("weather_time"), F.col("v").alias("temperature"))
    merged = DEFAULTS.with_(weather_broadcast_rows=0, block_rows=100)
    a, b = (wx.ensure_weather_columns(wx.merge_weather(readings, weather, s), s) for s in (DEFAULTS, merged))
    assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(a.columns)).collect()))
    plan = wx.merge_weather(readings, weather, merged)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def test_last_known_skips_nulls_over_borders(spark):
    values = [None, 1.0] + [None] * 50 + [2.0] + [None] * 47
    df = spark.createDataFrame([(i, v, None if i else 5.0) for i, v in enumerate(values)], "i int, v double, w double")
    want = pd.Series(values, dtype="float64").ffill()
    for rows in (5, 1000):
        got = ordered.global_last_known(df, [F.col("i")], {"a": F.col("v"), "b": F.col("w")}, rows).orderBy("i").toPandas()
        pd.testing.assert_series_equal(got["a"], want, check_names=False)
        assert (got["b"] == 5.0).all()
