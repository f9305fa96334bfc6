"""Series cut into blocks must give what the plain windows give, and copies must spread."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS
from fillcast.operators import baselines, emptying, events, metrics, ordered, screening, split, survival
from fillcast.operators import weather as wx

SF = "/root/testdata/sf0.001"
KEYS = ["container_id", "measured_at_utc"]


@pytest.fixture(scope="module")
def readings(spark):
    """One container holds over a third of all rows; some rows are exact copies."""
    raw = spark.read.parquet(f"{SF}/events.parquet").filter("value BETWEEN 0 AND 100")
    rows = raw.select(
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("long").alias("container_id"),
        F.col("ts").alias("measured_at_utc"), F.col("value").alias("percent_calculated"), F.lit("Bio").alias("trash_type"),
        (F.col("event_id") % 30).cast("double").alias("temperature"),
        F.when(F.col("event_id") % 4 == 0, 3.0).otherwise(0.0).alias("precipitation"))
    return rows.cache()


@pytest.fixture(scope="module")
def long(readings):
    found = ordered.find_long_series(readings, block_rows=60)
    largest = readings.groupBy("container_id").count().agg(F.max("count")).first()[0]
    assert largest > readings.count() / 3 and 1 <= found.ids.count() < 10
    return found


@pytest.fixture(scope="module")
def event_rows(readings):
    return events.create_event_dataset(emptying.detect_collections(readings)).drop("date").withColumn("date", F.to_date("measured_at_utc")).cache()


@pytest.fixture(scope="module")
def long_events(event_rows):
    found = ordered.find_long_series(event_rows, block_rows=12)
    assert found is not None
    return found


def same(plain, blocked, keys=KEYS):
    a, b = (df.select(sorted(plain.columns)).toPandas() for df in (plain, blocked))
    by = keys + [c for c in a.columns if c not in keys and a[c].dtype.kind in "if"]
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (a, b))
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_no_long_series_means_plain_windows(readings):
    assert ordered.find_long_series(readings) is None


def test_blocks_stay_below_their_size(readings, long):
    _, big = long.split(readings)
    placed = ordered.positions(big, ["container_id"], emptying.time_order(), long)
    spread = placed.groupBy("container_id").agg(F.max("_pos").alias("top"), F.countDistinct("_pos").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert spread.filter("top = rows AND n = rows").count() == long.ids.count()


@pytest.mark.parametrize("future", [False, True])
def test_detection(readings, long, future):
    same(emptying.detect_collections(readings, use_future_check=future), emptying.detect_collections(readings, use_future_check=future, long=long))


def test_sensitivity(readings, long):
    same(emptying.threshold_sensitivity(readings), emptying.threshold_sensitivity(readings, long=long), ["drop_threshold", "low_after_threshold"])


def test_event_features(event_rows, long_events):
    same(events.add_event_features(event_rows).drop("date"), events.add_event_features(event_rows, long=long_events).drop("date"))


def test_first_rows_and_seasonal_naive(event_rows, long_events):
    same(events.first_rows_per_series(event_rows, 20).drop("date"), events.first_rows_per_series(event_rows, 20, long_events).drop("date"))
    same(baselines.seasonal_naive(event_rows).drop("date"), baselines.seasonal_naive(event_rows, long=long_events).drop("date"))


def test_weather_features(event_rows, long_events):
    frames = wx.frames_for("event")
    rows = event_rows.drop("date")
    same(wx.add_weather_families(rows, frames), wx.add_weather_families(rows, frames, long=long_events))


def test_newest_part(readings, long):
    same(split.mark_newest(readings, 0.15), split.mark_newest(readings, 0.15, long=long))


def test_survival(readings, long):
    same(survival.survival_data(readings), survival.survival_data(readings, long=long))


def test_leakage(event_rows, long_events):
    rows = events.add_event_features(event_rows)
    names = [f"target_lag_{k}" for k in range(1, 6)]
    same(screening.leakage_issues(rows, names), screening.leakage_issues(rows, names, long_events), ["feature"])


def test_global_running_sums_and_quantile(readings):
    small = ordered.global_running_sums(readings, [F.col("measured_at_utc")], {"upto": F.lit(1)})
    large = ordered.global_running_sums(readings, [F.col("measured_at_utc")], {"upto": F.lit(1)}, block_rows=50)
    same(small, large)
    for q in (0.1, 0.5, 0.9):
        want = readings.agg(F.percentile("percent_calculated", F.lit(q))).first()[0]
        for rows in (50, 10_000):
            got = ordered.exact_quantile(readings, "percent_calculated", q, "v", rows).first()[0]
            assert got == pytest.approx(want, abs=1e-9)


def test_global_statistics_in_chunks(readings):
    tight = DEFAULTS.with_(block_rows=40)
    rows = readings.select(
        "container_id", "measured_at_utc", F.col("percent_calculated").alias("actual"),
        (F.col("percent_calculated") * 0.8 + 7).alias("model"), F.lit(50.0).alias("baseline"), (F.col("percent_calculated") * 0.5).alias("predicted"))
    same(metrics.wilcoxon_statistic(rows), metrics.wilcoxon_statistic(rows, settings=tight), ["n_pairs"])
    same(metrics.top_share_hits(rows), metrics.top_share_hits(rows, settings=tight), ["top_pct"])
    same(metrics.capacity_lift(rows), metrics.capacity_lift(rows, settings=tight), ["capacity_pct"])
    same(wx.ensure_weather_columns(readings), wx.ensure_weather_columns(readings, tight))
    curve = survival.survival_data(readings)
    same(survival.kaplan_meier(curve), survival.kaplan_meier(curve, tight), ["duration"])


def test_copies_of_one_row_are_spread_over_chunks(spark):
    copies = spark.range(3000).select(F.lit(7).cast("long").alias("container_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("measured_at_utc"),
                                      F.lit(50.0).alias("percent_calculated"))
    long = ordered.find_long_series(copies, block_rows=500)
    placed = ordered.positions(copies, ["container_id"], emptying.time_order(), long)
    assert placed.select("_pos").distinct().count() == 3000
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 1500
    marked = split.mark_newest(copies, 0.1, long=long).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in marked} == {"train": 2700, "val": 300}


def test_readings_are_filled_in_one_pass(spark, monkeypatch):
    """Values of earlier instants only, all columns along one range exchange."""
    rows = [(k, None if k % 50 == 0 else f"2024-01-01 00:{k // 3 % 60:02d}:00", float(k) if k % 7 == 0 else None) for k in range(180)]
    given = spark.createDataFrame(rows, "id long, at string, temperature double").withColumn("measured_at_utc", F.to_timestamp_ntz("at"))
    calls, saved = [], ordered.saved
    monkeypatch.setattr(ordered, "saved", lambda df: calls.append(1) or saved(df))
    known = {}
    for _, at, value in rows:
        if value is not None:
            known[at or ""] = max(value, known.get(at or "", value))
    want = {}
    for k, at, value in rows:
        earlier = [t for t in known if at is not None and t < at]
        want[k] = value if value is not None else known[max(earlier)] if earlier else None
    for block_rows in (1_000, 8):
        filled = wx.ensure_weather_columns(given, DEFAULTS.with_(block_rows=block_rows)).collect()
        assert {r["id"]: r["temperature"] for r in filled} == want
    assert len(calls) == 2
