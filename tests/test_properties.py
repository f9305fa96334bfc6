"""Properties: no leakage, disjoint splits, repeatability, edge cases of the series operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS
from fillcast.operators import emptying, encode, events, grid, screening, split, weather

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def readings(spark):
    return spark.read.parquet(f"{SF}/events.parquet").filter("value BETWEEN 0 AND 100").select(
        F.col("user_id").alias("container_id"), F.col("ts").alias("measured_at_utc"), F.col("value").alias("percent_calculated"),
        F.col("event_type").alias("trash_type")).cache()


def test_detection_matches_pandas(readings):
    got = emptying.detect_collections(readings).toPandas().sort_values(["container_id", "measured_at_utc"]).reset_index(drop=True)
    pdf = readings.toPandas().sort_values(["container_id", "measured_at_utc"]).reset_index(drop=True)
    g = pdf.groupby("container_id")
    change = pdf["percent_calculated"] - g["percent_calculated"].shift(1)
    gap = (pdf["measured_at_utc"] - g["measured_at_utc"].shift(1)).dt.total_seconds() / 3600
    limit = np.maximum(change.groupby(pdf["container_id"]).transform(lambda x: x.quantile(0.1)), -30)
    want = (change <= limit) & (gap <= 168) & (pdf["percent_calculated"] < 50) & (g["percent_calculated"].shift(1) > 40)
    assert got["is_collection"].tolist() == want.astype(int).tolist()


def test_grid_matches_pandas(readings):
    got = grid.resample_time_series(readings).toPandas().sort_values(["container_id", "measured_at_utc"]).reset_index(drop=True)
    parts = []
    for cid, part in readings.toPandas().sort_values("measured_at_utc").groupby("container_id"):
        s = part.set_index("measured_at_utc")["percent_calculated"].resample("6h").last().ffill(limit=2).dropna()
        parts.append(pd.DataFrame({"container_id": cid, "measured_at_utc": s.index, "percent_calculated": s.values}))
    want = pd.concat(parts).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, check_dtype=False)


def test_time_to_threshold_matches_scan(readings):
    rows = grid.label_time_to_threshold(grid.resample_time_series(readings)).toPandas().sort_values(["container_id", "measured_at_utc"])
    for _, part in rows.groupby("container_id"):
        level, want = part["percent_calculated"].to_numpy(), []
        for i in range(len(level)):
            hours = 0.0 if level[i] >= 85 else np.nan
            for j in range(i + 1, min(i + 100, len(level))) if level[i] < 85 else ():
                if level[j] < level[j - 1] - 25:
                    break
                if level[j] >= 85:
                    hours = (j - i) * 6.0
                    break
            want.append(hours)
        np.testing.assert_array_equal(part["time_to_threshold_hours"].to_numpy(dtype=float), np.array(want))


def test_features_ignore_the_future(readings):
    """Changing the newest readings must not change features of older rows."""
    cut = "timestamp_ntz'2024-01-20 00:00:00'"
    changed = readings.withColumn("percent_calculated", F.when(F.expr(f"measured_at_utc >= {cut}"), 100 - F.col("percent_calculated")).otherwise(F.col("percent_calculated")))
    names = ["fill_lag_1", "fill_roll_mean_6", "fill_roll_std_24", "container_fill_mean", "had_drop_24h"]

    def older(df):
        out = grid.add_time_features(grid.resample_time_series(df)).filter(F.expr(f"measured_at_utc < {cut}"))
        return out.select("container_id", "measured_at_utc", *names).toPandas().sort_values(["container_id", "measured_at_utc"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(older(readings), older(changed))


def test_results_do_not_depend_on_partitions(spark, readings):
    def run():
        e = events.add_event_features(events.create_event_dataset(emptying.detect_collections(readings)))
        return e.drop("date").toPandas().sort_values(["container_id", "measured_at_utc"]).reset_index(drop=True)

    many = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        pd.testing.assert_frame_equal(many, run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hold_outs_are_disjoint_and_repeatable(readings):
    n = readings.select("container_id").distinct().count()
    first, again, other = (split.hold_out_containers(readings, s) for s in (42, 42, 7))
    ids = {r[0] for r in first.collect()}
    assert len(ids) == int(n * 0.2) and ids == {r[0] for r in again.collect()}
    assert len(other.collect()) == len(ids)
    train, test = split.split_by_containers(readings, first)
    assert train.join(test, "container_id", "left_semi").isEmpty()
    assert train.count() + test.count() == readings.count()


def test_folds_cover_containers_once_and_respect_the_cutoff(readings):
    folds = split.holdout_folds(readings, 5).cache()
    sizes = sorted(r["n"] for r in folds.filter("part = 'val'").groupBy("fold").agg(F.countDistinct("container_id").alias("n")).collect())
    n = readings.select("container_id").distinct().count()
    assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1
    for r in folds.groupBy("fold").agg(
            F.max(F.when(F.col("part") == "train", F.col("measured_at_utc"))).alias("last"),
            F.min(F.when(F.col("part") == "val", F.col("measured_at_utc"))).alias("first")).collect():
        assert r["last"] is None or r["last"] < r["first"]
    assert folds.groupBy("fold", "container_id").agg(F.countDistinct("part").alias("n")).filter("n > 1").isEmpty()


def test_more_folds_than_containers(spark):
    few = spark.sql("SELECT id AS container_id, timestamp_ntz'2024-01-01' AS measured_at_utc, 1.0D AS percent_calculated FROM range(3)")
    assert {r["fold"] for r in split.assign_folds(few, 5, 1).collect()} == {0, 1, 2}


def test_expanding_folds_stop_at_the_end(readings):
    folds = split.expanding_folds(readings, 5)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {1, 2, 3, 4}


def test_encoder_gives_the_same_columns_on_new_data(spark):
    train = spark.createDataFrame([(f"d{i % 14}", "a" if i % 3 else None) for i in range(200)], "district string, trash_type string")
    new = spark.createDataFrame([("unseen", "unseen"), ("d1", None)], "district string, trash_type string")
    encoder = encode.CategoryEncoder.fit(train)
    a, b = encoder.transform(train), encoder.transform(new)
    assert a.columns == b.columns and len(encoder.feature_names) == 9 + 2
    first = b.filter("district = 'unseen'").first()
    assert first["district__other_"] == 1 and first["trash_type_a"] == 0 and first["trash_type__unknown_"] == 0


def test_leakage_check_finds_a_leak(readings):
    rows = events.add_event_features(events.create_event_dataset(emptying.detect_collections(readings)))
    assert screening.has_no_leakage(rows, ["target_lag_1", "target_lag_2"])
    assert not screening.has_no_leakage(rows.withColumn("target_lag_1", F.col("target")), ["target_lag_1"])


def test_no_weather_means_no_weather_features(readings):
    assert weather.add_all_weather_features(readings, None) is readings


def test_time_mode_needs_a_step():
    with pytest.raises(ValueError):
        weather.frames_for("time")
    assert weather.frames_for(step_hours=6).hours((1, 6, 12, 24)) == [(1, "6h"), (2, "12h"), (4, "24h")]


def test_optional_columns_are_added(spark):
    from fillcast.operators.cleaning import clean_readings
    raw = spark.sql("SELECT 1L AS container_id, timestamp_ntz'2024-01-01' AS measured_at_utc, 5.0D AS percent_calculated, 'Bio' AS trash_type")
    row = clean_readings(raw).first()
    assert row["capacity_class"] == "unknown" and row["firealarm"] == 0 and row["temperature"] is None and row["district_num"] is None


def test_settings_are_frozen():
    with pytest.raises(Exception):
        DEFAULTS.seed = 1
    assert DEFAULTS.with_(seed=1).seed == 1 and DEFAULTS.seed == 42


def test_a_temporal_split_is_marked_once(spark):
    rows = spark.range(300).selectExpr("id % 7 AS container_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS measured_at_utc", "double(id % 100) AS percent_calculated")
    for side in split.temporal_split(rows):
        assert "Window" not in side._jdf.queryExecution().optimizedPlan().toString()
