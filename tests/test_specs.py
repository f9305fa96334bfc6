"""Known answers for calendar, names and metrics."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillcast.functions import columns as fx
from fillcast.operators import calendar, encode, metrics
from fillcast.sources import tables


def hourly(spark, n, start="2019-01-01"):
    rows = spark.range(n).select(
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("measured_at_utc"),
        F.col("id").cast("double").alias("percent_calculated"))
    fields = fx.calendar_fields(F.col("measured_at_utc"))
    return rows.withColumns({k: fields[k] for k in ("day_of_week", "hour")})


def test_fourier_adds_expected_columns(spark):
    out = fx.add_fourier_features(hourly(spark, 24))
    assert {"fourier_week_sin_1", "fourier_week_cos_1", "fourier_day_sin_1", "fourier_day_cos_1"} <= set(out.columns)
    assert out.count() == 24


def test_fourier_values_in_range(spark):
    out = fx.add_fourier_features(hourly(spark, 100))
    names = [c for c in out.columns if "_sin_" in c]
    low, high = out.agg(F.min(F.least(*names)), F.max(F.greatest(*names))).first()
    assert -1 <= low and high <= 1


def test_fourier_without_inputs_changes_nothing(spark):
    df = spark.range(3)
    assert fx.add_fourier_features(df).columns == df.columns


def test_easter_known_years(spark):
    years = spark.createDataFrame([(2019,), (2020,), (1981,), (1954,), (2038,), (2049,)], "year int")
    found = {r["year"]: r["easter"] for r in calendar.easter_dates(years).collect()}
    assert found == {2019: dt.date(2019, 4, 21), 2020: dt.date(2020, 4, 12), 1981: dt.date(1981, 4, 19),
                     1954: dt.date(1954, 4, 18), 2038: dt.date(2038, 4, 25), 2049: dt.date(2049, 4, 18)}


def test_holiday_detection(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2019-01-01 10:00:00'), (timestamp_ntz'2019-06-15 00:00:00'), (NULL) AS t(date)")
    found = [tuple(r)[1:] for r in calendar.add_holiday_features(df).orderBy(F.asc_nulls_last("date")).collect()]
    assert found == [(1, 0, 1), (0, 20, 0), (0, 30, 0)]


def test_days_after_christmas_do_not_see_next_year(spark):
    df = spark.sql("SELECT * FROM VALUES (date'2019-12-31'), (date'2019-05-05') AS t(date)")
    found = {str(r["date"]): r["days_to_holiday"] for r in calendar.add_holiday_features(df).collect()}
    assert found["2019-12-31"] == 5
    both = df.union(spark.sql("SELECT date'2020-02-02'"))
    assert {str(r["date"]): r["days_to_holiday"] for r in calendar.add_holiday_features(both).collect()}["2019-12-31"] == 1


def test_sanitized_names_map_back(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], ["trash_type_Papír", "trash_type_Nápojové kartóny", "current_fill"])
    clean, back = encode.sanitize_names(df)
    assert all(" " not in c and c.isascii() for c in clean.columns)
    assert [back[c] for c in clean.columns] == df.columns
    clash = encode.safe_names(["a b", "a_b", "a-b"])
    assert len(set(clash.values())) == 3 and clash == encode.safe_names(["a b", "a_b", "a-b"])
    tricky = encode.safe_names(["a_b", "a_b_2", "a b", "a-b"])
    assert tricky["a_b"] == "a_b" and tricky["a_b_2"] == "a_b_2" and len(set(tricky.values())) == 4


def pairs(spark, y, p):
    return spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in zip(y, p)], "actual double, predicted double")


def test_rmse_and_mae_known_values(spark):
    same = metrics.all_metrics(pairs(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])).first()
    assert same["rmse"] == 0 and same["r2"] == 1
    assert metrics.all_metrics(pairs(spark, [1, 2, 3], [2, 3, 4])).first()["rmse"] == pytest.approx(1)
    assert metrics.all_metrics(pairs(spark, [1, 2, 3], [0, 3, 2])).first()["mae"] == pytest.approx(1)


def test_all_metrics_keys_and_interval(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(50, 15, 200)
    p = y + rng.normal(0, 3, 200)
    row = metrics.metrics_with_intervals(pairs(spark, y, p)).first()
    assert row["n"] == 200 and row["r2"] > 0.5
    assert row["rmse_ci_lower"] < row["rmse"] < row["rmse_ci_upper"]
    errors = (y - p) ** 2
    draws = np.sqrt(errors[rng.integers(0, 200, (2000, 200))].mean(axis=1))
    low, high = np.percentile(draws, [2.5, 97.5])
    assert row["rmse_ci_lower"] == pytest.approx(low, abs=0.12) and row["rmse_ci_upper"] == pytest.approx(high, abs=0.12)


def test_metrics_skip_missing_and_nan(spark):
    row = metrics.all_metrics(pairs(spark, [1, 2, None, math.nan], [1, None, 3, 4])).first()
    assert row["n"] == 1 and row["rmse"] == 0 and row["r2"] is None


def test_metrics_of_nothing_and_of_zeros(spark):
    empty = metrics.all_metrics(pairs(spark, [None], [1])).first()
    assert empty["n"] == 0 and empty["rmse"] is None and empty["wape"] is None
    assert metrics.all_metrics(pairs(spark, [0, 0], [0, 0])).first()["wape"] == 0
    assert metrics.all_metrics(pairs(spark, [0, 0], [1, 0])).first()["wape"] is None
    assert metrics.all_metrics(pairs(spark, [4, 4], [4, 5])).first()["r2"] == 0


def test_paired_tests_against_exact_rules(spark):
    rows = [(float(i), float(i) + (i % 5) * 0.3, float(i) + 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "actual double, model double, baseline double")
    w, t = metrics.paired_test(df).first(), metrics.paired_test(df, "ttest").first()
    d = np.array([(i % 5) * 0.3 - 1.0 for i in range(40)])
    assert t["statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(40)))
    order = {v: k for k, v in enumerate(sorted(set(np.round(abs(d), 9))))}
    groups = [np.sum(np.round(abs(d), 9) == v) for v in order]
    ranks = np.array([sum(groups[: order[v]]) + (groups[order[v]] + 1) / 2 for v in np.round(abs(d), 9)])
    assert w["statistic"] == pytest.approx(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    assert w["stars"] == "***"
    few = metrics.paired_test(df.limit(5)).first()
    assert few["p_value"] is None and few["stars"] == ""
    equal = metrics.paired_test(df.withColumn("baseline", F.col("model"))).first()
    assert equal["p_value"] == 1.0


def test_small_samples_take_exact_tails(spark):
    assert metrics.student_tail(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert metrics.student_tail(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert metrics.student_tail(0.0, 9) == pytest.approx(1.0) and metrics.student_tail(-3.0, 20) == metrics.student_tail(3.0, 20)
    for n, w in ((5, 0), (10, 8), (11, 33)):
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
        assert metrics.signed_rank_tail(w, n) == pytest.approx(min(1.0, 2 * sum(x <= w for x in sums) / 2 ** n))
    # ten pairs whose gaps have ranks 1 to 10, the three least of them positive
    rows = [(0.0, 10.0 + (g if g <= 3 else -g), 10.0) for g in range(1, 11)]
    got = metrics.paired_test(spark.createDataFrame(rows, "actual double, model double, baseline double")).first()
    assert got["statistic"] == 6 and got["p_value"] == pytest.approx(metrics.signed_rank_tail(6, 10)) and got["stars"] == "*"


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(float(i % 7), float(i % 5) + i / 90) for i in range(300)] + [(3.0, 4.0)] * 200
    df = spark.createDataFrame(rows, "actual double, predicted double")
    first, second = (metrics.bootstrap_intervals(df.repartition(k), rounds=50, buckets=64).first() for k in (1, 7))
    assert list(first) == pytest.approx(list(second)) and first["rmse_ci_lower"] < first["rmse_ci_upper"]
    one = metrics.bootstrap_intervals(spark.createDataFrame([(1.0, 3.0)] * 1000, df.schema), rounds=20, buckets=16).first()
    assert list(one) == pytest.approx([2.0] * 4)  # copies fill all buckets


def test_readings_need_their_columns(spark):
    with pytest.raises(ValueError, match="percent_calculated"):
        tables.conform_readings(spark.sql("SELECT 1L AS container_id, timestamp_ntz'2024-01-01' AS measured_at_utc, 'x' AS trash_type"))


def test_csv_readings_in_utc(spark, tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text("container_id,measured_at_utc,percent_calculated,trash_type\n1,2019-03-01 10:00:00+02:00,12.5,Bio\n1,2019-03-01 10:00:00,,Bio\n2,not a time,3,Bio\n")
    rows = tables.read_readings(spark, str(path)).orderBy("container_id", "measured_at_utc").collect()
    assert [r["measured_at_utc"] for r in rows] == [dt.datetime(2019, 3, 1, 8), dt.datetime(2019, 3, 1, 10), None]
    assert rows[1]["percent_calculated"] is None


def test_weather_file_variants(spark, tmp_path):
    assert tables.read_weather(spark, str(tmp_path / "missing.csv")) is None
    (tmp_path / "no_time.csv").write_text("tavg\n1\n")
    assert tables.read_weather(spark, str(tmp_path / "no_time.csv")) is None
    (tmp_path / "w.csv").write_text("date,tmin,tmax,prcp\n2024-01-02,1,3,\n2024-01-02,1,5,2\nbad,1,1,1\n")
    rows = tables.read_weather(spark, str(tmp_path / "w.csv")).collect()
    assert len(rows) == 1 and rows[0]["temperature"] in (2.0, 3.0) and rows[0]["wind_speed"] is None
