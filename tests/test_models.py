"""Behaviour of what SQL cannot check: trees, search, importance, forecasters, survival fit, tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS
from fillcast.operators import arima, forecasting, metrics, model, screening, survival
from fillcast.operators.boosting import BoostedTrees, Tree
from fillcast.operators.cleaning import clean_readings
from fillcast.operators.ordered import local_table
from fillcast.plans import features, studies, tables
from fillcast.plans.experiments import Result, Training

SMALL = {"maxIter": 8, "maxDepth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    """target = 3 a - 40 b + noise; c is irrelevant; a is sometimes missing."""
    rng = np.random.default_rng(3)
    n = 1500
    a, b, c = rng.uniform(0, 30, n), rng.integers(0, 2, n), rng.normal(size=n)
    pdf = pd.DataFrame({
        "container_id": np.arange(n) % 30, "measured_at_utc": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"),
        "a": np.where(rng.random(n) < 0.1, np.nan, a), "b": b, "c": c,
        "target": np.clip(3 * a - 40 * b + 45 + rng.normal(0, 1, n), 0, 100), "percent_calculated": 1.0})
    return spark.createDataFrame(pdf).withColumn("measured_at_utc", F.col("measured_at_utc").cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.train_model("balanced", rows, ["a", "b", "c"], params=model.preset("balanced", stepSize=0.3, **SMALL))


def test_model_beats_the_mean(rows, fitted):
    scored = metrics.all_metrics(fitted.predict(rows).withColumn("actual", F.col("target"))).first()
    assert scored["r2"] > 0.6 and scored["n"] == 1500
    low, high = fitted.predict(rows).agg(F.min("predicted"), F.max("predicted")).first()
    assert 0 <= low and high <= 100
    assert fitted.columns == ("a", "b", "c") and fitted.info["n_iter"] <= 8


def test_importances_agree_on_the_irrelevant_feature(rows, fitted):
    shap = {r["feature"]: r["shap_importance"] for r in model.shapley_importance(fitted, rows, rows=200).collect()}
    perm = {r["feature"]: r["rmse_growth"] for r in model.permutation_importance(fitted, rows).collect()}
    gain = dict(fitted.gains())
    for found in (shap, perm, gain):
        assert found["b"] > 5 * abs(found["c"]) and found["a"] > 5 * abs(found["c"])


def test_search_is_repeatable(rows):
    import random
    first, second = (model.draw_params("fine", random.Random(9)) for _ in range(2))
    assert first == second and 0.01 <= first["stepSize"] <= 0.3 and 3 <= first["maxDepth"] <= 12
    space = model.SEARCH_SPACE | {"maxIter": (2, 3, False), "maxDepth": (2, 2, False)}
    best, trials = model.search("balanced", rows, ["a", "b"], trials=2, space=space)
    table = trials.toPandas()
    assert len(table) == 2 and table["value"].notna().all()
    assert float(table.loc[table["value"].idxmin(), "params"]["stepSize"]) == best["stepSize"]


def test_pair_correlations_match_pandas(rows):
    got = {(r["feature_a"], r["feature_b"]): r["abs_corr"] for r in screening.pair_correlations(rows, ["a", "b", "c", "target"]).collect()}
    want = rows.select("a", "b", "c", "target").toPandas().corr().abs()
    assert len(got) == 6
    for (i, j), v in got.items():
        assert v == pytest.approx(want.loc[i, j], abs=1e-9)


def test_autoregression_recovers_its_coefficients():
    rng = np.random.default_rng(1)
    x = [50.0, 52.0]
    for _ in range(600):
        x.append(10 + 1.1 * x[-1] - 0.3 * x[-2] + rng.normal(0, 0.5))
    found = arima.fit_arima(np.array(x), arima.Order(p=2))
    assert abs(found.constant - 10) < 3 and abs(found.level[0] - 1.1) < 0.1 and abs(found.level[1] + 0.3) < 0.1
    known = arima.Arima(arima.Order(p=1), 1.0, np.array([0.5]), np.zeros(0), 1, 0.0)
    np.testing.assert_allclose(arima.forecasts_from(known, np.array([4.0]), np.array([1]), 3), [[3.0, 2.5, 2.25]])


def test_forecasts_follow_a_weekly_pattern(spark):
    t = pd.date_range("2024-01-01", periods=120, freq="6h")
    y = 40 + 0.1 * np.arange(120) + 15 * np.sin(2 * np.pi * np.arange(120) / 28)
    df = spark.createDataFrame(pd.DataFrame({"container_id": 1, "measured_at_utc": t, "y": y})).withColumn(
        "measured_at_utc", F.col("measured_at_utc").cast("timestamp_ntz"))
    assert metrics.all_metrics(forecasting.trend_forecasts(df, "y")).first()["rmse"] < 1.0
    assert forecasting.ar_forecasts(df.filter("y IS NULL"), "y").count() == 0


def test_kaplan_meier_known_curve(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (4.0, True)], "duration double, event boolean")
    curve = {r["duration"]: r["survival"] for r in survival.kaplan_meier(df).collect()}
    assert curve[1.0] == pytest.approx(0.75) and curve[2.0] == pytest.approx(0.75)
    assert curve[3.0] == pytest.approx(0.375) and curve[4.0] == 0
    assert survival.median_survival(survival.kaplan_meier(df)).first()[0] == 3.0


def test_kaplan_meier_without_median(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, False), (4.0, False)], "duration double, event boolean")
    assert survival.median_survival(survival.kaplan_meier(df)).first()[0] is None


def test_rolling_forecast_compares_aligned_steps():
    t = pd.date_range("2024-01-01", periods=100, freq="6h")
    out = forecasting._rolling(pd.DataFrame({"container_id": 1, "measured_at_utc": t, "y": np.arange(100.0) / 2}), 4, 10)
    ar = out[out["model"] == "autoregressive"]
    np.testing.assert_allclose(ar["predicted"], ar["actual"], atol=1e-6)
    assert len(ar) == 10 and ar["actual"].iloc[0] == (70 + 3) / 2


def test_balanced_does_not_stop_on_the_scored_fold(rows):
    params = {"maxIter": 4, "maxDepth": 3}
    columns = ["a", "b", "c"]
    alone = model.train_model("balanced", rows, columns, None, params)
    beside = model.train_model("balanced", rows, columns, rows.filter("a > 5"), params)
    assert alone.info["n_iter"] == beside.info["n_iter"]
    a, b = (m.predict(rows).agg({"predicted": "sum"}).first()[0] for m in (alone, beside))
    assert a == pytest.approx(b)


def test_forecasts_take_every_container(spark):
    t = pd.date_range("2024-01-01", periods=60, freq="6h")
    pdf = pd.concat([pd.DataFrame({"container_id": c, "measured_at_utc": t, "y": 40 + 10 * np.sin(np.arange(60) / 3 + c)}) for c in range(55)])
    found = forecasting.ar_forecasts(spark.createDataFrame(pdf), "y")
    assert found.select("container_id").distinct().count() == 55


def test_predictions_are_made_once_a_row(spark):
    """A condition on the prediction must not score the rows once more, in a second Python worker of the task."""
    tree = Tree()
    tree.add(50.0, 1.0)
    fitted = model.TrainedModel("balanced", BoostedTrees(("a",), 0.0, (tree,)), (0.0, 100.0))
    rows = spark.range(20).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS actual")
    scored = metrics.complete_pairs(fitted.predict(rows)).agg(metrics.rmse(), F.count(F.lit(1)))
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert scored.first()[1] == 20


def test_tables_of_few_rows_need_no_python_on_the_executors(spark):
    schema = "model string, number int, value double, params map<string,string>"
    rows = [("balanced", 1, 2.5, {"b": "1", "a": "x"}), (None, None, None, None)]
    found = local_table(spark, rows, schema)
    assert [tuple(r) for r in found.collect()] == rows and found.schema == spark.createDataFrame([], schema).schema
    assert local_table(spark, [], schema).isEmpty()
    segment = {"low": {"tasks": {"A": Result("A", "m", {"m": {"n": 3, "rmse": 1.0, "mae": 2.0, "wape": None, "smape": 4.0, "r2": float("nan")}}, {}, found, {})}}}
    table = tables.capacity_table(spark, segment)
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert [str(tuple(r)) for r in table.collect()] == [str(("low", "exp_A", 3, 1.0, 2.0, 4.0, float("nan")))]


def test_event_table_is_made_once_for_all_steps(spark, monkeypatch):
    """Steps share one stored table; its frequent containers are those that a filter before the features keeps."""
    readings = spark.range(8 * 60).selectExpr(
        "id % 8 AS container_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id DIV 8 AS INT) * 10) AS measured_at_utc",
        "CAST(CASE WHEN (id DIV 8) % (3 + id % 8) = 0 THEN 5 ELSE 60 + id % 30 END AS DOUBLE) AS percent_calculated",
        "'Bio' AS trash_type", "'1100' AS container_type", "'praha-1' AS district", "CAST(50 AS DOUBLE) AS latitude", "CAST(14 + id % 8 AS DOUBLE) AS longitude")
    source = features.Source.prepare(clean_readings(readings), settings=DEFAULTS.with_(folds=2, stability_seeds=(1,), min_events=10))
    made, real = [], features.event_table

    def counted(*args, **kwargs):
        made.append(1)
        return real(*args, **kwargs)

    monkeypatch.setattr(features, "event_table", counted)
    one = Training(models=("balanced",), params={"balanced": {"maxIter": 1, "maxDepth": 1}})
    held_out = spark.createDataFrame([(0,), (3,)], "container_id long")
    assert studies.cross_validation(source, held_out, one).count() == 2
    studies.seed_stability(source, one)
    assert len(made) == 1
    early, late = real(source, weather=False, min_events=10), screening.keep_frequent(source.events, 10)
    rows = [sorted(str(r) for r in df.select(*early.columns).collect()) for df in (early, late)]
    assert rows[0] == rows[1] and 0 < len(rows[0]) < source.events.count()
