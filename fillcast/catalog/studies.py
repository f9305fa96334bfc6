"""Queries on whole tasks, studies and result tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import CHECKED, clean, day_predictions, event_features, predictions, raw_readings, weather_daily, weather_fine
from fillcast.catalog.metrics import PAIR_SCORES, SCORES
from fillcast.catalog.registry import query
from fillcast.catalog.splits import held_out
from fillcast.operators import baselines, metrics
from fillcast.operators.ordered import shared_folder, stored
from fillcast.plans import studies, tables
from fillcast.plans.experiments import Training, comparison_table, run_event_task, run_threshold_task, run_time_task
from fillcast.plans.features import Source, event_table, threshold_table, time_table
from fillcast.plans.job import run_job

KEYS = "container_id:i measured_at_utc:u"
TREES = {"maxIter": 3, "maxDepth": 3}
ALL = Training(params={m: TREES for m in ("balanced", "sampled", "fine")})
ONE = Training(models=("balanced",), params={"balanced": TREES})
WHOLE = Training()
# Task C has few labelled rows a container.
LABELLED = CHECKED.with_(min_grid_rows=8)
COMPARISON = "model:s n:i rmse:f mae:f wape:f smape:f r2:f rmse_ci_lower:f rmse_ci_upper:f"


def _source(spark, sf, fine: bool = True) -> Source:
    return Source.prepare(stored(clean(spark, sf)), weather_fine(spark, sf) if fine else weather_daily(spark, sf), CHECKED)


@query("x01_event_task", COMPARISON)
def event_task(spark, sf) -> DataFrame:
    source = _source(spark, sf)
    return comparison_table(run_event_task(source, stored(held_out(spark, sf)), ALL), source)


@query("x01b_event_table", KEYS + " target:f target_lag_1:f is_holiday:i dist_from_center:f temperature:f is_raining:i", """
SELECT e.*, f.target_lag_1, 0 + CASE WHEN e.date IN (DATE '2024-01-01') THEN 1 ELSE 0 END AS is_holiday,
       sqrt(power(e.latitude - 50.0812, 2) + power(e.longitude - 14.4269, 2)) * 111 AS dist_from_center
FROM ev_flags e JOIN evf f ON f.container_id = e.container_id AND f.measured_at_utc = e.measured_at_utc""", ("ev_flags", "evf"))
def event_features_table(spark, sf) -> DataFrame:
    return event_table(_source(spark, sf))


@query("x02_time_task", COMPARISON)
def time_task(spark, sf) -> DataFrame:
    source = _source(spark, sf, fine=False)
    return comparison_table(run_time_task(source, stored(held_out(spark, sf)), WHOLE), source)


@query("x02b_time_table", KEYS + " target:f current_fill:f is_raining:i wind_strong:i", "SELECT *, percent_calculated AS current_fill FROM grid_flags", ("grid_flags",))
def time_features_table(spark, sf) -> DataFrame:
    return time_table(_source(spark, sf, fine=False))


@query("x03_threshold_task", COMPARISON)
def threshold_task(spark, sf) -> DataFrame:
    source = _source(spark, sf)
    found = run_threshold_task(
        Source(source.readings, source.weather, source.long, source.clusters, CHECKED.with_(min_grid_rows=8)), stored(held_out(spark, sf)), ALL)
    return comparison_table(found, source)


@query("x03b_threshold_table", KEYS + " target:f fill_gap:f estimated_time_linear:f", "SELECT * FROM ttt_features", ("ttt_features",))
def threshold_features_table(spark, sf) -> DataFrame:
    return threshold_table(_source(spark, sf))


@query("x04_cross_validation", "fold:i model:s " + SCORES)
def cross_validation(spark, sf) -> DataFrame:
    return studies.cross_validation(_source(spark, sf), stored(held_out(spark, sf)), ALL)


@query("x05_seed_stability", "seed:i model:s " + SCORES)
def seed_stability(spark, sf) -> DataFrame:
    return studies.seed_stability(_source(spark, sf), WHOLE)


ABLATION = "variant:s n_features:i n:i rmse:f r2:f rmse_ci_lower:f rmse_ci_upper:f"


@query("x06_event_weather_ablation", ABLATION)
def event_weather_ablation(spark, sf) -> DataFrame:
    return studies.event_weather_ablation(_source(spark, sf), stored(held_out(spark, sf)), ONE)


@query("x07_time_weather_ablation", ABLATION)
def time_weather_ablation(spark, sf) -> DataFrame:
    return studies.time_weather_ablation(_source(spark, sf, fine=False), stored(held_out(spark, sf)), WHOLE)


@query("x08_capacity_segments", "capacity_class:s experiment:s n:i rmse:f mae:f wape:f r2:f")
def capacity_segments(spark, sf) -> DataFrame:
    source = replace(_source(spark, sf), settings=LABELLED)
    return tables.capacity_table(spark, studies.capacity_segments(source, training=WHOLE))


# -- tables; predictions without a model stand in for task results, so that SQL can check them

def _scored(name: str, source: str) -> str:
    return f"SELECT '{name}' AS k, {PAIR_SCORES} FROM {source}"


_DAY_SCORES = "(SELECT *, actual - predicted AS e FROM day_pairs)"


def _result(task: str, winner: str, scored: DataFrame, base: DataFrame):
    from fillcast.plans.experiments import Result
    first = metrics.all_metrics(scored).first().asDict()
    return Result(task, winner, {winner: first}, metrics.all_metrics(base).first().asDict(), scored, {winner: {"maxIter": 300, "stepSize": 0.05, "tiny": 0.0001}})


def _model_free_results(spark, sf) -> dict:
    rows, days = predictions(spark, sf), day_predictions(spark, sf)
    events = event_features(spark, sf)
    naive = baselines.last_value(events)
    return {
        "A": _result("A", "weekday", baselines.same_weekday(events), naive),
        "B": _result("B", "mix", rows, rows.withColumn("predicted", F.col("baseline"))),
        "C": _result("C", "linear", days, days),
    }


_EVENTS = "(SELECT *, actual - predicted AS e FROM (SELECT target AS actual, coalesce(target_same_dow, target_lag_1) AS predicted FROM evf) WHERE predicted IS NOT NULL)"
_NAIVE = "(SELECT *, actual - predicted AS e FROM (SELECT target AS actual, least(greatest(target_lag_1, 0), 100) AS predicted FROM evf WHERE target_lag_1 IS NOT NULL))"
_PERSIST = "(SELECT actual, baseline AS predicted, actual - baseline AS e FROM predicted)"


@query("x09_results_table", "experiment:s model_type:s model:s n:i rmse:f mae:f r2:f metric_unit:s primary_metric:s primary_metric_value:f", " UNION ALL ".join(
    f"SELECT '{e}' AS experiment, '{kind}' AS model_type, '{m}' AS model, n, rmse, mae, r2, '{unit}' AS metric_unit, '{p}' AS primary_metric, {p} AS primary_metric_value FROM ({_scored('', src)})"
    for e, kind, m, unit, p, src in (
        ("Experiment A", "main_model", "weekday", "percentage points", "rmse", _EVENTS),
        ("Experiment A", "internal_baseline", "last value", "percentage points", "rmse", _NAIVE),
        ("Experiment B", "main_model", "mix", "percentage points", "rmse", "pairs"),
        ("Experiment B", "internal_baseline", "seasonal persistence", "percentage points", "rmse", _PERSIST),
        ("Experiment C", "main_model", "linear", "days", "mae", _DAY_SCORES),
        ("Experiment C", "internal_baseline", "linear extrapolation", "days", "mae", _DAY_SCORES))), ("evf", "pairs", "day_pairs"))
def results_table(spark, sf) -> DataFrame:
    return tables.results_table(spark, _model_free_results(spark, sf))


@query("x10_capacity_comparison", "capacity_class:s experiment:s n:i rmse:f mae:f wape:f r2:f", f"""
SELECT capacity_class, 'exp_B' AS experiment, {PAIR_SCORES} FROM pairs p JOIN classes c ON c.container_id = p.container_id
WHERE capacity_class IN ('low', 'high') GROUP BY 1""", ("pairs", "classes"))
def capacity_comparison(spark, sf) -> DataFrame:
    classes = clean(spark, sf).groupBy("container_id").agg(F.first("capacity_class").alias("capacity_class"))
    rows = stored(predictions(spark, sf).join(classes, "container_id"))
    found = {}
    for segment in CHECKED.capacity_segments:
        part = rows.filter(F.col("capacity_class") == segment)
        found[segment] = {"tasks": {"B": _result("B", "mix", part, part)}}
    return tables.capacity_table(spark, found)


# parameters of a "model" per trash type, taken from the data: mean, a tiny and a whole number
_PARAMETERS = """
SELECT CASE container_id % 3 WHEN 0 THEN 'Exp A' WHEN 1 THEN 'Exp B' ELSE 'Exp C' END AS experiment, trash_type AS model,
       unnest(['level', 'share', 'rows']) AS parameter,
       unnest([round(avg(percent_calculated), 3), round(avg(percent_calculated) / 100, 3), CAST(count(*) AS DOUBLE)]) AS value, unnest([false, false, true]) AS whole
FROM clean WHERE trash_type <> 'Bio' OR container_id % 3 < 2 GROUP BY 1, 2"""


def _parameters(spark, sf) -> DataFrame:
    names = F.when(F.col("container_id") % 3 == 0, "Exp A").when(F.col("container_id") % 3 == 1, "Exp B").otherwise("Exp C")
    rows = clean(spark, sf).filter((F.col("trash_type") != "Bio") | (F.col("container_id") % 3 < 2))
    grouped = rows.groupBy(names.alias("experiment"), F.col("trash_type").alias("model")).agg(
        F.round(F.avg("percent_calculated"), 3).alias("level"), F.round(F.avg("percent_calculated") / 100, 3).alias("share"), F.count(F.lit(1)).cast("double").alias("rows"))
    entry = lambda n, w: F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value"), F.lit(w).alias("whole"))
    return grouped.select("experiment", "model", F.inline(F.array(entry("level", False), entry("share", False), entry("rows", True)))).withColumn(
        "text", F.lit(None).cast("string"))


@query("x11_parameter_table", "experiment:s model:s parameter:s shown:s", f"""
SELECT *, CASE WHEN whole THEN printf('%.0f', value) WHEN abs(value) < 1 THEN printf('%.6f', value) ELSE printf('%.4f', value) END AS shown FROM ({_PARAMETERS})""", ("clean",))
def parameter_table(spark, sf) -> DataFrame:
    return tables.parameter_table(_parameters(spark, sf))


@query("x11b_parameter_comparison", "model:s parameter:s exp_a:s exp_b:s exp_c:s", """
SELECT model, parameter, """ + ", ".join(f"coalesce(max(CASE WHEN experiment = 'Exp {e}' THEN shown END), '-') AS exp_{e.lower()}" for e in "ABC") + f"""
FROM (SELECT *, CASE WHEN whole THEN printf('%.0f', value) WHEN abs(value) < 1 THEN printf('%.4f', value) ELSE printf('%.2f', value) END AS shown FROM ({_PARAMETERS}))
GROUP BY 1, 2""", ("clean",))
def parameter_comparison(spark, sf) -> DataFrame:
    return tables.parameter_comparison(_parameters(spark, sf))


# one "seed" per container group and two "models", scored without training
_STABLE = f"""
SELECT container_id % 5 AS seed, 'mix' AS model, {PAIR_SCORES} FROM pairs GROUP BY 1
UNION ALL SELECT container_id % 5, 'persistence', {PAIR_SCORES} FROM (SELECT container_id, actual, baseline AS predicted, actual - baseline AS e FROM predicted) GROUP BY 1"""


def _stability(spark, sf) -> DataFrame:
    guesses = F.array(F.struct(F.lit("mix").alias("model"), F.col("predicted")), F.struct(F.lit("persistence").alias("model"), F.col("baseline").alias("predicted")))
    rows = predictions(spark, sf).select((F.col("container_id") % 5).alias("seed"), "actual", F.inline(guesses))
    return metrics.all_metrics(rows, by=("seed", "model"))


@query("x12_stability_pivot", "seed:i " + " ".join(f"{m}_{x}:f" for m in ("rmse", "mae", "r2") for x in ("mix", "persistence")), "SELECT seed, " + ", ".join(
    f"max(CASE WHEN model = '{x}' THEN {m} END) AS {m}_{x}" for m in ("rmse", "mae", "r2") for x in ("mix", "persistence")) + f" FROM ({_STABLE}) GROUP BY 1", ("pairs",))
def stability_pivot(spark, sf) -> DataFrame:
    return tables.stability_pivot(_stability(spark, sf), ["mix", "persistence"])


_SUMMARY = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in ("rmse", "mae", "r2"))


@query("x12b_stability_summary", "model:s n_runs:i " + " ".join(f"{m}_mean:f {m}_std:f" for m in ("rmse", "mae", "r2")),
       f"SELECT model, count(*) AS n_runs, {_SUMMARY} FROM ({_STABLE}) GROUP BY 1 UNION ALL SELECT 'all models', count(*), {_SUMMARY} FROM ({_STABLE})", ("pairs",))
def stability_summary(spark, sf) -> DataFrame:
    return tables.stability_summary(_stability(spark, sf))


@query("x13_summary", "experiment:s model:s metric:s value:f cv_type:s", " UNION ALL ".join(
    f"SELECT '{e}' AS experiment, '{m}' AS model, unnest(['n', 'rmse', 'mae', 'wape', 'smape', 'r2']) AS metric, unnest([CAST(n AS DOUBLE), rmse, mae, wape, smape, r2]) AS value, 'container_holdout' AS cv_type FROM ({_scored('', src)})"
    for e, m, src in (("exp_A", "weekday", _EVENTS), ("exp_B", "mix", "pairs"), ("exp_C", "linear", _DAY_SCORES))), ("evf", "pairs", "day_pairs"))
def summary(spark, sf) -> DataFrame:
    return tables.summary_table(spark, _model_free_results(spark, sf), CHECKED.fold_kind)


@query("x14_full_job", "experiment:s model_type:s model:s n:i rmse:f mae:f r2:f")
def full_job(spark, sf) -> DataFrame:
    out = shared_folder(spark)
    found = run_job(spark, raw_readings(spark, sf), out, weather_fine(spark, sf), settings=LABELLED, training=WHOLE)
    return tables.results_table(spark, found["results"])
