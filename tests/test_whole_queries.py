"""Registered model queries and studies do their whole job: presets as they are, all tasks, presets, seeds and folds."""

import inspect

import pytest

from fillcast.catalog import REGISTRY, models, studies
from fillcast.config import DEFAULTS
from fillcast.operators import model
from fillcast.operators.boosting import BoostedTrees
from fillcast.plans import job, studies as plans
from fillcast.plans.experiments import run_time_task
from fillcast.plans.features import Source


@pytest.fixture
def fits(spark, monkeypatch):
    """Settings of all fits of a query over a small table; the trees themselves are left out."""
    rows = spark.sql("""
        SELECT id % 20 AS container_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id DIV 20 AS INT) * 6) AS measured_at_utc,
               CAST(id % 7 AS DOUBLE) AS percent_calculated, 'Bio' AS trash_type, CAST(id % 90 AS DOUBLE) AS target, id % 24 AS hour, id % 7 AS day_of_week
        FROM range(600)""").selectExpr("*", *[f"CAST(id % 13 AS DOUBLE) AS {c}".replace("id", "target") for c in models.FEATURES[:-2]])
    test = rows.filter("container_id < 4")
    monkeypatch.setattr(models, "_sides", lambda spark, sf: (rows.filter("container_id >= 4"), test))
    monkeypatch.setattr(models, "long_series", lambda spark, sf: None)
    seen = []

    def fit_trees(rows, columns, target, held, s, *args, **kwargs):
        seen.append(s)
        return BoostedTrees(tuple(columns), 50.0, ())

    monkeypatch.setattr(model, "fit_trees", fit_trees)
    return seen


def test_all_presets_are_trained_whole(spark, fits):
    assert REGISTRY["l01_train_and_evaluate"].run(spark, "").count() == 3
    assert sorted(map(str, fits)) == sorted(str(model.tree_settings(p)) for p in model.PRESETS.values())


def test_permutation_importance_is_of_whole_models(spark, fits):
    assert REGISTRY["l08_permutation_importance"].run(spark, "").count() == len(models.FEATURES)
    assert fits == [model.tree_settings(model.PRESETS["balanced"])] * DEFAULTS.folds


@pytest.fixture
def asked(spark, monkeypatch):
    """What a study query asks of its plan, by parameter name; the plan is not run."""
    source = Source(spark.range(1), None, None, None, studies.CHECKED)
    for name, value in (("_source", source), ("held_out", None), ("stored", None), ("shared_folder", "out"), ("weather_fine", None), ("comparison_table", None)):
        monkeypatch.setattr(studies, name, lambda *a, value=value, **k: value)
    monkeypatch.setattr(studies, "raw_readings", lambda *a: spark.sql("SELECT 1 AS container_id, 2 AS humidity"))
    for table in ("capacity_table", "results_table"):
        monkeypatch.setattr(studies.tables, table, lambda *a: None)
    seen = {}

    def record(where, name, plan):
        def called(*args, **kwargs):
            bound = inspect.signature(plan).bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update(bound.arguments)
            return {"results": {}}

        monkeypatch.setattr(where, name, called)

    record(studies, "run_time_task", run_time_task)
    record(studies, "run_job", job.run_job)
    for name in ("seed_stability", "time_weather_ablation", "capacity_segments"):
        record(plans, name, getattr(plans, name))
    return seen


def whole(training, names=tuple(model.PRESETS)):
    return training.models[:len(names)] == names and all(training.params_of(n) == model.PRESETS[n] for n in names)


def test_time_task_trains_whole_presets(spark, asked):
    REGISTRY["x02_time_task"].build(spark, "")
    assert whole(asked["training"])


def test_seed_stability_trains_whole_presets(spark, asked):
    REGISTRY["x05_seed_stability"].build(spark, "")
    assert whole(asked["training"]) and asked["source"].settings.stability_seeds == DEFAULTS.stability_seeds


def test_time_weather_ablation_trains_the_whole_first_preset(spark, asked):
    REGISTRY["x07_time_weather_ablation"].build(spark, "")
    assert whole(asked["training"], ("balanced",))


def test_capacity_segments_run_all_tasks_presets_and_folds(spark, asked):
    REGISTRY["x08_capacity_segments"].build(spark, "")
    assert whole(asked["training"]) and asked["tasks"] == "ABC" and asked["with_baselines"]
    assert asked["source"].settings.folds == DEFAULTS.folds


def test_the_full_job_leaves_nothing_out(spark, asked):
    REGISTRY["x14_full_job"].build(spark, "")
    assert whole(asked["training"]) and asked["tasks"] == "ABC" and asked["with_segments"] and asked["with_baselines"]
    assert asked["settings"].folds == DEFAULTS.folds and asked["settings"].stability_seeds == DEFAULTS.stability_seeds
    assert "humidity" in asked["readings"].columns
