"""The boosted trees against a plain booster, their exact Shapley values against all subsets, and the search."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.operators import boosting, model, parzen
from fillcast.operators.boosting import MISSING, TreeSettings

COLUMNS = ["c0", "c1", "c2"]


def table(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[:, 2] = rng.integers(0, 3, n)
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = 3 * np.nan_to_num(x[:, 0], nan=2.5) + np.where(np.isnan(x[:, 1]), 4, x[:, 1] ** 2) + rng.normal(0, 0.2, n)
    return x, y, rng.random(n) < 0.2


@pytest.fixture(scope="module")
def data(spark):
    x, y, held = table()
    frame = pd.DataFrame({**{c: x[:, k] for k, c in enumerate(COLUMNS)}, "y": y, "held": held, "id": np.arange(len(y))})
    return x, y, held, spark.createDataFrame(frame).repartition(5).cache()


def plain_best(x, g, rows, s):
    """The best split of some rows by trying every feature, value and side for the missing."""
    best = None
    for f in range(x.shape[1]):
        v = x[rows, f]
        gaps = np.isnan(v)
        for cut in np.unique(x[~np.isnan(x[:, f]), f])[:-1]:
            for with_missing in ((True, False) if gaps.any() else (None,)):
                left = np.where(gaps, bool(with_missing), v <= cut)
                if left[~gaps].sum() == 0 and not gaps.any() or min(left.sum(), (~left).sum()) < s.least_rows or not (v[~gaps] <= cut).any():
                    continue
                part = lambda m: g[rows][m].sum() ** 2 / (m.sum() + s.l2)
                gain = part(left) + part(~left) - part(np.ones(len(rows), bool))
                if gain > boosting.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                    best = (gain, rows[left], rows[~left])
    return best


def plain_tree(x, g, s, out):
    """Adds a tree's values to `out`; best leaf first or level by level."""
    leaves = [(np.arange(len(g)), 0)]
    while True:
        options = []
        for k, (rows, depth) in enumerate(leaves):
            if (not s.depth or depth < s.depth) and len(rows) >= 2 * s.least_rows and (found := plain_best(x, g, rows, s)):
                options.append((found[0], -k, found))
        if not options or s.leaves and len(leaves) >= s.leaves:
            break
        for _, k, (_, left, right) in [max(options)] if s.leaves else sorted(options):
            depth = leaves[-k][1] + 1
            leaves[-k] = (left, depth)
            leaves.append((right, depth))
    for rows, _ in leaves:
        out[rows] += -g[rows].sum() / (len(rows) + s.l2) * s.step
    return len(leaves)


@pytest.mark.parametrize("s", [
    TreeSettings(rounds=3, step=0.4, depth=3, least_rows=10, l2=1.0), TreeSettings(rounds=3, step=0.4, depth=0, leaves=7, least_rows=15, l2=0.1)],
    ids=["levels", "leaves"])
def test_equals_a_plain_booster(data, s):
    x, y, held, df = data
    fitted = boosting.fit_trees(df, COLUMNS, "y", F.lit(False), s)
    want = np.full(len(y), y.mean())
    sizes = [plain_tree(x, want - y, s, want) for _ in range(s.rounds)]
    np.testing.assert_allclose(fitted.values(x), want, atol=1e-9)
    assert [sum(f < 0 for f in t.feature) for t in fitted.trees] == sizes


def test_the_same_on_any_partitioning_and_in_spark(data):
    x, _, _, df = data
    s = TreeSettings(rounds=3, depth=3, row_share=0.7, column_share=0.7)
    a, b = (boosting.fit_trees(d, COLUMNS, "y", F.col("held"), s, seed=3, keys=["id"]) for d in (df, df.repartition(2)))
    np.testing.assert_allclose(a.values(x), b.values(x), atol=1e-9)
    scored = df.select("id", a.score(boosting.number_array(COLUMNS)).alias("p")).orderBy("id").toPandas()["p"]
    np.testing.assert_allclose(scored, a.values(x), atol=1e-12)
    bagged = boosting._in_bag(np.arange(100_000) * 7919, 3, 1, 0.7)
    assert abs(bagged.mean() - 0.7) < 0.01


def test_stops_on_the_validation_rows(data):
    x, y, held, df = data
    noise = df.withColumn("y", F.xxhash64("id") % 1000 / 1000.0)  # nothing to learn
    s = TreeSettings(rounds=40, step=0.5, depth=3, least_rows=5, patience=4)
    fitted = boosting.fit_trees(noise, COLUMNS, "y", F.col("held"), s)
    assert len(fitted.losses) < 40 and len(fitted.trees) == int(np.argmin(fitted.losses)) and len(fitted.losses) - 1 - len(fitted.trees) >= 4
    whole = boosting.fit_trees(df, COLUMNS, "y", F.col("held"), TreeSettings(rounds=4, step=0.3, depth=2, patience=4))
    assert whole.losses[-1] == pytest.approx(((whole.values(x) - y)[held] ** 2).mean())


def test_rows_are_stored_anew_without_a_change(data, monkeypatch):
    x, _, _, df = data
    s = TreeSettings(rounds=4, depth=2)
    want = boosting.fit_trees(df, COLUMNS, "y", F.lit(False), s).values(x)
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    np.testing.assert_allclose(boosting.fit_trees(df, COLUMNS, "y", F.lit(False), s).values(x), want, atol=1e-9)


def test_hard_tables(spark):
    schema = "c0 double, c1 double, c2 double, y double, held boolean"
    s = TreeSettings(rounds=3, depth=2, least_rows=1)
    assert boosting.fit_trees(spark.createDataFrame([], schema), COLUMNS, "y", F.col("held"), s).trees == ()
    flat = boosting.fit_trees(spark.createDataFrame([(1.0, None, float("nan"), 7.0, None)] * 5 + [(1.0, None, None, None, False)], schema), COLUMNS, "y", F.col("held"), s)
    assert flat.base == 7.0 and flat.trees == () and flat.values(np.array([[np.nan] * 3])).tolist() == [7.0]
    gaps = [(None, 1.0, 1.0, 9.0, False)] * 4 + [(2.0, 1.0, 1.0, 1.0, False)] * 4
    learned = boosting.fit_trees(spark.createDataFrame(gaps, schema), COLUMNS, "y", F.col("held"), s)
    assert learned.base == 5.0 and len(learned.trees) in (0, 3)


@pytest.mark.parametrize("s", [
    TreeSettings(rounds=12, step=0.2, depth=5, least_rows=3, row_share=0.8, column_share=0.7, patience=5),
    TreeSettings(rounds=12, step=0.2, depth=0, leaves=31, least_rows=4, l2=0.1, patience=5)], ids=["levels", "leaves"])
def test_a_fit_in_one_task_equals_the_passes(data, monkeypatch, s):
    df = data[3]
    monkeypatch.setattr(boosting, "FEW_ROUNDS", 0)
    one = boosting.fit_trees(df, COLUMNS, "y", F.col("held"), s, seed=3, keys=["id"])
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    passes = boosting.fit_trees(df.repartition(3), COLUMNS, "y", F.col("held"), s, seed=3, keys=["id"])
    assert len(one.trees) > 5 and one.losses == pytest.approx(passes.losses)
    for a, b in zip(one.trees, passes.trees, strict=True):
        for name in ("feature", "bin", "threshold", "missing_left", "left", "right", "cover"):
            assert getattr(a, name) == getattr(b, name)
        assert a.value == pytest.approx(b.value, abs=1e-9) and a.gain == pytest.approx(b.gain)


def test_a_short_table_is_fitted_in_one_job(data):
    """300 rounds of passes would be thousands of jobs."""
    df = data[3]
    context = df.sparkSession.sparkContext
    context.setJobGroup("short", "")
    try:
        fitted = boosting.fit_trees(df, COLUMNS, "y", F.lit(False), TreeSettings(rounds=300, depth=2))
        assert len(fitted.trees) == 300 and len(context.statusTracker().getJobIdsForGroup("short")) < 20
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_bins_are_few_and_ordered():
    edges = boosting.bin_edges(np.concatenate([np.arange(5000.0), [np.nan] * 10]))
    assert len(edges) < MISSING and (np.diff(edges) > 0).all()
    assert boosting.bin_edges(np.array([3.0, 1.0, np.nan, 1.0])).tolist() == [1.0] and len(boosting.bin_edges(np.array([np.nan]))) == 0


def expected(tree, x, present, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in present:
        goes = tree.missing_left[node] if np.isnan(x[f]) else x[f] <= tree.threshold[node]
        return expected(tree, x, present, left if goes else right)
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, x, present, c) for c in (left, right))


def test_shapley_values_equal_all_subsets(data):
    x, _, _, df = data
    fitted = boosting.fit_trees(df, COLUMNS, "y", F.lit(False), TreeSettings(rounds=3, step=0.5, depth=4, least_rows=10))
    got = boosting.shapley_values(fitted, x[:25])
    for i in range(25):
        for j in range(3):
            rest = [f for f in range(3) if f != j]
            want = sum(
                math.factorial(k) * math.factorial(2 - k) / 6 * (expected(t, x[i], {*s, j}) - expected(t, x[i], set(s)))
                for t in fitted.trees for k in range(3) for s in itertools.combinations(rest, k))
            assert got[i, j] == pytest.approx(want, abs=1e-9)
    np.testing.assert_allclose(got.sum(axis=1) + boosting.mean_prediction(fitted), fitted.values(x[:25]), atol=1e-9)


def test_shapley_importance_over_all_rows(data):
    x, _, _, df = data
    fitted = model.TrainedModel("fine", boosting.fit_trees(df, COLUMNS, "y", F.lit(False), TreeSettings(rounds=2, depth=3)), (0.0, 100.0))
    got = {r["feature"]: r["shap_importance"] for r in model.shapley_importance(fitted, df).collect()}
    want = np.abs(boosting.shapley_values(fitted.model, x)).mean(axis=0)
    assert [got[c] for c in COLUMNS] == pytest.approx(want.tolist())


def test_permutation_importance_does_not_depend_on_partitions(data):
    df = data[3].withColumnRenamed("y", "target")
    fitted = model.TrainedModel("fine", boosting.fit_trees(df, COLUMNS, "target", F.lit(False), TreeSettings(rounds=2, depth=3)), (-100.0, 100.0))
    first, second = ({r["feature"]: r["rmse_growth"] for r in model.permutation_importance(fitted, d).collect()} for d in (df, df.repartition(3)))
    assert first == pytest.approx(second) and first["c0"] > first["c2"]


SPACE = {"a": (0.001, 1.0, True), "b": (0.0, 10.0, False), "k": (1, 20, False)}


def test_parzen_search_beats_random_draws():
    def value(p):
        return (math.log10(p["a"]) + 1.5) ** 2 + (p["b"] - 7) ** 2 / 10 + abs(p["k"] - 13) / 5

    guided, blind = [], []
    for seed in range(20):
        rng, history = random.Random(seed), []
        for _ in range(50):
            p = parzen.propose(SPACE, history, rng, ("k",))
            assert 0.001 <= p["a"] <= 1 and 0 <= p["b"] <= 10 and p["k"] in range(1, 21)
            history.append((p, value(p)))
        guided.append(min(v for _, v in history))
        rng = random.Random(seed)
        blind.append(min(value(parzen.propose(SPACE, [], rng, ("k",))) for _ in range(50)))
    assert np.mean(guided) < 0.6 * np.mean(blind) and sum(g < b for g, b in zip(guided, blind, strict=True)) >= 15


def test_parzen_search_is_repeatable():
    def run():
        rng, history = random.Random(4), []
        for _ in range(15):
            p = parzen.propose(SPACE, history, rng)
            history.append((p, p["b"]))
        return history

    assert run() == run()


def test_rows_go_down_a_tree_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    tree = boosting.Tree()
    tree.add(0.0, 1.0)
    for node in range(40):
        tree.feature[node], tree.bin[node], tree.threshold[node] = int(rng.integers(3)), int(rng.integers(200)), float(rng.normal())
        tree.missing_left[node] = bool(rng.integers(2))
        tree.left[node], tree.right[node] = tree.add(0.0, 1.0), tree.add(0.0, 1.0)
    bins = rng.integers(0, 256, (3, 500)).astype(np.uint8)
    x = np.where(rng.random((3, 500)) < 0.2, np.nan, rng.normal(size=(3, 500)))
    together = tree.descend(bins, bins == boosting.MISSING, True), tree.descend(x, np.isnan(x), False)
    monkeypatch.setattr(boosting, "WIDE_TREE", 0)
    alone = tree.descend(bins, bins == boosting.MISSING, True), tree.descend(x, np.isnan(x), False)
    for a, b in zip(together, alone, strict=True):
        assert a.tolist() == b.tolist() and len(set(a.tolist())) > 10


def test_a_pass_reads_one_value_a_row(spark):
    rows = spark.createDataFrame([(1.5, False, 7, 0.0, None), (-2.0, True, -8, 5.0, 1.0)], "y double, held boolean, u bigint, a double, b double")
    edges = [np.array([1.0]), np.array([0.5, 2.0])]
    packed = boosting._binned(rows.select("y", "held", "u", F.expr("coalesce(a, double('NaN'))"), F.expr("coalesce(b, double('NaN'))")), edges)
    for kind in (pa.binary(), pa.large_binary()):
        batch = pa.RecordBatch.from_arrays([pa.array([None, *[r["r"] for r in packed.collect()]], kind)[1:]], names=["r"])
        found = sorted((r["y"].item(), r["u"].item(), r["held"].item(), r["x"].tolist()) for r in boosting._records(batch, 2))
        assert found == [(-2.0, -8, 1, [1, 1]), (1.5, 7, 0, [0, boosting.MISSING])]
