"""The row bootstrap against NumPy, on any partitioning, with copies, groups and missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillcast.operators import resampling

SCHEMA = "g string, actual double, predicted double"


def rows(spark, errors, group="a"):
    return spark.createDataFrame(pd.DataFrame({"g": group, "actual": errors, "predicted": 0.0}), SCHEMA)


def numpy_bounds(errors, rounds=1000):
    rng = np.random.default_rng(9)
    picked = [errors[rng.integers(0, len(errors), len(errors))] for _ in range(rounds)]
    stats = {"rmse": [np.sqrt(np.mean(p * p)) for p in picked], "mae": [np.abs(p).mean() for p in picked]}
    return {f"{m}_ci_{side}": np.quantile(v, q) for m, v in stats.items() for side, q in (("lower", 0.025), ("upper", 0.975))}


def test_intervals_equal_numpys(spark):
    errors = np.random.default_rng(1).normal(0, 10, 10_000)
    got = resampling.row_bootstrap(rows(spark, errors), bucket_values=1000).first().asDict()
    for name, want in numpy_bounds(errors).items():
        assert got[name] == pytest.approx(want, rel=0.01)


def test_few_rows_and_many_copies(spark):
    """A third of all rows are one value; small buckets, so that the tree is deep."""
    errors = np.concatenate([np.full(100, 7.0), np.random.default_rng(2).gamma(2, 3, 200)])
    got = resampling.row_bootstrap(rows(spark, errors), bucket_values=4).first().asDict()
    for name, want in numpy_bounds(errors, 4000).items():
        assert got[name] == pytest.approx(want, rel=0.03)


def test_draws_have_the_mean_and_variance_of_a_bootstrap(spark):
    """Of rows of error 1 among rows of error 0, n MAE is binomial: read back from its quantiles."""
    errors = np.concatenate([np.ones(300), np.linspace(-1e-9, 1e-9, 701)])
    df = rows(spark, errors)
    got = resampling.row_bootstrap(df, rounds=4000, bucket_values=16).first()
    p, n = 300 / 1001, 1001
    spread = (got["mae_ci_upper"] - got["mae_ci_lower"]) / (2 * 1.96)
    assert (got["mae_ci_upper"] + got["mae_ci_lower"]) / 2 == pytest.approx(p, rel=0.01)
    assert spread == pytest.approx(np.sqrt(p * (1 - p) / n), rel=0.06)


def test_partitions_and_order_do_not_matter(spark):
    df = rows(spark, np.random.default_rng(3).normal(size=500))
    a, b = (resampling.row_bootstrap(d, rounds=40, bucket_values=20).first() for d in (df.repartition(1), df.orderBy(F.rand(1)).repartition(7)))
    assert all(a[c] == pytest.approx(b[c], rel=1e-12) for c in a.asDict())


def test_groups_missing_values_and_empty_tables(spark):
    one = np.random.default_rng(4).normal(0, 1, 300)
    df = rows(spark, one).unionAll(rows(spark, one * 50)
                                   .withColumn("g", F.lit(None).cast("string"))).unionAll(
        spark.createDataFrame([("c", None, 1.0), ("c", float("nan"), 1.0), ("d", 5.0, 2.0)], SCHEMA))
    got = {r["g"]: r for r in resampling.row_bootstrap(df, by=("g",), rounds=200, bucket_values=50).collect()}
    assert set(got) == {"a", None, "d"}
    assert got["d"]["mae_ci_lower"] == got["d"]["rmse_ci_upper"] == 3.0
    assert got[None]["mae_ci_lower"] > 10 * got["a"]["mae_ci_upper"]
    assert resampling.row_bootstrap(df, by=("g",), rounds=5).first()["mae_ci_lower"] is None
    assert resampling.row_bootstrap(df.limit(0), by=("g",)).count() == 0
    assert resampling.row_bootstrap(df.limit(0)).first()["mae_ci_lower"] is None
