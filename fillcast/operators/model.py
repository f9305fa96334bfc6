"""Gradient-boosted trees on a feature table: training, prediction, search, importance."""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import clip
from fillcast.operators.boosting import BoostedTrees, TreeSettings, fit_trees, matrix, number_array, shapley_values
from fillcast.operators.encode import CategoryEncoder, feature_columns
from fillcast.operators.metrics import complete_pairs, rmse
from fillcast.operators.ordered import LongSeries, global_positions, local_table, stored
from fillcast.operators.parzen import propose
from fillcast.operators.side_by_side import side_by_side
from fillcast.operators.split import each_fold, holdout_folds

# Rounds, step size, leaves, depth (0: no limit), leaf size, L2 and sampling of the three presets. The first two
# grow best leaf first, the third level by level.
PRESETS: dict[str, dict] = {
    "balanced": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 0, "maxLeaves": 31, "minInstancesPerNode": 20, "l2": 0.1},
    "sampled": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 8, "maxLeaves": 31, "minInstancesPerNode": 20, "l2": 1.0,
                "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "fine": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 5, "l2": 1.0,
             "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
}
# The first preset stops on a tenth of its own training rows when no validation rows are given.
SELF_VALIDATING = ("balanced",)
SELF_VALIDATION_PERCENT = 10
#: Rounds without a better validation score after which a fit ends (fixed value).
PATIENCE = 20


def preset(name: str, **changes) -> dict:
    return PRESETS[name] | changes


def tree_settings(params: dict) -> TreeSettings:
    return TreeSettings(
        rounds=int(params["maxIter"]), step=float(params.get("stepSize", 0.05)), depth=int(params.get("maxDepth", 8)),
        leaves=int(params.get("maxLeaves", 0)), least_rows=int(params.get("minInstancesPerNode", 20)), l2=float(params.get("l2", 1.0)),
        row_share=float(params.get("subsamplingRate", 1.0)), column_share=float(params.get("featureSubsetStrategy", 1.0)), patience=PATIENCE)


def _number(column: str) -> str:
    """SQL text of a column as double with NaN as NULL. Text, because a feature table has
    hundreds of columns and one parsed expression each is cheaper than chains of calls."""
    quoted = column.replace("`", "``")
    return f"nanvl(CAST(`{quoted}` AS DOUBLE), CAST(NULL AS DOUBLE))"


@dataclass(frozen=True)
class FeatureMatrix:
    """Median fill-in and missing flags, fitted on training rows, for learners that reject NULL. The trees here do not."""

    columns: tuple[str, ...]
    medians: dict[str, float]
    flagged: tuple[str, ...]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> "FeatureMatrix":
        """One aggregate over the training rows: approximate medians and NULL counts."""
        medians = F.expr(f"array({', '.join(f'percentile_approx({_number(c)}, 0.5, 1000)' for c in columns)})")
        nulls = F.expr(f"array({', '.join(f'count_if({_number(c)} IS NULL)' for c in columns)})")
        found, missing = train.agg(medians.alias("m"), nulls.alias("k")).first()
        filled = {c: m if m is not None else 0.0 for c, m in zip(columns, found)}
        flagged = tuple(c for c, k in zip(columns, missing) if k and not c.endswith("_missing"))
        return FeatureMatrix(tuple(columns), filled, flagged)

    @property
    def names(self) -> list[str]:
        return [*self.columns, *[f"{c}_was_missing" for c in self.flagged]]

    def values(self) -> Column:
        """All feature values of a row as one array."""
        filled = [f"coalesce({_number(c)}, CAST({self.medians[c]!r} AS DOUBLE))" for c in self.columns]
        flags = [f"CAST({_number(c)} IS NULL AS DOUBLE)" for c in self.flagged]
        return F.expr(f"array({', '.join(filled + flags)})")

    def transform(self, df: DataFrame, array: str = "_x", vector: str = "features") -> DataFrame:
        return df.withColumn(array, self.values()).withColumn(vector, array_to_vector(F.col(array)))


@dataclass(frozen=True)
class TrainedModel:
    name: str
    model: BoostedTrees
    limits: tuple[float, float]
    info: dict = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.model.columns

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        return df.withColumn(output, clip(self.model.score(number_array(self.columns)), *self.limits))

    def gains(self) -> list[tuple[str, float]]:
        """Gain-based importance per feature."""
        return sorted(self.model.gains().items(), key=lambda p: (-p[1], p[0]))


def _row_keys(df: DataFrame) -> list[str]:
    return [c for c in ("container_id", "measured_at_utc") if c in df.columns]


def train_model(
    name: str, train: DataFrame, columns: list[str], validation: DataFrame | None = None,
    params: dict | None = None, limits: tuple[float, float] = (0.0, 100.0), target: str = "target",
    settings: Settings = DEFAULTS, seed: int | None = None,
) -> TrainedModel:
    """Fit one preset; validation rows (or, for a self-validating preset, always a hashed tenth of the
    training rows, so it never stops on the rows it is scored on) end the fit. Missing values are learned, not filled in."""
    chosen = dict(PRESETS[name] if params is None else params)
    if name in SELF_VALIDATING:
        validation = None
    keys = _row_keys(train)

    def part(df: DataFrame, held: Column) -> DataFrame:
        return df.select(*dict.fromkeys([*keys, target, *columns])).withColumn("_val", held)

    held = F.lit(False)
    if name in SELF_VALIDATING:
        held = F.pmod(F.xxhash64(F.lit(settings.seed), *(keys or [target])), F.lit(100)) < SELF_VALIDATION_PERCENT
    rows = part(train, held)
    if validation is not None:
        rows = rows.unionByName(part(validation, F.lit(True)))
    started = time.monotonic()
    fitted = fit_trees(
        rows, list(columns), target, F.col("_val"), tree_settings(chosen), settings.seed if seed is None else seed,
        watch=validation is not None or name in SELF_VALIDATING, keys=keys or None)
    info = {"train_time": time.monotonic() - started, "n_iter": len(fitted.trees), "params": chosen}
    return TrainedModel(name, fitted, limits, info)


def model_features(train: DataFrame, encoder: CategoryEncoder) -> list[str]:
    """Numeric columns of the encoded training table plus the encoder's outputs."""
    found = feature_columns(train)
    return found + [n for n in encoder.feature_names if n not in found and n in train.columns]


# -- hyper-parameter search -----------------------------------------------------

# Search range of each parameter; True marks a log-uniform one.
SEARCH_SPACE: dict[str, tuple[float, float, bool]] = {
    "stepSize": (0.01, 0.3, True),
    "maxIter": (100, 500, False),
    "maxDepth": (3, 12, False),
    "minInstancesPerNode": (5, 50, False),
    "subsamplingRate": (0.5, 1.0, False),
    "featureSubsetStrategy": (0.5, 1.0, False),
}
SEARCHED = {
    "balanced": ("stepSize", "maxIter", "maxDepth", "minInstancesPerNode"),
    "sampled": tuple(SEARCH_SPACE),
    "fine": tuple(SEARCH_SPACE),
}
WHOLE = ("maxIter", "maxDepth", "minInstancesPerNode")


def draw_params(name: str, rng: random.Random, space: dict = SEARCH_SPACE, history: list[tuple[dict, float]] = ()) -> dict:
    """Parameters for the next trial: random ones first, then by Parzen densities of the trials so far."""
    found = propose({p: space[p] for p in SEARCHED[name]}, history, rng, whole=WHOLE)
    return found | {p: f"{found[p]:.4f}" for p in ("featureSubsetStrategy",) if p in found}


def search(
    name: str, train: DataFrame, columns: list[str], settings: Settings = DEFAULTS,
    trials: int | None = None, seconds: int | None = None, space: dict = SEARCH_SPACE,
    limits: tuple[float, float] = (0.0, 100.0), long: LongSeries | None = None,
) -> tuple[dict, DataFrame]:
    """Seeded Parzen search: least mean RMSE over container folds. Returns (best, trial table).

    Parameters that the space doesn't name are the preset's.
    """
    rng = random.Random(settings.seed)
    folds = holdout_folds(train, settings.tuning_folds, settings.seed, cutoff=False, long=long, settings=settings).cache()
    limit = settings.tuning_seconds if seconds is None else seconds
    deadline = None if limit is None else time.monotonic() + limit
    rows: list[tuple] = []
    history: list[tuple[dict, float]] = []
    spark = train.sparkSession

    def fold_error(params: dict, inner: DataFrame, validation: DataFrame) -> float | None:
        model = train_model(name, inner, columns, validation, params, limits, settings=settings)
        scored = model.predict(validation).withColumn("actual", F.col("target"))
        return complete_pairs(scored).agg(rmse()).first()[0]

    try:
        for number in range(settings.trials if trials is None else trials):
            if rows and deadline is not None and time.monotonic() > deadline:
                break
            params = PRESETS[name] | draw_params(name, rng, space, history)
            scores = side_by_side(
                spark, [lambda f=f: fold_error(params, *f[1:]) for f in each_fold(folds)], settings.fits_at_once)
            known = [s for s in scores if s is not None]
            rows.append((name, number, sum(known) / len(known) if known else None, {k: str(v) for k, v in params.items()}))
            if known:
                history.append(({k: float(params[k]) for k in SEARCHED[name]}, rows[-1][2]))
    finally:
        folds.unpersist()
    table = local_table(spark, rows, "model string, number int, value double, params map<string,string>")
    ranked = [r for r in rows if r[2] is not None]
    best = min(ranked, key=lambda r: (r[2], r[1]))[3] if ranked else {}
    typed = {k: v if k == "featureSubsetStrategy" else int(v) if k in (*WHOLE, "maxLeaves") else float(v) for k, v in best.items()}
    return typed, table


def best_trials(trials: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The parameters of the best trial per group; the earlier trial wins a tie."""
    order = F.struct(F.col("value"), F.col("number"))
    return trials.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        F.min("value").alias("value"), F.min_by("number", order).alias("number"), F.min_by("params", order).alias("params"))


def pick_winner(comparison: DataFrame, metric: str = "rmse") -> DataFrame:
    return comparison.filter(F.col(metric).isNotNull()).agg(
        F.min_by("model", F.struct(metric, "model")).alias("model"), F.min(metric).alias(metric))


# -- importance -----------------------------------------------------------------

def _sample(df: DataFrame, rows: int | None, settings: Settings, salt: int) -> DataFrame:
    """All rows, or at most `rows`, numbered from 1 in hash order."""
    ids = [c for c in ("container_id", "measured_at_utc", "target") if c in df.columns]
    n = 0 if rows is None else df.count()
    if rows is not None and n > 4 * rows:  # thin out before ordering
        share = 2.0 * rows / n
        keep = F.pmod(F.xxhash64(F.lit(salt + 1), *ids), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share
        df = df.filter(keep)
    order = df.withColumn("_h", F.xxhash64(F.lit(salt), *ids))
    ranked = global_positions(order, [F.col("_h"), *[F.col(c) for c in ids]], "_i", settings.block_rows)
    return (ranked if rows is None else ranked.filter(F.col("_i") <= rows)).drop("_h")


def shapley_importance(model: TrainedModel, test: DataFrame, settings: Settings = DEFAULTS, rows: int | None = None) -> DataFrame:
    """Mean absolute exact Shapley contribution per feature over the rows of `test`, or over `rows` of them.

    The model is broadcast with the task; each task adds up its rows, so nothing but a row a feature is shuffled.
    """
    limit = settings.importance_rows if rows is None else rows
    data = test if limit is None else _sample(test, limit, settings, 1)
    own = model.model

    def run(batches):
        total, n = np.zeros(len(own.columns)), 0
        for batch in batches:
            x = matrix(batch.column(0), len(own.columns))
            total += np.abs(shapley_values(own, x)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.columns), pa.array(total), pa.array([n] * len(total), pa.int64())], names=["feature", "total", "n"])

    sums = data.select(number_array(own.columns).alias("x")).mapInArrow(run, "feature string, total double, n bigint")
    return sums.groupBy("feature").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("shap_importance"))


BUCKET_ROWS = 10_000


def permutation_importance(model: TrainedModel, data: DataFrame, fold: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """Growth of RMSE when one feature's values are exchanged between rows.

    Rows swap within buckets of about 10,000 rows: two orders of a bucket, by different hashes of the row, are
    matched by row number, so there is no global sort and the result doesn't depend on partitions. All features
    are scored in one pass over the rows.
    """
    names = model.columns
    buckets = max(1, data.count() // BUCKET_ROWS)
    keys = [F.col(c) for c in _row_keys(data)]

    def hashed(salt: int) -> Column:
        return F.xxhash64(F.lit(settings.seed + salt), *keys, "actual", "_x")

    rows = stored(
        data.withColumn("actual", F.col("target").cast("double")).withColumn("_x", number_array(names))
        .select("actual", "_x", F.pmod(hashed(0), F.lit(buckets)).alias("_bucket"), hashed(1).alias("_a"), hashed(2).alias("_b")))

    def ordered(by: str) -> Window:
        return Window.partitionBy("_bucket").orderBy(by)

    numbered = rows.withColumn("_n", F.row_number().over(ordered("_a")))
    donors = rows.select("_bucket", F.row_number().over(ordered("_b")).alias("_n"), F.col("_x").alias("_y"))
    both = numbered.join(donors, ["_bucket", "_n"])
    own, limits = model.model, model.limits

    def run(batches):
        sums = np.zeros((2, len(names) + 1))
        for batch in batches:
            known = batch.column("actual").is_valid().to_numpy(zero_copy_only=False)
            actual = batch.column("actual").to_numpy(zero_copy_only=False)[known]
            x, y = (matrix(batch.column(c), len(names))[known] for c in ("_x", "_y"))
            for j in range(-1, len(names)):
                mixed = x if j < 0 else x.copy()
                if j >= 0:
                    mixed[:, j] = y[:, j]
                error = actual - np.clip(own.values(mixed), *limits)
                sums[:, j + 1] += (error ** 2).sum(), len(error)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(names)), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["_feature", "_sq", "_n"])

    # Each task mixes and scores its rows and sends a row a feature.
    errors = both.select("actual", "_x", "_y").mapInArrow(run, "_feature int, _sq double, _n double").groupBy("_feature").agg(
        F.sqrt(F.sum("_sq") / F.nullif(F.sum("_n"), F.lit(0.0))).alias("_rmse"))
    labels = F.array(*[F.lit(c) for c in names])
    errors = errors.cache()  # one row per feature
    base_value = errors.filter("_feature = -1").first()["_rmse"]
    return errors.filter("_feature >= 0").select(
        F.get(labels, F.col("_feature")).alias("feature"), F.lit(fold).alias("fold"),
        (F.col("_rmse") - F.lit(base_value)).alias("rmse_growth"))


def importance_over_folds(
    name: str, folds: DataFrame, columns: list[str], params: dict | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Permutation importance of a model trained on each fold, measured on its validation rows."""
    def of_fold(fold: int, train: DataFrame, validation: DataFrame) -> DataFrame:
        model = train_model(name, train, columns, validation, params, settings=settings)
        return permutation_importance(model, validation, fold, settings)

    parts = side_by_side(folds.sparkSession, [lambda f=f: of_fold(*f) for f in each_fold(folds)], settings.fits_at_once)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return summarize_importance(out)


def summarize_importance(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("feature").agg(
        F.avg("rmse_growth").alias("importance_mean"), F.stddev_samp("rmse_growth").alias("importance_std_across_folds"))
