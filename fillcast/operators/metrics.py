"""Error metrics, their bootstrap intervals, and paired tests of two predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.functions.columns import correlation
from fillcast.operators.ordered import exact_quantile, global_running_sums, stored

SMAPE_EPSILON = 1e-8


def _y(actual: str, predicted: str) -> tuple[Column, Column, Column]:
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return y, p, y - p


def rmse(actual: str = "actual", predicted: str = "predicted") -> Column:
    _, _, e = _y(actual, predicted)
    return F.sqrt(F.avg(e * e))


def mae(actual: str = "actual", predicted: str = "predicted") -> Column:
    return F.avg(F.abs(_y(actual, predicted)[2]))


def wape(actual: str = "actual", predicted: str = "predicted") -> Column:
    y, _, e = _y(actual, predicted)
    total, wrong = F.sum(F.abs(y)), F.sum(F.abs(e))
    return F.when(total > 0, F.lit(100.0) * wrong / F.nullif(total, F.lit(0.0))).when(wrong == 0, F.lit(0.0))


def smape(actual: str = "actual", predicted: str = "predicted", epsilon: float = SMAPE_EPSILON) -> Column:
    y, p, e = _y(actual, predicted)
    return F.lit(100.0) * F.avg(F.lit(2.0) * F.abs(e) / (F.abs(y) + F.abs(p) + epsilon))


def r2(actual: str = "actual", predicted: str = "predicted") -> Column:
    """1 - SSE / SST; a constant target gives 1 without error and 0 with, one row gives NULL."""
    y, _, e = _y(actual, predicted)
    sse, sst, n = F.sum(e * e), F.var_pop(y) * F.count(y), F.count(y)
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0)))
        .otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    )


METRICS = {"rmse": rmse, "mae": mae, "wape": wape, "smape": smape, "r2": r2}


def complete_pairs(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    ok = F.lit(True)
    for c in (actual, predicted):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.filter(ok)


def all_metrics(
    df: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """n, RMSE, MAE, WAPE, SMAPE and R2 over the complete pairs, per group if `by` is given."""
    aggregates = [F.count(F.lit(1)).alias("n"), *[f(actual, predicted).alias(n) for n, f in METRICS.items()]]
    return complete_pairs(df, actual, predicted).groupBy(*by).agg(*aggregates)


BUCKETS = 4096
MIN_REPLICATES = 10


def bootstrap_intervals(
    df: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", predicted: str = "predicted",
    settings: Settings = DEFAULTS, rounds: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Percentile intervals of RMSE and MAE from resampled buckets of rows.

    Rows are reduced to sums per bucket; each replicate draws every bucket a Poisson(1) number
    of times, from a hash of (seed, bucket, replicate). The resampling work is rounds x buckets
    whatever the number of rows; with few rows it is close to the ordinary row bootstrap. Copies
    of a pair count as separate observations: they are counted first and dealt in turn to the
    buckets from the pair's hash on, so a result depends neither on partitioning nor on lost tasks.
    """
    n = rounds or settings.bootstrap_rounds
    y, p, e = _y(actual, predicted)
    pairs = complete_pairs(df, actual, predicted).groupBy(*by, y.alias("_y"), p.alias("_p")).agg(
        F.count(F.lit(1)).alias("_copies"), F.first(e).alias("_e"))
    turn = F.explode(F.sequence(F.lit(0), F.least(F.col("_copies"), F.lit(buckets)) - 1)).alias("_turn")
    dealt = pairs.select(*by, "_y", "_p", "_e", "_copies", turn)
    each = F.floor(F.col("_copies") / buckets) + (F.col("_turn") < F.col("_copies") % buckets).cast("long")
    bucket = F.pmod(F.xxhash64(F.lit(settings.seed), "_y", "_p") + F.col("_turn"), F.lit(buckets))
    error = F.col("_e")
    sums = dealt.withColumns({"_each": each, "_bucket": bucket}).groupBy(*by, "_bucket").agg(
        F.sum("_each").alias("_n"), F.sum(F.col("_each") * error * error).alias("_sq"), F.sum(F.col("_each") * F.abs(error)).alias("_ab"))
    drawn = sums.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "_times", poisson_one(F.xxhash64(F.lit(settings.seed), "_bucket", "_round")))
    times = F.col("_times")
    weight = F.nullif(F.sum(times * F.col("_n")), F.lit(0))
    rounds_df = drawn.groupBy(*by, "_round").agg(
        F.sqrt(F.sum(times * F.col("_sq")) / weight).alias("_rmse"),
        (F.sum(times * F.col("_ab")) / weight).alias("_mae"))
    return replicate_bounds(rounds_df, by, settings)


def replicate_bounds(replicates: DataFrame, by: tuple[str, ...], settings: Settings = DEFAULTS) -> DataFrame:
    """Percentile bounds of `_rmse` and `_mae` over the replicates; NULL where there are too few."""
    tail = (1 - settings.ci_level) / 2
    bounds = []
    for m in ("rmse", "mae"):
        for side, q in (("lower", tail), ("upper", 1 - tail)):
            value = F.percentile(f"_{m}", F.lit(q))
            bounds.append(F.when(F.count(f"_{m}") >= MIN_REPLICATES, value).alias(f"{m}_ci_{side}"))
    return replicates.groupBy(*by).agg(*bounds)


def poisson_one(hashed: Column) -> Column:
    """Poisson(1) draw from a 64-bit hash, by its cumulative probabilities."""
    uniform = F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40))
    total, term, steps = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    draw = F.lit(0)
    for limit in steps:
        draw = draw + (uniform >= limit).cast("int")
    return draw


def metrics_with_intervals(
    df: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", predicted: str = "predicted",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    point = all_metrics(df, by, actual, predicted)
    interval = bootstrap_intervals(df, by, actual, predicted, settings)
    if by:
        return point.join(interval, list(by), "left")
    return point.withColumn("_one", F.lit(1)).join(interval.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


# -- paired tests --------------------------------------------------------------

# Pairs a test needs, and pairs up to which signed ranks are counted exactly.
MIN_PAIRS, EXACT_PAIRS = 10, 50


def _stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def _error_gap(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    y = F.col(actual)
    gap = F.abs(y - F.col(first)) - F.abs(y - F.col(second))
    return df.select(gap.alias("_d")).filter(F.col("_d").isNotNull() & ~F.isnan("_d"))


def wilcoxon_statistic(
    df: DataFrame, actual: str = "actual", first: str = "model", second: str = "baseline", settings: Settings = DEFAULTS
) -> DataFrame:
    """Signed-rank sums of the difference in absolute error, zero differences left out.

    Rows collapse to distinct |d| first; the average rank of a tied group comes from the
    running count, computed in range-partitioned chunks when there are many values.
    """
    d = F.col("_d")
    groups = stored(_error_gap(df, actual, first, second).groupBy(F.abs(d).alias("_abs")).agg(
        F.count(F.lit(1)).alias("_k"), F.count_if(d > 0).alias("_plus")))
    distinct, pairs = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_k"), F.lit(0))).first()
    ranked = global_running_sums(
        groups.filter(F.col("_abs") != 0), [F.col("_abs")], {"_upto": F.col("_k")}, settings.block_rows, distinct)
    k = F.col("_k").cast("double")
    rank = F.col("_upto") - (k - 1) / 2
    return ranked.agg(
        F.lit(pairs).cast("long").alias("n_pairs"),
        F.coalesce(F.sum("_k"), F.lit(0)).alias("n_nonzero"),
        F.coalesce(F.sum(rank * F.col("_plus")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(rank * (k - F.col("_plus"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(k * k * k - k), F.lit(0.0)).alias("tie_term"))


def paired_test(
    df: DataFrame, kind: str = "wilcoxon", actual: str = "actual", first: str = "model",
    second: str = "baseline", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Statistic, two-sided p-value and stars; below ten pairs there is no result.

    The t test takes the t distribution. The signed-rank test takes the exact distribution for up to
    EXACT_PAIRS pairs without ties and zero differences, and otherwise the normal approximation.
    """
    if kind == "wilcoxon":
        row = wilcoxon_statistic(df, actual, first, second, settings).first()
        pairs, n = row["n_pairs"], row["n_nonzero"]
        statistic, p = (0.0, 1.0) if n == 0 else (min(row["w_plus"], row["w_minus"]), None)
        if n and n <= EXACT_PAIRS and n == pairs and not row["tie_term"]:
            p = signed_rank_tail(statistic, n)
        elif n:
            spread = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - row["tie_term"] / 48, 0.0))
            p = normal_tail((statistic - n * (n + 1) / 4) / spread) if spread else 1.0
    elif kind == "ttest":
        row = _error_gap(df, actual, first, second).agg(
            F.count("_d").alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s")).first()
        pairs = row["n"]
        statistic = row["m"] / (row["s"] / math.sqrt(pairs)) if pairs > 1 and row["s"] else None
        p = student_tail(statistic, pairs - 1) if statistic is not None else None
    else:
        raise ValueError(f"unknown test {kind!r}")
    if pairs < MIN_PAIRS:
        statistic = p = None
    result = df.sparkSession.createDataFrame(
        [(kind, pairs, statistic, p)], "test string, n_pairs long, statistic double, p_value double")
    return result.withColumn("stars", _stars(F.col("p_value")))


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_tail(t: float, freedom: int) -> float:
    """Two-sided tail of Student's t; the normal one beyond a million degrees, where they agree."""
    if freedom > 1_000_000:
        return normal_tail(t)
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, taken from the far end."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast below this point
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tail = 1.0
    for m in range(50 + 5 * math.isqrt(int(max(a, b))), 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1.0 + even / (1.0 + odd / tail)
    tail = 1.0 - (a + b) * x / (a + 1) / tail
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / a / tail


def signed_rank_tail(statistic: float, n: int) -> float:
    """Two-sided exact tail of the signed-rank sum: every set of ranks from 1 to n is equally likely."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2.0 * sum(ways[: int(statistic) + 1]) / 2.0 ** n)


# -- threshold decisions -------------------------------------------------------

# Decision thresholds and shares.
FILL_DECISIONS = (70.0, 80.0, 85.0, 90.0)
DAY_DECISIONS = (1.0, 2.0, 3.0, 5.0)
TOP_SHARES = (5, 10, 15, 20, 25, 30)
MAIN_THRESHOLD = 85.0
CAPACITY_SHARE = 20


def threshold_decisions(
    df: DataFrame, thresholds: tuple[float, ...] = FILL_DECISIONS, below: bool = False,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """Confusion counts, precision, recall and F1 of "urgent" at every threshold, in one pass.

    Urgent means at or above the threshold, or (`below`) at or below it for days.
    """
    y, p = F.col(actual), F.col(predicted)
    cells, structs = [], []
    for i, t in enumerate(thresholds):
        real, called = (y <= t, p <= t) if below else (y >= t, p >= t)
        parts = {"tp": real & called, "fp": ~real & called, "fn": real & ~called, "tn": ~real & ~called}
        cells += [F.count_if(c).alias(f"{k}_{i}") for k, c in parts.items()]
        structs.append(F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}_{i}").alias(k) for k in parts]))
    counts = complete_pairs(df, actual, predicted).agg(*cells).select(F.inline(F.array(*structs)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    rated = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    pr, re = F.col("precision"), F.col("recall")
    return rated.withColumns({
        "f1": F.coalesce(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), F.lit(0.0)),
        "n_urgent": tp + fn,
        "share_urgent_pct": ratio(F.lit(100.0) * (tp + fn), tp + fp + fn + tn),
    })


def _ranked_urgent(
    df: DataFrame, by: str, tie: tuple[str, ...], threshold: float, actual: str, settings: Settings
) -> tuple[DataFrame, int]:
    """Urgent rows with their rank by falling `by` among all rows, and the number of all rows."""
    keyed = stored(df.select((-F.col(by)).alias("_by"), *tie, (F.col(actual) >= threshold).alias("_urgent")))
    n = keyed.count()
    ranked = global_running_sums(
        keyed, [F.col("_by"), *[F.col(t) for t in tie]], {"_rank": F.lit(1).cast("long")}, settings.block_rows, n)
    return ranked.filter("_urgent"), n


def top_share_hits(
    df: DataFrame, tie: tuple[str, ...] = ("container_id", "measured_at_utc"), shares: tuple[int, ...] = TOP_SHARES,
    threshold: float = MAIN_THRESHOLD, actual: str = "actual", predicted: str = "predicted", settings: Settings = DEFAULTS,
) -> DataFrame:
    """How many urgent rows are among the top k % by prediction. Ties go by the `tie` columns."""
    urgent, n = _ranked_urgent(df, predicted, tie, threshold, actual, settings)
    sizes = [n * s // 100 for s in shares]
    counts = urgent.agg(
        F.count(F.lit(1)).alias("n_urgent"),
        *[F.count_if(F.col("_rank") <= k).alias(f"h_{i}") for i, k in enumerate(sizes)])
    rows = F.array(*[
        F.struct(F.lit(s).alias("top_pct"), F.lit(k).cast("long").alias("k_rows"), F.col(f"h_{i}").alias("hits"))
        for i, (s, k) in enumerate(zip(shares, sizes))])
    out = counts.select("n_urgent", F.inline(rows))
    return out.withColumn("hit_rate", F.coalesce(F.col("hits") / F.nullif(F.col("n_urgent"), F.lit(0)), F.lit(0.0)))


def capacity_lift(
    df: DataFrame, tie: tuple[str, ...] = ("container_id", "measured_at_utc"), share: int = CAPACITY_SHARE,
    threshold: float = MAIN_THRESHOLD, actual: str = "actual", predicted: str = "predicted", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Urgent rows caught when only `share` % can be served: by the model, by chance, at best.

    The best order serves urgent rows first, so it catches min(capacity, urgent rows).
    """
    urgent, n = _ranked_urgent(df, predicted, tie, threshold, actual, settings)
    k = n * share // 100
    caught = urgent.agg(
        F.count(F.lit(1)).alias("n_urgent"), F.count_if(F.col("_rank") <= k).alias("model_catches"))
    u = F.col("n_urgent")
    chance = u * share / F.lit(100.0)
    return caught.select(
        F.lit(share).alias("capacity_pct"), F.lit(k).cast("long").alias("capacity_n"), "model_catches",
        F.coalesce(F.col("model_catches") / F.nullif(u, F.lit(0)), F.lit(0.0)).alias("model_recall"),
        chance.alias("random_expected"),
        F.least(u, F.lit(k)).alias("perfect_catches"),
        F.coalesce(F.col("model_catches") / F.nullif(chance, F.lit(0.0)), F.lit(0.0)).alias("lift_vs_random"),
        F.lit(n).cast("long").alias("n_total"), u)


# -- per-group errors ----------------------------------------------------------

MIN_GROUP_ROWS = 5


def container_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Error statistics of every container with at least five predictions."""
    y, p, e = _y(actual, predicted)
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy("container_id").agg(
        rmse(actual, predicted).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.count(F.lit(1)).alias("n_samples"),
        F.mode("trash_type", True).alias("trash_type"),
        F.avg(y).alias("mean_actual"),
        F.stddev_pop(y).alias("std_actual"),
        F.avg(p - y).alias("mean_error"),
    ).filter(F.col("n_samples") >= MIN_GROUP_ROWS)


def container_reasons() -> Column:
    """Why a container is predicted badly, from its error statistics."""
    reasons = F.array_compact(F.array(
        F.when(F.col("std_actual") < 5, "low_variability"),
        F.when(F.abs("mean_error") > 5, "bias"),
        F.when(F.col("n_samples") < 20, "few_samples")))
    return F.when(F.size(reasons) == 0, F.array(F.lit("noise"))).otherwise(reasons)


def extreme_containers(stats: DataFrame, n_best: int = 3, n_worst: int = 3) -> DataFrame:
    """The best and worst containers by RMSE (more samples first among equals), with reasons."""
    best = stats.orderBy("rmse", F.desc("n_samples"), "container_id").limit(n_best).withColumn("side", F.lit("best"))
    worst = stats.orderBy(F.desc("rmse"), "n_samples", F.desc("container_id")).limit(n_worst).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).withColumn("reasons", F.array_join(container_reasons(), ","))


def container_error_summary(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    median = exact_quantile(stats, "rmse", 0.5, "median_rmse", settings.block_rows).first()[0]
    return stats.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.lit(median).cast("double").alias("median_rmse"), F.avg("rmse").alias("mean_rmse"))


def errors_by_type(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy("trash_type").agg(rmse(actual, predicted).alias("rmse"), F.count(F.lit(1)).alias("n"))


# -- distributions -------------------------------------------------------------

def histogram(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal-width bins; the upper edge belongs to the last bin."""
    place = F.floor((value - low) / F.lit((high - low) / bins))
    return F.least(place, F.lit(bins - 1))


def fill_histogram(df: DataFrame, bins: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    fill = F.col("percent_calculated")
    return df.filter(fill.isNotNull()).groupBy(*by, histogram(fill, 0, 100, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def daily_trend(df: DataFrame, days: int = 30) -> DataFrame:
    """Mean fill per date and its centred rolling mean, NULL where the window is not full.

    The window runs over one row per date.
    """
    daily = df.groupBy(F.to_date("measured_at_utc").alias("date")).agg(F.avg("percent_calculated").alias("mean_fill"))
    frame = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(days // 2), days - days // 2 - 1)
    full = F.count("mean_fill").over(frame) == days
    return daily.withColumn("rolling_mean", F.when(full, F.avg("mean_fill").over(frame)))


def hour_weekday_means(df: DataFrame) -> DataFrame:
    """Mean fill by hour, one column per weekday (Monday = dow_0)."""
    cells = df.select(
        F.hour("measured_at_utc").alias("hour"), F.weekday("measured_at_utc").alias("dow"), "percent_calculated")
    wide = cells.groupBy("hour").pivot("dow", list(range(7))).agg(F.avg("percent_calculated"))
    return wide.select("hour", *[F.col(str(d)).alias(f"dow_{d}") for d in range(7)])


def residual_histogram(df: DataFrame, bins: int = 80, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Histogram of actual - predicted between the extreme residuals, with the mean residual."""
    e = _y(actual, predicted)[2]
    ends = df.agg(F.min(e), F.max(e), F.avg(e)).first()
    low, high, mean = ends
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"),
                         F.lit(0.0).alias("mean_residual")).limit(0)
    if high == low:
        low, high = low - 0.5, high + 0.5
    return df.filter(e.isNotNull()).groupBy(histogram(e, low, high, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("mean_residual", F.lit(mean))


def scatter_sample(
    df: DataFrame, rows: int = 20_000, uniform: Column | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """A repeatable sample of about `rows` rows (all rows when there are fewer).

    `uniform` is a number in [0, 1) made from each row; a hash of the row by default.
    """
    share = F.lit(rows) / F.lit(max(df.count(), 1))
    if uniform is None:
        uniform = F.pmod(F.xxhash64(F.lit(settings.seed), *df.columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.filter(uniform < share)


def trial_progress(trials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best value so far after each trial."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_value", F.min("value").over(window))


def parameter_sensitivity(trials: DataFrame, parameters: list[str]) -> DataFrame:
    """|correlation| of each numeric parameter with the trial value."""
    row = trials.agg(*[F.abs(correlation(F.col(p), F.col("value"))).alias(p) for p in parameters])
    pairs = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("abs_corr")) for p in parameters])
    return row.select(F.inline(pairs)).filter(F.col("abs_corr").isNotNull())


def fill_summary(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Count, mean and exact median of the fill level."""
    median = exact_quantile(df, "percent_calculated", 0.5, "median_fill", settings.block_rows).first()[0]
    return df.agg(
        F.count("percent_calculated").alias("n"), F.avg("percent_calculated").alias("mean_fill"),
        F.lit(median).cast("double").alias("median_fill"))
