"""Queries on metrics, tests, screens, decisions, distributions, baselines and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import (
    clean, day_predictions, event_features, grid_rows, long_series, predictions, time_features, time_rows)
from fillcast.catalog.registry import part, query
from fillcast.catalog.splits import held_out
from fillcast.functions.columns import micros
from fillcast.operators import baselines, forecasting, metrics, resampling, screening, survival

KEYS = "container_id:i measured_at_utc:u"
SCORES = "n:i rmse:f mae:f wape:f smape:f r2:f"
PAIR_SCORES = """count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 100 * sum(abs(e)) / nullif(sum(abs(actual)), 0) AS wape,
       100 * avg(2 * abs(e) / (abs(actual) + abs(predicted) + 1e-8)) AS smape, 1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0) AS r2"""


def _single(name: str, column: str, sql: str):
    @query(name, f"trash_type:s {column}:f", f"SELECT trash_type, {sql} AS {column} FROM pairs GROUP BY 1", ("pairs",))
    def build(spark, sf) -> DataFrame:
        rows = metrics.complete_pairs(predictions(spark, sf))
        return rows.groupBy("trash_type").agg(metrics.METRICS[column]().alias(column))

    return build


_single("m01_rmse", "rmse", "sqrt(avg(e * e))")
_single("m02_mae", "mae", "avg(abs(e))")
_single("m03_wape", "wape", "100 * sum(abs(e)) / nullif(sum(abs(actual)), 0)")
_single("m04_smape", "smape", "100 * avg(2 * abs(e) / (abs(actual) + abs(predicted) + 1e-8))")


@query("m05_all_metrics", SCORES, f"SELECT {PAIR_SCORES} FROM pairs", ("pairs",))
def all_metrics(spark, sf) -> DataFrame:
    return metrics.all_metrics(predictions(spark, sf))


@query("m05b_metrics_per_container", "container_id:i " + SCORES, f"SELECT container_id, {PAIR_SCORES} FROM pairs GROUP BY 1 HAVING count(*) > 1", ("pairs",))
def metrics_per_container(spark, sf) -> DataFrame:
    return metrics.all_metrics(predictions(spark, sf), by=("container_id",)).filter("n > 1")


@query("m06_bootstrap_intervals", "rmse_ci_lower:f rmse_ci_upper:f mae_ci_lower:f mae_ci_upper:f")
def bootstrap_intervals(spark, sf) -> DataFrame:
    return metrics.bootstrap_intervals(predictions(spark, sf))


@query("m06c_row_bootstrap", "rmse_ci_lower:f rmse_ci_upper:f mae_ci_lower:f mae_ci_upper:f")
def row_bootstrap(spark, sf) -> DataFrame:
    return resampling.row_bootstrap(predictions(spark, sf))


@query("m06b_interval_contains_estimate", "rmse_inside:i mae_inside:i", "SELECT 1 AS rmse_inside, 1 AS mae_inside FROM pairs LIMIT 1", ("pairs",))
def interval_contains_estimate(spark, sf) -> DataFrame:
    both = metrics.metrics_with_intervals(predictions(spark, sf))
    return both.select(*[F.col(m).between(F.col(f"{m}_ci_lower"), F.col(f"{m}_ci_upper")).cast("int").alias(f"{m}_inside") for m in ("rmse", "mae")])


part("gaps", """
SELECT abs(d) AS a, d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk
FROM (SELECT abs(actual - predicted) - abs(actual - baseline) AS d FROM pairs) WHERE d <> 0""", "pairs")


@query("m07_wilcoxon_statistic", "n_pairs:i n_nonzero:i w_plus:f w_minus:f", """
SELECT (SELECT count(*) FROM pairs) AS n_pairs, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus,
       sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM gaps""", ("gaps",))
def wilcoxon_statistic(spark, sf) -> DataFrame:
    return metrics.wilcoxon_statistic(predictions(spark, sf), first="predicted", second="baseline")


@query("m07b_paired_t", "n_pairs:i statistic:f", """
SELECT count(*) AS n_pairs, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS statistic
FROM (SELECT abs(actual - predicted) - abs(actual - baseline) AS d FROM pairs)""", ("pairs",))
def paired_t(spark, sf) -> DataFrame:
    return metrics.paired_test(predictions(spark, sf), "ttest", first="predicted", second="baseline")


# Tails by Simpson's rule over the densities.
_TESTS = """
WITH signed AS (SELECT count(*) AS k, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM gaps),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM gaps GROUP BY a)),
given AS (
  SELECT 'wilcoxon' AS test, (SELECT count(*) FROM pairs) AS n_pairs, w AS statistic, abs(w - k * (k + 1) / 4.0) / sqrt(k * (k + 1.0) * (2 * k + 1) / 24 - tie / 48) AS x FROM signed, ties
  UNION ALL SELECT 'ttest', count(*), avg(d) / (stddev_samp(d) / sqrt(count(*))), abs(avg(d) / (stddev_samp(d) / sqrt(count(*))))
  FROM (SELECT abs(actual - predicted) - abs(actual - baseline) AS d FROM pairs)),
steps AS (SELECT *, x * i / 4000 AS u, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM given, (SELECT unnest(range(4001)) AS i)),
tails AS (
  SELECT test, n_pairs, statistic, greatest(0, 1 - 2 * any_value(x) / 12000 * sum(weight * CASE WHEN test = 'wilcoxon' THEN exp(-u * u / 2) / sqrt(2 * pi())
    ELSE exp(lgamma(n_pairs / 2.0) - lgamma((n_pairs - 1) / 2.0) - n_pairs / 2.0 * ln(1 + u * u / (n_pairs - 1))) / sqrt(pi() * (n_pairs - 1)) END)) AS p_value
  FROM steps GROUP BY 1, 2, 3)
SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM tails"""


@query("m07c_paired_tests", "test:s n_pairs:i statistic:f p_value:f stars:s", _TESTS, ("gaps",))
def paired_tests(spark, sf) -> DataFrame:
    rows = predictions(spark, sf)
    return metrics.paired_test(rows, "wilcoxon", first="predicted", second="baseline").unionByName(
        metrics.paired_test(rows, "ttest", first="predicted", second="baseline"))


_SCREENED = ("current_fill", "fill_lag_1", "fill_lag_2", "fill_lag_24h", "fill_lag_48", "fill_diff_1", "fill_roll_mean_6", "container_fill_mean", "hour", "is_weekend")
_W = "OVER (PARTITION BY container_id ORDER BY measured_at_utc"
part("screened", f"""
SELECT *, percent_calculated AS current_fill, lag(percent_calculated, 1) {_W}) AS fill_lag_1, lag(percent_calculated, 2) {_W}) AS fill_lag_2,
       lag(percent_calculated, 4) {_W}) AS fill_lag_24h, lag(percent_calculated, 48) {_W}) AS fill_lag_48,
       percent_calculated - lag(percent_calculated) {_W}) AS fill_diff_1,
       avg(percent_calculated) {_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS fill_roll_mean_6,
       avg(percent_calculated) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS container_fill_mean FROM timed""", "timed")


@query("m08_pair_correlations", "feature_a:s feature_b:s abs_corr:f", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS abs_corr FROM screened"
    for i, a in enumerate(_SCREENED) for b in _SCREENED[i + 1:]), ("screened",))
def pair_correlations(spark, sf) -> DataFrame:
    return screening.pair_correlations(time_features(spark, sf), list(_SCREENED))


@query("m08b_correlated_pairs", "feature_a:s feature_b:s abs_corr:f", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS abs_corr FROM screened"
    for i, a in enumerate(_SCREENED) for b in _SCREENED[i + 1:]) + ") WHERE abs_corr > 0.3", ("screened",))
def correlated_pairs(spark, sf) -> DataFrame:
    return screening.correlated_pairs(time_features(spark, sf), list(_SCREENED), 0.3)


_STATS = """
SELECT container_id, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0) AS r2, count(*) AS n_samples,
       arg_min(trash_type, -k) AS trash_type, avg(actual) AS mean_actual, stddev_pop(actual) AS std_actual, avg(-e) AS mean_error
FROM (SELECT p.*, m.k FROM pairs p JOIN (SELECT container_id, trash_type, count(*) AS k FROM pairs GROUP BY 1, 2) m
        ON m.container_id = p.container_id AND m.trash_type = p.trash_type)
GROUP BY 1 HAVING count(*) >= 5"""
part("stats", _STATS, "pairs")


def _container_stats(spark, sf) -> DataFrame:
    return metrics.container_errors(metrics.complete_pairs(predictions(spark, sf)))


@query("m09_container_errors", "container_id:i rmse:f r2:f n_samples:i trash_type:s mean_actual:f std_actual:f mean_error:f", "SELECT * FROM stats", ("stats",))
def container_errors(spark, sf) -> DataFrame:
    return _container_stats(spark, sf)


@query("m09b_extreme_containers", "side:s container_id:i rmse:f reasons:s", """
SELECT side, container_id, rmse, CASE WHEN r = '' THEN 'noise' ELSE r END AS reasons FROM (
  SELECT *, concat_ws(',', CASE WHEN std_actual < 5 THEN 'low_variability' END, CASE WHEN abs(mean_error) > 5 THEN 'bias' END, CASE WHEN n_samples < 20 THEN 'few_samples' END) AS r
  FROM ((SELECT 'best' AS side, * FROM stats ORDER BY rmse, n_samples DESC, container_id LIMIT 3)
        UNION ALL (SELECT 'worst' AS side, * FROM stats ORDER BY rmse DESC, n_samples, container_id DESC LIMIT 3)))""", ("stats",))
def extreme_containers(spark, sf) -> DataFrame:
    return metrics.extreme_containers(_container_stats(spark, sf))


@query("m09c_container_error_summary", "n_containers:i median_rmse:f mean_rmse:f",
       "SELECT count(*) AS n_containers, median(rmse) AS median_rmse, avg(rmse) AS mean_rmse FROM stats", ("stats",))
def container_error_summary(spark, sf) -> DataFrame:
    return metrics.container_error_summary(_container_stats(spark, sf))


@query("m10_errors_by_type", "trash_type:s rmse:f n:i", "SELECT trash_type, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM pairs GROUP BY 1", ("pairs",))
def errors_by_type(spark, sf) -> DataFrame:
    return metrics.errors_by_type(metrics.complete_pairs(predictions(spark, sf)))


def _decisions(source: str, thresholds: str, op: str) -> str:
    return f"""
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, tp + fn AS n_urgent, 100.0 * (tp + fn) / (tp + fp + fn + tn) AS share_urgent_pct
FROM (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall
      FROM (SELECT t AS threshold, count(*) FILTER (WHERE actual {op} t AND predicted {op} t) AS tp, count(*) FILTER (WHERE NOT actual {op} t AND predicted {op} t) AS fp,
                   count(*) FILTER (WHERE actual {op} t AND NOT predicted {op} t) AS fn, count(*) FILTER (WHERE NOT actual {op} t AND NOT predicted {op} t) AS tn
            FROM {source}, (SELECT unnest({thresholds}) AS t) GROUP BY 1))"""


DECISION = "threshold:f tp:i fp:i fn:i tn:i precision:f recall:f f1:f n_urgent:i share_urgent_pct:f"


@query("m11_fill_decisions", DECISION, _decisions("pairs", "[70.0, 80.0, 85.0, 90.0]", ">="), ("pairs",))
def fill_decisions(spark, sf) -> DataFrame:
    return metrics.threshold_decisions(predictions(spark, sf))


_RANKED = "SELECT *, row_number() OVER (ORDER BY predicted DESC, container_id, measured_at_utc) AS rk, count(*) OVER () AS n FROM pairs"


@query("m12_top_share_hits", "top_pct:i k_rows:i hits:i n_urgent:i hit_rate:f", f"""
SELECT *, hits / CAST(n_urgent AS DOUBLE) AS hit_rate FROM (
  SELECT s AS top_pct, max(n) * s // 100 AS k_rows, count(*) FILTER (WHERE actual >= 85 AND rk <= n * s // 100) AS hits, count(*) FILTER (WHERE actual >= 85) AS n_urgent
  FROM ({_RANKED}), (SELECT unnest([5, 10, 15, 20, 25, 30]) AS s) GROUP BY 1)""", ("pairs",))
def top_share_hits(spark, sf) -> DataFrame:
    return metrics.top_share_hits(metrics.complete_pairs(predictions(spark, sf)))


@query("m13_capacity_lift", "capacity_pct:i capacity_n:i model_catches:i model_recall:f random_expected:f perfect_catches:i lift_vs_random:f n_total:i n_urgent:i", f"""
SELECT *, model_catches / CAST(n_urgent AS DOUBLE) AS model_recall, model_catches / random_expected AS lift_vs_random FROM (
  SELECT 20 AS capacity_pct, max(n) * 20 // 100 AS capacity_n, count(*) FILTER (WHERE actual >= 85 AND rk <= n * 20 // 100) AS model_catches,
         count(*) FILTER (WHERE actual >= 85) * 20 / 100.0 AS random_expected, count(*) FILTER (WHERE actual >= 85 AND best <= n * 20 // 100) AS perfect_catches,
         max(n) AS n_total, count(*) FILTER (WHERE actual >= 85) AS n_urgent
  FROM (SELECT *, row_number() OVER (ORDER BY actual DESC) AS best FROM ({_RANKED})))""", ("pairs",))
def capacity_lift(spark, sf) -> DataFrame:
    return metrics.capacity_lift(metrics.complete_pairs(predictions(spark, sf)))


@query("m14_day_decisions", DECISION, _decisions("day_pairs", "[1.0, 2.0, 3.0, 5.0]", "<="), ("day_pairs",))
def day_decisions(spark, sf) -> DataFrame:
    return metrics.threshold_decisions(day_predictions(spark, sf), metrics.DAY_DECISIONS, below=True)


@query("m15_fill_histogram", "bin:i n:i", "SELECT least(CAST(floor(percent_calculated) AS BIGINT), 99) AS bin, count(*) AS n FROM clean GROUP BY 1", ("clean",))
def fill_histogram(spark, sf) -> DataFrame:
    return metrics.fill_histogram(clean(spark, sf))


@query("m15b_fill_histogram_by_type", "trash_type:s bin:i n:i",
       "SELECT trash_type, least(CAST(floor(percent_calculated / 2) AS BIGINT), 49) AS bin, count(*) AS n FROM clean GROUP BY 1, 2", ("clean",))
def fill_histogram_by_type(spark, sf) -> DataFrame:
    return metrics.fill_histogram(clean(spark, sf), 50, ("trash_type",))


@query("m15c_fill_summary", "n:i mean_fill:f median_fill:f", "SELECT count(*) AS n, avg(percent_calculated) AS mean_fill, median(percent_calculated) AS median_fill FROM clean", ("clean",))
def fill_summary(spark, sf) -> DataFrame:
    return metrics.fill_summary(clean(spark, sf))


def _trend(days: int) -> str:
    frame = f"(ORDER BY date ROWS BETWEEN {days // 2} PRECEDING AND {days - days // 2 - 1} FOLLOWING)"
    return f"""SELECT date, mean_fill, CASE WHEN count(mean_fill) OVER {frame} = {days} THEN avg(mean_fill) OVER {frame} END AS rolling_mean
FROM (SELECT CAST(measured_at_utc AS DATE) AS date, avg(percent_calculated) AS mean_fill FROM clean GROUP BY 1)"""


@query("m16_daily_trend", "date:d mean_fill:f rolling_mean:f", _trend(30), ("clean",))
def daily_trend(spark, sf) -> DataFrame:
    return metrics.daily_trend(clean(spark, sf))


@query("m16b_weekly_trend", "date:d mean_fill:f rolling_mean:f", _trend(7), ("clean",))
def weekly_trend(spark, sf) -> DataFrame:
    return metrics.daily_trend(clean(spark, sf), 7)


@query("m17_hour_weekday_means", "hour:i " + " ".join(f"dow_{d}:f" for d in range(7)), "SELECT hour(measured_at_utc) AS hour, " + ", ".join(
    f"avg(percent_calculated) FILTER (WHERE isodow(measured_at_utc) = {d + 1}) AS dow_{d}" for d in range(7)) + " FROM clean GROUP BY 1", ("clean",))
def hour_weekday_means(spark, sf) -> DataFrame:
    return metrics.hour_weekday_means(clean(spark, sf))


@query("m18_residual_histogram", "bin:i n:i mean_residual:f", """
SELECT least(CAST(floor((e - lo) / ((hi - lo) / 80)) AS BIGINT), 79) AS bin, count(*) AS n, max(m) AS mean_residual
FROM pairs, (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS m FROM pairs) GROUP BY 1""", ("pairs",))
def residual_histogram(spark, sf) -> DataFrame:
    return metrics.residual_histogram(metrics.complete_pairs(predictions(spark, sf)))


@query("m18b_scatter_sample", KEYS + " actual:f predicted:f", """
SELECT * FROM pairs, (SELECT count(*) AS n FROM pairs)
WHERE ((container_id * 7919 + epoch_us(measured_at_utc) // 3600000000) % 1009) / 1009.0 < 5000.0 / n""", ("pairs",))
def scatter_sample(spark, sf) -> DataFrame:
    hours = F.floor(micros(F.col("measured_at_utc")) / 3_600_000_000)
    uniform = (F.col("container_id") * 7919 + hours) % 1009 / 1009.0
    return metrics.scatter_sample(metrics.complete_pairs(predictions(spark, sf)), 5000, uniform)


# Search trials stand in as one row per container: its mean error over some numeric columns.
_TRIALS = """SELECT container_id AS number, avg(abs(e)) AS value, avg(actual) AS p_level, stddev_pop(actual) AS p_spread, CAST(count(*) AS DOUBLE) AS p_rows
FROM pairs GROUP BY 1"""


def _trials(spark, sf) -> DataFrame:
    rows = metrics.complete_pairs(predictions(spark, sf))
    return rows.groupBy(F.col("container_id").alias("number")).agg(
        metrics.mae().alias("value"), F.avg("actual").alias("p_level"), F.stddev_pop("actual").alias("p_spread"),
        F.count(F.lit(1)).cast("double").alias("p_rows"))


@query("m19_trial_progress", "number:i value:f best_value:f", f"SELECT *, min(value) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS best_value FROM ({_TRIALS})", ("pairs",))
def trial_progress(spark, sf) -> DataFrame:
    return metrics.trial_progress(_trials(spark, sf))


@query("m19b_parameter_sensitivity", "parameter:s abs_corr:f", " UNION ALL ".join(
    f"SELECT '{p}' AS parameter, abs(corr({p}, value)) AS abs_corr FROM ({_TRIALS})" for p in ("p_level", "p_spread", "p_rows")), ("pairs",))
def parameter_sensitivity(spark, sf) -> DataFrame:
    return metrics.parameter_sensitivity(_trials(spark, sf), ["p_level", "p_spread", "p_rows"])


# -- baselines --------------------------------------------------------------------

@query("b01_last_value", KEYS + " actual:f predicted:f",
       "SELECT *, target AS actual, least(greatest(target_lag_1, 0), 100) AS predicted FROM evf WHERE target_lag_1 IS NOT NULL", ("evf",))
def last_value(spark, sf) -> DataFrame:
    return baselines.last_value(event_features(spark, sf))


@query("b02_same_weekday", KEYS + " actual:f predicted:f", "SELECT *, target AS actual, coalesce(target_same_dow, target_lag_1) AS predicted FROM evf", ("evf",))
def same_weekday(spark, sf) -> DataFrame:
    return baselines.same_weekday(event_features(spark, sf))


@query("b03_seasonal_naive", KEYS + " actual:f predicted:f", "SELECT *, target AS actual, target_lag_7 AS predicted FROM evf WHERE target_lag_7 IS NOT NULL", ("evf",))
def seasonal_naive(spark, sf) -> DataFrame:
    return baselines.seasonal_naive(event_features(spark, sf), long=long_series(spark, sf))


@query("b04_seasonal_persistence", KEYS + " actual:f predicted:f", f"""
SELECT *, target AS actual, least(greatest(coalesce(lag(percent_calculated, 4) {_W}), percent_calculated), 0), 100) AS predicted FROM timed""", ("timed",))
def seasonal_persistence(spark, sf) -> DataFrame:
    return baselines.seasonal_persistence(time_features(spark, sf))


@query("b05_linear_extrapolation", KEYS + " actual:f predicted:f", "SELECT * FROM day_pairs", ("day_pairs",))
def linear_extrapolation(spark, sf) -> DataFrame:
    return day_predictions(spark, sf)


@query("b06_ar_forecasts", "container_id:i step:i actual:f predicted:f ar_order:i model_order:s")
def ar_forecasts(spark, sf) -> DataFrame:
    return forecasting.ar_forecasts(grid_rows(spark, sf), "percent_calculated")


@query("b06b_fixed_ar_forecasts", "container_id:i step:i actual:f predicted:f ar_order:i model_order:s")
def fixed_ar_forecasts(spark, sf) -> DataFrame:
    return forecasting.ar_forecasts(grid_rows(spark, sf), "percent_calculated", automatic=False)


_LAST_FIFTH = """SELECT container_id, rn - cut AS step, percent_calculated AS actual FROM (
  SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS rn, floor(count(*) OVER (PARTITION BY container_id) * 0.8) AS cut,
         count(*) OVER (PARTITION BY container_id) AS n FROM grid) WHERE rn > cut AND n >= 15 AND cut >= 10"""


@query("b06c_forecast_targets", "container_id:i step:i actual:f", _LAST_FIFTH, ("grid",))
def forecast_targets(spark, sf) -> DataFrame:
    return forecasting.ar_forecasts(grid_rows(spark, sf), "percent_calculated", automatic=False)


@query("b06d_most_common_order", "most_common_order:s n_series:i")
def most_common_order(spark, sf) -> DataFrame:
    return forecasting.most_common_order(forecasting.ar_forecasts(grid_rows(spark, sf), "percent_calculated"))


@query("b07_trend_forecasts", "container_id:i step:i actual:f predicted:f")
def trend_forecasts(spark, sf) -> DataFrame:
    return forecasting.trend_forecasts(grid_rows(spark, sf), "percent_calculated")


@query("b08_rolling_forecasts", "container_id:i model:s step:i actual:f predicted:f")
def rolling_forecasts(spark, sf) -> DataFrame:
    return forecasting.rolling_forecasts(time_rows(spark, sf), held_out(spark, sf))


@query("b08b_rolling_metrics", "model:s " + SCORES)
def rolling_metrics(spark, sf) -> DataFrame:
    return metrics.all_metrics(forecasting.rolling_forecasts(time_rows(spark, sf), held_out(spark, sf)), by=("model",))


part("ev_test", """SELECT *, lag(target, 7) OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS season FROM evf
WHERE target_lag_1 IS NOT NULL AND target_lag_2 IS NOT NULL AND container_id IN (SELECT container_id FROM test_ids)""", "evf", "test_ids")
_NAIVE = {"Last Value (Naive)": "target_lag_1", "Same Day-of-Week": "coalesce(target_same_dow, target_lag_1)", "Seasonal Naive (7-day)": "season"}


@query("b09_naive_comparison", "model:s " + SCORES, f"SELECT model, {PAIR_SCORES} FROM (SELECT *, actual - predicted AS e FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, target AS actual, {c} AS predicted FROM ev_test" for m, c in _NAIVE.items()) + ") WHERE predicted IS NOT NULL) GROUP BY 1", ("ev_test",))
def naive_comparison(spark, sf) -> DataFrame:
    return baselines.compare_baselines(event_features(spark, sf), held_out(spark, sf), long=long_series(spark, sf), forecasters=False, min_rows=1)


@query("b09b_all_baselines", "model:s " + SCORES)
def all_baselines(spark, sf) -> DataFrame:
    return baselines.compare_baselines(event_features(spark, sf), held_out(spark, sf), long=long_series(spark, sf), min_rows=1)


# -- survival ---------------------------------------------------------------------

part("waits", """
SELECT container_id, measured_at_utc, percent_calculated, coalesce(wait <= 14, false) AS event, greatest(CASE WHEN wait <= 14 THEN wait ELSE 14.0 END, 0.01) AS duration
FROM (SELECT a.container_id, a.measured_at_utc, a.percent_calculated,
             (SELECT min(date_diff('microsecond', a.measured_at_utc, b.measured_at_utc)) FROM clean b
              WHERE b.container_id = a.container_id AND b.measured_at_utc > a.measured_at_utc AND b.percent_calculated >= 85) / 86400000000.0 AS wait
      FROM clean a WHERE a.percent_calculated < 85)""", "clean")
part("curve", """
SELECT duration, at_risk, events, CASE WHEN zero > 0 THEN 0 ELSE exp(lg) END AS survival
FROM (SELECT *, sum(CASE WHEN events < at_risk THEN ln(1 - events / CAST(at_risk AS DOUBLE)) ELSE 0 END) OVER (ORDER BY duration) AS lg,
             sum(CASE WHEN events >= at_risk THEN 1 ELSE 0 END) OVER (ORDER BY duration) AS zero
      FROM (SELECT duration, sum(n) OVER (ORDER BY duration DESC) AS at_risk, events
            FROM (SELECT duration, count(*) AS n, count(*) FILTER (WHERE event) AS events FROM waits
                  WHERE container_id NOT IN (SELECT container_id FROM test_ids) GROUP BY 1)))""", "waits", "test_ids")


def _survival(spark, sf) -> DataFrame:
    return survival.survival_data(clean(spark, sf), long=long_series(spark, sf))


def _survival_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    data, ids = _survival(spark, sf), held_out(spark, sf)
    return data.join(ids, "container_id", "left_anti"), data.join(ids, "container_id", "left_semi")


@query("v01_survival_data", KEYS + " percent_calculated:f duration:f event:s", "SELECT * FROM waits", ("waits",))
def survival_data(spark, sf) -> DataFrame:
    return _survival(spark, sf)


@query("v02_kaplan_meier", "duration:f at_risk:i events:i survival:f", "SELECT * FROM curve", ("curve",))
def kaplan_meier(spark, sf) -> DataFrame:
    return survival.kaplan_meier(_survival_sides(spark, sf)[0])


@query("v02b_kaplan_meier_baseline", "median_survival:f rmse:f mae:f r2:f n:i", """
SELECT m AS median_survival, sqrt(avg((duration - m) ** 2)) AS rmse, avg(abs(duration - m)) AS mae, 1 - sum((duration - m) ** 2) / (var_pop(duration) * count(*)) AS r2, count(*) AS n
FROM waits, (SELECT min(duration) FILTER (WHERE survival <= 0.5 + 1e-12) AS m FROM curve)
WHERE event AND container_id IN (SELECT container_id FROM test_ids) GROUP BY m""", ("waits", "curve", "test_ids"))
def kaplan_meier_baseline(spark, sf) -> DataFrame:
    return survival.kaplan_meier_baseline(*_survival_sides(spark, sf))


@query("v03_hazard_baseline", "coefficient:f rmse:f mae:f r2:f n:i concordance:f")
def hazard_baseline(spark, sf) -> DataFrame:
    return survival.hazard_baseline(*_survival_sides(spark, sf))


part("cells", """
SELECT duration AS t, percent_calculated AS x, count(*) AS n, count(*) FILTER (WHERE event) AS d
FROM waits WHERE container_id NOT IN (SELECT container_id FROM test_ids) GROUP BY 1, 2""", "waits", "test_ids")


# for a hazard that rises with the fill level; pairs counted one by one
@query("v04_concordance", "concordance:f", """
SELECT sum(a.d * (CASE WHEN b.t > a.t THEN b.n ELSE b.n - b.d END) * (CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END))
       / sum(a.d * (CASE WHEN b.t > a.t THEN b.n ELSE b.n - b.d END)) AS concordance
FROM cells a JOIN cells b ON b.t >= a.t WHERE a.d > 0""", ("cells",))
def concordance(spark, sf) -> DataFrame:
    rising = survival.HazardModel(beta=1.0, center=0.0, scale=1.0, steps=0, baseline=None)
    return survival.concordance(rising, _survival_sides(spark, sf)[0])
