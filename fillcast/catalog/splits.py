"""Queries on hold-outs, temporal splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.catalog.inputs import CHECKED, clean, event_rows, long_series, time_rows
from fillcast.catalog.registry import part, query
from fillcast.operators import split

KEYS = "container_id:i measured_at_utc:u"


def _shuffled(source: str, seed: int) -> str:
    return f"""SELECT container_id, row_number() OVER (ORDER BY (container_id * 7919 + {seed} * 104729) % 1000003, container_id) AS rn,
       count(*) OVER () AS n FROM (SELECT DISTINCT container_id FROM {source})"""


part("test_ids", f"SELECT container_id FROM ({_shuffled('clean', 42)}) WHERE rn <= floor(n * 0.2)", "clean")


def held_out(spark, sf) -> DataFrame:
    return split.hold_out_containers(clean(spark, sf), key=split.arithmetic)


@query("p01_hold_out", "container_id:i", "SELECT * FROM test_ids", ("test_ids",))
def hold_out(spark, sf) -> DataFrame:
    return held_out(spark, sf)


@query("p01b_hold_out_rows", "side:s n_rows:i n_containers:i", """
SELECT CASE WHEN t.container_id IS NULL THEN 'train' ELSE 'test' END AS side, count(*) AS n_rows, count(DISTINCT c.container_id) AS n_containers
FROM clean c LEFT JOIN test_ids t ON t.container_id = c.container_id GROUP BY 1""", ("clean", "test_ids"))
def hold_out_rows(spark, sf) -> DataFrame:
    train, test = split.split_by_containers(clean(spark, sf), held_out(spark, sf))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("container_id").alias("n_containers"))


@query("p02_hold_out_per_class", "capacity_class:s container_id:i", " UNION ALL ".join(
    f"SELECT '{c}' AS capacity_class, container_id FROM ({_shuffled(f'(SELECT * FROM clean WHERE capacity_class = {chr(39)}{c}{chr(39)})', 42 + o)}) WHERE rn <= greatest(1, floor(n * 0.2))"
    for c, o in split.SEED_OFFSETS.items()), ("clean",))
def hold_out_per_class(spark, sf) -> DataFrame:
    rows = clean(spark, sf)
    parts = [split.hold_out_for_class(rows, c, key=split.arithmetic).select(F.lit(c).alias("capacity_class"), "container_id")
             for c in split.SEED_OFFSETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("p03_temporal_split", KEYS + " part:s", """
SELECT *, CASE WHEN rn > n - greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY measured_at_utc) AS rn, count(*) OVER (PARTITION BY container_id) AS n FROM clean)""", ("clean",))
def temporal_split(spark, sf) -> DataFrame:
    return split.mark_newest(clean(spark, sf), 0.15, long=long_series(spark, sf))


def _folds(source: str, k: int, cutoff: bool) -> str:
    limit = "AND h.measured_at_utc < (SELECT min(v.measured_at_utc) FROM halves v WHERE v.fold = x.f AND v.half = 'val')" if cutoff else ""
    return f"""
WITH groups AS (SELECT container_id, ntile({k}) OVER (ORDER BY (container_id * 7919 + 42 * 104729) % 1000003, container_id) AS fold
                FROM (SELECT DISTINCT container_id FROM {source})),
halves AS (SELECT s.container_id, s.measured_at_utc, g.fold,
                  CASE WHEN row_number() OVER w > count(*) OVER (PARTITION BY s.container_id) - greatest(1, floor(count(*) OVER (PARTITION BY s.container_id) * 0.5)) THEN 'val' ELSE 'train' END AS half
           FROM {source} s JOIN groups g ON g.container_id = s.container_id WINDOW w AS (PARTITION BY s.container_id ORDER BY s.measured_at_utc))
SELECT container_id, measured_at_utc, fold, 'val' AS part FROM halves WHERE half = 'val'
UNION ALL
SELECT h.container_id, h.measured_at_utc, x.f AS fold, 'train' AS part FROM halves h, (SELECT unnest(generate_series(1, {k})) AS f) x WHERE h.fold <> x.f {limit}"""


@query("p04_holdout_folds", KEYS + " fold:i part:s", _folds("ev", 5, True), ("ev",))
def holdout_folds(spark, sf) -> DataFrame:
    return split.holdout_folds(event_rows(spark, sf), 5, key=split.arithmetic, long=long_series(spark, sf))


@query("p05_expanding_folds", "fold:i part:s n_rows:i first_us:i last_us:i", """
WITH r AS (SELECT min(epoch_us(measured_at_utc)) AS lo, max(epoch_us(measured_at_utc)) - min(epoch_us(measured_at_utc)) AS span FROM timed)
SELECT f AS fold, CASE WHEN epoch_us(t.measured_at_utc) - lo < span * (5 + f) // 10 THEN 'train' ELSE 'val' END AS part, count(*) AS n_rows,
       min(epoch_us(t.measured_at_utc)) AS first_us, max(epoch_us(t.measured_at_utc)) AS last_us
FROM timed t, r, (SELECT unnest([1, 2, 3, 4]) AS f) x WHERE epoch_us(t.measured_at_utc) - lo < span * (6 + f) // 10 GROUP BY 1, 2""", ("timed",))
def expanding_folds(spark, sf) -> DataFrame:
    marked = split.expanding_folds(time_rows(spark, sf), 5)
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("measured_at_utc"))
    return marked.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("p06_tuner_folds", KEYS + " fold:i part:s", _folds("ev", 3, False), ("ev",))
def tuner_folds(spark, sf) -> DataFrame:
    return split.holdout_folds(event_rows(spark, sf), CHECKED.tuning_folds, cutoff=False, key=split.arithmetic, long=long_series(spark, sf))
