"""Ordered work over series that may be of any length.

A plain window partitioned by the entity puts a whole series into one task. That is
right for ordinary series and wrong for one that holds a large part of the data. The
helpers here therefore work on two branches:

* ordinary series take the plain window (one hash exchange on the entity);
* series longer than `block_rows` are range-partitioned on (entity, order), get exact
  row positions from per-chunk counts, and are processed in blocks of `block_rows`
  rows. A block carries a copy of the few neighbouring rows its frames reach, or a
  running total of everything before it, so results are the same as with the window.

Which series are long is found by one map-side combined count; there are at most
`rows / block_rows` of them, so that list is safe to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.config import DEFAULTS

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a wide table as parquet below the shared folder and read it back.

    For tables several jobs use: it cuts the lineage, survives lost executors, and later
    jobs read only the columns they need.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_TYPES = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "map<string,string>": pa.map_(pa.string(), pa.string())}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's few rows. It goes as Arrow: rows of Python values would start Python workers on the executors."""
    fields = T.StructType.fromDDL(schema).fields

    def value(v):
        return list(v.items()) if isinstance(v, dict) else v

    columns = [pa.array([value(r[k]) for r in rows], ARROW_TYPES[f.dataType.simpleString()]) for k, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[f.name for f in fields]), schema)


def shared_folder(spark: SparkSession) -> str:
    """A path for a new table below the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get(CHECKPOINT_SETTING, None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="fillcast-checkpoint-")
        context.setCheckpointDir(shared)


@dataclass(frozen=True)
class LongSeries:
    """The series that are cut into blocks, and the block length."""

    keys: tuple[str, ...]
    ids: DataFrame
    rows: int
    block_rows: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        ids = F.broadcast(self.ids)
        return df.join(ids, list(self.keys), "left_anti"), df.join(ids, list(self.keys), "left_semi")


def find_long_series(
    df: DataFrame, keys: tuple[str, ...] = ("container_id",), block_rows: int = DEFAULTS.block_rows
) -> LongSeries | None:
    """One counting pass over the key column; None when every series fits a task."""
    counted = df.groupBy(*keys).count().filter(F.col("count") > block_rows)
    found = counted.collect()  # at most rows / block_rows entries
    if not found:
        return None
    ids = df.sparkSession.createDataFrame(
        [tuple(r[k] for k in keys) for r in found], schema=counted.select(*keys).schema
    )
    return LongSeries(tuple(keys), ids, sum(r["count"] for r in found), block_rows)


def on_both(
    df: DataFrame, long: LongSeries | None,
    plain: Callable[[DataFrame], DataFrame], blocked: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    if long is None:
        return plain(df)
    rest, big = long.split(df)
    return plain(rest).unionByName(blocked(big))


# -- running totals over long series -------------------------------------------

def in_chunks(
    df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], rows: int, block_rows: int,
) -> tuple[DataFrame, list[Column], list[str]]:
    """Rows with their `_chunk` along (keys, order) and `_w_<name>` values; the sort columns; the helper columns.

    The range exchange spreads equal keys too: a random salt is the last sort column, so
    copies of one row do not end up in one task. Two checkpoints make that safe against
    lost executors: the first pins the salts, so a task run again sends every copy to the
    same place; the second pins the chunk numbers, which the per-chunk totals and the rows
    must agree on.
    """
    chunks = max(1, -(-rows // block_rows)) * 2
    placed = df.withColumn("_salt", F.rand(17))
    for i, c in enumerate(order):
        placed = placed.withColumn(f"_o{i}", c)
    sort_cols = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))] + [F.col("_salt")]
    placed = saved(placed.withColumns({f"_w_{name}": c for name, c in values.items()}))
    placed = saved(
        placed.repartitionByRange(chunks, *keys, *sort_cols).withColumn("_chunk", F.spark_partition_id())
    )
    return placed, sort_cols, ["_salt", "_chunk", *[f"_o{i}" for i in range(len(order))], *[f"_w_{n}" for n in values]]


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
    rows: int, block_rows: int,
) -> DataFrame:
    """Inclusive running sums along `order`, computed chunk by chunk."""
    placed, sort_cols, helpers = in_chunks(df, keys, order, sums, rows, block_rows)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*sort_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_w_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums])
    # one row per (long series, chunk): at most chunks + long series
    joined = placed.join(F.broadcast(before), [*keys, "_chunk"])
    for name in sums:
        joined = joined.withColumn(
            name, F.sum(f"_w_{name}").over(within) + F.col(f"_b_{name}"))
    return joined.drop(*helpers, *[f"_b_{n}" for n in sums])


def positions(
    df: DataFrame, keys: list[str], order: list[Column], long: LongSeries | None, name: str = "_pos"
) -> DataFrame:
    """1-based row position in each series."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return on_both(
        df, long,
        lambda part: part.withColumn(name, F.row_number().over(window).cast("long")),
        lambda part: running_sums(part, keys, order, {name: F.lit(1).cast("long")}, long.rows, long.block_rows),
    )


def global_running_sums(
    df: DataFrame, order: list[Column], sums: dict[str, Column], block_rows: int = DEFAULTS.block_rows,
    rows: int | None = None,
) -> DataFrame:
    """Running sums over one global order; a single-task window only below `block_rows` rows.

    `rows` is the row count where the caller knows it.
    """
    rows = df.count() if rows is None else rows
    if rows <= block_rows:
        window = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(c).over(window) for name, c in sums.items()})
    return running_sums(df, [], order, sums, rows, block_rows)


def global_positions(
    df: DataFrame, order: list[Column], name: str, block_rows: int = DEFAULTS.block_rows, rows: int | None = None
) -> DataFrame:
    return global_running_sums(df, order, {name: F.lit(1).cast("long")}, block_rows, rows)


def global_last_known(
    df: DataFrame, order: list[Column], values: dict[str, Column], block_rows: int = DEFAULTS.block_rows,
    rows: int | None = None, exclusive: bool = False,
) -> DataFrame:
    """Last value that is not NULL up to each row (`exclusive`: before it), for several columns over one global order.

    Rows that are equal in `order` are put in an arbitrary order, so callers name enough columns.
    Above `block_rows` rows the chunks of a range exchange are filled on their own, and what
    is known at the end of a chunk is carried over its border (one small row a chunk).
    """
    rows = df.count() if rows is None else rows
    upto = (Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    if rows <= block_rows:
        window = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({name: F.last(c, ignorenulls=True).over(window) for name, c in values.items()})
    placed, sort_cols, helpers = in_chunks(df, [], order, values, rows, block_rows)
    within = Window.partitionBy("_chunk").orderBy(*sort_cols).rowsBetween(*upto)
    at = F.struct(*helpers[2:2 + len(order)], "_salt")
    ends = placed.groupBy("_chunk").agg(*[
        F.max_by(f"_w_{n}", F.when(F.col(f"_w_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk: at most 2 * rows / block_rows + 2
    before = ends.select("_chunk", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in values])
    joined = placed.join(F.broadcast(before), "_chunk").withColumns({
        n: F.coalesce(F.last(f"_w_{n}", ignorenulls=True).over(within), F.col(f"_b_{n}")) for n in values})
    return joined.drop(*helpers, *[f"_b_{n}" for n in values])


def merge_as_of(df: DataFrame, right: DataFrame, at: str, right_at: str, block_rows: int = DEFAULTS.block_rows) -> DataFrame:
    """Each row of `df` with the columns of the last row of `right` at or before its time.

    Both sides are put into one global order of time, with right rows first at equal times, and
    the last right row is carried forward, over the borders of range partitions too. Nothing is
    broadcast but one row a partition, and rows of one instant are spread by a salt, so neither
    a hot day nor a hot instant makes a large task. Of right rows with equal times one is taken.
    Rows of `df` without a time get NULLs; right rows without a time match nothing.
    """
    mine = [F.col(c) for c in df.columns]
    theirs = [F.col(c) for c in right.columns]
    left_type, right_type = df.select(F.struct(*mine)).schema[0].dataType, right.select(F.struct(*theirs)).schema[0].dataType
    both = df.select(
        F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*mine).alias("_row"), F.lit(None).cast(right_type).alias("_from"),
    ).unionAll(right.filter(F.col(right_at).isNotNull()).select(
        F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left_type).alias("_row"), F.struct(*theirs).alias("_from")))
    carried = global_last_known(both, [F.col("_at"), F.col("_side")], {"_match": F.col("_from")}, block_rows)
    return carried.filter("_side = 1").select("_row.*", "_match.*")


# -- frames of bounded reach ---------------------------------------------------

def over_series(
    df: DataFrame, keys: list[str], order: list[Column],
    add: Callable[[DataFrame, list[str]], DataFrame],
    back: int = 0, ahead: int = 0, long: LongSeries | None = None,
) -> DataFrame:
    """Apply `add(frame, partition_columns)`, whose windows reach at most `back` rows
    behind and `ahead` rows in front of the current row."""
    def blocked(part: DataFrame) -> DataFrame:
        size = max(long.block_rows, back, ahead, 1)
        placed = positions(part, keys, order, long).withColumn(
            "_home", F.floor((F.col("_pos") - 1) / size).cast("long"))
        home, pos = F.col("_home"), F.col("_pos")
        copies = F.array_compact(F.array(
            home,
            F.when(pos > (home + 1) * size - back, home + 1),
            F.when((pos <= home * size + ahead) & (home > 0), home - 1),
        ))
        spread = placed.withColumn("_block", F.explode(copies))
        return add(spread, [*keys, "_block"]).filter("_block = _home").drop("_pos", "_home", "_block")

    return on_both(df, long, lambda part: add(part, keys), blocked)


# -- frames that reach the start or the end ------------------------------------

def running_extreme(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
    how: str = "max", later: bool = False, exclusive: bool = False, long: LongSeries | None = None,
) -> DataFrame:
    """Running max/min from the start of the series, or (`later`) over the rows after it.

    `later` sorts descending, so the frame always starts at the partition's first row
    and costs one pass.
    """
    args = (keys, order, value, name, how, later, exclusive)
    return on_both(
        df, long,
        lambda part: _extreme_in_window(part, *args),
        lambda part: _extreme_in_blocks(part, *args, long),
    )


def global_running_extreme(
    df: DataFrame, order: list[Column], value: Column, name: str, how: str = "max",
    later: bool = False, exclusive: bool = False, block_rows: int = DEFAULTS.block_rows,
) -> DataFrame:
    """`running_extreme` over one global order; a single-task window only below `block_rows` rows."""
    rows = df.count()
    args = ([], order, value, name, how, later, exclusive)
    if rows <= block_rows:
        return _extreme_in_window(df, *args)
    return _extreme_in_blocks(df, *args, LongSeries((), df.limit(0), rows, block_rows))


def _extreme_in_window(df, keys, order, value, name, how, later, exclusive) -> DataFrame:
    pick = F.max if how == "max" else F.min
    sort = [c.desc() for c in order] if later else order
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*sort).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumn(name, pick(value).over(window))


def _extreme_in_blocks(df, keys, order, value, name, how, later, exclusive, long) -> DataFrame:
    pick, merge = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    placed = running_sums(
        df.withColumn("_v", value), keys, order, {"_pos": F.lit(1).cast("long")}, long.rows, long.block_rows
    ).withColumn("_block", F.floor((F.col("_pos") - 1) / long.block_rows))
    sort = F.col("_pos").desc() if later else F.col("_pos").asc()
    inside = Window.partitionBy(*keys, "_block").orderBy(sort).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    tops = placed.groupBy(*keys, "_block").agg(pick("_v").alias("_top"))
    block = F.col("_block").desc() if later else F.col("_block").asc()
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # one row per block: at most rows / block_rows + long series
    carry = tops.select(*keys, "_block", pick("_top").over(before).alias("_carry"))
    return (
        placed.join(F.broadcast(carry), [*keys, "_block"])
        .withColumn("_inside", pick("_v").over(inside))
        .withColumn(name, F.coalesce(merge("_inside", "_carry"), "_inside", "_carry"))
        .drop("_pos", "_block", "_v", "_inside", "_carry")
    )


def history_stats(
    df: DataFrame, keys: list[str], order: list[Column], value: str, mean: str, std: str,
    long: LongSeries | None = None,
) -> DataFrame:
    """Mean and sample deviation of all earlier values of the series."""
    def plain(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumns({mean: F.avg(value).over(window), std: F.stddev_samp(value).over(window)})

    def blocked(part: DataFrame) -> DataFrame:
        v = F.col(value)
        placed = positions(part, keys, order, long).withColumn(
            "_block", F.floor((F.col("_pos") - 1) / long.block_rows))
        inside = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        moments = placed.groupBy(*keys, "_block").agg(
            F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"))
        # sums are taken around the series' first block mean to keep them small
        first = Window.partitionBy(*keys).orderBy("_block")
        shifted = moments.withColumn("_c", F.first("_m", ignorenulls=True).over(
            first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        before = first.rowsBetween(Window.unboundedPreceding, -1)
        d = F.col("_m") - F.col("_c")
        carry = shifted.select(
            *keys, "_block", "_c",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum(F.col("_n") * d).over(before), F.lit(0.0)).alias("_s0"),
            F.coalesce(F.sum(F.col("_n") * (F.col("_v") + d * d)).over(before), F.lit(0.0)).alias("_q0"))
        rows = placed.join(F.broadcast(carry), [*keys, "_block"])
        x = v - F.col("_c")
        rows = rows.withColumns({
            "_n1": F.col("_n0") + F.count(v).over(inside),
            "_s1": F.col("_s0") + F.coalesce(F.sum(x).over(inside), F.lit(0.0)),
            "_q1": F.col("_q0") + F.coalesce(F.sum(x * x).over(inside), F.lit(0.0)),
        })
        n, s, q = F.col("_n1"), F.col("_s1"), F.col("_q1")
        return rows.withColumns({
            mean: F.when(n > 0, F.col("_c") + s / n),
            std: F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))),
        }).drop("_pos", "_block", "_c", "_n0", "_s0", "_q0", "_n1", "_s1", "_q1")

    return on_both(df, long, plain, blocked)


# -- exact quantiles -----------------------------------------------------------

def series_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, long: LongSeries) -> DataFrame:
    """Exact quantile of each long series from distributed value ranks; one row per series.

    Interpolates linearly between the two rows around position (n - 1) q + 1.
    """
    filled = df.select(*keys, value).filter(F.col(value).isNotNull())
    ranked = running_sums(filled, keys, [F.col(value)], {"_rank": F.lit(1).cast("long")}, long.rows, long.block_rows)
    sizes = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one row per long series
    return (
        ranked.join(F.broadcast(sizes), keys)
        .withColumn("_share", _share_of_rank(F.col("_rank"), (F.col("_n") - 1) * F.lit(q) + 1))
        .filter("_share > 0").groupBy(*keys).agg(F.sum(F.col(value) * F.col("_share")).alias(name))
    )


def exact_quantile(df: DataFrame, value: str, q: float, name: str, block_rows: int = DEFAULTS.block_rows) -> DataFrame:
    """Exact quantile of a whole column, as a one-row frame."""
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k")))
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_k"), F.lit(0))).first()
    at = (total - 1) * q + 1
    last = F.col("_last")
    ranked = global_running_sums(counts, [F.col(value)], {"_last": F.col("_k")}, block_rows, distinct)
    low = F.floor(F.lit(at))
    return ranked.agg(
        (F.min(F.when(last >= low, F.col(value))) * F.lit(1 - (at - int(at)))
         + F.min(F.when(last >= F.least(low + 1, F.lit(max(total, 1))), F.col(value))) * F.lit(at - int(at))).alias(name))


def _share_of_rank(rank: Column, at: Column) -> Column:
    low = F.floor(at)
    return F.when(rank == low, 1 - (at - low)).when(rank == low + 1, at - low).otherwise(0.0)
