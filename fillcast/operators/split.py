"""Hold-outs and folds that separate entities and time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.config import DEFAULTS, Settings
from fillcast.operators.emptying import KEY, time_order
from fillcast.operators.ordered import LongSeries, global_positions, on_both, positions, stored

# Seed offset of each capacity class, so that their hold-outs are independent.
SEED_OFFSETS = {"low": 0, "medium": 100, "high": 200, "unknown": 300}
OTHER_OFFSET = 500

ShuffleKey = Callable[[Column, int], Column]


def hashed(entity: Column, seed: int) -> Column:
    """Pseudo-random order of entities that depends on nothing but seed and id."""
    return F.xxhash64(F.lit(seed), entity)


def arithmetic(entity: Column, seed: int) -> Column:
    """A shuffle order any SQL engine can repeat."""
    return (entity * 7919 + seed * 104729) % 1000003


def shuffled_containers(df: DataFrame, seed: int, key: ShuffleKey = hashed, settings: Settings = DEFAULTS) -> tuple[DataFrame, int]:
    """Distinct containers with their rank in the shuffle order, and how many there are."""
    ids = stored(df.select(*KEY).distinct())
    n = ids.count()
    order = ids.withColumn("_shuffle", key(F.col("container_id"), seed))
    ranked = global_positions(order, [F.col("_shuffle"), F.col("container_id")], "_rank", settings.block_rows, n)
    return ranked.drop("_shuffle"), n


def hold_out_containers(
    df: DataFrame, seed: int | None = None, at_least: int = 0,
    key: ShuffleKey = hashed, settings: Settings = DEFAULTS,
) -> DataFrame:
    """A fixed fraction of the containers, as a one-column frame."""
    ranked, n = shuffled_containers(df, settings.seed if seed is None else seed, key, settings)
    size = max(int(n * settings.test_fraction), at_least if n else 0)
    return ranked.filter(F.col("_rank") <= size).select(*KEY)


def hold_out_for_class(
    df: DataFrame, capacity_class: str, seed: int | None = None,
    key: ShuffleKey = hashed, settings: Settings = DEFAULTS,
) -> DataFrame:
    """The hold-out within one capacity class: at least one container, own seed."""
    offset = SEED_OFFSETS.get(capacity_class, OTHER_OFFSET)
    chosen = df.filter(F.col("capacity_class") == capacity_class)
    return hold_out_containers(chosen, (settings.seed if seed is None else seed) + offset, 1, key, settings)


def split_by_containers(df: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other containers, rows of the held-out containers)."""
    return df.join(held_out, KEY, "left_anti"), df.join(held_out, KEY, "left_semi")


def mark_newest(
    df: DataFrame, fraction: float, name: str = "part", long: LongSeries | None = None
) -> DataFrame:
    """'val' on the newest max(1, int(n * fraction)) rows of each container, 'train' before them."""
    whole = Window.partitionBy(*KEY)

    def with_size(part: DataFrame) -> DataFrame:  # same partitioning as the positions
        return part.withColumn("_n", F.count(F.lit(1)).over(whole))

    def with_joined_size(part: DataFrame) -> DataFrame:  # one row per long series
        return part.join(F.broadcast(part.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))), KEY)

    # rows of one instant need a fixed order too: both parts are read from separate jobs
    order = [*time_order(), F.xxhash64(*df.columns)]
    ranked = on_both(positions(df, KEY, order, long), long, with_size, with_joined_size)
    newest = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    return ranked.withColumn(
        name, F.when(F.col("_pos") > F.col("_n") - newest, "val").otherwise("train")).drop("_pos", "_n")


def temporal_split(
    df: DataFrame, fraction: float | None = None, long: LongSeries | None = None, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(older rows, newest rows). The marked rows are stored, since both parts are read by several jobs."""
    marked = stored(mark_newest(df, settings.validation_fraction if fraction is None else fraction, "_part", long))
    return marked.filter("_part = 'train'").drop("_part"), marked.filter("_part = 'val'").drop("_part")


def assign_folds(
    df: DataFrame, folds: int, seed: int, key: ShuffleKey = hashed, settings: Settings = DEFAULTS
) -> DataFrame:
    """Containers in `folds` near-equal groups (the first n % folds groups have one more)."""
    ranked, n = shuffled_containers(df, seed, key, settings)
    size, extra = divmod(n, folds)
    wide = extra * (size + 1)
    row = F.col("_rank") - 1
    fold = F.when(row < wide, F.floor(row / (size + 1)))
    if size:
        fold = fold.otherwise(extra + F.floor((row - wide) / size))
    return ranked.select(*KEY, fold.cast("int").alias("fold"))


def holdout_folds(
    df: DataFrame, folds: int | None = None, seed: int | None = None, cutoff: bool = True,
    key: ShuffleKey = hashed, long: LongSeries | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Every fold's train and validation rows in one frame, with `fold` and `part`.

    Fold f validates on the newest half of its containers and trains on the rest; with
    `cutoff`, only on rows older than the fold's oldest validation row. A row serves as
    training row of at most folds - 1 folds, so the frame is at most `folds` times as long.
    """
    k = folds or settings.folds
    groups = assign_folds(df, k, settings.seed if seed is None else seed, key, settings)
    marked = mark_newest(df, 0.5, "_half", long).join(groups.withColumnRenamed("fold", "_own"), KEY)
    val = marked.filter("_half = 'val'").select("*", F.col("_own").alias("fold"), F.lit("val").alias("part"))
    others = F.array(*[F.when(F.col("_own") != i, F.lit(i)) for i in range(k)])
    train = marked.select("*", F.explode(F.array_compact(others)).alias("fold"), F.lit("train").alias("part"))
    if cutoff:
        starts = val.groupBy("fold").agg(F.min("measured_at_utc").alias("_from"))  # one row per fold
        train = train.join(F.broadcast(starts), "fold").filter(F.col("measured_at_utc") < F.col("_from")).drop("_from")
    return train.unionByName(val).drop("_own", "_half").withColumn("fold", F.col("fold") + 1)


FIRST_TRAIN_TENTHS = 6


def expanding_folds(df: DataFrame, folds: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Train on the first 60 %, 70 %, ... of the time range, validate on the next 10 %.

    At most four folds fit; a fold without training or validation rows is left out.
    """
    span = df.agg(
        F.min("measured_at_utc").alias("lo"),
        F.timestamp_diff("MICROSECOND", F.min("measured_at_utc"), F.max("measured_at_utc")).alias("micros")).first()
    if span["lo"] is None:
        return df.select("*", F.lit(0).alias("fold"), F.lit("").alias("part")).limit(0)
    start_of_range = F.lit(str(span["lo"])).cast("timestamp_ntz")
    since = F.timestamp_diff("MICROSECOND", start_of_range, F.col("measured_at_utc"))
    count = min(folds or settings.folds, 10 - FIRST_TRAIN_TENTHS)

    def limit(tenths: int) -> Column:
        return F.lit(span["micros"] * tenths // 10)

    parts = []
    for i in range(count):
        start, end = limit(FIRST_TRAIN_TENTHS + i), limit(FIRST_TRAIN_TENTHS + i + 1)
        part = F.when(since < start, "train").when(since < end, "val")
        parts.append(F.when(part.isNotNull(), F.struct(F.lit(i + 1).alias("fold"), part.alias("part"))))
    rows = df.select("*", F.inline(F.array_compact(F.array(*parts))))
    both = rows.groupBy("fold").agg(F.countDistinct("part").alias("_n")).filter("_n = 2").select("fold")
    return rows.join(F.broadcast(both), "fold", "left_semi")


def make_folds(
    df: DataFrame, folds: int | None = None, seed: int | None = None, kind: str | None = None,
    long: LongSeries | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    if (kind or settings.fold_kind) == "expanding_window":
        return expanding_folds(df, folds, settings)
    return holdout_folds(df, folds, seed, True, hashed, long, settings)


def each_fold(marked: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, train rows, validation rows); the fold numbers are a handful."""
    for row in marked.select("fold").distinct().orderBy("fold").collect():
        fold = marked.filter(F.col("fold") == row["fold"]).drop("fold")
        yield (row["fold"], fold.filter("part = 'train'").drop("part"), fold.filter("part = 'val'").drop("part"))
