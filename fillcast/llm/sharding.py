"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.operators.ordered import stored

MAX_SHARD_BYTES = 16 << 20
HASH_BITS = 60
#: Directory bits counted in one round beyond those an even spread would need.
SPARE_BITS = 5


def row_hash(*keys: Column) -> Column:
    """Sixty bits of the MD5 of the keys as text; NULL reads as an empty string."""
    text = F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: str, bits: str) -> str:
    return f"shiftright({h}, {HASH_BITS} - {bits})"


def shard_directory(sized: DataFrame, limit: int) -> DataFrame:
    """Rows (shard_depth, bucket): the leaves of the directory over rows (h, bytes).

    A bucket at depth d holds the hashes that share their first d bits. It splits if its bytes exceed the
    limit. Bytes are summed once per fine bucket, and the sums of those give every depth above. Buckets
    that are still too large at the finest depth go to a next round, on the rows they hold.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    step = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    leaves, start, rows = None, 0, sized
    while True:
        end = min(HASH_BITS, start + step)
        fine = rows.groupBy(F.expr(prefix("h", str(end))).alias("f")).agg(F.sum("bytes").alias("bytes"))
        fine = stored(fine)
        every = fine.select(
            F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"), "f", "bytes")
        nodes = every.groupBy("d", F.expr(f"shiftright(f, {end} - d)").alias("bucket")).agg(F.sum("bytes").alias("bytes"))
        nodes = stored(nodes)
        # Bytes never grow with depth, so the buckets over the limit are the inner nodes of the directory.
        over = nodes.filter((F.col("bytes") > limit) & (F.col("d") < HASH_BITS)).select(F.col("d").alias("pd"), F.col("bucket").alias("pb"))
        inside = nodes.withColumns({"pd": F.col("d") - 1, "pb": F.expr("shiftright(bucket, 1)")})
        is_leaf = (F.col("bytes") <= limit) | (F.col("d") == HASH_BITS)
        below = inside.filter(is_leaf & (F.col("d") > start)).join(over, ["pd", "pb"], "left_semi")
        found = below.unionByName(inside.filter(is_leaf & (F.col("d") == start))).select(F.col("d").alias("shard_depth"), "bucket")
        leaves = found if leaves is None else leaves.unionByName(found)
        still = over.filter(F.col("pd") == end).select(F.col("pb").alias("s"))
        if end == HASH_BITS or still.isEmpty():
            return leaves
        rows = rows.withColumn("s", F.expr(prefix("h", str(end)))).join(still, "s", "left_semi").drop("s")
        start = end


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = MAX_SHARD_BYTES,
) -> DataFrame:
    """Documents with `shard` (the bits of the bucket; empty for the whole table), `shard_depth` and `n_bytes`.

    The hash is over id and text, so a shard does not depend on how the table is dealt. Every shard holds at
    most `limit` UTF-8 bytes of text. The only larger ones hold what no hash bit can part: one document
    over the limit, or repeated rows equal in id and text. NULL texts have no bytes; NULL ids hash like an
    empty string. Input columns named like a result are replaced.
    """
    results = ["shard", "shard_depth", "n_bytes"]
    t = F.col(text)
    rows = docs.drop(*[c for c in results if c != text]).withColumns({
        "__h": row_hash(F.col(id_col), F.md5(F.coalesce(t, F.lit("")))), "n_bytes": F.coalesce(F.octet_length(t), F.lit(0)).cast("long")})
    sized = stored(rows.select(F.col("__h").alias("h"), F.col("n_bytes").alias("bytes")))
    leaves = stored(shard_directory(sized, limit))
    # Leaves are looked up through the finest depth: each row has one bucket at each depth that occurs.
    depths = [r[0] for r in leaves.select("shard_depth").distinct().collect()]  # at most HASH_BITS + 1 values
    if not depths:
        return rows.withColumns({"shard": F.lit(""), "shard_depth": F.lit(0)}).drop("__h")
    top = min(depths)
    directory = leaves.select(
        F.expr(f"shiftright(bucket, shard_depth - {top})").alias("__top"), F.col("shard_depth").alias("__d"), F.col("bucket").alias("__b"))
    packed = directory.groupBy("__top").agg(F.collect_list(F.struct("__d", "__b")).alias("__leaves"))
    found = F.expr(f"filter(__leaves, x -> shiftright(__h, {HASH_BITS} - x.__d) = x.__b)[0]")
    joined = rows.withColumn("__top", F.expr(prefix("__h", str(top)))).join(packed, "__top").withColumn("__leaf", found)
    bits = F.expr("substring(lpad(bin(__leaf.__b), 64, '0'), 65 - __leaf.__d)")
    return joined.withColumns({"shard": bits, "shard_depth": F.col("__leaf.__d")}).drop("__h", "__top", "__leaves", "__leaf")
