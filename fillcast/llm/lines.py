"""Line dedup: lines found in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.llm.common import KEY, SPACE, ascii_lower, keyed, on_key

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Documents with `n_lines`, `n_dropped` and `kept_text`.

    A line's key is the line stripped and with A-Z lower-cased. Keys of at least `min_chars` characters in
    at least `min_docs` documents (rows) lose their lines in every document. NULL and empty texts are one
    empty line, which is kept as its key is too short. Repeated rows count as documents of their own.
    Input columns named like a result are replaced; an empty table gives an empty result.

    Only hashes and positions of lines are shuffled for the counts; each document crosses the network
    once, when its dropped positions arrive.
    """
    rows = keyed(docs.drop("n_lines", "n_dropped", "kept_text"), id_col, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    keys = F.transform(lines, line_key)
    own = rows.select(F.explode(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))).alias("k"))
    frequent = (
        own.select(F.xxhash64("k").alias("l1"), F.hash("k").alias("l2"))
        .groupBy("l1", "l2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("l1", "l2"))
    at = rows.select(*KEY, F.posexplode(keys).alias("pos", "k")).filter(F.length("k") >= min_chars)
    dropped = (
        at.select(*KEY, "pos", F.xxhash64("k").alias("l1"), F.hash("k").alias("l2"))
        .join(frequent, ["l1", "l2"], "left_semi")
        .groupBy(*KEY).agg(F.collect_set("pos").alias("__dropped")))
    joined = on_key(rows, dropped, "left").withColumn("__lines", lines)
    kept = F.array_except(
        F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce(F.col("__dropped"), F.array().cast("array<int>")))
    whole = F.col("__dropped").isNull()
    return (
        joined.withColumn("__kept", kept)
        .withColumns({
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"),
            "kept_text": F.when(whole, F.coalesce(F.col(text), F.lit(""))).otherwise(
                F.array_join(F.transform("__kept", lambda p: F.col("__lines")[p]), "\n"))})
        .drop(*KEY, "__lines", "__dropped", "__kept"))
