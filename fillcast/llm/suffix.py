"""Exact substring dedup by merging shard Burrows-Wheeler transforms.

Strings of 200 bytes that occur twice or more are found in groups that fit a task. Every 200-byte window has
an anchor, the smallest hash among its 40-byte grams; equal windows have equal anchors, so windows only need
to be compared within the group of an anchor. Consecutive windows with one anchor form a segment, and equal
segments are one with a weight. Within a task the segments of its groups are dealt to shards, each shard gets
its transform (the order of its suffixes, with the symbols that precede them), and the transforms are merged:
the interleave of the shards starts at depth 0, and each round takes the preceding symbol of every suffix in
the present order and distributes the suffixes stably by it, which is the interleave one symbol deeper. A
symbol is eight bytes, so 25 rounds reach 200. Boundaries that appear in a round give the common prefixes;
intervals of one suffix are final and leave the merge; intervals that are left after the last round are the
repeated strings. No suffix is sorted again.

Anchors with very many different segments are first split by what all windows at nearly the same offset to
the anchor share (161, then 191, then 200 bytes), until every group is small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.llm.common import KEY, as_bytes, keyed, on_key
from fillcast.operators.ordered import stored

WIDTH = 200
GRAM = 40
SYMBOL = 8
#: Windows in a segment, at most: longer runs of one anchor (periodic text) are cut.
RUN_WINDOWS = 1024
#: Different segments in a group, beyond which it is split.
GROUP_SEGMENTS = 2000
#: Bytes of segments merged at once, and in one shard.
MERGE_BYTES, SHARD_BYTES = 3 << 20, 1 << 19
#: Offsets to the anchor that share a key, by round of splitting.
SPLITS = (40, 10, 1)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the 40 bytes at each position, mixed."""
    h, factor, span = raw.astype(np.uint64) + np.uint64(1), int(_FACTOR), 1
    parts = {1: h}
    while span * 2 <= GRAM:
        power = np.uint64(pow(factor, span, 1 << 64))
        h = h[:-span] * power + h[span:]
        span *= 2
        parts[span] = h
    rest = GRAM - span  # 8 of 40: a second, shorter hash completes the gram
    n = len(raw) - GRAM + 1
    out = parts[span][:n] * np.uint64(pow(factor, rest, 1 << 64)) + parts[rest][span:span + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _window_anchors(grams: np.ndarray) -> np.ndarray:
    """The smallest gram hash in each window."""
    need, span, low = WIDTH - GRAM + 1, 1, grams
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = need - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def segments(body: bytes) -> list[tuple[int, int, int, int, int]]:
    """Rows (anchor, segment hash, start, windows, gram repeats in itself) for a text."""
    out = []
    for base in range(0, max(0, len(body) - WIDTH + 1), _PIECE):
        raw = np.frombuffer(body, np.uint8, count=min(len(body) - base, _PIECE + WIDTH - 1), offset=base)
        grams = _gram_hashes(raw)
        anchors = _window_anchors(grams)
        cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), len(anchors)]
        seen = anchors.view(np.int64)
        for a, b in zip(starts, ends, strict=True):
            again = int(np.count_nonzero(grams[a:b + WIDTH - GRAM] == anchors[a]) > 1)
            for s in range(a, b, RUN_WINDOWS):
                n = min(b, s + RUN_WINDOWS) - s
                at = base + s
                out.append((int(seen[a]), xxhash.xxh3_64_intdigest(body[at:at + n + WIDTH - 1]) - (1 << 63), at, n, again))
    return out


def _ranges(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of True, one after the other."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges.tolist()


# -- the merge ------------------------------------------------------------------

def _symbols(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number."""
    n = len(text) - SYMBOL + 1
    out = np.zeros(n, np.uint64)
    for k in range(SYMBOL):
        out = (out << np.uint64(8)) | text[k:k + n].astype(np.uint64)
    return out


def shard_transform(text: np.ndarray, at: np.ndarray, depth: int = 64) -> np.ndarray:
    """The order of the suffixes that begin at `at`, by their first `depth` bytes (ties in text order).

    With the symbols that precede them, read in this order, this is the shard's transform.
    """
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    return np.argsort(np.ascontiguousarray(view[at]).view(f"S{depth}").ravel(), kind="stable")


def merge_transforms(bodies: list[bytes], windows: list[int], groups: list[int]) -> list[np.ndarray]:
    """For each segment, which of its windows equal another window of its group, by interleave refinement."""
    text = np.frombuffer(b"".join(bodies) + bytes(64), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = np.array(windows, np.int64)
    of = np.repeat(np.arange(len(bodies)), count)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + starts[of]
    shard = starts[of] // SHARD_BYTES
    # The interleave at depth 0: shard after shard, each in its own order, within each group.
    orders = [np.flatnonzero(shard == s) for s in np.unique(shard)]
    entry = np.concatenate([o[shard_transform(text, begin[o] + WIDTH)] for o in orders])
    block = np.array(groups, np.int64)[of][entry]
    order = np.argsort(block, kind="stable")
    entry, block = entry[order], block[order]
    symbol = _symbols(text)
    position = begin[entry] + WIDTH
    for _ in range(WIDTH // SYMBOL):
        position = position - SYMBOL
        before = symbol[position]
        order = np.argsort(before, kind="stable")
        before, block, entry, position = before[order], block[order], entry[order], position[order]
        fresh = np.ones(len(entry), bool)
        fresh[1:] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(fresh)
        # The order within a symbol is that of the round before, so equal (symbol, block) are neighbours.
        last = np.ones(len(entry), bool)
        last[:-1] = fresh[1:]
        shared = ~(fresh & last)
        block, entry, position = block[shared], entry[shared], position[shared]
        if not len(entry):
            break
    found = np.zeros(len(of), bool)
    found[entry] = True
    return np.split(found, np.cumsum(count)[:-1])


def _merge_groups(batches):
    """Rows come sorted by group; merge about MERGE_BYTES of whole groups at a time."""
    rows, size = [], 0

    def flush(rows):
        groups, keys = [], {}
        for r in rows:
            groups.append(keys.setdefault((r[0], r[1]), len(keys)))
        crowd = np.bincount(groups)
        flags: list[np.ndarray | None] = [None] * len(rows)
        busy = [i for i, r in enumerate(rows) if crowd[groups[i]] > 1 or r[7]]
        if busy:
            for i, f in zip(busy, merge_transforms([rows[i][8] for i in busy], [rows[i][5] for i in busy], [groups[i] for i in busy]), strict=True):
                flags[i] = f
        out = ([], [], [])
        for r, f in zip(rows, flags, strict=True):
            if r[6] > 1:  # equal segments elsewhere: all of its windows repeat
                spans = [0, r[5]]
            else:
                spans = _ranges(f) if f is not None else []
            if spans:
                out[0].append(r[2])
                out[1].append(r[3])
                out[2].append([x + r[4] for x in spans])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))],
            names=["anchor", "seg", "ranges"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(9)]
        for r in zip(*cols, strict=True):
            if size >= MERGE_BYTES and (rows[-1][0], rows[-1][1]) != (r[0], r[1]):
                yield flush(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[8])
    if rows:
        yield flush(rows)


_ROW = "g1 bigint, g2 bigint, anchor bigint, seg bigint, base int, windows int, weight bigint, again int, body binary"


def _split_rows(step: int):
    """Cut each segment where the offset to the anchor passes a multiple of `step`, keyed by what is shared there."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for _, _, anchor, seg, base, n, weight, again, body in zip(*cols, strict=True):
                grams = _gram_hashes(np.frombuffer(body, np.uint8)).view(np.int64)
                hits = np.flatnonzero(grams == anchor)
                at = hits[np.searchsorted(hits, np.arange(n))]  # first anchor in each window
                place = (at - np.arange(n)) // step
                cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                    r, first = int(place[a]), int(at[a])
                    common = body[first - r * step:first - r * step - step + 1 + WIDTH]
                    d = xxhash.xxh3_128_digest(common + bytes([r]))
                    row = (
                        int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True),
                        anchor, seg, base + a, b - a, weight, again, body[a:b - 1 + WIDTH])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["g1", "g2", "anchor", "seg", "base", "windows", "weight", "again", "body"])

    return run


def repeated_ranges(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents with row keys, and rows (KEY, spans): the byte ranges of repeated strings per document."""
    rows = keyed(docs, id_col, text).withColumn("__raw", F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def anchors(batches):
        for batch in batches:
            which, out = [], [[], [], [], [], []]
            for i, body in enumerate(as_bytes(batch.column(len(KEY)))):
                found = segments(body)
                which.extend([i] * len(found))
                for c, v in zip(out, zip(*found, strict=True), strict=False):
                    c.extend(v)
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(len(KEY))]
                + [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                names=[*KEY, "anchor", "seg", "start", "windows", "again"])

    kind = rows.schema["__id"].dataType.simpleString()
    found = stored(rows.select(*KEY, "__raw").mapInArrow(
        anchors, f"__id {kind}, __h1 bigint, __h2 int, anchor bigint, seg bigint, start int, windows int, again int"))
    shared = found.groupBy("anchor").agg(F.sum(F.lit(1) + F.col("again")).alias("n")).filter("n > 1").select("anchor")
    places = stored(found.join(shared, "anchor", "left_semi"))
    distinct = stored(places.groupBy("anchor", "seg", "windows").agg(
        F.count("*").alias("weight"), F.max("again").alias("again"), F.min(F.struct(*KEY, "start")).alias("first")))
    crowded = distinct.groupBy("anchor").count().filter(F.col("count") > GROUP_SEGMENTS).select("anchor", F.lit(1).alias("crowded"))
    wanted = distinct.join(crowded, "anchor", "left").select(
        *[F.col(f"first.{k}").alias(k) for k in KEY],
        F.struct("anchor", "seg", F.col("first.start").alias("start"), "windows", "weight", "again", F.coalesce("crowded", F.lit(0)).alias("crowded")).alias("w"))
    per_doc = wanted.groupBy(*KEY).agg(F.collect_list("w").alias("wanted"))
    # Rows with one key have one text: any of them serves.
    texts = on_key(rows.select(*KEY, "__raw"), per_doc, "inner")

    def fetch(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for body, own in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in own:
                    row = (w["anchor"], w["seg"], w["windows"], w["weight"], w["again"], w["crowded"], body[w["start"]:w["start"] + w["windows"] + WIDTH - 1])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["anchor", "seg", "windows", "weight", "again", "crowded", "body"])

    bodies = stored(texts.select("__raw", "wanted").mapInArrow(
        fetch, "anchor bigint, seg bigint, windows int, weight bigint, again int, crowded int, body binary"))
    names = [c.split()[0] for c in _ROW.split(", ")]
    ready = bodies.withColumns({"g1": F.col("anchor"), "g2": F.lit(0).cast("bigint"), "base": F.lit(0)})
    groups = ready.filter("crowded = 0").select(*names)
    full = ready.filter("crowded = 1").select(*names)
    whole = None
    for step in SPLITS if not full.isEmpty() else ():
        parts = stored(full.mapInArrow(_split_rows(step), _ROW))
        if step == 1:  # the key is the window: nothing is left to compare
            repeated = parts.groupBy("g1", "g2").agg(F.sum("weight").alias("n")).filter("n > 1").select("g1", "g2")
            whole = parts.join(repeated, ["g1", "g2"], "left_semi").select(
                "anchor", "seg", F.array("base", F.col("base") + F.col("windows")).alias("ranges"))
            break
        sizes = stored(parts.groupBy("g1", "g2").count())
        # A part alone in its group repeats nothing unless its segment does.
        small = sizes.filter(F.col("count") <= GROUP_SEGMENTS).select("g1", "g2")
        large = sizes.filter(F.col("count") > GROUP_SEGMENTS).select("g1", "g2")
        groups = groups.unionByName(parts.join(small, ["g1", "g2"], "left_semi").select(*names))
        full = parts.join(large, ["g1", "g2"], "left_semi").select(*names)
        if full.isEmpty():
            break
    merged = groups.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(
        _merge_groups, "anchor bigint, seg bigint, ranges array<int>")
    repeats = merged if whole is None else merged.unionByName(whole)
    spans = (
        places.join(stored(repeats), ["anchor", "seg"])
        .select(*KEY, F.transform("ranges", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, WIDTH - 1).otherwise(0)).alias("r")))
    return rows, spans.groupBy(*KEY).agg(F.flatten(F.collect_list("r")).alias("spans"))


def _merged(flat: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, bodies: bool = True) -> DataFrame:
    """Documents with `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `removed_spans` and, if wanted, `kept`.

    Every byte covered by a 200-byte string that starts at two places or more of the input goes; overlaps and
    places in one document count, matches never cross documents. `removed_spans` are maximal byte ranges
    [from, to); `kept` holds the other bytes, which need not be valid UTF-8. NULL is empty. Shorter texts lose
    nothing; repeated rows are each other's copies. Input columns named like a result are replaced.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept"]
    source = docs if keep is None else docs.select(*dict.fromkeys([*keep, id_col, text]))
    rows, spans = repeated_ranges(source.drop(*[c for c in results if c not in (text, id_col)]), id_col, text)
    names = [c for c in (source.columns if keep is None else keep) if c not in results]
    joined = on_key(rows, spans, "left").select(*names, "__raw", "spans")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for body, flat in zip(as_bytes(batch.column(len(names))), batch.column(len(names) + 1).to_pylist(), strict=True):
                gone = _merged(flat or [])
                parts, last = [], 0
                for a, b in gone:
                    parts.append(body[last:a])
                    last = b
                parts.append(body[last:])
                rest = b"".join(parts)
                row = (len(body), len(body) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [list(x) for x in gone], rest if bodies else None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[*names, *results])

    fields = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("kept", T.BinaryType())]
    done = joined.mapInArrow(run, T.StructType([joined.schema[c] for c in names] + fields))
    return done if bodies else done.drop("kept")
