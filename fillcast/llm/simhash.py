"""SimHash near-dedup through segment popcounts.

A fingerprint is cut into segments, and the vector of the segments' bit counts is its embedding. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so pairs at
two bits or fewer lie at most two apart. Both then have a vector at distance one or less between them:
each fingerprint visits its own grid cell and the cells one step away, and a linked pair meets in a cell.
Cells with two visitors are verified by the exact Hamming distance. In fuller cells the visitors are
grouped by the fingerprints half-way (one bit or none from each): all visitors of such a midpoint are
within two bits of each other, so a star to the smallest one links the same sets as all pairs would.

Near copies for the pipeline (`near_duplicate_groups`) take the same cells as a first pass and buckets of minimum
hashes for copies that differ too much for two bits; candidates are then checked on their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.llm.common import KEY, keyed, on_key, with_text_columns, word_pattern
from fillcast.llm.components import connected_components
from fillcast.operators.ordered import stored

SHINGLE_WORDS = 3
SEED = 42


def _shingles(body: bytes, n: int) -> list[bytes]:
    tokens = word_pattern.findall(body.lower())
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    return [joined[a:b] for a, b in zip(starts[:-n].tolist(), (starts[n:] - 1).tolist(), strict=True)]


def fingerprint(body: bytes, n: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """Eight bytes: a bit is set if more than half of the shingles' hashes have it."""
    shingles = _shingles(body, n)
    if not shingles:
        return bytes(8)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    bits = np.unpackbits(hashes.byteswap().view(np.uint8)).reshape(-1, 64)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).tobytes()


def add_fingerprints(docs: DataFrame, text: str = "text", n: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Documents with `fp`, the 64-bit SimHash of their word shingles as a long; no words give zero."""

    def start():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array([int.from_bytes(fingerprint(t, n), "big", signed=True) for t in texts], pa.int64())]

        return compute

    return with_text_columns(docs, text, [T.StructField("fp", T.LongType())], start, keep)


def hamming_edges(fps: DataFrame, bits: int = 64, segment_bits: int = 4) -> DataFrame:
    """Edges (a, b), a < b, that connect distinct `fp` within two bits of each other (see the module text).

    Every edge is a true link, and linked fingerprints are in one component. Only the low `bits` bits are
    compared, in segments of `segment_bits`; equal higher bits are a band that keeps tables apart.
    """
    base = sum(1 << s for s in range(0, bits, segment_bits))
    low = (1 << bits) - 1
    full = (1 << segment_bits) - 1
    step = ", ".join(str(s) for s in range(0, bits, segment_bits))
    band = "0L" if bits == 64 else f"(fp & {~low}L)"
    own = "fp" if bits == 64 else f"(fp & {low}L)"
    counts = " + ".join(f"(shiftrightunsigned({{0}}, {j}) & {base}L)" for j in range(segment_bits))
    visits = (
        f"concat(array(v),"
        f" transform(filter(array({step}), s -> (shiftrightunsigned(v, s) & {full}) < {segment_bits}), s -> v + shiftleft(1L, s)),"
        f" transform(filter(array({step}), s -> (shiftrightunsigned(v, s) & {full}) > 0), s -> v - shiftleft(1L, s)))")
    vector = f"(({counts.format(own)}) | {band})"
    # One exchange on (fp, c) serves the counts and the look-back: all three uses below are one query.
    cells = (
        fps.select("fp").withColumn("v", F.expr(vector)).select("fp", F.explode(F.expr(visits)).alias("c")).repartition("c"))
    met = cells.groupBy("c").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    pairs = met.filter("n = 2 AND bit_count(a ^ b) <= 2").select("a", "b")
    # Half-way fingerprints of a visitor inside a cell: itself at home, else one bit of the segment that differs.
    inside = (
        f"CASE WHEN c = v THEN array(fp) ELSE transform(filter("
        f"sequence(bit_count(abs(c - v) - 1), bit_count(abs(c - v) - 1) + {segment_bits - 1}),"
        f" s -> (shiftrightunsigned(fp, s) & 1) = CASE WHEN c > v THEN 0 ELSE 1 END), s -> fp ^ shiftleft(1L, s)) END")
    mids = stored(
        cells.join(met.filter("n > 2").select("c").hint("shuffle_hash"), "c", "left_semi")
        .withColumn("v", F.expr(vector)).select("fp", F.explode(F.expr(inside)).alias("m")).unionByName(
            pairs.select(F.col("a").alias("fp"), F.col("b").alias("m")).withColumn("pair", F.lit(True)), allowMissingColumns=True))
    pairs = mids.filter("pair").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    mids = mids.filter("pair IS NULL").select("fp", "m")
    # A midpoint has one cell, so it is a key by itself. Two rows of a star are needed, its smallest and each other.
    smallest = mids.groupBy("m").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("m", "a")
    stars = mids.join(smallest, "m").filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each document.

    Fingerprints link at two or fewer differing bits; `component_id` is the smallest id reachable. Only
    distinct fingerprints are compared, so a group of copies costs one of them. Documents without words
    have fingerprint zero and link like any other. NULL ids get a component but never name one; repeated
    rows give repeated answers; an empty table gives none.
    """
    rows = stored(add_fingerprints(docs, text, n, keep=[id_col]))
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("__least"))
    roots = connected_components(hamming_edges(fps))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named)
    groups = named.groupBy("root").agg(F.min("__least").alias("component_id"))
    of_fp = named.join(groups, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near copies by shingle similarity ------------------------------------------

MIN_SIMILARITY = 0.8
SIMILAR_SHINGLE_WORDS = 5
#: Texts meet in a bucket if all BAND_ROWS minimum hashes of one of BANDS bands are equal: at similarity 0.8 all but
#: 2 in 10,000 pairs do, whatever was changed in the text.
BANDS, BAND_ROWS = 16, 4
#: Rounds in which all members of a bucket are compared with one of them, and the size up to which buckets that are
#: still not one group are then compared pair by pair; larger ones are joined on rare shingles (see `_rare_pairs`).
ROUNDS, SMALL_BUCKET = 2, 16
#: Texts of a tile when the texts of a shingle are paired.
_TILE = 1_000
#: Shingles whose minimum hashes are taken at once.
_SLICE = 20_000

_multipliers = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_mixer = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(body: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(b" ".join(word_pattern.findall(body.lower())))
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def _shingle_hashes(body: bytes, n: int) -> np.ndarray:
    own = set(_shingles(body, n))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in own), np.uint64, len(own)).view(np.int64))


def _fingerprint_of(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint64).byteswap().view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big", signed=True)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, from the minimum hashes of a text's shingles; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    own = hashes.view(np.uint64)
    for i in range(0, len(own), _SLICE):
        np.minimum(least, (own[i:i + _SLICE, None] * _multipliers).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = (keys ^ rows[:, k]) * _mixer
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def _signed(rows: DataFrame, text: str, n: int) -> DataFrame:
    """Row keys with the text's word hash (w1, w2), number of shingles, SimHash and band keys."""
    fields = [
        T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def start():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            words = [_word_hash(t) for t in texts]
            own = [_shingle_hashes(t, n) for t in texts]
            return [
                pa.array([w[0] for w in words], pa.int64()), pa.array([w[1] for w in words], pa.int64()), pa.array([len(h) for h in own], pa.int32()),
                pa.array([_fingerprint_of(h) if len(h) else 0 for h in own], pa.int64()), pa.array([band_keys(h) for h in own], pa.list_(pa.int64()))]

        return compute

    return with_text_columns(rows, text, fields, start, keep=KEY)


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (x, y) that join all texts whose SimHash fingerprints link (see the module text), through one text of each fingerprint."""
    worded = texts.filter("size > 0")
    fps = stored(worded.groupBy("fp").agg(F.min("node").alias("x"), F.count("*").alias("k")))
    edges = hamming_edges(fps.select("fp"))
    far = edges.join(fps.select(F.col("fp").alias("a"), "x"), "a").join(fps.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    same = worded.select("fp", F.col("node").alias("y")).join(fps.filter("k > 1").select("fp", "x"), "fp").filter("x <> y").select("x", "y")
    return far.unionByName(same)


def _bucket_members(texts: DataFrame) -> DataFrame:
    """Rows (b, node, size, place) of the buckets with several members; `place` puts texts that meet many others first."""
    entries = texts.select("node", "size", F.explode("bands").alias("b"))
    met = entries.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1")
    entries = stored(entries.join(met, "b"))
    crowd = entries.groupBy("node").agg((-F.sum("n")).alias("crowd"))
    return stored(entries.join(crowd, "node").select("b", "node", "size", F.struct("crowd", "node").alias("place")))


def _similar_sizes(least: float, a: str, b: str) -> str:
    return f"least({a}, {b}) >= {least} * greatest({a}, {b}) - 1e-6"


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _rare_pairs(members: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) of `members` in different groups, with all pairs whose similarity is `least` or more among them.

    Shingles are put in one order, those of the fewest texts first. Two texts that similar share one of the first
    `size - least * size + 1` shingles of both, so texts are joined on these, and what they share there at the latest
    bounds their similarity. The texts of the largest group of a shingle are paired with those of other groups only.
    """
    own = members.distinct().join(shingles, "node").select("node", "size", "root", F.explode("own").alias("s"))
    own = stored(own)
    often = own.groupBy("s").agg(F.count("*").alias("n"))
    ranked = own.join(often, "s").groupBy("node", "size", "root").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("own"))
    first = F.expr(f"slice(own, 1, CAST(size - ceil({least} * size - 1e-6) + 1 AS INT))")
    entries = ranked.select("node", "size", "root", F.posexplode(first).alias("at", "e")).filter("e.n > 1")
    entries = stored(entries.select("node", "size", "root", "at", F.col("e.s").alias("s")))
    largest = entries.groupBy("s", "root").agg(F.count("*").alias("n")).groupBy("s").agg(
        F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("of_top")).filter("of_top < n")
    entries = stored(entries.join(largest.select("s", "top", F.expr(f"CAST(ceil((n - of_top) / {_TILE}) AS INT)").alias("tiles")), "s"))
    few = entries.filter("root <> top").withColumn("tile", F.expr("pmod(xxhash64(node), tiles)").cast("int"))
    every = entries.withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    met = few.alias("x").join(every.alias("y"), F.expr(
        "x.s = y.s AND x.tile = y.tile AND x.root <> y.root AND (y.root = y.top OR x.node < y.node)"
        f" AND {_similar_sizes(least, 'x.size', 'y.size')}"
        f" AND least(x.size - x.at, y.size - y.at) * (1 + {least}) >= {least} * (x.size + y.size) - 1e-6"))
    return met.select(F.expr("least(x.node, y.node) AS x"), F.expr("greatest(x.node, y.node) AS y")).distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SIMILAR_SHINGLE_WORDS, least: float = MIN_SIMILARITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Rows (__id, __h1, __h2, group, first): every document key with its group, and whether it comes first.

    Texts with equal word sequences are one text, and empty ones are too. Others link if the Jaccard similarity of
    their `n`-word shingles is `least` or more, checked on all shingles; groups are the components of the links
    found. Two kinds of candidates are checked: texts whose SimHash fingerprints link through popcount cells, and
    texts that meet in a bucket of minimum hashes. In each round the members of a bucket are compared with the member
    that meets the most texts, if they are not in one group with it yet, so a round makes a pair a member at most,
    however large the bucket. Buckets that are not one group after all rounds are then joined exactly: small ones pair
    by pair, the texts of larger ones on their rarest shingles. So no two similar texts that meet in a bucket stay apart.
    The first of a group has its smallest (id, text hash); NULL ids come last.
    """
    rows = keyed(docs.select(id_col, text), id_col, text)
    signed = stored(_signed(rows, text, n))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__h1", "__h2")).alias("first")
    distinct = signed.groupBy("w1", "w2").agg(first, *[F.any_value(c).alias(c) for c in ("size", "fp", "bands")])
    texts = stored(distinct.withColumn("node", F.monotonically_increasing_id()))
    members = _bucket_members(texts)
    near = stored(_fingerprint_pairs(texts))

    # Shingles of the texts that are a candidate at all, once each: of rows equal in key one is enough.
    needed = members.select("node").unionByName(near.select(F.explode(F.array("x", "y")).alias("node"))).distinct()
    keys = texts.join(needed, "node").select("node", *[F.col(f"first.{k}").alias(k) for k in KEY])
    bodies = on_key(rows, keys, "inner").select("node", F.coalesce(F.col(text), F.lit("")).alias("body"))

    def start():
        return lambda bodies: [pa.array([_shingle_hashes(b, n) for b in bodies], pa.list_(pa.int64()))]

    shingles = stored(with_text_columns(bodies, "body", [T.StructField("own", T.ArrayType(T.LongType()))], start, keep=["node"]).dropDuplicates(["node"]))

    def verified(batches):
        for batch in batches:
            left, right = (batch.column(i) for i in (2, 3))
            ends = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (left, right)]
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (v[o[i]:o[i + 1]] for o, v in ends)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = both > 0 and both >= least * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    def links(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.join(shingles.select(F.col("node").alias("y"), F.col("own").alias("of_y")), "y")
            .join(shingles.select(F.col("node").alias("x"), F.col("own").alias("of_x")), "x"))
        return stored(both.select("x", "y", "of_x", "of_y").mapInArrow(verified, "a bigint, b bigint"))

    linked, tried, roots = None, near, None
    for k in range(rounds):
        placed = _labelled(members, roots)
        lead = F.struct("place", "size", "root")
        leads = placed.groupBy("b").agg(F.min(lead).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"))
        leads = leads.filter("low < high").select("b", "lead")
        met = stored(placed.join(leads, "b").filter("place > lead.place"))
        pairs = met.filter("root <> lead.root AND " + _similar_sizes(least, "size", "lead.size")).select(
            F.col("lead.place.node").alias("x"), F.col("node").alias("y")).distinct()
        pairs = stored(pairs.unionByName(near).distinct() if k == 0 else pairs.join(tried, ["x", "y"], "left_anti"))
        tried = pairs if k == 0 else tried.unionByName(pairs)
        found = links(pairs)
        linked = found if linked is None else linked.unionByName(found)
        roots = stored(connected_components(linked).withColumnRenamed("node", "of").select(F.col("of").alias("node"), "root"))
        members = met.select("b", "node", "size", "place")
    placed = _labelled(members, roots)
    mixed = placed.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_ = stored(placed.join(mixed, "b").select("b", "node", "size", "root", "n"))
    small = open_.filter(F.col("n") <= SMALL_BUCKET)
    rest = small.alias("x").join(small.alias("y"), F.expr(
        "x.b = y.b AND x.node < y.node AND x.root <> y.root AND " + _similar_sizes(least, "x.size", "y.size")))
    rest = rest.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
    rare = _rare_pairs(open_.filter(F.col("n") > SMALL_BUCKET).select("node", "size", "root"), shingles, least)
    # Pairs may have been tried in either order.
    done = tried.select(F.expr("least(x, y) AS x"), F.expr("greatest(x, y) AS y"))
    rest = rest.unionByName(rare).distinct().join(done, ["x", "y"], "left_anti")
    found = links(stored(rest))
    roots = connected_components(linked.unionByName(found) if linked is not None else found)
    grouped = texts.join(roots, "node", "left").select("w1", "w2", F.coalesce("root", "node").alias("group"), "first")
    leads = grouped.groupBy("group").agg(F.min("first").alias("lead"))
    of_text = stored(grouped.select("w1", "w2", "group").join(leads, "group"))
    own = F.struct(F.col("__id").isNull().alias("none"), "__id", "__h1", "__h2")
    return signed.select("w1", "w2", *KEY).join(of_text, ["w1", "w2"]).select(*KEY, "group", own.eqNullSafe(F.col("lead")).alias("first"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with the input's columns; see `near_duplicate_groups`.

    Rows that repeat the group's first row in id and text go too.
    """
    firsts = near_duplicate_groups(docs, id_col, text).filter("first").groupBy(*KEY).agg(F.count("*").alias("__n"))
    firsts = stored(firsts)
    rows = keyed(docs, id_col, text)
    single = on_key(rows, firsts.filter("__n = 1").drop("__n"), "left_semi")
    repeated = on_key(rows, firsts.filter("__n > 1").drop("__n"), "left_semi").dropDuplicates(KEY)
    return single.unionByName(repeated).select(*docs.columns)
