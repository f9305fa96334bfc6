"""The trie of shared conversation openings, from sorted turn sequences and sparse tables of their LCPs.

A turn is a code of 20 bytes (16 of a hash of role and text, 4 of its number of words), a conversation the
codes of its turns one after the other. Distinct conversations are sorted by range partitions, so the members
of every prefix stand side by side. In a partition the LCP of each row with the row before is known (the first
row's with the last one of the partition before), and a sparse table of range minima answers where a prefix
begins and ends: each candidate prefix searches its left and its right extent by halving steps, with no regard
to other candidates. All figures of a node are then differences of running totals over its interval. Prefixes
that reach over a border of partitions are few (those of the rows at the borders); their parts are added up
by a hash of the prefix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.llm.common import WORD
from fillcast.operators.ordered import saved, stored

#: Bytes of a turn's code, and of a prefix's name.
CODE, NAME = 20, 16
#: Turns of distinct conversations that a task sorts and searches at once, about.
PART_TURNS = 500_000
#: Ids of equal conversations are joined to texts within spans of so many ids.
ID_SPAN = 65_536

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """40 hexadecimal digits: equal for turns of equal role and text, the last 8 hold the number of words."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    body = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    return F.concat(F.substring(F.sha2(body, 256), 1, 32), F.lpad(F.hex(F.regexp_count(t, F.lit(WORD)).cast("long")), 8, "0"))


def turn_sequences(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Rows (conv_id, codes): each conversation's turn codes in order of `turn`, NULL first, ties by code.

    Texts are replaced by codes before the shuffle. A conversation is one row of 40 bytes a turn; rows without a
    conversation are left out, repeated rows stay turns of their own.
    """
    own = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("t"), turn_code(F.col(role), F.col(text)).alias("c")).alias("x"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.col("x.c").alias("codes"))


def with_shared_heads(sequences: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Rebuild conversations on the openings of the base conversations, whose ids `every` divides.

    Conversation c begins with the first h turns of conversation c - c % every (all if it has fewer, none if there
    is no such conversation) and goes on with its own turns after its first h; h = crc32(decimal c) % (most + 1).
    """
    heads = sequences.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("__base"), F.slice("codes", 1, most).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    based = sequences.withColumn("__base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "__base", "left")
    head = F.coalesce(F.slice("__head", F.lit(1), h), F.array().cast("array<string>"))
    return based.select("conv_id", F.concat(head, F.slice("codes", h + 1, F.size("codes"))).alias("codes"))


def _folded(batches):
    """Parts of one key, in order of their ids, become one row with the hash of all ids; a key's ids are never held at once."""
    key, n, least, ends = None, 0, 0, None
    for batch in batches:
        out = []
        for k, part_n, part_least, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if ends is not None:
                    out.append((key, n, least, ends.hexdigest()))
                key, n, least, ends = k, 0, part_least, hashlib.sha256()
            else:
                ends.update(b",")
            n, least = n + part_n, min(least, part_least)
            ends.update(ids.encode())
        if out:
            yield _group_rows(out)
    if ends is not None:
        yield _group_rows([(key, n, least, ends.hexdigest())])


def _group_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n", "least", "ends"])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """Rows (key, n, least, ends): distinct sequences, how many conversations have each, the smallest, and the hash of all."""
    keyed = sequences.select("conv_id", F.unhex(F.array_join("codes", "")).alias("key"))
    span = F.col("conv_id") - F.pmod("conv_id", F.lit(ID_SPAN))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    parts = keyed.groupBy("key", span.alias("span")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "span").select("key", "n", "least", "ids").mapInArrow(
        _folded, "key binary, n bigint, least bigint, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """The number of turns two sequences begin with in common."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // CODE
    x, y = np.frombuffer(a, np.uint8, least), np.frombuffer(b, np.uint8, least)
    return int(np.argmax(x != y)) // CODE


def _ends_of_part(batches):
    """One row of a partition: its number, its first and its last sequence."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            last = batch.column(0)[batch.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())],
            names=["part", "first", "last"])


def _with_common(batches):
    for batch in batches:
        part, first, before = (batch.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([-1 if b is None else common_turns(a, b) for a, b in zip(first, before, strict=True)], pa.int64())],
            names=["part", "common"])


def border_lcps(ordered: DataFrame) -> list[tuple[int, int]]:
    """(part, LCP with the part before; -1 for the first) of all partitions with rows: two numbers a partition."""
    edges = ordered.select("key").mapInArrow(_ends_of_part, "part int, first binary, last binary")
    before = edges.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row a partition
    return sorted((r["part"], r["common"]) for r in before.mapInArrow(_with_common, "part int, common bigint").collect())


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2**k values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        low, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(low[:-half], low[half:]))
    return levels


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last row around row `at` that share its first `depth` turns, by halving steps over range minima."""
    n = len(levels[0])
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        run, low = 1 << k, levels[k]
        # Rows from `left - run` on share the turns if all LCPs of the rows after it, up to `left`, do.
        to = left - run
        go = (to >= 0) & (low[np.clip(to + 1, 0, len(low) - 1)] >= depth)
        left = np.where(go, to, left)
        to = right + run
        go = (to < n) & (low[np.clip(right + 1, 0, len(low) - 1)] >= depth)
        right = np.where(go, to, right)
    return left, right


def _prefix_names(key: bytes, most: int) -> list[bytes]:
    """Names of the first prefixes of a sequence, from the empty one to the one of `most` turns."""
    running = hashlib.sha256()
    names = [running.digest()[:NAME]]
    for d in range(most):
        running.update(key[d * CODE:(d + 1) * CODE])
        names.append(running.copy().digest()[:NAME])
    return names


NODE_SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends string, name binary, parent_name binary")


def part_nodes(keys: list[bytes], weight: np.ndarray, least: np.ndarray, ends: list[str], before: int, after: int) -> pa.Table:
    """The nodes over one partition's sorted distinct sequences; those that reach over its borders get names.

    `before` and `after` are the LCPs with the neighbouring partitions (-1: none).
    """
    n = len(keys)
    lens = np.fromiter(map(len, keys), np.int64, n) // CODE
    lcp = np.empty(n, np.int64)
    lcp[0] = before
    lcp[1:] = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
    levels, smallest = sparse_table(lcp), sparse_table(least)

    # Running word counts: words[first[i] + d] counts the first d turns of row i.
    first = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, CODE)[:, NAME:].copy().view(">u4").ravel().astype(np.int64)
    words = np.zeros(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    words[inner] = flat
    words = np.cumsum(words)
    words -= np.repeat(words[first[:-1]], lens + 1)
    total = words[first[1:] - 1]
    unseen = total - words[first[:-1] + np.maximum(lcp, 0)]  # words of the nodes that a row is the first to have

    at = np.repeat(np.arange(n), lens + 1)
    depth = np.arange(first[-1]) - np.repeat(first[:-1], lens + 1)
    left, right = extents(levels, at, depth)
    own = left == at  # one candidate of each node
    row, d, last = at[own], depth[own], right[own]
    index = np.cumsum(own) - 1  # of a candidate that is a node: its number
    new = (row > 0) | (d > before)

    def over(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last + 1] - sums[row]

    count = over(weight)
    leaf = np.concatenate([lcp[1:], [after]]) < lens
    level = np.floor(np.log2(last - row + 1)).astype(np.int64)
    conv = np.empty(len(row), np.int64)
    for k, low in enumerate(smallest):
        some = level == k
        conv[some] = np.minimum(low[row[some]], low[last[some] - (1 << k) + 1])
    above = words[first[row] + np.maximum(d - 1, 0)]  # words before the node's last turn
    top = np.where(new, total[row] - above, unseen[row])
    saved_tokens = over(weight * total) - count * above - (over(unseen) - unseen[row]) - top

    candidate = np.flatnonzero(own)
    parent = np.where(d > 0, index[first[left[np.maximum(candidate - 1, 0)]] + d - 1], -1)
    children = np.bincount(parent[new & (d > 0)], minlength=len(row))
    ended = new & (lens[row] == d)

    over_left, over_right = (row == 0) & (d <= before), (last == n - 1) & (d <= after)
    crossing = over_left | over_right
    names: list[bytes | None] = [None] * len(row)
    for which, key, most in ((over_left, keys[0], before), (over_right, keys[-1], after)):
        if most >= 0:
            known = _prefix_names(key, most)
            for i in np.flatnonzero(which).tolist():
                names[i] = known[d[i]]
    parents = parent.tolist()
    return pa.table({
        "conv_id": conv, "depth": d,
        "parent_conv_id": pa.array(conv[parent], mask=(parent < 0) | crossing[parent]),
        "n_convs": count, "n_children": children.astype(np.int64), "n_leaves": over(leaf.astype(np.int64)), "saved_tokens": saved_tokens,
        "ends": pa.array([ends[i] if e else None for i, e in zip(row.tolist(), ended.tolist(), strict=True)], pa.string()),
        "name": pa.array(names, pa.binary()),
        "parent_name": pa.array([names[p] if p >= 0 else None for p in parents], pa.binary())})


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """One row of each distinct prefix of the sequences (conv_id, codes), the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (the root has none), n_convs, n_children, n_leaves
    and saved_tokens of the subtree with its top, ends_sha256 of the members that end here. Copies of a
    conversation are counted before they are sorted. No sequences give no rows.
    """
    groups = stored(distinct_sequences(sequences))
    turns = groups.agg(F.sum(F.octet_length("key") + CODE)).first()[0] or 0
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // CODE // PART_TURNS + 1)
    # Checkpointed: the partitions, their order and their borders are now fixed.
    ordered = saved(groups.repartitionByRange(parts, "key").sortWithinPartitions("key"))
    borders = border_lcps(ordered)
    before = dict(borders)
    after = {p: common for (p, _), (_, common) in zip(borders, borders[1:])}

    def nodes(batches):
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            part = TaskContext.get().partitionId()
            found = part_nodes(
                table["key"].to_pylist(), table["n"].to_numpy(), table["least"].to_numpy(), table["ends"].to_pylist(), before[part], after.get(part, -1))
            yield from found.to_batches(max_chunksize=50_000)

    def whole_part(batches):
        held = [b for b in batches if b.num_rows]
        return nodes(held) if held else iter(())

    found = stored(ordered.mapInArrow(whole_part, NODE_SCHEMA))
    crossing = stored(
        found.filter("name IS NOT NULL").groupBy("name").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            F.max("ends").alias("ends"), F.max("parent_name").alias("parent_name")))
    inside = found.filter("name IS NULL").drop("name")
    lost = inside.filter("parent_name IS NOT NULL").drop("parent_conv_id").unionByName(crossing.filter("parent_name IS NOT NULL").drop("name"))
    parents = crossing.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(None).cast("long").alias("parent_conv_id")
    every = (
        inside.filter("parent_name IS NULL").drop("parent_name")
        .unionByName(lost.join(parents, "parent_name").drop("parent_name"))
        .unionByName(crossing.filter("parent_name IS NULL").select("*", none).drop("name", "parent_name")))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def conversation_trie(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True,
) -> DataFrame:
    """The prefix trie of conversations, rebuilt on shared heads first unless `rebuild` is off.

    NULL role or text is empty; rows of a NULL conversation are left out; turns with equal `turn` go by their
    code; other columns are not looked at; an empty table gives no rows.
    """
    sequences = turn_sequences(turns, conv_id, turn, role, text)
    return prefix_nodes(with_shared_heads(stored(sequences)) if rebuild else sequences)
