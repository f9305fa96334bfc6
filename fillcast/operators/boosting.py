"""Gradient-boosted regression trees on binned features, fitted by Spark jobs over all rows.

Values are put into at most 255 bins a feature once; missing values have a bin of their own. A pass over the rows adds up
gradients and counts by (node, feature, bin) in every task, sums them by (node, feature), and finds there the split with the
largest second-order gain, with the missing bin sent to the side where it gains more. Only one split a node and feature
reaches the driver. A tree grows level by level, or best leaf first: then a pass opens the leaves that would be split next
if nothing better came, so the tree is the one that single steps would give, in fewer passes. The loss on validation rows
comes with the first pass of the next tree, and ends the fit when it has not fallen for a number of rounds.

A table of up to `TASK_BYTES` needs no passes for more than `FEW_ROUNDS`: one task reads it once and grows the same trees (`_TaskFit`).

Nothing depends on partitions: bins come from the rows with the smallest hashes, bags from hashes of row and tree, and
partial sums are added in the order of their partitions. In fits of more than `FEW_ROUNDS` gradients are also whole multiples
of a power of two, so that their sums are exact in any order.
"""

from __future__ import annotations

import heapq
import json
import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.operators.ordered import shared_folder, stored

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature; the last one holds missing values.
BINS, MISSING = 256, 255
#: Rows that the bins are made from: those with the smallest hashes. All rows are binned.
BIN_ROWS = 20_000
#: Trees and nodes after which the rows are stored anew with their predictions.
STORE_EVERY, STORE_NODES = 25, 128
#: Rounds that are made by passes, with plain sums, however short the table is.
FEW_ROUNDS = 25
#: Memory for the rows of a fit in one task; longer tables are fitted by passes. Memory there for sums of nodes.
TASK_BYTES, TASK_SUMS = 256 << 20, 64 << 20
#: Values a task counts at a time.
COUNTED = 1 << 16
#: Nodes a pass makes sums for at once.
PASS_NODES = 64
#: Nodes from which rows go down a tree one by one, rows predicted at a time, and sums a task sends at a time.
WIDE_TREE, SLICE_ROWS, SENT_SUMS = 1024, 2048, 1024
#: Gains up to this are rounding.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class TreeSettings:
    rounds: int = 300
    step: float = 0.05
    depth: int = 8               # 0: no limit
    leaves: int = 0              # 0: level by level; else best leaf first, up to so many
    least_rows: int = 20
    l2: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    patience: int = 20


@dataclass
class Tree:
    """Node arrays; a leaf has feature -1. Values include the step. A row goes left if its value is at most the threshold."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("missing_left", True), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def descend(self, values: np.ndarray, missing: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row; `values` are bins or numbers, a row a feature, `missing` tells which are missing.

        Rows are told apart node by node, which compares a feature's values in one go; trees of very many nodes go
        row by row instead.
        """
        cuts, n = self.bin if binned else self.threshold, values.shape[1]
        if len(self.feature) > WIDE_TREE:
            return self._by_row(values, missing, np.array(cuts))
        out = np.zeros(n, np.int64)
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while todo:
            node, here = todo.pop()
            f = self.feature[node]
            if f < 0:
                if here is not None:
                    out[here] = node
                continue
            left = values[f] <= cuts[node]
            left = left | missing[f] if self.missing_left[node] else left & ~missing[f]
            todo.append((self.left[node], left if here is None else here & left))
            todo.append((self.right[node], ~left if here is None else here & ~left))
        return out

    def _by_row(self, values: np.ndarray, missing: np.ndarray, cut: np.ndarray) -> np.ndarray:
        feature, left, right, to_left = (np.array(x) for x in (self.feature, self.left, self.right, self.missing_left))
        at, rows = np.zeros(values.shape[1], np.int64), np.arange(values.shape[1])
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            f = np.maximum(f, 0)
            go = np.where(missing[f, rows], to_left[at], values[f, rows] <= cut[at])
            at = np.where(inner, np.where(go, left[at], right[at]), at)


@dataclass(frozen=True)
class BoostedTrees:
    columns: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]
    losses: tuple[float, ...] = ()   # mean squared error on validation rows after each round, 0 rounds first

    def values(self, x: np.ndarray) -> np.ndarray:
        """Predictions for a matrix of numbers with NaN for missing ones."""
        out = np.full(len(x), self.base)
        for i in range(0, len(x), SLICE_ROWS):
            part = np.ascontiguousarray(x[i:i + SLICE_ROWS].T)
            missing = np.isnan(part)
            for tree in self.trees:
                out[i:i + SLICE_ROWS] += np.array(tree.value)[tree.descend(part, missing, False)]
        return out

    def score(self, features: Column) -> Column:
        """Predictions for an array of doubles, NaN where missing.

        Not marked as deterministic: otherwise a condition on the prediction moves below it and scores all rows once more, in
        a second Python worker of the task.
        """
        own, width = self, len(self.columns)

        @F.arrow_udf("double")
        def scored(rows: pa.Array) -> pa.Array:
            return pa.array(own.values(matrix(rows, width)))

        return scored.asNondeterministic()(features)

    def gains(self) -> dict[str, float]:
        """Share of each feature in the sum of all gains."""
        total = np.zeros(len(self.columns))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return dict(zip(self.columns, (total / total.sum() if total.sum() > 0 else total).tolist(), strict=True))


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """The numbers of an array column, a row each, without a copy."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def number(column: str) -> str:
    """SQL text of a column as double, NaN where missing."""
    quoted = column.replace("`", "``")
    return f"coalesce(CAST(`{quoted}` AS DOUBLE), CAST('NaN' AS DOUBLE))"


def number_array(columns: list[str] | tuple[str, ...]) -> Column:
    return F.expr(f"array({', '.join(number(c) for c in columns)})")


# -- bins ---------------------------------------------------------------------------

def bin_edges(values: np.ndarray) -> np.ndarray:
    """Upper ends of the bins: all values if there are few, else quantiles of the sample. The last bin is open."""
    known = np.sort(values[~np.isnan(values)])
    distinct = np.unique(known)
    if len(distinct) > MISSING - 1:
        distinct = np.unique(known[np.linspace(0, len(known) - 1, MISSING).astype(np.int64)])[:MISSING - 1]
    return distinct[:-1] if len(distinct) and distinct[-1] == known[-1] else distinct


def _edges_of(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    n = rows.count()
    if n > 2 * BIN_ROWS:
        rows = rows.filter(F.pmod("u", F.lit(1 << 30)) < int((1 << 30) * 1.5 * BIN_ROWS / n))
    first = rows.orderBy(F.pmod("u", F.lit(1 << 30)), "u").limit(BIN_ROWS).toArrow()
    return [bin_edges(first[f"_f{k}"].to_numpy().astype(np.float64)) for k in range(len(columns))]


def _record(width: int) -> np.dtype:
    """What a pass reads of a row, as one value: target, hash, prediction by the trees stored with it, held out or not, bins."""
    return np.dtype([("y", "f8"), ("u", "i8"), ("pred", "f8"), ("held", "u1"), ("x", "u1", (width,))])


def _as_binary(records: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(records.itemsize), len(records), [None, pa.py_buffer(records.tobytes())]).cast(pa.binary())


def _records(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The records of a batch, without a copy. All have the same length, so they lie one after the other."""
    r, kind = batch.column("r"), _record(width)
    if not len(r):
        return np.empty(0, kind)
    starts = np.frombuffer(r.buffers()[1], np.int64 if pa.types.is_large_binary(r.type) else np.int32)
    return np.frombuffer(r.buffers()[2], kind, len(r), int(starts[r.offset]))


def _binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows (y, held, r) with their records: a byte a feature."""
    def run(batches):
        for batch in batches:
            records = np.zeros(batch.num_rows, _record(len(edges)))
            for k, name in enumerate(("y", "held", "u")):
                records[name] = batch.column(k).to_numpy(zero_copy_only=False)
            for k, e in enumerate(edges):
                x = batch.column(3 + k).to_numpy(zero_copy_only=False)
                records["x"][:, k] = np.where(np.isnan(x), MISSING, np.searchsorted(e, x, "left"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _as_binary(records)], names=["y", "held", "r"])

    return rows.mapInArrow(run, "y double, held boolean, r binary")


# -- sums and splits ------------------------------------------------------------------

def best_split(grad: np.ndarray, count: np.ndarray, least_rows: int, l2: float) -> tuple[float, int, bool, float, float] | None:
    """(gain, bin, missing goes left, gradient and rows of the left side) of one node and feature, or None."""
    g, n = grad.sum(), count.sum()
    own, rows = np.cumsum(grad[:MISSING])[:-1], np.cumsum(count[:MISSING])[:-1]
    best = None
    for with_missing in (True, False):
        gl = own + (grad[MISSING] if with_missing else 0.0)
        nl = rows + (count[MISSING] if with_missing else 0.0)
        gr, nr = g - gl, n - nl
        # With no missing rows either way is the same cut; they then follow the larger side.
        ok = (nl >= least_rows) & (nr >= least_rows) & (rows > 0) & (rows < n - count[MISSING] if not count[MISSING] else True)
        if not ok.any():
            continue
        gain = np.where(ok, gl * gl / (nl + l2) + gr * gr / (nr + l2) - g * g / (n + l2), -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > LEAST_GAIN and (best is None or gain[k] > best[0]):
            to_left = with_missing if count[MISSING] else bool(nl[k] >= nr[k])
            best = (float(gain[k]), k, to_left, float(gl[k]), float(nl[k]))
    return best


_PART = "slot int, feature int, part int, grad binary, count binary"
_SPLIT = "slot int, feature int, gain double, bin int, missing_left boolean, grad_left double, rows_left double, grad double, n double"


def _bins(records: np.ndarray) -> np.ndarray:
    """The bins, a row a feature."""
    return np.ascontiguousarray(records["x"].T)


def _predictions(records, bins, missing, base, trees) -> np.ndarray:
    """`base` stands for the stored predictions as long as there are none."""
    out = records["pred"].copy() if base is None else np.full(len(records), base)
    for tree in trees:
        out += np.array(tree.value)[tree.descend(bins, missing, True)]
    return out


def gradient_unit(rows: int, spread: float) -> float:
    """A power of two: sums of `rows` gradients that are multiples of it are exact in any order. 0 for targets without bounds."""
    most = 4.0 * rows * (spread or 1.0)  # gradients may grow beyond the spread of the targets
    return 2.0 ** (math.frexp(most)[1] - 52) if most < math.inf else 0.0


def _whole(gradient: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(gradient / unit) * unit if unit else gradient


def _in_bag(u: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """A part of the rows, by a hash of row and tree."""
    if share >= 1:
        return np.ones(len(u), bool)
    h = (u.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


class _Pass:
    """One pass over the rows: sums for some nodes of the tree that grows, and the loss on validation rows if asked for."""

    def __init__(self, width: int, base: float | None, unit: float, pending: list[Tree], growing: Tree, nodes: list[int], features: np.ndarray, number: int, seed: int, s: TreeSettings, loss: bool):
        self.width, self.base, self.unit, self.pending, self.growing, self.nodes, self.features = width, base, unit, pending, growing, nodes, features
        self.number, self.seed, self.s, self.loss = number, seed, s, loss

    def sums(self, batches):
        slots = np.full(len(self.growing.feature) + 1, -1)
        slots[self.nodes] = np.arange(len(self.nodes))
        size = len(self.nodes) * BINS
        grad, count = np.zeros((len(self.features), size)), np.zeros((len(self.features), size))
        error = np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            records = _records(batch, self.width)
            bins = _bins(records)
            missing, held = bins == MISSING, records["held"] > 0
            g = _predictions(records, bins, missing, self.base, self.pending) - records["y"]
            if self.loss:
                error += (g[held] ** 2).sum(), held.sum()
            slot = slots[self.growing.descend(bins, missing, True)]
            use = (slot >= 0) & ~held & _in_bag(np.ascontiguousarray(records["u"]), self.seed, self.number, self.s.row_share)
            g, start = _whole(g[use], self.unit), slot[use] * BINS
            for k, f in enumerate(self.features.tolist()):
                at = start + bins[f][use]
                grad[k] += np.bincount(at, g, size)
                count[k] += np.bincount(at, minlength=size)
        part = TaskContext.get().partitionId()
        rows = [(-1, -1, part, error.tobytes(), b"")] if self.loss else []

        def sent() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slot", "feature", "part", "grad", "count"])

        for k, f in enumerate(self.features.tolist()):
            for slot in range(len(self.nodes)):
                c = count[k, slot * BINS:(slot + 1) * BINS]
                if c.any():
                    rows.append((slot, f, part, grad[k, slot * BINS:(slot + 1) * BINS].tobytes(), c.tobytes()))
            if len(rows) >= SENT_SUMS:
                yield sent()
                rows = []
        if rows:
            yield sent()

    def split(self, table: pa.Table) -> pa.Table:
        """The best split of a node and feature, from its parts in order; a row of totals where there is none."""
        rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "grad", "count")), strict=True))
        slot, feature = table["slot"][0].as_py(), table["feature"][0].as_py()
        grad = np.sum([np.frombuffer(r[1]) for r in rows], axis=0)
        if slot < 0:
            found = (slot, feature, None, None, None, None, None, grad[0], grad[1])
        else:
            count = np.sum([np.frombuffer(r[2]) for r in rows], axis=0)
            best = best_split(grad, count, self.s.least_rows, self.s.l2) or (None,) * 5
            found = (slot, feature, *best, grad.sum(), count.sum())
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), *[pa.float64()] * 4)
        names = ("slot", "feature", "gain", "bin", "missing_left", "grad_left", "rows_left", "grad", "n")
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, found, kinds, strict=True)})

    def run(self, rows: DataFrame) -> list:
        return rows.select("r").mapInArrow(self.sums, _PART).groupBy("slot", "feature").applyInArrow(lambda table: self.split(table), _SPLIT).collect()


# -- fitting ----------------------------------------------------------------------------

def next_leaves(tree: Tree, gains: dict[int, float], limit: int) -> tuple[list[int], set[int]]:
    """Best leaf first: the open leaves that are split next if their children gain nothing, and all nodes split so far.

    `gains` has the gains of the leaves and nodes whose best split is known. Leaves that better ones may still push out
    are opened too, never one that could not be in the tree.
    """
    heap, split, opened, leaves = [(-gains.get(0, 0.0), 0)], set(), [], 1
    while heap and leaves < limit:
        gain, node = heapq.heappop(heap)
        if gain >= -LEAST_GAIN:
            continue
        split.add(node)
        leaves += 1
        if tree.feature[node] < 0:
            opened.append(node)
        else:
            for child in (tree.left[node], tree.right[node]):
                heapq.heappush(heap, (-gains.get(child, 0.0), child))
    return opened, split


def pruned(tree: Tree, kept: set[int]) -> Tree:
    """The tree in which only the nodes of `kept` are split."""
    out, place = Tree(), {0: 0}
    out.add(tree.value[0], tree.cover[0])
    todo = [0]
    for old in todo:
        if old in kept and tree.feature[old] >= 0:
            new = place[old]
            sides = []
            for child in (tree.left[old], tree.right[old]):
                place[child] = out.add(tree.value[child], tree.cover[child])
                sides.append(place[child])
                todo.append(child)
            out.left[new], out.right[new] = sides
            for name in ("feature", "bin", "threshold", "missing_left", "gain"):
                getattr(out, name)[new] = getattr(tree, name)[old]
    return out


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round with the least error so far, and whether `patience` rounds have passed since."""
    best = int(np.argmin(errors))
    return best, len(errors) - 1 - best >= patience


class _Growth:
    """Grows trees one after the other. `_pass` gives the best splits of nodes, in a dictionary, and the loss if asked for."""

    def __init__(self, edges: list[np.ndarray], base: float, unit: float, s: TreeSettings, seed: int, watch: bool):
        self.edges, self.base, self.unit, self.s, self.seed, self.watch = edges, base, unit, s, seed, watch
        self.trees: list[Tree] = []
        self.losses: list[float] = []

    def _pass(self, tree: Tree, nodes: list[int], features: np.ndarray, loss: bool) -> dict[int, dict]:
        raise NotImplementedError

    def _root(self, tree: Tree, gradient: float, n: float) -> None:
        tree.value[0] = -gradient / (n + self.s.l2) * self.s.step

    def _split(self, tree: Tree, node: int, r) -> list[int]:
        s = self.s
        tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
        tree.threshold[node] = float(self.edges[r["feature"]][r["bin"]]) if r["bin"] < len(self.edges[r["feature"]]) else float("inf")
        tree.missing_left[node] = r["missing_left"]
        sides = ((r["grad_left"], r["rows_left"]), (r["grad"] - r["grad_left"], r["n"] - r["rows_left"]))
        tree.left[node], tree.right[node] = (tree.add(-g / (n + s.l2) * s.step, n) for g, n in sides)
        return [tree.left[node], tree.right[node]]

    def grow(self) -> Tree:
        s, width = self.s, len(self.edges)
        rng = np.random.default_rng([self.seed, len(self.trees)])
        features = np.sort(rng.choice(width, max(1, round(s.column_share * width)), replace=False)) if s.column_share < 1 else np.arange(width)
        tree, depth, known = Tree(), {0: 0}, {}
        tree.add(0.0, 0.0)
        todo, loss = [0], self.watch
        while todo:
            known |= self._pass(tree, todo, features, loss)
            loss = False
            gains = {n: r["gain"] for n, r in known.items()}
            opened = next_leaves(tree, gains, s.leaves)[0] if s.leaves else [n for n in todo if n in known]
            todo = []
            for node in opened:
                for child in self._split(tree, node, known[node]):
                    depth[child] = depth[node] + 1
                    if (not s.depth or depth[child] < s.depth) and tree.cover[child] >= 2 * s.least_rows:
                        todo.append(child)
        return pruned(tree, next_leaves(tree, {n: r["gain"] for n, r in known.items()}, s.leaves)[1]) if s.leaves else tree

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)

    def boost(self) -> None:
        s = self.s
        for _ in range(s.rounds):
            tree = self.grow()
            if self.watch and best_round(self.losses, s.patience)[1]:
                break
            if len(tree.feature) == 1 and s.row_share >= 1 and s.column_share >= 1:
                break  # nothing can be split, and no other tree would differ
            self.add(tree)
        if self.watch and len(self.losses) == len(self.trees):
            self._pass(Tree(*[[x] for x in (-1, 0, 0.0, True, -1, -1, 0.0, 0.0, 0.0)]), [0], np.array([0]), True)


class _Fit(_Growth):
    """A fit by passes over all rows in all tasks."""

    def __init__(self, rows: DataFrame, *settings):
        super().__init__(*settings)
        self.rows = rows
        self.pending: list[Tree] = []
        self.path: str | None = None

    def fresh_base(self) -> float | None:
        """What all predictions start from, until they are stored with the rows."""
        return self.base if self.path is None else None

    def _pass(self, tree: Tree, nodes: list[int], features: np.ndarray, loss: bool) -> dict[int, dict]:
        """The best split of each node over all features."""
        best: dict[int, tuple] = {}
        for i in range(0, len(nodes), PASS_NODES):
            part = nodes[i:i + PASS_NODES]
            one = _Pass(len(self.edges), self.fresh_base(), self.unit, self.pending, tree, part, features, len(self.trees), self.seed, self.s, loss and i == 0)
            for r in one.run(self.rows):
                if r["slot"] < 0:
                    self.losses.append(r["grad"] / r["n"] if r["n"] else float("nan"))
                    continue
                node = part[r["slot"]]
                tree.cover[node] = max(tree.cover[node], r["n"])
                if not i and node == 0 and len(tree.feature) == 1:
                    self._root(tree, r["grad"], r["n"])
                key = (-r["gain"], r["feature"]) if r["gain"] is not None else None
                if key is not None and (node not in best or key < best[node][0]):
                    best[node] = (key, r)
        return {node: r for node, (_, r) in best.items()}

    def add(self, tree: Tree) -> None:
        super().add(tree)
        self.pending.append(tree)
        many = len(self.pending) >= STORE_EVERY or sum(len(t.feature) for t in self.pending) >= STORE_NODES
        if many and len(self.trees) < self.s.rounds:
            self.store()

    def store(self) -> None:
        """Write the rows with their predictions, and drop the table of the time before."""
        pending, width, base = self.pending, len(self.edges), self.fresh_base()

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    records = _records(batch, width).copy()
                    bins = _bins(records)
                    records["pred"] = _predictions(records, bins, bins == MISSING, base, pending)
                    yield pa.RecordBatch.from_arrays([_as_binary(records)], names=["r"])

        spark = self.rows.sparkSession
        path = shared_folder(spark)
        self.rows.select("r").mapInArrow(run, "r binary").write.parquet(path)
        self.rows = spark.read.schema("r binary").parquet(path)
        self.drop()
        self.path, self.pending = path, []

    def drop(self) -> None:
        if self.path is not None:
            spark = self.rows.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            self.path = None


class _TaskFit(_Growth):
    """A fit in one task, which holds all rows: they are parted node by node, and of two children only the smaller is summed up.

    Sums are whole numbers of units, so the larger child's are the parent's less the smaller's, without an error.
    """

    def __init__(self, records: np.ndarray, *settings):
        super().__init__(*settings)
        self.y, self.u, self.held = records["y"].copy(), records["u"].copy(), records["held"] > 0
        # A feature's bins, with the missing one right after the others.
        self.gap = np.array([len(e) + 1 for e in self.edges])
        self.x = np.ascontiguousarray(records["x"].T)
        for x, gap in zip(self.x, self.gap, strict=True):
            x[x == MISSING] = gap
        self.pred = np.full(len(records), self.base)
        self.rows: dict[int, np.ndarray] = {}
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.family: dict[int, tuple[int, int]] = {}

    def _begin(self, features: np.ndarray) -> None:
        """A new tree: its rows, their gradients in units, and where its features' bins lie in a node's sums."""
        self.rows, self.sums, self.family = {0: np.flatnonzero(~self.held & _in_bag(self.u, self.seed, len(self.trees), self.s.row_share))}, {}, {}
        self.g = np.rint((self.pred - self.y) / self.unit)
        self.features = features
        ends = np.cumsum(self.gap[features] + 1)
        self.size, self.first, self.last = int(ends[-1]), ends - self.gap[features] - 1, ends - 1
        cuts = np.minimum(self.gap[features], MISSING - 1)
        self.of = np.repeat(np.arange(len(features)), cuts)
        self.cut = np.arange(len(self.of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        self.at = self.first[self.of] + self.cut

    def _summed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grad, count, g = np.zeros(self.size), np.zeros(self.size, np.int32), self.g[rows]
        step = max(1, COUNTED // max(1, len(rows)))
        for i in range(0, len(self.features), step):
            part = self.features[i:i + step]
            low, high = self.first[i], self.last[i + len(part) - 1] + 1
            bins = (self.x[part[:, None], rows] if len(part) > 1 else self.x[part[0]][rows][None]) + (self.first[i:i + step, None] - low)
            grad[low:high] = np.bincount(bins.ravel(), np.tile(g, len(part)), high - low)
            count[low:high] = np.bincount(bins.ravel(), minlength=high - low)
        return grad, count

    def _sums_of(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        if node in self.sums:
            return self.sums.pop(node)
        parent, other = self.family.get(node, (None, None))
        if parent not in self.sums:
            return self._summed(self.rows[node])
        whole, small = self.sums.pop(parent), min(node, other, key=lambda k: len(self.rows[k]))
        part = self._summed(self.rows[small])
        rest = whole[0] - part[0], whole[1] - part[1]
        own, self.sums[other] = (part, rest) if small == node else (rest, part)
        return own

    def _best(self, grad: np.ndarray, count: np.ndarray) -> tuple[float, float, dict | None]:
        """Gradient and rows of a node and its best split: that of `best_split` over all features, the first one if gains are equal."""
        unit, l2, least = self.unit, self.s.l2, self.s.least_rows
        units, rows = np.cumsum(grad.astype(np.int64)), np.cumsum(count, dtype=np.int64)
        total, n = float(units[self.last[0]]) * unit, float(rows[self.last[0]])
        if not n:
            return total, n, None
        g0, n0 = (c[self.at] - np.where(self.first > 0, c[self.first - 1], 0)[self.of] for c in (units, rows))
        g0, n0 = g0 * unit, n0.astype(np.float64)
        g_gap, n_gap = (grad[self.last] * unit)[self.of], count[self.last].astype(np.float64)[self.of]
        best = None
        for with_missing in (True, False) if n_gap.any() else (True,):
            gl, nl = (g0 + g_gap, n0 + n_gap) if with_missing else (g0, n0)
            gr, nr = total - gl, n - nl
            ok = np.flatnonzero((nl >= least) & (nr >= least) & (n0 > 0) & ((n_gap > 0) | (n0 < n)))
            if not len(ok):
                continue
            gl, nl, gr, nr = gl[ok], nl[ok], gr[ok], nr[ok]
            gain = gl * gl / (nl + l2) + gr * gr / (nr + l2) - total * total / (n + l2)
            k = int(np.argmax(gain))
            f, key = int(self.of[ok[k]]), (-float(gain[k]), int(self.of[ok[k]]))
            if gain[k] > LEAST_GAIN and (best is None or key < best[0]):
                best = (key, {
                    "feature": int(self.features[f]), "gain": float(gain[k]), "bin": int(self.cut[ok[k]]),
                    "missing_left": with_missing if count[self.last[f]] else bool(nl[k] >= nr[k]),
                    "grad_left": float(gl[k]), "rows_left": float(nl[k]), "grad": total, "n": n})
        return total, n, best and best[1]

    def _pass(self, tree: Tree, nodes: list[int], features: np.ndarray, loss: bool) -> dict[int, dict]:
        if loss:
            self.losses.append(float(((self.pred - self.y)[self.held] ** 2).sum() / self.held.sum()) if self.held.any() else float("nan"))
        if nodes == [0]:
            self._begin(features)
        found = {}
        for node in nodes:
            sums = self._sums_of(node)
            gradient, n, best = self._best(*sums)
            if n:
                tree.cover[node] = max(tree.cover[node], n)
                if node == 0:
                    self._root(tree, gradient, n)
            if best is not None:
                found[node] = best
                if (len(self.sums) + 1) * self.size * 12 <= TASK_SUMS:
                    self.sums[node] = sums
        return found

    def _sides(self, tree: Tree, node: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = tree.feature[node]
        x = self.x[f][rows]
        left = x <= tree.bin[node]
        if tree.missing_left[node]:
            left |= x == self.gap[f]
        else:
            left &= x != self.gap[f]
        return rows[left], rows[~left]

    def _split(self, tree: Tree, node: int, r) -> list[int]:
        left, right = super()._split(tree, node, r)
        self.rows[left], self.rows[right] = self._sides(tree, node, self.rows.pop(node))
        self.family[left], self.family[right] = (node, right), (node, left)
        return [left, right]

    def add(self, tree: Tree) -> None:
        super().add(tree)
        todo = [(0, np.arange(len(self.y)))]
        while todo:
            node, rows = todo.pop()
            if tree.feature[node] < 0:
                self.pred[rows] += tree.value[node]
            else:
                todo += zip((tree.left[node], tree.right[node]), self._sides(tree, node, rows), strict=True)


def _fit_in_a_task(table: DataFrame, *settings) -> tuple[list[Tree], list[float]]:
    """The trees and losses of `_TaskFit` over all rows."""
    width = len(settings[0])

    def run(batches):
        fit = _TaskFit(np.concatenate([_records(b, width) for b in batches]), *settings)
        fit.boost()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([[vars(t) for t in fit.trees], fit.losses])])], names=["fit"])

    trees, losses = json.loads(table.select("r").coalesce(1).mapInArrow(run, "fit string").collect()[0]["fit"])
    return [Tree(**t) for t in trees], losses


def fit_trees(
    rows: DataFrame, columns: list[str], target: str, held: Column, s: TreeSettings, seed: int = 0, watch: bool = True,
    keys: list[str] | None = None,
) -> BoostedTrees:
    """Fit boosted trees for squared error on the rows that are not `held`; with `watch`, stop by the loss on those that are.

    Rows without a target are left out. `keys` name a row (by default its features and target): its hash decides on
    samples and bags, so rows equal in all of them are in a bag together. Without training rows the prediction is 0.
    """
    own = [F.col(f"`{k}`") for k in keys] if keys else [number_array(columns), F.col(f"`{target}`")]
    named = [F.expr(number(c)).alias(f"_f{k}") for k, c in enumerate(columns)]
    wide = rows.filter(F.col(f"`{target}`").isNotNull() & ~F.isnan(F.col(f"`{target}`").cast("double"))).select(
        F.col(f"`{target}`").cast("double").alias("y"), F.coalesce(held, F.lit(False)).alias("held"),
        F.xxhash64(F.lit(seed), *own).alias("u"), *named)
    edges = _edges_of(wide.filter(~F.col("held")).select("u", *[f"_f{k}" for k in range(len(columns))]), columns)
    table = stored(_binned(wide, edges))
    y = F.when(~F.col("held"), F.col("y"))
    mean, spread, n, n_held = table.agg(F.avg(y), F.max(y) - F.min(y), F.count(F.lit(1)), F.count_if("held")).first()
    if mean is None:
        return BoostedTrees(tuple(columns), 0.0, ())
    base, unit = float(mean), gradient_unit(n, spread) if s.rounds > FEW_ROUNDS else 0.0
    watch = watch and n_held > 0
    if unit and n * (2 * len(columns) + 100) <= TASK_BYTES:
        trees, losses = _fit_in_a_task(table, edges, base, unit, s, seed, watch)
    else:
        fit = _Fit(table, edges, base, unit, s, seed, watch)
        try:
            fit.boost()
        finally:
            fit.drop()
        trees, losses = fit.trees, fit.losses
    kept = best_round(losses, s.patience)[0] if watch else len(trees)
    return BoostedTrees(tuple(columns), base, tuple(trees[:kept]), tuple(losses))


# -- exact Shapley values ----------------------------------------------------------------

def shapley_values(model: BoostedTrees, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of each row and feature, with absent features averaged over the training rows of a node.

    For a leaf, a present feature lets a row through or not, an absent one lets the share of training rows through. The
    sum over all sets of features is a polynomial in the number of present ones; it is multiplied up feature by feature
    along the leaf's path, so a leaf costs a power of its depth, not of two.
    """
    out = np.zeros(x.shape)
    missing = np.isnan(x)
    for tree in model.trees:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = tree.feature[node]
            if f >= 0:
                left = np.where(missing[:, f], tree.missing_left[node], x[:, f] <= tree.threshold[node])
                for child, goes in ((tree.left[node], left), (tree.right[node], ~left)):
                    share = tree.cover[child] / tree.cover[node]
                    passed, through = path.get(f, (True, 1.0))
                    stack.append((child, path | {f: (passed & goes, through * share)}))
            elif path:
                _add_leaf(out, path, tree.value[node])
    return out


def _add_leaf(out: np.ndarray, path: dict[int, tuple[np.ndarray, float]], value: float) -> None:
    d = len(path)
    weight = np.empty(d)
    weight[0] = 1.0 / d
    for k in range(1, d):
        weight[k] = weight[k - 1] * k / (d - k)
    for f, (present, absent) in path.items():
        sets = np.zeros((d, len(out)))
        sets[0] = 1.0
        for k, (g, (p, a)) in enumerate((g, v) for g, v in path.items() if g != f):
            sets[1:k + 2] = sets[1:k + 2] * a + sets[:k + 1] * p
            sets[0] *= a
        out[:, f] += value * (present - absent) * (weight @ sets)


def mean_prediction(model: BoostedTrees) -> float:
    """What the Shapley values of a row add up from: each leaf by its share of training rows."""
    def of(tree: Tree, node: int) -> float:
        if tree.feature[node] < 0:
            return tree.value[node]
        return sum(tree.cover[c] / tree.cover[node] * of(tree, c) for c in (tree.left[node], tree.right[node]))

    return model.base + sum(of(t, 0) for t in model.trees)
