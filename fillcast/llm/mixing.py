"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillcast.llm.common import KEY, WORD, keyed, on_key
from fillcast.operators.ordered import stored


@dataclass(frozen=True)
class Mixture:
    """Target weights by level (domain, language, source), and how much to take."""

    #: Weight by value for each level; values that are not listed have weight 1.
    weights: tuple[dict[str, float], ...] = field(default_factory=lambda: ({}, {}, {}))
    #: Tokens to select, as a share of the tokens there are.
    share: float = 1.0
    #: Times a document may be taken at most.
    max_epochs: int = 2
    seed: int = 7


LEVELS = ["__l0", "__l1", "__l2"]


def n_tokens(text: Column) -> Column:
    """Words, as a stand-in for tokens that every engine counts alike."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(level: str, weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for value, x in weights.items():
        w = F.when(F.col(level) == value, F.lit(float(x))).otherwise(w)
    return w


def _share_out(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """Split each group's `budget` over its nodes by `weight`, none beyond its `capacity`.

    Nodes are filled in the order of capacity over weight. Those before the first node whose share fits are
    full; what they cannot hold is spread over the others by weight. A budget over the group's capacity
    cannot occur, as a parent's budget never exceeds the sum of its children.
    """
    order = [F.col("capacity") / F.col("weight"), *[F.col(x) for x in name.split(",")]]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = nodes.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("weight") >= F.col("capacity"))
    # Once a node's share fits, all after it take the level of that node.
    rows = rows.withColumn("__at", F.first(F.when(~F.col("__full"), F.col("__level")), ignorenulls=True).over(so_far))
    return rows.withColumn("share", F.when(F.col("__at").isNull(), F.col("capacity").cast("double")).otherwise(
        F.least(F.col("__at") * F.col("weight"), F.col("capacity").cast("double")))).drop("__level", "__full", "__at")


def leaf_budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """Rows (levels, tokens, quota) from rows (levels, tokens): the whole tokens each leaf is to give.

    Capacities add up from the leaves. Budgets go down: at each node the budget is split over its children by
    weight within their capacity, so a shortage is met by siblings first, and only what a whole subtree
    cannot hold reaches its ancestors' other children.
    """
    l0, l1, l2 = LEVELS
    base = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs).filter("tokens > 0")
    budget = F.least(F.floor(F.sum("tokens") * F.lit(mix.share)), F.sum("capacity"))
    total = base.agg(budget.cast("long").alias("budget")).first()["budget"] or 0  # one number
    tops = base.groupBy(l0).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(l0, mix.weights[0]))
    tops = tops.withColumns({"__all": F.lit(0), "budget": F.lit(total)})
    top = _share_out(tops, ["__all"], l0).select(l0, F.col("share").alias("budget"))
    mids = base.groupBy(l0, l1).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(l1, mix.weights[1]))
    mid = _share_out(mids.join(top, l0), [l0], l1).select(l0, l1, F.col("share").alias("budget"))
    low = base.withColumn("weight", _weight(l2, mix.weights[2])).join(mid, [l0, l1])
    return _share_out(low, [l0, l1], l2).select(*LEVELS, "tokens", F.floor("share").cast("long").alias("quota"))


def select_mixture(
    docs: DataFrame, levels: list[Column], mix: Mixture, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Documents with `n_tokens` and `copies`, the times the mixture takes them (0: left out).

    `levels` are three columns, from domain to source; NULL is a value of its own. A leaf's quota is filled
    by epochs: in each one its documents stand in a seeded order of their own, whole epochs come first, and
    of the last one the longest prefix that fits. So a leaf gives its quota less at most part of one
    document. Documents without tokens are taken once, as they cost nothing. Rows equal in id and text
    are taken together or not at all. Input columns named like a result are replaced.

    No leaf is sorted in one task: tokens are summed by ranges of the order, a range holding about a
    thousand documents, and only the range in which the prefix ends is looked at by document.
    """
    rows = keyed(docs.drop(*[c for c in ("n_tokens", "copies") if c != text]), id_col, text)
    rows = rows.withColumn("n_tokens", n_tokens(F.col(text)))
    rows = rows.withColumns(dict(zip(LEVELS, [F.coalesce(x.cast("string"), F.lit("\u0000")) for x in levels], strict=True)))
    narrow = stored(rows.select(*KEY, *LEVELS, "n_tokens"))
    sums = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    sums = stored(sums)
    budgets = leaf_budgets(sums.select(*LEVELS, "tokens"), mix).join(sums.drop("tokens"), LEVELS)
    plan = stored(budgets.withColumns({
        "epochs": F.floor(F.col("quota") / F.col("tokens")).cast("long"),
        "ranges": F.greatest(F.lit(1), F.ceil(F.col("rows") / 1000.0)).cast("long")}).withColumn(
        "rest", F.col("quota") - F.col("epochs") * F.col("tokens")))
    # One row for each distinct (id, text): copies of a row are counted, never gathered.
    own = narrow.groupBy(*KEY, *LEVELS, "n_tokens").agg(F.count("*").alias("n")).filter("n_tokens > 0")
    place = F.pmod(F.xxhash64(F.lit(mix.seed), "epochs", "__id", "__h1"), F.lit(1 << 40))
    ordered = own.join(plan, LEVELS).withColumn("o", place).withColumn(
        "r", F.floor(F.col("o") * F.col("ranges") / F.lit(float(1 << 40))).cast("long"))
    ordered = stored(ordered)
    before = Window.partitionBy(*LEVELS).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ordered.groupBy(*LEVELS, "r").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).withColumn(
        "done", F.coalesce(F.sum("t").over(before), F.lit(0)))
    marked = ordered.join(ranged, [*LEVELS, "r"])
    inside = marked.filter((F.col("done") <= F.col("rest")) & (F.col("done") + F.col("t") > F.col("rest")))
    within = Window.partitionBy(*LEVELS, "r").orderBy("o", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("done") - F.coalesce(F.sum(F.col("n") * F.col("n_tokens")).over(within), F.lit(0))
    # A prefix ends at the first document that does not fit whole, so the running sum decides.
    ending = inside.withColumn("extra", (F.col("n") * F.col("n_tokens") <= left).cast("long"))
    full = marked.filter(F.col("done") + F.col("t") <= F.col("rest")).withColumn("extra", F.lit(1).cast("long"))
    none = marked.filter(F.col("done") > F.col("rest")).withColumn("extra", F.lit(0).cast("long"))
    columns = [*KEY, (F.col("epochs") + F.col("extra")).alias("copies")]
    chosen = stored(ending.select(*columns).unionByName(full.select(*columns)).unionByName(none.select(*columns)))
    joined = on_key(rows, chosen, "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    return joined.drop(*KEY, *LEVELS)


def mixed_documents(docs: DataFrame, levels: list[Column], mix: Mixture, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the mixture with the input's columns, each as often as it is taken."""
    taken = select_mixture(docs.withColumn("__row", F.struct(*docs.columns)), levels, mix, id_col, text).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
