"""Classes of linked nodes from bucket membership, without all pairs of a bucket.

Two nodes are candidates when they share a bucket.  In rounds every node is compared with
pivots of its buckets, and the links found are closed into classes.  The first round
takes its pivots from the shuffle that deals the buckets: each node meets the pivot of
most of its buckets, then the pairs of buckets of two that still differ are compared, and
these buckets are done.  In later rounds a bucket has a pivot of each of its PIVOTS
largest classes, and a node meets MEET of its buckets' pivots at most, the others wait.
The rounds go on while the buckets hold more pairs of different classes
than PAIRS a row and a round leaves less than LESS of them; then all pairs of different
classes that are left are compared, each given out by the first of its open buckets.
Sketches of the sets, which never part alike ones, are compared within
the joins, so that these give out hardly more than links; the sets confirm them.  Only
rows of buckets that are open after the first round get sketches.  A large
group of copies, one class by then, makes no pairs.  Every candidate pair is thus tested
or joined by tested links: the classes are those of all links.  Where a bucket holds many
nodes without links, the sketches of its pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialize

#: Pairs a row of a bucket that may be compared at last, the share of the pairs that a further round must take away, and rounds at most.
PAIRS, LESS, ROUNDS = 32, 0.75, 4
#: Open buckets of a node that its rows carry.
FIRST = 64
#: Pivots of a bucket in a later round, and those that a node is compared with.
PIVOTS = MEET = 8
#: Longs of a sketch at most.
SKETCH = 16
#: Pairs whose nodes' sets are picked by a broadcast before they are joined; links that are closed on the driver.
FEW = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for all nodes of the links (a, b)."""
    links = materialize(links.select("a", "b").distinct(), "edges")
    if links.count() <= FEW:
        return _few_components(links)
    both = materialize(links.union(links.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        out = lower.join(jump, "to", "left").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("moved"))
        before, out = labels, materialize(out, "labels")
        labels = out.select("node", "label")
        if not out.where("moved").limit(1).count():
            drop(links, both, before)
            return labels


def _few_components(links: DataFrame) -> DataFrame:
    """The same for FEW links at most: on the driver, without a dozen small jobs."""
    found = links.toArrow()
    names, ends = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    drop(links)
    out = links.sparkSession.createDataFrame(pa.table({"node": pa.array(names, pa.int64()), "label": pa.array(names[label], pa.int64())}))
    return materialize(out, "labels")


def shared(rows: DataFrame) -> DataFrame:
    """Distinct rows (bucket, node, ...) of buckets that hold two nodes or more, with n, the number of nodes, and p, the row of the bucket's last node.

    One shuffle by bucket.  The nodes are hashes or numbers without a meaning, so the last one is any.
    """
    whole = Window.partitionBy("bucket")
    own = [c for c in rows.columns if c != "bucket"]
    dealt = rows.repartition("bucket").withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole))
    # Most rows are alone in their bucket; only the others get their pivot and number.
    some = dealt.where(F.col("low") < F.col("high")).drop("low", "high").dropDuplicates(["bucket", "node"])
    return materialize(some.withColumn("p", F.max(F.struct(*own)).over(whole)).withColumn("n", F.count("*").over(whole)), "shared")


def classes(rows: DataFrame, sets: DataFrame, percent: int, near: Callable[[str, str], Column], more: DataFrame | None = None, names: DataFrame | None = None, near_last: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, label) of the nodes that have a link: Jaccard of ``percent`` or more of their ``sets`` (node, items, n, sketch).

    ``rows`` is what ``shared`` gave.  ``near(x, y)`` tells from two rows under these
    aliases whether the pair can be a link at all, by the first bucket in the order of the
    other columns that both share at the latest; ``near_last`` does so for the last pairs,
    from the rows of ``names`` (node, ...).  ``more`` has links (a, b) that are known.
    """
    own = [c for c in rows.columns if c not in ("bucket", "n", "p")]
    ends = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    likely = may("x.items", "y.items", "x.sketch", "y.sketch", percent)
    star = rows.alias("x").where(F.col("x.node") != F.col("x.p.node")).where(near("x", "x.p"))
    met = materialize(_met(star, F.max(F.col("n") == 2).alias("two")), "pairs")
    tested = materialize(_chosen(met, 1), "pairs")
    labels = components(_with(materialize(jaccard_links(tested, sets, percent), "links"), more))
    mine = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    two = met.where("two").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti").join(mine("a"), "a", "left").join(mine("b"), "b", "left")
    two = materialize(two.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "pairs")
    labels = _merged(labels, jaccard_links(two, sets, percent))
    tested = tested.union(two)
    now = rows.where("n > 2").select("bucket", *own)
    rows_left, before = now.count(), float("inf")
    for turn in range(1, ROUNDS):
        now, left = _open(now, labels)
        if not left:
            return labels
        full = _full(now, sets)
        if left <= PAIRS * rows_left or left > LESS * before or turn == ROUNDS - 1:
            break
        star = full.alias("x").join(_pivots(full, turn).alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & near("x", "y") & likely)
        met = star.groupBy(F.col("x.node").alias("node"), *ends).agg(F.count("*").alias("n"))
        pairs = materialize(_chosen(met.join(tested, ["a", "b"], "left_anti"), MEET), "pairs")
        links = materialize(jaccard_links(pairs, sets, percent, True), "links")
        if links.isEmpty():
            break
        tested = tested.union(pairs)
        labels = _merged(labels, links)
        now, before = now.select("bucket", *own), left
    # Not all pairs of a bucket are walked: one row is always of another class than the largest.
    rest = full.where(F.col("label") != F.col("top"))
    differ = (F.col("x.bucket") == F.col("y.bucket")) & ((F.col("y.label") == F.col("y.top")) | (F.col("x.label") < F.col("y.label")))
    # Both list the buckets in one order: the first that they share gives out the pair, and every one if more were cut off.
    first = F.coalesce(F.get(F.array_intersect("x.firsts", "y.firsts"), F.lit(0)) == F.col("x.bucket"), F.lit(True))
    pairs = rest.alias("x").join(full.alias("y"), differ & near("x", "y") & likely & first).select(*ends).distinct()
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    if names is not None:
        x, y = (names.select(F.col("node").alias(c), F.struct(*names.columns).alias(r)) for c, r in ("ax", "by"))
        pairs = materialize(pairs.join(x, "a").join(y, "b").where(near_last("x", "y")).select("a", "b"), "close")
    return _merged(labels, jaccard_links(pairs, sets, percent, True))


def _met(star: DataFrame, *more: Column) -> DataFrame:
    """node, a, b, and the number of buckets in which the node meets this pivot."""
    met = star.groupBy(F.col("x.node").alias("node"), F.col("x.p.node").alias("other")).agg(F.count("*").alias("n"), *more)
    return met.withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")}).drop("other")


def _chosen(met: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of each node with ``most`` pivots at most, those of most buckets."""
    order = Window.partitionBy("node").orderBy(F.desc("n"), F.xxhash64("a", "b"))
    return met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("a", "b").distinct()


def _with(links: DataFrame, more: DataFrame | None) -> DataFrame:
    return links if more is None else links.union(more)


def _open(now: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The rows, with label and the bucket's largest class (top), of buckets in which two classes or more are left; and the pairs of different classes."""
    now = now.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = now.groupBy("bucket", "label").agg(F.count("*").cast("double").alias("n"))
    left = per.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.max(F.struct("n", "label"))["label"].alias("top"))
    left = materialize(left.where("classes > 1").select("bucket", "top", ((F.col("n") * F.col("n") - F.col("n2")) / 2).alias("pairs")), "open-buckets")
    pairs = left.agg(F.sum("pairs")).first()[0] or 0
    return (materialize(now.join(left.select("bucket", "top"), "bucket"), "open") if pairs else now), pairs


def _full(now: DataFrame, sets: DataFrame) -> DataFrame:
    """The open rows with items and sketch of their nodes, and the first FIRST of a node's open buckets in the order of its rows, which all nodes share."""
    own = [c for c in now.columns if c not in ("bucket", "node", "label", "top")]
    per = now.groupBy("node").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct(*own, "bucket", "top"))).alias("at"))
    per = per.withColumn("firsts", F.slice(F.transform("at", lambda r: r["bucket"]), 1, FIRST))
    per = per.join(sets.select("node", F.col("n").alias("items"), "sketch"), "node")
    return materialize(per.select("node", "label", "items", "sketch", "firsts", F.inline("at")), "open-full")


def _pivots(full: DataFrame, turn: int) -> DataFrame:
    """A row of each of the PIVOTS largest classes of a bucket."""
    own = [c for c in full.columns if c not in ("bucket", "label", "top", "firsts")]
    per = full.groupBy("bucket", "label").agg(F.count("*").alias("size_"), F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("lot"), *own)).alias("p"))
    # Equal sizes are drawn by one lot for all buckets, so that few nodes serve as pivots.
    order = Window.partitionBy("bucket").orderBy(F.desc("size_"), "p.lot", "label")
    return per.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS).select("bucket", "label", *[F.col(f"p.{c}").alias(c) for c in own])


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    links = materialize(links, "links")
    if links.isEmpty():
        return labels
    return components(links.union(labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))))


def may(m: str, n: str, x: str, y: str, percent: int) -> Column:
    """Whether two sets of m and n items can be alike, by their sketches: one bit turned an item, so that no more bits differ than items do."""
    m, n = F.col(m), F.col(n)
    # Shorter sketches count as filled up with zeros.
    bits = reduce(Column.__add__, [F.coalesce(F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))), F.lit(0)) for w in range(SKETCH)])
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * bits <= (100 - percent) * (m + n))


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two sets have 100 * intersection >= percent * union."""
    m, n, same = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (100 * same >= percent * (m + n - same))


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int, likely: bool = False) -> DataFrame:
    """The pairs whose sets (node, items: distinct values, n, sketch) are alike; ``likely`` ones have passed their sketches."""
    if not likely:
        x, y = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        pairs = materialize(pairs.join(x, "a").join(y, "b").where(may("na", "nb", "sa", "sb", percent)).select("a", "b"), "close")
    if pairs.count() <= FEW:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    x = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    y = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    return pairs.join(x, "b").join(y, "a").where(alike("left", "right", percent)).select("a", "b")
