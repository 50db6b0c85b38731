"""Connected components of an edge table by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.tables import discard

Store = Callable[[DataFrame, str], DataFrame]


def component_labels(edges: DataFrame, store: Store) -> tuple[DataFrame, int]:
    """(node, label) for every endpoint of `edges` (src, dst), label the smallest node of its component; and the rounds.

    In a round every node hooks to its smallest neighbour if that is smaller, pointer doubling turns the trees into
    stars, and the edges are rewritten to the stars' roots. A root may be left without a child, as 5 in 5-9 and 1-9;
    then its neighbour hooked to a smaller node, so that in the next round the root has a smaller neighbour and hooks
    itself. So the nodes with edges halve at least every two rounds: O(log V) rounds of O(log depth) joins. `store`
    writes a table and reads it back; what a later step has replaced is removed. The hooks are partial aggregates; the
    joins read two stored tables each, whose exchanges adaptive execution can split at a hub. Null endpoints and loops
    add nothing but their node.
    """
    ends = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = store(ends.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct(), "pairs")
    left, labels, rounds = None, None, 0
    links = pairs.where("lo < hi")
    while not links.isEmpty():
        rounds += 1
        tree = store(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        moved = True
        while moved:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            lifted = tree.select("node", "root").join(up, "root", "left")
            new = store(lifted.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "stars")
            discard(tree)
            tree, moved = new, not new.where("moved").isEmpty()
        low = tree.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        high = tree.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        half = store(links.join(low, "lo", "left").select("hi", F.coalesce("lo_root", "lo").alias("a")), "half")
        rewritten = half.join(high, "hi").select(F.col("a"), F.col("hi_root").alias("b")).where("a <> b")
        links = store(rewritten.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
        discard(half)
        if left is not None:
            discard(left)
        left = links
        if labels is None:
            labels = tree
        else:
            later = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved_on = labels.select("node", "root").join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            new = store(moved_on.unionByName(tree.select("node", "root")), "labels")
            discard(labels), discard(tree)
            labels = new
    nodes = pairs.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    if labels is None:
        return nodes.select("node", F.col("node").alias("label")), rounds
    found = nodes.join(labels.select("node", F.col("root").alias("label")), "node", "left")
    named = store(found.select("node", F.coalesce("label", "node").alias("label")), "components")
    for done in (pairs, left, labels):
        discard(done)
    return named, rounds
