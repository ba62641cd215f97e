"""Merging overlapping groups: connected components of the graph of sets and their items.

Items are numbered in their own order, so the smallest number of a component is that of its smallest item, and all steps
but the first and the last work on numbers. In each level every vertex moves to the neighbour (or itself) of the least
random priority, and on to where that one moves; the graph is contracted, which leaves a fraction of it whatever its
shape. Minima are combined before their shuffles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.operators.contraction import FINISH, canonical, contracted
from echolex.operators.homophones import finish_groups
from echolex.operators.ranks import ranked
from echolex.session import Scratch

#: Bits of a label for the number of a vertex; its priority stands above them.
VERTEX_BITS = 40


def _moved(edges: DataFrame, number: int) -> DataFrame:
    """(v, center) for every end of (a, b) edges."""
    arcs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def label(vertex: str):
        priority = F.shiftrightunsigned(F.xxhash64(F.lit(number), vertex), VERTEX_BITS + 1)
        return F.shiftleft(priority, VERTEX_BITS).bitwiseOR(F.col(vertex))

    least = arcs.groupBy("a").agg(F.min(label("b")).alias("near"))
    to = F.least("near", label("a")).bitwiseAND((1 << VERTEX_BITS) - 1)
    first = least.select(F.col("a").alias("v"), to.alias("to"))
    onward = first.select(F.col("v").alias("to"), F.col("to").alias("center"))
    return first.join(onward, "to").select("v", "center")


def _moved_here(a: np.ndarray, b: np.ndarray, size: int, number: int) -> np.ndarray:
    """The same of dense vertices in one task."""
    order = np.random.default_rng(number).permutation(size)
    least = order.copy()
    np.minimum.at(least, a, order[b])
    np.minimum.at(least, b, order[a])
    to = np.argsort(order)[least]
    return to[to]


def component_labels(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(item, label) for every item of (a, b): the label is the smallest item reachable over any chain of edges.

    An edge from an item to itself only names the item. Edges with a null end are dropped; no edges, no rows. `finish`:
    how many edges are left to one task.
    """
    scratch = Scratch(edges.sparkSession, "groups")
    named = scratch.cut(edges.select("a", "b").dropna().distinct())
    items = named.select(F.col("a").alias("item")).unionByName(named.select(F.col("b").alias("item"))).distinct()
    numbers = scratch.cut(ranked(items, scratch, ("item",), name="number"))
    a = numbers.select(F.col("item").alias("a"), F.col("number").alias("x"))
    b = numbers.select(F.col("item").alias("b"), F.col("number").alias("y"))
    linked = named.where("a <> b").join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots, _ = contracted(canonical(linked), scratch, _moved, _moved_here, finish)
    roots = scratch.cut(roots)
    least = roots.groupBy("root").agg(F.min("v").alias("least"))
    labelled = roots.join(least, "root").select(F.col("v").alias("number"), "least")
    labelled = numbers.join(labelled, "number", "left").select("item", F.coalesce("least", "number").alias("number"))
    return labelled.join(numbers.withColumnRenamed("item", "label"), "number").select("item", "label")


def set_edges(sets: DataFrame, items: str) -> DataFrame:
    """(a, b) from the first item of each set to all of them (also to itself, so that single items are named)."""
    held = sets.select(F.filter(items, lambda x: x.isNotNull() & (x != "")).alias("held")).where(F.size("held") > 0)
    return held.select(F.element_at("held", 1).alias("a"), F.explode("held").alias("b"))


def merged_members(sets: DataFrame, items: str = "words") -> DataFrame:
    """(item, label): every item of the sets with the smallest item of its merged group, singles too. The form for
    groups of any size; null and empty items count for nothing."""
    return component_labels(set_edges(sets, items))


def _lists(labels: DataFrame) -> DataFrame:
    """(words) of (item, label), for text output: a group is one row, so it has to fit into one task."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("item")).alias("words")).select("words")


def merge_sets(sets: DataFrame, items: str = "words") -> DataFrame:
    """(words): the merged groups as lists, singles kept; every item is in exactly one group."""
    return _lists(merged_members(sets, items))


def merge_groups(sets: DataFrame, items: str = "words") -> DataFrame:
    """(words): `merge_sets` without groups of one distinct word."""
    return finish_groups(merge_sets(sets, items))


def connected_groups(rows: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """(words) like `merge_sets`, of (set, item) rows with ids of any type; items are strings."""
    named = rows.select(F.col(set_col).alias("s"), F.col(item_col).alias("item")).dropna()
    firsts = named.groupBy("s").agg(F.min("item").alias("a"))
    edges = named.join(firsts, "s").select("a", F.col("item").alias("b"))
    return _lists(component_labels(edges))
