"""Consolidating pairwise matches into groups.

Method: low-diameter decomposition (Miller, Peng and Xu 2013). Every vertex draws an exponential shift; clusters grow
from the shifted start times, one hop a round, and a vertex joins the cluster that reaches it first. The clusters are
contracted to super-vertices, the edges between clusters are the next level's graph, and when none are left the
assignments of all levels are composed, one table a level. The last FINISH edges are decomposed the same way by one task.

Shifts are capped at ROUNDS, so growth is complete after ROUNDS rounds: each level is exactly the decomposition for the
capped shifts. The paper's bound on the edges cut holds for shifts without a cap, which need rounds in proportion to the
logarithm of the vertices in each level; with the cap a fifth of the vertices start at time 0. What a level leaves was
measured instead (README): 0.38 of the edges of the test data, 0.45 of a chain, 0.37 to 0.45 of a grid. Results don't
depend on it.

Vertices are numbered densely, never hashed, so unlike items can't be merged by accident. A label is one long, the time
of arrival above the number of the center, and every aggregate is its `min`, combined before the shuffle; joins on a
hub's edges are split by adaptive execution. Levels are cut by tables in the shared folder.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.operators.contraction import FINISH, canonical, contracted
from echolex.session import Scratch, small_table

#: Rate of the exponential shifts, and the cap on a shift, that is the number of rounds in which clusters grow.
RATE = 0.4
ROUNDS = 4
#: Bits of a label for the number of the center (2**40 vertices), and for the fraction of a time.
CENTER_BITS, FRACTION_BITS = 40, 19
HOP = 1 << (CENTER_BITS + FRACTION_BITS)


def _start(vertex: Column, level: int, seed: int) -> Column:
    """A vertex's own label: the start time ROUNDS minus its exponential shift, capped at ROUNDS, and itself. A pure
    function of its arguments, so a task that runs again draws the same."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed * 1000 + level), vertex), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    time = ROUNDS - F.least(-F.log(uniform) / RATE, F.lit(float(ROUNDS)))
    return F.shiftleft(F.floor(time * (1 << FRACTION_BITS)).cast("bigint"), CENTER_BITS).bitwiseOR(vertex)


def _grow(edges: DataFrame, level: int, seed: int) -> DataFrame:
    """(v, center) for every end of (a, b) edges."""
    arcs = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    first = arcs.groupBy(F.col("dst").alias("v")).agg(F.min(_start(F.col("src"), level, seed) + HOP).alias("came"))
    labels = first.select("v", F.least("came", _start(F.col("v"), level, seed)).alias("label"))
    for _ in range(ROUNDS - 1):
        # every arc carries its source's label to the target, and back to the source itself
        to_target = F.struct(F.col("dst").alias("v"), (F.col("label") + HOP).alias("label"))
        to_source = F.struct(F.col("src").alias("v"), F.col("label").alias("label"))
        came = arcs.join(labels.withColumnRenamed("v", "src"), "src").select(F.inline(F.array(to_target, to_source)))
        labels = came.groupBy("v").agg(F.min("label").alias("label"))
    return labels.select("v", F.col("label").bitwiseAND((1 << CENTER_BITS) - 1).alias("center"))


def _numbered(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, number): distinct items with dense numbers. The numbers are written down, so they never change."""
    rows = scratch.cut(items.distinct().withColumn("place", F.monotonically_increasing_id()))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("part")  # one a task
    sizes["offset"] = sizes["n"].cumsum() - sizes["n"]
    if sizes["n"].sum() >= 1 << CENTER_BITS:
        raise ValueError("too many items")
    known = small_table(items.sparkSession, part=sizes["part"], offset=sizes["offset"])
    return rows.withColumn("part", part).join(known, "part").select("item", (row + F.col("offset")).alias("number"))


def _grow_here(seed: int):
    """`_grow` over arrays, for the remainder that one task finishes."""

    def grow(a: np.ndarray, b: np.ndarray, size: int, level: int) -> np.ndarray:
        shifts = np.minimum(np.random.default_rng((seed, level)).exponential(1 / RATE, size), ROUNDS)
        label = np.floor((ROUNDS - shifts) * (1 << FRACTION_BITS)).astype(np.int64) << CENTER_BITS | np.arange(size)
        for _ in range(ROUNDS):
            then = label.copy()
            np.minimum.at(then, b, label[a] + HOP)
            np.minimum.at(then, a, label[b] + HOP)
            label = then
        return label & ((1 << CENTER_BITS) - 1)

    return grow


def decompose(edges: DataFrame, seed: int = 0, finish: int = FINISH) -> DataFrame:
    """(v, root) for every end of the (a, b) edges: `root`, a number, is the same for two vertices iff a chain links
    them.

    Loops and rows with a null end count for nothing, repeated edges once; a table without edges gives no rows.
    `finish`: how many edges are left to one task.
    """
    scratch = Scratch(edges.sparkSession, "components")
    named = scratch.cut(canonical(edges.select("a", "b")))
    ends = named.select(F.col("a").alias("item")).unionByName(named.select(F.col("b").alias("item")))
    numbers = scratch.cut(_numbered(ends, scratch))
    a = numbers.select(F.col("item").alias("a"), F.col("number").alias("x"))
    b = numbers.select(F.col("item").alias("b"), F.col("number").alias("y"))
    linked = named.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots, left = contracted(linked, scratch, lambda now, level: _grow(now, level, seed), _grow_here(seed), finish)
    logging.getLogger(__name__).info("edges before each level: %s", left)
    return scratch.cut(numbers.join(roots, F.col("number") == F.col("v")).select(F.col("item").alias("v"), "root"))


def set_edges(sets: DataFrame, items_col: str) -> DataFrame:
    """(a, b): a star in each set, from its smallest item to the others. Null and empty items count for nothing."""
    items = F.array_sort(F.array_distinct(F.filter(items_col, lambda x: x.isNotNull() & (x != F.lit("")))))
    kept = sets.select(items.alias("items")).where(F.size("items") > 1)
    return kept.select(F.element_at("items", 1).alias("a"), F.explode(F.slice("items", F.lit(2), F.size("items"))).alias("b"))


def word_groups(sets: DataFrame, items_col: str = "words", seed: int = 0) -> DataFrame:
    """(word, group_word): each distinct item whose group, over any chain of sets, has at least two distinct items;
    `group_word` is the group's smallest item in code-point order.

    Null and empty sets, null and empty items and sets of one distinct item link nothing; repeated sets and items count
    once; an empty table gives no rows; other columns don't matter.
    """
    roots = decompose(set_edges(sets, items_col), seed)
    names = roots.groupBy("root").agg(F.min("v").alias("group_word"))
    return roots.join(names, "root").select(F.col("v").alias("word"), "group_word")
