"""Components of a graph by repeated contraction.

Each level assigns every vertex to a center of its own component; the edges between centers are the next level's graph.
The remainder is finished by one task once it has FINISH edges or fewer (2 MB), which saves the levels whose graphs are
too small to be worth a job. At the end the assignments of all levels are composed from the last one down, a table for
each level, so that no plan spans several of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.session import Scratch

#: Edges that one task finishes: two longs each, whatever the size of the input was.
FINISH = 1 << 16
MOST_LEVELS = 200

Level = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]


def canonical(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once; loops and null ends dropped."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def finished(a: np.ndarray, b: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of every end of the edges; `level(a, b, vertices, number)` gives a center for each of the dense
    vertices."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root, number = np.arange(len(ids)), 0
    while len(a):
        if number == MOST_LEVELS:
            raise RuntimeError(f"edges are left after {MOST_LEVELS} levels")
        held, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        to = np.arange(len(ids))
        to[held] = held[level(places[: len(a)], places[len(a) :], len(held), number)]
        root, a, b, number = to[root], to[a], to[b], number + 1
        apart = a != b
        both = np.unique(np.minimum(a, b)[apart] * len(ids) + np.maximum(a, b)[apart])
        a, b = both // len(ids), both % len(ids)
    return ids, ids[root]


def contracted(
    edges: DataFrame, scratch: Scratch, step: Callable[[DataFrame, int], DataFrame], level: Level, finish: int = FINISH
) -> tuple[DataFrame, list[int]]:
    """((v, root) for every end of the canonical (a, b) edges of longs, edges left before each level).

    `step(edges, number)` gives (v, center) for every end of the edges."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            v, root = finished(*(np.concatenate(x) for x in zip(*held)), level)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], ["v", "center"])

    at, levels, left = scratch.write(edges), [], []
    while (count := scratch.read(at, "a bigint, b bigint").count()) > 0:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"{count} edges are left after {MOST_LEVELS} levels")
        left.append(count)
        now = scratch.read(at, "a bigint, b bigint")
        if count <= finish:
            levels.append(scratch.cut(now.coalesce(1).mapInArrow(solve, "v bigint, center bigint")))
            break
        levels.append(scratch.cut(step(now, len(levels))))
        a = levels[-1].select(F.col("v").alias("a"), F.col("center").alias("x"))
        b = levels[-1].select(F.col("v").alias("b"), F.col("center").alias("y"))
        then = scratch.write(canonical(now.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
        scratch.drop(at)
        at = then
    if not levels:
        return scratch.read(at, "a bigint, b bigint").select(F.col("a").alias("v"), F.col("b").alias("root")), left
    roots = levels.pop().withColumnRenamed("center", "root")
    while levels:
        upper = roots.select(F.col("v").alias("center"), "root")
        roots = levels.pop().join(upper, "center", "left").select("v", F.coalesce("root", "center").alias("root"))
        roots = scratch.cut(roots) if levels else roots
    return roots, left
