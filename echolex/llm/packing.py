"""Filling containers of one capacity with items of varying size.

Method: minimum bin slack. For each container the largest item left is put in, and a subset-sum dynamic programme over
the sizes still available (bitsets of reachable sums, large sizes first, each as often as it is left) finds the fullest
feasible combination for the rest, which is then removed. Items of one size are interchangeable, so the programme works
on the histogram of sizes: fewer than `capacity` numbers whatever the count of items, and a combination is used for as
many containers as the histogram allows. Most containers are closed by the sums of one or two sizes, which two bitsets
give at once; the programme over any number of sizes runs where they leave too much.

Only that bounded histogram and plan pass through the driver. Pieces that fill a container are numbered without a plan;
the others get their place by a rank within their size, over ranges of rows, so that no task sees all items of a popular
size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.operators.ranks import PART, in_ranges, ranked
from echolex.session import Scratch, small_table

#: The search for a combination ends at a slack of capacity // FINE, which spares small items for later containers.
FINE = 2048


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(size, how many in one container), ...]), ...] using up the histogram of sizes 1..capacity.

    The count of combinations depends on the capacity alone, not on the number of items.
    """
    left = {size: n for size, n in histogram.items() if n > 0}
    sizes = sorted(left)
    have = sum(1 << size for size in sizes)
    mirror = sum(1 << capacity - size for size in sizes)
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    while sizes:
        largest = sizes[-1]
        room = capacity - largest
        enough = max(0, room - capacity // FINE)
        used = _closed_by_two(sizes, left, have, mirror, room, max(1, enough), capacity) or _subset_sum(
            sizes, left, largest, room, enough, bisect_right(sizes, room)
        )
        times = min(left[size] // n for size, n in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for size, n in used.items():
            left[size] -= times * n
            if not left[size]:
                del sizes[bisect_left(sizes, size)]
                have ^= 1 << size
                mirror ^= 1 << capacity - size
    return plan


def _closed_by_two(sizes, left, have, mirror, room, enough, capacity) -> dict[int, int] | None:
    """The programme's branch of largest sizes: they are taken until two more can fill the room. The sums of one size
    are the bitset of sizes, those of two are where it meets its mirror image. None if none of them is `enough`."""
    used = {sizes[-1]: 1}
    at = bisect_right(sizes, room)
    while at and 2 * sizes[at - 1] < enough:
        size = sizes[at - 1]
        times = min(left[size] - used.get(size, 0), -(-(enough - 2 * size) // size))
        if times > 0:
            used[size] = used.get(size, 0) + times
            room, enough = room - times * size, enough - times * size
        at = min(at - 1, bisect_right(sizes, room))

    def closed(*chosen: int) -> dict[int, int] | None:
        counts = dict(used)
        for size in chosen:
            counts[size] = counts.get(size, 0) + 1
        return counts if all(left[size] >= counts[size] for size in chosen) else None

    if at and sizes[at - 1] >= enough and (found := closed(sizes[at - 1])):
        return found
    for target in range(room, max(enough, 2) - 1, -1):
        both = have & mirror >> capacity - target
        while both:
            size = both.bit_length() - 1
            if 2 * size < target:
                break
            if found := closed(size, target - size):
                return found
            both ^= 1 << size
    return None


def _subset_sum(sizes, left, largest, room, enough, fitting) -> dict[int, int]:
    """The fullest combination of any number of sizes with the largest one; it ends at a sum of `enough`."""
    steps: list[tuple[int, int, int, int]] = []
    reach, full, at = 1, (1 << (room + 1)) - 1, fitting
    while at and not reach >> enough:
        at -= 1
        size = sizes[at]
        count = min(left[size] - (size == largest), room // size)
        chunk = 1
        while count > 0 and not reach >> enough:
            take = min(chunk, count)  # binary splitting of the multiplicity
            steps.append((size, take, reach, take * size))
            reach = (reach | reach << take * size) & full
            count -= take
            chunk *= 2
    target = reach.bit_length() - 1
    used = {largest: 1}
    for size, take, earlier, weight in reversed(steps):
        if not earlier >> target & 1:
            target -= weight
            used[size] = used.get(size, 0) + take
    return used


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(`id_col`, piece, from_token, to_token, container_id): each item in one container, or, if it is larger than
    `capacity`, cut into pieces of exactly the capacity and a rest.

    A container's pieces never add up to more than `capacity`. Items of size 0 or of unknown (null) size take no space
    and are spread over the containers. Repeated ids are separate items; rows with a null id are packed too. An empty
    table gives no rows. `container_id` counts from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    size = F.greatest(F.coalesce(items[size_col].cast("bigint"), F.lit(0)), F.lit(0))
    base = scratch.cut(items.select(items[id_col].alias("item"), size.alias("size")))
    wholes, full = _whole_pieces(base.where(F.col("size") >= capacity), capacity, scratch)
    rest = F.pmod("size", F.lit(capacity))
    rests = base.select("item", F.expr(f"size div {capacity}").alias("piece"), rest.alias("size"), F.col("size").alias("to_token")).where("size > 0")
    # fewer than `capacity` numbers, whatever the number of items
    counted = rests.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = minimum_bin_slack({r["size"]: r["n"] for r in counted}, capacity)
    rows, seen, first = [], {}, full
    for times, used in plan:
        for size_, n in used:
            low = seen.get(size_, 0)
            rows.append((size_, low, low + n * times, n, first))
            seen[size_] = low + n * times
        first += times
    names = ("place_size", "low", "high", "each", "first")
    columns = zip(*rows) if rows else [[] for _ in names]
    places = small_table(spark, **{name: pa.array(column, pa.int64()) for name, column in zip(names, columns)})
    inside = (F.col("size") == F.col("place_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked(rests, scratch, ("item", "piece"), ("size",), "rank").join(places, inside).select(
        "item",
        "piece",
        (F.col("to_token") - F.col("size")).alias("from_token"),
        "to_token",
        F.expr("first + (rank - low) div each").alias("container_id"),
    )
    none = F.lit(0).cast("bigint")
    empty = base.where("size = 0").select(
        "item", none.alias("piece"), none.alias("from_token"), none.alias("to_token"),
        F.pmod(F.xxhash64("item"), F.lit(max(1, first))).alias("container_id"),
    )
    return wholes.unionByName(placed).unionByName(empty).withColumnRenamed("item", id_col)


def _whole_pieces(large: DataFrame, capacity: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(item, piece, from_token, to_token, container_id) of the pieces that fill a container, and how many there are: a
    running count over ranges of items."""
    ranged = in_ranges(large.withColumn("number", F.expr(f"size div {capacity}")), scratch, "item", "size")
    sums = ranged.groupBy(PART).agg(F.sum("number").alias("sum"))
    full = sums.agg(F.coalesce(F.sum("sum"), F.lit(0))).first()[0]
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select(PART, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(PART).orderBy("item", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("within", F.coalesce(F.sum("number").over(within), F.lit(0))).join(offsets, PART)
    pieces = counted.select("item", (F.col("offset") + F.col("within")).alias("at"), F.explode(F.expr("sequence(0L, number - 1)")).alias("piece"))
    start = F.col("piece") * capacity
    return pieces.select(
        "item", "piece", start.alias("from_token"), (start + capacity).alias("to_token"), (F.col("at") + F.col("piece")).alias("container_id")
    ), full


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill): how full the containers of `pack` are."""
    used = F.coalesce(F.sum(F.col("to_token") - F.col("from_token")), F.lit(0)).cast("bigint")
    whole = packed.agg(F.count_distinct("container_id").alias("containers"), used.alias("tokens"))
    return whole.select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
