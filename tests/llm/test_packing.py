import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolex.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9), max_size=12), st.integers(40, 60))
def test_the_plan_uses_every_item_once(histogram, capacity):
    used = defaultdict(int)
    for times, items in P.minimum_bin_slack(histogram, capacity):
        assert times > 0 and sum(s * n for s, n in items) <= capacity
        for s, n in items:
            used[s] += n * times
    assert used == {s: n for s, n in histogram.items() if n}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_the_first_container_is_as_full_as_it_can_be(sizes):
    capacity = 20
    histogram = {s: sizes.count(s) for s in sizes}
    _, items = P.minimum_bin_slack(histogram, capacity)[0]
    rest = sorted(sizes)
    largest = rest.pop()
    sums = {0}
    for s in rest:
        sums |= {x + s for x in sums}
    assert sum(s * n for s, n in items) == largest + max(x for x in sums if x + largest <= capacity)


def packed(spark, sizes, capacity):
    rows = spark.createDataFrame([(i, s, 7, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, size int, piece string")
    return [r.asDict() for r in P.pack(rows, capacity).collect()]


def check(rows, sizes, capacity):
    pieces, fill = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["from_token"], r["to_token"]))
        fill[r["container_id"]] += r["to_token"] - r["from_token"]
    assert pieces.keys() == set(range(len(sizes)))
    for i, size in enumerate(sizes):
        size = size or 0
        cuts = sorted(pieces[i])
        assert [c[0] for c in cuts] == list(range(max(1, -(-size // capacity))))
        assert cuts[0][1] == 0 and cuts[-1][2] == size and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
        assert all(c[2] - c[1] == capacity for c in cuts[:-1])
    assert all(f <= capacity for f in fill.values())
    assert fill.keys() <= set(range(max(fill) + 1))
    return fill


def test_mixed_sizes(spark):
    r = random.Random(2)
    sizes = [r.choice([0, None, 5, 64, 65, 128, 300]) if r.random() < 0.3 else r.randint(1, 64) for _ in range(3000)]
    fill = check(packed(spark, sizes, 64), sizes, 64)
    assert len(fill) <= first_fit_decreasing([c for s in sizes if s for c in [64] * (s // 64) + [s % 64] if c], 64)


def first_fit_decreasing(sizes, capacity):
    left = []
    for size in sorted(sizes, reverse=True):
        at = next((i for i, room in enumerate(left) if room >= size), None)
        if at is None:
            left.append(capacity - size)
        else:
            left[at] -= size
    return len(left)


@pytest.mark.parametrize("seed", range(4))
def test_token_like_sizes_leave_little_unused(seed):
    r = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, 1 + int(r.expovariate(1 / 700)))] += 1
    containers = sum(times for times, _ in P.minimum_bin_slack(histogram, 2048))
    assert containers <= 1.002 * sum(s * n for s, n in histogram.items()) / 2048 + 1


@pytest.mark.parametrize("capacity, mean", [(32_768, 9_000), (131_072, 30_000)])
def test_large_capacities(capacity, mean):
    r = random.Random(capacity)
    histogram = defaultdict(int)
    for _ in range(40_000):
        histogram[min(capacity - 1, 1 + int(r.expovariate(1 / mean)))] += 1
    used, containers = defaultdict(int), 0
    for times, items in P.minimum_bin_slack(histogram, capacity):
        containers += times
        assert sum(s * n for s, n in items) <= capacity
        for s, n in items:
            used[s] += n * times
    assert used == histogram
    assert containers <= 1.002 * sum(s * n for s, n in histogram.items()) / capacity + 1


def test_many_whole_pieces_of_hot_items(spark):
    sizes = [64] * 500 + [6400] * 20 + [64 * 3 + 1] * 50 + [65] * 300
    fill = check(packed(spark, sizes, 64), sizes, 64)
    assert sum(f == 64 for f in fill.values()) >= 500 + 2000 + 150 + 300 and len(fill) == 2950 + 6


def test_all_of_one_size(spark):
    sizes = [30] * 1001
    fill = check(packed(spark, sizes, 64), sizes, 64)
    assert len(fill) == 501


@pytest.mark.parametrize("sizes", [[], [0], [None, 0], [1000]])
def test_small(spark, sizes):
    rows = packed(spark, sizes, 64)
    if sizes:
        check(rows, sizes, 64)
    else:
        assert rows == []


def test_fill(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, n_tokens long")
    assert tuple(P.fill(P.pack(rows, 40), 40).first()) == (1, 30, 0.75)
    with pytest.raises(ValueError):
        P.pack(rows, 0)
