import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from echolex.llm import components as C


def union_find(sets):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for items in sets:
        items = [x for x in items or [] if x]
        for x in items:
            parent[find(x)] = find(items[0])
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return sorted((x, min(g)) for g in groups.values() if len(g) > 1 for x in g)


def found(spark, sets, **more):
    rows = spark.createDataFrame([(s, "clash", "clash") for s in sets], "words array<string>, word string, v string")
    return sorted(map(tuple, C.word_groups(rows, **more).collect()))


CASES = {
    "nulls": [None, [], [None, ""], ["a", None, "b"], ["", "c"], ["d", "d"]],
    "repeats": [["b", "a"], ["b", "a"], ["a", "b", "a"], ["x"], ["c", "b"]],
    "case and code points": [["É", "é"], ["é", "Z"], ["🂡", "￿"], ["a ", "a"]],
    "hub": [["hub", f"w{i}"] for i in range(60)],
    "empty": [],
    "long": [["x" * 50_000, "y"], ["y", "z" * 50_000]],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert found(spark, CASES[name]) == union_find(CASES[name])


def test_long_chain(spark):
    names = [f"n{i:03d}" for i in range(150)]
    random.Random(1).shuffle(names)
    sets = [[a, b] for a, b in zip(names, names[1:])]
    assert found(spark, sets) == union_find(sets)


@pytest.mark.parametrize("finish", [0, 30])
def test_levels(spark, finish):
    sets = [["hub", f"h{i}"] for i in range(40)] + [[f"c{i}", f"c{i + 1}"] for i in range(40)] + [[f"g{i}", f"g{i + 7}"] for i in range(60)]
    edges = spark.createDataFrame(sets, "a string, b string")
    got = C.decompose(edges, finish=finish).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], []).append(r["v"])
    assert sorted((x, min(g)) for g in groups.values() for x in g) == union_find(sets)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 30).map(str), max_size=3), min_size=1, max_size=25), st.integers(0, 5))
def test_any_sets_and_seeds(spark, sets, seed):
    assert found(spark, sets, seed=seed) == union_find(sets)
