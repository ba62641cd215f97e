import random

import pytest

from echolex.operators import groups as G


def sets(spark, lines):
    return spark.createDataFrame([(line.split(),) for line in lines], "words array<string>")


def words(df):
    return sorted(" ".join(r["words"]) for r in df.collect())


@pytest.mark.parametrize(
    "lines, out",
    [(["k7 m2 q9", "m2 r1", "t4 q0"], ["k7 m2 q9 r1", "q0 t4"]), (["one two", "three four", "two three", "five six"], ["five six", "four one three two"]),
     (["solo"], []), (["twice twice"], [])],
)
def test_merge(spark, lines, out):
    assert words(G.merge_groups(sets(spark, lines))) == out


@pytest.mark.parametrize(
    "pairs, out",
    [([(4, "p"), (4, "p")], ["p"]), ([(4, "q"), (4, "p")], ["p q"]), ([(9, "u"), (9, "v"), (8, "v"), (8, "w"), (7, "x"), (None, "x")], ["u v w", "x"])],
)
def test_connected_groups(spark, pairs, out):
    assert words(G.connected_groups(spark.createDataFrame(pairs, "s int, item string"), "s", "item")) == out


@pytest.mark.parametrize("finish", [0, 40])
def test_levels(spark, finish):
    r = random.Random(5)
    edges = [(f"g{i // 50}-{r.randrange(30)}", f"g{i // 50}-{r.randrange(30)}") for i in range(300)] + [("hub", f"h{i}") for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = G.component_labels(spark.createDataFrame(edges, "a string, b string"), finish).collect()
    assert {r["item"]: r["label"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_long_chain_and_idempotence(spark):
    names = [f"w{i:03d}" for i in range(120)]
    random.Random(3).shuffle(names)
    chain = [f"{a} {b}" for a, b in zip(names, names[1:])]
    once = G.merge_groups(sets(spark, chain))
    assert words(once) == [" ".join(sorted(names))]
    assert words(G.merge_groups(once)) == words(once)


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None,), ([],), ([None, ""],), (["a", None, "b"],)], "words array<string>")
    assert words(G.merge_groups(rows)) == ["a b"]
    assert words(G.merge_groups(rows.limit(0))) == []
