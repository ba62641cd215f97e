import random

import pytest

from echolex.operators import similar as S
from echolex.sources import text


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lists(df):
    return [" ".join([r["word"], *r["matches"]]) for r in df.orderBy("ord").collect()]


THREE = [("a", "x"), ("ab", "xy"), ("bb", "yy")]


@pytest.mark.parametrize("d, out", [(1, ["a ab", "ab a bb", "bb ab"]), (2, ["a ab bb", "ab a bb", "bb a ab"])])
@pytest.mark.parametrize("strategy", list(S.STRATEGIES))
def test_lists(spark, d, out, strategy):
    assert lists(S.similar_lists(S.similar_pairs(text.from_entries(spark, THREE), distance=d, strategy=strategy))) == out


@pytest.mark.parametrize("p, d, out", [("y", 0, []), ("p", 0, ["w"]), ("p", 1, ["w", "w2"])])
def test_lookup(spark, p, d, out):
    rows = text.from_entries(spark, [("w", "p"), ("w2", "p2")])
    assert [r["word"] for r in S.lookup(rows, p, d).orderBy("ord").collect()] == out


def brute(x, y, d):
    return sorted((i, j, edit(p, q)) for i, (w, p) in enumerate(x) for j, (v, q) in enumerate(y) if (w, p) != (v, q) and edit(p, q) <= d)


def some(seed, n):
    r = random.Random(seed)
    return [("w" + r.choice("abc"), "".join(r.choice("abʌ") for _ in range(r.randint(0, 6)))) for _ in range(n)]


@pytest.mark.parametrize("d", [0, 1, 2, 3])
@pytest.mark.parametrize("strategy", list(S.STRATEGIES))
def test_against_brute_force(spark, d, strategy):
    x, y = some(1, 40), some(2, 30)
    for right in (None, y):
        found = S.similar_pairs(
            text.from_entries(spark, x), None if right is None else text.from_entries(spark, right), d, strategy
        )
        got = sorted((r["ord"], r["match_ord"], r["distance"]) for r in found.collect())
        assert got == brute(x, x if right is None else right, d)


def test_homographs_and_repeated_rows(spark):
    rows = text.from_entries(spark, [("a", "x"), ("a", "xy"), ("a", "x"), ("b", "x")])
    found = lists(S.similar_lists(S.similar_pairs(rows, distance=1)))
    assert found == ["a a b", "a a a b", "a a b", "b a a a"]


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "x")], "ord long, word string, phonemes string")
    assert S.similar_pairs(rows, distance=2).count() == 0
    assert S.similar_pairs(text.empty(spark), distance=1).count() == 0
    with pytest.raises(ValueError):
        S.similar_pairs(rows, distance=-1)


def test_search_query_finds_what_lookup_finds(spark):
    import __spark_entry__ as entries

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/dictionary.parquet")
    found = {tuple(r) for r in entries.queries()["search_similar_d1"](spark, folder).collect()}
    every = [(r["ord"], r["phonemes"]) for r in rows.select("ord", "phonemes").dropna().collect()]
    asked = [(o, p) for o, p in every if o % 50 == 0]
    for o, p in asked[:5]:
        assert {m for q, m, _ in found if q == o} == {r["ord"] for r in S.lookup(rows, p, 1).collect()}
    assert {q for q, _, _ in found} == {o for o, _ in asked} and any(d == 1 for _, _, d in found)
