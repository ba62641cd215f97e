import pytest

from echolex.operators import homophones as H
from echolex.sources import text


def dictionary(spark, entries):
    return text.from_entries(spark, [tuple(e.split("/")) for e in entries.split()])


def words(df):
    return [" ".join(r["words"]) for r in H.ordered(df).collect()]


@pytest.mark.parametrize(
    "entries, groups",
    [("w/p w1/p1", []), ("w/p w/p", []), ("c/p a/p d/q", ["a c"]), ("c/p b/p d/q a/q", ["a d", "b c"]), ("", []),
     ("cc/a bb/b cc/a aa/a", ["aa cc"]), ("a/x b/x a/y b/y", ["a b", "a b"])],
)
def test_one_source(spark, entries, groups):
    assert words(H.homophones(dictionary(spark, entries))) == groups


@pytest.mark.parametrize(
    "first, second, groups",
    [("w/p", "w1/p1", []), ("w/p w1/p", "w1/p1", []), ("w/p", "w/p", []), ("w/p", "w1/p", ["w w1"]),
     ("c/p d/q", "b/p a/q", ["a d", "b c"]), ("cc/a bb/b cc/a aa/a", "cc/x ab/b", ["ab bb"])],
)
def test_two_sources(spark, first, second, groups):
    both = H.tagged(dictionary(spark, first), dictionary(spark, second))
    assert words(H.cross_homophones(both)) == groups


def test_nulls_and_empty_pronunciations(spark):
    rows = spark.createDataFrame([("a", ""), ("b", ""), (None, ""), ("c", None), ("d", None)], "word string, phonemes string")
    assert words(H.homophones(rows)) == ["a b"]


def test_code_point_order(spark):
    assert words(H.homophones(dictionary(spark, "é/x z/x b/x B/x a/x"))) == ["B a b z é"]


def test_finish_groups(spark):
    rows = spark.createDataFrame([([2, 1],), ([1, 1],), ([4, 2, 2],), ([3, 3, 3],), ([5, 6, 1, 5],), (None,), ([None, 7],)], "words array<int>")
    assert sorted(r[0] for r in H.finish_groups(rows).collect()) == [[1, 2], [1, 5, 6], [2, 4]]


def test_multimap(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate([(1, 2), (3, 4), (1, 5), (1, 2), (3, 6)])], "ord int, k int, v int")
    assert {r["k"]: r["values"] for r in H.multimap(rows, "k", "v", "ord").collect()} == {1: [2, 5, 2], 3: [4, 6]}


@pytest.mark.parametrize("xs", [[], [1], [1, 2, 3], [1, 1, 1, 2, 2, 1, 3, 2, 1, 1], [None, None, 1, None], [5] * 40])
def test_squeeze_rows(spark, xs):
    rows = spark.createDataFrame(list(enumerate(xs)), "ord int, v int").repartition(3)
    got = [r["v"] for r in sorted(H.squeeze_rows(rows, "v", "ord").collect(), key=lambda r: r["ord"])]
    assert got == [x for i, x in enumerate(xs) if i == 0 or x != xs[i - 1]]


@pytest.mark.parametrize("constant", [False, True])
def test_squeeze_rows_keeps_other_columns(spark, constant):
    rows = spark.range(20_000).selectExpr("id AS ord", "'x' AS same" if constant else "CAST(id % 7 < 4 AS string) AS same", "uuid() AS more", "id % 3 AS __p")
    rows = H.Scratch(spark, "test").cut(rows).repartition(5)
    got = [r["ord"] for r in H.squeeze_rows(rows, "same", "ord").collect()]
    order = H.Window.orderBy("ord")
    was = H.F.lag("same").over(order)
    expected = rows.withColumn("was", was).withColumn("n", H.F.row_number().over(order)).where("n = 1 OR NOT same <=> was")
    assert sorted(got) == sorted(r["ord"] for r in expected.collect())
    assert not constant or got == [0]


def test_multimap_rows(spark):
    rows = spark.range(3000).selectExpr("id AS ord", "IF(id % 3 > 0, 'hot', IF(id % 2 = 0, NULL, CAST(id % 9 AS string))) AS k", "CAST(id % 5 AS int) AS v", "1 AS nth")
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r["ord"]):
        expected.setdefault(r["k"], []).append(r["v"])
    got = {}
    for r in sorted(H.multimap_rows(rows.repartition(4), "k", "v", "ord").collect(), key=lambda r: r["nth"]):
        assert r["nth"] == len(got.setdefault(r["k"], []))
        got[r["k"]].append(r["v"])
    assert got == expected
    assert H.multimap_rows(rows.limit(0), "k", "v", "ord").count() == 0


def test_members(spark):
    rows = dictionary(spark, "cc/a bb/b cc/a aa/a b/x a/x")
    assert sorted(map(tuple, H.homophone_members(rows).collect())) == [("a", "aa"), ("a", "cc"), ("x", "a"), ("x", "b")]
