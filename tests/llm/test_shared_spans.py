import random

import numpy as np
import pytest

from echolex.llm import shared_spans as S


def brute(rows, span):
    owners = {}
    for i, text in rows:
        for k in range(len(text or "") - span + 1):
            owners.setdefault(text[k : k + span], set()).add(i)
    out = []
    for i, text in rows:
        shared = [False] * len(text or "")
        for k in range(len(shared) - span + 1):
            if len(owners[text[k : k + span]]) > 1:
                shared[k : k + span] = [True] * span
        start = None
        for k, s in enumerate([*shared, False]):
            if s and start is None:
                start = k
            elif not s and start is not None:
                out.append((i, start, k))
                start = None
    return sorted(out)


def texts(seed, alphabet):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [word(r.randint(60, 500)) for _ in range(6)]
    out = []
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts += [word(r.randint(0, 200)), p[a : r.randint(a, len(p))] if r.random() < 0.7 else p]
        out.append("".join(parts))
    return [*out, out[0], out[1][5:], None, "", " ", "a" * 700, "a" * 400, "-" * 300 + out[2], "ab" * 300, "b" + "ab" * 200]


@pytest.mark.parametrize("seed, alphabet, span", [(1, "abcdefgh \n𝗎é", 200), (2, "ab", 100), (3, "abcdefghij", 64), (4, "xyz", 150)])
def test_against_all_windows(spark, seed, alphabet, span):
    rows = list(enumerate(texts(seed, alphabet)))
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, body string, first int")
    assert sorted(map(tuple, S.shared_spans(df, span).collect())) == brute(rows, span)


def test_within_one_document_nothing_is_shared(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 100), (None, "abcdefghij" * 100)], "doc_id long, text string")
    assert S.shared_spans(df, 100).count() == 0
    assert S.shared_spans(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(df, 10)


def test_repeated_ids(spark):
    df = spark.createDataFrame(list(enumerate(texts(9, "abcd "))), "doc_id long, text string")
    again = df.selectExpr("doc_id DIV 2 AS doc_id", "text")
    found = S.shared_spans(again.unionByName(again), 100).collect()
    assert all(0 <= r["start_pos"] <= r["end_pos"] - 100 for r in found)


def test_two_digests():
    points = np.frombuffer(("ab" * 300).encode("utf-32-le"), np.uint32)
    one, two = S.Digests(S._mixed(points))(np.array([0, 2, 1]), np.array([100, 102, 101]))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2] and one[0] != two[0]


def test_share(spark):
    rows = [(1, "x" * 10 + "".join(map(str, range(60)))), (2, "".join(map(str, range(60)))), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share = {r["doc_id"]: (r["shared_chars"], r["share"]) for r in S.shared_share(df, S.shared_spans(df, 64)).collect()}
    assert share == {1: (110, 110 / 120), 2: (110, 1.0), 3: (0, 0.0), 4: (0, 0.0)}


def test_gear_depends_on_its_window_alone():
    points = np.arange(200, dtype=np.uint32)
    whole, part = S.gear(S._mixed(points)), S.gear(S._mixed(points[50:]))
    full = S.GEAR - 1
    assert (whole[50 + full :] >> np.uint64(32) == part[full:] >> np.uint64(32)).sum() == 150 - full
