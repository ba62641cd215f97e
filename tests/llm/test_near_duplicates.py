import random

import numpy as np
import pytest

from echolex.llm import near_duplicates as N


def brute(rows, n, threshold):
    sets = [(i, {t[k : k + n] for k in range(len(t) - n + 1)}) for i, t in rows if i is not None and t is not None and len(t) >= n]
    return sorted(
        (min(i, j), max(i, j))
        for k, (i, x) in enumerate(sets)
        for j, y in sets[k + 1 :]
        if len(x & y) >= threshold * len(x | y) - 1e-9
    )


def texts(seed, count=160):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeʃːˈ") for _ in range(r.randint(3, 7))) for _ in range(25)]
    out = []
    for _ in range(count):
        if out and r.random() < 0.6:
            t = list(r.choice(out))
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(t) + 1)
                if r.random() < 0.5:
                    t.insert(at, r.choice("xyz𝗎"))
                elif len(t) > 4:
                    del t[min(at, len(t) - 1)]
            out.append("".join(t))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 6))))
    return out + [None, "", "ab", "abc", "abc", "aaaaaaaaaaaa", "aaa", " ", "x" * 30_000, "x" * 20_000 + "y"]


@pytest.mark.parametrize("n, threshold, seed", [(3, 0.6, 1), (3, 0.8, 2), (2, 0.5, 3), (5, 0.7, 4), (3, 1.0, 5), (1, 0.9, 6)])
def test_against_all_pairs(spark, n, threshold, seed):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, "abc", "", 0)], "phrase_id long, phonemes string, text string, a int")
    assert sorted(map(tuple, N.similar_pairs(df, n=n, threshold=threshold).collect())) == brute(rows, n, threshold)


def test_frequent_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    rows = [(i, f"common phrase number {i % 40} of all") for i in range(120)]
    df = spark.createDataFrame(rows, "phrase_id long, phonemes string")
    assert sorted(map(tuple, N.similar_pairs(df).collect())) == brute(rows, 3, 0.6)


def test_cells_of_a_counter_beyond_32_bits():
    side = np.array([100_000])
    at, rows = N.cell_numbers(np.array([99_999]), side, True)
    _, columns = N.cell_numbers(np.array([70_000]), side, False)
    assert rows.dtype == np.int64 and rows.max() == 100_000**2 - 1 and len(at) == 100_000
    assert np.intersect1d(rows, columns).tolist() == [99_999 * 100_000 + 70_000]


def test_groups_and_members(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    for rows in (list(enumerate(texts(7))), [(i, f"common phrase number {i % 40} of all") for i in range(120)]):
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, "abc", "", 0)], "phrase_id long, phonemes string, id string, text_id int")
        pairs = brute(rows, 3, 0.6)
        group, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
        for i, j in pairs:
            links[i], links[j] = links[i] + 1, links[j] + 1
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()}
        got = N.similar_groups(df).collect()
        assert sorted(map(tuple, got)) == sorted((i, group[i], links[i]) for i, _ in rows)


def test_nothing(spark):
    df = spark.createDataFrame([], "phrase_id long, phonemes string")
    assert N.similar_pairs(df).count() == 0 and N.similar_groups(df).count() == 0
    with pytest.raises(ValueError):
        N.similar_pairs(df, threshold=0)


def test_gram_sets_are_exact_for_three_points():
    record, gram = N.gram_sets(["abcabc", "", "a𝗎b", "ab"], 3)
    assert record.tolist() == [0, 0, 0, 2] and len(np.unique(gram)) == 4
