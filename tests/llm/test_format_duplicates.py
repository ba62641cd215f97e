import unicodedata
from collections import defaultdict

from echolex.llm import format_duplicates as D


def parts(word):
    runs, run = [], ""
    for c in word + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            runs.append(run.lower())
            run = ""
    return tuple(sorted(runs))


def expected(rows):
    classes = defaultdict(list)
    for o, word, lang, phonemes in rows:
        if None not in (word, lang, phonemes) and parts(word):
            classes[lang, phonemes, parts(word)].append(o)
    return sorted((o, min(c), len(c)) for c in classes.values() if len(c) > 1 for o in c)


WRITTEN = [
    "Ab cd", "cd, AB", "ab cd ab", "ab-ab cd", "abcd", "ab  c d", "", "  ", "!?", None, "É x", "é-X", "é x", "x é", "Ⅷ 1", "ⅷ-1",
    "12 ab", "ab 12", "ab12", "İx", "ΑΣ βγ", "βγ ας", "x" * 100_000 + " y", "Y_" + "X" * 100_000, "ab\tcd", "ab​cd", "«cd» ab!",
]


def table(spark):
    rows = [(i, w, lang, p) for i, (w, (lang, p)) in enumerate((w, k) for k in [("en", "p"), ("de", "p"), ("en", ""), (None, "p"), ("en", None)] for w in WRITTEN)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "ord int, word string, lang string, phonemes string, text string, id int")


def test_copies(spark):
    rows, df = table(spark)
    assert sorted(map(tuple, D.copies(df).collect())) == expected(rows)
    assert D.copies(df.limit(0)).count() == 0


def test_collapse_keeps_every_other_row(spark):
    rows, df = table(spark)
    got = {r["ord"]: r["n_copies"] for r in D.collapse(df).collect()}
    dropped = {o for o, first, _ in expected(rows) if o != first}
    assert got.keys() == {r[0] for r in rows} - dropped
    assert sum(got.values()) == len(rows)
    assert D.collapse(df).columns == [*df.columns, "n_copies"]


def test_one_class_of_many(spark):
    df = spark.range(3000).selectExpr("id AS ord", "if(id % 2 = 0, 'A b', 'b, a') AS word", "'en' AS lang", "'p' AS phonemes")
    rows = D.copies(df).collect()
    assert len(rows) == 3000 and {(r["class_id"], r["copies"]) for r in rows} == {(0, 3000)}
