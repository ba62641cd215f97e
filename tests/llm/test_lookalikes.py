import unicodedata

import pytest

from echolex.llm import lookalikes as L

SYMBOLS = " abcdefghijklmnopqrstuvwxyzãäæçðõöøĩŋœɑɔəɛɣɪɲɵɸɾʁʃʊʌʒʰʲˈˌːθχḛḭẽ" + "̥̩̰̃"
KEYS = ["ˈʃɛ̃tʃedã̰n̥ɛ ˈkĩ", "höqiz vḭrɛ", "ˈtøpebr ʁɑːz", "ḛ̃ç", "bʒæəɣ"]
VARIANTS = [
    ("ˈʃɛ̃t​ʃedã̰n̥ɛ ˈkĩ", 0), ("'∫ε̃t∫еdã̰n̥ɛ ′kі̃", 0), ("'∫ɛ̃tʃedã̰n͏̥ɛ ˈkĩ", 0),
    ("ｈöqｉz vḭrε", 1), ("höqiz　vḭrɛ﻿", 1), ("ˈtøрebr ʁα꞉z", 2), ("ḛ̃ç", 3), ("𝖻ӡӕәγ", 4),
    ("höqiz vḭrɛ", None), ("höqis vḭrɛ", None), ("hoqiz vḭrɛ", None), ("höqiz vḭre", None), ("höqiz  vḭrɛ", None), ("HÖQIZ VḬRƐ", None),
    ("ˈtopebr ʁɑːz", None), ("ˈtøpebr ʁaːz", None), ("", None), (None, None), ("x" * 50_000, None), ("bʒæəɣʰ", None),
]


@pytest.fixture
def tables(spark):
    symbols = spark.createDataFrame([(c,) for c in SYMBOLS], "symbol string")
    keys = spark.createDataFrame(list(enumerate(KEYS)), "key_id long, phonemes string")
    rows = spark.createDataFrame([(i, v, "clash", "clash") for i, (v, _) in enumerate(VARIANTS)], "ord long, phonemes string, value string, block string")
    return rows, keys, symbols


def test_keys_are_composed():
    assert [unicodedata.normalize("NFC", k) for k in KEYS] == KEYS


def test_match_reference(tables):
    expected = sorted((i, k) for i, (_, k) in enumerate(VARIANTS) if k is not None)
    assert sorted(map(tuple, L.match_reference(*tables).collect())) == expected


def test_unify_keeps_every_row_and_is_stable(spark, tables):
    rows, keys, symbols = tables
    twice = rows.unionByName(rows)
    out = L.unify(twice, keys, symbols, keep=("ord",)).collect()
    assert len(out) == 2 * sum(v is not None for v, _ in VARIANTS)
    named = {r["ord"]: r["canonical"] for r in out}
    for i, (value, key) in enumerate(VARIANTS):
        if key is not None:
            assert named[i] == KEYS[key]
        elif value is not None and i != 8:
            assert named[i] == value
    once = spark.createDataFrame([(i, c) for i, c in named.items()], "ord long, phonemes string")
    again = {r["ord"]: r["canonical"] for r in L.unify(once, keys, symbols, keep=("ord",)).collect()}
    assert again == named


def test_without_a_reference_the_smallest_is_canonical(spark, tables):
    _, keys, symbols = tables
    rows = spark.createDataFrame([("ãb",), ("ãb",), ("аb",), ("c",)], "phonemes string")
    out = {r["phonemes"]: (r["canonical"], r["is_reference"]) for r in L.unify(rows, keys.limit(0), symbols).collect()}
    assert out == {"ãb": ("ãb", False), "ãb": ("ãb", False), "аb": ("аb", False), "c": ("c", False)}
    assert L.match_reference(rows.limit(0).selectExpr("0L AS ord", "phonemes"), keys, symbols).count() == 0


def test_symbols_never_stand_for_one_another():
    table = L.likeness(SYMBOLS)
    assert not set(table) & set(SYMBOLS) and set(table.values()) <= set(SYMBOLS)


def test_a_value_equal_to_a_reference_alone_in_its_block_is_one(spark, tables):
    _, keys, symbols = tables
    rows = spark.createDataFrame([(KEYS[0],), ("xyz",)], "phonemes string")
    out = {r["phonemes"]: (r["canonical"], r["is_reference"]) for r in L.unify(rows, keys, symbols).collect()}
    assert out == {KEYS[0]: (KEYS[0], True), "xyz": ("xyz", False)}
