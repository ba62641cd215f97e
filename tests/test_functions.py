import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from echolex.functions import phonetics, text


def pair(xs, compute):
    return [tuple(x) if x else None for x in compute(text.tab_pair, xs)]


def test_tab_pair_rejects(compute):
    assert pair(["", " ", "\t", "\t \t ", "xx\t \t ", " \t \txx ", None], compute) == [None] * 7


def test_tab_pair_accepts(compute):
    lines = ["xx\tyy", "  xx\tyy  \n", " \t xx\tyy \t ", "a\tb\tc", " a \t　b "]
    assert pair(lines, compute) == [("xx", "yy")] * 3 + [("a", "b\tc"), ("a", "b")]


def test_trim_keeps_separators_that_are_no_white_space(compute):
    assert compute(text.trim, ["\x1cx\x1f", "\u0085x ", "", None]) == ["\x1cx\x1f", "x", "", None]


def test_tokens(compute):
    assert compute(text.tokens, [" a  b\tc　d ", "", "  ", None]) == [["a", "b", "c", "d"], [], [], None]


def test_words_of(compute):
    assert compute(text.words_of, ["Zwei, drei-Vier 5x!", ""]) == [["zwei", "drei", "vier", "x"], []]


@pytest.mark.parametrize(
    "whole, lines",
    [("", []), ("\n\n", ["", ""]), ("xx \tyy\nz\n\nzz", ["xx \tyy", "z", "", "zz"]), ("a\r\nb\rc\n", ["a", "b\rc"])],
)
def test_string_lines(compute, whole, lines):
    assert compute(text.string_lines, [whole]) == [lines]


def test_squeeze(compute):
    assert compute(text.squeeze, ["", "1", "123", "1112213211", "a\n\n\nb", "𝗎𝗎x"]) == ["", "1", "123", "121321", "a\nb", "𝗎x"]


def test_graphemes(compute):
    assert compute(text.graphemes, ["", "abc", "é̂̃", "🇩🇪x"]) == [0, 3, 1, 2]


def test_normalize(compute):
    given_ = ["", " " * 8, "ʌbɹiˌviejˈʃʌnz", "m ʌ nʲ ɪ t o rʲ ɪ n k", "ç", "ç", "ä", "ä", None]
    assert compute(phonetics.normalize, given_) == ["", "", "abriviejʃanz", "manitorink", "ʃ", "t", "a", "a", None]


def test_normalize_is_idempotent(compute):
    xs = [phonetics.FROM, phonetics.TO, "".join(reversed(phonetics.FROM)), "aɑbʙʃç"]
    once = compute(phonetics.normalize, xs)
    assert compute(phonetics.normalize, once) == once


def test_class_table_has_as_many_sources_as_targets():
    assert len(phonetics.FROM) == len(phonetics.TO) == len(set(phonetics.FROM)) == 57


@pytest.mark.parametrize("a, b, d, yes", [("p", "p", 0, True), ("p", "p2", 0, False), ("p", "p2", 1, True), ("p", "q2", 1, False), ("p", "q2", 2, True), ("", "", 0, True), ("ʌ", "a", 1, True)])
def test_similar(spark, a, b, d, yes):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(phonetics.similar("a", "b", d).alias("x")).first()["x"] is yes


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\t  \n", max_size=8), min_size=1, max_size=20))
def test_trim_against_python(compute, xs):
    assert compute(text.trim, xs) == [x.strip(" \t\n ") for x in xs]


def test_blank(compute):
    assert compute(text.is_blank, ["", "  ", "x", "\x1c"]) == [True, True, False, False]
