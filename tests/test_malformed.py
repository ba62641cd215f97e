import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolex.operators import malformed as M


def plain_reason(line):
    """The statement, word for word, up to the columns."""
    fields, at = 0, 0
    while True:
        if line[at : at + 1] == '"':
            closing = re.compile(r'"(?:[^"]|"")*"(?=\t|\Z)', re.S).match(line, at)
            if not closing:
                return "quoting"
            at = closing.end()
        else:
            at = (line.find("\t", at) + 1 or len(line) + 1) - 1
        fields += 1
        if at >= len(line):
            return None if fields == 5 else "columns"
        at += 1


def shape_of(line):
    return re.sub(r'[^\t"]+', M.OTHER, line)


def cost_reason(line, fields=5):
    quoting, columns, edits = M.parse_shape(shape_of(line), fields)
    assert (columns == 0) == (edits == "") and columns >= quoting
    return "quoting" if quoting else "columns" if columns else None


@pytest.mark.parametrize("size", range(8))
def test_all_short_shapes(size):
    for shape in map("".join, itertools.product('\t"x', repeat=size)):
        if "xx" not in shape:
            assert cost_reason(shape) == plain_reason(shape), shape


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='\t\t"xy ', max_size=40))
def test_long_shapes(line):
    assert cost_reason(line) == plain_reason(line)


def test_written_fields_come_back(spark):
    r = random.Random(4)
    values = ["".join(r.choices('\t"xy \n', k=r.randrange(7))) for _ in range(2000)] + ['a"b' * 50_000, '"\t' * 50_000, "", ""] * 5
    quote = lambda v: '"' + v.replace('"', '""') + '"' if "\t" in v or v[:1] == '"' else v
    rows = [(i, values[i : i + 5]) for i in range(0, len(values), 5)]
    lines = spark.createDataFrame([(i, "\t".join(map(quote, v)), "x") for i, v in rows], "i int, raw string, parsed string").drop("parsed")
    got = {x["i"]: x["parsed"] for x in M.parse(lines).collect()}
    assert all((got[i]["quoting"], got[i]["columns"], got[i]["edits"], got[i]["fields"]) == (0, 0, "", v) for i, v in rows)


def repaired(shape, edits):
    """The shape after the edits."""
    out = list(shape) + [""]
    before = {}
    for edit in edits.split():
        kind, place = edit[:2], int(edit[2:])
        if kind[0] == "-":
            out[place] = ""
        else:
            before[place] = before.get(place, "") + ('"' if kind[1] == "q" else "\t")
    return "".join(before.get(i, "") + c for i, c in enumerate(out))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='\t"x', max_size=12))
def test_edits_repair_the_line(line):
    shape = shape_of(line)
    _, cost, edits = M.parse_shape(shape, 5)
    assert len(edits.split()) == cost
    assert M.parse_shape(shape_of(repaired(shape, edits)), 5)[1] == 0


def test_very_long_shapes_keep_their_edits():
    assert M.parse_shape('x\t' * 15_000 + 'x', 5)[:2] == (0, 2)  # a quote on either side hides the rest
    for shape in ('"x' * 50_000 + '\t' * 4, 'x\t' * 50_000 + 'x', '"\t"x' * 3 * M.BLOCK, ('x' + '\t"x"x' * 9) * 700):
        quoting, columns, edits = M.parse_shape(shape, 5)
        assert len(edits.split()) == columns > 0
        assert M.parse_shape(shape_of(repaired(shape, edits)), 5)[1] == 0


LINES = [
    (1, "a\tp\ten\t1\t2020-02-29", None), (2, "a\tp\ten\t1\t2021-02-29", "added"), (3, None, "no case"), (4, " \t　", "no case"),
    (5, '"a\tb"\tp\ten\t1\t2020-01-01', None), (6, '"a" \tp\ten\t1\t2020-01-01', "quoting"), (7, "a\tp\ten\t1", "columns"),
    (8, "\tp\ten\t1\t2020-01-01", "word"), (9, "a�\tp\ten\t1\t2020-01-01", "word"), (10, "a\tp4\ten\t1\t2020-01-01", "phonemes"),
    (11, "a\t\txx\t1\t2020-01-01", "phonemes"), (12, "a\tp\txx\t1\t2020-01-01", "lang"), (13, "a\tp\tEN\t1\t2020-01-01", "lang"),
    (14, "a\tp\ten\t1234567890\t2020-01-01", "freq"), (15, "a\tp\ten\t１\t2020-01-01", "freq"), (16, "a\tp\ten\t-1\t2020-01-01", "freq"),
    (17, "a\tp\ten\t1\t2020-1-01", "added"), (18, "a\tp\ten\t1\t2020-13-01", "added"), (19, "a\tp\ten\t1\t2020-01-01x", "added"),
    (20, ' " a "\t" p "\t en \t 000000007\t 2020-01-01 ', None), (21, '""""\tp\ten\t1\t2020-01-01', None),
    (22, '"\tp\ten\t1\t2020-01-01', "quoting"), (23, "a\tp\ten\t1\t0000-01-01", "added"), (24, '""\tp\ten\t1\t2020-01-01', "word"),
    (25, "x" * 200_000 + "\tp\ten\t1\t2020-01-01", None), (1, "a\tp\ten\t1\t2020-02-29", None),
]


def test_reasons(spark):
    lines = spark.createDataFrame([(i, r, "w", "r") for i, r, _ in LINES], "line_id long, raw string, word string, reason string")
    languages = spark.createDataFrame([("en",), ("en",), (None,)], "lang string")
    rows = M.checked(lines, languages).collect()
    expected = sorted((i, r or "") for i, _, r in LINES if r != "no case")
    assert sorted((r["line_id"], r["reason"] or "") for r in rows) == expected
    good = {r["line_id"]: r for r in M.good_rows(lines, languages).collect()}
    assert good[5]["word"] == "a\tb" and good[21]["word"] == '"' and good[20]["freq"] == 7 and good[20]["word"] == '" a "'
    assert str(good[1]["added"]) == "2020-02-29"
    bad = {r["line_id"]: r for r in M.bad_rows(lines, languages).collect()}
    assert bad[7]["edits"].count("+d") == 1 and bad[8]["edits"] == ""
    assert M.checked(lines.limit(0), languages).count() == 0
