import pytest

from echolex.operators import phonemise as P
from echolex.plans import programs
from echolex.sources import text
from echolex.streaming import dictionary as stream


def write(path, content):
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def ordered(df):
    return [r["line"] for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize(
    "content, out", [("", []), ("\n\n", ["", ""]), ("xx \tyy\nz\n\nzz", ["xx \tyy", "z", "", "zz"]), ("a\rb\r\nc", ["a\rb\r", "c"])]
)
def test_lines(spark, tmp_path, content, out):
    assert ordered(text.lines(spark, write(tmp_path / "f", content))) == out


def test_invalid_utf8_is_counted_and_left_out(spark, tmp_path):
    path = write(tmp_path / "f", b"a\tx\n\xff\xfe\nb\ty\n")
    assert ordered(text.lines(spark, path)) == ["a\tx", "b\ty"]
    assert text.rejected(spark, path).first()["n"] == 1


def test_order_over_files(spark, tmp_path):
    paths = [write(tmp_path / n, c) for n, c in (("b", "1\n2\n"), ("a", "3\n"), ("c", ""))]
    rows = text.ordered_lines(spark, paths).orderBy("ord").collect()
    assert [(r["ord"], r["line"]) for r in rows] == [(0, "1"), (1, "2"), (2, "3")]


def test_chained(spark):
    first, second = text.from_entries(spark, [("xx", "p"), ("yy", "p")]), text.from_entries(spark, [("1", "p"), ("2", "p")])
    assert [r["word"] for r in text.chained(first, second).orderBy("ord").collect()] == ["xx", "yy", "1", "2"]
    assert text.chained(text.empty(spark), second).count() == 2


@pytest.mark.parametrize("low, high, out", [(0, None, "xx yyy zzzz"), (0, 0, ""), (0, 3, "xx yyy"), (4, 9, "zzzz"), (3, 2, "")])
def test_word_length(spark, low, high, out):
    rows = text.from_entries(spark, [("xx", "x"), ("yyy", "y"), ("zzzz", "z")])
    assert [r["word"] for r in text.word_length(rows, low, high).orderBy("ord").collect()] == out.split()
    marks = text.from_entries(spark, [("é̂̃̈", "x")])
    assert text.word_length(marks, 1, 1).count() == 1


FIND = [
    ("", [], {}), ("cc/a bb/b cc/a aa/a", ["aa cc"], {}),
    ("c/a bb/b c/a aa/a ddd/b", ["bb ddd"], {"min_length": 2, "max_length": 3}),
    ("c/a bb/b c/a aa/a", ["aa c"], {"min_length": 1, "max_length": 2}),
    ("c/a bb/b c/a aa/a ddd/b", ["aa c", "bb ddd"], {"min_length": 1, "max_length": 4}),
    ("a/x ab/xy bb/yy", [], {}), ("a/x ab/xy bb/yy", ["a ab", "ab a bb", "bb ab"], {"max_distance": 1}),
    ("a/x ab/xy bb/yy", ["a ab bb", "ab a bb", "bb a ab"], {"max_distance": 2}),
    ("a/ɑ b/aː c/b", ["a b"], {"normalize": True}), ("a/ɑ b/aː c/ab", ["a b c", "b a c", "c a b"], {"normalize": True, "max_distance": 1}),
]


@pytest.mark.parametrize("entries, out, options", FIND)
def test_find(spark, tmp_path, entries, out, options):
    path = write(tmp_path / "d", "".join(e.replace("/", "\t") + "\n" for e in entries.split()))
    chosen = programs.FindOptions(**options)
    loaded = programs.load(text.ordered_lines(spark, [path]), chosen)
    assert [r[0] for r in programs.find_lines(programs.find(loaded, None, chosen)).collect()] == out


def test_merge(spark, tmp_path):
    paths = [write(tmp_path / "a", "aa bb cc\n bb b\n\n a c\n"), write(tmp_path / "b", "d c e\nbb f\n")]
    assert [r[0] for r in text.group_lines(programs.merge(text.lines(spark, paths))).collect()] == ["a c d e", "aa b bb cc f"]


def test_create_and_sinks(spark, tmp_path, capsys):
    path = write(tmp_path / "w", "test\n\n  abc \n!!\nschön\n")
    made = programs.create(text.ordered_lines(spark, [path]), P.Rules("de"))
    lines = text.dictionary_lines(made.orderBy("ord"))
    assert text.print_lines(lines) == 3
    assert capsys.readouterr().out == "test\ttest\nabc\tabk\nschön\tʃøn\n"
    text.write_lines(lines, str(tmp_path / "out"))
    assert text.dictionary(spark, str(tmp_path / "out")).count() == 3
    assert text.print_lines(lines, str(tmp_path / "one")) == 3
    assert (tmp_path / "one").read_text().startswith("test\ttest\n")


def test_native_phonemizer_and_ascii(spark):
    entries = spark.createDataFrame([(1, "ab"), (2, None), (3, " ")], "ord int, entry string")
    rows = P.phonemise(entries, P.Native(lambda: str.upper)).collect()
    assert [(r["word"], r["phonemes"]) for r in rows] == [("ab", "AB")]
    rows = P.phonemise(entries, P.Native(lambda: lambda text: text.encode() + b"\xff\xc3")).collect()
    assert len(rows) == 1 and rows[0]["phonemes"].startswith("ab\ufffd") and rows[0]["phonemes"].strip("ab\ufffd") == ""
    assert [r["word"] for r in P.unspoken(entries.selectExpr("ord", "coalesce(entry, '!?') AS entry"), P.Rules("en")).collect()] == ["!?"]
    assert P.phonemise(entries, P.Rules("en", True)).count() == 1


def test_streams(spark, tmp_path):
    entries = spark.createDataFrame([(" Schule ",), ("",), (None,)], "entry string")
    entries.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(entries.schema).parquet(str(tmp_path / "in"))
    made = stream.created(source, P.Rules("de"))
    known = spark.createDataFrame([("Schuhle", "ʃule"), ("schule", "x")], "word string, phonemes string")
    query = stream.matched(made, known).writeStream.format("memory").queryName("matched").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["word"], r["match_word"]) for r in spark.table("matched").collect()] == [("Schule", "Schuhle")]


def test_stream_counts_late_rows(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/dictionary.parquet").select("phonemes", "added_at")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream.homophone_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == rows.dropna().count()
