import pytest

from echolex.plans import cli


WRONG = ["find one two three", "find -d minus", "find -d -4", "find -L", "find --min-length -2", "create --output", "create in out", "merge --what", ""]


@pytest.mark.parametrize("argv", WRONG)
def test_wrong_options(argv):
    with pytest.raises(SystemExit) as stop:
        cli.main(argv.split())
    assert stop.value.code == 2


@pytest.mark.parametrize("program", ["create", "find", "merge"])
def test_help(program, capsys):
    with pytest.raises(SystemExit) as stop:
        cli.main([program, "--help"])
    assert stop.value.code == 0 and "usage" in capsys.readouterr().out


def test_options():
    args = cli.parser().parse_args("find --normalize --max-distance 2 --min-length 4 --max-length 11 north.tsv".split())
    assert (args.normalize, args.max_distance, args.min_length, args.max_length, args.files) == (True, 2, 4, 11, ["north.tsv"])
    args = cli.parser().parse_args("create --ascii --voice speakers/anna --language sv --output made.tsv list.txt".split())
    assert (args.ascii, args.voice, args.language, args.output, args.input) == (True, "speakers/anna", "sv", "made.tsv", "list.txt")
    args = cli.parser().parse_args(["find"])
    assert (args.normalize, args.max_distance, args.min_length, args.max_length, args.files) == (False, 0, 0, None, [])


def test_warnings(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    words, nested = tmp_path / "w", str(tmp_path / "nested")
    words.write_bytes(b"aa\tx\nno tab\n\n \nbb\tx\n\xff\n")
    assert cli.main(["find", str(words)]) == 0
    out = capsys.readouterr()
    assert out.out == "aa bb\n" and "1 lines that aren't valid UTF-8" in out.err and "1 lines without a tab" in out.err
    words.write_text("Schule\n!!\n\n")
    rows = [("de/x", [("de", 2), ("nds", 1)]), ("none", []), (None, [("de", 9)])]
    spark.createDataFrame(rows, "filename string, languages array<struct<name: string, priority: byte>>").write.parquet(nested)
    assert cli.main(["create", "-l", "nds", "--voices", nested, str(words)]) == 0
    assert "1 entries without a pronunciation" in capsys.readouterr().err
    assert cli.main(["create", "-L"]) == 0
    assert "no voices found" in capsys.readouterr().err
    words.write_text("Der schnelle Weg führt durch den Wald\nund über die Brücke zu einem kleinen Haus\n")
    spark.createDataFrame([("de", "de/x", 1)], "lang string, filename string, priority byte").write.parquet(str(tmp_path / "flat"))
    assert cli.main(["create", "--voices", str(tmp_path / "flat"), str(words)]) == 0  # the language is detected
    assert capsys.readouterr().out.count("\t") == 2


def test_programs(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    one, two, voices = tmp_path / "1", tmp_path / "2", str(tmp_path / "voices")
    one.write_text("cc\ta\nbb\tb\ncc\ta\naa\ta\n")
    two.write_text("cc\tx\nab\tb\n")
    spark.createDataFrame([("de", "de/x", 1), ("de", "de/yy", 2)], "lang string, filename string, priority byte").write.parquet(voices)
    assert cli.main(["find", str(one), str(two)]) == 0
    out = capsys.readouterr()
    assert out.out == "ab bb\n" and "1 results" in out.err
    assert cli.main(["merge", str(one)]) == 0
    assert capsys.readouterr().out == "a aa cc\nb bb\n"
    two.write_text("Schule\n")
    assert cli.main(["create", "-l", "de", "--voices", voices, str(two)]) == 0
    assert capsys.readouterr().out == "Schule\tʃule\n"
    assert cli.main(["create", "-L", "--voices", voices]) == 0
    assert capsys.readouterr().out == "Languages:\n\nName:   de\nVoices:\nFilename Priority\n   de/yy        2\n    de/x        1\n"
    assert cli.main(["create", "-l", "fr", "--voices", voices, str(two), "-o", str(tmp_path / "none")]) == 1
    assert not (tmp_path / "none").exists()
    assert cli.main(["merge", str(tmp_path / "missing")]) == 1
