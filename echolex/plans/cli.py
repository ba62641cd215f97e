"""`python -m echolex.plans.cli create|find|merge`."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile


from echolex.operators import detect, languages, phonemise
from echolex.plans import programs
from echolex.session import local_session, scratch_tables
from echolex.sources import text


def _count(value: str) -> int:
    number = int(value)
    if number < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echolex", description="Phonetic word linkage.")
    sub = top.add_subparsers(dest="program", required=True)
    create = sub.add_parser("create", help="make a pronunciation dictionary of a word list")
    create.add_argument("input", nargs="?", help="word list (default: standard input)")
    create.add_argument("-L", "--list-languages", action="store_true", help="print the languages and their voices")
    create.add_argument("-l", "--language", help="language (default: detected)")
    create.add_argument("-v", "--voice", metavar="FILE", help="voice (default: the language's voice of highest priority)")
    create.add_argument("-a", "--ascii", action="store_true", help="ASCII names of sounds")
    create.add_argument("-o", "--output", metavar="FILE", help="output (default: standard output)")
    create.add_argument("--voices", metavar="PARQUET", help="voice catalogue with lang, filename and priority")
    create.add_argument("--samples", metavar="PARQUET", help="texts with lang and text, from which detection learns")
    find = sub.add_parser("find", help="find words with similar pronunciations")
    find.add_argument("files", nargs="*", metavar="file", help="dictionaries, at most 2 (default: standard input)")
    find.add_argument("-n", "--normalize", action="store_true", help="fold pronunciations into broad sound classes")
    find.add_argument("-l", "--min-length", type=_count, default=0)
    find.add_argument("-L", "--max-length", type=_count)
    find.add_argument("-d", "--max-distance", type=_count, default=0, help="edit distance (default: 0)")
    merge = sub.add_parser("merge", help="merge groups that share words")
    merge.add_argument("files", nargs="*", metavar="file", help="groups (default: standard input)")
    return top


def _spooled(paths: list[str], folder: str) -> list[str]:
    """The files, or standard input spooled to one."""
    if paths:
        for path in paths:
            if not os.path.exists(path):
                raise FileNotFoundError(path)
        return [os.path.abspath(p) for p in paths]
    path = os.path.join(folder, "stdin")
    with open(path, "wb") as out:
        shutil.copyfileobj(sys.stdin.buffer, out)
    return [path]


def _warn(number: int, what: str) -> None:
    if number:
        print(f"Warning: {number} {what}", file=sys.stderr)


def _warn_of_lines(spark, paths: list[str]) -> None:
    _warn(text.rejected(spark, paths).first()["n"], "lines that aren't valid UTF-8 were left out")


def _create(spark, args, folder: str) -> None:
    voices = text.empty(spark, "lang string, filename string, priority tinyint")
    if args.voices:
        voices = languages.catalogue(spark.read.parquet(args.voices))
    if voices.isEmpty():
        print("Warning: no voices found", file=sys.stderr)
    if args.list_languages:
        print("Languages:")
        width = languages.catalogue_width(voices).first()["width"]
        last = None
        for row in languages.catalogue_report(voices).orderBy("lang", "nth").toLocalIterator():
            if row["lang"] != last:
                last = row["lang"]
                print(f"\nName:   {last}\nVoices:\n{'Filename':>{width}} {'Priority':>{width}}")
            print(row["line"])
        return
    paths = _spooled([args.input] if args.input else [], folder)
    _warn_of_lines(spark, paths)
    rows = text.ordered_lines(spark, paths)

    def guess() -> str:
        known = detect.profiles(spark.read.parquet(args.samples)) if args.samples else None
        return detect.detect_file(rows, known)[0]

    language = args.language
    if args.voice is None:
        language = language or guess()
        languages.choose_voice(voices, None, language)  # fails before any output is made
    language = language or os.path.basename(os.path.dirname(args.voice)) or args.voice
    speak = phonemise.Rules(language, args.ascii)
    made = programs.create(rows, speak).orderBy("ord")
    text.print_lines(text.dictionary_lines(made), args.output)
    _warn(phonemise.unspoken(rows, speak, "line").count(), "entries without a pronunciation were left out")


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.program == "find" and len(args.files) > 2:
        top.error("too many file arguments")
    spark = local_session(os.cpu_count() or 1)
    folder = tempfile.mkdtemp(prefix="echolex-cli-")  # standard input is spooled to it; the session is a local one
    try:
        with scratch_tables(spark):
            return _run(spark, args, folder)
    except (EOFError, FileNotFoundError, languages.NoVoiceForLanguage) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _run(spark, args, folder: str) -> int:
    if args.program == "create":
        _create(spark, args, folder)
    elif args.program == "find":
        options = programs.FindOptions(args.normalize, args.min_length, args.max_length, args.max_distance)
        paths = _spooled(args.files, folder)
        _warn_of_lines(spark, paths)
        rows = [text.ordered_lines(spark, [p]) for p in paths]
        _warn(sum(text.unparsed(r).count() for r in rows), "lines without a tab were left out")
        loaded = [programs.load(r, options) for r in rows]
        found = programs.find_lines(programs.find(loaded[0], loaded[1] if len(loaded) > 1 else None, options))
        print(f"{text.print_lines(found)} results", file=sys.stderr)
    else:
        paths = _spooled(args.files, folder)
        _warn_of_lines(spark, paths)
        text.print_lines(text.group_lines(programs.merge(text.lines(spark, paths))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
