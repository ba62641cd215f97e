"""Text files: lines in file order, dictionaries, groups; and the sinks for them.

Lines end at LF only (a CR stays in the line). Lines that aren't valid UTF-8 are left out and counted, the rest of the
file is kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.functions import text as T
from echolex.functions.phonetics import normalize
from echolex.session import small_table

DICTIONARY = "ord bigint, word string, phonemes string"
GROUPS = "words array<string>"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ord, line) of one or more files or folders. `ord` is unique and grows with the place in a file."""
    read = spark.read.text(paths, lineSep="\n").withColumnRenamed("value", "line")
    return read.withColumn("ord", F.monotonically_increasing_id()).where(F.is_valid_utf8("line")).select("ord", "line")


def ordered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, line) with `ord` dense from 0 in the order of the files and of the lines in them: parts in order get their
    offsets from the (bounded) counts of the parts before."""
    read = None
    for n, path in enumerate(paths):
        part = lines(spark, path).withColumn("file", F.lit(n))
        read = part if read is None else read.unionByName(part)
    split = read.withColumn("part", F.shiftright("ord", 33))
    counts = split.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("low")).toPandas()
    counts = counts.sort_values(["file", "part"])
    counts["offset"] = counts["n"].cumsum() - counts["n"]
    offsets = small_table(spark, file=counts["file"], part=counts["part"], offset=counts["offset"])  # one row a part
    nth = F.row_number().over(Window.partitionBy("file", "part").orderBy("ord")) - 1
    joined = split.withColumn("nth", nth).join(offsets, ["file", "part"])
    return joined.select((F.col("nth") + F.col("offset")).cast("bigint").alias("ord"), "line")


def rejected(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(n): how many lines aren't valid UTF-8."""
    read = spark.read.text(paths, lineSep="\n")
    return read.where(~F.is_valid_utf8("value")).agg(F.count(F.lit(1)).alias("n"))


def unparsed(rows: DataFrame, line_col: str = "line") -> DataFrame:
    """(ord, line): the lines that `parse_dictionary` leaves out though they aren't blank."""
    return rows.where(T.tab_pair(line_col).isNull() & ~T.is_blank(line_col)).select("ord", F.col(line_col).alias("line"))


def parse_dictionary(
    rows: DataFrame, shortest: int = 0, longest: int | None = None, fold: bool = False, line_col: str = "line"
) -> DataFrame:
    """(ord, word, phonemes) of (ord, line) rows: lines without a tab are left out, words are kept if their number of
    grapheme clusters is within the bounds, and pronunciations are folded if asked for."""
    pairs = rows.select("ord", T.tab_pair(line_col).alias("pair")).where("pair IS NOT NULL").select("ord", "pair.*")
    pairs = word_length(pairs, shortest, longest)
    return pairs.withColumn("phonemes", normalize("phonemes")) if fold else pairs


def word_length(rows: DataFrame, shortest: int = 0, longest: int | None = None) -> DataFrame:
    """Rows whose word has so many grapheme clusters, both bounds included; no filter where there are no bounds."""
    if shortest > 0:
        rows = rows.where(T.graphemes("word") >= shortest)
    return rows if longest is None else rows.where(T.graphemes("word") <= longest)


def dictionary(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """`parse_dictionary` of files."""
    return parse_dictionary(lines(spark, paths), **options)


def word_sets(rows: DataFrame, line_col: str = "line") -> DataFrame:
    """(set_id, words): the words of each line that isn't blank."""
    return rows.select(F.col("ord").alias("set_id"), T.tokens(line_col).alias("words")).where(F.size("words") > 0)


def from_entries(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> DataFrame:
    """(ord, word, phonemes) of pairs in memory, in order, repeats kept; none give an empty dictionary."""
    return spark.createDataFrame([(i, w, p) for i, (w, p) in enumerate(entries)], DICTIONARY)


def empty(spark: SparkSession, schema: str = DICTIONARY) -> DataFrame:
    return spark.createDataFrame([], schema)


def chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of `first`, then those of `second`, in one order by `ord`."""
    span = first.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__span"))
    moved = second.crossJoin(F.broadcast(span)).withColumn("ord", F.col("ord") + F.col("__span")).drop("__span")  # one row
    return first.unionByName(moved)


def dictionary_lines(rows: DataFrame) -> DataFrame:
    """(value): `word TAB phonemes`."""
    return rows.select(F.concat_ws("\t", "word", "phonemes").alias("value"))


def group_lines(groups: DataFrame) -> DataFrame:
    """(value): the words of each group with single spaces."""
    return groups.select(T.joined("words").alias("value"))


def list_lines(lists: DataFrame) -> DataFrame:
    """(value): each head and its matches with single spaces, in the order of the heads."""
    return lists.orderBy("ord").select(T.joined(F.concat(F.array("word"), F.col("matches"))).alias("value"))


def write_lines(values: DataFrame, path: str) -> None:
    """A folder of text files; parts are in the order of the rows."""
    values.write.mode("overwrite").text(path, lineSep="\n")


def print_lines(values: DataFrame, path: str | None = None) -> int:
    """One local file, or standard output; rows stream through the driver one partition at a time. Returns the count."""
    count = 0
    out = open(path, "w", encoding="utf-8", newline="\n") if path else sys.stdout
    try:
        for row in values.toLocalIterator():
            out.write(row[0] + "\n")
            count += 1
    finally:
        if path:
            out.close()
    return count
