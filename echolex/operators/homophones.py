"""Words that sound the same: groups of equal pronunciations within one dictionary or across two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.operators.ranks import PART, in_ranges, ranked
from echolex.session import Scratch


def finish_groups(groups: DataFrame, col: str = "words") -> DataFrame:
    """Each group sorted and without repeats; groups of fewer than two members are dropped. Nulls are no members."""
    members = F.array_sort(F.array_distinct(F.array_compact(F.col(col))))
    return groups.withColumn(col, members).where(F.size(col) > 1)


def homophone_members(dictionary: DataFrame) -> DataFrame:
    """(phonemes, word): the groups of `homophones`, one row for each distinct word. The form for groups of any size:
    whether a pronunciation has two words shows in its smallest and largest one."""
    rows = dictionary.select("word", "phonemes").dropna()
    ends = rows.groupBy("phonemes").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    several = ends.where("low <> high").select("phonemes")
    return rows.join(several, "phonemes", "left_semi").select("phonemes", "word").distinct()


def homophones(dictionary: DataFrame) -> DataFrame:
    """(phonemes, words): the distinct words of each pronunciation that has at least two.

    Groups aren't compared with each other: two pronunciations may have the same words. Rows with a null field are
    dropped; an empty pronunciation is one like any other. The set is built by partial aggregates before the shuffle.
    """
    rows = dictionary.select("word", "phonemes").dropna()
    groups = rows.groupBy("phonemes").agg(F.collect_set("word").alias("words"))
    return groups.where(F.size("words") > 1).select("phonemes", F.array_sort("words").alias("words"))


def tagged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both dictionaries as one, with `src` 0 and 1."""
    sides = [d.select("word", "phonemes").withColumn("src", F.lit(i)) for i, d in enumerate((first, second))]
    return sides[0].unionByName(sides[1])


def cross_homophones(rows: DataFrame) -> DataFrame:
    """(phonemes, words) like `homophones`, of (word, phonemes, src) rows, for pronunciations that both sources have.

    The sources are looked at before words are made distinct: a word in both counts once, and a group that is left
    with one word is dropped.
    """
    kept = rows.select("word", "phonemes", "src").dropna()
    groups = kept.groupBy("phonemes").agg(
        F.collect_set("word").alias("words"), F.min("src").alias("low"), F.max("src").alias("high")
    )
    both = groups.where((F.col("low") != F.col("high")) & (F.size("words") > 1))
    return both.select("phonemes", F.array_sort("words").alias("words"))


def ordered(groups: DataFrame) -> DataFrame:
    """In a total order that refines the order by first member."""
    keys = ["words", "phonemes"] if "phonemes" in groups.columns else ["words"]
    return groups.orderBy(*keys)


def multimap_rows(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, nth, value): the values of each key with their place from 0 in arrival order, repeats kept. The form for
    keys of any size: a hot key is ranked by several tasks."""
    return ranked(pairs.select(key, order, value), Scratch(pairs.sparkSession, "multimap"), (order,), (key,)).select(key, "nth", value)


def multimap(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): `multimap_rows` as lists, for text output: a key is one row, so it has to fit into one task."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))))
    return pairs.groupBy(key).agg(held.alias("held")).select(key, F.col("held.value").alias("values"))


def squeeze_rows(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Rows whose value equals the one before (in `order`) dropped; nulls are equal to each other.

    An order over all rows has no partition key: neighbours are found within ranges of `order`, and only the last
    value of each range goes to the next, so no task sees all rows. Rows that agree in `order` have no fixed order.
    """
    ranged = in_ranges(rows, Scratch(rows.sparkSession, "squeeze"), order)
    within = Window.partitionBy(PART).orderBy(order)
    marked = ranged.withColumn("__nth", F.row_number().over(within)).withColumn("__prev", F.lag(value).over(within))
    ends = ranged.groupBy(PART).agg(F.max(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))).alias("__end"))
    before = Window.orderBy(PART)  # one row a range
    ends = ends.select(F.lead(PART).over(before).alias(PART), F.lit(True).alias("__has"), F.col("__end.value").alias("__carried"))
    joined = marked.join(ends.dropna(subset=[PART]), PART, "left")
    same = F.when(
        F.col("__nth") == 1, F.col("__has").eqNullSafe(True) & F.col(value).eqNullSafe(F.col("__carried"))
    ).otherwise(F.col(value).eqNullSafe(F.col("__prev")))
    return joined.where(~same).select(*rows.columns)
