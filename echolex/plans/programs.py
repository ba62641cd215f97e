"""The three programs as plans: create a dictionary, find similar words, merge groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from echolex.operators import groups, homophones, phonemise, similar
from echolex.sources import text


@dataclass(frozen=True)
class FindOptions:
    normalize: bool = False
    min_length: int = 0
    max_length: int | None = None
    max_distance: int = 0


def load(lines: DataFrame, options: FindOptions) -> DataFrame:
    return text.parse_dictionary(lines, options.min_length, options.max_length, options.normalize)


def find(first: DataFrame, second: DataFrame | None, options: FindOptions) -> DataFrame:
    """Of one or two dictionaries: homophone groups (words) at distance 0, else (ord, word, matches) of each row of the
    first that has a similar one in the second (or, with one dictionary, in itself)."""
    if options.max_distance == 0:
        found = homophones.homophones(first) if second is None else homophones.cross_homophones(homophones.tagged(first, second))
        return homophones.ordered(found)
    return similar.similar_lists(similar.similar_pairs(first, second, options.max_distance))


def find_lines(found: DataFrame) -> DataFrame:
    return text.list_lines(found) if "matches" in found.columns else text.group_lines(found)


def create(lines: DataFrame, phonemizer: phonemise.Phonemizer) -> DataFrame:
    """(ord, word, phonemes) of (ord, line) rows."""
    return phonemise.phonemise(lines, phonemizer, "line")


def merge(lines: DataFrame) -> DataFrame:
    """(words): the merged groups of lines of words, in order of their first word."""
    return groups.merge_groups(text.word_sets(lines)).orderBy("words")
