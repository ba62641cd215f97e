"""Text functions on Columns. White space is Unicode White_Space, lengths count code points unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space at either end. Spark's own `trim` knows only U+0020."""
    return F.regexp_replace(_column(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """True for an empty value and one of white space only."""
    return ~F.rlike(_column(c), F.lit(r"(?U)\S"))


def tab_pair(line: Column | str) -> Column:
    """struct(word, phonemes) of a trimmed line split at its first tab, both halves trimmed; null without a tab."""
    whole = trim(line)
    at = F.instr(whole, "\t")
    word, rest = trim(F.substring(whole, F.lit(1), at - 1)), trim(F.substring(whole, at + 1, F.length(whole)))
    return F.when(at > 0, F.struct(word.alias("word"), rest.alias("phonemes")))


def tokens(c: Column | str) -> Column:
    """The parts between white space, none of them empty."""
    return F.filter(F.split(_column(c), r"(?U)\s+"), lambda x: x != F.lit(""))


def words_of(text: Column | str) -> Column:
    """The lower-case runs of letters of a running text."""
    return F.filter(F.split(F.lower(_column(text)), r"[^\p{L}]+"), lambda x: x != F.lit(""))


def string_lines(text: Column | str) -> Column:
    """The lines of a string in memory: split at LF, a CR before it dropped, no empty line after the last LF."""
    parts = F.split(_column(text), r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def squeeze(c: Column | str) -> Column:
    """Runs of one character reduced to one."""
    return F.regexp_replace(_column(c), r"(?s)(.)\1+", "$1")


def graphemes(c: Column | str) -> Column:
    """The number of extended grapheme clusters."""
    return F.regexp_count(_column(c), F.lit(r"\X"))


def joined(words: Column | str) -> Column:
    """Words with single spaces between them."""
    return F.array_join(_column(words), " ")
