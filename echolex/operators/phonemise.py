"""Words to pronunciations.

The synthesiser that a native backend would call isn't part of Spark. `Rules` is a deterministic stand-in built of
ordered replacements per language, all in the JVM; it makes no claim to equal a synthesiser's output. `Native` runs any
Python callable over Arrow batches, one instance for each worker, for places where such a library is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.functions.text import trim

#: Spelling to sound, in order of application; the rules after those of a language are common to all. No look-around, so
#: that other engines of regular expressions read them alike; a word ends where neither a letter nor a mark follows.
END = r"(\z|[^\p{L}\p{M}])"
RULES: dict[str, list[tuple[str, str]]] = {
    "en": [("tion", "ʃən"), ("ough", "ɔː"), ("igh", "aɪ"), ("ph", "f"), ("kn", "n"), ("wr", "r"), ("th", "θ"), ("sh", "ʃ"),
           ("ch", "tʃ"), ("ck", "k"), ("ng", "ŋ"), ("qu", "kw"), ("ee|ea", "iː"), ("oo", "uː"), ("ai|ay", "eɪ"),
           ("ou|ow", "aʊ"), ("c([eiy])", "s$1"), ("x", "ks"), ("y" + END, "i$1")],
    "de": [("sch", "ʃ"), ("tsch", "tʃ"), ("ch", "x"), ("ie", "iː"), ("ei|ai", "aɪ"), ("eu|äu", "ɔʏ"), ("au", "aʊ"),
           ("ä", "ɛ"), ("ö", "ø"), ("ü", "y"), ("ß", "s"), (r"(\A|[^\p{L}\p{M}])s([pt])", "$1ʃ$2"), ("s([aeiou])", "z$1"), ("z", "ts"),
           ("v", "f"), ("w", "v"), ("qu", "kv"), ("ng", "ŋ")],
    "fr": [("eau|au", "o"), ("oi", "wa"), ("ou", "u"), ("ph", "f"), ("ch", "ʃ"), ("gn", "ɲ"), ("qu", "k"), ("(?:an|en)" + END, "ɑ̃$1"),
           ("on" + END, "ɔ̃$1"), ("in" + END, "ɛ̃$1"), ("[éè]", "e"), ("ç", "s"), ("c([eiy])", "s$1"), ("j", "ʒ"), ("g([eiy])", "ʒ$1"),
           ("u", "y"), ("[tsdx]" + END, "$1")],
    "es": [("ll", "ʎ"), ("ñ", "ɲ"), ("ch", "tʃ"), ("rr", "r"), ("qu([ei])", "k$1"), ("gu([ei])", "g$1"), ("c([ei])", "θ$1"), ("z", "θ"),
           ("j", "x"), ("g([ei])", "x$1"), ("h", ""), ("v", "b"), ("y", "ʝ")],
}
COMMON = [("c", "k"), ("q", "k"), ("x", "ks"), ("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), (r"[^\p{L}\p{M}\p{Z}\x09-\x0D\x{85}]", "")]
#: ASCII names of sounds that aren't ASCII.
ASCII = {"ʃ": "S", "ʒ": "Z", "θ": "T", "ð": "D", "ŋ": "N", "ɲ": "n^", "ʎ": "l^", "ʝ": "j", "ə": "@", "ɪ": "I", "ʊ": "U",
         "ɛ": "E", "ɔ": "O", "ɑ": "A", "ø": "Y", "ʏ": "Y", "ː": ":", "̃": "~"}


class Phonemizer(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Rules:
    """Ordered replacements on the lower-case text."""

    def __init__(self, language: str, ascii_names: bool = False) -> None:
        self.rules = RULES.get(language, []) + COMMON
        self.ascii_names = ascii_names

    def __call__(self, text: Column) -> Column:
        out = reduce(lambda c, rule: F.regexp_replace(c, *rule), self.rules, F.lower(text))
        if self.ascii_names:
            out = reduce(lambda c, item: F.replace(c, F.lit(item[0]), F.lit(item[1])), ASCII.items(), out)
        return out


class Native:
    """`make()` returns a function from one text to its pronunciation; it is called once in each Python worker. What it
    returns may be bytes, as a library in C gives them; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, make: Callable[[], Callable[[str], str | bytes]]) -> None:
        self.make = make

    def __call__(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("binary")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            speak = make()

            def spoken(text: str) -> bytes | None:
                said = speak(text)
                return said.encode() if isinstance(said, str) else said

            for texts in batches:
                yield texts.map(spoken, na_action="ignore")

        return F.make_valid_utf8(run(text).cast("string"))


def phonemise(entries: DataFrame, phonemizer: Phonemizer, entry_col: str = "entry", keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(*keep, word, phonemes): entries trimmed, blank ones and null ones left out, and those without a pronunciation."""
    words = entries.select(*keep, trim(entry_col).alias("word")).where(F.length("word") > 0)
    return words.withColumn("phonemes", phonemizer(F.col("word"))).where(F.length("phonemes") > 0)


def unspoken(entries: DataFrame, phonemizer: Phonemizer, entry_col: str = "entry", keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(*keep, word): the entries that `phonemise` leaves out because they have no pronunciation."""
    words = entries.select(*keep, trim(entry_col).alias("word")).where(F.length("word") > 0)
    return words.where(F.coalesce(F.length(phonemizer(F.col("word"))), F.lit(0)) == 0)


def phonemise_by_language(entries: DataFrame, entry_col: str, lang_col: str, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """`phonemise` with the rules of each row's language; rows of a language without rules, and those of none, get the
    common ones. One branch of the union for each set of rules keeps each expression small enough for code generation."""
    branches = []
    for language in [*RULES, ""]:
        mine = F.col(lang_col) == language if language else F.coalesce(~F.col(lang_col).isin(*RULES), F.lit(True))
        branches.append(phonemise(entries.where(mine), Rules(language), entry_col, (*keep, lang_col)))
    return reduce(DataFrame.unionByName, branches)
