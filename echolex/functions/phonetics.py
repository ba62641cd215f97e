"""Pronunciations as Columns: broad sound classes and edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolex.functions.text import _column, squeeze

# The sound each symbol of a row is folded to.
SOUND_CLASSES = {
    "a": "äɐɑʌ",
    "e": "æɛœɜ",
    "i": "ɨɪ",
    "o": "ɔɒɵʊ",
    "u": "ʉ",
    "y": "ʏø",
    "ɘ": "ɤɞəɯ",
    "b": "ʙ",
    "d": "ɖɟ",
    "f": "ɸ",
    "g": "ɢ",
    "j": "ʎʝ",
    "k": "q",
    "l": "ɭɫʟ",
    "m": "ɱ",
    "n": "ɳɲŋɴ",
    "r": "ɾɹɽɻʀʁ",
    "t": "ʈc",
    "v": "βʋ",
    "x": "ɣχħhɦ",
    "θ": "ð",
    "ʃ": "ʂç",
    "ʒ": "ʐ",
    "ɰ": "ʕ",
}
FROM = "".join(SOUND_CLASSES.values())
TO = "".join(sound * len(symbols) for sound, symbols in SOUND_CLASSES.items())


def normalize(phonemes: Column | str) -> Column:
    """Modifiers and white space dropped, symbols folded into broad classes, then runs reduced. May become empty.

    No Unicode normalisation: a composed and a decomposed symbol may fold differently.
    """
    bare = F.regexp_replace(_column(phonemes), r"(?U)[ʰ-ͯ\s]", "")
    return squeeze(F.translate(bare, FROM, TO))


def similar(a: Column | str, b: Column | str, distance: int) -> Column:
    """True if the edit distance, in code points, is at most `distance`."""
    return F.levenshtein(_column(a), _column(b), distance) >= 0
