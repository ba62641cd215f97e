"""One consistent form for text that looks the same but holds different characters.

Method: every value is mapped to a look-alike skeleton by built-in string functions (undrawn characters fall away,
every single space becomes a space, foreign characters become the symbol they are drawn like, composed symbols are taken
apart and their marks put in canonical order). The skeletons are grouped in SQL under the accent-sensitive collation
UNICODE, which also equates composed with decomposed characters; the canonical member of a class is the smallest
reference value in it, or else its smallest value; it is joined back to the rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of other scripts or styles and the phonetic symbol each is drawn like.
DRAWN_LIKE = {
    "a": "аａ⍺",
    "b": "ЬƄ",
    "c": "сϲⲥᴄ",
    "d": "ԁ",
    "e": "еҽ℮",
    "f": "ẝ",
    "g": "ɡᶃց",
    "h": "һհ",
    "i": "іιıⲓ",
    "j": "јϳ",
    "k": "ĸκкᴋⲕ",
    "l": "ӏ|∣ǀ",
    "m": "ⅿ",
    "n": "ոռ",
    "o": "оοօσᴏⲟ",
    "p": "рρ⍴ⲣ",
    "q": "ԛգզ",
    "r": "гᴦⲅ",
    "s": "ѕꜱ",
    "t": "τтᴛ",
    "u": "υսʋᴜꞟ",
    "v": "νѵᴠ",
    "w": "ԝѡաᴡ",
    "x": "х×⤫⤬",
    "y": "уγүყ",
    "z": "ᴢ",
    "ɑ": "α⍺",
    "æ": "ӕ",
    "ɔ": "ᴐͻ",
    "ə": "ǝә",
    "ɛ": "εє",
    "ɣ": "γ",
    "ɪ": "і",
    "ɵ": "өѳꝋ",
    "ø": "∅⌀",
    "ɸ": "ϕφⲫ",
    "ʃ": "∫ꭍ",
    "ʊ": "ᴜ",
    "ʒ": "ӡꝫⳍ",
    "θ": "ϑ",
    "χ": "ꭓⲭ",
    "ŋ": "ղ",
    "ð": "∂",
    "ʌ": "⋀∧",
    "ˈ": "ʹ′'ʼ’ˊ´",
    "ˌ": "‚",
    "ː": ":꞉∶：",
    "̃": "̴͂",
    "̩": "͈",
}
#: Fixed values, in the order in which a character with several likenesses takes one: the first row above that has it
#: wins, except for these.
PREFERRED = {"γ": "ɣ", "і": "i", "ᴜ": "u", "⍺": "ɑ", "ʋ": "u"}
#: Compatibility forms that look like their plain letter; superscripts, circled letters and fractions don't.
LOOKS_PLAIN = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")


def undrawn() -> str:
    """All characters that draw nothing: format and control characters (but white space), variation selectors, the
    grapheme joiner and the fillers."""
    fillers = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
    selectors = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    kinds = ("Cf", "Cc")
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) in kinds and not chr(p).isspace()]
    return "".join(sorted({*fillers, *map(chr, selectors), *map(chr, points)} - {"\0"}))


def likeness(symbols: Iterable[str]) -> dict[str, str]:
    """character -> symbol for every foreign character that is drawn like one of `symbols`; never from a symbol."""
    symbols = set(symbols)
    table: dict[str, str] = {}
    for symbol, foreign in DRAWN_LIKE.items():
        for c in foreign:
            if symbol in symbols and c not in symbols:
                table.setdefault(c, symbol)
    table |= {c: s for c, s in PREFERRED.items() if s in symbols and c not in symbols}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if c in symbols or c in table:
            continue
        if unicodedata.category(c) == "Zs":
            table[c] = " "
            continue
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind in LOOKS_PLAIN and rest and " " not in rest:
            plain = chr(int(rest, 16))
            if plain in symbols or plain in table:
                table[c] = table.get(plain, plain)
    return table


def blocking_key(value: Column, symbols: Iterable[str]) -> Column:
    """The base letters of what a value looks like: one `translate` that also drops marks. Equal for look-alikes."""
    symbols = set(symbols)
    base = lambda s: "" if unicodedata.combining(s) else unicodedata.normalize("NFD", s)[0]
    table = {c: base(s) for c, s in likeness(symbols).items()}
    table |= {s: base(s) for s in symbols if base(s) != s}
    table |= {chr(p): "" for p in range(0x300, 0x370)}
    mapped = [(c, s) for c, s in table.items() if s]
    dropped = [c for c, s in table.items() if not s]
    start = "".join(c for c, _ in mapped) + "".join(dropped) + undrawn()
    return F.translate(value, start, "".join(s for _, s in mapped))


def skeleton(value: Column, symbols: Iterable[str]) -> Column:
    """What a value looks like, spelled with `symbols`; all built-in functions, null for null."""
    symbols = sorted(set(symbols))
    table = likeness(symbols)
    out = F.translate(value, "".join(table) + undrawn(), "".join(table.values()))
    apart = {s: d for s in symbols if (d := unicodedata.normalize("NFD", s)) != s}
    out = reduce(lambda col, item: F.replace(col, F.lit(item[0]), F.lit(item[1])), apart.items(), out)
    marks: dict[int, str] = {}
    for c in sorted(set("".join(unicodedata.normalize("NFD", s) for s in [*symbols, *table.values()]))):
        if order := unicodedata.combining(c):
            marks[order] = marks.get(order, "") + c
    orders = sorted(marks)
    for _ in orders[1:]:  # a bubble sort of the marks by their class
        for low, high in zip(orders, orders[1:]):
            out = F.regexp_replace(out, f"([{marks[high]}]+)([{marks[low]}]+)", "$2$1")
    return out


def unify(
    values: DataFrame,
    reference: DataFrame,
    symbols: DataFrame,
    col: str = "phonemes",
    keep: tuple[str, ...] = (),
    only_reference: bool = False,
) -> DataFrame:
    """(`col`, *keep, canonical, is_reference): each row of `values` with the canonical member of its class.

    `reference` has the same column `col` and is a small table of preferred forms; `symbols` has a column `symbol` and
    is bounded by the alphabet. Null values are no case and give no rows; an empty string is a value like any other.
    Rows repeated in `values` come out as often as they came in. With `only_reference`, rows whose class has no
    reference form are left out. Rows are blocked by their base letters first; only blocks with several different
    values (or with a reference form) are compared under the collation.
    """
    spark = values.sparkSession
    alphabet = [r[0] for r in symbols.select("symbol").distinct().collect() if r[0]]
    block = blocking_key(F.col("value"), alphabet)
    kept = [values[c].alias(f"k{i}") for i, c in enumerate(keep)]
    rows = values.select(*kept, values[col].alias("value")).dropna(subset=["value"]).withColumn("block", block)
    known = reference.select(reference[col].alias("value")).dropna().withColumn("block", block)
    if only_reference:
        blocks = known.select("block").distinct()
    else:
        spread = rows.select("block", "value", F.lit(0).alias("known")).unionByName(known.withColumn("known", F.lit(1))).groupBy("block")
        ends = spread.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("known").alias("known"))
        blocks = ends.where("low <> high OR known = 1").select("block")
    close = rows.join(blocks, "block", "left_semi").withColumn("looks", skeleton(F.col("value"), alphabet))
    distinct = close.select("looks", "value").groupBy("looks").agg(F.min("value").alias("value"))
    named = {"near": distinct, "known": known.withColumn("looks", skeleton(F.col("value"), alphabet))}
    # one row for each different skeleton; a class under the collation has few of them
    classes = spark.sql(
        """
        SELECT looks, first_value(struct(foreign, value)) OVER (
                 PARTITION BY looks COLLATE UNICODE ORDER BY foreign, value) AS member
        FROM (SELECT looks, value, 1 AS foreign FROM {near} UNION ALL SELECT looks, value, 0 AS foreign FROM {known})
        """,
        **named,
    )
    classes = classes.groupBy("looks").agg(F.min("member").alias("member"))
    joined = close.join(classes, "looks").select(
        F.col("value"),
        *[f"k{i}" for i in range(len(keep))],
        F.col("member.value").alias("canonical"),
        (F.col("member.foreign") == 0).alias("is_reference"),
    )
    if only_reference:
        joined = joined.where("is_reference")
    else:
        alone = rows.join(blocks, "block", "left_anti")
        own = F.col("value").alias("canonical")
        joined = joined.unionByName(alone.select("value", *[f"k{i}" for i in range(len(keep))], own, F.lit(False).alias("is_reference")))
    return joined.select(F.col("value").alias(col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "canonical", "is_reference")


def match_reference(values: DataFrame, reference: DataFrame, symbols: DataFrame, id_col: str = "ord", key_col: str = "key_id", col: str = "phonemes") -> DataFrame:
    """(`id_col`, `key_col`): the rows whose value looks like a reference value but is stored differently."""
    found = unify(values, reference, symbols, col, (id_col,), only_reference=True).where(F.col("canonical") != F.col(col))
    keys = reference.select(reference[key_col].alias(key_col), reference[col].alias("canonical"))
    return found.join(keys, "canonical").select(id_col, key_col)
