"""Lines of a delimited file that are no well-formed rows, apart from the good ones and with the reason.

Method: minimum-cost error parse. A row is a fixed number of fields with one delimiter between them; a field whose
first character is a quote is quoted up to the next quote that isn't doubled. A dynamic programme runs over the line,
one state for each pair of (fields begun, what the parser is in), and may insert or delete quotes and delimiters at a
cost of 1 each; all else is kept. The least cost of a line with any number of fields is that of its quoting, the least
cost of one with the right number that of its columns. A line of cost zero is parsed as it stands and its values are
checked against their types; of another, the edit operations say what is wrong.

Only quotes and delimiters matter to the programme, so it runs on the line's shape, in which each run of other
characters is one symbol, once for each different shape of a batch. A line without quotes and with the right number of
delimiters has cost zero as it stands, so only the shapes of other lines leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.functions.text import is_blank, trim

FIELDS = ("word", "phonemes", "lang", "freq", "added")
DELIMITER, QUOTE, OTHER = "\t", '"', "x"
NAMES = {QUOTE: "q", DELIMITER: "d"}
#: Where the parser is: at a field's start, in a plain field, inside quotes, behind a quote inside quotes.
START, PLAIN, INSIDE, BEHIND = range(4)
#: Shapes up to this length are remembered; a longer one is worked out each time.
REMEMBERED = 200
#: Symbols between two layers of costs that are kept; those between are worked out again when the edits are traced, so
#: that a line of any length takes the memory of one block and of a layer for each block.
BLOCK = 4096
NEVER = 1 << 28


def _step(state: int, symbol: str) -> tuple[int, int] | None:
    """(next state, fields begun) after reading a symbol as it is; None if the symbol can't stand there."""
    if symbol == DELIMITER:
        return (INSIDE, 0) if state == INSIDE else (START, 1)
    if symbol == QUOTE:
        return ((INSIDE, 0), (PLAIN, 0), (BEHIND, 0), (INSIDE, 0))[state]
    return None if state == BEHIND else ((PLAIN, 0), (PLAIN, 0), (INSIDE, 0))[state]


@dataclass(frozen=True)
class Programme:
    """The steps of the programme as matrices over its nodes, that is pairs of (fields begun, state)."""

    start: np.ndarray  # cost of each node before the first symbol
    inserted: list[list[str]]  # the symbols inserted on the cheapest way between two nodes
    over: dict[str, np.ndarray]  # [to, from]: least cost of a symbol and what is inserted behind it
    through: dict[str, np.ndarray]  # [to, from]: the node right behind the symbol on that way
    kept: dict[str, np.ndarray]  # [from, behind]: whether the symbol was read and not deleted


@lru_cache(maxsize=16)
def programme(fields: int) -> Programme:
    most = fields + 1  # all larger numbers of fields count as this one
    nodes = [(begun, state) for begun in range(1, most + 1) for state in range(4)]
    place = {node: i for i, node in enumerate(nodes)}
    size = len(nodes)

    def after(node: tuple[int, int], symbol: str) -> int | None:
        read = _step(node[1], symbol)
        return None if read is None else place[min(node[0] + read[1], most), read[0]]

    inserted: list[list[str | None]] = [[None] * size for _ in nodes]
    for i in range(size):  # breadth first: every insertion costs 1
        inserted[i][i] = ""
        waiting = [i]
        for at in waiting:
            for symbol in NAMES:
                to = after(nodes[at], symbol)
                if to is not None and inserted[i][to] is None:
                    inserted[i][to] = inserted[i][at] + symbol
                    waiting.append(to)
    insertions = np.array([[NEVER if way is None else len(way) for way in row] for row in inserted])
    over, through, kept = {}, {}, {}
    for symbol in (DELIMITER, QUOTE, OTHER):
        price, read = np.full((size, size), NEVER), np.zeros((size, size), bool)
        for i, node in enumerate(nodes):
            if symbol != OTHER:
                price[i, i] = 1
            if (to := after(node, symbol)) is not None:
                price[i, to], read[i, to] = 0, True
        ways = price[:, :, None] + insertions[None, :, :]  # from, behind the symbol, to
        over[symbol] = np.minimum(ways.min(1), NEVER).T.astype(np.int32).copy()
        through[symbol], kept[symbol] = ways.argmin(1).T.copy(), read
    return Programme(insertions[place[1, START]].astype(np.int32), inserted, over, through, kept)


def parse_shape(shape: str, fields: int) -> tuple[int, int, str]:
    """(cost of any number of fields, cost of exactly `fields`, the edits of the latter).

    `shape` holds delimiters, quotes and OTHER. Edits are written as operation and place in the shape, in order:
    `+q3` inserts a quote before symbol 3, `-d5` deletes the delimiter that is symbol 5.
    """
    steps = programme(fields)
    cost, layers = steps.start, [steps.start]
    for at, symbol in enumerate(shape, 1):
        cost = (steps.over[symbol] + cost).min(1)
        if at % BLOCK == 0:
            layers.append(cost)
    ends = np.where(np.arange(len(cost)) % 4 == INSIDE, NEVER, cost)
    exact = ends[4 * (fields - 1) : 4 * fields]
    total = int(exact.min())
    return int(ends.min()), total, _traced(shape, steps, layers, 4 * (fields - 1) + int(exact.argmin())) if total else ""


def _traced(shape: str, steps: Programme, layers: list[np.ndarray], node: int) -> str:
    edits: list[str] = []

    def insertions(way: str, at: int) -> None:
        edits.extend(f"+{NAMES[symbol]}{at}" for symbol in reversed(way))

    for block in range(len(layers) - 1, -1, -1):
        part = shape[block * BLOCK : (block + 1) * BLOCK]
        costs = [layers[block]]
        for symbol in part:
            costs.append((steps.over[symbol] + costs[-1]).min(1))
        for i in range(len(part) - 1, -1, -1):
            symbol, at = part[i], block * BLOCK + i
            before = int((steps.over[symbol][node] + costs[i]).argmin())
            behind = int(steps.through[symbol][node, before])
            insertions(steps.inserted[behind][node], at + 1)
            if not steps.kept[symbol][before, behind]:
                edits.append(f"-{NAMES[symbol]}{at}")
            node = before
    insertions(steps.inserted[START][node], 0)
    return " ".join(reversed(edits))


@lru_cache(maxsize=100_000)
def _remembered(shape: str, fields: int) -> tuple[int, int, str]:
    return parse_shape(shape, fields)


def shape_of(line: Column) -> Column:
    return F.regexp_replace(line, r'[^\t"]+', OTHER)


def split_quoted(line: Column) -> Column:
    """The fields of a line of cost zero, quotes taken off. No quantifier backtracks, so long fields take no stack."""
    held = F.regexp_extract_all(F.concat(F.lit(DELIMITER), line), F.lit(r'\t("(?:[^"]++|"")*+"|[^\t]*+)'), 1)
    bare = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit(QUOTE))
    return F.transform(held, lambda x: F.when(F.startswith(x, F.lit(QUOTE)), bare(x)).otherwise(x))


def parse(lines: DataFrame, raw_col: str = "raw", fields: int = len(FIELDS)) -> DataFrame:
    """The lines with `parsed`: struct(quoting int, columns int, edits string, fields array<string>). The costs of
    quoting and of columns; `fields` is null unless both are zero. A null line has a null `parsed`."""

    @F.pandas_udf("quoting int, columns int, edits string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for shapes in batches:
            codes, distinct = pd.factorize(shapes)
            parsed = [(_remembered if len(x) <= REMEMBERED else parse_shape)(x, fields) for x in distinct]
            rows = pd.DataFrame([*parsed, (0, 0, "")], columns=["quoting", "columns", "edits"])  # the last one for null
            yield rows.astype({"quoting": "int32", "columns": "int32"}).iloc[codes].reset_index(drop=True)

    raw = lines[raw_col]
    plain = ~F.contains(raw, F.lit(QUOTE)) & (F.length(raw) - F.length(F.replace(raw, F.lit(DELIMITER), F.lit(""))) == fields - 1)
    cost = lines.withColumn("__plain", plain).withColumn("__cost", run(F.when(~F.col("__plain"), shape_of(raw))))
    zero = F.col("__cost.columns") == 0
    held = F.when(F.col("__plain"), F.split(raw, DELIMITER)).when(zero, split_quoted(raw))
    parsed = F.struct("__cost.quoting", "__cost.columns", "__cost.edits", held.alias("fields"))
    return cost.select(*lines.columns, F.when(raw.isNotNull(), parsed).alias("parsed"))


def _is_day(text: Column) -> Column:
    """An existing calendar day written YYYY-MM-DD in ASCII digits (year 0000 is none)."""
    shaped = F.rlike(text, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    day = F.try_to_date(F.when(shaped & ~F.startswith(text, F.lit("0000")), text), "yyyy-MM-dd")
    return day.isNotNull()


def checked(lines: DataFrame, languages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Every line that isn't null or blank, with its values, `reason` (null for a good line) and `edits`.

    The values `word`, `phonemes`, `lang`, `freq`, `added` are trimmed strings, null where the line doesn't parse. The
    reason is the first of quoting, columns, word, phonemes, lang, freq, added that holds. `languages` has a column
    `lang` of the known codes, a small table. Columns of `lines` with those names are replaced.
    """
    rows = lines.drop(*[c for c in (*FIELDS, "reason", "edits", "parsed") if c != raw_col]).where(
        F.col(raw_col).isNotNull() & ~is_blank(raw_col)
    )
    parsed = parse(rows, raw_col)
    values = [trim(F.get("parsed.fields", i)).alias(name) for i, name in enumerate(FIELDS)]
    parsed = parsed.select(*rows.columns, "parsed", *values)
    known = languages.select(F.col("lang").alias("__known")).dropna().distinct()
    parsed = parsed.join(known, parsed["lang"] == known["__known"], "left")
    lost = F.lit("�")
    reason = (
        F.when(F.col("parsed.quoting") > 0, "quoting")
        .when(F.col("parsed.columns") > 0, "columns")
        .when((F.col("word") == "") | F.contains("word", lost), "word")
        .when((F.col("phonemes") == "") | F.contains("phonemes", lost) | F.rlike("phonemes", F.lit("[0-9]")), "phonemes")
        .when(F.col("__known").isNull(), "lang")
        .when(~F.rlike("freq", F.lit(r"\A[0-9]{1,9}\z")), "freq")
        .when(~_is_day(F.col("added")), "added")
    )
    return parsed.select(*rows.columns, *FIELDS, reason.alias("reason"), F.col("parsed.edits").alias("edits"))


def good_rows(lines: DataFrame, languages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The good lines, with `freq` as int and `added` as date."""
    rows = checked(lines, languages, raw_col).where("reason IS NULL").drop("reason", "edits")
    return rows.withColumn("freq", F.col("freq").cast("int")).withColumn("added", F.to_date("added", "yyyy-MM-dd"))


def bad_rows(lines: DataFrame, languages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The bad lines as they came, with `reason` and, for those that don't parse, the cheapest `edits` to five fields."""
    rows = checked(lines, languages, raw_col).where("reason IS NOT NULL")
    return rows.select(*[c for c in rows.columns if c not in FIELDS])
