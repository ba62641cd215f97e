"""Language detection: scripts first, then character trigrams (Cavnar and Trenkle 1994).

A profile holds the most frequent trigrams of a language with their ranks; a text is scored by how early its trigrams
stand in each profile. Scores are sums of whole numbers. A result counts as reliable only with enough letters and a clear
lead. Scripts used by one language of the code table decide by themselves. Profiles come from labelled texts, or, without
any, from a short sample of each language (`samples`).

A text is scored in one pass over the scan, in numpy over the code points of a whole batch: the profiles are at most
PROFILE rows for each language, so they go to the tasks, and no trigram is shuffled.

Labels may be wrong. `cross_detect` cuts the texts into two halves and scores each by the profiles of the other, so that
no text helps to judge itself. A label is confirmed if at least half of its texts have it as the best one among itself
and the labels of as many texts or more (a rarer one can't take them away); others are no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.functions.text import trim, words_of
from echolex.operators.samples import SAMPLES
from echolex.session import Scratch, small_table

#: Trigrams in a profile, which bounds its size by the number of languages.
PROFILE = 400
#: Letters a text needs, and the lead of the best score over the next in hundredths, before the result counts as reliable.
LEAST_LETTERS = 20
LEAD = 105
#: By how much more a short text has to lead: SHORT / letters, since its lead is sooner one of chance.
SHORT = 400
#: Characters scored at once, and lines of a file whose scores are looked at together, at most.
CHARS_AT_ONCE = 1 << 20
LINES_AT_ONCE = 1 << 14
SPACE = 32
# Scripts that one language of the code table uses, and its code.
SCRIPTS = {
    "Georgian": "ka",
    "Ethiopic": "am",
    "Hangul": "ko",
    "Hiragana": "jp",
    "Greek": "el",
    "Kannada": "kn",
    "Tamil": "ta",
    "Thai": "th",
    "Gujarati": "gu",
    "Gurmukhi": "pa",
    "Telugu": "te",
    "Malayalam": "ml",
    "Oriya": "or",
    "Myanmar": "my",
    "Sinhala": "si",
    "Khmer": "km",
    "Armenian": "hy",
    "Bengali": "bn",
    "Han": "zh",
}


def word_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, n): how often each lower-case word stands in the texts of an id."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(words_of(text_col)).alias("word"))
    return words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))


def spelled(words: DataFrame) -> DataFrame:
    """Rows with a `word` as one row for each of its trigrams, set in blanks, as `gram` instead."""
    others = [c for c in words.columns if c != "word"]
    padded = words.select(*others, F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"))
    places = padded.select(*others, "padded", F.explode(F.sequence(F.lit(1), F.length("padded") - 2)).alias("place"))
    return places.select(*others, F.substring("padded", F.col("place"), F.lit(3)).alias("gram"))


def trigrams(words: DataFrame) -> DataFrame:
    """(id, gram, n) of (id, word, n): the trigrams of each word, as often as the word."""
    return spelled(words).groupBy("id", "gram").agg(F.sum("n").alias("n"))


def _first(grams: DataFrame, key: str) -> DataFrame:
    """(key, gram, rank): the PROFILE most frequent trigrams of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select(key, "gram", "rank")


def profiles(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank): the PROFILE most frequent trigrams of each language, counted over all texts."""
    labelled = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return _first(trigrams(word_counts(labelled, lang_col, text_col)).withColumnRenamed("id", "lang"), "lang")


def sample_profiles(spark) -> DataFrame:
    """`profiles` of the samples, for detection where there are no labelled texts."""
    return profiles(spark.createDataFrame(list(SAMPLES.items()), "lang string, text string"))


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Known:
    """Profiles as sorted trigrams and a matrix of what each counts for a language."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.langs = sorted({lang for lang, _, _ in rows})
        grams = sorted({gram for _, gram, _ in rows})
        points = np.array([[ord(c) for c in gram] for gram in grams], np.int64).reshape(-1, 3)
        keys = points[:, 0] << 42 | points[:, 1] << 21 | points[:, 2]
        order = np.argsort(keys)
        place = {grams[i]: k for k, i in enumerate(order)}
        self.keys = keys[order]
        self.early = np.zeros((len(grams), len(self.langs)))
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.early[place[gram], column[lang]] = PROFILE + 1 - rank

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of lower-case texts, one column for each language; exact, being sums far below 2**53."""
        out = np.zeros((len(texts), len(self.langs)))
        if not len(self.keys) or not texts:
            return out
        points = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t or "") + 2 for t in texts])
        points = np.where(_letter_table()[points], points, SPACE)
        blank = points == SPACE
        kept = np.ones(len(points), bool)
        kept[1:] = ~(blank[1:] & blank[:-1])  # one blank between two words
        points, text = points[kept], text[kept]
        middle = np.flatnonzero(points[1:-1] != SPACE) + 1
        key = points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        at, text = at[hit], text[middle[hit]]
        step = max(1, CHARS_AT_ONCE // len(self.keys))
        for low in range(0, len(texts), step):
            rows = min(step, len(texts) - low)
            first, last = np.searchsorted(text, (low, low + rows))
            counts = np.bincount((text[first:last] - low) * len(self.keys) + at[first:last], minlength=rows * len(self.keys))
            out[low : low + rows] = counts.reshape(rows, -1) @ self.early
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * CHARS_AT_ONCE // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def scores(texts: DataFrame, known: DataFrame, text_col: str = "text", by: str | None = None) -> DataFrame:
    """The rows of `texts` with `scores`: (lang, score) of every profile, the best one first. With `by`, a column of both
    tables, by the profiles that agree in it. What is collected is at most PROFILE rows for each language (and `by`)."""
    held: dict = {}
    for row in known.select(F.lit(None).alias("by") if by is None else F.col(by).alias("by"), "lang", "gram", "rank").collect():
        held.setdefault(row["by"], []).append((row["lang"], row["gram"], row["rank"]))
    tables = {key: Known(rows) for key, rows in held.items()}
    kind = pa.list_(pa.struct([("lang", pa.string()), ("score", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lower, keys = batch.column("__lower").to_pylist(), batch.column("__by").to_pylist()
            found: list = [[] for _ in lower]
            for key, table in tables.items():
                rows = [i for i, k in enumerate(keys) if k == key]
                for i, row in zip(rows, table.scores([lower[i] for i in rows])):
                    pairs = [{"lang": lang, "score": int(score)} for lang, score in zip(table.langs, row) if score > 0]
                    found[i] = sorted(pairs, key=lambda p: (-p["score"], p["lang"]))
            kept = batch.drop_columns(["__lower", "__by"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, kind)], [*kept.schema.names, "scores"])

    key = F.lit(None).cast("string") if by is None else F.col(by)
    rows = texts.drop("scores").withColumn("__lower", F.lower(text_col)).withColumn("__by", key).drop(text_col)
    plain = [f for f in rows.schema.fields if f.name not in ("__lower", "__by")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + ["scores array<struct<lang: string, score: bigint>>"])
    return rows.mapInArrow(run, out)


def _script(foreign: Column, letters: Column) -> Column:
    """The code of the script that one language uses, if most letters are of it; `foreign` are those not Latin."""
    out = F.lit(None).cast("string")
    for script, code in reversed(SCRIPTS.items()):
        found = F.regexp_count(foreign, F.lit(rf"\p{{Is{script}}}"))
        out = F.when((found > 0) & (found * (3 if script == "Hiragana" else 2) > letters), code).otherwise(out)
    return F.when(F.length(foreign) * 3 > letters, out)


def _with_letters(texts: DataFrame, text_col: str) -> DataFrame:
    """The texts with `letters`, their number, and `script`, the language that their script decides."""
    text = F.coalesce(text_col, F.lit(""))
    rows = texts.withColumn("__foreign", F.regexp_replace(text, r"[\p{IsLatin}\P{L}]+", ""))
    rows = rows.withColumn("letters", F.length(F.regexp_replace(text, r"\P{L}+", "")))
    return rows.withColumn("script", _script(F.col("__foreign"), F.col("letters"))).drop("__foreign")


def _reliable(scored: Column) -> Column:
    """The language of the best score if its lead is clear."""
    first, second = F.get(scored, F.lit(0)), F.coalesce(F.get(scored, F.lit(1))["score"], F.lit(0))
    return F.when(100 * F.col("letters") * first["score"] >= (LEAD * F.col("letters") + SHORT) * second, first["lang"])


def _named(scored: Column) -> Column:
    return F.coalesce("script", F.when(F.col("letters") >= LEAST_LETTERS, _reliable(scored)))


def detect(texts: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language): one row for each text; null where nothing is reliable (also for null and empty texts). `known`
    are `profiles`, by default those of the samples."""
    known = sample_profiles(texts.sparkSession) if known is None else known
    rows = _with_letters(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return scores(rows, known, "text").select("id", _named(F.col("scores")).alias("language"))


def _halves(texts: DataFrame) -> DataFrame:
    """(label, text, half, ...) of (label, text, ...): equal texts in one half, and a label of several in both."""
    hashed = texts.withColumn("hash", F.md5("text"))
    odd = F.conv(F.substring("hash", 32, 1), 16, 10).cast("int") % 2
    ends = hashed.groupBy("label").agg(F.max("hash").alias("high"), F.min(odd).alias("least"), F.max(odd).alias("most"), F.count("text").alias("n"))
    half = F.when(F.col("least") != F.col("most"), odd).otherwise((F.col("hash") == F.col("high")).cast("int"))
    # one row a label; the planner knows their size, so the texts aren't shuffled by their label
    rows = ends.collect()
    columns = {c: pa.array([r[c] for r in rows], t) for c, t in (("high", pa.string()), ("least", pa.int32()), ("most", pa.int32()), ("n", pa.int64()))}
    known = small_table(texts.sparkSession, __label=pa.array([r["label"] for r in rows], pa.string()), **columns)
    return hashed.join(known, F.col("label").eqNullSafe(F.col("__label"))).withColumn("half", F.coalesce(half, odd, F.lit(0)).cast("string")).drop("hash", "high", "least", "most", "__label")


def cross_detect(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, language) of labelled texts, some of them wrongly labelled or not at all: `detect`, each text by the profiles
    that the other half of the texts gives for the confirmed labels.

    Labels are folded (case, white space). A trigram in the profile of every language tells nothing as far as it is as
    early in all of them: its last place counts as none, in all profiles, which leaves the order of the languages as it
    is and their differences plain."""
    scratch = Scratch(texts.sparkSession, "languages")
    label = F.nullif(F.lower(trim(lang_col)), F.lit(""))
    rows = _halves(texts.select(F.col(id_col).alias("id"), label.alias("label"), F.col(text_col).alias("text")))
    grams = trigrams(word_counts(rows.where("label IS NOT NULL AND text IS NOT NULL").withColumn("part", F.concat("half", "label")), "part", "text"))
    parts = _first(grams.withColumnRenamed("id", "part"), "part")
    other = F.when(F.startswith("part", F.lit("0")), "1").otherwise("0")  # the texts of one half learn from the other
    crossed = scratch.cut(parts.select(other.alias("half"), F.substring("part", F.lit(2), F.length("part")).alias("lang"), "gram", "rank"))
    scored = scratch.cut(scores(_with_letters(rows, "text"), crossed, "text", "half").select("id", "label", "n", "half", "letters", "script", "scores"))
    sizes = {r["label"]: r["n"] for r in scored.where("label IS NOT NULL").groupBy("label").agg(F.max("n").alias("n")).collect()}  # one a label
    numbers = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(n))]) if sizes else F.lit(None).cast("map<string, bigint>")
    rivals = F.filter("scores", lambda x: numbers[x["lang"]] >= F.col("n"))
    own = F.get(F.filter("scores", lambda x: x["lang"] == F.col("label")), F.lit(0))["score"]
    wins = F.coalesce(own >= F.get(rivals, F.lit(0))["score"], F.lit(False)).cast("int")
    votes = scored.where("label IS NOT NULL").groupBy("label").agg(F.sum(wins).alias("wins"), F.max("n").alias("n"))
    kept = [r["label"] for r in votes.where("2 * wins >= n").collect()] or list(sizes)
    chosen = crossed.where(F.col("lang").isin(kept))
    held = chosen.groupBy("half", "gram").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    several = chosen.groupBy("half").agg(F.count_distinct("lang").alias("langs"))
    shared = held.join(several, "half").where("n = langs AND n > 1").select("half", "gram", (F.lit(PROFILE + 1) - F.col("last")).alias("least"))
    place = (F.col("rank") + F.coalesce("least", F.lit(0))).cast("int")
    plain = chosen.join(shared, ["half", "gram"], "left").select("half", "lang", "gram", place.alias("rank")).where(F.col("rank") <= PROFILE)
    final = scores(_with_letters(rows, "text"), scratch.cut(plain), "text", "half")
    return final.select("id", _named(F.col("scores")).alias("language"))


def detect_file(lines: DataFrame, known: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(language, the lines read) of an (ord, line) table: the shortest prefix of lines that is reliable. An EOFError if
    the end comes first.

    Lines are read in growing prefixes, one more than was read before each time up to LINES_AT_ONCE; only their letters
    and scores come to the driver, the running sums of which decide."""
    spark = lines.sparkSession
    known = sample_profiles(spark) if known is None else known
    rows = [(r["lang"], r["gram"], r["rank"]) for r in known.collect()]
    scored = scores(_with_letters(lines.select("ord", "line"), "line").select("ord", "line", "letters"), spark.createDataFrame(rows, "lang string, gram string, rank int"), "line")
    scripts = [F.regexp_count(F.coalesce("line", F.lit("")), F.lit(rf"\p{{Is{script}}}")).alias(script) for script in SCRIPTS]
    read, size, letters, sums, seen = None, 16, 0, dict.fromkeys(sorted({r[0] for r in rows}), 0), dict.fromkeys(SCRIPTS, 0)
    while True:
        after = F.lit(True) if read is None else F.col("ord") > read
        part = scored.where(after).orderBy("ord").limit(size).collect()
        found = {r["ord"]: r for r in lines.where(after).select("ord", *scripts).orderBy("ord").limit(size).collect()}
        for row in part:
            letters += row["letters"]
            for pair in row["scores"]:
                sums[pair["lang"]] += pair["score"]
            for script in SCRIPTS:
                seen[script] += found[row["ord"]][script] or 0
            by_script = [c for s, c in SCRIPTS.items() if seen[s] and seen[s] * (3 if s == "Hiragana" else 2) > letters]
            best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:2]
            second = best[1][1] if len(best) > 1 else 0
            clear = best and best[0][1] > 0 and 100 * letters * best[0][1] >= (LEAD * letters + SHORT) * second
            if by_script or (letters >= LEAST_LETTERS and clear):
                return (by_script or [best[0][0]])[0], lines.where(F.col("ord") <= row["ord"])
        if len(part) < size:
            raise EOFError("not enough text for language detection")
        read, size = part[-1]["ord"], min(2 * size, LINES_AT_ONCE)
