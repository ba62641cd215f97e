"""The catalogue of languages and their voices, and the table of language codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The 69 detectable languages and their two-letter codes, in the detector's order.
LANGUAGE_CODES = {
    "epo": "eo", "eng": "en", "rus": "ru", "cmn": "zh", "spa": "es", "por": "pt", "ita": "it", "ben": "bn",
    "fra": "fr", "deu": "de", "ukr": "uk", "kat": "ka", "ara": "ar", "hin": "hi", "jpn": "jp", "heb": "he",
    "yid": "yi", "pol": "pl", "amh": "am", "jav": "jv", "kor": "ko", "nob": "nb", "dan": "da", "swe": "sv",
    "fin": "fi", "tur": "tr", "nld": "nl", "hun": "hu", "ces": "cs", "ell": "el", "bul": "bg", "bel": "be",
    "mar": "mr", "kan": "kn", "ron": "ro", "slv": "sl", "hrv": "hr", "srp": "sr", "mkd": "mk", "lit": "lt",
    "lav": "lv", "est": "et", "tam": "ta", "vie": "vi", "urd": "ur", "tha": "th", "guj": "gu", "uzb": "uz",
    "pan": "pa", "aze": "az", "ind": "id", "tel": "te", "pes": "fa", "mal": "ml", "ori": "or", "mya": "my",
    "nep": "ne", "sin": "si", "khm": "km", "tuk": "tk", "aka": "ak", "zul": "zu", "sna": "sn", "afr": "af",
    "lat": "la", "slk": "sk", "cat": "ca", "tgl": "tl", "hye": "hy",
}


class NoVoiceForLanguage(Exception):
    """No voice speaks the language."""

    def __init__(self, language: str) -> None:
        super().__init__(f'No voice found for language "{language}"')
        self.language = language


def code_table(spark) -> DataFrame:
    """(name, code): the languages and their codes, a fixed 69 rows."""
    return spark.createDataFrame(list(LANGUAGE_CODES.items()), "name string, code string")


def two_letter_code(name: str) -> str:
    """The code of a language name; a KeyError for an unknown one."""
    return LANGUAGE_CODES[name.lower()]


def catalogue(voices: DataFrame) -> DataFrame:
    """(lang, filename, priority) of a synthesiser's voices, each with an array `languages` of (name, priority): one row
    for each voice and language. A voice without a filename or without languages speaks none. A flat table stays as it is."""
    if "languages" not in voices.columns:
        return voices.select("lang", "filename", "priority")
    spoken = voices.where("filename IS NOT NULL").select("filename", F.explode("languages").alias("spoken"))
    return spoken.select(F.col("spoken.name").alias("lang"), "filename", F.col("spoken.priority").alias("priority")).dropna(subset=["lang"])


def voices_by_language(voices: DataFrame) -> DataFrame:
    """(lang, voices array<struct<filename, priority>>): larger priorities first, equal ones by filename."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("priority").cast("int")).alias("rank"), "filename", "priority")))
    grouped = voices.dropna(subset=["lang"]).groupBy("lang").agg(ranked.alias("ranked"))
    plain = F.transform("ranked", lambda v: F.struct(v["filename"].alias("filename"), v["priority"].alias("priority")))
    return grouped.select("lang", plain.alias("voices"))


def default_voices(voices: DataFrame) -> DataFrame:
    """(lang, filename, priority): the voice of the largest priority, of equal ones the first filename."""
    best = F.min(F.struct((-F.col("priority").cast("int")).alias("rank"), "filename", "priority"))
    grouped = voices.dropna(subset=["lang"]).groupBy("lang").agg(best.alias("best"))
    return grouped.select("lang", "best.filename", "best.priority")


def first_seen(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(name, order): distinct names with the place where each was first seen."""
    return rows.groupBy(name).agg(F.min(order).alias(order))


def choose_voice(voices: DataFrame, voice: str | None = None, language: str | None = None, detect=None) -> str:
    """A named voice as it is; else the default of the named language; else of the one that `detect()` returns."""
    if voice is not None:
        return voice
    language = language if language is not None else detect()
    found = default_voices(voices.where(F.col("lang") == language)).select("filename").first()
    if found is None:
        raise NoVoiceForLanguage(language)
    return found[0]


def catalogue_width(voices: DataFrame) -> DataFrame:
    """(width): the longest filename in bytes, at least 8."""
    longest = F.coalesce(F.max(F.octet_length("filename")), F.lit(0))
    return voices.agg(F.greatest(F.lit(8), longest).cast("bigint").alias("width"))


def catalogue_report(voices: DataFrame) -> DataFrame:
    """(lang, line): for each language its lines in order, filename and priority right-aligned to the common width."""
    width = catalogue_width(voices)
    rows = voices_by_language(voices).crossJoin(F.broadcast(width))  # one row
    cell = lambda text: F.concat(F.repeat(F.lit(" "), (F.col("width") - F.octet_length(text)).cast("int")), text)
    line = F.transform("voices", lambda v: F.concat(cell(v["filename"]), F.lit(" "), cell(v["priority"].cast("string"))))
    return rows.select("lang", F.posexplode(line).alias("nth", "line"))
