"""Row-wise operators over unbounded input: dictionary creation, lookups against a fixed dictionary, counted homophones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.functions.phonetics import normalize
from echolex.operators.phonemise import Phonemizer
from echolex.functions.text import trim


def created(entries: DataFrame, phonemizer: Phonemizer, entry_col: str = "entry") -> DataFrame:
    """A stream of entries as a stream of dictionary rows; stateless."""
    words = entries.withColumn("word", trim(entry_col)).where(F.length("word") > 0)
    return words.withColumn("phonemes", phonemizer(F.col("word"))).where(F.length("phonemes") > 0)


def matched(stream: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each streamed row with the dictionary's rows of equal sound (broad classes), as a stream-static join; rows that
    agree in word don't match."""
    known = dictionary.select(F.col("word").alias("match_word"), normalize("phonemes").alias("sound"))
    rows = stream.withColumn("sound", normalize("phonemes"))
    return rows.join(known, "sound").where(F.col("word") != F.col("match_word"))


def homophone_counts(stream: DataFrame, time_col: str = "added_at", delay: str = "60 days", window: str = "30 days") -> DataFrame:
    """(start, phonemes, n): rows of each pronunciation in windows of event time; state is dropped behind the watermark."""
    rows = stream.select("phonemes", F.col(time_col).cast("timestamp").alias(time_col)).dropna()
    timed = rows.withWatermark(time_col, delay)
    counts = timed.groupBy(F.window(time_col, window).alias("w"), "phonemes").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "phonemes", "n")
