"""Edit-distance joins on pronunciations.

A join condition `levenshtein(a, b, d) >= 0` alone makes a nested loop over all pairs. Here every pair within distance
d shares at least one key, so candidates come from an equi-join and are verified:

* `deletions`: all strings left after up to d deletions (Bocek et al. 2007). One edit costs each side at most one
  deletion, so both reach a common string. The number of keys grows with length ** d: for d of 1 and 2.
* `segments`: a string is cut into d + 1 segments; d edits leave one untouched (Li et al. 2011), which the other
  string holds at a place shifted by d at most. For long strings, whose segments are rare.
* `mixed`: a pair of which one string is short by deletions, any other by segments. A short string's partner has at
  most d more code points, so deletions of strings up to that length are enough.

Joins run on distinct pronunciations; rows that share one are attached afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.functions.phonetics import similar


#: Strings up to this length count as short, whatever the distance.
SHORT = 12


def _deletions(key: Column, distance: int) -> Column:
    """All different strings left after up to `distance` deletions of one code point, the string itself included."""
    out = F.array(key)
    for _ in range(distance):
        one_less = F.flatten(
            F.transform(
                out,
                lambda s: F.when(F.length(s) == 0, F.array(s)).otherwise(
                    F.transform(
                        F.sequence(F.lit(1), F.length(s)),
                        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
                    )
                ),
            )
        )
        out = F.array_distinct(F.concat(out, one_less))
    return out


def _by_deletions(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    # probes travel as 64-bit hashes: a collision is one more candidate, which the verification drops
    probes = F.explode(F.array_distinct(F.transform(_deletions(F.col("key"), distance), lambda s: F.xxhash64(s))))
    a = left.select(F.col("key").alias("a"), probes.alias("probe"))
    b = right.select(F.col("key").alias("b"), probes.alias("probe"))
    close = F.abs(F.length("a") - F.length("b")) <= distance
    return a.join(b, "probe").where(close & similar("a", "b", distance)).select("a", "b").distinct()


def _by_segments(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Left strings are cut by their own length; a right string offers, for each left length within `distance` of its
    own, its substrings at the segments' places, shifted by as much as edits before and behind the segment allow."""
    parts = distance + 1

    def bounds(length: Column, i: Column) -> tuple[Column, Column]:
        return F.floor(length * i / parts).cast("int"), F.floor(length * (i + 1) / parts).cast("int")

    def cut(length: Column, i: Column, key: Column) -> Column:
        start, end = bounds(length, i)
        return F.struct(length.alias("n"), i.alias("i"), F.substring(key, start + 1, end - start).alias("piece"))

    number = F.sequence(F.lit(0), F.lit(distance))
    a = left.select(
        F.col("key").alias("a"),
        F.explode(F.transform(number, lambda i: cut(F.length("key"), i, F.col("key")))).alias("probe"),
    )

    def offered(n: Column) -> Column:
        def shifted(i: Column) -> Column:
            start, end = bounds(n, i)
            # i segments before it and distance - i behind it: one of them is untouched, if it isn't this one, unless
            # the edits on both sides are as few as the segments there
            longer = F.length("key") - n
            low = F.greatest(start + F.greatest(-i, longer - (distance - i)), F.lit(0))
            high = F.least(start + F.least(i, longer + (distance - i)), F.length("key") - (end - start))
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(
                places,
                lambda p: F.struct(n.alias("n"), i.alias("i"), F.substring(F.col("key"), p + 1, end - start).alias("piece")),
            )

        return F.flatten(F.transform(number, shifted))

    lengths = F.sequence(F.greatest(F.length("key") - distance, F.lit(0)), F.length("key") + distance)
    b = right.select(
        F.col("key").alias("b"), F.explode(F.array_distinct(F.flatten(F.transform(lengths, offered)))).alias("probe")
    )
    return a.join(b, "probe").where(similar("a", "b", distance)).select("a", "b").distinct()


def _by_length(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """All pairs of nearby lengths: nearly quadratic, to hold the others against on small inputs."""
    a = left.select(F.col("key").alias("a"), F.length("key").alias("n"))
    reach = F.sequence(F.length("key") - distance, F.length("key") + distance)
    b = right.select(F.col("key").alias("b"), F.explode(reach).alias("n"))
    return a.join(b, "n").where(similar("a", "b", distance)).select("a", "b")


def _mixed(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    short = min(4 * (distance + 1), SHORT)
    near = [d.where(F.length("key") <= short + distance) for d in (left, right)]
    far = [d.where(F.length("key") > short) for d in (left, right)]
    return _by_deletions(*near, distance).unionByName(_by_segments(*far, distance)).distinct()


STRATEGIES = {"mixed": _mixed, "deletions": _by_deletions, "segments": _by_segments, "length": _by_length}


def similar_keys(left: DataFrame, right: DataFrame, distance: int, strategy: str | None = None) -> DataFrame:
    """(a, b): all pairs of distinct pronunciations of two dictionaries within the distance."""
    if distance < 0:
        raise ValueError("distance must not be negative")
    keys = [d.select(F.col("phonemes").alias("key")).dropna().distinct() for d in (left, right)]
    return STRATEGIES[strategy or ("deletions" if distance <= 1 else "mixed")](*keys, distance)


def _numbered(dictionary: DataFrame) -> DataFrame:
    """With an `ord` of its rows, if it has none; unique, not dense."""
    if "ord" not in dictionary.columns:
        dictionary = dictionary.withColumn("ord", F.monotonically_increasing_id())
    return dictionary.select("ord", "word", "phonemes").dropna(subset=["word", "phonemes"])


def similar_pairs(
    left: DataFrame, right: DataFrame | None = None, distance: int = 1, strategy: str | None = None
) -> DataFrame:
    """(ord, word, phonemes, match_ord, match_word, match_phonemes, distance): every row of `left` with every row of
    `right` (or of `left`) whose pronunciation is within the distance.

    Rows that agree in word and pronunciation don't match each other, whichever rows they are. Repeated rows match as
    often as they stand there. Rows with a null word or pronunciation match nothing; empty pronunciations do.
    """
    x, y = _numbered(left), _numbered(left if right is None else right)
    close = similar_keys(x, y, distance, strategy).withColumn("distance", F.levenshtein("a", "b"))
    heads = x.join(close, x["phonemes"] == close["a"]).select("ord", "word", "phonemes", "b", "distance")
    matches = y.select(
        F.col("ord").alias("match_ord"), F.col("word").alias("match_word"), F.col("phonemes").alias("match_phonemes")
    )
    other = (F.col("word") != F.col("match_word")) | (F.col("phonemes") != F.col("match_phonemes"))
    return heads.join(matches, heads["b"] == matches["match_phonemes"]).where(other).select(
        "ord", "word", "phonemes", "match_ord", "match_word", "match_phonemes", "distance"
    )


def similar_lists(pairs: DataFrame) -> DataFrame:
    """(ord, word, matches): for each head with at least one match, the matching words in the order of their rows,
    repeats kept."""
    held = F.array_sort(F.collect_list(F.struct(F.col("match_ord").alias("at"), F.col("match_word").alias("word"))))
    lists = pairs.groupBy("ord", "word").agg(held.alias("held"))
    return lists.select("ord", "word", F.col("held.word").alias("matches"))


def lookup(dictionary: DataFrame, phonemes: str, distance: int = 0) -> DataFrame:
    """The rows of a dictionary within the distance of one pronunciation, which a filter on the scan finds."""
    return dictionary.where(similar("phonemes", F.lit(phonemes), distance))


def search(queries: DataFrame, dictionary: DataFrame, distance: int = 1, strategy: str | None = None) -> DataFrame:
    """(ord, match_ord, distance): `lookup` for the pronunciation of every row of `queries` at once, by the join on keys;
    a row of both tables finds itself. Null pronunciations find nothing."""
    close = similar_keys(queries, dictionary, distance, strategy).withColumn("distance", F.levenshtein("a", "b"))
    heads = queries.select("ord", F.col("phonemes").alias("a")).join(close, "a").select("ord", "b", "distance")
    return heads.join(dictionary.select(F.col("ord").alias("match_ord"), F.col("phonemes").alias("b")), "b").select("ord", "match_ord", "distance")
