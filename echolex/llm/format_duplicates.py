"""Records that differ only in how they are written.

Method: progressive partition refinement. All records are first split by cheap invariants of their class: the fields
that must be equal as stored and the stripped length of the written one. Only members of classes with several records
get the next, costlier key, the letter histogram (the sorted letters), and only those that still have company get the
exact key: the lower-case parts in sorted order. Each refinement counts with partial aggregates and keeps members by
a semi-join, so a class of any size is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.session import Scratch

#: What separates the parts of a word: everything but letters and digits.
BETWEEN_PARTS = r"[^\p{L}\p{N}]+"


def parts(word: Column) -> Column:
    """The longest runs of letters and digits, each in lower case, sorted. Lower case is that of the Unicode default
    algorithm: a capital sigma at the end of a part becomes the final small sigma, a dotted capital I an i and a dot."""
    return F.array_sort(F.transform(F.filter(F.split(word, BETWEEN_PARTS), lambda x: x != F.lit("")), F.lower))


def _with_company(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` occurs more than once. Keys are hashes; a collision only keeps a row for the next level."""
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return rows.join(several, key, "left_semi")


def copies(
    records: DataFrame,
    id_col: str = "ord",
    text_col: str = "word",
    equal_cols: tuple[str, ...] = ("lang", "phonemes"),
) -> DataFrame:
    """(id, class_id, copies): every record that has at least one copy, with the smallest id of its class and the
    class's size.

    Copies have equal, non-null `equal_cols` and the same parts, each equally often, in any order. A null text, one
    without parts or a null in `equal_cols` is no case. Ids are unique and not null. An empty table gives no rows.
    """
    scratch = Scratch(records.sparkSession, "copies")
    equal = [f"e{i}" for i in range(len(equal_cols))]
    rows = records.select(
        records[id_col].alias("id"),
        records[text_col].alias("text"),
        *[records[c].alias(e) for c, e in zip(equal_cols, equal)],
    ).dropna(subset=["text", *equal])
    stripped = F.regexp_replace("text", BETWEEN_PARTS, "")
    level1 = rows.withColumn("k1", F.xxhash64(*equal, F.length(stripped))).where(F.length(stripped) > 0)
    level2 = _with_company(level1, "k1").select(
        "id",
        "text",
        *equal,
        F.xxhash64("k1", F.array_join(F.array_sort(F.split(F.array_join(parts(F.col("text")), ""), "")), "")).alias("k2"),
    )
    level2 = scratch.cut(level2)
    level3 = _with_company(level2, "k2").select("id", *equal, F.array_join(parts(F.col("text")), " ").alias("written"))
    level3 = scratch.cut(level3)
    key = [*equal, "written"]
    classes = level3.groupBy(*key).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return level3.join(classes, key).select("id", "class_id", "copies")


def collapse(
    records: DataFrame,
    id_col: str = "ord",
    text_col: str = "word",
    equal_cols: tuple[str, ...] = ("lang", "phonemes"),
) -> DataFrame:
    """The records with every class reduced to its first member (smallest id), and `n_copies`: how many records it
    stands for, at least 1. Records that are no case stand for themselves."""
    found = copies(records, id_col, text_col, equal_cols).select(F.col("id").alias(id_col), "class_id", "copies")
    joined = records.join(found, id_col, "left")
    first = F.col("class_id").isNull() | (F.col("class_id") == F.col(id_col))
    return joined.where(first).select(*[joined[c] for c in records.columns], F.coalesce("copies", F.lit(1)).alias("n_copies"))
