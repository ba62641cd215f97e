"""Places of rows in an order, without a window over all of them.

Rows are put into ranges of the order by one exchange and written down together with the number of their range. Ranks
and neighbours are found within a range; between ranges only a row or a count for each of them is passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.session import Scratch

PART = "__part"


def in_ranges(rows: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """The rows with the number of their range of `order`. They are written: a second plan over a range exchange may
    sample other bounds, so that its numbers would not agree with the first one's."""
    return scratch.cut(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def ranked(rows: DataFrame, scratch: Scratch, order: tuple[str, ...], keys: tuple[str, ...] = (), name: str = "nth") -> DataFrame:
    """The rows with `name`: their dense place from 0 in `order`, within equal `keys` (nulls are equal).

    A key that holds most of the rows lies in many ranges and is ranked by as many tasks. Rows that agree in keys and
    order get places in no fixed order."""
    cut = in_ranges(rows, scratch, *keys, *order)
    sizes = cut.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(PART).alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) - 1
    met = F.col(PART) == F.col("__p")
    for i, key in enumerate(keys):
        met = met & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    placed = cut.withColumn("__within", within).join(offsets, met)
    return placed.select(*rows.columns, (F.col("__within") + F.col("__offset")).cast("bigint").alias(name))
