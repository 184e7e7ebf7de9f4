"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.llm.common import written

#: Bits of a sequence number that count the rows of one partition; the partition's number stands above them.
_ROW_BITS = 33


def in_sequence(rows: DataFrame, *order: str) -> DataFrame:
    """rows, sorted by range and written, with a number _seq that rises in that order. rows must be a scan or a written table,
    so that a task that runs again numbers its rows alike. Rows equal in all of order are dealt by their place in the input,
    so that many of them still spread over tasks. Null values come first."""
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return written(dealt.withColumn("_seq", F.monotonically_increasing_id()), "sequence")


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos, a row's place in its group from 0, and total, the group's rows. A group of any size spreads over tasks:
    only counts of a group in a partition meet. group must not be null; rows as for in_sequence."""
    part = F.shiftright("_seq", _ROW_BITS).alias("_part")
    sequence = in_sequence(rows, group, *order).withColumn("_part", part)
    counts = sequence.groupBy(group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    starts = written(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total")), "starts")
    return sequence.join(starts, [group, "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift")
