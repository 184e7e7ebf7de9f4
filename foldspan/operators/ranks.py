"""Exact places of rows in an order, where no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.sources.scratch import stored

#: A sequence number counts the rows of a partition in its low bits; the partition's number stands above them.
_LOW_BITS = 33


def placed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows, a scan or a stored table, with pos, the place in the group from 0, and total, the rows of the group.

    Rows are dealt and sorted by range, and equal ones by their place in the input, so that neither a large group nor a
    frequent value meets in one task. What is brought together is one count for each group and partition. Group columns
    must not be null.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*groups, *order, "_tie").sortWithinPartitions(*groups, *order, "_tie").drop("_tie")
    sequence = stored(dealt.withColumn("_seq", F.monotonically_increasing_id()), "sequence").withColumn("_part", F.shiftright("_seq", _LOW_BITS))
    counts = sequence.groupBy(*groups, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*groups)
    starts = counts.select(*groups, "_part", (F.sum("_n").over(group.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total"))
    return sequence.join(stored(starts, "starts"), [*groups, "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift")
