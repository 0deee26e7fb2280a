"""Global sort by sampled range partitions, with a global position if wanted."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.storage import stage

#: Partitions whose offsets are broadcast; beyond, they are joined.
MAX_BROADCAST = 100_000


def range_sorted(df: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of sampled keys and sorted in each partition; partitions follow one another in order."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def with_position(df: DataFrame, *keys: str | Column, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Adds the rank of each row from 0: its place in its partition after the rows of the partitions before."""
    placed = range_sorted(df, *keys, partitions=partitions).withColumn("__part", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stage(placed, "sorted")
    counts = rows.groupBy("__part").count().orderBy("__part").collect()  # a number a partition
    starts = list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    firsts = df.sparkSession.createDataFrame(starts, "__part int, __first long")
    firsts = F.broadcast(firsts) if len(starts) <= MAX_BROADCAST else firsts
    return rows.join(firsts, "__part").withColumn(name, F.col(name) + F.col("__first")).drop("__part", "__first")
