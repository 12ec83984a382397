"""Ordered merges of partitions and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import filters


def merge_key(df: DataFrame, part: str | None, order: str = "seq", ts: str = "timestamp_ns") -> DataFrame:
    """Adds merge_ts, the running maximum of the timestamp in each partition: sorting by (merge_ts, partition, order)
    equals a heap merge that keeps each partition's own order, also where timestamps step back. part None: df is one
    partition, however long, and is taken in ranges."""
    if part is None:
        made = filters.carried(df, F.col(ts), "max", "_before", order)
        return made.withColumn("merge_ts", F.greatest("_before", ts)).drop("_before")
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("merge_ts", F.max(ts).over(w))


def merge_ordered(df: DataFrame, part: str, order: str = "seq", ts: str = "timestamp_ns") -> DataFrame:
    return merge_key(df, part, order, ts).orderBy("merge_ts", part, order)


def merge_sequential(df: DataFrame, part: str, order: str = "seq") -> DataFrame:
    return df.orderBy(F.col(part).cast("string"), order)


def fan_in(sources: list[DataFrame], order: str = "seq", ts: str = "timestamp_ns", committed: dict[int, int] | None = None, ranges: bool = False) -> DataFrame:
    """Sources by their index; ties go to the lower one. committed: by source the position up to which its rows are done, and left
    out. ranges: each source is a long log, and is taken in ranges rather than by one task."""
    if not sources:
        raise ValueError("no sources")
    left = [s.where(F.col(order) > committed[i]) if committed and i in committed else s for i, s in enumerate(sources)]
    tagged = [s.withColumn("source", F.lit(i)) for i, s in enumerate(left)]
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    if ranges:
        return union([merge_key(s, None, order, ts) for s in tagged]).orderBy("merge_ts", "source", order)
    return merge_ordered(union(tagged), "source", order, ts)


def pending(sources: list[DataFrame], committed: dict[int, int], order: str = "seq") -> DataFrame:
    """(source, pending): rows after each source's committed position."""
    counts = [s.where(F.col(order) > committed.get(i, -1)).agg(F.count(F.lit(1)).alias("pending")).select(F.lit(i).alias("source"), "pending") for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), counts)


def rolls(df: DataFrame, part: str, stream: str | None = None, order: str = "seq") -> DataFrame:
    """df with prev_part, the partition of the row before (null for the first). Where the two differ the writer rolls: what
    a roll callback would be given."""
    if stream is None:
        return filters.carried(df, F.col(part), "last", "prev_part", order)
    return df.withColumn("prev_part", F.lag(part).over(Window.partitionBy(stream).orderBy(order)))


def rolling_stats(df: DataFrame, part: str, stream: str | None = None, order: str = "seq") -> DataFrame:
    """messages_written, partition_rolls (changes of partition along the order) and partitions_written (rolls + 1)."""
    changed = rolls(df, part, stream, order).withColumn("_c", F.coalesce((F.col(part) != F.col("prev_part")).cast("long"), F.lit(0)))
    grouped = changed.groupBy(stream) if stream else changed.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("messages_written"), F.sum("_c").alias("partition_rolls"), (F.sum("_c") + 1).alias("partitions_written"))
