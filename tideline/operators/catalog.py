"""Symbol dimension: as-of lookup of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import micros

#: Dimension rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def resolve(df: DataFrame, versions: DataFrame, key: str = "market_id", ts: str = "timestamp_ns", order: str = "seq") -> DataFrame:
    """df with the version valid at its time (from <= t < until, microseconds); of overlapping ones the last in order of
    (valid_from_ts, load_ord). Rows without one get nulls. Versions are cut into disjoint ranges first, so each row
    meets at most one of them and no window over df is needed."""
    # the boundaries of each key's versions; a range between two of them has one best version, or none
    v = versions
    cuts = v.select(key, F.col("valid_from_ts").alias("at")).unionByName(v.select(key, F.col("valid_until_ts").alias("at"))).distinct()
    ranges = cuts.withColumn("to", F.lead("at").over(Window.partitionBy(key).orderBy("at"))).where("to is not null")
    best = ranges.join(v, key).where("valid_from_ts <= at and at < valid_until_ts")
    one = best.groupBy(key, "at", "to").agg(F.max_by("symbol_id", F.struct("valid_from_ts", "load_ord")).alias("symbol_id"))
    one = one.select(F.col(key).alias("_k"), F.col("at").alias("_a"), F.col("to").alias("_z"), "symbol_id")
    t = micros(F.col(ts))
    side = F.broadcast(one) if one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else one
    return df.join(side, (F.col(key) == F.col("_k")) & (t >= F.col("_a")) & (t < F.col("_z")), "left").drop("_k", "_a", "_z")


def resolve_all(df: DataFrame, versions: DataFrame, **kw) -> DataFrame:
    """As resolve, but a row without a version raises."""
    out = resolve(df, versions, **kw)
    return out.withColumn("symbol_id", F.when(F.col("symbol_id").isNull(), F.raise_error(F.lit("no symbol version")).cast("long")).otherwise(F.col("symbol_id")))
