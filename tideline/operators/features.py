"""Features over book states, triggers, and extraction. An undefined feature is 0.0, not null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import bucket, scaled
from tideline.operators.book_l2 import replay

# A trigger is a function (window spec, eligible) -> Column: whether a row emits, given which rows reach the trigger.
Trigger = Callable[..., Column]


def mid_price(scale: int = 2) -> Column:
    bid, ask = scaled(F.col("best_bid"), F.lit(scale)), scaled(F.col("best_ask"), F.lit(scale))
    return F.coalesce((bid + ask) * 0.5, F.lit(0.0)).alias("mid_price")


def spread_bps(scale: int = 2) -> Column:
    bid, ask = scaled(F.col("best_bid"), F.lit(scale)), scaled(F.col("best_ask"), F.lit(scale))
    mid = (bid + ask) * 0.5
    return F.coalesce(F.when(mid != 0, (ask - bid) / mid * 10000.0), F.lit(0.0)).alias("spread_bps")


def imbalance(depth: int = 5) -> Column:
    """Over at most the levels that the states hold: replay(depth=...), or FeatureGraph(depth=...), has to be as deep."""
    total = lambda c: F.aggregate(F.slice(c, 1, max(1, depth)), F.lit(0).cast("long"), lambda s, x: s + x)
    bids, asks = total("bid_sizes"), total("ask_sizes")
    return F.coalesce(F.when(bids + asks != 0, (bids - asks) / (bids + asks).cast("double")), F.lit(0.0)).alias("imbalance")


def features(states: DataFrame, *columns: Column, keep: tuple[str, ...] = ("market_id", "seq", "timestamp_ns")) -> DataFrame:
    if not columns:
        raise ValueError("no features")
    return states.select(*keep, *columns)


class FeatureGraph:
    """Named features over book states, their schema, and the place where each one's columns begin."""

    KINDS = ("double", "bigint", "boolean")

    def __init__(self, *groups: list[Column], keep: tuple[str, ...] = ("market_id", "seq", "timestamp_ns"), depth: int = 5):
        if not groups or not all(groups):
            raise ValueError("no features")
        self.groups, self.keep, self.depth = groups, keep, depth

    @property
    def offsets(self) -> list[int]:
        return [sum(map(len, self.groups[:i])) for i in range(len(self.groups))]

    def over(self, states: DataFrame) -> DataFrame:
        out = features(states, *[c for g in self.groups for c in g], keep=self.keep)
        odd = [f.name for f in out.schema.fields[len(self.keep) :] if f.dataType.simpleString() not in self.KINDS]
        if odd:
            raise ValueError(f"features of another kind than {', '.join(self.KINDS)}: {odd}")
        return out

    def extract(self, levels: DataFrame, *triggers: Trigger, stream: str = "market_id") -> DataFrame:
        """Events to rows: the book is folded over every event, to this graph's depth; the triggers choose rows afterwards."""
        states = replay(levels, self.depth)
        return self.over(emitted(states, stream, *triggers) if triggers else states)


# ---------------------------------------------------------------- triggers


def always() -> Trigger:
    return lambda w, eligible: eligible


def event_type(kind: int, column: str = "ev") -> Trigger:
    return lambda w, eligible: eligible & (F.col(column) == kind)


def time_bar(interval_ns: int, column: str = "timestamp_ns") -> Trigger:
    """The first row of each new bucket. Timestamp 0 never emits; late rows don't open old buckets again."""

    def run(w, eligible: Column) -> Column:
        b = F.when(eligible & (F.col(column) != 0), bucket(F.col(column), interval_ns))
        seen = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(b > seen, b.isNotNull())

    return run


def emitted(df: DataFrame, stream: str, *triggers: Trigger, order: str = "seq") -> DataFrame:
    """Rows that any trigger emits, tried in order: a later one doesn't see the rows that an earlier one took."""
    w = Window.partitionBy(stream).orderBy(order)
    fired: list[str] = []
    for i, t in enumerate(triggers):
        eligible = F.lit(True)
        for f in fired:
            eligible = eligible & ~F.col(f)
        df = df.withColumn(f"_t{i}", t(w, eligible))
        fired.append(f"_t{i}")
    any_ = F.lit(False)
    for f in fired:
        any_ = any_ | F.col(f)
    return df.where(any_).drop(*fired)
