"""L2 order books: the sequential fold, and the relational form of a book at one point.

Level rows: (market_id, seq, ev, side, price, size), ev 1 = snapshot (clears the market's book first), 2 = diff; size 0
deletes, other sizes replace. The rows of one seq are the levels of one event: it clears once, then its levels apply in the
order of ``level_ord`` (0 where there is no such column), the later of two equal prices wins. Books are keyed by market;
one market's fold is one task, as a book has no parallelism inside.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "market_id long, seq long, timestamp_ns long, ev int, best_bid long, best_ask long, bid_levels int, ask_levels int, bid_sizes array<long>, ask_sizes array<long>, bid_prices array<long>, ask_prices array<long>"
#: With skipped events too: why, in the words of filters.event_status; null for an applied one.
STATUS = STATE + ", skipped string"


class Side:
    """The live levels of one side: sizes by price, and the prices in order."""

    def __init__(self) -> None:
        self.size: dict[int, int] = {}
        self.prices: list[int] = []

    def put(self, price: int, size: int) -> None:
        if size:
            if price not in self.size:
                insort(self.prices, price)
            self.size[price] = size
        elif self.size.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]


class Book:
    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.bids, self.asks = Side(), Side()

    def put(self, side: str, price: int, size: int) -> None:
        (self.bids if side == "B" else self.asks).put(price, size)

    def state(self, depth: int | None) -> tuple:
        bids, asks = self.bids.prices[::-1] if depth is None else self.bids.prices[: -depth - 1 : -1], self.asks.prices[:depth]
        sizes = [self.bids.size[p] for p in bids], [self.asks.size[p] for p in asks]
        return (bids[0] if bids else None, asks[0] if asks else None, len(self.bids.prices), len(self.asks.prices), *sizes, bids, asks)


def ordered(levels: DataFrame) -> DataFrame:
    """levels with a level_ord."""
    return levels if "level_ord" in levels.columns else levels.withColumn("level_ord", F.lit(0))


def book_at(levels: DataFrame, until: int | None = None, key: str = "market_id") -> DataFrame:
    """(key, side, price, size) of the live levels after the events up to ``until``. Two aggregations and no sort."""
    rows = ordered(levels).where("ev in (1, 2)")
    if until is not None:
        rows = rows.where(F.col("seq") <= until)
    since = rows.where("ev = 1").groupBy(key).agg(F.max("seq").alias("_since"))
    live = rows.join(since, key, "left").where("_since is null or seq >= _since")
    last = live.groupBy(key, "side", "price").agg(F.max_by("size", F.struct("seq", "level_ord")).alias("size"))
    return last.where("size <> 0")


def top_levels(book: DataFrame, n: int, key: str = "market_id") -> DataFrame:
    """The best n levels of each side with their rank."""
    best = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    return book.withColumn("level", F.row_number().over(Window.partitionBy(key, "side").orderBy(best))).where(F.col("level") <= max(1, n))


def replay(levels: DataFrame, depth: int | None = 5, key: str | None = "market_id", require_snapshot: bool = False, gap_policy: str = "ignore", statuses: bool = False) -> DataFrame:
    """The book after each event: one row of STATE for each (market, seq). key None: one book for the whole stream.

    The rows of a market arrive in order and are folded as they stream by; the state is the live levels alone. An event is
    skipped if ``skipped`` (a column of levels, see filters.event_status) names a reason, if its ev is neither 1 nor 2, or if
    its seq is not one more than the market's last one: gap_policy quarantine skips that event alone, panic raises, ignore
    applies it. With ``statuses``, skipped events have a row too (STATUS), with the book as it is. depth: levels of each side
    in a state (None: all). A boolean column ``due`` of levels limits the states to the events that it marks.
    """
    if gap_policy not in ("ignore", "quarantine", "panic"):
        raise ValueError(gap_policy)
    depth = None if depth is None else max(1, depth)
    schema = STATUS if statuses else STATE
    names = [x.split()[0] for x in schema.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, event, ready, why, wanted = Book(), None, False, None, True
        out: list[tuple] = []

        def close() -> None:
            if event is not None and wanted and (why is None or statuses) and (ready or not require_snapshot):
                out.append((*event, *book.state(depth), why) if statuses else (*event, *book.state(depth)))

        def packed() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"best_bid": "Int64", "best_ask": "Int64"})

        for b in batches:
            for m, seq, ts, ev, side, price, size, skipped, due in zip(*(b[c].tolist() for c in b.columns), strict=True):
                if event is None or (m, seq) != event[:2]:
                    close()
                    gap = event is not None and m == event[0] and seq != event[1] + 1
                    if event is None or m != event[0]:
                        book, ready = Book(), False
                    if gap and gap_policy == "panic":
                        raise ValueError(f"sequence gap: {event[1]} to {seq}, missing {max(seq - event[1] - 1, 0)}")
                    event, why, wanted = (m, seq, ts, ev), skipped, due
                    if gap and gap_policy == "quarantine":
                        why = "Gap"
                    elif why is None and ev not in (1, 2):
                        why = "UnsupportedEvent"
                    if why is None and ev == 1:
                        book.clear()
                        ready = True
                if why is None and price is not None and price == price and (ready or not require_snapshot):
                    book.put(side, int(price), int(size))
            yield packed()
            out.clear()
        close()
        yield packed()

    rows = ordered(levels)
    skipped = F.col("skipped").cast("string") if "skipped" in levels.columns else F.lit(None).cast("string")
    if gap_policy == "ignore" and not statuses:
        rows = rows.where("ev in (1, 2)")
    rows = rows.select((F.col(key) if key else F.lit(0)).cast("long").alias("market_id"), "seq", "timestamp_ns", F.col("ev").cast("int").alias("ev"), "side", "price", "size", skipped.alias("skipped"), F.coalesce(F.col("due"), F.lit(False)).alias("due") if "due" in levels.columns else F.lit(True).alias("due"), "level_ord")
    return rows.repartition("market_id").sortWithinPartitions("market_id", "seq", "level_ord").drop("level_ord").mapInPandas(fold, schema)


def reaches(levels: DataFrame, snapshots: DataFrame, market: int, target: int, column: str = "timestamp_ns") -> bool:
    """Whether a warm start gets to the target: there is a snapshot before it, and an event of any kind after that one which reaches it."""
    head = snapshots.where((F.col("market_id") == market) & (F.col(column) <= target)).agg(F.max("seq")).first()[0]
    return head is not None and bool(levels.where((F.col("market_id") == market) & (F.col("seq") > head) & (F.col(column) >= target)).limit(1).count())


def warm_start(levels: DataFrame, snapshots: DataFrame, market: int, target: int | None = None, column: str = "timestamp_ns") -> DataFrame:
    """The book from the latest snapshot of a market (at most the target) and the later events, through the first one that reaches the target.

    snapshots(market_id, seq, timestamp_ns, side, price, size). Without a snapshot there is no row.
    """
    own = snapshots.where(F.col("market_id") == market)
    if target is not None:
        own = own.where(F.col(column) <= target)
    head = own.agg(F.max("seq").alias("_at"))
    start = ordered(own.join(F.broadcast(head), F.col("seq") == F.col("_at"))).select("market_id", "seq", F.lit(1).alias("ev"), "side", "price", "size", "level_ord")
    rows = levels.where((F.col("market_id") == market) & F.col("ev").isin(1, 2)).join(F.broadcast(head), F.col("seq") > F.col("_at"))
    if target is not None:
        stop = rows.where(F.col(column) >= target).agg(F.min("seq").alias("_stop"))
        rows = rows.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop")))
    return book_at(start.unionByName(ordered(rows).select("market_id", "seq", F.col("ev").cast("int").alias("ev"), "side", "price", "size", "level_ord")))
