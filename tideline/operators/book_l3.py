"""L3 books, order by order: keyed folds over events in order.

What happens to an order depends on its own events alone, and what happens to a level on the changes that orders make to it. So final
books take two folds, by order and by level, each with a state of fixed size; no task holds a market's book.

Events: market_id, ord, event_type (1 add, 2 cancel, 3 modify, 4 trade, 5 reset, 6 heartbeat), side (1 buy, 2 sell), flags,
order_id, bid_order_id, ask_order_id, price, qty. A partial reduction takes the order out of its level's queue, though the
level's total stays right; strict_fifo keeps it in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import filters

MARKET_FLAG = 1
OUT = "market_id long, kind string, order_id long, side int, price long, qty long, queue_len int"


class Book:
    def __init__(self, unknown: str = "skip", strict_fifo: bool = False):
        self.unknown, self.strict = unknown, strict_fifo
        self.orders: dict[int, list[int]] = {}  # side, price, qty, flags
        self.levels: dict[tuple[int, int], list] = {}  # (side, price): total, queue (orders in their order, and how often each stands in it)

    def apply(self, kind, side, flags, order_id, bid, ask, price, qty) -> None:
        if kind == 1:
            self._add(order_id, side, price, qty, flags)
        elif kind == 2:
            if order_id:
                self._reduce(order_id, qty, "cancel")
        elif kind == 3:
            if order_id:
                self._modify(order_id, price, qty, flags)
        elif kind == 4:
            for one in [x for x in (bid, ask) if x] or ([order_id] if order_id else []):
                self._reduce(one, qty, "trade")
        elif kind == 5:
            self.orders.clear()
            self.levels.clear()
        elif kind != 6:
            raise ValueError(f"unknown L3 event {kind}")

    def _known(self, order_id: int, what: str) -> bool:
        if order_id not in self.orders and self.unknown == "fail":
            raise ValueError(f"{what} of unknown order {order_id}")
        return order_id in self.orders

    def _enter(self, side: int, price: int, order_id: int, qty: int) -> None:
        if side in (1, 2):
            level = self.levels.setdefault((side, price), [0, {}])
            level[0] += qty
            level[1][order_id] = level[1].get(order_id, 0) + 1

    def _leave(self, side: int, price: int, order_id: int, qty: int, gone: bool) -> None:
        level = self.levels.get((side, price))
        if level is not None:
            level[0] = max(0, level[0] - qty)
            if gone or not self.strict:
                level[1].pop(order_id, None)
            if level[0] == 0:
                del self.levels[side, price]

    def _add(self, order_id, side, price, qty, flags) -> None:
        if not order_id:
            raise ValueError("order add without an id")
        side = side if side in (1, 2) else 0
        self.orders[order_id] = [side, price, qty, flags]
        if not flags & MARKET_FLAG and price:
            self._enter(side, price, order_id, qty)

    def _reduce(self, order_id, qty, what) -> None:
        if self._known(order_id, what):
            side, price, left, _ = self.orders[order_id]
            taken = min(qty, left) if qty else left
            self.orders[order_id][2] = left - taken
            self._leave(side, price, order_id, taken, left == taken)
            if left == taken:
                del self.orders[order_id]

    def _modify(self, order_id, price, qty, flags) -> None:
        if not self._known(order_id, "modify"):
            return
        order = self.orders[order_id]
        side, old_price, old_qty, _ = order
        order[1], order[2] = price or old_price, qty or old_qty
        if flags & MARKET_FLAG or not order[1]:
            if old_qty:
                self._leave(side, old_price, order_id, old_qty, True)
        elif order[1] != old_price:
            self._leave(side, old_price, order_id, old_qty, True)
            self._enter(side, order[1], order_id, order[2])
        elif order[2] != old_qty and side in (1, 2):
            self._adjust(side, old_price, order[2] - old_qty)

    def _adjust(self, side: int, price: int, change: int) -> None:
        level = self.levels.setdefault((side, price), [0, {}])
        level[0] = max(0, level[0] + change)

    def rows(self, market: int) -> list[tuple]:
        return [(market, "order", k, o[0], o[1], o[2], 0) for k, o in self.orders.items()] + [(market, "level", None, s, p, v[0], sum(v[1].values())) for (s, p), v in self.levels.items()]


    def best(self) -> tuple[int | None, int | None]:
        """The best prices of the levels."""
        return max((p for s, p in self.levels if s == 1), default=None), min((p for s, p in self.levels if s == 2), default=None)

    def dump(self) -> str:
        """The whole state as text, for load()."""
        levels = [[*k, v[0], list(v[1].items())] for k, v in self.levels.items()]
        return json.dumps([[[k, *o] for k, o in self.orders.items()], levels])

    def load(self, text: str) -> Book:
        orders, levels = json.loads(text)
        self.orders = {k: o for k, *o in orders}
        self.levels = {(side, price): [total, dict(queue)] for side, price, total, queue in levels}
        return self


ENTER, LEAVE, ADJUST, STAND, ORDER = range(5)
CHANGES = "market_id long, side int, price long, late int, ord long, sub int, what int, order_id long, qty long"
BATCH = 10_000


class _Changes(Book):
    """The book of one order, which notes what the order does to levels instead of keeping them, and where it stands in queues."""

    def __init__(self, unknown: str, strict_fifo: bool):
        super().__init__(unknown, strict_fifo)
        self.at, self.made, self.stands = (0, 0), [], {}

    def _enter(self, side: int, price: int, order_id: int, qty: int) -> None:
        if side in (1, 2):
            self.made.append((side, price, 0, *self.at, ENTER, None, qty))
            self.stands.setdefault((side, price), []).append(self.at)

    def _leave(self, side: int, price: int, order_id: int, qty: int, gone: bool) -> None:
        if side in (1, 2):
            self.made.append((side, price, 0, *self.at, LEAVE, None, qty))
            if gone or not self.strict:
                self.stands.pop((side, price), None)

    def _adjust(self, side: int, price: int, change: int) -> None:
        self.made.append((side, price, 0, *self.at, ADJUST, None, change))

    def end(self) -> None:
        """Notes what is left of the order and its places in queues, which levels take after all changes."""
        self.made += [(side, price, 1, *at, STAND, None, 0) for (side, price), places in self.stands.items() for at in places]
        self.made += [(side, price, 1, 0, 0, ORDER, k, qty) for k, (side, price, qty, _) in self.orders.items()]


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, of[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _by_order(unknown: str, strict_fifo: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book, live, out = None, _Changes(unknown, strict_fifo), True, []

        def close() -> None:
            if live and key is not None:
                book.end()
                out.extend((key[0], *x) for x in book.made)
            for x in (book.made, book.stands, book.orders):
                x.clear()

        for market, epoch, order, at, sub, is_live, kind, side, flags, price, qty in _rows(batches):
            if key != (market, epoch, order):
                close()
                key, live = (market, epoch, order), is_live
            elif len(book.made) >= BATCH:  # an order of many events: its changes needn't wait for its end
                out.extend((market, *x) for x in book.made if live)
                book.made.clear()
            if len(out) >= BATCH:
                yield _batch(out, CHANGES)
                out.clear()
            book.at = at, sub
            book.apply(kind, side, flags, order, 0, 0, price, qty)
        close()
        if out:
            yield _batch(out, CHANGES)

    return fold


def _by_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of each level in their order, and after them the places in its queue: those count that came since it last began."""
    key, total, since, queue, out = None, None, (0, 0), 0, []
    for market, side, price, _, at, sub, what, order, qty in _rows(batches):
        if key != (market, side, price):
            if total is not None:
                out.append((key[0], "level", None, key[1], key[2], total, queue))
            key, total, queue = (market, side, price), None, 0
        if what == ORDER:
            out.append((market, "order", order, side, price, qty, 0))
        elif what == STAND:
            queue += total is not None and (at, sub) >= since
        elif what == LEAVE:
            if total is not None:
                total = max(0, total - qty) or None
        else:
            if total is None:
                total, since = 0, (at, sub)
            total = total + qty if what == ENTER else max(0, total + qty)
        if len(out) >= BATCH:
            yield _batch(out, OUT)
            out = []
    if total is not None:
        out.append((key[0], "level", None, key[1], key[2], total, queue))
    if out:
        yield _batch(out, OUT)


def final_books(events: DataFrame, unknown: str = "skip", strict_fifo: bool = False, gap_policy: str = "ignore") -> DataFrame:
    """OUT: the orders and levels of each market after all of its events. gap_policy panic raises where a market's seq (a further
    column of events) is not one more than the one before; other policies apply every event."""
    if gap_policy == "panic":
        events = filters.apply_gap_policy(filters.gaps(events, "market_id", "ord"), "panic").where(~F.col("is_gap"))
    kind, order = F.col("event_type"), F.col("order_id")
    # one row for each market that was reset: what came before doesn't count
    resets = events.where(kind == 5).groupBy(F.col("market_id").alias("_m")).agg(F.max("ord").alias("_reset"))
    rows = events.join(resets, F.col("market_id") == F.col("_m"), "left").drop("_m")
    live = F.coalesce(F.col("ord") > F.col("_reset"), F.lit(True))
    named = lambda *ids: F.filter(F.array(*(F.col(x).cast("long") for x in ids)), lambda x: x != 0)
    parties = named("bid_order_id", "ask_order_id")
    wrong = lambda say: F.raise_error(say).cast("array<bigint>")
    touched = (
        F.when(~kind.isin(1, 2, 3, 4, 5, 6), wrong(F.concat(F.lit("unknown L3 event "), kind.cast("string"))))
        .when((kind == 1) & (F.coalesce(order, F.lit(0)) == 0), wrong(F.lit("order add without an id")))
        .when(kind.isin(5, 6) if unknown == "fail" else kind.isin(5, 6) | ~live, F.array().cast("array<bigint>"))
        .when((kind == 4) & (F.size(parties) > 0), parties)
        .otherwise(named("order_id"))
    )
    # unknown orders are told apart by what is known since the reset before, not since the last one
    epoch = F.sum((kind == 5).cast("int")).over(Window.partitionBy("market_id").orderBy("ord")) if unknown == "fail" else F.lit(0)
    rows = rows.withColumn("_epoch", epoch.cast("int")).withColumn("_live", live)
    fields = ["event_type", "side", "flags", "price", "qty"]
    rows = rows.select("market_id", "_epoch", "ord", "_live", *fields, F.posexplode(touched).alias("sub", "order"))
    dealt = rows.repartition("market_id", "order").sortWithinPartitions("market_id", "_epoch", "order", "ord", "sub")
    changes = dealt.select("market_id", "_epoch", "order", "ord", "sub", "_live", *fields).mapInArrow(_by_order(unknown, strict_fifo), CHANGES)
    levels = ["market_id", "side", "price"]
    return changes.repartition(*levels).sortWithinPartitions(*levels, "late", "ord", "sub").mapInArrow(_by_level, OUT)


def book_hash(final: DataFrame) -> DataFrame:
    """(market_id, book_hash): a SHA-256 digest over the sorted orders, for checkpoints."""
    one = F.concat_ws(",", "order_id", "side", "price", "qty")
    return final.where("kind = 'order'").groupBy("market_id").agg(F.sha2(F.concat_ws(";", F.sort_array(F.collect_list(one))), 256).alias("book_hash"))


def unknown_orders(events: DataFrame) -> DataFrame:
    """Trades, cancels and modifications of orders that no event adds."""
    added = events.where("event_type = 1").select(F.col("market_id").alias("m"), F.col("order_id").alias("o")).distinct()
    uses = events.where("event_type in (2, 3, 4)").select("market_id", "ord", F.explode(F.filter(F.array("order_id", "bid_order_id", "ask_order_id"), lambda x: x != 0)).alias("order_id"))
    return uses.join(added, (F.col("market_id") == F.col("m")) & (F.col("order_id") == F.col("o")), "left_anti")
