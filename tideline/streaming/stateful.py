"""Streaming forms: sources that resume, keyed folds with state, windowed monitoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.scalar import path_component
from tideline.operators.book_l2 import Book, ordered
from tideline.operators.book_l3 import Book as OrderBook


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A growing folder of Parquet files; a named reader is its checkpoint location."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def try_open(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame | None:
    """read_log, or None if there is nothing at the path yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return read_log(spark, path, schema, files_per_trigger) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def named_reader(stream: DataFrame, root: str, name: str, write: Callable[[DataFrame, int], None]):
    """Runs ``write(batch, number)`` over what is new for the reader of this name, then stops: its position is its checkpoint, so a
    next run goes on where this one ended. A batch whose write failed comes again under its number: at least once."""
    path_component(name)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root.rstrip('/')}/readers/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def once_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for named_reader in which a batch that comes again replaces itself, so each row is there once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def best_quotes(levels: DataFrame) -> DataFrame:
    """The best quotes after each event of a market; events of a batch are folded in order of seq, across batches as they arrive.
    The rows of one event have to arrive in one batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book()
        if state.exists:
            for side, prices, sizes in (("B", *state.get[:2]), ("S", *state.get[2:])):
                for p, s in zip(prices, sizes, strict=True):
                    book.put(side, int(p), int(s))
        rows = pd.concat(list(frames)).sort_values(["seq", "level_ord"], kind="stable")
        out, last = [], None
        for r in rows.itertuples(index=False):
            if r.ev not in (1, 2):
                continue
            if r.seq != last and r.ev == 1:
                book.clear()
            book.put(r.side, r.price, r.size)
            if r.seq == last:
                out.pop()
            last = r.seq
            out.append((key[0], r.seq, *book.state(1)[:2]))
        bids, asks = book.bids, book.asks
        state.update((bids.prices, [bids.size[p] for p in bids.prices], asks.prices, [asks.size[p] for p in asks.prices]))
        yield pd.DataFrame(out, columns=["market_id", "seq", "best_bid", "best_ask"]).astype({"best_bid": "Int64", "best_ask": "Int64"})

    shape = "bid_prices array<long>, bid_sizes array<long>, ask_prices array<long>, ask_sizes array<long>"
    return ordered(levels).groupBy("market_id").applyInPandasWithState(fold, "market_id long, seq long, best_bid long, best_ask long", shape, "append", GroupStateTimeout.NoTimeout)


def l3_quotes(events: DataFrame, unknown: str = "skip") -> DataFrame:
    """The best level prices of a market after each L3 event, across batches; events of a batch are taken in order of ord."""
    names = ["event_type", "side", "flags", "order_id", "bid_order_id", "ask_order_id", "price", "qty"]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = OrderBook(unknown)
        if state.exists:
            book.load(state.get[0])
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        out = []
        for ord_, *event in rows[["ord", *names]].itertuples(index=False):
            book.apply(*map(int, event))
            out.append((key[0], ord_, *book.best()))
        state.update((book.dump(),))
        yield pd.DataFrame(out, columns=["market_id", "ord", "best_bid", "best_ask"]).astype({"best_bid": "Int64", "best_ask": "Int64"})

    return events.groupBy("market_id").applyInPandasWithState(fold, "market_id long, ord long, best_bid long, best_ask long", "book string", "append", GroupStateTimeout.NoTimeout)


def time_bars(df: DataFrame, interval_ns: int, stream: str = "market_id", ts: str = "timestamp_ns", order: str = "seq") -> DataFrame:
    """The first row of each new bucket of a stream, across batches; late rows don't open old buckets again, timestamp 0 never emits."""
    names = df.columns

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        bucket = (rows[ts] // interval_ns).where(rows[ts] != 0, -1)
        seen = bucket.cummax().shift(fill_value=-1).clip(lower=state.get[0] if state.exists else -1)
        state.update((int(max(seen.iloc[-1], bucket.iloc[-1])),))
        yield rows.loc[bucket > seen, names]

    return df.groupBy(stream).applyInPandasWithState(fold, df.schema, "bucket long", "append", GroupStateTimeout.NoTimeout)


def gaps(df: DataFrame, stream: str = "market_id", order: str = "seq") -> DataFrame:
    """(stream, gap_from, gap_to) for each row that is not one more than the row before it in its stream, across batches."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(frames))["_seq"].sort_values(kind="stable")
        before = now.shift().astype("Int64")
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((int(now.iloc[-1]),))
        gap = before.notna() & (now.astype("Int64") != before + 1).fillna(False)
        yield pd.DataFrame({stream: key[0], "gap_from": before[gap].astype("int64"), "gap_to": now[gap]})

    kind = df.schema[stream].dataType.simpleString()
    return df.select(stream, F.col(order).cast("long").alias("_seq")).groupBy(stream).applyInPandasWithState(fold, f"{stream} {kind}, gap_from long, gap_to long", "last long", "append", GroupStateTimeout.NoTimeout)


def monitored(df: DataFrame, interval: str, value: str, delay: str) -> DataFrame:
    """Count and quantiles by event-time window; rows later than ``delay`` are left out."""
    timed = df.withColumn("at", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("at", delay)
    return timed.groupBy(F.window("at", interval)).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.99))).alias("quantiles"))
