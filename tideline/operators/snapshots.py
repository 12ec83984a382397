"""Snapshot cadence, lookup and retention, and the refinery that injects snapshots into a clean stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import catalog
from tideline.operators.book_l2 import replay


def every_n(df: DataFrame, n: int, stream: str, order: str = "seq") -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(stream).orderBy(order))).where(F.col("_k") % n == 0).drop("_k")


def planned(df: DataFrame, stream: str, order: str = "seq", records: int | None = None, size: int | None = None, elapsed: int | None = None, ts: str = "timestamp_ns", size_col: str = "size", first: bool = True) -> DataFrame:
    """Rows at which a snapshot is due: ``records`` rows, ``size`` bytes or ``elapsed`` since the last one (none yet: due, by time).

    "At least so much since the last emission" depends on each emission, so it is a fold over the stream in order, one row at
    a time, with a state of three numbers.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total, last = None, 0, 0, None
        for b in batches:
            keep = []
            for key, t, s in zip(b["_key"], b["_ts"], b["_size"], strict=True):
                if key != now:
                    now, n, total, last = key, 0, 0, None
                n, total = n + 1, total + s
                due = (records is not None and n >= records) or (size is not None and total >= size)
                due = due or (elapsed is not None and (last is None or max(t - last, 0) >= elapsed))
                keep.append(due)
                if due:
                    n, total, last = 0, 0, t
            yield b.loc[keep, names]

    names = df.columns
    size_of = F.col(size_col) if size_col in names else F.lit(0)
    rows = df.select("*", F.col(stream).alias("_key"), F.col(ts).alias("_ts"), F.coalesce(size_of, F.lit(0)).cast("long").alias("_size"))
    return rows.repartition("_key").sortWithinPartitions("_key", order).mapInPandas(fold, df.schema)


def latest_before(snapshots: DataFrame, target: int, column: str = "seq", key: str = "market_id", venue_id: int | None = None) -> DataFrame:
    """For each key the snapshot with the largest value up to the target; ties go to the least seq. venue_id: of this venue only."""
    snapshots = snapshots if venue_id is None else snapshots.where(F.col("venue_id") == venue_id)
    best = F.max_by(F.struct(*snapshots.columns), F.struct(F.col(column), -F.col("seq")))
    return snapshots.where(F.col(column) <= target).groupBy(key).agg(best.alias("s")).select("s.*")


def retained(snapshots: DataFrame, key: str, now: int | None = None, max_age: int | None = None, max_count: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """What age, then count, then bytes leave; the oldest seq goes first."""
    if now is not None and max_age is not None:
        snapshots = snapshots.where(F.lit(now) - F.col("modified") <= max_age)
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    if max_count is not None:
        snapshots = snapshots.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max_count).drop("_k")
    if max_bytes is not None:
        snapshots = snapshots.withColumn("_b", F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_b") <= max_bytes).drop("_b")
    return snapshots


def refine(df: DataFrame, interval: int, stream: str = "market_id", order: str = "seq", ts: str = "timestamp_ns", versions: DataFrame | None = None) -> DataFrame:
    """The book events, with a snapshot marker before each event at which one is due. ``part`` 0: marker (state after the
    event), 1: the event; output order is (order, part); out_seq numbers the result of each stream from 0.

    Rows of another type (type_id, where there is one) are dropped. versions: the symbol dimension; an event without a valid
    version raises, and so does a stream whose symbol changes. Book events of every kind pass and may bring a marker.
    """
    if "type_id" in df.columns:
        df = df.where(F.col("type_id") == BOOK_EVENT)
    if versions is not None:
        df = catalog.resolve_all(df, versions, key=stream, ts=ts, order=order)
        drift = F.lag("symbol_id").over(Window.partitionBy(stream).orderBy(order))
        df = df.withColumn("_was", drift)
        raised = F.raise_error(F.concat(F.lit("symbol changes to "), F.col("symbol_id").cast("string"))).cast("long")
        df = df.withColumn("symbol_id", F.when(F.col("_was") != F.col("symbol_id"), raised).otherwise(F.col("symbol_id"))).drop("_was")
    due = planned(df, stream, order, elapsed=interval, ts=ts)
    both = due.withColumn("part", F.lit(0)).unionByName(df.withColumn("part", F.lit(1)))
    return both.withColumn("out_seq", (F.row_number().over(Window.partitionBy(stream).orderBy(order, "part")) - 1).cast("long"))


def refined_books(levels: DataFrame, interval: int) -> DataFrame:
    """The snapshots that refine() injects into level rows (one or more for each event): the whole book after each due event."""
    events = levels.select("market_id", "seq", "timestamp_ns").distinct()
    due = planned(events, "market_id", elapsed=interval).select("market_id", "seq", F.lit(True).alias("due"))
    return replay(levels.join(due, ["market_id", "seq"], "left"), None).where("ev in (1, 2)")


# ---------------------------------------------------------------- stored snapshots

# fixed values of the format
BOOK_EVENT, SNAPSHOT_VERSION, MODE_L2 = 0x1000, 1, 0
HEADER_BYTES, COUNTS_BYTES, LEVEL_BYTES = 64, 12, 16


def write_snapshots(books: DataFrame, path: str, venue_id: int = 0, mode: str = "append") -> None:
    """Appends states of whole books (replay, depth None). Spark's commit makes a snapshot appear whole or not at all."""
    size = HEADER_BYTES + COUNTS_BYTES + LEVEL_BYTES * (F.size("bid_prices") + F.size("ask_prices"))
    head = {"version": F.lit(SNAPSHOT_VERSION), "book_mode": F.lit(MODE_L2), "venue_id": F.lit(venue_id), "size": size.cast("long")}
    books.withColumns(head).sortWithinPartitions("market_id", "seq").write.mode(mode).parquet(path)


def read_snapshots(spark, path: str, venue_id: int | None = None) -> DataFrame:
    """Stored snapshots; one of another version or mode, or whose length is not that of its levels, raises when it is read."""
    df = spark.read.parquet(path)
    df = df if venue_id is None else df.where(F.col("venue_id") == venue_id)
    bad = F.when(F.col("version") != SNAPSHOT_VERSION, "version").when(F.col("book_mode") != MODE_L2, "mode")
    bad = bad.when(F.col("size") != HEADER_BYTES + COUNTS_BYTES + LEVEL_BYTES * (F.size("bid_prices") + F.size("ask_prices")), "length")
    say = F.raise_error(F.concat(F.lit("snapshot of another "), bad)).cast("int")
    return df.withColumn("version", F.when(bad.isNotNull(), say).otherwise(F.col("version")))


def levels_of(snapshots: DataFrame) -> DataFrame:
    """Snapshots as level rows: bids from the best down, then asks from the best up."""
    keys = ["market_id", "seq", "timestamp_ns"]
    side = lambda s, p, z: snapshots.select(*keys, F.lit(s).alias("side"), F.posexplode(F.arrays_zip(F.col(p).alias("price"), F.col(z).alias("size"))).alias("level_ord", "x"))
    both = side("B", "bid_prices", "bid_sizes").unionByName(side("S", "ask_prices", "ask_sizes"))
    return both.select(*keys, F.lit(1).alias("ev"), "side", F.col("x.price").alias("price"), F.col("x.size").alias("size"), "level_ord")


def write_checkpoint(books: DataFrame, path: str, channel: int) -> None:
    """{channel, last_seq, symbols: [{symbol, book_hash}]} by symbol, as JSON. books(symbol, last_seq, book_hash): one row for each book."""
    entries = F.sort_array(F.collect_list(F.struct("symbol", "book_hash"))).alias("symbols")
    books.agg(F.lit(channel).alias("channel"), F.max("last_seq").alias("last_seq"), entries).coalesce(1).write.mode("overwrite").json(path)


def snapshot_service(stream: DataFrame, path: str, checkpoint: str, make, venue_id: int = 0):
    """A running query that appends, for each micro-batch of level rows, the snapshots that ``make`` takes from it (a function to
    states of whole books). The dimension or any other table that make reads is read anew for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        write_snapshots(make(batch), f"{path}/batch={number}", venue_id, "overwrite")  # a batch that comes again replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
