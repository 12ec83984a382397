"""Messages, seeks and other sources. Every table carries an explicit order column; scan order is never relied on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAD = 0xFFFF
#: The message view of the driver's events (one row for each): seq orders the whole table.
VIEW = """
SELECT event_id AS seq, unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS timestamp_ns, user_id % 8 AS market_id, event_type, value,
       CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 4 ELSE 2 END AS ev,
       CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side, 10000 + (event_id * 7919) % 25 AS price,
       CASE WHEN event_type = 'purchase' THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS size
FROM {events}"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def scan(df: DataFrame, type_col: str = "type_id") -> DataFrame:
    """Without padding records."""
    return df.where(F.col(type_col) != PAD)


def verified(df: DataFrame) -> DataFrame:
    """Raises for a row whose checksum is not the CRC-32 of its payload."""
    return df.withColumn("payload", F.when(F.crc32("payload") == F.col("checksum"), F.col("payload")).otherwise(F.raise_error(F.lit("corrupt record")).cast("binary")))


def drain(df: DataFrame, most: int, order: str = "seq") -> DataFrame:
    return df.orderBy(order).limit(most)


def start_at(df: DataFrame, mode: str, order: str = "seq", committed: int | None = None) -> DataFrame:
    """earliest, latest (nothing that is there yet), or resume after the committed position (strict: it must exist)."""
    if mode == "earliest":
        return df
    if mode == "latest":
        return df.where(F.lit(False))
    if mode == "resume_strict" and committed is None:
        raise ValueError("no committed position")
    if committed is not None:
        return df.where(F.col(order) > committed)
    return df if mode == "resume_snapshot" else df.where(F.lit(False))


def readable(df: DataFrame) -> DataFrame:
    """What a queue's reader gives: no padding, and every payload checked."""
    return verified(scan(df))


def _first(df: DataFrame, condition: Column, order: str) -> int | None:
    """The least position of the rows that fit. One small job: as a literal, the position prunes row groups of the scan."""
    return df.where(condition).agg(F.min(order)).first()[0]


def seek(df: DataFrame, column: str, target: int, order: str = "seq") -> DataFrame:
    """Positional: all rows from the first one, in order, whose column reaches the target."""
    at = _first(df, F.col(column) >= target, order)
    return df.where(F.lit(False)) if at is None else df.where(F.col(order) >= at)


def seek_scan(df: DataFrame, column: str, start: int, end: int, order: str = "seq") -> DataFrame:
    """Positional range: from the first row that reaches ``start`` up to the first one after it that reaches ``end``."""
    rows = seek(df, column, start, order)
    stop = _first(rows, F.col(column) >= end, order)
    return rows if stop is None else rows.where(F.col(order) < stop)


def for_each_available(df: DataFrame, most: int, go_on: Column, order: str = "seq") -> DataFrame:
    """The rows that a callback over at most ``most`` rows counts: those before the first for which go_on is not true.
    That one is consumed as well: a next call starts after it."""
    rows = drain(df, most, order)
    stop = _first(rows, ~F.coalesce(go_on, F.lit(False)), order)
    return rows if stop is None else rows.where(F.col(order) < stop)


def seek_result(df: DataFrame, target: int, column: str = "timestamp_ns", order: str = "seq") -> DataFrame:
    """One row: Found, EndOfLog or BeforeStart, and the position."""
    a = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.min(F.when(F.col(column) >= target, F.col(order))).alias("position"))
    return a.select(F.when(F.col("lo") > target, "BeforeStart").when(F.col("hi") >= target, "Found").otherwise("EndOfLog").alias("result"), "position")


def delta_files(spark: SparkSession, log_dir: str) -> DataFrame:
    """(path) of the live files of a Delta log, a folder of JSON files in the order of their names."""
    files = spark.read.text(log_dir, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"))
    return live_files(files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value")))


def live_files(lines: DataFrame) -> DataFrame:
    """(path) whose last action is an add, from (file, line, value): by file, then line; in a line, add comes before remove."""
    found = lines.select("file", "line", F.get_json_object("value", "$.add.path").alias("added"), F.get_json_object("value", "$.remove.path").alias("removed"))
    act = lambda k, c: found.where(F.col(c).isNotNull()).select("file", "line", F.lit(k).alias("k"), F.col(c).alias("path"))
    acts = act(0, "added").unionByName(act(1, "removed"))
    return acts.groupBy("path").agg(F.max_by("k", F.struct("file", "line", "k")).alias("k")).where("k = 0").select("path")


def dimension(df: DataFrame) -> DataFrame:
    """Clean symbol versions: no nulls, no negative numbers, until after from."""
    return df.dropna().where("valid_from_ts >= 0 and symbol_id >= 0 and valid_until_ts > valid_from_ts")


# fixed values: the columns of the exchange's files
ORDER_CSV = "OrderQty LONG, OrdType STRING, TransactTime LONG, ExpirationDays INT, Side BYTE, ApplSeqNum LONG, Contactor LONG, SendingTime LONG, Price DOUBLE, ChannelNo INT, ExpirationType INT, ContactInfo LONG, ConfirmID LONG"
TICK_CSV = "ApplSeqNum LONG, BidApplSeqNum LONG, SendingTime LONG, Price DOUBLE, ChannelNo INT, Qty LONG, OfferApplSeqNum LONG, Amt DOUBLE, ExecType STRING, TransactTime LONG"


def csv_rows(spark: SparkSession, path: str, schema: str, ignore_errors: bool = False, channel: int | None = None, symbols: str | None = None, max_files: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Rows with their path, the place of the file in the order of paths, and the symbol in its name.

    symbols: a regular expression of the symbols wanted; max_files: only the first files by path. Undecodable bytes are replaced.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").collect()]
    files = [f for f in files if f.endswith(".csv")][:max_files]
    rows = spark.read.csv(files or [path], schema=schema, header=True, encoding=encoding, mode="DROPMALFORMED" if ignore_errors else "FAILFAST")
    rows = rows.withColumn("path", F.col("_metadata.file_path")).withColumn("symbol", F.regexp_extract("path", r"([0-9]{6})\.csv$", 1))
    rows = rows.withColumn("file", F.dense_rank().over(Window.orderBy("path")) - 1 if not files else F.array_position(F.lit(files), F.col("path")).cast("int") - 1)
    if channel is not None:
        rows = rows.where(F.col("ChannelNo") == channel)
    return rows if symbols is None else rows.where(F.col("symbol").rlike(symbols))


def merged_csv(rows: DataFrame) -> DataFrame:
    """All files by (channel, sequence); equal ones by the place of their file."""
    return rows.orderBy("ChannelNo", "ApplSeqNum", "file")


def one_channel(rows: DataFrame) -> DataFrame:
    """Paths with more than one channel: their rows can't be merged as one stream."""
    return rows.groupBy("path").agg(F.countDistinct("ChannelNo").alias("channels")).where("channels > 1")


def channel_sink(path: str):
    """Writes each channel's rows, sorted, to a folder of its own."""
    return lambda df: by_channel(df).write.mode("append").partitionBy("ChannelNo").csv(path, header=True)


def order_tick_union(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """One table of both, with an event label; padded with typed nulls."""
    event = F.when(F.col("ExecType") == "F", "TRADE").when(F.col("ExecType") == "4", "CANCEL").otherwise("TICK")
    return orders.withColumn("Event", F.lit("ORDER")).unionByName(ticks.withColumn("Event", event), allowMissingColumns=True)


def by_channel(df: DataFrame) -> DataFrame:
    """Each channel sorted, in ranges of its positions: a channel, however long, is dealt over tasks, and its parts follow each other
    in the order of partitions (and of the files that a sink writes)."""
    keys = ["ChannelNo", "ApplSeqNum"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def monotone(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """The rows that step back."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_last", F.lag(column).over(w)).where(F.col(column) < F.col("_last")).drop("_last")


def pad_filter(column: Column) -> Column:
    return column != PAD
