"""Storage lifecycle, segment statistics, retention of readers, and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import bucket
from tideline.operators.filters import carried

DAY = 86400
MAX_LAG = 10 * 2**30
TTL_NS = 30 * 10**9


def should_compress(policy: str, now: int, days: int = 7, track_reads: bool = True, size: int = 0) -> Column:
    """Over (is_sealed, is_compressed, created_at, modified_at, last_accessed_at, size_bytes), times in seconds."""
    since = lambda c: F.greatest(F.lit(now) - c, F.lit(0))
    used = F.coalesce(F.col("last_accessed_at"), F.col("modified_at")) if track_reads else F.col("modified_at")
    by = {"never": F.lit(False), "immediate": F.lit(True), "idle_after": since(used) >= days * DAY, "age_after": since(F.col("created_at")) >= days * DAY, "size_threshold": F.col("size_bytes") >= size}
    return F.col("is_sealed") & ~F.col("is_compressed") & by[policy]


def lifecycle_totals(runs: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("size_before") - F.col("size_after"), F.lit(0))
    return runs.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("compressed").alias("compressed"), F.coalesce(F.sum(F.when(F.col("compressed"), saved)), F.lit(0)).alias("bytes_saved"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def segment_stats(df: DataFrame, segment: Column, order: str = "seq", ts: str = "timestamp_ns") -> DataFrame:
    return df.groupBy(segment.alias("segment_id")).agg(F.min(order).alias("min_seq"), F.max(order).alias("max_seq"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("n"))


def seek_index(df: DataFrame, segment: Column, stride: int = 4096, order: str = "seq", ts: str = "timestamp_ns") -> DataFrame:
    """Every stride-th record of each segment, from its first."""
    rows = df.withColumn("segment_id", segment)
    k = F.row_number().over(Window.partitionBy("segment_id").orderBy(order)) - 1
    return rows.withColumn("_k", k).where(F.col("_k") % stride == 0).select("segment_id", F.col("_k").cast("long").alias("record_index"), order, ts)


def position(segment_size: int) -> Column:
    return F.col("segment_id") * segment_size + F.col("offset")


def reader_lag(readers: DataFrame, head: int, segment_size: int) -> DataFrame:
    return readers.select("name", F.greatest(F.lit(head) - position(segment_size), F.lit(0)).alias("lag"))


def min_live_reader(readers: DataFrame, head: int, segment_size: int, now_ns: int) -> DataFrame:
    """The least position of the readers that count: neither stale nor too far behind; the head if there is none."""
    fresh = (F.col("last_heartbeat_ns") == 0) | (F.lit(now_ns) - F.col("last_heartbeat_ns") <= TTL_NS)
    at = position(segment_size)
    return readers.where(fresh & (F.lit(head) - at <= MAX_LAG)).agg(F.coalesce(F.min(at), F.lit(head).cast("long")).alias("position"))


def removable_segments(segments: DataFrame, readers: DataFrame, head: int, segment_size: int, now_ns: int) -> DataFrame:
    """Segments that no live reader needs, below the head segment; none if there are no readers at all."""
    live = min_live_reader(readers, head, segment_size, now_ns).crossJoin(readers.agg(F.count(F.lit(1)).alias("n")))  # one row each
    return segments.join(F.broadcast(live), (F.col("n") > 0) & (F.col("segment_id") < F.expr(f"position div {segment_size}")) & (F.col("segment_id") < head // segment_size)).drop("position", "n")


def monitor_windows(df: DataFrame, interval_s: int, value: str, ts: str = "timestamp_ns", exact: bool = False) -> DataFrame:
    """Count, rate and quantiles in each interval. Exact quantiles hold every distinct value of an interval; the others keep a
    sketch of fixed size."""
    b = bucket(F.col(ts), interval_s * 10**9)
    q = lambda p: F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, F.lit(p), 10_000)
    return df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / float(interval_s)).alias("rate"), q(0.5).alias("p50"), q(0.99).alias("p99"), q(0.999).alias("p999"), F.max(value).alias("max_value"))


def symbol_name(type_id: Column, market_id: Column) -> Column:
    """What a message is dealt by: its market if it is a book event, else its type."""
    return F.when(type_id == 0x1000, F.concat(F.lit("MARKET_"), market_id.cast("string"))).otherwise(F.concat(F.lit("TYPE_"), type_id.cast("string")))


def per_symbol(df: DataFrame, workers: int, symbol: str = "market_id") -> DataFrame:
    """Messages and symbols of each worker; a symbol belongs to one."""
    return df.groupBy((F.col(symbol) % workers).alias("worker")).agg(F.count(F.lit(1)).alias("messages"), F.countDistinct(symbol).alias("symbols"))


def sample_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the value at place floor(n * q) of the sorted values, the last one at most. Counted by distinct value, in ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    at = max(min(int(total * q), total - 1), 0)
    placed = carried(counts, F.col("n"), "sum", "before", value).withColumn("before", F.coalesce("before", F.lit(0)))
    return placed.where((F.col("before") <= at) & (F.col("before") + F.col("n") > at)).select(F.col(value).alias("quantile"))


def extractor_stats(df: DataFrame, batch_rows: int, emits: Column) -> DataFrame:
    """messages, events (snapshots and diffs), skipped, rows emitted, and batches of at most batch_rows."""
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    event = F.col("ev").isin(1, 2)
    a = df.agg(F.count(F.lit(1)).alias("messages"), F.count_if(event).alias("events"), F.count_if(~event).alias("skipped"), F.count_if(event & emits).alias("rows"))
    return a.withColumn("batches", F.ceil(F.col("rows") / batch_rows).cast("long"))


def writer_status(writers: DataFrame, now_ns: int, ttl_ns: int = TTL_NS) -> DataFrame:
    """(name, status) from (name, locked, last_heartbeat_ns): live, stale (locked without a recent heartbeat) or gone."""
    recent = F.lit(now_ns) - F.col("last_heartbeat_ns") <= ttl_ns
    return writers.select("name", F.when(~F.col("locked"), "gone").when(recent, "live").otherwise("stale").alias("status"))


# ---------------------------------------------------------------- lifecycle runs


def record_access(spark, path: str, partition: str, segment_id: int, at: int) -> None:
    """Appends to the access log; at: seconds. The partition is part of the key, as segment ids repeat between partitions."""
    spark.createDataFrame([(partition, segment_id, at)], "partition string, segment_id long, at long").coalesce(1).write.mode("append").parquet(path)


def last_access(spark, path: str) -> DataFrame:
    log = spark.read.schema("partition string, segment_id long, at long").parquet(path)
    return log.groupBy("partition", "segment_id").agg(F.max("at").alias("last_accessed_at"))


def compress_segment(spark, path: str) -> tuple[int, int]:
    """Rewrites a folder of Parquet files with zstd: into a folder beside it, which is checked and then takes its place. (bytes before, after)."""
    jvm = spark.sparkContext._jvm
    at, tmp, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", ".zst-tmp", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):  # an earlier run ended between its two renames
        fs.delete(old, True) if fs.exists(at) else fs.rename(old, at)
    df = spark.read.parquet(path)
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*d.columns).cast("decimal(20,0)"))).first()
    before = fs.getContentSummary(at).getLength()
    df.write.mode("overwrite").option("compression", "zstd").parquet(tmp.toString())
    if mark(df) != mark(spark.read.parquet(tmp.toString())):
        fs.delete(tmp, True)
        raise ValueError(f"{path}: the rewritten rows differ")
    after = fs.getContentSummary(tmp).getLength()
    fs.rename(at, old)
    fs.rename(tmp, at)
    fs.delete(old, True)
    return before, after


def run_once(spark, segments: DataFrame, policy: str, now: int, **limits) -> DataFrame:
    """Compresses the segments (path and the columns of should_compress) that the policy names; a row for each segment scanned,
    for lifecycle_totals. An error is kept with its segment and does not end the run. The driver holds one row for each
    segment; the rewriting is Spark's."""
    out = []
    for r in segments.withColumn("_due", should_compress(policy, now, **limits)).toLocalIterator():
        before = after = r["size_bytes"]
        error = None
        if r["_due"]:
            try:
                before, after = compress_segment(spark, r["path"])
            except Exception as e:  # noqa: BLE001
                error = str(e).split("\n")[0][:200]
        out.append((r["path"], bool(r["_due"]) and error is None, before, after, error))
    return spark.createDataFrame(out, "path string, compressed boolean, size_before long, size_after long, error string")


def discovery(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    added = after.join(before, key, "left_anti").select(key, F.lit("added").alias("change"))
    return added.unionByName(before.join(after, key, "left_anti").select(key, F.lit("removed").alias("change")))
