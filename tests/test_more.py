"""Events of many levels, statuses, streams in batches, raw segments, stored snapshots, lifecycle runs, guards."""

import random
import re
import zlib

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import book_l2, book_l3, features, filters, lifecycle, merge, snapshots
from tideline.plans import replay
from tideline.plans import table as tables
from tideline.plans.table import Table
from tideline.sources import messages as src
from tideline.sources import payloads, segments
from tideline.streaming import stateful

LEVELS = "market_id long, seq long, timestamp_ns long, ev int, side string, price long, size long, level_ord int"


def random_levels(n=300, markets=3, seed=5):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        m, ev = rng.randrange(markets), 1 if rng.random() < 0.08 else 2
        for k in range(rng.randrange(1, 6)):
            rows.append((m, seq, seq * 10, ev, rng.choice("BS"), 100 + rng.randrange(8), rng.choice([0, 1, 5]), k))
    return rows


def plain_books(rows):
    """(market, seq) -> (bids, asks), event by event."""
    books, out, last = {}, {}, None
    for m, seq, _, ev, side, price, size, _ in sorted(rows, key=lambda r: (r[1], r[7])):
        if (m, seq) != last and ev == 1:
            books[m] = ({}, {})
        last = (m, seq)
        book = books.setdefault(m, ({}, {}))[side == "S"]
        book.pop(price, None)
        if size:
            book[price] = size
        bids, asks = books[m]
        out[m, seq] = (dict(bids), dict(asks))
    return out


def test_a_snapshot_of_many_levels_clears_once(spark):
    rows = [(1, 0, 0, 1, "B", 100, 5, 0), (1, 0, 0, 1, "S", 101, 6, 1), (1, 1, 1, 2, "B", 100, 0, 0), (1, 1, 1, 2, "B", 99, 2, 1), (1, 1, 1, 2, "B", 99, 3, 2)]
    got = book_l2.replay(spark.createDataFrame(rows, LEVELS)).orderBy("seq").collect()
    assert [(r["best_bid"], r["best_ask"], r["bid_sizes"], r["ask_prices"]) for r in got] == [(100, 101, [5], [101]), (99, 101, [3], [101])]


def test_replay_by_event_equals_plain_books(spark):
    rows = random_levels()
    want = plain_books(rows)
    got = {(r["market_id"], r["seq"]): r for r in book_l2.replay(spark.createDataFrame(rows, LEVELS).repartition(5), None).collect()}
    assert got.keys() == want.keys()
    for k, (bids, asks) in want.items():
        r = got[k]
        assert dict(zip(r["bid_prices"], r["bid_sizes"])) == bids and r["bid_prices"] == sorted(bids, reverse=True)
        assert dict(zip(r["ask_prices"], r["ask_sizes"])) == asks and r["ask_prices"] == sorted(asks)
    last = {m: max(s for x, s in want if x == m) for m, _ in want}
    at = {(r["market_id"], r["side"], r["price"]): r["size"] for r in book_l2.book_at(spark.createDataFrame(rows, LEVELS)).collect()}
    assert at == {(m, "BS"[i], p): s for m, q in last.items() for i in (0, 1) for p, s in want[m, q][i].items()}


def test_gap_policies_and_required_snapshot(spark):
    rows = [(1, 1, 0, 2, "B", 98, 1, 0), (1, 2, 0, 1, "B", 100, 1, 0), (1, 4, 0, 2, "B", 101, 1, 0), (1, 5, 0, 4, None, None, None, 0), (1, 6, 0, 2, "B", 102, 1, 0)]
    df = spark.createDataFrame(rows, LEVELS)
    got = book_l2.replay(df, gap_policy="quarantine", statuses=True).orderBy("seq").collect()
    assert [(r["seq"], r["best_bid"], r["skipped"]) for r in got] == [(1, 98, None), (2, 100, None), (4, 100, "Gap"), (5, 100, "UnsupportedEvent"), (6, 102, None)]
    assert [r["seq"] for r in book_l2.replay(df, require_snapshot=True).orderBy("seq").collect()] == [2, 4, 6]
    with pytest.raises(PySparkException, match="missing 1"):
        book_l2.replay(df, gap_policy="panic").collect()
    reasons = df.withColumn("skipped", F.when(F.col("seq") == 4, "Corrupt"))
    assert [r["best_bid"] for r in book_l2.replay(reasons, statuses=True).orderBy("seq").collect()] == [98, 100, 100, 100, 102]
    with pytest.raises(ValueError, match="else"):
        book_l2.replay(df, gap_policy="else")
    assert book_l2.replay(df.limit(0)).count() == 0


def batches(spark, folder, frames, run, name):
    """The rows of a streaming query over frames that arrive one after the other; each start resumes from its checkpoint."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames[0].schema)
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = run(stateful.read_log(spark, f"{folder}/in", schema))
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_streams_in_two_batches_equal_one(spark, tmp_path):
    rows = random_levels(120)
    cut = lambda lo, hi: spark.createDataFrame([r for r in rows if lo <= r[1] < hi], LEVELS)
    got = batches(spark, f"file://{tmp_path}/quotes", [cut(0, 50), cut(50, 120)], stateful.best_quotes, "quotes").collect()
    want = {k: (max(b, default=None), min(a, default=None)) for k, (b, a) in plain_books(rows).items()}
    assert {(r["market_id"], r["seq"]): (r["best_bid"], r["best_ask"]) for r in got} == want and len(got) == len(want)
    # bars: late rows don't open old buckets again, timestamp 0 never emits
    events = [(1, 0, 0), (1, 1, 105), (1, 2, 110), (1, 3, 230), (1, 4, 140), (1, 5, 299), (1, 6, 310), (2, 7, 50), (2, 8, 20)]
    frames = [spark.createDataFrame(events[:4] + events[7:8], "market_id long, seq long, timestamp_ns long"), spark.createDataFrame(events[4:7] + events[8:], "market_id long, seq long, timestamp_ns long")]
    bars = batches(spark, f"file://{tmp_path}/bars", frames, lambda d: stateful.time_bars(d, 100), "bars").collect()
    assert sorted(r["seq"] for r in bars) == [1, 3, 6, 7]
    found = batches(spark, f"file://{tmp_path}/gaps", [spark.createDataFrame([(1, 1), (1, 2), (1, 5)], "market_id long, seq long"), spark.createDataFrame([(1, 6), (1, 6), (1, 9)], "market_id long, seq long")], stateful.gaps, "gaps").collect()
    assert sorted((r["gap_from"], r["gap_to"]) for r in found) == [(2, 5), (6, 6), (6, 9)]


def test_raw_segments(spark, tmp_path):
    rows = [(k, 1000 + k, src.PAD if k == 2 else 0x1000, bytes([k]) * (k * 37)) for k in range(6)]
    (tmp_path / "000000000.q").write_bytes(segments.encode(0, rows))
    (tmp_path / "000000002.q").write_bytes(segments.encode(2, [(0, 9, 1, b"again")], sealed=False))
    (tmp_path / "other.txt").write_text("x")
    got = segments.read_segments(spark, f"file://{tmp_path}").orderBy("segment_id", "offset").collect()
    assert [(r["segment_id"], r["seq"], r["timestamp_ns"], r["type_id"], bytes(r["payload"])) for r in got] == [(0, *r) for r in rows if r[2] != src.PAD] + [(2, 0, 9, 1, b"again")]
    assert segments.read_segments(spark, f"file://{tmp_path}", padding=True).count() == 7
    bad = bytearray(segments.encode(3, [(0, 0, 1, b"payload")]))
    bad[130] ^= 1
    (tmp_path / "000000003.q").write_bytes(bytes(bad))
    with pytest.raises(PySparkException, match="corrupt record"):
        segments.read_segments(spark, f"file://{tmp_path}").collect()
    with pytest.raises(ValueError, match="out of bounds"):
        list(segments.records(segments.encode(1, [(0, 0, 1, b"x" * 500)])[:300]))


def test_readable_messages(spark):
    good = [(0, 1, b"a", zlib.crc32(b"a")), (1, src.PAD, b"p", 0)]
    df = spark.createDataFrame(good, "seq long, type_id int, payload binary, checksum long")
    assert [r["seq"] for r in src.readable(df).collect()] == [0]
    with pytest.raises(PySparkException, match="corrupt record"):
        src.readable(spark.createDataFrame([(0, 1, b"a", 5)], df.schema)).collect()
    assert [src.start_at(df, m, committed=c).count() for m, c in (("earliest", None), ("latest", None), ("resume_snapshot", None), ("resume_latest", None), ("resume_strict", 0))] == [2, 0, 2, 0, 1]
    with pytest.raises(ValueError, match="no committed"):
        src.start_at(df, "resume_strict")


def test_table_reader_kinds_and_paths(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", [("channel", "int"), ("day", "date")])
    rows = spark.createDataFrame([(k, 86_400 * 10**9 * (k % 2) + k) for k in range(20)], "seq long, timestamp_ns long")
    t.write_rolling(rows.where("seq < 10"), {"channel": 9})
    t.write_rolling(rows.where("seq >= 10"), {"channel": 10})
    assert [r["seq"] for r in t.reader({"channel": 9, "day": "1970-01-01"}).collect()] == [0, 2, 4, 6, 8]
    for values in ({"channel": "9", "day": "1970-01-01"}, {"channel": 9}):
        with pytest.raises(ValueError):
            t.reader(values)
    count = lambda f: t.query(f).count()
    assert count(filters.Exact({"channel": 9, "day": "1970-01-02"})) == 5 and count(filters.Exact({"channel": "9", "day": "1970-01-02"})) == 0
    assert count(filters.Exact({"channel": 9})) == 0 and count(filters.All()) == 20 and count(filters.Range("channel", "10", "5")) == 10
    assert {tuple(r) for r in t.partitions().collect()} == {(c, d) for c in (9, 10) for d in ("1970-01-01", "1970-01-02")}
    assert not spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "false"
    values = {"day": "1970-01-01", "channel": 9}
    assert tables.partition_path(t.scheme, values) == "channel=9/day=1970-01-01" and tables.partition_values("channel=9/day=1970-01-01") == {"channel": "9", "day": "1970-01-01"}
    assert tables.partition_label({"b": 1, "a": 2}) == "a=2/b=1"
    spark.createDataFrame([('{"version": 2, "scheme": [], "tz": "UTC"}',)], "value string").write.mode("overwrite").text(f"file://{tmp_path}/v/_table/metadata")
    with pytest.raises(ValueError, match="version 2"):
        Table.open(spark, f"file://{tmp_path}/v")


def test_stored_snapshots(spark, tmp_path):
    rows = random_levels(80)
    states = book_l2.replay(spark.createDataFrame(rows, LEVELS).withColumn("due", F.expr("seq % 20 = 0")), None)
    path = f"file://{tmp_path}/snapshots"
    snapshots.write_snapshots(states, path, venue_id=3)
    want = {k: v for k, v in plain_books(rows).items() if k[1] % 20 == 0}
    got = snapshots.read_snapshots(spark, path, 3)
    assert {(r["market_id"], r["seq"]): (dict(zip(r["bid_prices"], r["bid_sizes"])), dict(zip(r["ask_prices"], r["ask_sizes"]))) for r in got.collect()} == want
    assert snapshots.read_snapshots(spark, path, 4).count() == 0
    # a warm start from a stored snapshot equals the whole replay
    market, seq = max(want, key=lambda k: (k[1], k[0]))
    final = {(r["side"], r["price"]): r["size"] for r in book_l2.warm_start(spark.createDataFrame(rows, LEVELS), snapshots.levels_of(got), market).collect()}
    last = max(s for m, s in plain_books(rows) if m == market)
    assert final == {("BS"[i], p): s for i in (0, 1) for p, s in plain_books(rows)[market, last][i].items()}
    for column, value, say in (("version", 2, "version"), ("book_mode", 1, "mode"), ("size", 5, "length")):
        other = f"file://{tmp_path}/{column}"
        got.withColumn(column, F.lit(value).cast(got.schema[column].dataType)).write.parquet(other)
        with pytest.raises(PySparkException, match=f"another {say}"):
            snapshots.read_snapshots(spark, other).collect()
    snapshots.write_checkpoint(spark.createDataFrame([("b", 7, "y"), ("a", 9, "x")], "symbol string, last_seq long, book_hash string"), f"file://{tmp_path}/check", 4)
    r = spark.read.json(f"file://{tmp_path}/check").first()
    assert (r["channel"], r["last_seq"], [(s["symbol"], s["book_hash"]) for s in r["symbols"]]) == (4, 9, [("a", "x"), ("b", "y")])


def test_snapshot_service(spark, tmp_path):
    rows = random_levels(60, markets=1)
    stream = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, LEVELS).coalesce(1).write.parquet(stream)
    make = lambda batch: book_l2.replay(batch.withColumn("due", F.expr("seq % 30 = 0")), None)
    q = snapshots.snapshot_service(stateful.read_log(spark, stream, LEVELS), f"file://{tmp_path}/out", f"file://{tmp_path}/check", make)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["seq"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [0, 30]


def test_refinery(spark):
    rows = [(1, k, 100 * k, 4097 if k == 2 else 4096) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "market_id long, seq long, timestamp_ns long, type_id int")
    version = "market_id long, load_ord int, symbol_id long, valid_from_ts long, valid_until_ts long"
    one = spark.createDataFrame([(1, 0, 50, 0, 10**9)], version)
    got = [(r["seq"], r["part"], r["symbol_id"]) for r in snapshots.refine(df, 200, versions=one).orderBy("out_seq").collect()]
    assert got == [(1, 0, 50), (1, 1, 50), (3, 0, 50), (3, 1, 50), (4, 1, 50), (5, 0, 50), (5, 1, 50), (6, 1, 50)]
    with pytest.raises((PySparkException, Py4JJavaError), match="no symbol version"):
        snapshots.refine(df, 200, versions=one.where("false")).collect()
    drift = spark.createDataFrame([(1, 0, 50, 0, 0), (1, 1, 51, 0, 10**9)], version).unionByName(spark.createDataFrame([(1, 2, 50, 0, 10**9)], version))
    two = spark.createDataFrame([(k, 1, 1000 * k, 4096) for k in (1,)] + [], "market_id long, seq long, timestamp_ns long, type_id int")
    assert snapshots.refine(two, 200, versions=drift).count() == 2
    moving = spark.createDataFrame([(1, 0, 50, 0, 1), (1, 1, 51, 1, 10)], version)
    far = spark.createDataFrame([(1, 1, 500, 4096), (1, 2, 1500, 4096)], "market_id long, seq long, timestamp_ns long, type_id int")
    with pytest.raises((PySparkException, Py4JJavaError), match="symbol changes"):
        snapshots.refine(far, 200, versions=moving).collect()
    books = snapshots.refined_books(spark.createDataFrame([(1, k, 100 * k, 2, "B", 100 + k, 1, 0) for k in range(5)], LEVELS), 250)
    assert [(r["seq"], r["bid_prices"]) for r in books.orderBy("seq").collect()] == [(0, [100]), (3, [103, 102, 101, 100])]


def test_lifecycle_run(spark, tmp_path):
    paths = []
    for k in range(3):
        paths.append(f"file://{tmp_path}/p/seg={k}")
        spark.range(1000 * k, 1000 * k + 1000).withColumn("x", F.lit("same text " * 5)).write.option("compression", "uncompressed").parquet(paths[-1])
    infos = [(paths[0], True, False, 0, 0, None, 10**6), (paths[1], False, False, 0, 0, None, 10**6), (f"file://{tmp_path}/p/none", True, False, 0, 0, None, 5), (paths[2], True, False, 0, 99, 10**9, 10**6)]
    df = spark.createDataFrame(infos, "path string, is_sealed boolean, is_compressed boolean, created_at long, modified_at long, last_accessed_at long, size_bytes long")
    done = lifecycle.run_once(spark, df, "idle_after", 10**9, days=7)
    got = {r["path"]: (r["compressed"], r["error"] is not None, r["size_after"] < r["size_before"]) for r in done.collect()}
    assert got == {paths[0]: (True, False, True), paths[1]: (False, False, False), infos[2][0]: (False, True, False), paths[2]: (False, False, False)}
    assert spark.read.parquet(paths[0]).count() == 1000 and sorted(x.name for x in (tmp_path / "p").iterdir()) == ["seg=0", "seg=1", "seg=2"]
    total = lifecycle.lifecycle_totals(done).first()
    assert (total["scanned"], total["compressed"], total["errors"]) == (4, 1, 1) and total["bytes_saved"] > 0
    log = f"file://{tmp_path}/log"
    for partition, segment, at in (("a", 1, 5), ("a", 1, 9), ("b", 1, 7)):
        lifecycle.record_access(spark, log, partition, segment, at)
    assert {tuple(r) for r in lifecycle.last_access(spark, log).collect()} == {("a", 1, 9), ("b", 1, 7)}


def test_csv_files_and_channels(spark, tmp_path):
    head = "ApplSeqNum,BidApplSeqNum,SendingTime,Price,ChannelNo,Qty,OfferApplSeqNum,Amt,ExecType,TransactTime"
    for name, rows in (("000002", [(3, 1), (1, 2)]), ("000001", [(3, 1), (2, 1)]), ("600003", [(1, 1)])):
        (tmp_path / f"{name}.csv").write_text("\n".join([head] + [f"{s},0,0,1.5,{c},10,0,1.0,F,0" for s, c in rows]) + "\n")
    read = lambda **kw: src.csv_rows(spark, f"file://{tmp_path}", src.TICK_CSV, **kw)
    got = [(r["ChannelNo"], r["ApplSeqNum"], r["symbol"]) for r in src.merged_csv(read()).collect()]
    assert got == [(1, 1, "600003"), (1, 2, "000001"), (1, 3, "000001"), (1, 3, "000002"), (2, 1, "000002")]
    assert read(channel=2).count() == 1 and read(symbols="^0").count() == 4 and read(max_files=1).count() == 2
    assert [r["channels"] for r in src.one_channel(read()).collect()] == [2]
    src.channel_sink(f"file://{tmp_path}/out")(read().drop("path", "file"))
    split = spark.read.csv(f"file://{tmp_path}/out", header=True)
    assert {(r["ChannelNo"], r["n"]) for r in split.groupBy("ChannelNo").agg(F.count("*").alias("n")).collect()} == {(1, 4), (2, 1)}


def test_l3_decode_policies_and_channels(spark):
    rows = [(1, 4096, 1, 2, 128, 7), (2, 4097, 1, 2, 128, 7), (3, 4096, 0, 2, 128, 7), (4, 4096, 1, 1, 128, 7)]
    df = spark.createDataFrame(rows, "seq long, type_id int, book_mode int, event_type int, record_len int, stream_id int")
    assert [r["seq"] for r in filters.l3_events(df, "skip").collect()] == [1]
    with pytest.raises(PySparkException, match="no L3 event: NonBookEvent"):
        filters.l3_events(df.where("seq < 3")).collect()
    short = df.where("seq = 1").withColumn("record_len", F.lit(100))
    for policy in ("skip", "fail"):
        with pytest.raises(PySparkException, match="Corrupt"):
            filters.l3_events(short, policy).collect()
    assert filters.one_channel(df).count() == 4
    with pytest.raises(ValueError, match="2 channels"):
        filters.one_channel(df.withColumn("stream_id", F.col("seq") % 2))


def test_l3_market_flag_reset_and_hash(spark):
    names = "market_id long, ord long, event_type int, side int, flags int, order_id long, bid_order_id long, ask_order_id long, price long, qty long"
    rows = [
        (1, 1, 1, 1, 0, 10, 0, 0, 100, 5), (1, 2, 1, 1, 1, 11, 0, 0, 100, 3),  # the flagged one is in no level
        (1, 3, 2, 0, 0, 11, 0, 0, 0, 0),  # its cancel is taken from that price's level all the same
        (2, 1, 1, 1, 0, 20, 0, 0, 50, 5), (2, 2, 5, 0, 0, 0, 0, 0, 0, 0), (2, 3, 6, 0, 0, 0, 0, 0, 0, 0),
        (3, 1, 1, 2, 0, 30, 0, 0, 70, 5), (3, 2, 4, 0, 0, 0, 0, 30, 70, 2), (3, 3, 1, 2, 0, 31, 0, 0, 70, 1),
    ]
    final = book_l3.final_books(spark.createDataFrame(rows, names)).collect()
    levels = {(r["market_id"], r["side"], r["price"]): (r["qty"], r["queue_len"]) for r in final if r["kind"] == "level"}
    assert levels == {(1, 1, 100): (2, 1), (3, 2, 70): (4, 1)}
    strict = book_l3.final_books(spark.createDataFrame(rows, names), strict_fifo=True).where("kind = 'level' and market_id = 3").first()
    assert (strict["qty"], strict["queue_len"]) == (4, 2)
    with pytest.raises(PySparkException, match="unknown L3 event 9"):
        book_l3.final_books(spark.createDataFrame([(1, 1, 9, 0, 0, 0, 0, 0, 0, 0)], names)).collect()
    with pytest.raises(PySparkException, match="trade of unknown order"):
        book_l3.final_books(spark.createDataFrame([(1, 1, 4, 0, 0, 5, 0, 0, 0, 1)], names), unknown="fail").collect()
    hashes = lambda some: {r["market_id"]: r["book_hash"] for r in book_l3.book_hash(book_l3.final_books(spark.createDataFrame(some, names))).collect()}
    assert hashes(rows)[3] == hashes(rows[6:])[3] != hashes(rows[6:8])[3]


def test_ranges_agree_with_one_window(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(10**6), rng.randrange(50)) for k in range(2000)]
    df = spark.createDataFrame(rows, "seq long, timestamp_ns long, part long").repartition(7)
    best, got = -1, {r["seq"]: r["merge_ts"] for r in merge.merge_key(df, None).collect()}
    for k, ts, _ in rows:
        best = max(best, ts)
        assert got[k] == best
    assert sorted((r["seq"], r["_k"]) for r in filters.numbered(df, "seq", n=9).collect()) == [(k, k + 1) for k in range(2000)]
    sums = {r["seq"]: r["s"] for r in filters.carried(df, F.col("part"), "sum", "s", n=5).collect()}
    total = 0
    for k, _, p in rows:
        assert sums[k] == (None if k == 0 else total)
        total += p
    assert merge.rolling_stats(df, "part").first()["partition_rolls"] == sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    assert merge.merge_key(df.limit(0), None).count() == 0


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(0,), (1_704_067_199_999_999_999,), (-1,)], "t long")
    stamps = spark.createDataFrame([("20240229093000123",), ("2024",), (None,)], "s string")
    read = lambda: ([r[0] for r in df.select(scalar.roll(F.col("t"), "minute", "Asia/Shanghai")).collect()], [r[0] for r in stamps.select(scalar.exchange_time(F.col("s"))).collect()])
    want = read()
    assert want == (["1970-01-01-08-00", "2024-01-01-07-59", "1970-01-01-07-59"], [1_709_199_000_123_000_000, None, None])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_functions(spark):
    df = spark.createDataFrame([(k, float(k % 10)) for k in range(100)], "seq long, value double")
    assert lifecycle.sample_quantile(df, "value", 0.5).first()[0] == 5.0 and lifecycle.sample_quantile(df, "value", 1.0).first()[0] == 9.0
    assert lifecycle.sample_quantile(df.limit(0), "value", 0.5).count() == 0
    assert [r["seq"] for r in src.for_each_available(df, 50, F.expr("seq < 7")).collect()] == list(range(7))
    assert src.for_each_available(df, 5, F.lit(True)).count() == 5 and src.seek(df, "seq", 1000).count() == 0
    assert scalar.path_component("a-b.c_1") == "a-b.c_1"
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            scalar.path_component(bad)
    with pytest.raises(ValueError):
        lifecycle.extractor_stats(df.withColumn("ev", F.lit(1)), 0, F.lit(True))
    with pytest.raises(ValueError):
        merge.fan_in([])


def test_named_readers_resume(spark, tmp_path):
    path, root = f"file://{tmp_path}/log", f"file://{tmp_path}"
    assert stateful.try_open(spark, path, "seq long") is None
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).withColumnRenamed("id", "seq").coalesce(1).write.mode("append").parquet(path)
        stateful.named_reader(stateful.try_open(spark, path, "seq long"), root, "a", stateful.once_sink(f"{root}/out"))
    out = spark.read.parquet(f"{root}/out")
    assert sorted((r["batch"], r["seq"]) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]
    stateful.once_sink(f"{root}/out")(spark.range(3, 6).withColumnRenamed("id", "seq"), 1)
    assert spark.read.parquet(f"{root}/out").count() == 6
    stateful.named_reader(stateful.read_log(spark, path, "seq long"), root, "b", stateful.once_sink(f"{root}/other"))
    assert spark.read.parquet(f"{root}/other").count() == 6
    with pytest.raises(ValueError):
        stateful.named_reader(stateful.read_log(spark, path, "seq long"), root, "../x", stateful.once_sink(root))


def test_feature_graph(spark):
    rows = [(1, k, k, 2, "BS"[k % 2], 100 + k, k + 1, 0) for k in range(20)]
    df = spark.createDataFrame(rows, LEVELS)
    graph = features.FeatureGraph([features.mid_price()], [features.spread_bps(), features.imbalance(10)], depth=10)
    assert graph.offsets == [0, 1]
    last = graph.extract(df).orderBy(F.desc("seq")).first()
    bids, asks = sorted((k + 1 for k in range(0, 20, 2)), reverse=True), [k + 1 for k in range(1, 20, 2)]
    assert last["imbalance"] == (sum(bids) - sum(asks)) / (sum(bids) + sum(asks))
    assert graph.extract(df, features.time_bar(10)).count() == 2
    with pytest.raises(ValueError, match="no features"):
        features.FeatureGraph([])
    with pytest.raises(ValueError, match="another kind"):
        features.FeatureGraph([F.lit("x").alias("x")]).extract(df)


def test_warm_start_reaches(spark):
    rows = [(1, k, 10 * k, 1 if k == 2 else 2, "B", 100, 1, 0) for k in range(6)]
    df = spark.createDataFrame(rows, LEVELS)
    shots = df.where("ev = 1")
    assert [book_l2.reaches(df, shots, 1, t) for t in (10, 20, 45, 50, 51)] == [False, True, True, True, False]
    assert snapshots.latest_before(shots.withColumn("venue_id", F.lit(3)), 50, "timestamp_ns", venue_id=4).count() == 0


def test_raw_log_to_books(spark, tmp_path):
    """Segments of binary book events, decoded and replayed, with a status for every message."""
    event = payloads.BOOK_EVENT
    messages = [
        (0, 10, event, payloads.diff_payload([(99, 1)], [], 7)),
        (1, 20, event, payloads.snapshot_payload({100: 5, 98: 2}, {101: 6}, 7, (2, 3))),
        (2, 30, event, payloads.diff_payload([(100, 0), (99, 3)], [(102, 4)], 7, ids=(5, 6, 4))),
        (3, 40, payloads.BOOK_TICKER, payloads._TICKER.pack(40, 1.5, 2.0, 1.75, 3.0, 2**64 - 1)),
        (4, 50, event, payloads.l3_payload(1, 1, 11, 100, 5, 7)),
        (5, 60, event, payloads.diff_payload([(1, 1)], [], 7)[:-8]),
        (6, 70, event, b"short"),
        (8, 80, event, payloads.diff_payload([(97, 2**63)], [], 7)),
        (9, 90, event, payloads.diff_payload([], [], 7)),
        (10, 95, payloads.TRADE, payloads._TRADE.pack(95, 1.5, 2.0, 3, 4, 5, True, 6)),
    ]
    (tmp_path / "000000000.q").write_bytes(segments.encode(0, messages))
    log = segments.read_segments(spark, f"file://{tmp_path}")
    levels = payloads.book_levels(log)
    got = book_l2.replay(levels.withColumn("market_id", F.lit(7)), None, statuses=True).orderBy("seq").collect()
    want = [(0, 99, None, None), (1, 100, 101, None), (2, 99, 101, None), (3, 99, 101, "NonBookEvent"), (4, 99, 101, "UnsupportedMode"), (5, 99, 101, "Corrupt"), (6, 99, 101, "Corrupt"), (8, 99, 101, "Corrupt"), (9, 99, 101, None), (10, 99, 101, "NonBookEvent")]
    assert [(r["seq"], r["best_bid"], r["best_ask"], r["skipped"]) for r in got] == want
    assert dict(zip(got[-1]["bid_prices"], got[-1]["bid_sizes"])) == {99: 3, 98: 2}
    assert {(r["price_scale"], r["size_scale"]) for r in levels.where("seq = 1").collect()} == {(2, 3)}
    assert [(r["update_id_first"], r["update_id_last"]) for r in levels.where("seq = 2 and level_ord = 0").collect()] == [(5, 6)]
    (t,) = payloads.tickers(log).collect()
    assert (t["seq"], t["timestamp_ns"], t["bid_price"], t["ask_qty"], int(t["symbol_hash"])) == (3, 40, 1.5, 3.0, 2**64 - 1)
    (t,) = payloads.trades(log).collect()
    assert (t["seq"], t["trade_id"], t["is_buyer_maker"], int(t["symbol_hash"])) == (10, 3, True, 6)
    one = payloads.l3_events(log.where("seq in (3, 4)"), "skip")
    assert [(r["kind"], r["price"], r["qty"]) for r in book_l3.final_books(one).orderBy("kind").collect()] == [("level", 100, 5), ("order", 100, 5)]
    with pytest.raises(PySparkException, match="no L3 event: NonBookEvent"):
        payloads.l3_events(log.where("seq = 3")).collect()
    with pytest.raises(PySparkException, match="no L3 event: Corrupt"):
        payloads.l3_events(log.where("seq = 6"), "skip").collect()
    assert payloads.book_levels(log.limit(0)).count() == 0


def test_snapshot_payload_round_trip(spark):
    bids, asks = {100: 5, 98: 2, 97: 1}, {101: 6, 105: 1}
    payload = payloads.snapshot_payload(bids, asks, 3)
    assert len(payload) == snapshots.HEADER_BYTES + snapshots.COUNTS_BYTES + snapshots.LEVEL_BYTES * 5
    rows = payloads.book_levels(spark.createDataFrame([(0, 0, 0x1000, payload)], "seq long, timestamp_ns long, type_id int, payload binary")).orderBy("level_ord").collect()
    assert [(r["side"], r["price"], r["size"]) for r in rows] == [("B", 100, 5), ("B", 98, 2), ("B", 97, 1), ("S", 101, 6), ("S", 105, 1)]


def test_delta_log_in_line_order(spark, tmp_path):
    (tmp_path / "00000000000000000000.json").write_text('{"add": {"path": "a"}}\n{"add": {"path": "b"}}\n{"remove": {"path": "a"}}\n{"add": {"path": "a"}}\n')
    (tmp_path / "00000000000000000001.json").write_text('{"remove": {"path": "b"}}\n{"add": {"path": "c"}, "remove": {"path": "c"}}\n{"add": {"path": "d"}}\n')
    assert sorted(r["path"] for r in src.delta_files(spark, f"file://{tmp_path}").collect()) == ["a", "d"]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(k, 10 * k, 1 + k % 2, bytes([k])) for k in range(10)], "seq long, timestamp_ns long, type_id int, payload binary")
    path, run = f"file://{tmp_path}", lambda sink: replay.ReplayPipeline(log).filter_types([1]).sink(sink).run()
    assert run(replay.parquet_sink(f"{path}/p", 2)).written == 5
    assert spark.read.parquet(f"{path}/p").count() == 5 and len(list((tmp_path / "p").glob("*.parquet"))) >= 3
    run(replay.csv_sink(f"{path}/c"))
    assert {(r["seq"], r["payload_len"]) for r in spark.read.csv(f"{path}/c", header=True).collect()} == {(str(k), "1") for k in range(0, 10, 2)}
    run(replay.queue_sink(f"{path}/q"))
    queue = spark.read.parquet(f"{path}/q")
    assert queue.columns == ["timestamp_ns", "type_id", "payload"] and queue.where("timestamp_ns > 1600000000000000000").count() == 5
    assert run(replay.null_sink).written == 5
    with pytest.raises(ValueError):
        replay.parquet_sink(path, 0)


def test_replay_by_symbol_flushes_at_the_end(spark):
    log = spark.createDataFrame([(k % 3, k) for k in range(30)], "market_id long, seq long").repartition(4)

    def handler(frames):
        now, total = None, 0
        for f in frames:
            for m, s in f.itertuples(index=False):
                if m != now:
                    if now is not None:
                        yield pd.DataFrame({"market_id": [now], "total": [total]})
                    now, total = m, 0
                total = total * 31 % 1000003 + s  # depends on the order
        if now is not None:
            yield pd.DataFrame({"market_id": [now], "total": [total]})

    want = {}
    for k in range(30):
        want[k % 3] = want.get(k % 3, 0) * 31 % 1000003 + k
    assert {r["market_id"]: r["total"] for r in replay.replay_by_symbol(log, handler, "market_id long, total long").collect()} == want


def test_tables_are_created_once_and_written_by_partition(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = Table.create(spark, path, [("symbol", "string"), ("n", "int")])
    with pytest.raises(PySparkException):
        Table.create(spark, path, [("symbol", "string")])
    rows = spark.createDataFrame([(2, 20), (1, 30)], "seq long, timestamp_ns long")
    t.write(rows, {"symbol": "a b", "n": 1})
    t.write(rows, {"symbol": "a b", "n": 1})
    again = Table.open(spark, path)
    assert again.scheme == t.scheme and [r["seq"] for r in again.reader({"symbol": "a b", "n": 1}).collect()] == [1, 1, 2, 2]
    for values in ({"symbol": "a", "n": "1"}, {"symbol": "a"}, {"symbol": "a", "n": 1, "x": 2}):
        with pytest.raises(ValueError):
            t.write(rows, values)
    with pytest.raises(ValueError):
        t.write_rolling(rows, {"symbol": "a"})


def test_monitoring_windows_of_a_stream(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([(k * 10**9, float(k)) for k in range(20)], "timestamp_ns long, value double").coalesce(1).write.parquet(path)
    out = stateful.monitored(stateful.read_log(spark, path, "timestamp_ns long, value double"), "10 seconds", "value", "0 seconds")
    q = out.writeStream.format("memory").queryName("monitored").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["quantiles"][0]) for r in spark.table("monitored").collect()) == [(10, 4.0), (10, 14.0)]


def test_triggers_always_and_in_turn(spark):
    df = spark.createDataFrame([(1, k, k * 50, 1 if k == 3 else 2) for k in range(8)], "market_id long, seq long, timestamp_ns long, ev int")
    fired = lambda *t: [r["seq"] for r in features.emitted(df, "market_id", *t).orderBy("seq").collect()]
    assert fired(features.always()) == list(range(8))
    assert fired(features.time_bar(100)) == [1, 2, 4, 6]  # timestamp 0 never emits
    assert fired(features.event_type(1), features.time_bar(100)) == [1, 2, 3, 4, 6]
    assert [r["seq"] for r in snapshots.planned(df.withColumn("size", F.lit(10)), "market_id", size=25, first=False).orderBy("seq").collect()] == [2, 5]
    assert [r["seq"] for r in snapshots.planned(df, "market_id", records=4).orderBy("seq").collect()] == [3, 7] and snapshots.planned(df, "market_id").count() == 0


def test_l3_stream_in_two_batches(spark, tmp_path):
    rng = random.Random(6)
    names = "market_id long, ord long, event_type int, side int, flags int, order_id long, bid_order_id long, ask_order_id long, price long, qty long"
    rows, live = [], []
    for k in range(200):
        kind = rng.choice([1, 1, 1, 2, 3, 4]) if live else 1
        order = k + 1 if kind == 1 else rng.choice(live)
        live += [order] if kind == 1 else []
        rows.append((k % 2, k, kind, rng.choice([1, 2]), rng.choice([0, 0, 0, 1]), order, 0, 0, rng.choice([0, 100, 101, 102, 103]) if kind != 2 else 0, rng.choice([0, 1, 5])))
    want, books = {}, {}
    for m, k, *event in rows:
        book = books.setdefault(m, book_l3.Book())
        book.apply(*event[:3], *event[3:])
        want[m, k] = book.best()
    cut = lambda lo, hi: spark.createDataFrame(rows[lo:hi], names)
    got = batches(spark, f"file://{tmp_path}", [cut(0, 90), cut(90, 200)], stateful.l3_quotes, "l3").collect()
    assert {(r["market_id"], r["ord"]): (r["best_bid"], r["best_ask"]) for r in got} == want
    final = {(r["market_id"], r["side"], r["price"]): (r["qty"], r["queue_len"]) for r in book_l3.final_books(cut(0, 200)).where("kind = 'level'").collect()}
    assert final == {(m, s, p): (v[0], sum(v[1].values())) for m, b in books.items() for (s, p), v in b.levels.items()}
    again = book_l3.Book().load(books[0].dump())
    assert again.orders == books[0].orders and again.levels == books[0].levels
    holes = spark.createDataFrame([(1, 1, 6, 0, 0, 0, 0, 0, 0, 0, 1), (1, 2, 6, 0, 0, 0, 0, 0, 0, 0, 3)], names + ", seq long")
    assert book_l3.final_books(holes).count() == 0
    with pytest.raises((PySparkException, Py4JJavaError), match="missing 1"):
        book_l3.final_books(holes, gap_policy="panic").collect()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("unknown", ["skip", "fail"])
def test_l3_final_books_equal_one_book_without_holding_it(spark, monkeypatch, strict, unknown):
    """Two folds, by order and by level, equal a whole book fed event by event, also with resets, repeated adds and trades of two
    orders; and no fold has a market's orders together."""
    rng = random.Random(11)
    names = "market_id long, ord long, event_type int, side int, flags int, order_id long, bid_order_id long, ask_order_id long, price long, qty long"
    rows, books, known = [], {}, {}
    for k in range(3000):
        m = k % 3
        book, live = books.setdefault(m, book_l3.Book(unknown, strict)), known.setdefault(m, [])
        kind = 5 if k in (700, 701, 1500) else rng.choice([1, 1, 1, 2, 3, 4, 4, 6]) if live else 1
        pick = lambda: rng.choice([x for x in live if x in book.orders] or [0]) if unknown == "fail" else rng.choice([*live[-40:], 0, 99999])  # noqa: B023, E731
        order = rng.choice([k + 1, k + 1, k + 1, *live[-2:]]) if kind == 1 else pick()
        bid, ask = (pick(), pick()) if kind == 4 and rng.random() < 0.5 else (0, 0)
        if unknown == "fail" and bid == ask:
            ask = 0
        live += [order] if kind == 1 else []
        event = (kind, rng.choice([0, 1, 2]), rng.choice([0, 0, 0, 1]), order, bid, ask, rng.choice([0, 100, 101, 102]), rng.choice([0, 1, 5]))
        book.apply(*event)
        rows.append((m, k, *event))
    want = sorted((x for m, b in books.items() for x in b.rows(m)), key=str)
    df = spark.createDataFrame(rows, names).repartition(7)
    held = set()
    assert sorted((tuple(r) for r in book_l3.final_books(df, unknown, strict).collect()), key=str) == want and len(want) > 15
    apply = book_l3.Book.apply
    monkeypatch.setattr(book_l3.Book, "apply", lambda self, *event: (apply(self, *event), held.add(len(self.orders)))[0])
    fold = book_l3._by_order("skip", strict)
    made = [(0, 0, k, k, 0, 1, 1, 1, 0, 100, 5) for k in range(1, 500)]
    kinds = "market_id long, epoch int, order long, ord long, sub int, live int, event_type int, side int, flags int, price long, qty long"
    changes = list(fold(iter([book_l3._batch(made, kinds)])))
    assert sum(b.num_rows for b in changes) == 3 * 499 and max(held) == 1


def test_by_channel_deals_a_long_channel_over_tasks(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 50 == 49).cast("long").alias("ChannelNo"), (F.col("id") * 7919 % 20_000).alias("ApplSeqNum"))
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        got = src.by_channel(df).select("*", F.spark_partition_id().alias("p")).collect()
        src.channel_sink(f"file://{tmp_path}/out")(df)
    finally:
        spark.conf.unset(off)
    keys = [(r["ChannelNo"], r["ApplSeqNum"]) for r in got]
    assert keys == sorted((r["ChannelNo"], r["ApplSeqNum"]) for r in df.collect())
    sizes = {p: sum(r["p"] == p for r in got) for p in {r["p"] for r in got}}
    assert len(sizes) == 4 and max(sizes.values()) < 10_000  # one channel has 19,600 of the rows
    files = sorted((tmp_path / "out" / "ChannelNo=0").glob("part-*.csv"))
    lines = [int(x) for f in files for x in f.read_text().split()[1:]]
    assert len(files) > 1 and lines == sorted(lines) and len(lines) == 19_600


def test_l3_queries_deal_by_order_and_level_not_by_market(spark):
    """A market is never one task: its events are dealt by order, then by level."""
    from tideline import queries_more
    from tideline.queries import QUERIES

    assert queries_more
    for name in ("l3_book_final", "l3_life_cycles"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(market_id#\d+L?, \d+\)", plan)
        assert re.search(r"hashpartitioning\(market_id#\d+L?, order#\d+L?,", plan) and re.search(r"hashpartitioning\(market_id#\d+L?, side#\d+, price#\d+L?,", plan)
