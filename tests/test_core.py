"""Small fixtures with results worked out by hand, and randomised comparisons with plain loops."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import book_l2, book_l3, catalog, features, filters, lifecycle, merge, snapshots
from tideline.plans.replay import ReplayPipeline, csv_rows, vec_sink
from tideline.plans.table import Table
from tideline.sources import messages as src


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def log(spark, stamps):
    return spark.createDataFrame([(i, t, i % 3, b"x" * i) for i, t in enumerate(stamps)], "seq long, timestamp_ns long, type_id int, payload binary")


@pytest.mark.parametrize(("target", "result", "position"), [(5000, "Found", 4), (500, "BeforeStart", 0), (20000, "EndOfLog", None)])
def test_seek_result(spark, target, result, position):
    assert rows(src.seek_result(log(spark, range(1000, 11000, 1000)), target), "result", "position") == [(result, position)]


def test_seek_is_positional(spark):
    df = log(spark, [1000, 3000, 2000, 4000])
    assert rows(src.seek(df, "timestamp_ns", 2500).orderBy("seq"), "timestamp_ns") == [(3000,), (2000,), (4000,)]
    assert rows(src.seek_scan(df, "timestamp_ns", 2500, 4000).orderBy("seq"), "timestamp_ns") == [(3000,), (2000,)]


def test_pipeline_counts_and_sampling_order(spark):
    out = []
    stats = ReplayPipeline.from_source(log(spark, range(100))).filter_types([1]).sample(10).sink(vec_sink(out)).run()
    assert (stats.read, stats.written, stats.filtered) == (100, 3, 97) and stats.seconds > 0 and stats.throughput > 0
    assert ReplayPipeline.from_source(log(spark, range(100))).filter_types([1]).run().written == 0
    holes = log(spark, range(10)).where("seq <> 4")
    assert [r["seq"] for r in ReplayPipeline(holes).gaps("quarantine").df.orderBy("seq").collect()] == [0, 1, 2, 3, 6, 7, 8, 9]
    with pytest.raises(Exception, match="missing 1"):
        ReplayPipeline(holes).gaps("panic").run()
    assert ReplayPipeline(holes).gaps("ignore").seek_seq(6).filter_types([1]).run().read == 4
    assert sorted(r["seq"] for r in out) == [28, 58, 88]
    assert rows(csv_rows(log(spark, [1, 2])).orderBy("seq"), "payload_len") == [(0,), (1,)]


def test_gaps(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 5), (0, 4, 6)], "stream int, ord int, seq long")
    g = filters.gaps(df, "stream", "ord")
    assert [r[0] for r in rows(g.orderBy("ord"), "is_gap")] == [False, False, True, False]
    assert rows(filters.last_gap(g, "stream", "ord"), "gap_from", "gap_to") == [(2, 5)]
    assert filters.apply_gap_policy(g, "quarantine").count() == 3
    with pytest.raises(Exception, match="sequence gap"):
        filters.apply_gap_policy(g, "panic").collect()


def test_merge_equals_a_heap(spark):
    rng = random.Random(1)
    parts = [[rng.randrange(50) for _ in range(rng.randrange(1, 30))] for _ in range(5)]
    heap, want = [(p[0], i, 0) for i, p in enumerate(parts)], []
    heapq.heapify(heap)
    while heap:
        t, i, k = heapq.heappop(heap)
        want.append((i, k))
        if k + 1 < len(parts[i]):
            heapq.heappush(heap, (parts[i][k + 1], i, k + 1))
    df = spark.createDataFrame([(i, k, t) for i, p in enumerate(parts) for k, t in enumerate(p)], "part int, seq int, timestamp_ns long")
    assert rows(merge.merge_ordered(df, "part"), "part", "seq") == want


def test_rolling_stats_count_changes(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "seq int, p string")
    assert rows(merge.rolling_stats(df, "p"), "messages_written", "partition_rolls", "partitions_written") == [(3, 2, 3)]


def test_filters_and_functions(spark):
    assert scalar.tz_offset("-0500") == -18000 and scalar.tz_offset("Asia/Shanghai") == 28800
    df = spark.createDataFrame([(1706486400000000000, " BTC/USDT ", 9)], "t long, s string, k int")
    got = df.select(scalar.roll(F.col("t"), "date"), scalar.roll(F.col("t") - 3_600_000_000_000, "date", "Asia/Shanghai"), scalar.symbol_code(F.col("s")), filters.Range("k", "10", "20").column(["k"]), filters.Exact({"k": 9}).column(["k", "x"])).first()
    assert tuple(got) == ("2024-01-29", "2024-01-29", "btc-usdt", False, False)
    assert (scalar.hash64("BTCUSDT") >> 32) ^ (scalar.hash64("BTCUSDT") & 0xFFFFFFFF) == 3467451262


def test_table(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", [("channel", "int"), ("date", "date")])
    with pytest.raises(Exception):
        Table.create(spark, f"file://{tmp_path}/t", [("channel", "int")])
    with pytest.raises(ValueError):
        t.validate({"channel": 1})
    day = 86_400_000_000_000
    t.write_rolling(log(spark, [1000, day + 1500, 2000]), {"channel": 101})
    t = Table.open(spark, f"file://{tmp_path}/t")
    assert t.partitions().count() == 2
    assert rows(t.query(filters.All()), "timestamp_ns") == [(1000,), (2000,), (day + 1500,)]
    assert t.query(filters.In("date", ("1970-01-02",))).count() == 1


def test_triggers(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([0, 5, 12, 8, 13, 25])], "seq int, timestamp_ns long, m int")
    assert rows(features.emitted(df, "m", features.time_bar(10)).orderBy("seq"), "timestamp_ns") == [(5,), (12,), (25,)]


def test_l2_fold_equals_relational_book(spark):
    rng = random.Random(2)
    events = [(i % 3, i, i * 10, rng.choice([1, 2, 2, 2, 2, 2, 2, 4]), rng.choice("BS"), rng.randrange(5), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(events, "market_id long, seq long, timestamp_ns long, ev int, side string, price long, size long")
    books = {m: ({}, {}) for m in range(3)}
    want = []
    for m, seq, _, ev, side, price, size in events:
        if ev == 4:
            continue
        if ev == 1:
            books[m] = ({}, {})
        levels = books[m][side == "S"]
        levels.pop(price, None)
        if size:
            levels[price] = size
        want.append((seq, max(books[m][0], default=None), min(books[m][1], default=None)))
    assert rows(book_l2.replay(df).orderBy("seq"), "seq", "best_bid", "best_ask") == want
    final = {(m, "BS"[k], p, s) for m, b in books.items() for k in (0, 1) for p, s in b[k].items()}
    assert set(rows(book_l2.book_at(df), "market_id", "side", "price", "size")) == final


def test_features(spark):
    df = spark.createDataFrame([(1, 1, 1, 100000, 100010, [200, 200], [100, 100]), (1, 2, 1, None, 100010, [], [])], "market_id int, seq int, timestamp_ns long, best_bid long, best_ask long, bid_sizes array<long>, ask_sizes array<long>")
    got = rows(features.features(df, features.mid_price(4), features.imbalance(2)).orderBy("seq"), "mid_price", "imbalance")
    assert got[0] == pytest.approx((10.0005, 1 / 3)) and got[1] == (0.0, 0.0)


def l3(spark, events):
    return spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], "market_id long, ord long, event_type int, side int, flags int, order_id long, bid_order_id long, ask_order_id long, price long, qty long")


def test_l3(spark):
    assert book_l3.final_books(l3(spark, [(1, 1, 0, 10, 0, 0, 100, 5), (2, 0, 0, 10, 0, 0, 0, 5)])).count() == 0
    trade = l3(spark, [(1, 1, 0, 1, 0, 0, 100, 10), (1, 2, 0, 2, 0, 0, 101, 10), (4, 0, 0, 0, 1, 2, 0, 5)])
    got = book_l3.final_books(trade)
    assert sorted(rows(got.where("kind = 'order'"), "order_id", "qty")) == [(1, 5), (2, 5)]
    assert sorted(rows(got.where("kind = 'level'"), "price", "qty", "queue_len")) == [(100, 5, 0), (101, 5, 0)]
    assert book_l3.final_books(l3(spark, [(1, 1, 1, 1, 0, 0, 100, 10)])).where("kind = 'level'").count() == 0
    assert rows(book_l3.final_books(l3(spark, [(1, 1, 0, 1, 0, 0, 100, 10)] * 2)).where("kind = 'level'"), "qty") == [(20,)]
    assert book_l3.unknown_orders(l3(spark, [(2, 0, 0, 7, 0, 0, 0, 1)])).count() == 1


def test_snapshots(spark):
    df = spark.createDataFrame([(0, i, 0, s) for i, s in ((1, 5), (2, 50), (3, 60), (4, 1))], "m int, seq int, timestamp_ns long, size long")
    assert rows(snapshots.planned(df, "m", records=10, size=100), "seq") == [(3,)]
    assert sorted(rows(snapshots.retained(df, "m", max_count=2), "seq")) == [(3,), (4,)]
    assert rows(snapshots.latest_before(df, 3, key="m"), "seq") == [(3,)]


def test_catalog(spark):
    v = spark.createDataFrame([(1, 101, 1000, 2000, 0), (1, 202, 2000, 10000, 1)], "market_id long, symbol_id long, valid_from_ts long, valid_until_ts long, load_ord int")
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([1_500_000, 2_000_000, 9_000_000, 10_000_000])], "market_id long, seq int, timestamp_ns long")
    assert rows(catalog.resolve(df, v).orderBy("seq"), "symbol_id") == [(101,), (202,), (202,), (None,)]
    with pytest.raises(Exception, match="no symbol version"):
        catalog.resolve_all(df, v).collect()


def test_delta_log(spark, tmp_path):
    (tmp_path / "0.json").write_text("\n".join(json.dumps(x) for x in ({"add": {"path": "a"}}, {"add": {"path": "b"}})))
    (tmp_path / "1.json").write_text(json.dumps({"remove": {"path": "a"}}))
    assert rows(src.delta_files(spark, f"file://{tmp_path}"), "path") == [("b",)]


def test_lifecycle(spark):
    df = spark.createDataFrame([(True, False, 0, 0, None, 10), (False, False, 0, 0, None, 10), (True, True, 0, 0, None, 10)], "is_sealed boolean, is_compressed boolean, created_at long, modified_at long, last_accessed_at long, size_bytes long")
    assert [r[0] for r in df.select(lifecycle.should_compress("idle_after", 8 * 86400).alias("c")).collect()] == [True, False, False]
    readers = spark.createDataFrame([("a", 1, 5, 0), ("b", 0, 0, 1)], "name string, segment_id long, offset long, last_heartbeat_ns long")
    assert rows(lifecycle.min_live_reader(readers, 5000, 1000, 10**12), "position") == [(1005,)]
