"""The registered queries of the market-event operators, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import book_l2, book_l3, catalog, features, filters, lifecycle, merge, snapshots
from tideline.plans import replay
from tideline.sources import messages as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HOUR = 3_600_000_000_000
JAN10 = 1_704_844_800_000_000_000
JAN20 = 1_705_708_800_000_000_000

M = """WITH m AS (SELECT event_id AS seq, epoch_us(ts)*1000 AS timestamp_ns, user_id % 8 AS market_id, event_type, value,
 CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 4 ELSE 2 END AS ev, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side,
 10000 + (event_id*7919) % 25 AS price, CASE WHEN event_type='purchase' THEN 0 ELSE CAST(floor(value*100) AS BIGINT) END AS size FROM events) """
KEEP = ("seq", "timestamp_ns", "market_id", "ev")
COLS = "seq, timestamp_ns, market_id, ev"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def over_messages(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql and M + sql)(lambda spark, sf_dir: f(src.messages(spark, sf_dir)))


# ---------------------------------------------------------------- scans, filters, seeks

over_messages("scan_messages", f"SELECT {COLS} FROM m", lambda m: m.select(*KEEP))
over_messages("type_filter", f"SELECT {COLS} FROM m WHERE ev IN (1, 4)", lambda m: filters.types(m, [1, 4], "ev").select(*KEEP))
over_messages(
    "time_range",
    f"SELECT {COLS} FROM m WHERE timestamp_ns >= {JAN10} AND timestamp_ns < {JAN20}",
    lambda m: filters.time_range(m, JAN10, JAN20).select(*KEEP),
)
over_messages(
    "sample_10th",
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM m WHERE ev = 2) WHERE k % 10 = "
    "0",
    lambda m: replay.ReplayPipeline.from_source(m).filter_types([2], "ev").sample(10).df.select(*KEEP),
)
over_messages(
    "sample_per_market",
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY seq) AS k FROM m) "
    "WHERE k % 7 = 0",
    lambda m: filters.sample(m, 7, stream="market_id").select(*KEEP),
)
over_messages(
    "seek_seq",
    f"SELECT {COLS} FROM m WHERE seq >= (SELECT min(seq) FROM m WHERE seq >= 4321)",
    lambda m: src.seek(m, "seq", 4321).select(*KEEP),
)
over_messages(
    "seek_timestamp",
    f"SELECT {COLS} FROM m WHERE seq >= (SELECT min(seq) FROM m WHERE timestamp_ns >= {JAN10})",
    lambda m: src.seek(m, "timestamp_ns", JAN10).select(*KEEP),
)
over_messages(
    "seek_scan",
    f"SELECT {COLS} FROM m WHERE seq >= (SELECT min(seq) FROM m WHERE timestamp_ns >= {JAN10}) AND seq < "
    f"(SELECT min(seq) FROM m WHERE timestamp_ns >= {JAN20})",
    lambda m: src.seek_scan(m, "timestamp_ns", JAN10, JAN20).select(*KEEP),
)
over_messages(
    "seek_result",
    f"SELECT CASE WHEN min(timestamp_ns) > {JAN10} THEN 'BeforeStart' WHEN max(timestamp_ns) >= {JAN10} THEN "
    f"'Found' ELSE 'EndOfLog' END AS result, min(seq) FILTER (timestamp_ns >= {JAN10}) AS position FROM m",
    lambda m: src.seek_result(m, JAN10),
)
over_messages("drain_available", f"SELECT {COLS} FROM m ORDER BY seq LIMIT 500", lambda m: src.drain(m, 500).select(*KEEP))
over_messages(
    "csv_payload_len",
    "SELECT seq, timestamp_ns, ev AS type_id, length(event_type) AS payload_len FROM m",
    lambda m: replay.csv_rows(m.withColumn("type_id", F.col("ev")).withColumn("payload", F.col("event_type"))),
)

# ---------------------------------------------------------------- partitions and merges

over_messages(
    "partition_exact",
    f"SELECT {COLS} FROM m WHERE market_id = 3 AND event_type = 'click'",
    lambda m: m.where(filters.Exact({"market_id": 3, "event_type": "click"}).column(["market_id", "event_type"])).select(
        *KEEP,
    ),
)
over_messages(
    "partition_in",
    f"SELECT {COLS} FROM m WHERE CAST(market_id AS VARCHAR) IN ('1', '5')",
    lambda m: m.where(filters.In("market_id", (1, 5)).column(["market_id"])).select(*KEEP),
)
over_messages(
    "partition_range_lex",
    f"SELECT {COLS} FROM m WHERE CAST(seq AS VARCHAR) BETWEEN '10' AND '20'",
    lambda m: m.where(filters.Range("seq", "10", "20").column(["seq"])).select(*KEEP),
)
over_messages(
    "partition_and",
    f"SELECT {COLS} FROM m WHERE CAST(market_id AS VARCHAR) IN ('1', '2', '5') AND CAST(market_id AS VARCHAR) "
    "BETWEEN '2' AND '7'",
    lambda m: m.where(
        filters.And((filters.In("market_id", (1, 2, 5)), filters.Range("market_id", "2", "7"))).column(
            ["market_id"],
        ),
    ).select(
        *KEEP,
    ),
)
over_messages("partitions", "SELECT DISTINCT market_id, event_type FROM m", lambda m: m.select("market_id", "event_type").distinct())
for _name, _kind, _tz, _fmt, _off in (("roll_date_shanghai", "date", "Asia/Shanghai", "%Y-%m-%d", 28800), ("roll_hour_ny_fixed", "hour", "America/New_York", "%Y-%m-%d-%H", -18000), ("roll_minute", "minute", "UTC", "%Y-%m-%d-%H-%M", 0)):
    over_messages(
        _name,
        f"SELECT seq, strftime(make_timestamp((timestamp_ns // 1000000000 + {_off}) * 1000000), '{_fmt}') AS part "
        "FROM m",
        lambda m, k=_kind, z=_tz: m.select("seq", scalar.roll(F.col("timestamp_ns"), k, z).alias("part")),
    )
over_messages(
    "rolling_stats",
    "SELECT market_id, count(*) AS messages_written, sum(c) AS partition_rolls, sum(c) + 1 AS "
    "partitions_written FROM (SELECT market_id, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY "
    "market_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM m) GROUP BY market_id",
    lambda m: merge.rolling_stats(m, "event_type", stream="market_id"),
)
_REGRESS = "timestamp_ns - (seq * 7919 % 13) * 60000000000"
over_messages(
    "merge_ordered",
    "SELECT seq, market_id, row_number() OVER (ORDER BY merge_ts, market_id, seq) AS position FROM (SELECT "
    f"*, max({_REGRESS}) OVER (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_ts FROM "
    "m)",
    lambda m: _positions(
        merge.merge_key(m.withColumn("timestamp_ns", F.expr(_REGRESS)), "market_id"),
        "merge_ts",
        "market_id",
        "seq",
    ),
)
over_messages(
    "merge_sequential",
    "SELECT seq, market_id, row_number() OVER (ORDER BY CAST(market_id AS VARCHAR), seq) AS position FROM m",
    lambda m: _positions(m, "market_id", "seq"),
)
over_messages(
    "fanin_merge",
    "SELECT seq, source, row_number() OVER (ORDER BY merge_ts, source, seq) AS position FROM (SELECT *, "
    "max(timestamp_ns) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_ts FROM "
    "(SELECT *, CASE ev WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS source FROM m))",
    lambda m: _positions(merge.fan_in([m.where(f"ev = {e}") for e in (1, 2, 4)]), "merge_ts", "source", "seq").withColumnRenamed(
        "market_id",
        "source",
    ),
)


def _positions(df: DataFrame, *by: str) -> DataFrame:
    """(seq, group, position) in the merged order, without one task that sorts all."""
    group = by[-2]
    return filters.numbered(df.select("seq", F.col(group).alias("market_id"), F.struct(*by).alias("_o")), "_o", "position").select("seq", "market_id", F.col("position").cast("long").alias("position"))


# ---------------------------------------------------------------- sequences

_HOLES = "seq % 17 <> 0"
over_messages(
    "gap_detect",
    "SELECT seq, market_id, seq // 8 AS n, lag(seq // 8) OVER (PARTITION BY market_id ORDER BY seq) AS prev, "
    "coalesce(seq // 8 <> lag(seq // 8) OVER (PARTITION BY market_id ORDER BY seq) + 1, false) AS is_gap "
    f"FROM m WHERE {_HOLES}",
    lambda m: filters.gaps(m.where(_HOLES).withColumn("n", F.expr("seq div 8")), "market_id", column="n").select(
        "seq",
        "market_id",
        "n",
        "prev",
        "is_gap",
    ),
)
over_messages(
    "gap_quarantine",
    f"SELECT seq FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM m WHERE {_HOLES}) WHERE p IS NULL "
    "OR seq = p + 1",
    lambda m: filters.apply_gap_policy(filters.gaps(m.where(_HOLES)), "quarantine").select("seq"),
)
over_messages(
    "last_gap",
    "SELECT market_id, arg_max(p, seq) AS gap_from, max(seq) AS gap_to FROM (SELECT market_id, seq, lag(seq) "
    f"OVER (PARTITION BY market_id ORDER BY seq) AS p FROM m WHERE {_HOLES}) WHERE seq <> p + 1 GROUP BY "
    "market_id",
    lambda m: filters.last_gap(filters.gaps(m.where(_HOLES), "market_id"), "market_id"),
)

# ---------------------------------------------------------------- dimension

_VERSIONS = (
    "SELECT market_id, k AS load_ord, market_id * 100 + k AS symbol_id, 1704067200000000 + k * 432000000000 AS "
    "valid_from_ts, 1704067200000000 + k * 432000000000 + CASE WHEN k % 2 = 0 THEN 604800000000 ELSE "
    "345600000000 END AS valid_until_ts FROM (SELECT DISTINCT user_id % 8 AS market_id FROM events) t, (SELECT "
    "{range}) r"
)


@query(
    "symbol_asof",
    M + (
        f", v AS ({_VERSIONS.format(range='unnest([0, 1, 2, 3, 4]) AS k')}), j AS (SELECT m.seq, m.market_id, "
        "v.symbol_id, row_number() OVER (PARTITION BY m.seq ORDER BY v.valid_from_ts DESC, v.load_ord DESC) AS r "
        "FROM m LEFT JOIN v ON m.market_id = v.market_id AND m.timestamp_ns // 1000 >= v.valid_from_ts AND "
        "m.timestamp_ns // 1000 < v.valid_until_ts) SELECT seq, market_id, CAST(symbol_id AS BIGINT) AS "
        "symbol_id FROM j WHERE r = 1"
    ),
)
def _symbol_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    versions = spark.sql(_VERSIONS.format(range="explode(array(0, 1, 2, 3, 4)) AS k").replace("FROM events", "FROM {events}"), events=events)
    return catalog.resolve(src.messages(spark, sf_dir), versions).select("seq", "market_id", F.col("symbol_id").cast("long").alias("symbol_id"))


@query(
    "symbol_code",
    "SELECT c_custkey, trim(regexp_replace(regexp_replace(translate(lower(c_name), '/: ', '---'), "
    "'[^a-z0-9._-]', '', 'g'), '-+', '-', 'g'), '-') AS code FROM customer",
)
def _symbol_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", scalar.symbol_code(F.col("c_name")).alias("code"))


@query("symbol_market_id")
def _symbol_market_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", scalar.market_id("c_name").alias("market_id"), scalar.symbol_hash("c_name").alias("hash"))


@query(
    "event_union_sorted",
    "SELECT ChannelNo, ApplSeqNum, Event FROM (SELECT o_custkey % 4 AS ChannelNo, o_orderkey AS ApplSeqNum, "
    "'ORDER' AS Event FROM orders UNION ALL SELECT l_suppkey % 4, l_orderkey, CASE l_returnflag WHEN 'R' "
    "THEN 'TRADE' WHEN 'A' THEN 'CANCEL' ELSE 'TICK' END FROM lineitem)",
)
def _event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 4 AS ChannelNo", "o_orderkey AS ApplSeqNum")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey % 4 AS ChannelNo", "l_orderkey AS ApplSeqNum", "CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN '4' ELSE '0' END AS ExecType")
    return src.by_channel(src.order_tick_union(o, t)).select("ChannelNo", "ApplSeqNum", "Event")


# ---------------------------------------------------------------- books, features, triggers

_BOOK = """, s AS (SELECT market_id, max(seq) AS since FROM m WHERE ev = 1 {cut} GROUP BY 1),
 l AS (SELECT m.market_id, side, price, arg_max(size, seq) AS size FROM m LEFT JOIN s USING (market_id) WHERE ev IN (1, 2) {cut} AND (since IS NULL OR seq >= since) GROUP BY 1, 2, 3),
 b AS (SELECT * FROM l WHERE size <> 0) """
over_messages("l2_book_final", _BOOK.format(cut="") + "SELECT * FROM b", book_l2.book_at)
over_messages("l2_book_asof", _BOOK.format(cut="AND seq <= 5000") + "SELECT * FROM b", lambda m: book_l2.book_at(m, 5000))
over_messages(
    "l2_top_n",
    _BOOK.format(cut="") + (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id, side ORDER BY CASE side WHEN 'B' "
        "THEN -price ELSE price END) AS level FROM b) WHERE level <= 3"
    ),
    lambda m: book_l2.top_levels(book_l2.book_at(m), 3),
)
# the state after each event, relationally: a level lives until its next change or the market's next snapshot
_STATES = """, e AS (SELECT * FROM m WHERE ev IN (1, 2)), n AS (SELECT *, min(CASE WHEN ev = 1 THEN seq END) OVER (PARTITION BY market_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns,
 lead(seq) OVER (PARTITION BY market_id, side, price ORDER BY seq) AS nl FROM e),
 live AS (SELECT market_id, side, price, size, seq AS a, least(coalesce(ns, 1000000000000000000), coalesce(nl, 1000000000000000000)) AS z FROM n WHERE size <> 0),
 x AS (SELECT e.seq, e.market_id, e.timestamp_ns, e.ev, l.side, l.price, l.size, row_number() OVER (PARTITION BY e.seq, l.side ORDER BY CASE l.side WHEN 'B' THEN -l.price ELSE l.price END) AS k
       FROM e LEFT JOIN live l ON e.market_id = l.market_id AND e.seq >= l.a AND e.seq < l.z),
 st AS (SELECT seq, market_id, timestamp_ns, ev, max(price) FILTER (side = 'B') AS best_bid, min(price) FILTER (side = 'S') AS best_ask,
        coalesce(sum(size) FILTER (side = 'B' AND k <= 5), 0) AS bs, coalesce(sum(size) FILTER (side = 'S' AND k <= 5), 0) AS asz,
        count(price) FILTER (side = 'B') AS bid_levels, count(price) FILTER (side = 'S') AS ask_levels FROM x GROUP BY 1, 2, 3, 4),
 f AS (SELECT seq, market_id, timestamp_ns, best_bid, best_ask, bid_levels, ask_levels, coalesce((best_bid / 100.0::DOUBLE + best_ask / 100.0::DOUBLE) * 0.5::DOUBLE, 0.0::DOUBLE) AS mid_price,
       coalesce((best_ask / 100.0::DOUBLE - best_bid / 100.0::DOUBLE) / ((best_bid / 100.0::DOUBLE + best_ask / 100.0::DOUBLE) * 0.5::DOUBLE) * 10000.0::DOUBLE, 0.0::DOUBLE) AS spread_bps,
       CASE WHEN bs + asz <> 0 THEN (bs - asz)::DOUBLE / (bs + asz)::DOUBLE ELSE 0.0::DOUBLE END AS imbalance FROM st) """
over_messages(
    "features_bbo",
    _STATES + (
        "SELECT market_id, seq, best_bid, best_ask, CAST(bid_levels AS INTEGER) AS bid_levels, CAST(ask_levels "
        "AS INTEGER) AS ask_levels FROM f"
    ),
    lambda m: book_l2.replay(m).select("market_id", "seq", "best_bid", "best_ask", "bid_levels", "ask_levels"),
)
over_messages(
    "mid_price",
    _STATES + "SELECT market_id, seq, timestamp_ns, mid_price FROM f",
    lambda m: features.features(book_l2.replay(m), features.mid_price()),
)
over_messages(
    "spread_bps",
    _STATES + "SELECT market_id, seq, timestamp_ns, spread_bps FROM f",
    lambda m: features.features(book_l2.replay(m), features.spread_bps()),
)
over_messages(
    "book_imbalance_5",
    _STATES + "SELECT market_id, seq, timestamp_ns, imbalance FROM f",
    lambda m: features.features(book_l2.replay(m), features.imbalance(5)),
)
_BAR = "timestamp_ns // 3600000000000"
over_messages(
    "bars_exchange_1h",
    f"SELECT {COLS} FROM (SELECT *, {_BAR} AS b, max({_BAR}) OVER (PARTITION BY market_id ORDER BY seq ROWS "
    "BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m WHERE ev = 2) WHERE seen IS NULL OR b > seen",
    lambda m: features.emitted(filters.types(m, [2], "ev"), "market_id", features.time_bar(HOUR)).select(*KEEP),
)
over_messages(
    "trigger_event_type",
    f"SELECT {COLS} FROM m WHERE ev = 1",
    lambda m: features.emitted(m, "market_id", features.event_type(1)).select(*KEEP),
)
over_messages(
    "trigger_any",
    f"SELECT {COLS} FROM (SELECT *, {_BAR} AS b, max(CASE WHEN ev <> 1 THEN {_BAR} END) OVER (PARTITION BY "
    "market_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) WHERE ev = 1 "
    "OR seen IS NULL OR b > seen",
    lambda m: features.emitted(m, "market_id", features.event_type(1), features.time_bar(HOUR)).select(*KEEP),
)
over_messages(
    "extract_features",
    _STATES + (
        f", g AS (SELECT *, {_BAR} AS b, max({_BAR}) OVER (PARTITION BY market_id ORDER BY seq ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f) SELECT market_id, seq, timestamp_ns, mid_price, "
        "spread_bps, imbalance FROM g WHERE seen IS NULL OR b > seen"
    ),
    lambda m: features.features(
        features.emitted(book_l2.replay(m), "market_id", features.time_bar(HOUR)),
        features.mid_price(),
        features.spread_bps(),
        features.imbalance(),
    ),
)

# ---------------------------------------------------------------- snapshots, refinery

_DAY = 24 * HOUR
over_messages(
    "snapshot_every_n",
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY seq) AS k FROM m) "
    "WHERE k % 50 = 0",
    lambda m: snapshots.every_n(m, 50, "market_id").select(*KEEP),
)
_CHAIN = f""", g AS (SELECT market_id, min(seq) AS seq FROM m GROUP BY 1 UNION ALL
 SELECT x.market_id, (SELECT min(y.seq) FROM m y WHERE y.market_id = x.market_id AND y.seq > x.seq AND y.timestamp_ns - x.t >= {_DAY}) FROM (SELECT g.market_id, g.seq, (SELECT timestamp_ns FROM m WHERE m.seq = g.seq) AS t FROM g WHERE g.seq IS NOT NULL) x)"""
_RM = M.replace("WITH m", "WITH RECURSIVE m")
query("snapshot_interval", _RM + _CHAIN + f" SELECT {COLS} FROM m WHERE seq IN (SELECT seq FROM g)")(
    lambda spark, sf_dir: snapshots.planned(src.messages(spark, sf_dir), "market_id", elapsed=_DAY).select(*KEEP),
)
query(
    "refinery_stream",
    _RM + _CHAIN + (
        ", o AS (SELECT seq, market_id, 1 AS part FROM m UNION ALL SELECT seq, market_id, 0 FROM m WHERE seq IN "
        "(SELECT seq FROM g)) SELECT seq, market_id, part, row_number() OVER (PARTITION BY market_id ORDER BY "
        "seq, part) - 1 AS out_seq FROM o"
    ),
)(
    lambda spark, sf_dir: snapshots.refine(src.messages(spark, sf_dir), _DAY).select("seq", "market_id", "part", "out_seq"),
)
over_messages(
    "snapshot_latest_before",
    "SELECT market_id, max(seq) AS seq FROM m WHERE ev = 1 AND seq <= 7000 GROUP BY 1",
    lambda m: snapshots.latest_before(m.where("ev = 1"), 7000).select("market_id", "seq"),
)
over_messages(
    "snapshot_retention",
    "SELECT seq, market_id FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY seq DESC) AS "
    "k, sum(size) OVER (PARTITION BY market_id ORDER BY seq DESC) AS b FROM m WHERE ev = 1) WHERE k <= 20 "
    "AND b <= 60000",
    lambda m: snapshots.retained(m.where("ev = 1"), "market_id", max_count=20, max_bytes=60000).select("seq", "market_id"),
)
over_messages(
    "l2_warm_start",
    _BOOK.format(
        cut=(
            "AND market_id = 3 AND seq <= coalesce("
            "(SELECT min(seq) FROM m WHERE market_id = 3 AND ev IN (1, 2) AND seq >= 6000), 1000000000000)"
        ),
    ) + "SELECT * FROM b WHERE market_id = 3",
    lambda m: book_l2.warm_start(m, m.where("ev = 1 and market_id = 3 and seq <= 6000"), 3, 6000, "seq"),
)

# ---------------------------------------------------------------- L3: orders add, lineitems trade


def _l3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 8 AS market_id", "o_orderkey * 16 AS ord", "1 AS event_type", "CAST(1 + o_orderkey % 2 AS INT) AS side", "o_orderkey + 1 AS order_id", "10000 + o_orderkey % 50 AS price", "100L AS qty")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey % 8 AS market_id", "l_orderkey * 16 + l_linenumber AS ord", "4 AS event_type", "0 AS side", "l_orderkey + 1 AS order_id", "0L AS price", "1L AS qty")
    return o.unionByName(t).withColumns({"flags": F.lit(0), "bid_order_id": F.lit(0).cast("long"), "ask_order_id": F.lit(0).cast("long")})


_L3 = (
    "WITH o AS (SELECT o_custkey % 8 AS market_id, o_orderkey AS order_id, 1 + o_orderkey % 2 AS side, 10000 + "
    "o_orderkey % 50 AS price, 100 - (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS qty FROM "
    "orders) "
)
query(
    "l3_book_final",
    _L3 + (
        "SELECT market_id, CAST(side AS INTEGER) AS side, price, CAST(sum(qty) AS BIGINT) AS qty FROM o GROUP BY "
        "1, 2, 3"
    ),
)(
    lambda spark, sf_dir: book_l3.final_books(_l3_events(spark, sf_dir)).where("kind = 'level'").select(
        "market_id",
        "side",
        "price",
        "qty",
    ),
)
query(
    "l3_unknown_orders",
    "SELECT o_custkey % 8 AS market_id, l_orderkey * 16 + l_linenumber AS ord, l_orderkey + 1 AS order_id "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_orderkey + 1) % 3 = 0",
)(
    lambda spark, sf_dir: book_l3.unknown_orders(_l3_events(spark, sf_dir).where("event_type = 4 or order_id % 3 <> 0")).select(
        "market_id",
        "ord",
        "order_id",
    ),
)

# ---------------------------------------------------------------- segments, lifecycle, monitoring

over_messages(
    "segment_stats",
    "SELECT seq // 1000 AS segment_id, min(seq) AS min_seq, max(seq) AS max_seq, min(timestamp_ns) AS "
    "min_ts, max(timestamp_ns) AS max_ts, count(*) AS n FROM m GROUP BY 1",
    lambda m: lifecycle.segment_stats(m, F.expr("seq div 1000")),
)
over_messages(
    "seek_index_stride",
    "SELECT segment_id, k AS record_index, seq, timestamp_ns FROM (SELECT *, seq // 1000 AS segment_id, "
    "row_number() OVER (PARTITION BY seq // 1000 ORDER BY seq) - 1 AS k FROM m) WHERE k % 64 = 0",
    lambda m: lifecycle.seek_index(m, F.expr("seq div 1000"), 64),
)
over_messages(
    "monitor_window",
    "SELECT timestamp_ns // 86400000000000 AS bucket, count(*) AS n, count(*) / 86400.0::DOUBLE AS rate, "
    "quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS "
    "p999, max(value) AS max_value FROM m GROUP BY 1",
    lambda m: lifecycle.monitor_windows(m, 86400, "value", exact=True),
)
over_messages(
    "symbol_parallel",
    "SELECT market_id % 3 AS worker, count(*) AS messages, count(DISTINCT market_id) AS symbols FROM m GROUP "
    "BY 1",
    lambda m: lifecycle.per_symbol(m, 3),
)
_READERS = (
    "SELECT 'r' || s_suppkey AS name, s_suppkey % 40 AS segment_id, s_suppkey * 7 % 1024 AS \"offset\", CASE "
    "WHEN s_suppkey % 5 = 0 THEN 1 ELSE 100000000000 END AS last_heartbeat_ns FROM supplier"
)


def _readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_READERS.replace('"offset"', "`offset`").replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


query("reader_lag", f"SELECT name, greatest(30720 - (segment_id * 1024 + \"offset\"), 0) AS lag FROM ({_READERS})")(
    lambda spark, sf_dir: lifecycle.reader_lag(_readers(spark, sf_dir), 30720, 1024),
)
query(
    "min_live_reader",
    f"SELECT coalesce(min(segment_id * 1024 + \"offset\"), 40960) AS position FROM ({_READERS}) WHERE "
    "110000000000 - last_heartbeat_ns <= 30000000000",
)(
    lambda spark, sf_dir: lifecycle.min_live_reader(_readers(spark, sf_dir), 40960, 1024, 110000000000),
)
_SEGMENTS = (
    "SELECT p_partkey AS segment_id, p_partkey % 7 <> 0 AS is_sealed, p_partkey % 5 = 0 AS is_compressed, "
    "1700000000 - p_partkey * 3600 AS created_at, 1700000000 - p_partkey * 1800 AS modified_at, CASE WHEN "
    "p_partkey % 3 = 0 THEN 1700000000 - p_partkey * 600 END AS last_accessed_at, p_size * 1000 AS size_bytes "
    "FROM part"
)
query(
    "lifecycle_policy",
    "SELECT segment_id, is_sealed AND NOT is_compressed AND 1700000000 - coalesce(last_accessed_at, "
    "modified_at) >= 7 * 86400 AS idle, is_sealed AND NOT is_compressed AND 1700000000 - created_at >= 2 * "
    f"86400 AS aged, is_sealed AND NOT is_compressed AND size_bytes >= 25000 AS large FROM ({_SEGMENTS})",
)(
    lambda spark, sf_dir: spark.sql(_SEGMENTS.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet")).select(
        "segment_id",
        lifecycle.should_compress("idle_after", 1700000000).alias("idle"),
        lifecycle.should_compress("age_after", 1700000000, days=2).alias("aged"),
        lifecycle.should_compress("size_threshold", 1700000000, size=25000).alias("large"),
    ),
)
over_messages("payload_checksum", None, lambda m: m.select("seq", scalar.payload_crc32(F.col("event_type")).alias("checksum")))
