"""Further registered queries: events of many levels, statuses, L3 life cycles, hashes, callbacks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import book_l2, book_l3, catalog, filters, lifecycle, merge, snapshots
from tideline.queries import COLS, HOUR, KEEP, M, ORACLE, over_messages, query
from tideline.sources import messages as src


def tables(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """sql over tables that it names in braces."""
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


# ---------------------------------------------------------------- events of many levels: orders and their lineitems

#: An order is an event of a market, its lineitems are the levels; every 40th order is a snapshot.
LEVELS = """SELECT o_custkey % 8 AS market_id, o_orderkey AS seq, o_orderkey * 1000000 AS timestamp_ns,
 CASE WHEN o_orderkey % 40 = 1 THEN 1 WHEN o_orderkey % 17 = 0 THEN 4 ELSE 2 END AS ev,
 CASE WHEN l_partkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, 1000 + l_partkey % 30 AS price,
 CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS size,
 ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS level_ord
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
_L = "WITH RECURSIVE m AS (" + LEVELS.replace("{", "").replace("}", "") + "), "
# of the levels of one event the last with a price counts; it lives until the price's next change or the market's next snapshot
_LIVE = """e AS (SELECT DISTINCT market_id, seq, ev FROM m WHERE {applied}),
 s AS (SELECT market_id, seq, lead(seq, 1, 1000000000000) OVER (PARTITION BY market_id ORDER BY seq) AS next_snapshot FROM e WHERE ev = 1),
 l AS (SELECT market_id, seq, side, price, arg_max(size, level_ord) AS size FROM m JOIN e USING (market_id, seq, ev) GROUP BY ALL),
 n AS (SELECT *, lead(seq, 1, 1000000000000) OVER (PARTITION BY market_id, side, price ORDER BY seq) AS next_change,
        (SELECT min(s.seq) FROM s WHERE s.market_id = l.market_id AND s.seq > l.seq) AS next_snapshot FROM l),
 live AS (SELECT market_id, side, price, size, seq AS a, least(next_change, coalesce(next_snapshot, 1000000000000)) AS z FROM n WHERE size <> 0),
 st AS (SELECT e.market_id, e.seq, max(price) FILTER (side = 'B') AS best_bid, min(price) FILTER (side = 'S') AS best_ask,
        CAST(count(price) FILTER (side = 'B') AS INTEGER) AS bid_levels, CAST(count(price) FILTER (side = 'S') AS INTEGER) AS ask_levels
        FROM e LEFT JOIN live ON e.market_id = live.market_id AND e.seq >= a AND e.seq < z GROUP BY 1, 2) """
STATE_COLUMNS = ("market_id", "seq", "best_bid", "best_ask", "bid_levels", "ask_levels")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, LEVELS, "lineitem", "orders")


@query("l2_events_multi", _L + _LIVE.format(applied="ev IN (1, 2)") + "SELECT * FROM st")
def _l2_events_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_l2.replay(levels(spark, sf_dir)).select(*STATE_COLUMNS)


_EVENTS = """v AS (SELECT *, lag(n) OVER (PARTITION BY market_id ORDER BY seq) AS p FROM (SELECT DISTINCT market_id, seq, ev, seq // 32 AS n FROM m)),
 w AS (SELECT *, CASE WHEN n <> p + 1 THEN 'Gap' WHEN ev NOT IN (1, 2) THEN 'UnsupportedEvent' END AS skipped FROM v) """


@query(
    "l2_statuses",
    _L + _EVENTS + (
        "SELECT market_id, n AS seq, min(seq) AS first_seq, any_value(skipped) AS skipped FROM w GROUP BY 1, 2 "
        "HAVING count(*) = 1"
    ),
)
def _l2_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the quarantine policy, numbered so that they have gaps; only numbers that one event has."""
    rows = levels(spark, sf_dir).withColumn("first_seq", F.col("seq")).withColumn("seq", F.expr("seq div 32"))
    alone = rows.groupBy("market_id", "seq").agg(F.count_distinct("first_seq").alias("k"), F.min("first_seq").alias("first_seq")).where("k = 1")
    gapped = filters.gaps(rows.select("market_id", "seq", "first_seq").distinct(), "market_id", order="first_seq")
    told = filters.event_status(gapped.join(rows.select("market_id", "first_seq", "ev").distinct(), ["market_id", "first_seq"]).withColumns({"type_id": F.lit(0x1000), "header_ok": F.lit(True), "book_mode": F.lit(0), "event_type": F.col("ev")}))
    return told.join(alone.select("market_id", "seq"), ["market_id", "seq"]).select("market_id", "seq", "first_seq", "skipped")


_QUARANTINE = """t AS (SELECT *, lag(seq) OVER (PARTITION BY market_id ORDER BY seq) AS p FROM (SELECT DISTINCT market_id, seq, ev FROM m)),
 q AS (SELECT market_id, seq, CASE WHEN p IS NOT NULL AND seq <> p + 1 THEN 'Gap' WHEN ev NOT IN (1, 2) THEN 'UnsupportedEvent' END AS skipped FROM t) """


@query("l2_quarantine", _L + _QUARANTINE + "SELECT market_id, seq, skipped FROM q")
def _l2_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_l2.replay(levels(spark, sf_dir), gap_policy="quarantine", statuses=True).select("market_id", "seq", "skipped")


@query("l2_depth_10", _L + _LIVE.format(applied="ev IN (1, 2)") + """, r AS (SELECT e.market_id, e.seq, side, price, size,
 row_number() OVER (PARTITION BY e.market_id, e.seq, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS k
 FROM e JOIN live ON e.market_id = live.market_id AND e.seq >= a AND e.seq < z WHERE e.seq % 50 = 0)
 SELECT market_id, seq, CAST(sum(size) FILTER (side = 'B') AS BIGINT) AS bid_size, CAST(sum(size) FILTER (side = 'S') AS BIGINT) AS ask_size FROM r WHERE k <= 10 GROUP BY 1, 2""")
def _l2_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
    states = book_l2.replay(levels(spark, sf_dir), 10).where("seq % 50 = 0 and bid_levels + ask_levels > 0")
    return states.select("market_id", "seq", total("bid_sizes").alias("bid_size"), total("ask_sizes").alias("ask_size"))


@query("snapshot_levels", _L + _LIVE.format(applied="ev IN (1, 2)") + """, due AS (SELECT market_id, seq FROM e WHERE seq % 200 = 0)
 SELECT due.market_id, due.seq, side, price, size FROM due JOIN live ON due.market_id = live.market_id AND due.seq >= a AND due.seq < z""")
def _snapshot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books after chosen events, as level rows."""
    marked = levels(spark, sf_dir).withColumn("due", F.expr("seq % 200 = 0"))
    return snapshots.levels_of(book_l2.replay(marked, None)).select("market_id", "seq", "side", "price", "size")


# ---------------------------------------------------------------- sources, sampling, callbacks

over_messages("partition_all", f"SELECT {COLS} FROM m", lambda m: m.where(filters.All().column(["market_id"])).select(*KEEP))
over_messages(
    "for_each_available",
    f"SELECT {COLS} FROM m WHERE seq BETWEEN 1 AND 500 AND seq < coalesce((SELECT min(seq) FROM m WHERE seq "
    "BETWEEN 1 AND 500 AND price = 10024), 501)",
    lambda m: src.for_each_available(m.where("seq >= 1"), 500, F.expr("price <> 10024")).select(*KEEP),
)
over_messages(
    "start_after_commit",
    f"SELECT {COLS} FROM m WHERE seq > 9000",
    lambda m: src.start_at(m, "resume_strict", committed=9000).select(*KEEP),
)
over_messages(
    "partition_rolls",
    "SELECT seq, event_type, prev_part FROM (SELECT seq, event_type, lag(event_type) OVER (ORDER BY seq) AS "
    "prev_part FROM m) WHERE event_type <> prev_part",
    lambda m: merge.rolls(m, "event_type").where("event_type <> prev_part").select("seq", "event_type", "prev_part"),
)
over_messages(
    "gap_whole_log",
    "SELECT seq, prev FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM m WHERE seq % 17 <> 0) "
    "WHERE seq <> prev + 1",
    lambda m: filters.gaps(m.where("seq % 17 <> 0")).where("is_gap").select("seq", "prev"),
)
over_messages(
    "rolling_stats_whole_log",
    "SELECT count(*) AS messages_written, CAST(sum(c) AS BIGINT) AS partition_rolls, CAST(sum(c) + 1 AS "
    "BIGINT) AS partitions_written FROM (SELECT CASE WHEN event_type <> lag(event_type) OVER (ORDER BY seq) "
    "THEN 1 ELSE 0 END AS c FROM m)",
    lambda m: merge.rolling_stats(m, "event_type"),
)
over_messages("update_id_continuity", """, u AS (SELECT *, seq - seq % 3 AS first_id, seq + seq % 5 AS last_id FROM m WHERE seq % 11 <> 0),
 x AS (SELECT *, max(last_id) OVER (PARTITION BY market_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM u)
 SELECT seq, market_id, CASE WHEN l IS NULL THEN 'first' WHEN last_id <= l THEN 'stale' WHEN first_id > l + 1 THEN 'gap' ELSE 'next' END AS continuity FROM x""",
              lambda m: filters.update_gaps(m.where("seq % 11 <> 0").selectExpr("seq", "market_id", "seq - seq % 3 AS update_id_first", "seq + seq % 5 AS update_id_last"), "market_id").select("seq", "market_id", "continuity"))

_HEAD = (
    "seq % 9 = 0 AS is_gap, CASE WHEN seq % 7 = 0 THEN 4097 ELSE 4096 END AS type_id, seq % 13 <> 0 AS "
    "header_ok, CAST(seq % 11 = 0 AS INT) AS book_mode, ev AS event_type, CASE WHEN seq % 19 = 0 THEN 100 ELSE "
    "128 END AS record_len"
)
over_messages("event_status", f"""SELECT seq, CASE WHEN is_gap THEN 'Gap' WHEN type_id <> 4096 THEN 'NonBookEvent' WHEN NOT header_ok THEN 'Corrupt' WHEN book_mode <> 0 THEN 'UnsupportedMode'
 WHEN event_type NOT IN (1, 2) THEN 'UnsupportedEvent' END AS skipped FROM (SELECT seq, {_HEAD} FROM m)""",
              lambda m: filters.event_status(m.selectExpr("seq", *_HEAD.split(", "))).select("seq", "skipped"))
over_messages("l3_decode", f"""SELECT seq, CASE WHEN type_id <> 4096 THEN 'NonBookEvent' WHEN book_mode <> 1 THEN 'UnsupportedMode' WHEN event_type <> 2 THEN 'UnsupportedEvent'
 WHEN record_len <> 128 THEN 'Corrupt' END AS skipped FROM (SELECT seq, {_HEAD} FROM m)""",
              lambda m: filters.l3_status(m.selectExpr("seq", *_HEAD.split(", "))).select("seq", "skipped"))

over_messages("fanin_committed", """, s AS (SELECT *, CASE ev WHEN 1 THEN 0 ELSE 1 END AS source FROM m WHERE ev IN (1, 2) AND seq > CASE ev WHEN 1 THEN 4000 ELSE 7000 END),
 r AS (SELECT *, max(timestamp_ns) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_ts FROM s)
 SELECT seq, source, merge_ts FROM r""", lambda m: merge.fan_in([m.where("ev = 1"), m.where("ev = 2")], committed={0: 4000, 1: 7000}, ranges=True).select("seq", "source", "merge_ts"))  # fmt: skip
over_messages(
    "fanin_pending",
    "SELECT source, count(seq) AS pending FROM (VALUES (0, 1, 4000), (1, 2, 7000)) AS v(source, e, c) "
    "LEFT JOIN m ON ev = e AND seq > c GROUP BY source",
    lambda m: merge.pending([m.where("ev = 1"), m.where("ev = 2")], {0: 4000, 1: 7000}),
)

over_messages("symbol_names", """SELECT CASE WHEN ev <> 4 THEN 'MARKET_' || market_id ELSE 'TYPE_4097' END AS symbol, count(*) AS n FROM m GROUP BY 1""",
              lambda m: m.select(lifecycle.symbol_name(F.expr("CASE WHEN ev <> 4 THEN 4096 ELSE 4097 END"), F.col("market_id")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))

_DELTA = "SELECT lpad(CAST(o_orderkey // 100 AS VARCHAR), 20, '0') AS file, o_orderkey % 100 AS line, CASE WHEN o_custkey % 3 = 0 THEN 'remove' ELSE 'add' END AS act, 'part-' || o_custkey % 500 AS path FROM orders"


@query("delta_active_files", f"SELECT path FROM (SELECT path, arg_max(act, file || lpad(CAST(line AS VARCHAR), 5, '0')) AS act FROM ({_DELTA}) GROUP BY path) WHERE act = 'add'")
def _delta_active_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables(spark, sf_dir, _DELTA.replace("//", "div").replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), "orders")
    return src.live_files(log.select("file", "line", F.concat(F.lit('{"'), "act", F.lit('": {"path": "'), "path", F.lit('"}}')).alias("value")))


# ---------------------------------------------------------------- statistics

over_messages(
    "sample_quantile",
    "SELECT value AS quantile FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER "
    "() AS n FROM m) WHERE k = CAST(floor(n * 0.99) AS BIGINT)",
    lambda m: lifecycle.sample_quantile(m, "value", 0.99),
)
over_messages("extractor_stats", """SELECT count(*) AS messages, count(*) FILTER (ev IN (1, 2)) AS events, count(*) FILTER (ev NOT IN (1, 2)) AS skipped, count(*) FILTER (ev IN (1, 2) AND seq % 10 = 0) AS rows,
 CAST(ceil(count(*) FILTER (ev IN (1, 2) AND seq % 10 = 0) / 64.0) AS BIGINT) AS batches FROM m""", lambda m: lifecycle.extractor_stats(m, 64, F.expr("seq % 10 = 0")))  # fmt: skip


@query("lifecycle_totals", """SELECT count(*) AS scanned, count(*) FILTER (done) AS compressed, CAST(sum(CASE WHEN done THEN greatest(a - b, 0) ELSE 0 END) AS BIGINT) AS bytes_saved, count(*) FILTER (e) AS errors
 FROM (SELECT p_partkey % 3 = 0 AS done, p_size * 10 AS a, p_partkey % 400 AS b, p_partkey % 11 = 0 AS e FROM part)""")
def _lifecycle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tables(spark, sf_dir, "SELECT p_partkey % 3 = 0 AS compressed, p_size * 10L AS size_before, p_partkey % 400 AS size_after, CASE WHEN p_partkey % 11 = 0 THEN 'x' END AS error FROM {part}", "part")
    return lifecycle.lifecycle_totals(runs)


_READERS = (
    "SELECT 'r' || s_suppkey AS name, 5 + s_suppkey % 40 AS segment_id, s_suppkey * 7 % 1024 AS \"offset\", CASE "
    "WHEN s_suppkey % 5 = 0 THEN 1 ELSE 100000000000 END AS last_heartbeat_ns FROM supplier"
)


@query("removable_segments", f"""SELECT p_partkey AS segment_id FROM part WHERE p_partkey < 40 AND p_partkey <
 (SELECT coalesce(min(segment_id * 1024 + "offset"), 40960) FROM ({_READERS}) WHERE 110000000000 - last_heartbeat_ns <= 30000000000) // 1024""")
def _removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = tables(spark, sf_dir, _READERS.replace('"offset"', "`offset`").replace("FROM supplier", "FROM {supplier}"), "supplier")
    segments = tables(spark, sf_dir, "SELECT p_partkey AS segment_id FROM {part}", "part")
    return lifecycle.removable_segments(segments, readers, 40960, 1024, 110_000_000_000)


@query("writer_status", """SELECT 'w' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'gone' WHEN 100000000000 - s_suppkey * 1000000000 <= 30000000000 THEN 'live' ELSE 'stale' END AS status FROM supplier""")
def _writer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers = tables(spark, sf_dir, "SELECT 'w' || s_suppkey AS name, s_suppkey % 4 <> 0 AS locked, s_suppkey * 1000000000 AS last_heartbeat_ns FROM {supplier}", "supplier")
    return lifecycle.writer_status(writers, 100_000_000_000)


@query("discovery", """SELECT 'q' || c_custkey AS path, 'added' AS change FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0
 UNION ALL SELECT 'q' || c_custkey, 'removed' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tables(spark, sf_dir, "SELECT 'q' || c_custkey AS path, c_custkey FROM {customer}", "customer")
    return lifecycle.discovery(paths.where("c_custkey % 2 = 0").select("path"), paths.where("c_custkey % 3 = 0").select("path"))


# ---------------------------------------------------------------- dimension, refinery

_V = (
    "SELECT DISTINCT user_id % 8 AS market_id, 0 AS load_ord, user_id % 8 + 500 AS symbol_id, 0 AS "
    "valid_from_ts, 4102444800000000 AS valid_until_ts FROM {events}"
)


@query("symbol_complete", M + "SELECT seq, market_id + 500 AS symbol_id FROM m")
def _symbol_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row has a version, or the query fails."""
    return catalog.resolve_all(src.messages(spark, sf_dir), tables(spark, sf_dir, _V, "events")).select("seq", "symbol_id")


_CHAIN = f""", b AS (SELECT * FROM m WHERE seq % 6 <> 0), g AS (SELECT market_id, min(seq) AS seq FROM b GROUP BY 1 UNION ALL
 SELECT x.market_id, (SELECT min(y.seq) FROM b y WHERE y.market_id = x.market_id AND y.seq > x.seq AND y.timestamp_ns - x.t >= {12 * HOUR})
 FROM (SELECT g.market_id, g.seq, (SELECT timestamp_ns FROM b WHERE b.seq = g.seq) AS t FROM g WHERE g.seq IS NOT NULL) x),
 o AS (SELECT seq, market_id, 1 AS part FROM b UNION ALL SELECT seq, market_id, 0 FROM b WHERE seq IN (SELECT seq FROM g))"""


@query("refinery_book_events", M.replace("WITH m", "WITH RECURSIVE m") + _CHAIN + """
 SELECT seq, market_id, market_id + 500 AS symbol_id, part, row_number() OVER (PARTITION BY market_id ORDER BY seq, part) - 1 AS out_seq FROM o""")
def _refinery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another type are dropped; the others are resolved and get snapshots."""
    m = src.messages(spark, sf_dir).withColumn("type_id", F.expr("CASE WHEN seq % 6 = 0 THEN 4097 ELSE 4096 END"))
    return snapshots.refine(m, 12 * HOUR, versions=tables(spark, sf_dir, _V, "events")).select("seq", "market_id", "symbol_id", "part", "out_seq")


# ---------------------------------------------------------------- hashes, text, times

_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::HUGEINT)),
 lambda h, b: (xor(h, b) * 1196076331647965444::HUGEINT) % 18446744073709551616::HUGEINT)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


@query(
    "symbol_version_id",
    "SELECT c_custkey, CAST(" + _FNV.format(text="c_custkey || ':' || c_custkey * 10 || ':' || (c_custkey * 10 + 7)") + " AS DECIMAL(20, 0)) AS version_id FROM customer",
)
def _version_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir, "SELECT c_custkey FROM {customer}", "customer")
    return c.select("c_custkey", scalar.version_id(F.col("c_custkey"), F.col("c_custkey") * 10, F.col("c_custkey") * 10 + 7).alias("version_id"))


@query("text_fields", "SELECT o_orderkey, 'k' || o_custkey AS sym, CAST(o_orderkey * 3 AS VARCHAR) AS px FROM orders")
def _text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, "SELECT o_orderkey, concat('sym=k', o_custkey, ' px=', o_orderkey * 3) AS payload FROM {orders}", "orders")
    kv = scalar.key_values(F.col("payload"))
    return o.select("o_orderkey", kv["sym"].alias("sym"), kv["px"].alias("px"))


_STAMP = (
    "lpad(CAST(9 + o_orderkey % 7 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || "
    "lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"
)


@query("exchange_time", f"""SELECT o_orderkey, epoch_us(strptime(left(s, 14), '%Y%m%d%H%M%S')) * 1000 + CAST(right(s, 3) AS BIGINT) * 1000000 AS ns,
 CASE WHEN t >= 915 AND t < 925 THEN 'open' WHEN t >= 1457 AND t < 1500 THEN 'close' WHEN (t >= 930 AND t < 1130) OR (t >= 1300 AND t < 1457) THEN 'continuous' ELSE 'closed' END AS phase
 FROM (SELECT o_orderkey, '20240229' || {_STAMP} AS s, CAST(substr({_STAMP}, 1, 4) AS INTEGER) AS t FROM orders)""")
def _exchange_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir, f"SELECT o_orderkey, '20240229' || {_STAMP.replace('VARCHAR', 'STRING')} AS s FROM {{orders}}", "orders")
    return o.select("o_orderkey", scalar.exchange_time(F.col("s")).alias("ns"), scalar.auction_phase(F.col("s")).alias("phase"))


# ---------------------------------------------------------------- L3: orders that are cancelled, changed and traded

L3 = """SELECT o_custkey % 8 AS market_id, o_orderkey * 16 AS ord, 1 AS event_type, CAST(1 + o_orderkey % 2 AS INT) AS side, o_orderkey + 1 AS order_id, 10000 + o_orderkey % 50 AS price, 100L AS qty,
 CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS flags FROM {orders}
UNION ALL SELECT o_custkey % 8, o_orderkey * 16 + 1, 2, 0, o_orderkey + 1, 0, CASE WHEN o_orderkey % 3 = 0 THEN 0L ELSE 30L END, 0 FROM {orders} WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_custkey % 8, o_orderkey * 16 + 2, 3, 0, o_orderkey + 1, CASE WHEN o_orderkey % 2 = 0 THEN 10100 + o_orderkey % 7 ELSE 0 END, 60L, 0 FROM {orders} WHERE o_orderkey % 5 = 1"""
_L3 = """WITH o AS (SELECT o_custkey % 8 AS market_id, 1 + o_orderkey % 2 AS side, 10000 + o_orderkey % 50 AS price, 100 AS qty, o_orderkey AS k FROM orders WHERE o_orderkey % 23 <> 0),
 c AS (SELECT market_id, side, CASE WHEN k % 5 = 1 AND k % 2 = 0 THEN 10100 + k % 7 ELSE price END AS price,
       CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN 0 WHEN k % 5 = 0 THEN 70 WHEN k % 5 = 1 THEN 60 ELSE 100 END AS qty FROM o)
 SELECT market_id, CAST(side AS INTEGER) AS side, price, CAST(sum(qty) AS BIGINT) AS qty FROM c GROUP BY 1, 2, 3 HAVING sum(qty) > 0"""


def l3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, L3, "orders").withColumns({"bid_order_id": F.lit(0).cast("long"), "ask_order_id": F.lit(0).cast("long")})


@query("l3_life_cycles", _L3)
def _l3_life_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without the market flag that are added, partly or wholly cancelled, and changed in price and quantity."""
    rows = l3_events(spark, sf_dir)
    flagged = rows.where("event_type = 1 and flags = 1").select("order_id")
    return book_l3.final_books(rows.join(flagged, "order_id", "left_anti")).where("kind = 'level'").select("market_id", "side", "price", "qty")


# SQL of queries that are registered without it
ORACLE["payload_checksum"] = M + "SELECT seq, " + _CRC.format(text="event_type") + " AS checksum FROM m"
ORACLE["symbol_market_id"] = (
    "SELECT c_custkey, CAST(h AS DECIMAL(20, 0)) AS hash, CAST(xor(h // 4294967296, h % 4294967296) AS BIGINT) AS market_id "
    "FROM (SELECT c_custkey, " + _FNV.format(text="c_name") + " AS h FROM customer)"
)
