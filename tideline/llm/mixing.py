"""Mixing sources to target weights (operator 7): pivotal dependent rounding through a reduction tree.

Every document of a source starts with the same expected number of copies, target / size of its source. The whole part is
certain. The fractional parts are rounded by the pivotal method: two documents meet, and a random transfer of *words*
(p_i s_i + p_j s_j stays as it is) makes one of the two probabilities 0 or 1, with odds that keep the expectation of
each; the other one goes on. So a source's taken words stay at its target, but for the last document left.

Tree: the documents of a source are dealt by hash into leaves of about LEAF documents, each rounds its own in one pass
and passes one document on; FAN of these meet on each next level, until one is left, which is rounded by chance. A hot
source has more leaves, not a larger one. All random numbers are hashes of doc_id, level and SEED, so reruns agree.

A null text has size 0. A null source is a source of its own, after all others. An empty document takes the whole part
of its source's rate. Documents with one doc_id or none are separate ones, also if they are equal. Sources whose texts have
no words have target 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, Scratch, lean, table

BLANK = r"[\x20\x09-\x0D]"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
LEAF = 4_000
FAN = 256
SEED = 17
#: Sources whose targets are joined by broadcast; beyond it they go by a shuffle.
BROADCAST_SOURCES = 10_000
#: Sources whose targets are computed on the driver; more are computed by the executors.
DRIVER_SOURCES = 10_000
_CLOSE = 1e-9


def water_fill(sizes: list[float], weights: list[float], total: float) -> list[float]:
    """Targets in proportion to the weights, none above MOST times its size; the excess goes to the others."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > MOST * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = MOST * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size). Up to DRIVER_SOURCES sources are filled on the driver, more by rounds of sums."""
    spark = sized.sparkSession
    sums = Scratch(spark).keep(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    if sums.limit(DRIVER_SOURCES + 1).count() > DRIVER_SOURCES:
        return _many_targets(sums)
    rows = sums.orderBy(F.col("source").asc_nulls_last()).collect()
    made = water_fill([float(r["size"]) for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], SHARE * sum(r["size"] for r in rows))
    return spark.createDataFrame([(r["source"], int(r["size"]), t) for r, t in zip(rows, made, strict=True)], "source string, source_size long, target double")


def _many_targets(sums: DataFrame) -> DataFrame:
    """The same for any number of sources: their places in order by ranges, and water_fill's rounds as sums over the sources left."""
    scratch = Scratch(sums.sparkSession)
    # the ranges are written, so that they are the same for all that follows
    ranged = scratch.keep(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = (F.col("place") + F.col("start") - 1) % len(WEIGHTS)
    weight = F.array(*map(F.lit, WEIGHTS))[at.cast("int")]
    rows = scratch.keep(ranged.withColumn("place", place).join(F.broadcast(starts), "range").select("source", "size", weight.alias("weight")), "weighted")
    left = SHARE * (rows.agg(F.sum("size")).first()[0] or 0)
    open_, most = (F.col("size") > 0), MOST * F.col("size")
    unit = None
    while True:
        # a source that was full stays full, as the unit only grows
        full = F.lit(False) if unit is None else F.lit(unit) * F.col("weight") > most
        taken, weights = rows.where(open_).agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (left - (taken or 0.0)) / weights if weights else float("inf")
        if unit == now or not weights:
            unit = now if weights else unit
            break
        unit = now
    share = F.lit(0.0) if unit is None else F.least(F.lit(unit) * F.col("weight"), most)
    return rows.select("source", F.col("size").cast("long").alias("source_size"), F.when(open_, share).otherwise(0.0).alias("target"))


def _chance(key: int | None, row: int, level: int) -> float:
    h = hashlib.blake2b(f"{SEED}:{key}:{row}:{level}".encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") / 2.0**64


def _round(group: pd.DataFrame, level: int) -> Iterator[tuple[int, float, bool]]:
    """(row number, probability, settled) of one leaf's documents, in order."""
    held = None  # row, probability, size
    for k, (key, row, p, s) in enumerate(zip(group["doc_id"], group["row"], group["p"], group["size"], strict=True)):
        if p <= _CLOSE or p >= 1 - _CLOSE:
            yield k, float(p > 0.5), True
        elif held is None:
            held = (k, p, s)
        else:
            j, q, r = held
            # moving x words: p + x / s and q - x / r, or the other way round
            up, down = min((1 - p) * s, q * r), min(p * s, (1 - q) * r)
            if _chance(key, row, level) * (up + down) < down:
                p, q = p + up / s, q - up / r
            else:
                p, q = p - down / s, q + down / r
            mine, other = (p <= _CLOSE or p >= 1 - _CLOSE), (q <= _CLOSE or q >= 1 - _CLOSE)
            if other:
                yield j, float(q > 0.5), True
                held = None if mine else (k, p, s)
                if mine:
                    yield k, float(p > 0.5), True
            else:
                yield k, float(p > 0.5), True
                held = (j, q, r)
    if held is not None:
        yield held[0], held[1], False


STATE = "doc_id long, row long, source string, size double, p double, leaf long, settled boolean"


def _level(rows: DataFrame, level: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            group = held["group"]
            cut = int((group != group.iloc[-1]).sum()) if len(held) else 0
            if cut:
                yield from done(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from done(held)

    def done(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = b.drop(columns=["group"]).reset_index(drop=True)
        for _, g in b.reset_index(drop=True).groupby("group", sort=False):
            at = g.index.to_numpy()
            for k, p, settled in _round(g, level):
                out.at[at[k], "p"] = p
                out.at[at[k], "settled"] = settled
        yield out

    keyed = rows.withColumn("group", F.xxhash64("source", F.coalesce(F.col("source").isNull(), F.lit(True)), "leaf"))
    return keyed.repartition(parts, "group").sortWithinPartitions("group", "doc_id", "row").mapInPandas(lean(run), STATE)


def mix(sized: DataFrame) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, copies) from (doc_id, row, source, size); row tells documents of one id apart."""
    spark = sized.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = scratch.keep(sized, "sized")
    goals = targets(sized)
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
    goals = goals.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    small = counts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    goals = goals.withColumnRenamed("source", "s")
    rated = sized.join(F.broadcast(goals) if small else goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(rate + _CLOSE)).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    leaf = F.pmod(F.xxhash64("doc_id", "row", F.lit(SEED)), F.ceil(F.col("n") / LEAF))
    live = F.col("size") > 0
    state = rated.where(live).select("doc_id", "row", "source", F.col("size").cast("double").alias("size"), "p", leaf.cast("long").alias("leaf"), F.lit(False).alias("settled"))
    done, level = [], 0
    leaves = sized.groupBy("source").count().agg(F.max(F.ceil(F.col("count") / LEAF))).first()[0] or 0
    while leaves:
        out = scratch.keep(_level(state, level, parts), f"level{level}")
        done.append(out.where("settled"))
        state = out.where("not settled").withColumn("leaf", F.expr(f"leaf div {FAN}"))
        level += 1
        if leaves == 1:
            break
        leaves = -(-leaves // FAN)
    if done:
        last = state.withColumn("p", F.when(F.pmod(F.xxhash64("doc_id", "row", F.lit(SEED + 1)), F.lit(1 << 30)) < F.col("p") * (1 << 30), 1.0).otherwise(0.0))
        taken = last
        for d in done:
            taken = taken.unionByName(d)
        taken = taken.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("p").alias("extra"))
        rated = rated.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    else:
        rated = rated.withColumn("extra", F.lit(0.0))
    return rated.select("doc_id", "row", "source", F.col("size").cast("long").alias("size"), "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long").alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, source, size); row is a hash of the text, with equal rows numbered."""
    # one mark for each word, then none for the blanks that end the text: no array of words is built
    marks = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANK + "*" + WORD, "w")
    size = F.length(F.regexp_replace(marks, BLANK + "+", "")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"))


def numbered(sized: DataFrame) -> DataFrame:
    """Makes (doc_id, row) unique: repeated rows become one row with their number, each of which is then counted up."""
    return sized.groupBy("doc_id", "row", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("row", F.when(F.col("k") == 1, F.col("row")).otherwise(F.xxhash64("row", "k"))).drop("n", "k")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(numbered(sizes(table(spark, sf_dir, "documents"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
