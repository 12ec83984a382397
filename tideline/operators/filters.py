"""Row filters, partition filters, sampling, sequence gaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def identity(df: DataFrame) -> DataFrame:
    return df


def time_range(df: DataFrame, start: int, end: int, column: str = "timestamp_ns") -> DataFrame:
    """Half open."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def types(df: DataFrame, kinds: list, column: str = "type_id") -> DataFrame:
    return df.where(F.col(column).isin(list(kinds)))


def sample(df: DataFrame, n: int, order: str = "seq", stream: str | None = None) -> DataFrame:
    """Every n-th of the rows that reach it. Numbered without one global sort task: ranges are counted, then numbered from
    the ranges before; with ``stream``, each stream is numbered alone."""
    if n < 1:
        raise ValueError("n must be positive")
    if stream is not None:
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(stream).orderBy(order))).where(F.col("_k") % n == 0).drop("_k")
    return numbered(df, order).where(F.col("_k") % n == 0).drop("_k")


def range_of(df: DataFrame, order: str, n: int | None = None) -> Column:
    """The number of the range that a row's position falls in (of a struct, its first field): bounds are computed once and stand
    in the plan as literals, so that every use of the column agrees, whatever Spark does with partitions."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[order].dataType
    at = F.col(order).getField(kind.fieldNames()[0]) if isinstance(kind, StructType) else F.col(order)
    bounds = sorted({int(b) for b in df.select(at.alias("_q")).approxQuantile("_q", [i / n for i in range(1, n)], 0.5 / n)}) if n > 1 else []

    def search(lo: int, hi: int) -> Column:
        """The number of bounds below the position, known to be lo at least and hi at most."""
        middle = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(at > bounds[middle], search(middle + 1, hi)).otherwise(search(lo, middle))

    return search(0, len(bounds))


def numbered(df: DataFrame, order: str, name: str = "_k", n: int | None = None) -> DataFrame:
    """Row numbers from 1 in a total order: ranges number their rows, after the number of rows in earlier ranges."""
    ranged = df.withColumn("_p", range_of(df, order, n))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    # one row for each range
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return local.join(F.broadcast(before.select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def carried(df: DataFrame, value: Column, how: str, name: str, order: str = "seq", n: int | None = None) -> DataFrame:
    """Adds what the rows before each row come to, in one total order: the ``last`` value, the ``max`` or the ``sum`` (null before the
    first row). No task sees the whole log: a window in each range, and one value for each range that the earlier ones leave."""
    fold = {"last": lambda v, o: F.max_by(v, o), "max": lambda v, o: F.max(v), "sum": lambda v, o: F.sum(v)}[how]
    both = {"last": F.coalesce, "max": F.greatest, "sum": lambda a, b: F.coalesce(a + b, a, b)}[how]
    ranged = df.withColumn("_p", range_of(df, order, n)).withColumn("_v", value)
    before = lambda w, o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_p").agg(fold("_v", order).alias("_v")).withColumn("_e", fold("_v", "_p").over(before(Window, "_p"))).select("_p", "_e")
    local = ranged.withColumn("_l", fold("_v", order).over(before(Window.partitionBy("_p"), order)))
    return local.join(F.broadcast(ends), "_p").withColumn(name, both(F.col("_l"), F.col("_e"))).drop("_p", "_v", "_l", "_e")


# ---------------------------------------------------------------- partition filters


@dataclass(frozen=True)
class All:
    def column(self, keys: list[str], kinds: dict[str, str] | None = None) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Exact:
    """Equal on all keys of the scheme; a missing or further key, or another type, matches nothing."""

    values: dict

    def column(self, keys: list[str], kinds: dict[str, str] | None = None) -> Column:
        """kinds: of the keys; only those of kind int take a Python int, all others a string. Without them a column's own type decides."""
        if set(self.values) != set(keys):
            return F.lit(False)
        if kinds is not None and any(isinstance(v, int) != (kinds[k] == "int") for k, v in self.values.items()):
            return F.lit(False)
        same = [(F.typeof(k).isin("string", "date") != F.lit(isinstance(v, int))) & (F.col(k).cast("string") == F.lit(str(v))) for k, v in self.values.items()]
        return reduce(lambda a, b: a & b, same if kinds is None else [F.col(k) == F.lit(v) for k, v in self.values.items()], F.lit(True))


@dataclass(frozen=True)
class In:
    key: str
    values: tuple

    def column(self, keys: list[str], kinds: dict[str, str] | None = None) -> Column:
        return F.col(self.key).cast("string").isin([str(v) for v in self.values]) if self.key in keys else F.lit(False)


@dataclass(frozen=True)
class Range:
    """Inclusive, by the order of strings."""

    key: str
    start: str
    end: str

    def column(self, keys: list[str], kinds: dict[str, str] | None = None) -> Column:
        return F.col(self.key).cast("string").between(str(self.start), str(self.end)) if self.key in keys else F.lit(False)


@dataclass(frozen=True)
class And:
    parts: tuple = ()

    def column(self, keys: list[str], kinds: dict[str, str] | None = None) -> Column:
        return reduce(lambda a, b: a & b, [p.column(keys, kinds) for p in self.parts], F.lit(True))


# ---------------------------------------------------------------- sequences


def gaps(df: DataFrame, stream: str | None = None, order: str = "seq", column: str = "seq") -> DataFrame:
    """Adds prev and is_gap: not one more than the row before in its stream; repeats and steps back are gaps too. Without a
    stream the whole log is one, and is taken in ranges."""
    if stream is None:
        df = carried(df, F.col(column), "last", "prev", order)
    else:
        df = df.withColumn("prev", F.lag(column).over(Window.partitionBy(stream).orderBy(order)))
    return df.withColumn("is_gap", F.coalesce(F.col(column) != F.col("prev") + 1, F.lit(False)))


def apply_gap_policy(df: DataFrame, policy: str, column: str = "seq") -> DataFrame:
    """df has prev and is_gap. panic raises, quarantine drops the gap row itself, ignore keeps it."""
    if policy == "quarantine":
        return df.where(~F.col("is_gap"))
    if policy == "panic":
        missing = F.greatest(F.col(column) - F.col("prev") - 1, F.lit(0))
        say = F.concat(F.lit("sequence gap: "), F.col("prev").cast("string"), F.lit(" to "), F.col(column).cast("string"), F.lit(", missing "), missing.cast("string"))
        return df.withColumn("is_gap", F.when(F.col("is_gap"), F.raise_error(say).cast("boolean")).otherwise(F.lit(False)))
    if policy == "ignore":
        return df
    raise ValueError(policy)


def last_gap(df: DataFrame, stream: str, order: str = "seq", column: str = "seq") -> DataFrame:
    g = df.where("is_gap").groupBy(stream).agg(F.max_by(F.struct(F.col("prev").alias("gap_from"), F.col(column).alias("gap_to")), order).alias("g"))
    return g.select(stream, "g.*")


def event_status(df: DataFrame) -> DataFrame:
    """Why a row is not applied to an L2 book: gap, then type, header, mode, event; null if it is."""
    status = F.when(F.col("is_gap"), "Gap").when(F.col("type_id") != 0x1000, "NonBookEvent").when(F.col("header_ok") == F.lit(False), "Corrupt").when(F.col("book_mode") != 0, "UnsupportedMode").when(~F.col("event_type").isin(1, 2), "UnsupportedEvent")
    return df.withColumn("skipped", status)


def l3_status(df: DataFrame) -> DataFrame:
    """Why a row is no L3 event, in ``skipped``: type, mode, event, then length; null if it is one. A wrong length is ``Corrupt``."""
    status = F.when(F.col("type_id") != 0x1000, "NonBookEvent").when(F.col("book_mode") != 1, "UnsupportedMode").when(F.col("event_type") != 2, "UnsupportedEvent").when(F.col("record_len") != L3_RECORD, "Corrupt")
    return df.withColumn("skipped", status)


#: Fixed value: bytes of an L3 event with its header.
L3_RECORD = 128


def l3_events(df: DataFrame, policy: str = "fail") -> DataFrame:
    """The L3 events. fail raises for any other row, skip leaves it out; a corrupt one raises under both."""
    if policy not in ("fail", "skip"):
        raise ValueError(policy)
    bad = F.col("skipped").isNotNull() if policy == "fail" else F.col("skipped") == "Corrupt"
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("no L3 event: "), "skipped")).cast("boolean")).otherwise(F.col("skipped").isNull())
    return l3_status(df).where(checked).drop("skipped")


def one_channel(df: DataFrame, column: str = "stream_id") -> DataFrame:
    """df, which raises if it has more than one channel."""
    n = df.agg(F.count_distinct(column).alias("_n"), F.min(column).alias("_c")).first()
    if n["_n"] > 1:
        raise ValueError(f"{n['_n']} channels in one stream")
    return df


def update_gaps(df: DataFrame, stream: str, order: str = "seq") -> DataFrame:
    """Rows (update_id_first, update_id_last) that do not go on where the row before ended; those that end before it are stale."""
    last = F.max("update_id_last").over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(F.col("_last").isNull(), "first").when(F.col("update_id_last") <= F.col("_last"), "stale").when(F.col("update_id_first") > F.col("_last") + 1, "gap").otherwise("next")
    return df.withColumn("_last", last).withColumn("continuity", state).drop("_last")
