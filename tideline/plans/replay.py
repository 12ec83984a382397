"""A fluent replay pipeline over messages, its sinks, and symbol-parallel replay."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.operators import filters
from tideline.sources import messages as src


@dataclass(frozen=True)
class ReplayStats:
    """Rows read, written (to a sink) and filtered out, and the seconds that took."""

    read: int
    written: int
    filtered: int
    seconds: float

    @property
    def throughput(self) -> float:
        """Rows read in a second."""
        return self.read / self.seconds if self.seconds else 0.0


class ReplayPipeline:
    """Steps apply in the order they are given: sampling counts the rows that earlier steps pass, gaps are seen by later ones."""

    def __init__(self, source: DataFrame, order: str = "seq", stream: str | None = None):
        self.source, self.order, self.stream = source, order, stream
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self._sink: Callable[[DataFrame], Any] | None = None

    @classmethod
    def from_source(cls, source: DataFrame, **kw) -> ReplayPipeline:
        return cls(source, **kw)

    def _applied(self, df: DataFrame) -> DataFrame:
        for f in self.steps:
            df = df.transform(f)
        return df

    @property
    def df(self) -> DataFrame:
        return self._applied(self.source)

    def seek_seq(self, target: int) -> ReplayPipeline:
        """What has been read before the position counts neither as read nor as filtered."""
        self.source, self.steps = src.seek(self.df, "seq", target, self.order), []
        return self

    def seek_timestamp(self, target: int) -> ReplayPipeline:
        self.source, self.steps = src.seek(self.df, "timestamp_ns", target, self.order), []
        return self

    def filter_time_range(self, start: int, end: int) -> ReplayPipeline:
        return self.transform(lambda d: filters.time_range(d, start, end))

    def filter_types(self, kinds: list, column: str = "type_id") -> ReplayPipeline:
        return self.transform(lambda d: filters.types(d, kinds, column))

    def sample(self, n: int) -> ReplayPipeline:
        return self.transform(lambda d: filters.sample(d, n, self.order, self.stream))

    def gaps(self, policy: str, column: str = "seq") -> ReplayPipeline:
        """panic raises at a gap, quarantine drops the row after it, ignore keeps all."""

        def step(d: DataFrame) -> DataFrame:
            if policy == "ignore":
                return d
            kept = filters.apply_gap_policy(filters.gaps(d, self.stream, self.order, column), policy)
            return kept.where(~F.col("is_gap")).drop("prev", "is_gap")

        if policy not in ("panic", "quarantine", "ignore"):
            raise ValueError(policy)
        return self.transform(step)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> ReplayPipeline:
        self.steps.append(f)
        return self

    def sink(self, write: Callable[[DataFrame], Any]) -> ReplayPipeline:
        self._sink = write
        return self

    def run(self) -> ReplayStats:
        """One pass: the rows are counted as they are read and as they reach the sink. Without a sink nothing counts as written."""
        began, read, out = time.monotonic(), Observation("read"), Observation("out")
        one = F.count(F.lit(1)).alias("n")
        (self._sink or null_sink)(self._applied(self.source.observe(read, one)).observe(out, one))
        n, passed = read.get["n"], out.get["n"]
        return ReplayStats(n, passed if self._sink else 0, n - passed, time.monotonic() - began)


def null_sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def csv_rows(df: DataFrame) -> DataFrame:
    """What the CSV sink writes: the length of the payload, not the payload."""
    return df.select("seq", "timestamp_ns", "type_id", F.octet_length("payload").alias("payload_len"))


def csv_sink(path: str) -> Callable[[DataFrame], None]:
    return lambda df: csv_rows(df).write.mode("append").csv(path, header=True)


def parquet_sink(path: str, batch_rows: int | None = None) -> Callable[[DataFrame], None]:
    if batch_rows is not None and batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    return lambda df: df.write.mode("append").option("maxRecordsPerFile", batch_rows or 0).parquet(path)


def queue_sink(path: str) -> Callable[[DataFrame], None]:
    """Appends types and payloads under new timestamps."""
    now = (F.unix_micros(F.current_timestamp()) * 1000).alias("timestamp_ns")
    return lambda df: df.select(now, "type_id", "payload").write.mode("append").parquet(path)


def vec_sink(out: list) -> Callable[[DataFrame], None]:
    return lambda df: out.extend(df.collect())


def replay_by_symbol(df: DataFrame, handler: Callable, schema: str, symbol: str = "market_id", order: str = "seq") -> DataFrame:
    """handler(batches) runs over whole symbols in order; batches are pandas frames sorted by (symbol, order)."""
    return df.repartition(symbol).sortWithinPartitions(symbol, order).mapInPandas(handler, schema)
