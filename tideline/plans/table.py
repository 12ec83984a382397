"""Hive-partitioned time-series tables with a declared scheme."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import roll
from tideline.operators.filters import Exact
from tideline.operators.merge import merge_ordered, merge_sequential

VERSION = 1


def partition_path(scheme: list[tuple[str, str]], values: dict) -> str:
    """``k=v/k=v`` in the order of the scheme."""
    return "/".join(f"{k}={values[k]}" for k, _ in scheme)


def partition_label(values: dict) -> str:
    """The same in the order of the alphabet, to be shown."""
    return "/".join(f"{k}={values[k]}" for k in sorted(values))


def partition_values(path: str) -> dict[str, str]:
    """Of a path: the values, always strings."""
    return dict(x.split("=", 1) for x in path.strip("/").split("/") if "=" in x)


class Table:
    """``scheme``: (key, kind) pairs, kind one of string, int, date, hour, minute. Rows have seq and timestamp_ns."""

    def __init__(self, spark: SparkSession, path: str, scheme: list[tuple[str, str]], tz: str = "UTC"):
        self.spark, self.path, self.scheme, self.tz = spark, path.rstrip("/"), scheme, tz

    @classmethod
    def create(cls, spark: SparkSession, path: str, scheme: list[tuple[str, str]], tz: str = "UTC") -> Table:
        meta = json.dumps({"version": VERSION, "scheme": scheme, "tz": tz})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path.rstrip('/')}/_table/metadata")
        return cls(spark, path, scheme, tz)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        meta = json.loads(spark.read.text(f"{path.rstrip('/')}/_table/metadata").first()[0])
        if meta["version"] != VERSION:
            raise ValueError(f"unsupported table version {meta['version']}")
        return cls(spark, path, [tuple(x) for x in meta["scheme"]], meta["tz"])

    @property
    def keys(self) -> list[str]:
        return [k for k, _ in self.scheme]

    def validate(self, values: dict) -> None:
        if set(values) != set(self.keys):
            raise ValueError(f"partition keys {sorted(values)} are not {sorted(self.keys)}")
        for k, kind in self.scheme:
            if isinstance(values[k], int) != (kind == "int"):
                raise ValueError(f"{k} must be {kind}")

    def write(self, df: DataFrame, values: dict) -> None:
        """Appends one partition."""
        self.validate(values)
        self._append(df.withColumns({k: F.lit(v) for k, v in values.items()}))

    def write_rolling(self, df: DataFrame, static: dict) -> None:
        """Partition values of date, hour and minute keys follow from each row's timestamp."""
        rolled = {k: roll(F.col("timestamp_ns"), kind, self.tz) for k, kind in self.scheme if kind in ("date", "hour", "minute")}
        if set(rolled) | set(static) != set(self.keys):
            raise ValueError("the scheme has keys without a value")
        self._append(df.withColumns(rolled | {k: F.lit(v) for k, v in static.items()}))

    def _append(self, df: DataFrame) -> None:
        # sorted files make row-group statistics useful for seeks
        df.repartition(*self.keys).sortWithinPartitions(*self.keys, "seq").write.mode("append").option("compression", "zstd").partitionBy(*self.keys).parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        """Partition values keep their declared types: strings, and long for int."""
        found = self.spark.read.parquet(f"{self.path}/data")
        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in self.keys]
        # a declared schema, so that partition values are not inferred
        return self.spark.read.schema(", ".join(own + [f"`{k}` {'long' if kind == 'int' else 'string'}" for k, kind in self.scheme])).parquet(f"{self.path}/data")

    def reader(self, values: dict) -> DataFrame:
        """One partition, in order; all keys have to be given, with their kinds."""
        self.validate(values)
        return self.read().where(Exact(values).column(self.keys, dict(self.scheme))).orderBy("seq")

    def partitions(self) -> DataFrame:
        return self.read().select(*self.keys).distinct()

    def query(self, condition, strategy: str = "ordered") -> DataFrame:
        """Pruned to the partitions that the filter accepts, merged by timestamp or one after the other."""
        df = self.read().where(condition.column(self.keys, dict(self.scheme)))
        part = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in self.keys])
        df = df.withColumn("_part", part)
        return (merge_ordered(df, "_part") if strategy == "ordered" else merge_sequential(df, "_part")).drop("_part")
