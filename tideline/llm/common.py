"""Helpers shared by the text operators: shared storage, word hashing on Arrow buffers, bounded table sums.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. bytes.split() cuts exactly there, so Python and the
vectorised code below agree with the regular expression ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Text bytes that are hashed at a time; one document alone may exceed it.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in
    tests; on a cluster executors would write to their own disks, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to shared storage, which cut the lineage and survive lost executors; drop() deletes those no longer needed.

    What an operator returns still reads its tables. Who has written that result can clear() all tables made since a mark()."""

    _written: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh(self.spark, name)
        Scratch._written.append(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._scratch_path)
            if df._scratch_path in Scratch._written:
                Scratch._written.remove(df._scratch_path)

    @staticmethod
    def mark() -> int:
        return len(Scratch._written)

    def clear(self, mark: int, *but: DataFrame) -> None:
        """Deletes the tables written since the mark, but for those given. Not while another thread uses operators of its own."""
        kept = {df._scratch_path for df in but}
        for path in Scratch._written[mark:]:
            if path not in kept:
                delete(self.spark, path)
        Scratch._written[mark:] = [p for p in Scratch._written[mark:] if p in kept]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """run, for mapInArrow or mapInPandas, with a worker that gives its freed memory back when its task ends: idle workers stay alive."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    task.__name__ = run.__name__  # for the plan
    return task


# ---------------------------------------------------------------- hashing on Arrow buffers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        size = max(n + 1, CHUNK + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        made = np.cumprod(out)
        if size > 4 * CHUNK:
            return made
        _powers[base] = made
    return _powers[base]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each; a longer document is one range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """The words of some documents: first[i]:first[i + 1] are those of document i."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    """Words and their 64-bit hashes, for documents data[offsets[i]:offsets[i + 1]]; lower: with A-Z as a-z."""
    at = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), np.zeros(0, np.uint64), none, none, data)
    blank = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = blank[:-1]
    edge[at] = True
    solid = ~blank
    start = np.flatnonzero(solid & edge[:-1])
    edge[1:-1] = blank[1:]
    edge[at] = True
    end = np.flatnonzero(solid & edge[1:]) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * powers(_INV, len(data))[start]
    return Words(np.searchsorted(start, at), mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), start, end, data)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(31)
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over the total - k + 1 windows: those within one document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    bad = np.zeros(total + 1, np.int64)
    inner = first[1:-1]
    # a document boundary b (0 < b < total) spoils the windows that start in [b - k + 1, b)
    np.add.at(bad, np.maximum(inner - k + 1, 0), 1)
    np.add.at(bad, inner, -1)
    return np.cumsum(bad)[:n] == 0


# ---------------------------------------------------------------- sums of fixed-size tables


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


PART = 1 << 16
TABLE = "name string, part int, body binary"


def table_rows(name: str, a: np.ndarray) -> pa.RecordBatch:
    """A counter table as rows of at most PART counters, for summed()."""
    n = -(-len(a) // PART)
    return pa.RecordBatch.from_pydict({"name": [name] * n, "part": pa.array(range(n), pa.int32()), "body": pa.array([packed(a[i * PART : (i + 1) * PART]) for i in range(n)], pa.binary())})


def summed(rows: DataFrame, kind=np.uint32, tasks: int = 24) -> DataFrame:
    """Adds up tables of equal names and parts, streaming: a task holds one sum for each part dealt to it."""

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for name, part, body in zip(b["name"].to_pylist(), b["part"].to_pylist(), b["body"], strict=True):
                a = unpacked(body.as_py(), kind)
                if (name, part) in sums:
                    sums[name, part] += a
                else:
                    sums[name, part] = a.copy()
        for (name, part), a in sums.items():
            yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "body": pa.array([packed(a)], pa.binary())})

    return rows.repartition(tasks, "name", "part").mapInArrow(lean(add), TABLE)


def gathered(rows: DataFrame, kind=np.uint32) -> dict[str, np.ndarray]:
    """The summed tables on the driver: their size is fixed by their makers, whatever the input."""
    parts: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.toLocalIterator():
        parts.setdefault(r["name"], {})[r["part"]] = unpacked(bytes(r["body"]), kind)
    return {k: np.concatenate([v[i] for i in sorted(v)]) for k, v in parts.items()}


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
