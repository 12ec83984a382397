"""Raw segment files of an event log (``000000042.q``): 64-byte headers, records aligned to 64 bytes, little endian.

Spark reads whole files, so any file system that it knows will do; a segment is one task's work. The order of the log is
(segment_id, offset): seq restarts with every writer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.messages import PAD

# fixed values of the format
MAGIC, VERSION, SEALED = 0x53454730, 2, 1
ALIGN = 64
_SEGMENT = struct.Struct("<IIII48x")
#: commit word (payload length + 1; 0: not committed), version, seq, timestamp, type, flags, CRC-32 of the payload
_RECORD = struct.Struct("<IB3xQQHHI32x")

RECORD = "segment_id long, offset long, seq long, timestamp_ns long, type_id int, payload binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def records(segment: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """The committed records of one segment, padding included; a damaged one raises."""
    magic, version, number, _ = _SEGMENT.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this version")
    at = ALIGN
    while at + ALIGN <= len(segment):
        commit, _, seq, ts, kind, _, checksum = _RECORD.unpack_from(segment, at)
        if not commit:
            return
        stop = at + ALIGN + commit - 1
        if stop > len(segment):
            raise ValueError(f"segment {number}: record at {at} is out of bounds")
        payload = segment[at + ALIGN : stop]
        if kind != PAD and zlib.crc32(payload) != checksum:
            raise ValueError(f"segment {number}: corrupt record at {at}")
        yield number, at, seq, ts, kind, payload
        at = -(-stop // ALIGN) * ALIGN


def encode(number: int, rows: list[tuple[int, int, int, bytes]], sealed: bool = True) -> bytes:
    """A segment of rows (seq, timestamp_ns, type_id, payload)."""
    out = bytearray(_SEGMENT.pack(MAGIC, VERSION, number, SEALED if sealed else 0))
    for seq, ts, kind, payload in rows:
        out += _RECORD.pack(len(payload) + 1, 1, seq, ts, kind, 0, zlib.crc32(payload)) + payload
        out += bytes(-len(out) % ALIGN)
    return bytes(out + bytes(ALIGN))


def read_segments(spark: SparkSession, folder: str, padding: bool = False) -> DataFrame:
    """RECORD rows of all segments of a folder, without padding records. A missing segment number is no error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                rows = [r for r in records(content.as_py()) if padding or r[4] != PAD]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000], strict=True), _KINDS, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.q").load(folder)
    return files.select(F.col("content")).mapInArrow(decode, RECORD)
