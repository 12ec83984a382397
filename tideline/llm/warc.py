"""WARC (operator 9): archives of individually compressed records that share an embedded Zstandard dictionary.

An archive is a skippable frame (magic 0x184D2A5D, 32-bit length) that holds the dictionary, then one Zstandard frame for
each record. The dictionary is trained on the records of a bounded sample of pages: for each of SLOTS hash slots the page
with the least hash. Of records whose payloads are equal and of PAYLOAD_LEAST bytes at least, the one with the largest
page_id is the response and the others revisit it; shorter ones are all responses.

Each write task writes one archive under a name of its own in the shared folder, and returns it in a manifest, which is
kept as a table: archives of failed attempts are in no manifest and are never read. Files are reached through
pyarrow.fs, by URI. Reading streams one record at a time and checks the digest of each response.

A null html is an empty payload, a null url gives no target header. Pages of equal page_id (or a null one) and equal long
payloads: the record that revisits names the same id; one row of the largest id stays the response and the rest revisit
it. An empty table gives no archive and no row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, fresh, lean, table

PAYLOAD_LEAST = 1000
SLOTS = 256
SAMPLE_BYTES = 16 * 1024
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
_SKIPPABLE = 0x184D2A5D
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, size long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "none" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = _HTTP if revisit else _HTTP + payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """A record's fields in the order of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines[1:])
    size = int(h["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    number = lambda x: None if x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    digest, kind = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), h["WARC-Type"]
    payload = rest[:size].removeprefix(_HTTP) if kind == "response" else None
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError("payload and digest differ")
    url = h.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, kind, number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, url, payload


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SLOTS records of at most SAMPLE_BYTES each; raw content where the sample is too small to train on."""
    rows = pages.select(F.pmod(F.xxhash64("url", "html"), F.lit(SLOTS)).alias("slot"), F.struct(F.xxhash64("html", F.lit(3)).alias("h"), "page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).alias("page"))
    sample = [record(r["p"]["page_id"], r["p"]["url"], (r["p"]["html"] or "").encode(), None, False) for r in rows.groupBy("slot").agg(F.min("page").alias("p")).orderBy("slot").toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The manifest (path, records, size) of archives of pages(page_id, url, html), written to ``folder``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(dictionary(pages))
    digested = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    key = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("url").alias("u"))
    heads = digested.where(F.col("bytes") >= PAYLOAD_LEAST).groupBy("sha1").agg(F.max(key).alias("head"), F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that a join with them is a broadcast where they are few, and else split where a payload is hot
    heads = Scratch(pages.sparkSession).keep(heads, "heads")
    marked = digested.join(heads, "sha1", "left").withColumn("revisit", F.col("n").isNotNull() & (F.col("head") != key))
    # rows that repeat the head in page_id and url: one of them is the response
    again = heads.join(digested, "sha1").where(F.col("head") == key).groupBy("sha1").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    if again.limit(1).count():
        twins = marked.join(again, "sha1", "left_semi").where("not revisit")
        order = Window.partitionBy("sha1").orderBy(F.lit(1))
        twins = twins.withColumn("revisit", F.row_number().over(order) > 1)
        marked = marked.where("revisit").unionByName(marked.where("not revisit").join(again, "sha1", "left_anti")).unionByName(twins)
    rows = marked.select("page_id", "url", "html", "refers_to", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, n, size, name = None, 0, 0, f"{uuid.uuid4().hex}.warc.zst"
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(shared.value), write_content_size=True)
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    size += out.write(struct.pack("<II", _SKIPPABLE, len(shared.value)) + shared.value)
                page, url, html, to, revisit = (b[c][i].as_py() for c in ("page_id", "url", "html", "refers_to", "revisit"))
                size += out.write(press.compress(record(page, url, html.encode(), to, revisit)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64())})

    return rows.mapInArrow(lean(write), MANIFEST)


def records_of(stream) -> Iterator[bytes]:
    """The records of an open archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _SKIPPABLE:
        raise ValueError("no dictionary frame")
    open_ = zstandard.ZstdDecompressor(dict_data=_dict(stream.read(size)))
    one, parts, data = open_.decompressobj(), [], stream.read(1 << 20)
    while data:
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            yield b"".join(parts)
            data, parts = one.unused_data, []
            one = open_.decompressobj()
        if not data:
            data = stream.read(1 << 20)
    if any(parts):
        raise ValueError("truncated archive")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records (RECORD) of the archives that a manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for path in b["path"].to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(at) as stream:
                    for raw in records_of(stream):
                        rows.append(parsed(raw))
                        size += len(raw)
                        if size > 1 << 22:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(lean(read), RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = Scratch(spark).keep(write_archives(table(spark, sf_dir, "pages"), fresh(spark, "warc")), "manifest")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""
