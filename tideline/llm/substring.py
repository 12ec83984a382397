"""Substring dedup (operator 1): repeats of 50 words or more, by prefix-partitioned suffix subtrees.

A *window* is WINDOW consecutive words of one document. Every word covered by a window whose word sequence also starts
in a document with a smaller doc_id is removed; windows are judged on the input.

Suffixes are dealt by a variable-length prefix. To deal only those that can repeat, each window names one *anchor*, the
first of its PREFIX-word sequences with the least hash; equal windows name the same one at the same place. So the
windows of an anchor's content are a group of suffixes whose prefixes (from the anchor on) agree, and

1. one scan emits the anchors (about 4 % of all word positions), and counts them by content;
2. anchors whose content stands in one document only are dropped: no window of theirs repeats;
3. for the others, the words around the anchor (all windows that name it) are dealt by content. A task holds whole
   groups of a bounded size and names the nodes of their suffix subtrees at depths 1, 2, 4, ... 32 and 50 from the
   ranks of the two halves; suffixes with one node at depth 50 start the same window, and its least doc_id decides;
4. groups of more than GROUP occurrences are split by longer prefixes, until each fits. Occurrences whose words around
   the anchor are all equal are one to begin with: it stands in the least doc_id, the others are covered. If more than
   GROUP different ones are left, their windows are halved by the anchor's place in them; the windows of a half have more
   words in common (29, then 40, 45, 48 and at last all 50), and these are its prefix. So an occurrence becomes two at
   most, equal ones merge again, and only groups that are still too large go on;
5. the covered ranges of words are joined to the documents, merged and cut out.

A null text has no words. Texts shorter than a window lose nothing. Rows of one doc_id count as one document's: a window
in two of them is removed from neither because of the other; rows that are equal are cut alike. A null doc_id is never
smaller or larger than another, so such rows lose nothing and take nothing. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, buffers, inside, lean, pieces, table, window_hashes, words_of

WINDOW = 50
PREFIX = 8
#: Occurrences of one prefix that are compared in one task; larger groups take longer prefixes.
GROUP = 500
#: Occurrences that a task holds at a time.
HELD = 2_000


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the first least value in each run of ``width`` consecutive values."""
    n = len(h) - width + 1
    at, step = np.arange(len(h)), 1
    while step * 2 <= width:
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        step *= 2
    left, right = at[:n], at[width - step : width - step + n]
    return np.where(h[right] < h[left], right, left)


def anchors_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, content hash, first window's word, number of windows, anchor's word), words counted in the document."""
    w = words_of(offsets, data)
    n = len(w.hash) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none
    grams = window_hashes(w.hash, PREFIX)
    at = _least(grams, WINDOW - PREFIX + 1)
    ok = inside(w.first, WINDOW, len(w.hash))
    starts = np.flatnonzero(ok)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none
    named = at[starts]
    new = np.ones(len(starts), bool)
    # windows of one document name their anchors in rising order, so the windows of an anchor are neighbours
    doc = np.searchsorted(w.first, starts, "right") - 1
    new[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    base = w.first[doc[i]]
    return doc[i], grams[named[i]], starts[i] - base, np.diff(np.append(i, len(starts))), named[i] - base


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, data = buffers(b["text"])
        ids, rows = b["doc_id"].to_numpy(), b["row"].to_numpy()
        for lo, hi in pieces(at):
            d, h, s, n, a = anchors_of(at[lo : hi + 1], data)
            yield pa.RecordBatch.from_pydict({"doc_id": ids[lo + d], "row": rows[lo + d], "content": h.view(np.int64), "start": s.astype(np.int32), "windows": n.astype(np.int32), "anchor": a.astype(np.int32)})


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        at, data = buffers(b["text"])
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "row": b["row"], "z": pa.array([press.compress(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)], pa.binary())})


CONTEXT = "doc_id long, row long, key long, hot boolean, low int, high int, start int, windows int, anchor int, words binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 5, pa.binary())


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[c.split()[0] for c in CONTEXT.split(", ")])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (z, anchors array): the words around each anchor. low, high: the least and most words that a window has before it."""
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        ids, rows, out = b["doc_id"].to_pylist(), b["row"].to_pylist(), []
        size = 0
        for i in range(b.num_rows):
            words = open_.decompress(b["z"][i].as_py()).split()
            for x in b["found"][i].as_py():
                text = b" ".join(words[x["start"] : x["start"] + x["windows"] + WINDOW - 1])
                out.append((ids[i], rows[i], x["content"], x["hot"], 0, WINDOW - PREFIX, x["start"], x["windows"], x["anchor"], text))
                size += len(text)
            if size > 1 << 21:
                yield _context_batch(out)
                out, size = [], 0
        if out:
            yield _context_batch(out)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of large groups, each with the windows of one half of its places only, and keyed by all words that these share."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            words, middle = r["words"].split(b" "), (r["low"] + r["high"]) // 2
            most = r["anchor"] - r["start"]
            least = most - r["windows"] + 1
            for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                top, bottom = min(most, high), max(least, low)
                if top < bottom:
                    continue
                at = most - top
                prefix = words[most - low : most - high + WINDOW]
                key = hashlib.blake2b(struct.pack("<qi", r["key"], low) + b" ".join(prefix), digest_size=8).digest()
                out.append((r["doc_id"], r["row"], struct.unpack("<q", key)[0], True, low, high, r["start"] + at, top - bottom + 1, r["anchor"], b" ".join(words[at : at + top - bottom + WINDOW])))
        if out:
            yield _context_batch(out)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the pairs (a[i], b[i]): the nodes that they lead to."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1]


def _covered(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, first covered word, end) for whole groups of occurrences: the subtrees' nodes at depth WINDOW and their least doc."""
    name = defaultdict(count().__next__)
    parts = [x.split(b" ") for x in words]
    size = np.array([len(p) for p in parts])
    ids = np.fromiter((name[w] for p in parts for w in p), np.int64, int(size.sum()))
    base = np.cumsum(size) - size
    # ranks of the suffixes at depth d; a suffix may run on into the next context, but those are no window's
    rank, depth = ids, 1
    while depth * 2 <= WINDOW:
        rank = _ranks(rank[: len(rank) - depth], rank[depth:])
        depth *= 2
    of = np.repeat(np.arange(len(doc)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[of] + place
    node = _ranks(rank[at], rank[at + WINDOW - depth])
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[of])
    hit = doc[of] > least[node]
    return _runs(of[hit], (start[of] + place)[hit])


def _runs(of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges covered windows (sorted by occurrence, word) into ranges."""
    if not len(of):
        return of, first, first
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (first[1:] > first[:-1] + WINDOW)
    i = np.flatnonzero(new)
    return of[i], first[i], first[np.append(i[1:], len(of)) - 1] + WINDOW


RANGE = "doc_id long, row long, lo int, hi int"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by key: the covered ranges. Holds whole groups, about HELD occurrences."""

    def done(b: pa.Table) -> pa.RecordBatch:
        doc = b["doc_id"].to_numpy()
        of, lo, hi = _covered(doc, b["start"].to_numpy().astype(np.int64), b["windows"].to_numpy().astype(np.int64), b["words"].to_pylist())
        return pa.RecordBatch.from_pydict({"doc_id": doc[of], "row": b["row"].to_numpy()[of], "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, HELD):
            held.append(batch.slice(lo, HELD))
            if sum(b.num_rows for b in held) >= HELD:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def covered_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row, lo, hi): ranges of words to remove, in each document; they may overlap. docs(doc_id long, row long, text string);
    (doc_id, row) tells documents apart."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id is not null")
    anchors = scratch.keep(docs.mapInArrow(lean(_emit_anchors), "doc_id long, row long, content long, start int, windows int, anchor int"), "anchors")
    # groups are written, so that a join with them can be a broadcast, or split where a group is hot
    groups = scratch.keep(anchors.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("content", (F.col("n") > GROUP).alias("hot")), "groups")
    found = anchors.join(groups, "content")
    per_doc = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("content", "hot", "start", "windows", "anchor")).alias("found"))
    contexts = scratch.keep(docs.mapInArrow(lean(_squeezed), "doc_id long, row long, z binary").join(per_doc, ["doc_id", "row"]).mapInArrow(lean(_contexts), CONTEXT), "contexts")
    scratch.drop(anchors)
    fitting = lambda t: t.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_subtrees), RANGE)
    ranges = fitting(contexts.where("not hot").select("key", "doc_id", "row", "start", "windows", "words"))
    state, more = contexts.where("hot"), bool(groups.where("hot").limit(1).count())
    while more:
        # contexts of equal words: all windows of those after the least doc_id are covered by it, only that one's own go on
        named = state.withColumn("same", F.unhex(F.md5("words")))
        firsts = scratch.keep(named.groupBy("key", "same").agg(F.min("doc_id").alias("first")), "firsts")
        sizes = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("x"), F.max("first").alias("y"))
        sizes = scratch.keep(sizes.select("key", F.when(F.col("x") < F.col("y"), F.col("k")).otherwise(0).alias("k")), "sizes")
        level = scratch.keep(named.join(firsts, ["key", "same"]).join(sizes, "key").where("doc_id > first or k > 0").drop("same"), "level")
        copies = level.where("doc_id > first")
        ranges = ranges.unionByName(copies.select("doc_id", "row", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + WINDOW - 1).cast("int").alias("hi")))
        own = level.where("doc_id = first")
        ranges = ranges.unionByName(fitting(own.where(F.col("k") <= GROUP).select("key", "doc_id", "row", "start", "windows", "words")))
        more = bool(sizes.where(F.col("k") > GROUP).limit(1).count())
        state = own.where(F.col("k") > GROUP).select(*[c.split()[0] for c in CONTEXT.split(", ")]).mapInArrow(lean(_longer), CONTEXT)
        scratch.drop(firsts, sizes)
    return ranges


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, z, found): without the words of the ranges. Kept words are joined by one space."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            n_words, n_removed, kept = [], [], []
            for i in range(b.num_rows):
                words = open_.decompress(b["z"][i].as_py()).split()
                left, last = [], 0
                for lo, hi in _merged(b["found"][i].as_py()):
                    left += words[last:lo]
                    last = hi
                left += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "row": b["row"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})


def dedup_substrings(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary) for every row of docs; kept: the words left, joined by one space.

    key: a long column that tells rows of one doc_id apart, returned as well; without it their texts do."""
    scratch = Scratch(docs.sparkSession)
    row = F.xxhash64("doc_id", "text") if key is None else F.col(key).cast("long")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", row.alias("row"))
    ranges = covered_ranges(docs, scratch).groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    out = docs.mapInArrow(lean(_squeezed), "doc_id long, row long, z binary").join(ranges, ["doc_id", "row"], "left").mapInArrow(lean(_cut), "doc_id long, row long, n_words long, n_removed long, kept binary")
    return out.drop("row") if key is None else out.withColumnRenamed("row", key)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, r, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM t, unnest(range(1, len(w) - 48)) AS u(i)),
firsts AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN firsts USING (h), unnest(range(0, 50)) AS v(k) WHERE win.doc_id > firsts.d),
word AS (SELECT r, p, w[p] AS x FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
