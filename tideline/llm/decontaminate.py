"""Benchmark decontamination (operator 4): template canonicalisation, a hash join of template windows, slot consistency.

Words are taken without punctuation at their ends and in lower case. Numbers, names (capitalised inside a sentence) and
units (after a number) become typed placeholders, so a question with other numbers or names has the same template.
An item has up to three *forms*: its template; the same with its first word taken for a name, if it is capitalised (it may
follow a comma in a document); and its plain words, which find verbatim copies whatever their case, context or share of
placeholders. Every WINDOW consecutive words of a form (of a template, at least half of them literal) are hashed; a form
of fewer words is one window. They are joined with the windows of all documents. Documents' windows pass a bitmap of
the items' hashes first; it has a fixed size and only saves rows, the join decides.

For each document and form, matches are grouped by alignment (where the item would start). In an alignment, the values
that stand in the item's slots must map one to one to the document's. An item is found in a document if the consistent
alignments cover SHARE of the windows of one of its forms. Nothing is capped.

A null or empty text has no windows. Documents with one doc_id, or none, are told apart by their text; repeated rows give
one result row. Items of one item_id are told apart by their text. Of ties nothing depends: every item found is returned. An empty
table of either kind gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import _BASE, _INV, _LOWER, BLANKS, Scratch, buffers, inside, lean, mix, packed, pieces, powers, table, unpacked, window_hashes, words_of

WINDOW = 8
SHARE = 0.6
BITS = 1 << 25
UNITS = "km m cm mm mi ft in kg g mg lb oz s sec ms min h hr hrs hours minutes seconds days weeks months years km/h mph l ml gal % usd eur $ dollars euros cents miles meters metres feet inches pounds grams kilograms liters litres degrees".split()
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_NUMBER, _NAME, _UNIT, _PLAIN = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A3, 0xA5A5A5A5A5A5A5A7, 0x5A5A5A5A5A5A5A59))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * powers(_INV, len(data))[start] + (end - start).astype(np.uint64))


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    at = np.concatenate([[0], np.cumsum([len(u) for u in raw])])
    return np.sort(_hash(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]))


def templates(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each document, template hashes, slot values, plain hashes): a slot value is 0 for a literal word."""
    w = words_of(offsets, data)
    if not len(w.start):
        none = np.zeros(0, np.uint64)
        return w.first, none, none, none
    raw, s, e = w.data, w.start.copy(), w.end.copy()
    for _ in range(3):
        s += (e - s > 1) & _EDGE[raw[s]]
        e -= (e - s > 1) & _EDGE[raw[e - 1]]
    h = _hash(_LOWER[raw], s, e)
    number = _DIGIT[raw[s]] | ((e - s > 1) & _DIGIT[raw[np.minimum(s + 1, len(raw) - 1)]] & ((raw[s] == 45) | (raw[s] == 36) | (raw[s] == 43)))
    fresh = np.ones(len(s), bool)  # starts a sentence, line or document
    fresh[1:] = _STOP[raw[w.end[:-1] - 1]] | (raw[w.start[1:] - 1] == 10)
    fresh[w.first[:-1][w.first[:-1] < len(s)]] = True
    name = _UPPER[raw[s]] & ~fresh & ~number
    after = np.zeros(len(s), bool)
    after[1:] = number[:-1] & ~fresh[1:]
    unit = after & np.isin(h, _unit_hashes())
    slot = number | name | unit
    t = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return w.first, t, np.where(slot, h | np.uint64(1), np.uint64(0)), h


def _windows(first: np.ndarray, t: np.ndarray, slots: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows inside documents; of those of WINDOW words the ones with enough literal words."""
    h = window_hashes(t, size)
    ok = inside(first, size, len(t))
    if len(h) and size == WINDOW:
        literal = np.cumsum(np.concatenate([[0], slots == 0]))
        ok &= 2 * (literal[WINDOW:] - literal[:-WINDOW]) >= WINDOW
    at = np.flatnonzero(ok)
    return at, h[at]


def _plain(first: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of plain words; their hashes differ from those of templates."""
    at = np.flatnonzero(inside(first, size, len(h)))
    return at, window_hashes(h, size)[at] ^ _PLAIN


ITEM = "item_id long, item long, form int, k int, n int, size int, h long, slots array<long>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, keys, rows = b["item_id"].to_pylist(), b["text"].to_pylist(), b["item"].to_pylist(), []
        offsets, data = buffers(b["text"])
        for i, item in enumerate(ids):
            first, t, slots, plain = templates(offsets[i : i + 2], data)
            if not len(t):
                continue
            size = min(len(t), WINDOW)
            forms = [(0, t, slots)]
            if slots[0] == 0 and texts[i].lstrip(BLANKS + ".,;:!?\"'()[]{}")[:1].isupper():
                forms.append((1, np.append(_NAME, t[1:]), np.append(plain[0] | np.uint64(1), slots[1:])))
            for form, x, s in forms:
                if size < WINDOW and (s == 0).sum() * 2 < size:
                    continue
                at, h = _windows(first, x, s, size)
                rows += [(item, keys[i], form, int(k), len(at), size, int(y), s[k : k + size].view(np.int64).tolist()) for k, y in zip(at, h.view(np.int64), strict=True)]
            at, h = _plain(first, plain, size)
            rows += [(item, keys[i], 2, int(k), len(at), size, int(y), []) for k, y in zip(at, h.view(np.int64), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64())), strict=True)], names=[x.split()[0] for x in ITEM.split(", ")])


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap (of BITS bits) of the hashes, built by the tasks and united on the driver, and the window sizes below WINDOW."""

    def run(batches):
        bits, sizes = np.zeros(BITS // 8, np.uint8), set()
        for b in batches:
            x = b["h"].to_numpy().view(np.uint64) & np.uint64(BITS - 1)
            np.bitwise_or.at(bits, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))
            sizes |= set(b["size"].to_pylist())
        yield pa.RecordBatch.from_pydict({"bits": pa.array([packed(bits)], pa.binary()), "sizes": pa.array([sorted(sizes)], pa.list_(pa.int32()))})

    bits, sizes = np.zeros(BITS // 8, np.uint8), set()
    for r in windows.coalesce(8).mapInArrow(lean(run), "bits binary, sizes array<int>").toLocalIterator():
        bits |= unpacked(bytes(r["bits"]), np.uint8)
        sizes |= set(r["sizes"])
    return bits, sorted(sizes - {WINDOW})


def matches(docs: DataFrame, items: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, item_id, share, n_slots) for each document and item found in it; docs(doc_id, text), items(item_id, text).

    key: a long column that tells documents of one doc_id apart, returned as well (a row for each); without it their texts do."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.xxhash64("item_id", "text")).distinct()
    windows = items.repartition(1 if items.limit(20_001).count() <= 20_000 else 64, F.xxhash64("text")).mapInArrow(lean(_items), ITEM)
    bits, short = _bitmap(windows)
    shared = docs.sparkSession.sparkContext.broadcast((packed(bits), short))
    del bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, short = unpacked(shared.value[0], np.uint8), shared.value[1]
        for b in batches:
            offsets, data = buffers(b["text"])
            ids, rows = b["doc_id"], b["row"].to_numpy()
            for lo, hi in pieces(offsets):
                first, t, slots, plain = templates(offsets[lo : hi + 1], data)
                for size in [WINDOW, *short]:
                    for literal in (False, True):
                        at, h = _plain(first, plain, size) if literal else _windows(first, t, slots, size)
                        x = h & np.uint64(BITS - 1)
                        hit = (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at, h = at[hit], h[hit]
                        if not len(at):
                            continue
                        doc = np.searchsorted(first, at, "right") - 1
                        found = [[] if literal else slots[a : a + size].view(np.int64).tolist() for a in at]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + doc)), pa.array(rows[lo + doc]), pa.array((at - first[doc]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row", "pos", "h", "found"])

    row = F.xxhash64("doc_id", "text") if key is None else F.col(key).cast("long")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", row.alias("row"))
    scratch = Scratch(docs.sparkSession)
    windows, hits = scratch.keep(windows, "windows"), scratch.keep(docs.mapInArrow(lean(run), "doc_id long, row long, pos int, h long, found array<long>"), "hits")
    # a form that is found misses at most n - ceil(SHARE * n) windows: one of so many and one more, its rarest, names each
    # candidate. So windows that many items share, as boilerplate is, bring no pairs of their own
    often = windows.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("item", "form").orderBy("often", "h", "k")
    names = windows.join(often, "h").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= F.col("n") - F.ceil(SHARE * F.col("n") - 1e-9) + 1)
    asked = hits.select("doc_id", "row", "h").distinct().join(names.select("h", "item", "form"), "h").select("doc_id", "row", "item", "form").distinct()
    asked = asked.join(windows, ["item", "form"])
    same = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("row") == F.col("r")) & (F.col("h") == F.col("w"))
    hits = asked.join(hits.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("h").alias("w"), "pos", "found"), same).drop("d", "r", "w")
    # one row for each alignment: windows covered, and the pairs of values in its slots
    of = ["doc_id", "row", "item_id", "item", "form", "n"]
    pairs = F.array_distinct(F.filter(F.arrays_zip("slots", "found"), lambda x: x["slots"] != 0))
    aligned = hits.groupBy(*of, (F.col("pos") - F.col("k")).alias("start")).agg(F.collect_set("k").alias("ks"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    one = lambda c: F.size(F.array_distinct(F.transform("pairs", lambda x: x[c]))) == F.size("pairs")
    whole = aligned.where(one("slots") & one("found")).groupBy(*of).agg(F.size(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("covered"), F.max(F.size("pairs")).alias("n_slots"))
    found = whole.where(F.col("covered") >= SHARE * F.col("n")).withColumnRenamed("row", key or "row")
    return found.groupBy("doc_id", *([] if key is None else [key]), "item_id").agg(F.max(F.col("covered") / F.col("n")).alias("share"), F.max("n_slots").alias("n_slots"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
