"""N-gram Jaccard join (operator 8): exact set-similarity classes through skipped index lists and derived answers.

Two documents link when the Jaccard similarity of their sets of distinct five-word shingles is 0.8 or more. Steps:

1. One scan gives each document its set size and a 64-bit signature of its set; equal sets are one *set* from here on.
   It also counts shingles in 2 ** 22 hash buckets (a table of fixed size), which defines one global order, rare first.
2. A second scan emits the *prefix* of every set, n - ceil(0.8 n) + 1 shingles in that order: two sets that link share
   one of them. These are the index lists, dealt by shingle. A list is taken in blocks: a block pair is skipped when its
   sizes or positions leave too little room for the overlap needed, and members that no other member can reach go.
   Shingles of buckets with more than HOT documents may have longer lists: they are dealt with a salt, and not pruned.
3. The least signature of a list is its *pivot*; the sets of all lists with one pivot are a *group*. Each member's exact
   answer against the pivot is computed from the texts, in slices of about SLICE members, and gives links. It is
   kept with what the member lacks of the pivot (a bitmap) and has beyond it (hashes).
4. In groups whose members are still of different classes, members are compared by these answers alone:
   |x ^ y| = |(x ^ p) ^ (y ^ p)|, so a set's answers derive from those of a similar set, exactly and without
   texts. A range of members whose distances from the pivot differ too much is skipped, and so are members that one
   class holds by now: a block of m members returns m - 1 links at most, never its pairs. Groups of more than HELD
   members (or of large answers) are dealt as pairs of blocks.

Nothing is capped. A null text, or one without words, has an empty set and links with nothing; a text with fewer than
five words has one shingle, the whole sequence. Rows that repeat a doc_id are documents of their own: each stands in the
class of its text. A null doc_id counts for no component_id; where a class has no other, its component_id is null. An
empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, buffers, gathered, lean, mix, packed, pieces, summed, table, table_rows, unpacked, window_hashes, words_of
from tideline.llm.components import components

SHINGLE = 5
BUCKETS = 1 << 22
#: Documents in a bucket beyond which its shingles' lists are dealt with a salt, in SALTS parts.
HOT = 4096
SALTS = 16
#: Members of a list that are compared at a time; lists up to SMALL are compared many at a time.
BLOCK = 64
SMALL = 24
#: Members of a group whose texts meet in one task.
SLICE = 2000
#: Members, and bytes of their answers, that are compared with each other in one task.
HELD = 4096
HELD_BYTES = 16 << 20
#: Sets (16 bytes each) that are broadcast to pick texts; more go by a shuffle.
BROADCAST_SETS = 500_000


def sets_of(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for lo, hi in pieces(offsets):
        w = words_of(offsets[lo : hi + 1], data, lower=True)
        h = window_hashes(w.hash, SHINGLE)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= SHINGLE:
                out.append(np.unique(h[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(window_hashes(w.hash[a:b], int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """Of a set: 64 bits, as a signed integer; 0 for the empty set."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


SCAN = "doc_id long, row long, n long, sig long, name string, part int, body binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, n, sig), and at the end the bucket counts as rows of TABLE."""
    counts = np.zeros(BUCKETS, np.uint32)
    waiting: list[np.ndarray] = []
    for b in batches:
        sets = sets_of(*buffers(b["text"]))
        waiting += [s >> np.uint64(42) for s in sets]
        if sum(map(len, waiting)) > BUCKETS:
            counts += np.bincount(np.concatenate(waiting).view(np.int64), minlength=BUCKETS).astype(np.uint32)
            waiting = []
        n = len(sets)
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "row": b["row"], "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([_signature(s) for s in sets], pa.int64()), "name": pa.nulls(n, pa.string()), "part": pa.nulls(n, pa.int32()), "body": pa.nulls(n, pa.binary())})
    if waiting:
        counts += np.bincount(np.concatenate(waiting).view(np.int64), minlength=BUCKETS).astype(np.uint32)
    t = table_rows("shingles", counts)
    none = pa.nulls(t.num_rows, pa.int64())
    yield pa.RecordBatch.from_pydict({"doc_id": none, "row": none, "n": none, "sig": none, "name": t["name"], "part": t["part"], "body": t["body"]})


# ---------------------------------------------------------------- index lists


PREFIX = "token long, salt int, sig long, n int, pos int"


def _prefixes(ranks_b) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = unpacked(ranks_b.value, np.uint16).astype(np.uint64) << np.uint64(48)
        seen: set[int] = set()
        for b in batches:
            tokens, sigs, sizes, places = [], [], [], []
            for s in sets_of(*buffers(b["text"])):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()  # repeats are removed later; this only saves rows
                seen.add(sig)
                n = len(s)
                k = n - (4 * n + 4) // 5 + 1
                order = np.sort(ranks[(s >> np.uint64(42)).view(np.int64)] | (s & np.uint64((1 << 48) - 1)))
                tokens.append(order[:k])
                sigs.append(np.full(k, sig, np.int64))
                sizes.append(np.full(k, n, np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                token, sig = np.concatenate(tokens), np.concatenate(sigs)
                salt = np.where(token >> np.uint64(48) > HOT, 1 + sig % SALTS, 0).astype(np.int32)
                out = pa.RecordBatch.from_pydict({"token": token.view(np.int64), "salt": salt, "sig": sig, "n": np.concatenate(sizes), "pos": np.concatenate(places)})
                for i in range(0, out.num_rows, 1 << 17):
                    yield out.slice(i, 1 << 17)

    return run


def _reach(n, p, m, q):
    """Whether sets of n and m shingles that share one at their places p and q can link: 9 |x & y| >= 4 (|x| + |y|)."""
    return 9 * (np.minimum(p, q) + np.minimum(n - p, m - q)) >= 4 * (n + m)


def _reached(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of one list: the members that some other member can reach. Taken by size, in blocks of BLOCK."""
    order = np.argsort(n, kind="stable")
    n, pos = n[order], pos[order]
    ok = np.zeros(len(n), bool)
    starts = np.arange(0, len(n), BLOCK)
    least, most = n[starts], n[np.minimum(starts + BLOCK, len(n)) - 1]
    room, place = np.maximum.reduceat(n - pos, starts), np.maximum.reduceat(pos, starts)
    for a, at in enumerate(starts.tolist()):
        x = slice(at, at + BLOCK)
        for b in range(a, len(starts)):
            if 5 * most[a] < 4 * least[b]:
                break  # all further blocks are too large
            if 9 * (min(room[a], room[b]) + min(place[a], place[b])) < 4 * (least[a] + least[b]):
                continue
            y = slice(starts[b], starts[b] + BLOCK)
            if ok[x].all() and ok[y].all():
                continue
            hit = _reach(n[x, None], pos[x, None], n[None, y], pos[None, y])
            if a == b:
                np.fill_diagonal(hit, False)
            ok[x] |= hit.any(axis=1)
            ok[y] |= hit.any(axis=0)
    out = np.empty(len(n), bool)
    out[order] = ok
    return out


LIST = "token long, p long, x long"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, salt, sig): (token, pivot, member) of whole lists, or (token, null, member) of the parts of a salted one.

    Holds the last list between batches, HOT documents at most; a salted part is streamed.
    """

    def done(t, salt, s, n, p) -> pa.RecordBatch:
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, salt, s, n, p = (c[new] for c in (t, salt, s, n, p))
        edge = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(t)))
        of = np.repeat(np.arange(len(edge)), size)
        keep = salt > 0
        small = (size > 1) & (size <= SMALL)
        row = np.flatnonzero(small[of] & ~keep)
        reps = size[of[row]]
        i = np.repeat(row, reps)
        j = edge[of[i]] + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        hit = (i != j) & _reach(n[i], p[i], n[j], p[j])
        keep[i[hit]] = True
        for g in np.flatnonzero(size > SMALL).tolist():
            x = slice(edge[g], edge[g] + size[g])
            if not salt[edge[g]]:
                keep[x] = _reached(n[x], p[x])
        t, salt, s = t[keep], salt[keep], s[keep]
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        pivot = s[np.flatnonzero(first)][np.cumsum(first) - 1] if len(t) else s
        out = (salt > 0) | (pivot != s)
        return pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(pivot[out], mask=salt[out] > 0), pa.array(s[out])], names=["token", "p", "x"])

    held = None
    for b in batches:
        cols = [b[c].to_numpy().astype(np.int64) for c in ("token", "salt", "sig", "n", "pos")]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        t, salt = cols[0], cols[1]
        cut = len(t) if len(t) and salt[-1] else int(np.searchsorted(t, t[-1])) if len(t) else 0
        if cut:
            yield done(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield done(*held)


# ---------------------------------------------------------------- answers against pivots


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        at, data = buffers(b["text"])
        yield pa.RecordBatch.from_pydict({"sig": b["sig"], "z": pa.array([press.compress(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)], pa.binary())})


ANSWER = "p long, x long, m long, link boolean, n int, far int, lacks binary, adds binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (p, slice, x, m, slices, z), sorted with the pivot first: each member's answer. What it lacks and adds is left out where
    the whole group is linked."""
    open_ = zstandard.ZstdDecompressor()
    now, pivot, last, found, held = None, None, None, [], 0

    def made() -> pa.RecordBatch:
        whole = now[2] == 1 and all(r[1] for r in found)
        k = len(found)
        x, link, n, far, lacks, adds = zip(*found, strict=True)
        clear = [None] * k if whole else None
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * k, pa.int64()), pa.array(x, pa.int64()), pa.array([now[3]] * k, pa.int64()), pa.array(link, pa.bool_()), pa.array(n, pa.int32()), pa.array(far, pa.int32()), pa.array(clear or lacks, pa.binary()), pa.array(clear or adds, pa.binary())], names=[c.split()[0] for c in ANSWER.split(", ")])

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            b = batch.slice(lo, 256)
            texts = [open_.decompress(z.as_py()) for z in b["z"]]
            sets = sets_of(np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.frombuffer(b"".join(texts), np.uint8))
            for key, x, s in zip(zip(*(b[c].to_pylist() for c in ("p", "slice", "slices", "m")), strict=True), b["x"].to_pylist(), sets, strict=True):
                if key != now:
                    if found:
                        yield made()
                    now, pivot, last, found, held = key, s, x, [], 0
                    continue
                if x == last:
                    continue
                last = x
                at = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                both = pivot[at] == s
                common = int(both.sum())
                lacks = np.ones(len(pivot), np.uint8)
                lacks[at[both]] = 0
                far = len(pivot) + len(s) - 2 * common
                link = 9 * far <= len(pivot) + len(s)
                alone = key[3] == 1  # nothing to compare it with
                found.append((x, link, len(s), far, None if alone else np.packbits(lacks).tobytes(), None if alone else s[~both].tobytes()))
                held += 0 if alone else len(pivot) // 8 + 8 * (len(s) - common)
                if held > HELD_BYTES:
                    now = (now[0], now[1], 2, now[3])
                    yield made()
                    found, held, now = [], 0, key
    if found:
        yield made()


# ---------------------------------------------------------------- derived answers


def forest(n: np.ndarray, far: np.ndarray, label: np.ndarray, side: np.ndarray | None, lacks: list[bytes], adds: list[bytes]) -> list[tuple[int, int]]:
    """Links (members i, j) that join the classes (label) of one pivot's members; none within a class. side: only members of different sides are compared."""
    order = np.argsort(far, kind="stable")
    n, far, label = n[order], far[order], label[order]
    side = None if side is None else side[order]
    bits = np.array([lacks[i] for i in order], dtype=f"S{max(1, max(map(len, lacks)))}")
    width = bits.dtype.itemsize
    bits = np.frombuffer(bits.tobytes(), np.uint8).reshape(len(n), width)
    bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -width % 8)))).view(np.uint64)
    own = [np.frombuffer(adds[i], np.uint64) for i in order]
    size = np.array([len(a) for a in own])
    keys, ids = np.unique(np.concatenate(own), return_inverse=True)
    of = np.repeat(np.arange(len(n)), size)
    by = np.argsort(ids, kind="stable")
    edge = np.searchsorted(ids[by], np.arange(len(keys) + 1))
    lists, shared = of[by], np.diff(edge) > 1
    mine = np.split(ids, np.cumsum(size)[:-1])
    largest, out = int(n.max()), []
    for i in range(1, len(n)):
        lo = int(np.searchsorted(far, far[i] - (int(n[i]) + largest) // 9))
        j = label[lo:i] != label[i]
        if side is not None:
            j &= side[lo:i] != side[i]
        j = np.flatnonzero(j) + lo
        if not len(j):
            continue
        room = n[j] + n[i]
        fits = 9 * np.maximum(far[i] - far[j], np.abs(n[i] - n[j])) <= room
        j, room = j[fits], room[fits]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        fits = 9 * (apart + np.abs(size[j] - size[i])) <= room
        j, room, apart = j[fits], room[fits], apart[fits]
        if not len(j):
            continue
        some = [lists[edge[k] : edge[k + 1]] for k in mine[i][shared[mine[i]]].tolist()]
        common = np.bincount(np.concatenate(some), minlength=len(n))[j] if some else 0
        j = j[9 * (apart + size[j] + size[i] - 2 * common) <= room]
        for k in j[np.unique(label[j], return_index=True)[1]].tolist():
            out.append((int(order[i]), int(order[k])))
        label[np.isin(label, label[j])] = label[i]
    return out


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of answers (p, a, b, x, side, n, far, label, lacks, adds), sorted by (p, a, b): links (a, b)."""

    def done(t: pa.Table) -> pa.RecordBatch:
        c = {k: t[k].to_numpy() for k in ("x", "side", "n", "far", "label")}
        two = t["a"][0].as_py() != t["b"][0].as_py()
        made = forest(c["n"].astype(np.int64), c["far"].astype(np.int64), c["label"].copy(), c["side"] if two else None, t["lacks"].to_pylist(), t["adds"].to_pylist())
        i, j = np.array(made, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_pydict({"a": pa.array(c["x"][i], pa.int64()), "b": pa.array(c["x"][j], pa.int64())})

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.array([batch[c].to_numpy() for c in ("p", "a", "b")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi == lo:
                continue
            mine = tuple(key[:, lo].tolist())
            if mine != now and held:
                yield done(pa.Table.from_batches(held))
                held = []
            now = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield done(pa.Table.from_batches(held))


def similarity_classes(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text), and the column ``keep`` of docs, if one is named (a long)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    row = F.xxhash64("doc_id", "text") if keep is None else F.col(keep).cast("long")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", row.alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = scratch.keep(docs.mapInArrow(lean(_scan), SCAN), "scan")
    counts = gathered(summed(scan.where("name is not null").select("name", "part", "body"))).get("shingles", np.zeros(BUCKETS, np.uint32))
    sets = scan.where("name is null").select("doc_id", "row", "n", "sig")
    ranks = spark.sparkContext.broadcast(packed(np.minimum(counts, 65535).astype(np.uint16)))
    del counts
    rows = docs.select("text").mapInArrow(lean(_prefixes(ranks)), PREFIX)
    lists = scratch.keep(rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "sig").mapInArrow(lean(_lists), LIST), "lists")
    ranks.unpersist()

    # (pivot, member) of every list; a salted one gets its pivot here
    salted = lists.where("p is null").select("token", "x")
    pivots = salted.groupBy("token").agg(F.min("x").alias("p"), F.max("x").alias("z")).where("p < z").select("token", "p")
    members = lists.where("p is not null").select("p", "x").unionByName(salted.join(pivots, "token").where("x <> p").select("p", "x")).distinct()
    members = scratch.keep(members, "members")
    scratch.drop(lists)

    # one document's text stands for a set
    sigs = members.select(F.col("p").alias("sig")).unionByName(members.select(F.col("x").alias("sig"))).distinct()
    heads = scratch.keep(sets.where("n > 0").groupBy("sig").agg(F.min("row").alias("row")).join(sigs, "sig", "left_semi"), "heads")
    few = heads.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    texts = docs.select("row", "text").join(F.broadcast(heads) if few else heads, "row").select("sig", "text").mapInArrow(lean(_squeezed), "sig long, z binary").groupBy("sig").agg(F.min("z").alias("z"))
    sizes = members.groupBy("p").agg(F.count(F.lit(1)).alias("m")).withColumn("slices", F.ceil(F.col("m") / SLICE))
    asked = members.join(sizes, "p").select("p", "x", "m", "slices", F.pmod(F.xxhash64("x"), F.col("slices")).alias("slice"))
    asked = asked.unionByName(sizes.select("p", F.col("p").alias("x"), "m", "slices", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")))
    asked = asked.join(texts, F.col("x") == F.col("sig")).select("p", "slice", "x", "m", "slices", "z", (F.col("x") != F.col("p")).alias("other"))
    answers = scratch.keep(asked.repartition(parts, "p", "slice").sortWithinPartitions("p", "slice", "other", "x").drop("other").mapInArrow(lean(_answers), ANSWER), "answers")
    labels = components(scratch, answers.where("link").select(F.col("p").alias("a"), F.col("x").alias("b")))

    # groups of several classes
    left = answers.where("lacks is not null").join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    mixed = left.groupBy("p").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count(F.lit(1)).alias("k"), F.sum(F.length("lacks") + F.length("adds")).alias("bytes")).where("u <> v")
    mixed = mixed.select("p", F.greatest(F.ceil(F.col("k") / HELD), F.ceil(F.col("bytes") / HELD_BYTES)).cast("int").alias("blocks"))
    left = left.join(mixed, "p").withColumn("side", F.pmod(F.xxhash64("x", F.lit(1)), F.col("blocks")).cast("int"))
    left = left.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("p", F.least("side", "to").alias("a"), F.greatest("side", "to").alias("b"), "x", "side", "n", "far", "label", "lacks", "adds")
    links = scratch.keep(left.repartition(parts, "p", "a", "b").sortWithinPartitions("p", "a", "b").mapInArrow(lean(_derived), "a long, b long"), "links")
    scratch.drop(answers)
    if links.limit(1).count():
        labels = components(scratch, links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    least = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(labels, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("label", "sig").alias("label"))
    tops = least.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = least.join(tops, "label").select(F.col("sig").alias("s"), "component_id", F.col("label").alias("class"))
    out = sets.join(classes, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, *([] if keep is None else [F.col("row").alias(keep), F.when(F.col("n") > 0, F.col("class")).alias("class")]))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
least AS (SELECT x AS r, min(doc_id) AS d FROM reach JOIN t ON t.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(d, doc_id)) AS component_id
FROM t LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""
