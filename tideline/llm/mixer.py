"""LM scoring (operator 3): online logistic mixing of hashed-context predictors, beside a smoothed unigram base score.

A text is scored as its tokens: words (A-Z lower-cased), and an end mark. What is learned are counts over *all* training
texts, exact and growing with them: of words, and of *segments* after the two words before them. A segment starts where a
hash of the two words before is divisible by SPREAD, and ends before the next one: equal passages have equal segments. Of a
training document's own score its own counts are taken out first. The probabilities are

    segment: A * (count after its context / count of the context) + (1 - A) * product of its words
    word:    C * (share in the document so far) + (1 - C) * known

where ``known`` is the word's share of all training tokens, or for an unknown one the probability of an unknown word (the share
of words that occur once) times that of its spelling. A and C are outputs of logistic mixers:

* inputs are the logits of several predictors: for A the rate at which contexts of as many occurrences and followers were
  right in training (leaving one out), and how often contexts were right for the last 4 and 16 segments of the document; for C
  a prior that grows along the document, and how much the document's own words were worth lately, in two spans;
* a gate (the context's count, the place in the document) selects the weights. They start from START and are learned online,
  along each document, by the gradient of its coding cost, in blocks of BLOCK steps.

Spelling: each byte is a path of binary decisions through a fixed Huffman tree. Hashes of the last 2, 3 and 4 bytes of the
word and the tree node are slots that count zeros and ones; their logits are combined by gates, the evidence in the longer contexts.
Counted are the words that occur once in the training texts of a piece, for all pieces; for ``refined_score`` all words of all training
texts. What a byte follows in four bytes is bounded, so these tables are of fixed size.

That is ``score``. ``refined_score``, which op3_lm_score returns as its score, goes through the whole method:

* four mixers: B (the bits of every word, known or not: the contexts' logits), U (whether its bits or its share of the known words
  give the next word: both can, so it mixes the two probabilities), C and A. They learn online in the scan, over all training texts,
  by the counts that a piece has of other documents (B: from each distinct word of a piece, by the counts that the task has so far).
  Tasks' weights are averaged by their steps. From there on they learn along each document that is scored;
* an adaptive map for each refines its output: by a small context and a bin of the mixer's logit, how often the event came. Maps
  add up over all training texts and go on along each document. The probability used is halfway between both, in logits.

All else that a document's score depends on is a sum over all training texts, or happens inside the document: but for the
plain score's spelling of unknown words and what the mixers have learned, scores don't depend on how documents are cut into pieces, and they never
depend on the order in which tasks run. Both scores are sums of log10 over all tokens; bits_per_byte follows from refined_score.

1. One scan cuts the documents into pieces of about PIECE bytes and emits each piece's text, and its distinct words and
   contexts with their training counts, in buckets by hash. So a frequent word costs an entry for each piece, not document.
2. A bucket's task adds up the counts of its words and contexts and returns to each piece what it asked for.
3. A piece's task scores its documents. Memory is bounded by pieces and buckets.

Training texts are those of ``train`` rows. A null text has one token, the end mark. Documents of one doc_id or of none, and
repeated rows, are separate rows. Without training texts all counts are 0 and the base score is 0 / 0: defined as 0. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import _BASE, _INV, CHUNK, Scratch, delete, fresh, gathered, lean, mix, packed, powers, summed, table, table_rows, unpacked, words_of

#: Bytes of the word so far: slots (a power of two).
CONTEXTS = {2: 1 << 18, 3: 1 << 19, 4: 1 << 20}
PRIOR = 0.4
#: Evidence (zeros and ones of a slot) at which the next gate begins, and the weight of the context in each gate.
EVIDENCE = (1, 2, 4, 8, 16, 64, 512)
TRUST = (0.0, 0.4, 0.57, 0.75, 0.86, 0.93, 0.98, 0.995)
#: Logits are stored in 1/SCALE units, in 8 bits.
SCALE = 15.0
#: First weights of the mixers' inputs, their learning rate, and the tokens between two updates.
START = {"A": (0.8, 0.25, 0.25, 0.0), "C": (0.6, 0.3, 0.3, 0.0)}
RATE = 0.02
BLOCK = 32
GATES = 6
#: Refinement. Of each learned mixer: first weights, gates, gates within a document, contexts of its map, bound of its logits,
#: first block of steps. U: is the next word spelled; B: the bits of a word's spelling; A and C as above.
LEVELS = len(TRUST)
MIXERS = {"U": ((0.5, 0.25, 0.25, 0.0), GATES, GATES, 2 * GATES, 9, BLOCK), "C": (START["C"], GATES, GATES, 2 * GATES, 9, BLOCK), "A": (START["A"], GATES, GATES, 2 * GATES, 9, BLOCK), "B": (None, LEVELS**3, LEVELS, 32, 11, 8 * BLOCK)}
#: Blocks double along a document up to so many times the first.
WIDE = 32
#: Bins of a map over the mixer's logit, what the identity weighs in a bin, and what all that was learned in training weighs at most.
BINS = 24
IDENTITY = 4.0
MEMORY = 256.0
#: In training: steps between two updates, and size of the first updates.
LEARN = 8192
ETA = 0.05
#: Documents that are followed at a time; bytes of distinct words that the mixer of bits learns from before it begins a new block.
DOCS = 1024
SPELL = 1 << 14
#: Documents, and their bits, that are spelled side by side.
SPELL_DOCS = 512
SPELL_STEPS = 1 << 20
#: In a bit's place: how far up the bit stands, above the map's first bin.
PLACE = 10
SPOT = (1 << PLACE) - 1
#: Learned sums are added up as integers of 1/FIXED units, so that no order of tasks matters.
FIXED = 1 << 20
#: One in so many contexts starts a segment.
SPREAD = 2
#: Prior weight of the document's own words after t tokens: CACHE * t / (t + WARM).
CACHE = 0.2
WARM = 200.0
#: Bytes of text in a piece.
PIECE = 2 << 20
#: Low bits of a segment's key: those of its words; the others are those of its context. Bits of a word's key.
FOLLOWER = 28
WORD_BITS = 56
_END, _BEFORE = np.uint64(0x5DEECE66D), np.uint64(0x2545F4914F6CDD1D)


# ---------------------------------------------------------------- the tree


def _tree() -> tuple[np.ndarray, ...]:
    """A Huffman tree over bytes from a rule of thumb for their weights: (length, offset, flat nodes, flat bits)."""
    weight = np.full(256, 1e-5)
    weight[128:192] = 2e-3
    weight[[0xC3, 0xC2]] = 1.5e-2
    weight[33:65] = 2e-3
    weight[48:58] = 1e-3
    weight[[44, 46]] = 2e-2
    for i, c in enumerate(b" enthiaosrdlucgbpmfwvyqjzxk"):
        weight[c] = 0.17 / (1 + 0.18 * i) if i else 0.17
    weight[10] = 3e-3
    heap = [(w, i, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    length, offset, nodes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64), [], []
    for c in range(256):
        path, at = [], c
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        offset[c], length[c] = len(nodes), len(path)
        nodes += [p for p, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return length, offset, np.array(nodes, np.uint32), np.array(bits, np.uint8)


LENGTH, OFFSET, NODES, BITS = _tree()
_SALT = (NODES * np.uint32(0x9E3779B1)).astype(np.uint32)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


# ---------------------------------------------------------------- spelling


def _decisions(d: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slot hashes by context, bits, decisions of each word) for words d[starts[i]:starts[i + 1]], each with its closing blank."""
    n = len(d)
    size = np.diff(np.append(starts, n))
    j = (np.arange(n) - np.repeat(starts, size)).astype(np.int32)
    v, recent = d.astype(np.uint32), np.zeros(n, np.uint32)
    hashes = []
    for k in range(1, 5):
        recent[k:] |= np.where(j[k:] >= k, v[:-k], 0).astype(np.uint32) << np.uint32(8 * (k - 1))
        if k in CONTEXTS:
            x = (recent + np.uint32(k)) * np.uint32(0x85EBCA6B)
            hashes.append((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35))
    length = LENGTH[d]
    ends = np.cumsum(length)
    path = np.repeat(OFFSET[d] - ends + length, length) + np.arange(int(ends[-1]) if n else 0)
    salt = _SALT[path]
    edge = np.concatenate([[0], ends])
    made = []
    for h in hashes:
        x = np.repeat(h, length) + salt
        made.append(x ^ (x >> np.uint32(13)))
    return made, BITS[path], edge[np.append(starts[1:], n)] - edge[starts]


def _chunks(words: list[bytes], size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lo = 0
    while lo < len(words):
        hi, total = lo, 0
        while hi < len(words) and (hi == lo or total < size):
            total += len(words[hi]) + 1
            hi += 1
        some = words[lo:hi]
        size_of = np.array([len(w) + 1 for w in some])
        yield np.frombuffer(b" ".join(some) + b" ", np.uint8), np.cumsum(size_of) - size_of
        lo = hi


def count(words: list[bytes], tables: list[np.ndarray]) -> None:
    """Adds the decisions of words to the tables (zeros and ones alternate)."""
    held: list[list[np.ndarray]] = [[] for _ in tables]

    def add() -> None:
        for parts, counts in zip(held, tables, strict=True):
            counts += np.bincount(np.concatenate(parts), minlength=len(counts)).astype(np.uint32)
            parts.clear()

    for d, starts in _chunks(words):
        slots, bits, _ = _decisions(d, starts)
        for h, parts, counts in zip(slots, held, tables, strict=True):
            parts.append(((h & np.uint32(len(counts) // 2 - 1)) << np.uint32(1)) | bits)
        if sum(map(len, held[0])) > 1 << 21:
            add()
    if held and held[0]:
        add()


def logits(counts: np.ndarray) -> np.ndarray:
    """8-bit logits of a table."""
    x = np.log((counts[1::2] + PRIOR) / (counts[0::2] + PRIOR))
    return np.clip(np.rint(x * SCALE), -127, 127).astype(np.int8)


def gates(counts: np.ndarray) -> np.ndarray:
    """How much evidence each slot has."""
    return np.searchsorted(np.array(EVIDENCE), counts[0::2].astype(np.int64) + counts[1::2], "right").astype(np.int8)


def word_scores(words: list[bytes], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural logarithm of the probability of each word's spelling, from (logits, gates) of the contexts, the shortest first."""
    trust, out = np.array(TRUST, np.float32), []
    for d, starts in _chunks(words):
        slots, bits, n = _decisions(d, starts)
        z = np.zeros(len(bits), np.float32)
        for h, (t, g) in zip(slots, tables, strict=True):
            at = h & np.uint32(len(t) - 1)
            w = trust[g[at]]
            z += w * (t[at] * np.float32(1 / SCALE) - z)
        np.clip(z, -11, 11, out=z)
        np.negative(z, out=z, where=bits.astype(bool))
        cost = np.log1p(np.exp(z)).astype(np.float64)
        ends = np.cumsum(n)
        out.append(-np.add.reduceat(cost, ends - n))
    return np.concatenate(out) if out else np.zeros(0)


# ---------------------------------------------------------------- learned mixers and their refinement


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _shared(cell: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """What comes to n bins: low to the cells, high to those after them."""
    out = np.bincount(cell, low, minlength=n)
    out[1:] += np.bincount(cell, high, minlength=n)[:-1]
    return out


def _first(name: str) -> np.ndarray:
    """First weights of a mixer: (input, gate). Those of B give the longer contexts the share of trust that their evidence earns."""
    start, gates, *_ = MIXERS[name]
    if start is not None:
        return np.repeat(np.array(start)[:, None], gates, axis=1)
    two, three, four = (np.array(TRUST)[i] for i in np.unravel_index(np.arange(gates), (LEVELS,) * 3))
    return np.stack([two * (1 - three) * (1 - four), three * (1 - four), four, np.zeros(gates)])


class Steps:
    """Binary steps of documents, in their order. x: inputs by step; gate, near: the cells of weights, of the corpus and of the
    document; spot: the context of the map. What happened is ``bit``, or, where both parts of a mixture can have made the token,
    their logarithms a (with the mixer's probability) and b (without)."""

    def __init__(self, x, gate, spot, doc, bit=None, a=None, b=None, near=None):
        self.x, self.gate, self.spot, self.doc = np.stack([*x, np.ones(len(gate))]), gate, spot, doc
        self.near = gate if near is None else near
        self.bit, self.a, self.b = None if bit is None else np.asarray(bit, float), a, b
        self.odds = None if bit is not None else a - b

    def event(self, at, z: np.ndarray) -> np.ndarray:
        """How far the mixer's event came, if it has the logit z."""
        return self.bit[at] if self.bit is not None else _sigmoid(self.odds[at] + z)

    def cost(self, z: np.ndarray) -> np.ndarray:
        """The logarithms of the probabilities of what happened, if the events have the logits z."""
        if self.bit is not None:
            return -np.log1p(np.exp((1 - 2 * self.bit) * z))
        return np.logaddexp(self.a + z, self.b) - np.log1p(np.exp(z))


class Model:
    """The weights of a mixer, and its adaptive map: by context and bin of the mixer's logit, how often the event came.

    The probability used lies halfway (in logits) between the mixer's and what the map has for it, between two bins."""

    def __init__(self, name: str):
        self.name, (_, gates, self.cells, self.spots, self.bound, self.block) = name, MIXERS[name]
        self.weights = _first(name)
        self.slope = np.zeros_like(self.weights)
        self.steps = np.zeros(gates)
        center = np.linspace(-self.bound, self.bound, BINS)
        self.hit, self.all = np.tile(IDENTITY * _sigmoid(center), self.spots), np.full(self.spots * BINS, IDENTITY)

    def _bins(self, z: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (z + self.bound) * ((BINS - 1) / (2 * self.bound))
        lo = np.minimum(u.astype(np.int64), BINS - 2)
        return spot * BINS + lo, u - lo

    def learn(self, s: Steps, mask: np.ndarray) -> np.ndarray:
        """Learns from the steps under the mask, online and in their order; the logits that their events had."""
        out = np.empty(len(s.gate))
        for lo in range(0, len(out), LEARN):
            at = slice(lo, lo + LEARN)
            gate, x, m = s.gate[at], s.x[:, at], mask[at]
            z = self.weights[0][gate] * x[0]
            for w, v in zip(self.weights[1:], x[1:], strict=True):
                z += w[gate] * v
            np.clip(z, -self.bound, self.bound, out=z)
            cell, part = self._bins(z, s.spot[at])
            v = np.log(self.hit / (self.all - self.hit))
            out[at] = (z + (1 - part) * v[cell] + part * v[cell + 1]) / 2
            y, high = s.event(at, out[at]), m * part
            hit, much = _shared(cell, y * (m - high), y * high, len(self.hit)), _shared(cell, m - high, high, len(self.all))
            self.hit += hit
            self.all += much
            error = m * ((y if s.bit is not None else s.event(at, z)) - _sigmoid(z))
            for i in range(len(x)):
                g = np.bincount(gate, error * x[i], minlength=len(self.steps))
                self.slope[i] += g * g
                self.weights[i] += ETA * g / np.sqrt(1 + self.slope[i])
            self.steps += np.bincount(gate, m, minlength=len(self.steps))
        return out

    def sums(self) -> np.ndarray:
        """What was learned, as integers that add up over tasks."""
        center = Model(self.name)
        parts = [self.steps, ((self.weights - center.weights) * self.steps).ravel(), self.hit - center.hit, self.all - center.all]
        return np.rint(np.concatenate(parts) * FIXED).astype(np.int64)

    @classmethod
    def of(cls, name: str, sums: np.ndarray | None) -> Model:
        """From added sums: the tasks' weights averaged by their steps, and the map of all of them."""
        m = cls(name)
        if sums is not None:
            n, k = len(m.steps), m.weights.size
            s = sums / FIXED
            m.weights += s[n : n + k].reshape(m.weights.shape) / np.maximum(s[:n], 1)
            more, size = s[n + k :].reshape(2, -1), len(m.hit)
            scale = np.minimum(1, MEMORY / np.maximum(more[1], 1))
            m.hit, m.all = m.hit + more[0][:size] * scale, m.all + more[1][:size] * scale
        return m

    def state(self, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What documents add to weights and map, at first nothing."""
        return np.zeros((len(self.weights), docs * self.cells)), np.zeros(docs * len(self.hit)), np.zeros(docs * len(self.hit))

    def follow(self, s: Steps, before: tuple | None = None) -> tuple[np.ndarray, tuple | None]:
        """The logarithms of the steps' probabilities; weights and map go on learning along each document, in blocks.

        before: the state of the first document, which began earlier. Also returns that of the last one."""
        out = np.empty(len(s.gate))
        if not len(out):
            return out, before
        new = np.append(True, s.doc[1:] != s.doc[:-1])
        head, number = np.flatnonzero(new), np.cumsum(new) - 1
        edges = np.append(head[::DOCS], len(out))
        for a, z in zip(edges, edges[1:], strict=False):
            before = self._group(s, int(a), int(z), number[a:z] - number[a], np.arange(a, z) - head[number[a:z]], before if a == 0 else None, out)
        return s.cost(out), before

    def _group(self, s: Steps, start: int, stop: int, doc: np.ndarray, rank: np.ndarray, before: tuple | None, out: np.ndarray) -> tuple:
        docs, size, cells = int(doc[-1]) + 1, len(self.hit), self.cells
        weights, hit, all_ = self.state(docs)
        if before is not None:
            weights[:, :cells], hit[:size], all_[:size] = before
        most = WIDE * self.block
        block = np.where(rank < most, np.frexp(rank / self.block)[1].clip(0), rank // most + int(np.log2(WIDE)))
        # of a document's blocks the last one comes apart: what it teaches is not asked for, but by who goes on
        final = block[np.append(np.flatnonzero(np.diff(doc)), -1)]
        final[-1] = -1
        block = 2 * block + (block == final[doc])
        order = np.argsort(block.astype(np.uint16) if int(block.max()) < 1 << 16 else block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(int(block.max()) + 2)).tolist()
        for k, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)):
            if lo == hi:
                continue
            own = order[lo:hi]
            at, d = own + start, doc[own]
            gate, x, near = s.gate[at], s.x[:, at], d * cells + s.near[at]
            z = np.einsum("ij,ij->j", np.take(self.weights, gate, axis=1) + np.take(weights, near, axis=1), x)
            np.clip(z, -self.bound, self.bound, out=z)
            cell, part = self._bins(z, s.spot[at])
            mine = cell + d * size
            seen = self.hit[cell] + hit[mine]
            low = np.log(seen / (self.all[cell] + all_[mine] - seen))
            seen = self.hit[cell + 1] + hit[mine + 1]
            high = np.log(seen / (self.all[cell + 1] + all_[mine + 1] - seen))
            out[at] = final = (z + (1 - part) * low + part * high) / 2
            if k & 1:
                continue
            y = s.event(at, final)
            for where, much in ((mine, 1 - part), (mine + 1, part)):
                np.add.at(hit, where, much * y)
                np.add.at(all_, where, much)
            # a cell's step is never more than that of a whole block of BLOCK steps
            error = RATE * (s.event(at, z) - _sigmoid(z)) * np.minimum(1, BLOCK / np.bincount(near)[near])
            for i in range(len(x)):
                np.add.at(weights[i], near, error * x[i])
        last = docs - 1
        return weights[:, last * cells :].copy(), hit[last * size :].copy(), all_[last * size :].copy()


def _refresh(kept: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> None:
    """Brings one of joined()'s tables up to its counts in these slots."""
    mark = np.zeros(len(kept), bool)
    mark[slots & np.uint32(len(kept) - 1)] = True
    at = np.flatnonzero(mark)
    pairs = counts.reshape(-1, 2)[at].ravel()
    kept[at] = joined([(logits(pairs), gates(pairs))])[0]


def joined(tables: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """(logits, gates) of the contexts in one number each."""
    return [t.view(np.uint8) | (g.astype(np.int16) << 8) for t, g in tables]


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys of so many bits: the distinct ones, sorted, each key's place among them, and how often each comes."""
    low = len(key).bit_length()
    if not len(key) or bits + low > 64:
        return np.unique(key, return_inverse=True, return_counts=True)
    both = (key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    at = (both & np.uint64((1 << low) - 1)).view(np.int64)
    both >>= np.uint64(low)
    new = np.append(True, both[1:] != both[:-1])
    head, of = np.flatnonzero(new), np.empty(len(key), np.int64)
    of[at] = np.cumsum(new) - 1
    return both[head], of, np.diff(np.append(head, len(key)))


class Words(NamedTuple):
    """Words, each with its closing blank: their bytes one after another, and how many each has."""

    text: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: list[bytes] | Words) -> Words:
        return words if isinstance(words, Words) else cls(np.frombuffer(b"".join(w + b" " for w in words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)) + 1)


class Bits:
    """The bits of distinct words. Equal bytes after the same four are one *step*, whose bits are held once, one after another.
    x: the contexts' logits, in 1/SCALE; gate, near: cells of weights, of the corpus and of the document; spot: contexts of the map;
    slots: of the contexts. start, long: each step's bits; of: the steps of the words' bytes; size, n: bytes and decisions of each word.

    tables: of joined()."""

    def __init__(self, words: list[bytes] | Words, tables: list[np.ndarray]):
        d, self.size = Words.of(words)
        self.starts = np.cumsum(self.size) - self.size
        j = np.arange(len(d)) - np.repeat(self.starts, self.size)
        v, key = d.astype(np.uint64), d.astype(np.uint64)
        for k in range(1, 5):
            key[k:] |= (v[:-k] << np.uint64(8 * k)) * (j[k:] >= k)
        key[self.starts] |= np.uint64(1 << 40)
        steps, self.of, self.times = _distinct(key, 41)
        byte, recent, first = (steps & np.uint64(255)).astype(np.int64), (steps >> np.uint64(8)).astype(np.uint32), (steps >> np.uint64(40)).astype(np.int64)
        self.long = LENGTH[byte]
        ends = np.cumsum(self.long)
        self.start = ends - self.long
        self.n = np.add.reduceat(self.long[self.of], self.starts) if len(self.size) else np.zeros(0, np.int64)
        depth = np.arange(int(self.long.sum())) - np.repeat(self.start, self.long)
        path = np.repeat(OFFSET[byte], self.long) + depth
        self.bit, salt, self.slots = BITS[path], _SALT[path], []
        for k in CONTEXTS:
            h = ((recent & np.uint32((1 << 8 * k) - 1)) + np.uint32(k)) * np.uint32(0x85EBCA6B)
            h = np.repeat((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35), self.long) + salt
            self.slots.append(h ^ (h >> np.uint32(13)))
        both = [t[h & np.uint32(len(t) - 1)] for h, t in zip(self.slots, tables, strict=True)]
        self.x, (two, three, four) = [(v & 255).astype(np.uint8).view(np.int8) for v in both], ((v >> 8).astype(np.int64) for v in both)
        self.gate = (two * LEVELS + three) * LEVELS + four
        self.near = four
        self.spot = np.minimum(depth, 15) * 2 + np.repeat(first, self.long)

    def steps(self) -> Steps:
        """All words' bits, one after another."""
        long = self.long[self.of]
        at = np.repeat(self.start[self.of] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))
        return Steps([x[at] * (1 / SCALE) for x in self.x], self.gate[at], self.spot[at], np.zeros(len(at), np.int64), bit=self.bit[at], near=self.near[at])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """By bit, four small numbers in one: the mixer's inputs, which are the logits and 1; and the map's first bin, the bit (at
        PLACE) and near (above it)."""
        x = np.stack([*self.x, np.ones(len(self.bit), np.int8)], axis=1).view(np.int32)[:, 0]
        return x, (self.spot * BINS | self.bit.astype(np.int64) << PLACE | self.near << (PLACE + 1)).astype(np.int32)


class Units:
    """The bytes of texts, as their steps, in blocks of bits: equal bytes of a block are one unit. A byte in which a block ends is two parts.

    edges: the bits at which blocks begin; order: by block, which units come first. Of units: rank (the block's order), start and long
    (their bits), times. of: the units of the bytes' parts; part: each byte's first part."""

    def __init__(self, bits: Bits, steps: np.ndarray, edges: np.ndarray, order: np.ndarray):
        long = bits.long[steps]
        end = np.cumsum(long)
        cut = np.searchsorted(end, edges[1:], "right")
        inside = end[cut] - long[cut] < edges[1:]
        cut, edge = cut[inside], edges[1:][inside]
        parts = np.ones(len(steps), np.int64)
        parts[cut] = 2
        self.part = np.cumsum(parts) - parts
        name = np.repeat(steps, parts)
        k, left = len(bits.long), edge - end[cut] + long[cut]
        head = self.part[cut]
        name[head], name[head + 1] = k + 2 * np.arange(len(cut)), k + 2 * np.arange(len(cut)) + 1
        start = np.append(bits.start, np.stack([bits.start[steps[cut]], bits.start[steps[cut]] + left], axis=1).ravel())
        size = np.append(bits.long, np.stack([left, long[cut] - left], axis=1).ravel())
        ends = np.cumsum(size[name])
        first = np.searchsorted(ends, edges, "right")
        block = np.repeat(order, np.diff(np.append(first, len(name))))
        low = len(size).bit_length()
        keys, self.of, self.times = _distinct((block.astype(np.uint64) << np.uint64(low)) | name.astype(np.uint64), low + int(order.max()).bit_length())
        self.rank, name = (keys >> np.uint64(low)).astype(np.int64), (keys & np.uint64((1 << low) - 1)).astype(np.int64)
        self.start, self.long = start[name], size[name]

    def bits(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of units: the places of their bits, and where each unit's begin among them."""
        k = self.long[lo:hi]
        first = np.cumsum(k) - k
        return np.repeat(self.start[lo:hi] - first, k) + np.arange(int(k.sum())), first


def _word_sums(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p, np.cumsum(n) - n)


def _spell_groups(size: np.ndarray) -> list[int]:
    """Where groups of words begin that the mixer learns from one after another: words of SPELL bytes."""
    ends, at = np.cumsum(size), [0]
    while (stop := int(np.searchsorted(ends, (ends[at[-1] - 1] if at[-1] else 0) + SPELL)) + 1) < len(size):
        at.append(stop)
    return at


def learn_spelling(words: list[bytes] | Words, tables: list[np.ndarray], model: Model, times: np.ndarray | None = None, kept: list[np.ndarray] | None = None) -> np.ndarray:
    """Learns how to mix the contexts from the bits of words that the tables don't count yet; then, with ``times``, counts them there so
    many times each. Returns the natural logarithm of the probability that each spelling had. kept: joined() of the tables, which then
    follows their counts."""
    words = Words.of(words)
    if not len(words.size):
        return np.zeros(0)
    kept = joined([(logits(t), gates(t)) for t in tables]) if kept is None else kept
    b = Bits(words, kept)
    edge = (np.cumsum(b.n) - b.n)[_spell_groups(b.size)]
    edges = np.concatenate([np.arange(a, z, LEARN) for a, z in zip(edge, [*edge[1:], b.n.sum()], strict=True)])
    units = Units(b, b.of, edges, np.arange(len(edges)))
    cost = _learn_bits(model, b, units)[units.of]
    if times is not None:
        much = np.repeat(np.bincount(b.of, np.repeat(times, b.size), minlength=len(b.long)).astype(np.int64), b.long)
        for h, counts, table in zip(b.slots, tables, kept, strict=True):
            np.add.at(counts, ((h & np.uint32(len(counts) // 2 - 1)) << np.uint32(1)) | b.bit, much.astype(counts.dtype))
            _refresh(table, counts, h)
    return -np.add.reduceat(cost, units.part[b.starts])


def _learn_bits(m: Model, b: Bits, units: Units) -> np.ndarray:
    """What the units cost: Model.learn's rule, a block of equal rank at a time."""
    out, (rows, places) = np.empty(len(units.rank)), b.rows()
    gates = b.gate.astype(np.int16)
    edge = np.append(np.flatnonzero(np.diff(units.rank, prepend=-1)), len(out)).tolist()
    by = np.array([1 / SCALE] * len(b.x) + [1])
    scale = np.float32((BINS - 1) / (2 * m.bound))
    for lo, hi in zip(edge, edge[1:], strict=False):
        at, first = units.bits(lo, hi)
        times = np.repeat(units.times[lo:hi].astype(np.float32), units.long[lo:hi])
        gate, x, place = gates[at].astype(np.int64), rows[at].view(np.int8).astype(np.float32), places[at]
        y = place >> PLACE & 1
        sign = np.float32(1) - np.float32(2) * y.astype(np.float32)
        z = _dot(np.ascontiguousarray(m.weights.T * by, np.float32).view(np.complex128)[:, 0][gate], x)
        np.clip(z, -m.bound, m.bound, out=z)
        low, part = _bins(z, m.bound, scale)
        low += place & SPOT
        v = np.log(m.hit / (m.all - m.hit)).astype(np.float32)
        out[lo:hi] = np.add.reduceat(_cost(v, low, part, z, sign), first)
        error, high = _error(z, sign) * times, part * times
        for where, much in ((low, times - high), (low + 1, high)):
            m.hit += np.bincount(where, much * y, minlength=len(m.hit))
            m.all += np.bincount(where, much, minlength=len(m.all))
        for i, g in enumerate(_slopes(gate, x, error, by, len(m.steps))):
            m.slope[i] += g * g
            m.weights[i] += ETA * g / np.sqrt(1 + m.slope[i])
        m.steps += np.bincount(gate, times, minlength=len(m.steps))
    return out


def _dot(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The products of four weights, as a number of 16 bytes, and four inputs."""
    p = (weights.view(np.float32) * x).view(np.complex64)
    p = p[::2] + p[1::2]
    return p.real + p.imag


def _slopes(cell: np.ndarray, x: np.ndarray, error: np.ndarray, by: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each of four inputs (by is their unit): what it adds up to in each of n cells, times the errors."""
    error = error.astype(float)
    return [np.bincount(cell, x[i::4] * error, minlength=n) * c for i, c in enumerate(by[:-1])] + [np.bincount(cell, error, minlength=n) * by[-1]]


def _bins(z: np.ndarray, bound: float, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """The bin of a map below each logit, and how far the logit is from it."""
    part = (z + np.float32(bound)) * scale
    low = np.minimum(part.astype(np.int8), np.int8(BINS - 2))
    part -= low
    return low.astype(np.int64), part


def _cost(v: np.ndarray, low: np.ndarray, part: np.ndarray, z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Minus the logarithm of what happened, from the map's logits and the mixer's."""
    a = v[low]
    b = v[1:][low]
    b -= a
    b *= part
    b += a
    b += z
    b *= sign
    b *= np.float32(0.5)
    np.exp(b, out=b)
    b += np.float32(1)
    return np.log(b, out=b)


def _error(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """1 - the probability of the event that came, signed: its logit is -z * sign."""
    e = np.exp(z * sign)
    e += np.float32(1)
    np.divide(sign, e, out=e)
    e -= sign
    return e


def spell(words: list[bytes] | Words, doc: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], model: Model, of: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each word's spelling, for the words of documents in their order: all of their bits, as
    Model.follow has them, with the weights and the map going on along each document. of: the words' places among distinct ones."""
    if of is None:
        of = np.arange(len(Words.of(words).size))
    if not len(of):
        return np.zeros(0)
    # by distinct step: what doesn't depend on the document
    b = Bits(words, joined(tables))
    corpus = model.weights[-1][b.gate].astype(np.float32)
    for w, x in zip(model.weights, b.x, strict=False):
        corpus += (w[b.gate] * (1 / SCALE)).astype(np.float32) * x
    long = b.n[of]
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    steps = np.add.reduceat(long, head)
    rest = *b.rows(), corpus
    ends, out, lo = np.append(head[1:], len(of)), [], 0
    while lo < len(head):
        hi = lo + max(1, min(SPELL_DOCS, int(np.searchsorted(np.cumsum(steps[lo : lo + SPELL_DOCS]), SPELL_STEPS, "right"))))
        own = of[head[lo] : ends[hi - 1]]
        k = b.size[own]
        first = np.cumsum(k) - k
        units = _doc_units(model, b, b.of[np.repeat(b.starts[own] - first, k) + np.arange(int(k.sum()))], steps[lo:hi])
        out.append(-np.add.reduceat(_follow_bits(model, units, hi - lo, *rest)[units.of], units.part[first]))
        lo = hi
    return np.concatenate(out)


def _doc_units(m: Model, b: Bits, steps: np.ndarray, size: np.ndarray) -> Units:
    """Units of documents of so many bits, in the blocks of Model.follow: the first blocks of all documents, then the second ones; of
    these those that are followed by another, then those that are not."""
    first, most, lo, begin, rank = np.cumsum(size) - size, WIDE * m.block, 0, [], []
    while (alive := np.flatnonzero(size > lo)).size:
        begin.append(first[alive] + lo)
        lo, before = (m.block if lo == 0 else min(2 * lo, lo + most)), len(rank)
        rank.append(alive + len(size) * (2 * before + (size[alive] <= lo)))
    edges, rank = np.concatenate(begin), np.concatenate(rank)
    order = np.argsort(edges)
    return Units(b, steps, edges[order], rank[order])


def _follow_bits(m: Model, units: Units, docs: int, rows: np.ndarray, places: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """What the units of documents cost: Model.follow's rule, block by block of all documents. rows, places: Bits.rows(); corpus: what
    the corpus' weights make of the bits."""
    cells, kinds = m.cells, len(m.hit)
    weights, counts = np.zeros((docs, cells, 4)), np.zeros((docs, kinds, 2))
    counts[:, :, 0], counts[:, :, 1] = m.all - m.hit, m.hit
    out, by = np.empty(len(units.rank)), np.array([1 / SCALE] * 3 + [1])
    scale, level = np.float32((BINS - 1) / (2 * m.bound)), units.rank // docs
    edge = np.append(np.flatnonzero(np.diff(level >> 1, prepend=-1)), len(out)).tolist()
    for lo, hi in zip(edge, edge[1:], strict=False):
        own = units.rank[lo:hi] % docs
        new = np.append(True, own[1:] != own[:-1])
        alive, k = own[new], units.long[lo:hi]
        at, first = units.bits(lo, hi)
        d = np.repeat(np.cumsum(new) - 1, k)
        z, place, x = corpus[at], places[at], rows[at].view(np.int8).astype(np.float32)
        y = place >> PLACE & 1
        sign = np.float32(1) - np.float32(2) * y.astype(np.float32)
        cell = d * cells
        cell += place >> (PLACE + 1)
        if lo:
            z += _dot((weights[alive] * by).astype(np.float32).view(np.complex128).ravel()[cell], x)
        np.clip(z, -m.bound, m.bound, out=z)
        low, part = _bins(z, m.bound, scale)
        d *= kinds
        low += d
        low += place & SPOT
        state = counts[alive].reshape(-1, 2)
        v = np.log((state[:, 1] / state[:, 0]).astype(np.float32))
        out[lo:hi] = np.add.reduceat(_cost(v, low, part, z, sign), first)
        # what the last block of a document teaches is not asked for
        go = lo + int(np.searchsorted(level[lo:hi] & 1, 1))
        if go == lo:
            continue
        alive, bits = alive[: int(new[: go - lo].sum())], int(first[go - lo]) if go < hi else len(z)
        cell, low, y, x, part = cell[:bits], low[:bits], y[:bits], x[: 4 * bits], part[:bits]
        times = np.repeat(units.times[lo:go].astype(np.float32), k[: go - lo])
        error = _error(z[:bits], sign[:bits]) * times
        n = np.bincount(cell, times, minlength=len(alive) * cells)
        step = RATE * np.minimum(1, BLOCK / np.maximum(n, 1))
        weights[alive] += np.stack([g * step for g in _slopes(cell, x, error, by, len(n))], axis=1).reshape(-1, cells, 4)
        low *= 2
        low += y
        part *= times
        size = 2 * kinds * len(alive)
        both = np.bincount(low, times - part, minlength=size)
        both[2:] += np.bincount(low, part, minlength=size)[:-2]
        counts[alive] += both.reshape(-1, kinds, 2)
    return out


# ---------------------------------------------------------------- pieces


class Piece:
    """Some documents' tokens in order, their distinct words, and their distinct segments in context (the two tokens before)."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        hashes, sizes, starts, ends, base = [], [], [], [], 0
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK):
                size += len(texts[hi])
                hi += 1
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]).astype(np.int64)
            w = words_of(at, np.frombuffer(b"".join(texts[lo:hi]), np.uint8))
            hashes.append(w.hash)
            sizes.append(np.diff(w.first))
            starts.append(w.start + base)
            ends.append(w.end + base)
            base += int(at[-1])
            lo = hi
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.tokens = size + 1
        self.first = np.cumsum(self.tokens) - self.tokens
        h = np.full(int(self.tokens.sum()), _END)
        inner = np.ones(len(h), bool)
        inner[self.first + size] = False
        h[inner] = np.concatenate(hashes) if hashes else []
        self.doc = np.repeat(np.arange(self.n), self.tokens)
        self.place = np.arange(len(h)) - self.first[self.doc]
        self.keys, where, self.of = np.unique(h >> np.uint64(64 - WORD_BITS), return_index=True, return_inverse=True)
        s, e = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if hashes:
            s[inner], e[inner] = np.concatenate(starts), np.concatenate(ends)
        self._body, self._span = b"".join(texts), (s[where], e[where])
        # contexts, segments, and the segments in their contexts
        context = h.copy()
        context[1:] = h[1:] + h[:-1] * np.uint64(0x9FB21C651E98DF25)
        context = np.concatenate([[_BEFORE], mix(context)[:-1]])
        context[self.place == 0] = _BEFORE
        second = self.place == 1
        context[second] = mix(h[np.flatnonzero(second) - 1])
        self.start = np.flatnonzero((context % np.uint64(SPREAD) == 0) | (self.place == 0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * powers(_BASE, len(h))[: len(h)])])
        stop = np.append(self.start[1:], len(h))
        what = mix((total[stop] - total[self.start]) * powers(_INV, len(h))[self.start] + (stop - self.start).astype(np.uint64))
        low = np.uint64((1 << FOLLOWER) - 1)
        self.grams, self.gram_of = np.unique((context[self.start] & ~low) | (what & low), return_inverse=True)

    def words(self, at: np.ndarray) -> list[bytes]:
        """The distinct words at these places of keys; the end mark is a word of one line feed, which no word contains."""
        s, e = self._span
        return [self._body[a:z] if z > a else b"\n" for a, z in zip(s[at].tolist(), e[at].tolist(), strict=True)]


    def spelling(self, at: np.ndarray) -> Words:
        """The same words, with closing blanks."""
        s, size = (x[at] for x in (self._span[0], self._span[1] - self._span[0]))
        end = size == 0  # the end mark
        ends = np.cumsum(size + end + 1)
        text = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        first, inner = np.cumsum(size) - size, np.arange(int(size.sum()))
        text[np.repeat(ends - size - 1 - first, size) + inner] = np.frombuffer(self._body, np.uint8)[np.repeat(s - first, size) + inner]
        text[ends[end] - 2] = 10
        return Words(text, size + end + 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, the bytes of equal weight together, compressed."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<II", a.dtype.itemsize, len(a)) for a in arrays)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(body: bytes) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(body), []
    n = struct.unpack_from("<I", raw)[0]
    at = 4 + 8 * n
    for i in range(n):
        size, length = struct.unpack_from("<II", raw, 4 + 8 * i)
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(length))
        at += size * length
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _buckets(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Edges of n buckets in sorted keys of so many bits: ranges of hashes."""
    return np.searchsorted((keys >> np.uint64(bits - 20)) * np.uint64(n) >> np.uint64(20), np.arange(n + 1))


SCAN = "kind string, piece long, bucket int, name string, part int, body binary"


def _rows(kind: str, piece: int, buckets, bodies: list[bytes]) -> pa.RecordBatch:
    k = len(bodies)
    return pa.RecordBatch.from_arrays([pa.array([kind] * k), pa.array([piece] * k, pa.int64()), pa.array(list(buckets), pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.array(bodies, pa.binary())], names=["kind", "piece", "bucket", "name", "part", "body"])


def _scan(buckets: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n, np.int64) for n in CONTEXTS.values()]
        rare = [np.zeros(2 * n, np.int64) for n in CONTEXTS.values()] if plain else []
        kept = joined([(logits(t), gates(t)) for t in tables])
        models = {k: Model(k) for k in MIXERS}
        serial = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0

        def piece() -> Iterator[pa.RecordBatch]:
            nonlocal serial, size
            p = Piece(texts)
            flags = np.array(train, bool)[p.doc]
            c = np.bincount(p.of, flags, minlength=len(p.keys)).astype(np.uint32)
            t = np.bincount(p.gram_of, flags[p.start], minlength=len(p.grams)).astype(np.uint32)
            learned = np.flatnonzero(c)
            spelt = np.zeros(len(p.keys))
            spelt[learned] = learn_spelling(p.spelling(learned), tables, models["B"], c[learned], kept)
            if plain:  # words that are rare here spell as unknown ones do
                count(p.words(np.flatnonzero(c == 1)), rare)
            if len(learned):
                learn_piece(p, np.array(train, bool), c, t, models, spelt)
            a, b = _buckets(p.keys, buckets, WORD_BITS), _buckets(p.grams, buckets, 64)
            bodies = [pack(_steps(p.keys[a[i] : a[i + 1]]), c[a[i] : a[i + 1]], _steps(p.grams[b[i] : b[i + 1]]), t[b[i] : b[i + 1]]) for i in range(buckets)]
            yield _rows("counts", serial, range(buckets), bodies)
            lengths = np.array([len(x) for x in texts], np.uint64)
            head = np.array([-(1 << 63) if i is None else i for i in ids], np.int64).view(np.uint64)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield _rows("piece", serial, [-1], [struct.pack("<I", len(x := pack(head, np.array(train, np.uint8), lengths))) + x + body])
            serial += 1
            for x in (ids, train, texts):
                x.clear()
            size = 0

        for b in batches:
            for i, f, t in zip(b["doc_id"].to_pylist(), b["train"].to_pylist(), b["text"], strict=True):
                ids.append(i)
                train.append(f)
                texts.append(normal((t.as_py() or "").encode()))
                size += len(texts[-1]) + 8
                if size >= PIECE:
                    yield from piece()
        if texts:
            yield from piece()
        learned = [("learned", k, m.sums()) for k, m in models.items()]
        for kind, name, t in [*(("table", str(k), t) for k, t in zip(CONTEXTS, tables, strict=True)), *(("table", f"rare {k}", t) for k, t in zip(CONTEXTS, rare, strict=False)), *learned]:
            r = table_rows(name, t)
            k = r.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([kind] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), r["name"], r["part"], r["body"]], names=["kind", "piece", "bucket", "name", "part", "body"])

    return run


# ---------------------------------------------------------------- counts


#: Shape of the table of hits and misses: by count of the context, and by followers for each occurrence.
SHAPE = (12, 8, 2)


def _bin(times: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """The cell of contexts that occur so often with so many followers."""
    a = np.minimum(np.frexp(times.astype(np.float64))[1], SHAPE[0] - 1)
    return a * SHAPE[1] + np.minimum(8 * followers // (times + 1), SHAPE[1] - 1)


def _outcomes(grams: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted segments in context and their counts: their contexts' counts and numbers of followers, and the table of hits and misses."""
    context = grams >> np.uint64(FOLLOWER)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
    spread = np.diff(np.append(first, len(grams)))
    times, followers = (np.repeat(np.add.reduceat(x, first), spread) if len(grams) else t for x in (t, (t > 0).astype(np.int64)))
    cells = np.zeros(SHAPE, np.int64)
    again, once = t > 1, (t == 1) & (times > 1)
    cells[..., 1] = np.bincount(_bin(times[again] - 1, followers[again]), t[again], minlength=cells[..., 1].size).reshape(SHAPE[:2])
    cells[..., 0] = np.bincount(_bin(times[once] - 1, followers[once] - 1), minlength=cells[..., 0].size).reshape(SHAPE[:2])
    return times, followers, cells


def _facts(distinct: int, total: int, once: int, cells: np.ndarray) -> dict:
    """What scores need to know of the whole: cells as rows (misses, hits)."""
    return {"total": total, "floor": float(np.log10(total + 0.5 * (distinct + 1))), "unknown": min(max(once / total, 1e-4), 0.9) if total else 1.0, "rates": np.log((cells[:, 1] + 0.5) / (cells[:, 0] + 0.5))}


BACK = "kind string, piece long, bucket int, body binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets, sorted by bucket: to each piece the counts it asked for, and what the corpus has in the bucket.

    A piece gets, in the order of its words, their counts; and in the order of its words in context these counts, those of the
    contexts, and the contexts' numbers of different followers."""

    def done(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        asked = [unpack(body) for _, body in held]
        keys, of = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
        c = np.bincount(of, np.concatenate([a[1] for a in asked]), minlength=len(keys)).astype(np.int64)
        grams, gram_of = np.unique(np.concatenate([np.cumsum(a[2]) for a in asked]), return_inverse=True)
        t = np.bincount(gram_of, np.concatenate([a[3] for a in asked]), minlength=len(grams)).astype(np.int64)
        times, followers, cells = _outcomes(grams, t)
        facts = np.concatenate([[(c > 0).sum(), c.sum(), (c == 1).sum()], cells.ravel()]).astype(np.uint64)
        bodies, a, b = [], 0, 0
        for x in asked:
            i, j = of[a : a + len(x[0])], gram_of[b : b + len(x[2])]
            bodies.append(pack(*(y.astype(np.uint32) for y in (c[i], t[j], times[j], followers[j]))))
            a, b = a + len(x[0]), b + len(x[2])
        k = len(held)
        return pa.RecordBatch.from_pydict({"kind": ["back"] * k + ["facts"], "piece": pa.array([p for p, _ in held] + [-1], pa.int64()), "bucket": pa.array([bucket] * (k + 1), pa.int32()), "body": pa.array([*bodies, pack(facts)], pa.binary())})

    now, held = None, []
    for b in batches:
        for piece, bucket, body in zip(b["piece"].to_pylist(), b["bucket"].to_pylist(), b["body"], strict=True):
            if now is not None and bucket != now:
                yield done(now, held)
                held = []
            now = bucket
            held.append((piece, body.as_py()))
    if held:
        yield done(now, held)


# ---------------------------------------------------------------- scoring


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys: each element's group, its number in the group, the group's size, and the first element of each group."""
    low = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + low < 64:
        both = (key << low) | np.arange(len(key))
        both.sort()
        order, sorted_ = both & ((1 << low) - 1), both >> low
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(key) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    of, number = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    number[order] = np.arange(len(key)) - np.repeat(head, size)
    return of, number, size[of], order[head]


def _lately(x: np.ndarray, doc: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
    """Logit of the smoothed mean of x over the last ``span`` elements of the document before each."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    n = np.minimum(rank, span)
    hit = total[:-1] - total[np.arange(len(x)) - n]
    miss = np.maximum(n - hit, 0)
    miss += 0.5
    hit += 0.5
    hit /= miss
    return np.log(hit, out=hit)


def mixed(name: str, a: np.ndarray, b: np.ndarray, inputs: list[np.ndarray], gate: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The logarithm of W * exp(a) + (1 - W) * exp(b) for each step, W from a document's mixer: learned along the document from
    what W was worth.

    rank: the step's number among those of its document."""
    start = np.array(START[name])
    x = np.stack([*inputs, np.ones(len(a))])
    block = rank // BLOCK
    order = np.argsort(block, kind="stable")
    edge = np.searchsorted(block[order], np.arange(int(block.max()) + 2)) if len(a) else [0]
    cell = (doc * GATES + gate).astype(np.int64)
    n = int(cell.max()) + 1 if len(a) else 0
    weights = np.repeat(start[:, None], n, axis=1)
    out = np.empty(len(a))
    for lo, hi in zip(edge, edge[1:], strict=False):
        at = order[lo:hi]
        own, y = cell[at], x[:, at]
        z = np.clip((weights[:, own] * y).sum(axis=0), -9, 9)
        none = np.log1p(np.exp(z))  # minus the logarithm of 1 - W
        one = a[at] + z - none
        p = np.logaddexp(one, b[at] - none)
        out[at] = p
        if hi < len(order):
            error = np.exp(one - p) - 1 / (1 + np.exp(-z))
            for i in range(len(x)):
                weights[i] += RATE * np.bincount(own, error * y[i], minlength=n)
    return out


def score(piece: Piece, train: np.ndarray, c: np.ndarray, t: np.ndarray, times: np.ndarray, followers: np.ndarray, facts: dict, run, spelt, tables=None) -> tuple[np.ndarray | None, np.ndarray]:
    """log10 probability of each text of a piece: with plain mixers if there are tables, and refined.

    train: by document; c by distinct word; t, times, followers by distinct segment in context. run(name, steps): the logarithms of
    the steps' probabilities; spelt(tokens' places among the distinct words, their documents): those of the tokens' spelling."""
    doc, of, place = piece.doc, piece.of, piece.place
    own = train[doc]
    _, before, mine, _ = _groups(of * piece.n + doc)
    known = c[of] - np.where(own, mine, 0)
    new = facts["unknown"]
    fresh = known <= 0
    share_of = np.log(np.where(fresh, 1, known) / max(facts["total"], 1))
    with np.errstate(divide="ignore"):
        share = np.log(before / np.maximum(place, 1))
    prior = _stretch(np.clip(CACHE * place / (place + WARM), 1e-3, 0.5))
    gate = np.minimum(np.frexp(place / 16.0)[1].clip(0), GATES - 1)
    lately = lambda x: (_lately(x, doc, place, 16), _lately(x, doc, place, 128))
    # in units whose sums are exact, so that equal documents score alike wherever they stand
    cached = lambda word: [prior, *lately(np.rint((1 << 30) / (1 + np.exp(word - share))) / (1 << 30))]
    last = lambda x, first: np.where(first, 0, np.append(0, x[:-1])).astype(np.int64)

    plain = None
    if tables is not None:
        word = np.log(np.where(fresh, new, (1 - new) * known / max(facts["total"], 1)))
        asked, back = np.unique(of[fresh], return_inverse=True)
        word[fresh] += word_scores(piece.words(asked), tables)[back]
        plain = np.where(place == 0, word, mixed("C", share, word, cached(word), gate, doc, place))

    # does its spelling name the word, bit by bit, or its share of the known ones; is it one of the document's own
    rate = _stretch(np.full(len(of), min(max(new, 1e-4), 0.9)))
    low = run("U", Steps([rate, *lately(fresh.astype(float))], gate, 2 * gate + last(fresh, place == 0), doc, a=spelt(of, doc), b=np.where(fresh, -np.inf, share_of)))
    some = np.flatnonzero(place > 0)
    x = [y[some] for y in cached(low)]
    low[some] = run("C", Steps(x, gate[some], (2 * gate + last(before > 0, place == 0))[some], doc[some], a=share[some], b=low[some]))

    # segments, without the document's own share of what their contexts count
    total = np.add.reduceat(low, piece.start)
    doc, gram_of = doc[piece.start], piece.gram_of
    own = train[doc]
    _, _, same, heads = _groups(gram_of * piece.n + doc)
    context = np.cumsum(np.append(0, np.diff(piece.grams >> np.uint64(FOLLOWER)) != 0))
    group, _, inside, _ = _groups(context[gram_of] * piece.n + doc)
    alone = np.bincount(group[heads], t[gram_of[heads]] == same[heads], minlength=int(group.max()) + 1).astype(np.int64)
    right = t[gram_of] - np.where(own, same, 0)
    seen = times[gram_of] - np.where(own, inside, 0)
    many = followers[gram_of] - np.where(own, alone[group], 0)
    some = np.flatnonzero(seen > 0)
    d = doc[some]
    rank = np.arange(len(some)) - np.searchsorted(d, d)
    cell = _bin(seen[some], np.maximum(many[some], 1))
    hit = (right[some] > 0).astype(np.float64)
    gate = np.minimum(np.frexp(seen[some].astype(np.float64))[1] - 1, GATES - 1)
    with np.errstate(divide="ignore"):
        high = np.log(right[some] / seen[some])
    x = [facts["rates"][cell], _lately(hit, d, rank, 4), _lately(hit, d, rank, 16)]
    if plain is not None:
        plain = np.add.reduceat(plain, piece.start)
        plain[some] = mixed("A", high, plain[some], x, gate, d, rank)
        plain = np.bincount(doc, plain, minlength=piece.n) / np.log(10)
    total[some] = run("A", Steps(x, gate, 2 * gate + last(hit, rank == 0), d, a=high, b=total[some]))
    return plain, np.bincount(doc, total, minlength=piece.n) / np.log(10)


def learn_piece(p: Piece, train: np.ndarray, c: np.ndarray, t: np.ndarray, models: dict[str, Model], spelt: np.ndarray) -> None:
    """Learns the mixers online along the training texts of a piece, by the counts that the piece has of other documents. spelt: by
    distinct word, the logarithm of the probability of its spelling."""
    c, t = c.astype(np.int64), t.astype(np.int64)
    times, followers, cells = _outcomes(p.grams, t)
    facts = _facts(int((c > 0).sum()), int(c.sum()), int((c == 1).sum()), cells.reshape(-1, 2))
    run = lambda name, steps: steps.cost(models[name].learn(steps, train[steps.doc].astype(float)))
    score(p, train, c, t, times, followers, facts, run, lambda of, _: spelt[of])


SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, refined_score double, size long"


def _scored(model):
    """Of pieces and what came back for them, sorted by (piece, bucket): the scores of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables, rare = ([tuple(unpacked(x, np.int8) for x in pair) for pair in m[k]] for k in ("tables", "rare"))
        rare = rare or None
        facts = m["facts"]
        models = {k: Model.of(k, m["learned"].get(k)) for k in MIXERS}

        def done(body: bytes, back: list[bytes]) -> pa.RecordBatch:
            size = struct.unpack_from("<I", body)[0]
            ids, train, lengths = unpack(body[4 : 4 + size])
            raw = zstandard.ZstdDecompressor().decompress(body[4 + size :])
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tolist()
            p = Piece([raw[a:z] for a, z in zip(at, at[1:], strict=False)])
            c, t, times, followers = (np.concatenate(x).astype(np.int64) for x in zip(*(unpack(x) for x in back), strict=True))
            flags = train.astype(bool)
            run = lambda name, steps: models[name].follow(steps)[0]
            words = p.spelling(np.arange(len(p.keys)))
            made, refined = score(p, flags, c, t, times, followers, facts, run, lambda of, doc: spell(words, doc, tables, models["B"], of), rare)
            known = np.bincount(p.doc, c[p.of] > 0, minlength=p.n)
            base = np.bincount(p.doc, np.log10(c[p.of] + 0.5), minlength=p.n) - p.tokens * facts["floor"] if facts["total"] else np.zeros(p.n)
            ids = ids.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == -(1 << 63)), pa.array(flags), pa.array(p.tokens, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.nulls(p.n, pa.float64()) if made is None else pa.array(made), pa.array(refined), pa.array(lengths.astype(np.int64) + 1)], names=[x.split()[0] for x in SCORE.split(", ")])

        now, text, back = None, None, []
        for b in batches:
            for piece, bucket, body in zip(b["piece"].to_pylist(), b["bucket"].to_pylist(), b["body"], strict=True):
                if piece != now:
                    if now is not None:
                        yield done(text, back)
                    now, back = piece, []
                if bucket < 0:
                    text = body.as_py()
                else:
                    back.append(body.as_py())
        if now is not None:
            yield done(text, back)

    return run


def score_documents(docs: DataFrame, plain: bool = True) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, refined_score, bits_per_byte) for docs(doc_id, text, train
    boolean). score is null without ``plain``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    path = fresh(spark, "scan")
    made = docs.mapInArrow(lean(_scan(parts, plain)), SCAN)
    made.write.option("compression", "uncompressed").partitionBy("kind").parquet(path)  # the bodies are compressed
    written = [f.getPath().getName() for f in _listed(spark, path)]
    empty = spark.createDataFrame([], made.schema).drop("kind")
    scan = {k: spark.read.schema(made.drop("kind").schema).parquet(f"{path}/kind={k}") if f"kind={k}" in written else empty for k in ("counts", "piece", "table", "learned")}
    counts = gathered(summed(scan["table"].select("name", "part", "body"), np.int64), np.int64)
    tables, rare = ([(packed(logits(t)), packed(gates(t))) for t in (counts.pop(kind + str(k), np.zeros(2 * n, np.int64)) for k, n in CONTEXTS.items())] for kind in ("", "rare "))
    learned = gathered(summed(scan["learned"].select("name", "part", "body"), np.int64), np.int64)
    del counts
    back = scratch.keep(scan["counts"].select("piece", "bucket", "body").repartition(parts, "bucket").sortWithinPartitions("bucket", "piece").mapInArrow(lean(_sums), BACK), "back")
    if "kind=counts" in written:
        delete(spark, f"{path}/kind=counts")
    # one row of fixed size for each bucket
    sums = np.zeros(3 + int(np.prod(SHAPE)), np.int64)
    for r in back.where("kind = 'facts'").select("body").toLocalIterator():
        sums += unpack(bytes(r["body"]))[0].astype(np.int64)
    distinct, total, once = sums[:3].tolist()
    cells = sums[3:].reshape(-1, 2)
    facts = _facts(distinct, total, once, cells)
    model = spark.sparkContext.broadcast({"tables": tables, "rare": rare if plain else [], "facts": facts, "learned": learned})
    pieces = scan["piece"].select("piece", "bucket", "body").unionByName(back.where("kind = 'back'").select("piece", "bucket", "body"))
    out = pieces.repartition(parts, "piece").sortWithinPartitions("piece", "bucket").mapInArrow(lean(_scored(model)), SCORE)
    bits = (-F.col("refined_score") / F.log10(F.lit(2.0)) / F.col("size")).alias("bits_per_byte")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "refined_score", bits)


def _listed(spark: SparkSession, path: str) -> list:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return list(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    out = score_documents(docs, plain=False)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("refined_score").alias("score"), "bits_per_byte")
