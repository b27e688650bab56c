"""Language-model scoring by logistic context mixing [operator 1].

The model gives each byte of a lower-cased text, and a closing zero byte, as eight binary decisions.  Predictors
of orders 0 to 4 (the bytes before, with the decision's place in the byte's tree) each hold counts of
zeros and ones; a decision's probability is the logistic mix of their log-odds, by weights that a gate picks:
the decision's depth and how much the two longest contexts have seen.

Gathering, over all training texts (crc32(doc_id) mod `folds` is not 0): every block of texts asks with its distinct
five-byte grams and how often its training texts hold them.  A gram's last two context bytes choose the bucket that
adds it up, so a bucket has all of its contexts of order 2 and more: it counts them exactly and apart, and there are
more buckets and more counts the more text there is.  A bucket learns weights online: mini-batches of its grams in
hash order, each predicted with its own occurrence left out, each followed by a gradient step; the buckets' weights
are averaged by the grams they saw.  Only the weights and the counts of orders 0 and 1 (65,792 decisions, 64 bits
each) are broadcast; a bucket mixes each of its grams once and answers the blocks that asked.

A bucket gets what blocks ask in at most `fan` rows: where there are more blocks, `fan` neighbours' distinct grams are
added up first, and again until that holds, and answers go down the same way.

Scoring: each text then is refined as it goes, in three steps.  A match predictor, the byte that followed the last
equal six bytes of the same text, is mixed in with a rate that follows its hits and misses in the text so far.  A word
with the white space (or end) after it, which the bytes give one way, the corpus's count of that word gives another,
mixed in at the rate at which that was better in the text so far.  And so is a phrase: a text is cut after words that a
hash of the word and the one before picks, one in sixteen, and how often the phrase follows the one before it in
*other* training texts gives its probability (where these have the phrase before at all).  All of this looks at
earlier bytes only, so `score` is a probability.

Words are known by whole 64-bit hashes, which V, N and n_known depend on; phrases, which only `score` looks at, by fewer bits.

Defined results: a null text is empty (one end token, one closing byte); a null doc_id counts as the empty
string for crc32; repeated rows are scored, and learnt from, each; an empty table gives no rows; with no training
text all predictors are even and counts zero.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tally

ORDERS = 5
GATES = 4
BLOCK = 6 << 20
FAN = 4096
_PHRASES = 1 << 28  # buckets of phrases in tallies begin here
_MATCH = 6  # bytes of context of the match predictor
_SEEN = np.array([0.0, 1.0, 4.0])  # how much the longest contexts have seen


# ---- grams -----------------------------------------------------------------------------------------------------


def grams(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and closing zero of the texts, it and the four bytes before (zero before the start), 40 bits; n+1 offsets."""
    n = len(offsets) - 1
    out = offsets + 4 * np.arange(n + 1)
    padded = np.zeros(len(low) + 4 * n + 1, np.uint64)
    at = np.arange(len(low)) + 4 * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    padded[at] = low
    g = padded[4:].copy()
    for k in range(1, 5):
        g |= padded[4 - k : len(padded) - k] << np.uint64(8 * k)
    ends = offsets + np.arange(n + 1)
    keep = np.ones(len(g), bool)
    drop = (out[1:-1, None] - np.arange(1, 4)).reshape(-1) if n > 1 else np.zeros(0, np.int64)
    keep[drop] = False
    return g[keep][: int(ends[-1])], ends


def bucket_of(g: np.ndarray, bits: int = 6) -> np.ndarray:
    """By the last two context bytes, which all contexts of order 2 and more hold; 2^bits buckets."""
    return (C.mix64((g >> np.uint64(8)) & np.uint64(0xFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


def bucket_bits(size: int) -> int:
    """A bucket for each 32 MB of text, 64 at least; no more than there are pairs of bytes."""
    return min(16, max(6, (size >> 25).bit_length()))


def _slots(g: np.ndarray, bits: int) -> np.ndarray:
    """Of each gram and order the slots of its eight decisions: (orders, grams, 8)."""
    byte = (g & np.uint64(255)).astype(np.int64)
    node = (1 << np.arange(8)) | (byte[:, None] >> (8 - np.arange(8)))  # 1, 1b, 1bb ...
    out = np.zeros((ORDERS, len(g), 8), np.int64)
    out[0] = node
    out[1] = 256 + (((g >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * 256)[:, None] + node
    inner = bits - 6
    base = 256 + 65536
    bucket = bucket_of(g)
    for k in range(2, ORDERS):
        ctx = (g >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
        h = C.mix64(ctx * np.uint64(2 * k + 1) + np.uint64(k))
        low = C.mix64(h[:, None] + node.astype(np.uint64)) & np.uint64((1 << inner) - 1)
        out[k] = base + ((k - 2) << bits) + ((bucket << inner)[:, None] | low.astype(np.int64))
    return out


def table_size(bits: int) -> int:
    return 256 + 65536 + ((ORDERS - 2) << bits)


def _inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the orders and the gate of each decision, from counts (orders, decisions)."""
    x = np.log((n1 + np.float32(0.08)) / (n0 + np.float32(0.08)))
    seen = np.searchsorted(_SEEN, n0[-1] + n1[-1], "right") - 1
    return x, seen * GATES + np.searchsorted(_SEEN[1:], n0[-2] + n1[-2], "right")


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights() -> np.ndarray:
    """(8 depths, gates, orders)"""
    w = np.full((8, 3 * GATES, ORDERS), 0.15, np.float32)
    w[:, :, -1], w[:, :, -2] = 0.4, 0.25
    return w


def low_counts(pairs: np.ndarray) -> np.ndarray:
    """Zeros and ones (2, 65792) of the decisions of orders 0 and 1, from the count of each byte after each byte (65536)."""
    p = pairs.reshape(256, 256)
    every = np.concatenate([p.sum(axis=0)[None], p])
    out = np.zeros((2, 257, 256), np.int64)
    for depth in range(8):
        out[:, :, 1 << depth : 2 << depth] = every.reshape(257, 1 << depth, 2, -1).sum(axis=3).transpose(2, 0, 1)
    return out.reshape(2, -1)


class Nodes:
    """Counts of zeros and ones in the contexts of a bucket's grams (distinct, all that the bucket has)."""

    def __init__(self, g: np.ndarray, counts: np.ndarray, low: np.ndarray, bits: int | None = None):
        self.g, self.low, self.orders = g, low, []
        for k in range(2, ORDERS):
            key = g & np.uint64((1 << 8 * (k + 1)) - 1)
            if bits is not None:
                key = C.mix64((key >> np.uint64(8)) * np.uint64(2 * k + 1) + np.uint64(k)) >> np.uint64(64 - max(1, bits - 6)) << np.uint64(8) | (key & np.uint64(255))
            order = np.argsort(key, kind="stable")
            self.orders.append((order, key[order], counts[order].astype(np.float64)))

    def counts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(orders, grams) of each gram's decision at a depth: a run of equal context and bits before it."""
        out = np.zeros((2, ORDERS, len(self.g)), np.float32)
        node = (1 << depth) | ((self.g & np.uint64(255)) >> np.uint64(8 - depth)).astype(np.int64)
        out[:, 0] = self.low[:, node]
        out[:, 1] = self.low[:, 256 + ((self.g >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * 256 + node]
        for k, (order, key, n) in enumerate(self.orders, 2):
            run = np.concatenate([[0], np.cumsum(np.diff(key >> np.uint64(8 - depth)) != 0)]) if len(key) else np.zeros(0, np.int64)
            bit = (key >> np.uint64(7 - depth)) & np.uint64(1)
            for b in range(2):
                out[b, k, order] = np.bincount(run, weights=n * (bit == b))[run] if len(key) else 0
        return out[0], out[1]


def learn_weights(g: np.ndarray, counts: np.ndarray, nodes: Nodes, passes: int = 2) -> np.ndarray:
    """Online: a gradient step after each mini-batch of grams, every occurrence left out of its own prediction."""
    w = start_weights()
    order = np.argsort(C.mix64(g))
    byte = (g & np.uint64(255)).astype(np.int64)
    for depth in range(8):
        n0, n1 = nodes.counts(depth)
        steps = 0
        for _ in range(passes):
            for a in range(0, len(g), 2048):
                some = order[a : a + 2048]
                rate = 0.5 / (1 + steps / 40) ** 0.5
                steps += 1
                mass = np.minimum(counts[some], 50).astype(np.float32)
                bit = ((byte[some] >> (7 - depth)) & 1).astype(np.float32)
                x, gate = _inputs(np.maximum(n0[:, some] - (1 - bit), 0), np.maximum(n1[:, some] - bit, 0))
                p = _logistic((w[depth][gate] * x.T).sum(axis=1))
                step = ((bit - p) * mass)[:, None] * x.T
                total = np.bincount(gate, weights=mass, minlength=3 * GATES) + 1e-9
                for k in range(ORDERS):
                    w[depth, :, k] += rate * (np.bincount(gate, weights=step[:, k], minlength=3 * GATES) / total / 4).astype(np.float32)
    return w


class Model:
    """Weights and counts of slots: those of orders 0 and 1 alone, the others being a bucket's, or all of them."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, weights: np.ndarray, bits: int | None):
        self.n0, self.n1, self.weights, self.bits = n0, n1, weights, bits
        ends = np.flatnonzero(~C.NOT_SPACE | (np.arange(256) == 0))
        no, yes = (n[:256].astype(np.float64) for n in (n0, n1))
        one, zero = np.log((yes + 0.5) / (no + yes + 1)), np.log((no + 0.5) / (no + yes + 1))
        path = [sum((one if b >> (7 - d) & 1 else zero)[1 << d | b >> (8 - d)] for d in range(8)) for b in ends.tolist()]
        #: Natural logarithm of the shares of the bytes that may follow a word.
        self.closing = np.full(256, -np.inf)
        self.closing[ends] = path - np.logaddexp.reduce(path)

    def nats(self, g: np.ndarray) -> np.ndarray:
        """Natural logarithm of each gram's last byte's probability, by a model that has the slots of all orders."""
        slots = _slots(g, self.bits)
        return self._mixed(g, lambda depth: (self.n0[slots[:, :, depth]].astype(np.float32), self.n1[slots[:, :, depth]].astype(np.float32)))

    def bucket_nats(self, g: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same of all distinct grams of a bucket, with their counts in training texts."""
        return self._mixed(g, Nodes(g, counts, np.stack([self.n0, self.n1]), self.bits).counts)

    def _mixed(self, g: np.ndarray, counts) -> np.ndarray:
        out = np.zeros(len(g), np.float64)
        byte = (g & np.uint64(255)).astype(np.int64)
        for depth in range(8):
            n0, n1 = counts(depth)
            for a in range(0, len(g), 1 << 15):
                some = slice(a, a + (1 << 15))
                x, gate = _inputs(n0[:, some], n1[:, some])
                dot = (self.weights[depth][gate] * x.T).sum(axis=1).clip(-20, 20)
                out[some] -= np.logaddexp(0, np.where((byte[some] >> (7 - depth)) & 1, -dot, dot))
        return out


# ---- gathering -------------------------------------------------------------------------------------------------


def held_out(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids], bool)


def _gram_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    distinct, back = np.unique(every, return_inverse=True)
    return distinct, np.bincount(back, weights=np.concatenate([p[1] for p in parts]) if parts else None, minlength=len(distinct)).astype(np.int64)


def ask_grams(m: int, parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.Table:
    """A block's distinct grams and their counts in its training texts, by bucket; bucket k is -1 - k."""
    g, n = _gram_counts(parts)
    b = bucket_of(g, bits)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange((1 << bits) + 1))
    cut = [(-1 - k, order[x:y]) for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if x < y]
    return pa.table([
        pa.array([m] * len(cut), pa.int64()), pa.array([k for k, _ in cut], pa.int32()),
        pa.array([_six(g[i]) for _, i in cut], pa.binary()), pa.array([n[i].astype("<u4").tobytes() for _, i in cut], pa.binary()),
    ], ["m", "b", "keys", "counts"])


def _asked_grams(t) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of rows of one level; blocks' counts have four bytes, sums over blocks eight."""
    keys, counts = b"".join(t.column("keys").to_pylist()), b"".join(t.column("counts").to_pylist())
    g = _of_six(keys)
    return g, np.frombuffer(counts, "<u8" if len(counts) == 8 * len(g) else "<u4").astype(np.int64)


def _up(fan: int):
    return F.floor(F.col("m") / F.lit(fan)).cast("long")


def summed_grams(asked: DataFrame, fan: int) -> DataFrame:
    """What `fan` neighbouring rows of a bucket ask, as one row."""

    def run(t: pa.Table) -> pa.Table:
        g, n = _gram_counts([_asked_grams(t)])
        C.tidy()
        return pa.table([t.column("up").slice(0, 1), t.column("b").slice(0, 1), pa.array([_six(g)], pa.binary()), pa.array([n.astype("<u8").tobytes()], pa.binary())], ["m", "b", "keys", "counts"])

    return asked.withColumn("up", _up(fan)).groupBy("b", "up").applyInArrow(run, tally.ASKED)


def answered_below(asked: DataFrame, replies: DataFrame, fan: int) -> DataFrame:
    """Replies to what was summed by summed_grams(), as replies to the rows that it summed."""

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        known, parts = Answers(r.column("reply").to_pylist()), []
        for k in t.column("keys").to_pylist():
            parts.append(k + known.nats(_of_six(k)).astype("<f4").tobytes())
        C.tidy()
        return pa.table([t.column("m"), t.column("b"), pa.array(parts, pa.binary())], ["m", "b", "reply"])

    return asked.withColumn("up", _up(fan)).groupBy("b", "up").cogroup(replies.groupBy("b", "m")).applyInArrow(run, "m long, b int, reply binary")


def gather(asked: DataFrame, slot_bits: int | None) -> Model:
    """Of what blocks asked: counts of orders 0 and 1, and the weights."""

    def pairs(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            g, n = _asked_grams(batch)
            total += np.bincount((g & np.uint64(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["pair", "n"])

    count = np.zeros(1 << 16, np.int64)
    for r in asked.select("keys", "counts").mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        count[r.pair] = r.n
    low = low_counts(count)
    shared = asked.sparkSession.sparkContext.broadcast(low)

    def learn(t: pa.Table) -> pa.Table:
        g, n = _gram_counts([_asked_grams(t)])
        g, n = g[n > 0], n[n > 0]
        w = learn_weights(g, n, Nodes(g, n, shared.value, slot_bits))
        C.tidy()
        return pa.table([t.column("b").slice(0, 1), pa.array([w.tobytes()], pa.binary()), pa.array([len(g)], pa.int64())], ["b", "weights", "seen"])

    weights, seen = np.zeros(start_weights().size), 0
    for r in sorted(asked.groupBy("b").applyInArrow(learn, "b int, weights binary, seen long").collect(), key=lambda r: r.b):
        weights += np.frombuffer(r.weights, np.float32).astype(np.float64) * r.seen
        seen += r.seen
    w = (weights / seen).astype(np.float32).reshape(start_weights().shape) if seen else start_weights()
    return Model(low[0], low[1], w, slot_bits)


def answered_grams(asked: DataFrame, model) -> DataFrame:
    """Each block's grams with their nats, 32 bits each, after them."""

    def run(t: pa.Table) -> pa.Table:
        every, n = _asked_grams(t)
        g, back = np.unique(every, return_inverse=True)
        nats = model.value.bucket_nats(g, np.bincount(back, weights=n, minlength=len(g)).astype(np.int64)).astype("<f4")[back]
        keys = t.column("keys").to_pylist()
        ends = np.cumsum([len(k) // 5 for k in keys]).tolist()
        parts = [k + nats[x:y].tobytes() for k, x, y in zip(keys, [0, *ends[:-1]], ends, strict=True)]
        del every, n, g, back, nats
        C.tidy()
        return pa.table([t.column("m"), t.column("b"), pa.array(parts, pa.binary())], ["m", "b", "reply"])

    return asked.groupBy("b").applyInArrow(run, "m long, b int, reply binary")


class Answers:
    """Nats of a block's grams; most are found by the hash's slot, the others by search."""

    def __init__(self, replies: list[bytes]):
        cut = [len(r) // 9 * 5 for r in replies]
        g = _of_six(b"".join(r[:c] for r, c in zip(replies, cut, strict=True)))
        order = np.argsort(g)
        self.g = g[order]
        self.value = np.frombuffer(b"".join(r[c:] for r, c in zip(replies, cut, strict=True)), "<f4").astype(np.float64)[order]
        self.shift = np.uint64(64 - max(1, (4 * len(g)).bit_length()))
        self.at = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.at[self._slot(self.g)] = np.arange(len(g), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def nats(self, g: np.ndarray) -> np.ndarray:
        at = self.at[self._slot(g)]
        miss = np.flatnonzero(self.g[at] != g)
        at[miss] = np.searchsorted(self.g, g[miss])
        return self.value[at]


def _six(g: np.ndarray) -> bytes:
    """40-bit grams on five bytes each, sorted by the caller's order."""
    return g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# ---- scoring ---------------------------------------------------------------------------------------------------


def refined(g: np.ndarray, ends: np.ndarray, nats: np.ndarray) -> np.ndarray:
    """Nats of each byte with the match predictor mixed in, as that has done in its text so far."""
    n = len(g)
    if not n:
        return nats
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    byte = (g & np.uint64(255)).astype(np.uint8)
    place = np.arange(n) - ends[doc]
    ctx = (g >> np.uint64(8)) + (doc.astype(np.uint64) << np.uint64(33)) * np.uint64(3)
    for k in range(4, _MATCH):
        before = np.zeros(n, np.uint64)
        before[k + 1 :] = byte[: n - k - 1]
        ctx = ctx * np.uint64(0x9E3779B97F4A7C15) + before
    bits = max(1, int(n).bit_length())
    key = np.sort((C.mix64(ctx) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    same = np.zeros(n, bool)
    same[1:] = (key[1:] >> np.uint64(bits)) == (key[:-1] >> np.uint64(bits))
    guess = np.full(n, -1, np.int64)
    prev = np.concatenate([[0], at[:-1]])
    ok = same & (doc[at] == doc[prev]) & (place[at] >= _MATCH) & (place[prev] >= _MATCH)
    guess[at[ok]] = byte[prev[ok]]
    tried, hit = guess >= 0, guess == byte

    def so_far(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[:-1] - c[ends[:-1]][doc]).astype(np.float64)

    rate = np.where(tried, (so_far(tried & hit) + 0.4) / (so_far(tried) + 1.6), 0.0)
    return np.log((1 - rate) * np.exp(nats) + rate * hit)


def _so_far(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each item how many of the items before it in its text have the flag."""
    c = np.concatenate([[0], np.cumsum(flag)])
    return c[:-1] - np.repeat(c[offsets[:-1]], np.diff(offsets))


def mixed_in(own: np.ndarray, known: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Nats of items with another's (nan: it says nothing) mixed in, at the rate at which that was better in its text so far."""
    tried = ~np.isnan(known)
    known = np.where(tried, known, -np.inf)
    rate = (_so_far(known > own, offsets) + 1) / (_so_far(tried, offsets) + 2)
    return np.where(tried, np.logaddexp(np.log1p(-rate) + own, np.log(rate) + known), own)


class Phrases:
    """Texts (as bytes with a closing zero each) cut after words that a hash of the word and the one before picks."""

    def __init__(self, g: np.ndarray, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray, words: np.ndarray):
        doc = np.repeat(np.arange(len(w) - 1), np.diff(w))
        before = np.concatenate([np.zeros(min(1, len(words)), np.uint64), words[:-1]])
        before[w[:-1][np.diff(w) > 0]] = 0
        last = C.mix64(before * np.uint64(3) + words) & np.uint64(15) == 0
        self.ends = np.union1d(ends[last] + doc[last] + 1, e[1:])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        #: n+1 offsets of phrases by text, and the first word of each phrase.
        self.offsets = np.searchsorted(self.starts, e)
        self.first_word = np.searchsorted(starts + doc, self.starts)
        own = C.word_hashes((g & np.uint64(255)).astype(np.uint8), self.starts, self.ends)
        before = np.concatenate([np.zeros(min(1, len(own)), np.uint64), own[:-1]])
        before[self.offsets[:-1]] = 0
        #: Keys of the phrase before, and of that and the phrase.
        self.context = C.mix64(before + np.uint64(0xA0761D6478BD642F))
        self.pair = C.mix64(self.context * np.uint64(0x9E3779B97F4A7C15) ^ own)

    def here(self, key: np.ndarray) -> np.ndarray:
        """How often each phrase's key stands in its own text."""
        doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        order = np.lexsort((key, doc))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (np.diff(doc[order]) != 0) | (key[order][1:] != key[order][:-1])
        run = np.cumsum(fresh) - 1
        out = np.zeros(len(key), np.int64)
        out[order] = np.bincount(run)[run] if len(run) else run
        return out

    def known(self, context: np.ndarray, pair: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Nats of each phrase by counts in training texts, its own text's left out; nan where its context is in no other."""
        ours = np.repeat(train, np.diff(self.offsets))
        n = context - ours * self.here(self.context)
        with np.errstate(divide="ignore"):
            return np.where(n > 0, np.log(np.maximum(pair - ours * self.here(self.pair), 0)) - np.log(np.maximum(n, 0) + 0.5), np.nan)


def text_nats(nats: np.ndarray, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray, word: np.ndarray, phrases: Phrases, phrase: np.ndarray) -> np.ndarray:
    """Nats of each text, from those of its bytes, of its words (with the byte after them) and of its phrases.

    word: natural logarithm of the corpus's share of each word, with that of the byte after it; -inf if unknown.
    """
    doc = np.repeat(np.arange(len(w) - 1), np.diff(w))
    upto = np.concatenate([[0], np.cumsum(nats)])
    own = upto[ends + doc + 1] - upto[starts + doc]
    gain = np.concatenate([[0], np.cumsum(mixed_in(own, word, w) - own)])
    own = upto[phrases.ends] - upto[phrases.starts] + np.diff(gain[np.append(phrases.first_word, len(own))])
    return np.diff(np.concatenate([[0], np.cumsum(mixed_in(own, phrase, phrases.offsets))])[phrases.offsets])


def score_documents(docs: DataFrame, folds: int = 10, slot_bits: int | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each document.

    slot_bits: folds a bucket's contexts of an order on 2^(slot_bits - 6), for a small model; None keeps all apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes())
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    bits, phrase_bits, spread = tally.bucket_bits(size // 6), tally.bucket_bits(size // 48), bucket_bits(size)
    dealt = rows.withColumn("m", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "m")

    def tokens(t: pa.Table):
        """Per chunk: range of documents, lower-cased bytes, offsets, keys of words, offsets of words."""
        buf, off = C.flat(t.column("text"))
        for a, b in C.chunks(off):
            low, o = C.lowered(buf[off[a] : off[b]]), off[a : b + 1] - off[a]
            s, e, w = C.spans(low, o, C.NOT_SPACE)
            yield a, b, low, o, C.word_hashes(low, s, e), w, s, e

    def asks(t: pa.Table) -> pa.Table:
        train = ~held_out(t.column("doc_id").to_pylist(), folds)
        parts, phrases, seen, size = [], [], [], 0
        for a, b, low, o, h, w, first, after in tokens(t):
            parts.append((h, np.repeat(train[a:b], np.diff(w))))
            g, e = grams(low, o)
            p = Phrases(g, e, first, after, w, h)
            phrases += [(key, np.repeat(train[a:b], np.diff(p.offsets))) for key in (p.context, p.pair)]
            ours = np.repeat(train[a:b], np.diff(e))
            seen.append(np.unique(g[ours], return_counts=True))
            others = np.unique(g[~ours])
            seen.append((others, np.zeros(len(others), np.int64)))
            size += len(seen[-2][0]) + len(others)
            if size > 3_000_000:
                seen = [_gram_counts(seen)]
                size = len(seen[0][0])
        m, tables = t.column("m")[0].as_py(), []
        for some, k, first, whole in ((parts, bits, 0, True), (phrases, phrase_bits, _PHRASES, False)):
            distinct, back = np.unique(np.concatenate([p[0] for p in some]) >> np.uint64(0 if whole else 32 - k), return_inverse=True)
            tables.append(tally.ask(m, distinct, np.bincount(back, weights=np.concatenate([p[1] for p in some]), minlength=len(distinct)), k, first, whole))
        return pa.concat_tables([*tables, ask_grams(m, seen, spread)])

    both = C.stash(dealt.groupBy("m").applyInArrow(asks, tally.ASKED), "asked")
    asked, asked_phrases, levels, n = both.where(f"b >= 0 and b < {_PHRASES}"), both.where(f"b >= {_PHRASES}"), [both.where("b < 0")], blocks
    while n > fan:
        levels.append(C.stash(summed_grams(levels[-1], fan), "asked"))
        n = -(-n // fan)
    with C.freed(spark):
        model = spark.sparkContext.broadcast(gather(levels[-1], slot_bits))

    def summed(t: pa.Table) -> pa.Table:
        _, total, _, _ = tally.totals(t)
        return pa.table([pa.array([int((total > 0).sum())], pa.int64()), pa.array([int(total.sum())], pa.int64())], ["v", "n"])

    with C.freed(spark):
        v, n = asked.groupBy("b").applyInArrow(summed, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    ends_ = rows.select("doc_id").where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != 0).count()
    v, n = int(v or 0) + (ends_ > 0), int(n or 0) + ends_
    floor = np.log10(n + 0.1 * (v + 1))
    end_known, end_score = ends_ > 0, float(np.log10(ends_ + 0.1) - floor)
    of_grams = answered_grams(levels[-1], model)
    for level in levels[-2::-1]:
        of_grams = answered_below(level, of_grams, fan)
    replies = tally.answered(asked, lambda total: total.astype("<i8")).union(tally.answered(asked_phrases, lambda total: total.astype("<f4"))).union(of_grams)

    def scores(t: pa.Table, r: pa.Table) -> pa.Table:
        closing, b_ = model.value.closing, r.column("b").to_numpy()
        answers = Answers(r.filter(pa.array(b_ < 0)).column("reply").to_pylist())
        out_ids = held_out(t.column("doc_id").to_pylist(), folds)
        parts = list(tokens(t))

        def looked_up(keys: list[np.ndarray], counts: np.ndarray, cut: int):
            distinct = np.unique(np.concatenate(keys) >> np.uint64(cut)) if keys else np.zeros(0, np.uint64)
            return lambda h: counts[np.searchsorted(distinct, h >> np.uint64(cut))] if len(h) else np.zeros(0, counts.dtype)

        texts = [Phrases(*grams(low, o), first, after, w, h) for _, _, low, o, h, w, first, after in parts]
        of_word = looked_up([p[4] for p in parts], tally.in_order(r.filter(pa.array((b_ >= 0) & (b_ < _PHRASES))), "<i8"), 0)
        of_phrase = looked_up([x for p in texts for x in (p.context, p.pair)], tally.in_order(r.filter(pa.array(b_ >= _PHRASES)), "<f4"), 32 - phrase_bits)
        cols = [[] for _ in range(5)]
        for (a, b, low, o, h, w, first, after), phrases in zip(parts, texts, strict=True):
            c = of_word(h)
            g, e = grams(low, o)
            add = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            cols[0].append(np.diff(w) + 1)
            cols[1].append(add(c > 0, w).astype(np.int64) + end_known)
            cols[2].append(add(np.log10(c + 0.1) - floor, w) + end_score)
            nats = refined(g, e, answers.nats(g))
            known = np.log(np.maximum(c, 1)) - np.log(max(1, n - ends_)) + closing[(g[after + np.repeat(np.arange(b - a), np.diff(w))] & np.uint64(255)).astype(np.int64)]
            phrase = phrases.known(of_phrase(phrases.context).astype(np.float64), of_phrase(phrases.pair).astype(np.float64), ~out_ids[a:b])
            cols[3].append(text_nats(nats, e, first, after, w, np.where(c > 0, known, -np.inf), phrases, phrase) / np.log(10))
            cols[4].append(np.diff(e))
        tokens_, known, base, score, size_ = (np.concatenate(x) for x in cols)
        C.tidy()
        return pa.table([t.column("doc_id"), pa.array(out_ids), pa.array(tokens_), pa.array(known), pa.array(np.full(len(out_ids), n)), pa.array(base), pa.array(score), pa.array(size_), pa.array(-score / np.log10(2) / size_)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return dealt.groupBy("m").cogroup(replies.groupBy("m")).applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.table(spark, sf_dir, "documents"))
