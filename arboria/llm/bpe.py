"""Byte-pair encoding by a deterministic automaton over tokens [operator 12].

Compiling.  The automaton starts with one state that every byte token leads back to: any sequence of bytes passes.  Then
each merge u+v, in the order of the list, is put in by a gadget:

    the state that u leads to is copied, if other tokens lead there too, and the copy loses its arc for v
    the new token uv has an arc from every state that still has one for u, to the state that v leads to
    (with u = v the state before the loss stays, as the one that uv leads to: of aaa the first two merge)

After the last merge the automaton passes exactly the token sequences that the merges make, one for each text.  States
that were never told apart share a row, and tokens that the same states lack share a column, so all arcs of 50,000
tokens are a bit table of some megabytes; a trie of the tokens' bytes stands beside it.  Size and time follow the
vocabulary, not the data: the driver compiles once and broadcasts the tables.

Encoding.  A text is cut into units as in `token_store`, a unit into the words of the vocabulary's own pre-tokenizer.
Every prefix of a word has one passing token sequence, so the automaton has one state after each byte of a word: from
each byte on the trie is walked, and where a token ends and the state has an arc for it, the arc's end is the state
there.  All words of a batch go forward together, a byte at a time; the arcs are then read from the words' ends.
Decoding puts the labels (bytes) of the arcs one after another.

Defined results: a null text is empty and has no ids; special tokens of the vocabulary are found in texts first, as the
library does; a vocabulary with another kind of model or pre-tokenizer, a normalizer, or merges not in the order in which
their parts are made, is refused.  Rows of equal id, null ids and extra columns: each row is encoded by itself, other
columns are ignored; an empty table gives no rows.  Texts are encoded whole, in memory of some 40 bytes a byte of the
longest one.  decode() of ids that make no UTF-8 puts U+FFFD for the bytes that don't fit, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .token_store import Encoder


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Tables of a compiled vocabulary; what is broadcast."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type") != "BPE" or odd or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-pair model")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a byte-level pre-tokenizer without prefix space and normalizer")
        chars = _byte_chars()
        vocab = model["vocab"]
        ids = {bytes(chars[c] for c in t): i for t, i in vocab.items() if all(c in chars for c in t)}
        self.size = 1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._compile(ids, [(bytes(chars[c] for c in a), bytes(chars[c] for c in b)) for a, b in merges])
        self._trie(ids)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("an added token with a rule of its own")
        labels = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [labels.get(i, b"") for i in range(self.size)]
        self.labels, self.label_at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        self.width, self.dtype = (2, "<u2") if self.size <= 1 << 16 else (4, "<u4")

    def _compile(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        row, col = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        most = 2 * len(merges) + 3
        lacks = np.zeros((256, 256), np.uint8)  # states x (columns / 8): bit set where the state has no arc
        rows, cols, in_row, in_col = 1, 2, [1], [0, 0]  # state 0 is the start; column 1 is that of tokens without arcs
        lacks[0, 0] = 2
        made: set[bytes] = set()
        for b in range(256):
            if (one := bytes([b])) not in ids:
                raise ValueError("a vocabulary without all bytes")
            row[ids[one]], col[ids[one]] = 0, 0
            in_row[0] += 1
            in_col[0] += 1
            made.add(one)
        for u, v in merges:
            if u not in made or v not in made or u + v in made:
                raise ValueError("merges are not in the order in which tokens are made")
            made.add(u + v)
            a, b, new = ids[u], ids[v], ids[u + v]
            before = row[a]
            if lacks[before, col[b] >> 3] >> (col[b] & 7) & 1:  # no text has u and v side by side by now
                row[new], col[new] = row[b], 1
                in_row[row[b]] += 1
                continue
            if in_row[before] > 1 or a == b:
                if rows == len(lacks):
                    lacks = np.concatenate([lacks, np.zeros((min(len(lacks), most - rows), lacks.shape[1]), np.uint8)])
                lacks[rows] = lacks[before]
                in_row[before] -= 1
                in_row.append(1)
                row[a], rows = rows, rows + 1
            if in_col[col[b]] > 1:
                if cols == 8 * lacks.shape[1]:
                    lacks = np.concatenate([lacks, np.zeros((len(lacks), min(lacks.shape[1], (most - cols) // 8 + 1)), np.uint8)], axis=1)
                old = int(col[b])
                lacks[:rows, cols >> 3] |= (lacks[:rows, old >> 3] >> np.uint8(old & 7) & np.uint8(1)) << np.uint8(cols & 7)
                in_col[old] -= 1
                in_col.append(1)
                col[b], cols = cols, cols + 1
            lacks[row[a], col[b] >> 3] |= 1 << (col[b] & 7)
            row[new], col[new] = before if a == b else row[b], col[a]
            in_row[row[new]] += 1
            in_col[col[a]] += 1
        self.row, self.col, self.lacks = row, col, np.ascontiguousarray(lacks[:rows, : (cols + 7) // 8])

    def _trie(self, ids: dict[bytes, int]) -> None:
        """Nodes in level order; a node's children are those of its set bits, from `first` on."""
        level = sorted(t for t in ids if t and self.row[ids[t]] >= 0)
        words, token, starts, nodes = [], [-1], [], 1
        here = [(0, level)]
        while here:
            below = []
            for depth, tokens in here:
                bits, at = 0, 0
                starts.append(nodes)
                while at < len(tokens):
                    byte, to = tokens[at][depth], at
                    while to < len(tokens) and tokens[to][depth] == byte:
                        to += 1
                    ends = len(tokens[at]) == depth + 1
                    token.append(ids[tokens[at]] if ends else -1)
                    below.append((depth + 1, tokens[at + ends : to]))
                    bits |= 1 << byte
                    nodes, at = nodes + 1, to
                words.append([bits >> 64 * k & (1 << 64) - 1 for k in range(4)])
            here = below
        self.bits, self.token = np.array(words, np.uint64), np.array(token, np.int32)
        ones = np.bitwise_count(self.bits).astype(np.int32)
        self.first = np.array(starts, np.int32)[:, None] + np.cumsum(ones, axis=1, dtype=np.int32) - ones

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's node one byte on, or -1."""
        lane, bit = byte >> 6, (byte & 63).astype(np.uint64)
        bits = self.bits[node, lane]
        below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where(bits >> bit & np.uint64(1), self.first[node, lane] + below, -1)

    def passes(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        col = self.col[token]
        return (self.lacks[state, col >> 3] >> (col & 7) & 1) == 0

    #: Words of more bytes than this go forward one by one.
    LONG = 96

    def words(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between the places `at` of a buffer, and how many each word has."""
        last = np.full(len(buf) + 1, -1, np.int32)  # the token that ends at each place
        size = np.diff(at)
        short = np.flatnonzero((size > 0) & (size <= self.LONG))
        for group in np.array_split(short[np.argsort(size[short], kind="stable")], max(1, len(short) >> 15)):
            self._forward(buf, at[:-1][group], at[1:][group], last)
        for w in np.flatnonzero(size > self.LONG).tolist():
            self._forward_one(buf, int(at[w]), int(at[w + 1]), last)
        marks, place = np.zeros(len(buf) + 1, bool), at[1:][size > 0].copy()
        begin, length = at[:-1][size > 0], np.diff(self.label_at)
        while len(place):
            marks[place] = True
            place = place - length[last[place]]
            some = place > begin
            place, begin = place[some], begin[some]
        ends = np.flatnonzero(marks)
        return last[ends], np.diff(np.searchsorted(ends, at, "right"))

    def _forward(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> None:
        """All words (by length) from a to b at once, a byte in a step."""
        size = b - a
        for i in range(int(size[-1]) if len(size) else 0):
            live = np.searchsorted(size, i, "right")
            place, end = a[live:] + i, b[live:]
            state = np.zeros(len(place), np.int32) if i == 0 else self.row[last[place]]
            node = np.zeros(len(place), np.int32)
            walk = place
            while len(walk):
                node = self.child(node, buf[walk])
                some = node >= 0
                node, walk, end, state = node[some], walk[some] + 1, end[some], state[some]
                token = self.token[node]
                ends = np.flatnonzero(token >= 0)
                ends = ends[self.passes(state[ends], token[ends])]
                last[walk[ends]] = token[ends]
                some = walk < end
                if not some.all():
                    node, walk, end, state = node[some], walk[some], end[some], state[some]

    def _forward_one(self, buf: np.ndarray, a: int, b: int, last: np.ndarray) -> None:
        """A long word: the trie from many places at once, then the arcs in the order of their ends."""
        for x in range(a, b, 1 << 14):
            place = np.arange(x, min(b, x + (1 << 14)))
            node, arcs = np.zeros(len(place), np.int32), []
            walk = place
            while len(walk):
                node = self.child(node, buf[walk])
                some = node >= 0
                node, walk, place = node[some], walk[some] + 1, place[some]
                ends = self.token[node] >= 0
                arcs.append((place[ends], walk[ends], self.token[node[ends]]))
                some = walk < b
                node, walk, place = node[some], walk[some], place[some]
            start, end, token = (np.concatenate(p) for p in zip(*arcs, strict=True))
            order = np.argsort(start, kind="stable")
            row, lacks, col = self.row, self.lacks, self.col[token]
            for s, e, t, c in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), col[order].tolist(), strict=True):
                if not lacks[row[last[s]] if s > a else 0, c >> 3] >> (c & 7) & 1:
                    last[e] = t

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of a sequence of arcs, one after another."""
        at, n = self.label_at[ids], self.label_at[ids + 1] - self.label_at[ids]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.labels[np.repeat(at, n) + step].tobytes()


def automaton(vocabulary: str) -> Automaton:
    with open(vocabulary, encoding="utf-8") as f:
        return Automaton(json.load(f))


class WordEncoder(Encoder):
    """Token ids of whole batches by an automaton; distinct units of a batch, and those remembered, go through it once."""

    def __init__(self, auto: Automaton):
        from tokenizers import pre_tokenizers

        if any(b in s for s in auto.special for b in " \n"):
            raise ValueError("an added token with a blank")
        self.auto, self.end, self.width = auto, 0, auto.width
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(auto.special, key=len, reverse=True)) + ")") if auto.special else None
        self.forget()

    def _sizes(self, text: str) -> list[int]:
        """Bytes of the pre-tokenizer's words, in order."""
        return [len(word) for word, _ in self.pre.pre_tokenize_str(text)]

    def _units(self, data: bytes, a: np.ndarray, b: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base, counts, parts, used = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), [], 0
        alone = [np.flatnonzero(~plain)]
        for some in np.array_split(np.flatnonzero(plain), np.count_nonzero(plain) // 4096 + 1):
            raw = b"".join(data[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True))
            text, starts = raw.decode(), np.cumsum([0, *(b[some] - a[some])])
            at = np.cumsum([0, *self._sizes(text)])
            first = np.searchsorted(at, starts)
            if (self.split and self.split.search(text)) or (at[first] != starts).any():
                alone.append(some)
                continue
            ids, n = self.auto.words(np.frombuffer(raw, np.uint8), at)
            upto = np.cumsum([0, *n])[first]
            base[some], counts[some] = used + upto[:-1], np.diff(upto)
            parts.append(ids)
            used += len(ids)
        for i in np.concatenate(alone).tolist():
            ids = self._one(data[a[i] : b[i]])
            base[i], counts[i], used = used, len(ids), used + len(ids)
            parts.append(ids)
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32), base, counts

    def _one(self, raw: bytes) -> np.ndarray:
        """Ids of one unit, special tokens first."""
        out = []
        text = raw.decode("utf-8", "replace")
        for part in self.split.split(text) if self.split else [text]:
            if part in self.auto.special:
                out.append(np.array([self.auto.special[part]], np.int32))
            elif part:
                out.append(self.auto.words(np.frombuffer(part.encode(), np.uint8), np.cumsum([0, *self._sizes(part)]))[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents, and n+1 offsets."""
        ids, off = self.batch(buf, offsets)  # each with an end id
        return np.delete(ids, off[1:] - 1), off - np.arange(len(off))


_encoders: dict[int, WordEncoder] = {}


def _encoder(shared) -> WordEncoder:
    """One a worker and automaton: its memory of units serves all tasks that the worker runs."""
    key = id(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(shared.value)
    return _encoders[key]


def encode(docs: DataFrame, auto: Automaton) -> DataFrame:
    """doc_id, ids (binary, little-endian, auto.width bytes an id) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            for a, b in C.chunks(off):
                ids, o = enc.documents(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                ends = pa.py_buffer((o * enc.width).astype(np.int64).tobytes())
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, ends, pa.py_buffer(ids.astype(enc.auto.dtype).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blob], ["doc_id", "ids"])
        C.tidy()

    C.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes()).mapInArrow(run, "doc_id long, ids binary")


def decoded(spark: SparkSession, auto: Automaton, ids: str = "ids"):
    """A column of ids as encode() gives them, as text; special tokens are kept."""
    shared, dtype = spark.sparkContext.broadcast((auto.labels, auto.label_at)), auto.dtype

    def run(column: pa.Array) -> pa.Array:
        labels = Automaton.__new__(Automaton)
        labels.labels, labels.label_at = shared.value
        return pa.array([labels.decode(np.frombuffer(x or b"", dtype).astype(np.int64)).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(F.col(ids))


def decimal_sha256(dtype: str, ids: str = "ids"):
    """Lower-case hex SHA-256 of ids in decimal, joined by commas; long rows are written out in pieces."""

    def one(x: bytes | None) -> str:
        values, h = np.frombuffer(x or b"", dtype), hashlib.sha256()
        for k in range(0, len(values), 1 << 16):
            h.update(("," if k else "").encode() + ",".join(map(str, values[k : k + (1 << 16)].tolist())).encode())
        return h.hexdigest()

    return F.arrow_udf(lambda column: pa.array(map(one, column.to_pylist()), pa.string()), "string")(F.col(ids))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    auto = automaton(public_tokenizers.path("byte_bpe_50k.json"))
    coded = encode(C.table(spark, sf_dir, "documents"), auto)
    n = F.expr(f"octet_length(ids) div {auto.width}").alias("n_tokens")
    return coded.select("doc_id", n, decimal_sha256(auto.dtype).alias("ids_sha256"), F.sha2(decoded(spark, auto), 256).alias("decoded_sha256"))
