"""Token ids with Elias-Fano document boundaries [operator 8].

Texts become token ids (a byte-level BPE read with the tokenizers library), an end id closes each document,
and ids are written in ascending doc_id order as shard files.  A shard file is

    ids, two bytes each (four if the vocabulary is larger), as one array
    Elias-Fano code of the n+1 document boundaries       (about 2 + log2(ids / documents) bits a document)
    Elias-Fano code of the doc_ids, less the smallest
    a fixed footer: lengths, smallest doc_id, documents without doc_id, id width, magic

so a reader finds document i by two selects, from samples of the code, with no table of 64-bit offsets; whole files
are read in runs of documents, each between two selects.

How texts are cut: a single space or line feed between two characters that are surely not white space always
starts a new piece for the tokenizer, whatever stands around it, so a text is the sequence of its units cut
there.  Each distinct unit of a batch is encoded once, its bytes being compared with those of the units known; numpy
puts the ids of all occurrences together.

Defined results: a null text is empty (only the end id); null doc_ids come first; repeated rows are all
written; rows of one doc_id are ordered by their ids; an empty table gives no files and no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"EFT1"
FOOTER = "<QQQqQI4s"


class EliasFano:
    """A non-decreasing sequence of non-negative numbers in near-minimal space, with select."""

    HEAD = "<QQB"
    EVERY = 512

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high = n, top, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 7) // 8, np.uint8)
        if bits:
            planes = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
            low = np.packbits(planes.reshape(-1), bitorder="little")
        ones = np.zeros(n + (top >> bits) + 1, np.uint8)
        ones[(values >> bits) + np.arange(n)] = 1
        return cls(n, top, bits, low, np.packbits(ones, bitorder="little"))

    def dump(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.top, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, top, bits = struct.unpack_from(cls.HEAD, data)
        a = (n * bits + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=struct.calcsize(cls.HEAD))
        return cls(n, top, bits, raw[:a], raw[a : a + (n + (top >> bits) + 8) // 8])

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << k
        return out

    def _sampled(self) -> np.ndarray:
        """(byte, ones before in that byte) of every EVERY-th one among the high bits: eight bytes for EVERY values."""
        out, before, piece = [], 0, 1 << 14
        for a in range(0, len(self.high), piece):
            ones = np.bitwise_count(self.high[a : a + piece])
            upto = np.cumsum(ones, dtype=np.uint32)
            want = np.arange(-(-before // self.EVERY) * self.EVERY, before + int(upto[-1]), self.EVERY, dtype=np.int64) - before
            byte = np.searchsorted(upto, want, "right")
            out.append(np.stack([byte + a, want - (upto[byte] - ones[byte])], axis=1).astype(np.uint32))
            before += int(upto[-1])
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint32)

    def values(self, a: int, b: int) -> np.ndarray:
        """Values a to b (exclusive): the ones from the nearest sample on among the high bits, and the low bits."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.int64)
        if self._samples is None:
            self._samples = self._sampled()
        byte, skip = (int(x) for x in self._samples[a // self.EVERY])
        skip += a % self.EVERY
        parts, found = [], -skip
        while found < b - a:
            piece = self.high[byte : byte + 512]
            if not len(piece):
                raise ValueError("a boundary code is cut off")
            ones = np.flatnonzero(np.unpackbits(piece, bitorder="little"))
            parts.append(ones[max(0, -found) : max(0, b - a - found)] + byte * 8)
            byte, found = byte + len(piece), found + len(ones)
        i = np.arange(a, b)
        return ((np.concatenate(parts) - i) << self.low_bits) | self._low(i)

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.values(i, i + 1)[0])


# ---- encoding --------------------------------------------------------------------------------------------------

#: Bytes after which, and before which, a single space or line feed surely is one: printable ASCII, or (lead bytes
#: of) two-byte characters from U+00C0 on, none of which is white space.
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units, and for each whether it is plain: a space or line feed and then only sure bytes."""
    n = len(buf)
    lead, ascii_ = _LEAD[buf], _ASCII[buf]
    tail = np.zeros(n, bool)
    tail[1:] = _TAIL[buf[1:]] & lead[:-1]
    blank = (buf == 32) | (buf == 10)
    cut = np.zeros(n + 1, bool)
    cut[1 : n - 1] = blank[1:-1] & (ascii_ | tail)[:-2] & (ascii_ | lead)[2:]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    cut[:-1] &= ~inner[:-1] & ~inner[1:]
    sure = ascii_ | tail
    sure[:-1] |= lead[:-1] & tail[1:]
    odd = ~(sure | cut[:-1])
    starts = np.flatnonzero(cut | inner)
    starts = starts[starts < n]
    plain = cut[starts] & ~np.logical_or.reduceat(odd, starts) if len(starts) else np.zeros(0, bool)
    return starts, plain


class Encoder:
    """Token ids of whole batches; `end` closes each document.  Exactly what encode() gives for each text."""

    def __init__(self, path: str, end: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a thread a core would keep an allocator's arena each
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 and end < 1 << 16 else 4
        self.opens = np.zeros(max(size, end + 1), bool)
        for t, i in self.tok.get_vocab().items():
            self.opens[i] = t.startswith("Ġ") or t == "Ċ"
        self.forget()

    #: Slots of the memory of units: a unit's ids stay at its hash's slot until the memory is full and begins anew.
    SLOTS = 1 << 20
    #: Eights of bytes of the units in slots, compared byte by byte; longer units are remembered by themselves.
    LANES = 3

    def forget(self) -> None:
        self.lanes = np.zeros((self.LANES, self.SLOTS), np.uint64)
        self.size, self.base, self.n = np.zeros(self.SLOTS, np.uint8), np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.flat, self.used = np.zeros(self.SLOTS, np.uint16 if self.width == 2 else np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _remember(self, ids: np.ndarray) -> int:
        """Puts ids at the end of `flat`, which doubles where it is full, and says where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used), self.flat.dtype)
            grown[:at] = self.flat[:at]
            self.flat = grown
        self.flat[at : self.used] = ids
        return at

    def _look_up(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of each unit begin, and how many; units not remembered are encoded."""
        if self.used > 8 * self.SLOTS or len(self.long) > self.SLOTS // 8:
            self.forget()
        base, n, size = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), b - a
        wide, data = C.eights(buf), buf.tobytes()
        some = np.flatnonzero(size <= 8 * self.LANES)
        lanes = np.zeros((self.LANES, len(some)), np.uint64)
        for k in range(self.LANES):
            more = size[some] > 8 * k
            at = some[more]
            lanes[k, more] = wide[a[at] + 8 * k] & C.FIRST[np.minimum(size[at] - 8 * k, 8)]
        h = size[some].astype(np.uint64)
        for lane in lanes:
            h = C.mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ lane)
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        known = (self.n[slot] > 0) & (self.size[slot] == size[some])
        for k in range(self.LANES):
            known &= self.lanes[k, slot] == lanes[k]
        base[some], n[some] = self.base[slot], self.n[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            key = [size[some[miss]], *lanes[:, miss]]
            order = np.lexsort(key)
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in key])
            back = np.zeros(len(order), np.int64)
            back[order] = np.cumsum(fresh) - 1
            one = miss[order[fresh]]
            ids, at, counts = self._units(data, a[some[one]], b[some[one]], plain[some[one]])
            at += self._remember(ids)
            base[some[miss]], n[some[miss]] = at[back], counts[back]
            taken, keep = np.unique(slot[one], return_index=True)  # of several units for a slot one is remembered
            one = one[keep]
            self.lanes[:, taken], self.size[taken], self.base[taken], self.n[taken] = lanes[:, one], size[some[one]], at[keep], counts[keep]
        rest = np.flatnonzero(size > 8 * self.LANES)
        if len(rest):
            texts = [data[x:y] for x, y in zip(a[rest].tolist(), b[rest].tolist(), strict=True)]
            fresh = {x: k for k, x in enumerate(texts) if x not in self.long}
            one = rest[list(fresh.values())]
            ids, at, counts = self._units(data, a[one], b[one], plain[one])
            at += self._remember(ids)
            self.long |= zip(fresh, zip(at.tolist(), counts.tolist(), strict=True), strict=True)
            base[rest], n[rest] = np.array([self.long[x] for x in texts], np.int64).T
        return base, n

    def _units(self, data: bytes, a: np.ndarray, b: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units, and for each where they begin and how many they are."""
        base, counts, ids = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(0, np.uint32)
        together = np.flatnonzero(plain)
        if len(together):
            texts = [b"".join(data[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)).decode() for some in np.array_split(together, len(together) // 4096 + 1)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for text in texts for e in self.tok.encode_batch_fast([text], add_special_tokens=False)])
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(together) and at[0] == 0:
                base[together], counts[together] = at, np.diff(np.append(at, len(ids)))
            else:  # a vocabulary in which a blank does not open exactly one token
                plain, ids = np.zeros(len(a), bool), ids[:0]
        alone = np.flatnonzero(~plain)
        parts = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([data[a[i] : b[i]].decode("utf-8", "replace") for i in alone.tolist()], add_special_tokens=False)]
        counts[alone] = [len(x) for x in parts]
        base[alone] = len(ids) + np.cumsum(counts[alone]) - counts[alone]
        return np.concatenate([ids, *parts]), base, counts

    def batch(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents, each with its end id, and n+1 offsets."""
        docs = len(offsets) - 1
        starts, plain = _cuts(buf, offsets) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, bool))
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        base, n = self._look_up(buf, starts, ends, plain)
        unit_doc = np.searchsorted(offsets, starts, "right") - 1
        per = np.bincount(unit_doc, weights=n, minlength=docs).astype(np.int64) + 1 if docs else np.zeros(0, np.int64)
        out_off = np.concatenate([[0], np.cumsum(per)])
        out = np.full(out_off[-1], self.end, np.uint32)
        where = np.concatenate([[0], np.cumsum(n)])[:-1] + unit_doc
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(where, n) + step] = self.flat[np.repeat(base, n) + step]
        return out, out_off


@lru_cache(1)
def id_width(path: str, end: int) -> int:
    """Bytes of an id."""
    return Encoder(path, end).width


def encode(docs: DataFrame, vocabulary: str, end: int = 0, bounds: np.ndarray | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian, 2 or 4 bytes an id) and shard (of range_bounds()) of each document.

    A task has an encoder of its own, which goes with it, vocabulary and all: idle workers count against their executor,
    and Spark takes turns with them.  The shard is told in the same pass, which so takes one worker a task and not two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if bounds is None else bounds)

    def run(batches):
        enc = Encoder(vocabulary, end)
        dtype = "<u2" if enc.width == 2 else "<u4"
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            for a, b in C.chunks(off):
                ids, o = enc.batch(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                raw = pa.py_buffer(ids.astype(dtype).tobytes())
                ends = pa.py_buffer((o * enc.width).astype(np.int64).tobytes())
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, ends, raw]).cast(pa.binary())
                keys = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([keys, blob, C.shards_in(keys, shared.value)], ["doc_id", "ids", "shard"])
        del enc
        C.tidy()

    C.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes()).mapInArrow(run, "doc_id long, ids binary, shard int")


# ---- shard files -----------------------------------------------------------------------------------------------


def write_store(docs: DataFrame, folder: str, vocabulary: str, end: int = 0, shard_chars: int = 32 << 20) -> DataFrame:
    """Writes the shard files of `docs` and returns the manifest: shard, file, n_docs, n_ids, bytes."""
    spark = docs.sparkSession
    wide = id_width(vocabulary, end)
    bounds = C.range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", F.coalesce(F.length("text"), F.lit(0)) + 1, shard_chars)
    dealt = C.dealt_to_shards(encode(docs, vocabulary, end, bounds), len(bounds) + 1, F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        now, out, sizes, keys = None, None, [], []

        def close():
            ids = np.concatenate(sizes)
            doc = pa.concat_arrays(keys)
            nulls, real = doc.null_count, np.sort(doc.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            bounds_ef = EliasFano.of(np.concatenate([[0], np.cumsum(ids)])).dump()
            low = int(real[0]) if len(real) else 0
            keys_ef = EliasFano.of(real - low).dump()
            total = int(ids.sum())
            for part in (bounds_ef, keys_ef, struct.pack(FOOTER, total, len(bounds_ef), len(keys_ef), low, nulls, wide, MAGIC)):
                out.write(part)
            out.commit()
            return now, name(now), len(ids), total, out.size

        name = lambda k: f"ids-{k:06d}.eft"
        rows = []
        for batch in batches:
            buf, off = C.flat(batch.column(1))
            shard = np.asarray(batch.column(2))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != int(shard[a]):
                    if out is not None:
                        rows.append(close())
                    now, sizes, keys = int(shard[a]), [], []
                    out = C.Committed(folder, name(now))
                out.write(buf[off[a] : off[b]].tobytes())
                sizes.append(np.diff(off[a : b + 1]) // wide)
                keys.append(batch.column(0).slice(a, b - a))
        if out is not None:
            rows.append(close())
        C.tidy()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "file", "n_docs", "n_ids", "bytes"])

    with C.freed(spark):
        dealt.mapInArrow(run, "shard int, file string, n_docs long, n_ids long, bytes long").write.parquet(f"{folder}/_manifest")
    C.swept(folder)
    return spark.read.parquet(f"{folder}/_manifest")


class Shard:
    """One shard file, read by ranges: ids(i) is document i's, found by two selects."""

    def __init__(self, folder: str, name: str):
        fs, root = C.file_system(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        foot = struct.calcsize(FOOTER)
        end = self.file.size() - foot
        total, nb, nk, self.low, self.nulls, self.wide, magic = struct.unpack(FOOTER, self.file.read_at(foot, end))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.bounds = EliasFano.load(self.file.read_at(nb, total * self.wide))
        self.keys = EliasFano.load(self.file.read_at(nk, total * self.wide + nb))

    def __len__(self) -> int:
        return self.bounds.n - 1

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids from place a to b of the whole array."""
        return np.frombuffer(self.file.read_at((b - a) * self.wide, a * self.wide), "<u2" if self.wide == 2 else "<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_ids(self, a: int = 0, b: int | None = None) -> list[int | None]:
        """doc_ids of documents a to b (exclusive)."""
        b = len(self) if b is None else b
        nulls = max(0, min(b, self.nulls) - a)
        return [None] * nulls + (self.keys.values(max(0, a - self.nulls), max(0, b - self.nulls)) + self.low).tolist()


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files named in the manifest."""
    files = spark.read.parquet(f"{folder}/_manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = files.select("file", before.cast("long").alias("base"))
    n = max(1, files.count())

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(folder, name)
                for first in range(0, len(s), EliasFano.EVERY):
                    bounds = s.bounds.values(first, first + EliasFano.EVERY + 1)
                    docs = s.doc_ids(first, first + len(bounds) - 1)
                    for a, b in C.chunks(bounds):
                        at = bounds[a : b + 1]
                        raw = memoryview(s.span(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                        cut = (4 * (at - at[0])).tolist()
                        crc = [zlib.crc32(raw[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, vocabulary: str | None = None, end: int = 0, shard_chars: int = 32 << 20) -> DataFrame:
    """Writes the token store of `docs` to the shared folder and returns what its files hold."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = C.new_dir(spark, "tokens")
    write_store(docs, folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end, shard_chars)
    return read_store(spark, folder)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(C.table(spark, sf_dir, "documents"))
