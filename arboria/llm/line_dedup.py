"""Near-duplicate lines by a segment-partition edit join [operator 4].

Lines are what stands between line feeds, without ASCII white space at both ends; lines without a word are left
alone.  A line is known by a 128-bit digest of its bytes.  Two different lines link when both have `min_chars` code points or more and are at most `edits` apart
(insertions, deletions, substitutions of code points).  A line is a duplicate when an equal line (exact) or a linked
line (near) stands earlier, by doc_id and line number of the first occurrence; all others are kept.  Lines that links connect
are a class, by the smallest of their digests; each duplicate comes with its class and the place it repeats (the first
of the equal line, or of the earliest line linked to it), each document with the text of its kept lines.

1. Tasks send each distinct line of a chunk once, with its first place, to the block of the line, which adds those up; so
   a line that a third of all documents hold costs a row a chunk.
2. A line of length n is cut into edits + 1 segments.  Within `edits` of another line at least one segment stands in
   that unharmed, at a place the lengths bound (multi-match-aware windows).  Blocks of lines learn through `tally`
   which of their length-and-place-aware keys any other line has; few have, and only those become join rows.
   The rows of a key that more than MEET lines have are cut into parts, which meet the others in tasks of their own.
3. Candidates under the length filter and a parity sketch of bigrams are verified once a pair, by banded bit-parallel edit
   distance.

Defined results: a null text has no lines, and an empty kept text; lines without a word stay in it; a null doc_id comes first; rows of one doc_id and line number are not
later than each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tally
from .components import components

BLOCK = 6 << 20
#: About as many lines of a key meet all others of that key in a task.
MEET = 2000
_FIRST = -(2**63)


# ---- edit distance ---------------------------------------------------------------------------------------------


def within(a: str, b: str, most: int) -> bool:
    """Whether a and b are at most `most` edits apart: a band of 2 * most + 1 diagonals, one machine word a column."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    e = 0
    while e < len(b) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not b or len(a) <= most:
        return len(a) <= most
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    vp, vn = full & ~((1 << (width - 1 - most)) - 1), 0
    dist, start, across = most, most + 1 - width, top >> 1
    limit = 2 * most + len(b) - len(a)
    for j, ch in enumerate(b):
        pm = place.get(ch, 0)
        x = (pm >> start if start >= 0 else pm << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j < len(a) - most:
            dist += not d0 & top
        else:
            dist += bool(hp & across) - bool(hn & across)
            across >>= 1
        if dist > limit + most:
            return False
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        start += 1
    return dist <= most


# ---- keys ------------------------------------------------------------------------------------------------------


def segments(n: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of the segments of lines of n code points; the last ones get what is over."""
    small, over, at, out = n // parts, n % parts, np.zeros_like(n), []
    for i in range(parts):
        length = small + (i >= parts - over)
        out.append((at, length))
        at = at + length
    return out


def sketches(lines: list[str]) -> np.ndarray:
    """Of each line, for each of 64 cells whether an odd number of its bigrams falls in it; an edit changes four at most."""
    ends = np.cumsum([len(x) for x in lines], dtype=np.int64)
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    upto = np.zeros(max(1, len(points)), np.uint64)  # of the bigrams that begin before each place, across lines too
    np.bitwise_xor.accumulate(np.uint64(1) << (C.mix64(points[:-1] * np.uint64(1 << 21) + points[1:]) >> np.uint64(58)), out=upto[1:])
    return (upto[np.maximum(ends - 1, starts)] ^ upto[starts]).view(np.int64)


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = max(C.CHUNK, n) + 1
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)


class Lines:
    """Rolling hashes of the code points of many lines one after another; they only find candidates."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])[:-1].astype(np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        _grow(len(points))
        self.sum = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * _powers[0][: len(points)], out=self.sum[1:])

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return C.mix64((self.sum[start + length] - self.sum[start]) * _powers[1][start] + length.astype(np.uint64))

    def _slots(self, some: np.ndarray, edits: int, min_chars: int):
        """Which of `some` lines have a key of each kind, these keys, and whether they are of the lines' own segments."""
        n, at = self.n[some], self.at[some]
        for less in range(edits + 1):
            target = n - less
            for i, (p, length) in enumerate(segments(target, edits + 1)):
                low = np.maximum(np.maximum(p - i, p + less - (edits - i)), 0)
                high = np.minimum(np.minimum(p + i, p + less + (edits - i)), n - length)
                for shift in range(-edits, edits + 1):
                    q = p + shift
                    ok = (q >= low) & (q <= high) & (target >= min_chars)
                    if ok.any():
                        h = self.hash(at[ok] + q[ok], length[ok])
                        yield ok, C.mix64(h + (target[ok].astype(np.uint64) << np.uint64(8)) + np.uint64(i + 1)), less == 0 and shift == 0

    def keys(self, edits: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """line, key, and whether it is one of the line's own segments (else a substring to look up)."""
        some = np.flatnonzero(self.n >= min_chars)
        line, key, own = [], [], []
        for ok, k, mine in self._slots(some, edits, min_chars):
            line.append(some[ok])
            key.append(k)
            own.append(np.full(len(k), mine))
        if not line:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(line), np.concatenate(key), np.concatenate(own)

    def distinct_keys(self, edits: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys() by line and key, without repetition within a line; own where one of equal keys is."""
        some = np.flatnonzero(self.n >= min_chars)
        slots = sorted(self._slots(some, edits, min_chars), key=lambda s: not s[2])  # own segments first; all lines have these
        if not slots:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        key = np.repeat(slots[0][1][:, None], len(slots), axis=1)  # a key that a line lacks repeats its first
        for j, (ok, k, _) in enumerate(slots):
            key[ok, j] = k
        order = np.argsort(key, axis=1, kind="stable")
        key, own = np.take_along_axis(key, order, 1), np.array([s[2] for s in slots])[order]
        fresh = np.ones(key.shape, bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :-1]
        return np.repeat(some, fresh.sum(axis=1)), key[fresh], own[fresh]


# ---- the operator ----------------------------------------------------------------------------------------------


def _chunk_lines(column, doc_ids: list) -> tuple[dict[bytes, list], list[tuple]]:
    """Distinct lines with number, first place and how often they stand, and for each document its lines: (number of line, place)."""
    first: dict[bytes, list] = {}
    docs = []
    for doc, text in zip(doc_ids, column, strict=True):
        key, own = _FIRST if doc is None else doc, []
        for no, raw in enumerate((text or b"").split(b"\n")):
            line = raw.strip()
            if line:
                at = first.get(line)
                if at is None:
                    at = first[line] = [len(first), key, no, 0]
                elif (key, no) < (at[1], at[2]):
                    at[1], at[2] = key, no
                at[3] += 1
                own.append((at[0], no))
        docs.append(own)
    return first, docs


def _merged(t: pa.Table) -> pa.Table:
    """Each line of a block once, with its first place and how often it stands in all."""
    lid = t.column("lid").combine_chunks()
    wide = np.frombuffer(b"".join(lid.to_pylist()), ">u8").reshape(-1, 2)
    d, no, times = (t.column(c).to_numpy() for c in ("d", "no", "times"))
    order = np.lexsort((no, d, wide[:, 1], wide[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (wide[order[1:]] != wide[order[:-1]]).any(axis=1)
    first = order[new]
    total = np.add.reduceat(times[order], np.flatnonzero(new))
    return t.take(pa.array(first)).set_column(t.schema.get_field_index("times"), "times", pa.array(total, pa.int64()))


def _block(t: pa.Table, edits: int, min_chars: int):
    """Of a block of distinct lines: texts, code points, and keys without repetition within a line."""
    texts = [x.decode("utf-8", "replace") for x in t.column("line").to_pylist()]
    parts, size, a = [], 0, 0
    for b, x in enumerate(texts, 1):
        size += len(x)
        if size > C.CHUNK or b == len(texts):
            lines = Lines(texts[a:b])
            line, key, own = lines.distinct_keys(edits, min_chars)
            parts.append((line + a, key, own, lines.n))
            a, size = b, 0
    line, key, own, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return texts, n, line, key, own


def _size(rows: DataFrame) -> int:
    """Bytes of texts and of what goes with each; the sum's shuffle is deleted."""
    with C.freed(rows.sparkSession):
        return rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def line_dedup(docs: DataFrame, edits: int = 2, min_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lines (lid, d, no, times, ...: digest, doc_id and number of the first place, how often it stands) and links (a, b, their first places) between lines; both are stashes.

    Lines of any length link; those of less than edits + 1 code points have empty segments, and meet by length alone.  A
    larger min_chars leaves shorter lines out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes())
    size = _size(rows)
    blocks = max(1, -(-size // BLOCK))
    bits = tally.bucket_bits(size // 20)

    def split(batches):
        for batch in batches:
            buf, off = C.flat(batch.column("text"))
            for a, b in C.chunks(off, 4 * C.CHUNK):
                first, _ = _chunk_lines(batch.column("text").slice(a, b - a).to_pylist(), batch.column("doc_id").slice(a, b - a).to_pylist())
                lines = list(first)
                yield pa.RecordBatch.from_arrays([pa.array([C.digest(x) for x in lines], pa.binary()), pa.array([x[1] for x in first.values()], pa.int64()), pa.array([x[2] for x in first.values()], pa.int64()), pa.array([x[3] for x in first.values()], pa.int64()), pa.array(lines, pa.binary())], ["lid", "d", "no", "times", "line"])

    each = rows.mapInArrow(split, "lid binary, d long, no long, times long, line binary")
    dealt = each.withColumn("m", F.pmod(F.xxhash64("lid"), F.lit(blocks))).repartition(blocks, "m")

    def asks(t: pa.Table) -> pa.Table:
        key = _block(_merged(t), edits, min_chars)[3]
        keys, counts = np.unique(key >> np.uint64(32 - bits), return_counts=True)
        return tally.ask(t.column("m")[0].as_py(), keys, counts, bits)

    def places(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = _merged(t)
        texts, n, line, key, own = _block(t, edits, min_chars)
        short = key >> np.uint64(32 - bits)
        held = tally.unstepped(np.arange(256))[tally.in_order(replies, np.uint8)][np.searchsorted(np.unique(short), short)] if len(key) else np.zeros(0, np.int64)
        many = held > 1
        line, key, own, parts = line[many], key[many].view(np.int64), own[many], -(-held[many] // MEET)
        edges = np.searchsorted(line, np.arange(len(texts) + 1))
        some = np.diff(edges) > 0
        at = np.flatnonzero(some).tolist()
        kept = np.full(len(texts), None, object)
        kept[at] = [texts[k] for k in at]
        cells = np.zeros(len(texts), np.int64)
        for a, b in C.chunks(np.concatenate([[0], np.cumsum(n[at])])):  # numbers of a chunk's code points at once
            cells[at[a:b]] = sketches([texts[k] for k in at[a:b]])
        each = pa.StructArray.from_arrays([pa.array(key), pa.array(own), pa.array(parts.astype(np.int32))], ["key", "own", "parts"])
        keys = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), each, mask=pa.array(~some))
        return pa.table([t.column("lid"), t.column("d"), t.column("no"), t.column("times"), pa.array(n, pa.int64()), pa.array(cells, mask=~some), pa.array(kept, pa.string()), keys], ["lid", "d", "no", "times", "n", "sketch", "text", "keys"])

    replies = tally.answered(dealt.groupBy("m").applyInArrow(asks, tally.ASKED), tally.steps)
    lines = dealt.groupBy("m").cogroup(replies.groupBy("m")).applyInArrow(places, "lid binary, d long, no long, times long, n long, sketch long, text string, keys array<struct<key:long,own:boolean,parts:int>>")
    lines = C.stash(lines, "lines")

    keys = lines.where("keys is not null").select("lid", "n", "sketch", F.inline("keys"))
    # rows of a key that very many lines have meet part by part
    part = F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int")
    x = keys.where("own").select("key", part.alias("part"), F.col("lid").alias("x"), F.col("n").alias("x_n"), F.col("sketch").alias("x_s"))
    y = keys.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lid").alias("y"), F.col("n").alias("y_n"), F.col("sketch").alias("y_s"))
    near = F.bit_count(F.col("x_s").bitwiseXOR(F.col("y_s"))) <= 4 * edits
    pairs = x.join(y, ["key", "part"]).where((F.col("x") != F.col("y")) & (F.col("y_n") - F.col("x_n")).between(0, edits) & near)
    pairs = C.stash(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    text = lambda c: lines.where("text is not null").select(F.col("lid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("d", "no", "text")))
    places = ["a_d", "a_no", "b_d", "b_no"]

    def verify(batches):
        for batch in batches:
            ok = pa.array([within(p, q, edits) for p, q in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b", *places]).filter(ok)

    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", *places, "a_text", "b_text")
    links = C.stash(both.mapInArrow(verify, f"a binary, b binary, {', '.join(f'{c} long' for c in places)}"), "links")
    C.drop(pairs)
    return lines, links


_COUNTS = ["doc_id", "n_lines", "n_exact", "n_near", "n_links", "n_kept"]
_DUPLICATE = {"no": pa.int64(), "kind": pa.string(), "first_doc_id": pa.int64(), "first_no": pa.int64(), "class_id": pa.string()}
_JUDGED = f"{', '.join(f'{c} long' for c in _COUNTS)}, duplicates array<struct<no:long,kind:string,first_doc_id:long,first_no:long,class_id:string>>, text string"


def _judge(t: pa.Table, r: pa.Table) -> pa.Table:
    """Counts, duplicate lines and kept text of each document of a block; r: what is known of lines that stand more than once or have links."""
    fact = {x["lid"]: x for x in r.to_pylist()}
    rows = []
    for part in t.select(["doc_id", "text"]).to_batches(max_chunksize=256):
        texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
        first, docs = _chunk_lines(texts, ids)
        digests = [C.digest(x) for x in first]
        known = [fact.get(x) for x in digests]
        for doc_id, text, own in zip(ids, texts, docs, strict=True):
            here, n_links, gone = _FIRST if doc_id is None else doc_id, 0, []
            for k, no in own:
                f = known[k]
                if f is None:
                    continue
                if (f["d"], f["no"]) < (here, no):
                    kind, place = "exact", (f["d"], f["no"])
                else:
                    n_links += f["links"] or 0
                    if f["before"] is None:
                        continue
                    kind, place = "near", (f["before"]["d"], f["before"]["no"])
                gone.append({"no": no, "kind": kind, "first_doc_id": None if place[0] == _FIRST else place[0], "first_no": place[1], "class_id": (f["class_id"] or digests[k]).hex()})
            kept = text.decode("utf-8", "replace")
            if gone:
                out = {x["no"] for x in gone}
                kept = b"\n".join(x for no, x in enumerate(text.split(b"\n")) if no not in out).decode("utf-8", "replace")
            n_exact = sum(x["kind"] == "exact" for x in gone)
            rows.append((doc_id, len(own), n_exact, len(gone) - n_exact, n_links, len(own) - len(gone), gone, kept))
    C.tidy()
    kinds = [*[pa.int64()] * len(_COUNTS), pa.list_(pa.struct(list(_DUPLICATE.items()))), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_COUNTS, "duplicates", "text"])


def deduplicated(docs: DataFrame, edits: int = 2, min_chars: int = 0) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_links, n_kept, duplicates and the text of the lines kept, of each document.

    Links are counted at a line's first occurrence; duplicates have the numbers of lines, from 0.  Blocks of documents ask
    for what is known of their lines, so texts are moved once for this, and lines that say nothing new are not.
    """
    lines, links = line_dedup(docs, edits, min_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes())
    blocks = max(1, -(-_size(rows) // BLOCK))
    dealt = rows.withColumn("m", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "m")

    def asks(t: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for part in t.select(["text"]).to_batches(max_chunksize=256):
            for text in part.column("text").to_pylist():
                found.update(x.strip() for x in text.split(b"\n"))
        found.discard(b"")
        return pa.table([pa.array([t.column("m")[0].as_py()] * len(found), pa.int64()), pa.array([C.digest(x) for x in found], pa.binary())], ["m", "lid"])

    at = lambda c: F.struct(F.col(f"{c}_d").alias("d"), F.col(f"{c}_no").alias("no"))
    end = lambda c, o: links.select(F.col(c).alias("lid"), at(c).alias("at"), F.when(at(o) < at(c), at(o)).alias("before"))
    near = end("a", "b").union(end("b", "a")).groupBy("lid").agg(F.count("*").alias("links"), F.min("before").alias("before"), F.first("at").alias("at"))
    labels = components(links)
    near = near.join(labels.select(F.col("v").alias("lid"), F.col("label").alias("class_id")), "lid")
    facts = lines.where("times > 1").select("lid", F.struct("d", "no").alias("of")).join(near, "lid", "full")
    facts = facts.withColumn("at", F.coalesce("of", "at")).select("lid", "at.d", "at.no", "links", "before", "class_id")
    known = C.stash(dealt.groupBy("m").applyInArrow(asks, "m long, lid binary").join(facts.hint("shuffle_hash"), "lid"), "known")
    C.drop(lines, links, labels)
    return dealt.groupBy("m").cogroup(known.groupBy("m")).applyInArrow(_judge, _JUDGED)


def duplicates(docs: DataFrame, edits: int = 2, min_chars: int = 0) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_links, n_kept of each document."""
    return deduplicated(docs, edits, min_chars).select(*_COUNTS)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(C.table(spark, sf_dir, "documents"))
