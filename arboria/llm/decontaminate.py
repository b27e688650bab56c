"""Benchmark decontamination by a prefix-filtered set join [operator 7].

An item's windows are its runs of `window` consecutive words (an item of fewer words is one window).  For exact
containment the necessary prefix of a window is one shingle: its rarest.

1. Items become rows of shingles (three words, fewer in shorter windows) and windows.  How often each shingle stands
   in all documents is counted; a window with a shingle that stands nowhere stands nowhere either.
2. Each window left is a row under its rarest shingle.  Documents give a row for each place of such a shingle, with
   the words around it, and the two are joined on the shingle.  A window that would begin before or end after the
   document is passed over (length and positional bounds), the rest is compared with those words, byte by byte.
3. Overlapping occurrences are merged before hit words are counted, all by text: copies of a text are looked through
   once a task, and what is found goes back to each of them by the text's digest of 128 bits.

Documents are read three times (counts, places, result), whatever the size of the benchmark, and the plan is the same
at every size.  The driver holds no items: what is broadcast besides joins that Spark sizes is a table of bits over
shingles (Filter, 32 MB at most; a fuller one lets more rows through to the join and changes no result) and what was
found, where that is small.

Defined results: a null text has no words; items without words have no window; items of one item_id are one
item, and null item_ids are not listed; with no benchmark nothing is hit; repeated documents give a row each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 3
#: Rows of shingles that an item gives at a time.
_ROWS = 1 << 13


def _words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, w = C.spans(low, off, C.ALNUM)
    return C.word_hashes(low, s, e), w


def _bytes_of_words(text: bytes) -> list[bytes]:
    return text.translate(C.ALNUM_TEXT).split()


def _spaced(words: list[bytes]) -> bytes:
    """Words with a blank before each and after the last, so that whole words are compared; no words: a blank."""
    return b" ".join([b"", *words, b""]) if words else b" "


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of the buffer, over the borders of documents too."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 2**64))
    return C.mix64(out)


class Filter:
    """Three bits of one 64-bit number for each key: what it keeps out is not a key, what it lets through may be.

    There is about a number a key, from 2**10 to 2**MOST; the driver gets these, 16 bytes each.
    """

    MOST = 22

    def __init__(self, keys: DataFrame, n: int):
        size = 1 << min(self.MOST, max(10, n.bit_length()))
        bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(gram, {b}) & 63 as int))" for b in (40, 46, 52))
        rows = keys.groupBy(F.expr(f"gram & {size - 1}L").alias("at")).agg(F.bit_or(F.expr(bits)).alias("bits")).toArrow()
        self.bits = np.zeros(size, np.uint64)
        self.bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where in an array of hashes those are that it lets through."""
        found = self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)]
        at = np.flatnonzero(found)
        found, h = found[at], h[at]
        for b in (40, 46, 52):
            on = (found >> ((h >> np.uint64(b)) & np.uint64(63))) & np.uint64(1) == 1
            at, found, h = at[on], found[on], h[on]
        return at


def _batches(column):
    buf, off = C.flat(column)
    for a, b in C.chunks(off):
        low, o = C.lowered(buf[off[a] : off[b]]), off[a : b + 1] - off[a]
        yield low, o, *_words(low, o)


def _within(grams: np.ndarray, k: int, w: np.ndarray, some: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles that the filter lets through and that end in the document they begin in; those documents."""
    at = some.places(grams)
    doc = np.searchsorted(w, at, "right") - 1
    inside = at + k <= w[doc + 1] if len(at) else at > 0
    return at[inside], doc[inside]


_SHINGLES = "item_id string, text binary, place long, n int, k int, gram long, win binary"


def _shingles(items: DataFrame, window: int) -> DataFrame:
    """A row for each shingle of an item, with the window that begins there, if one does; text: its digest."""
    schema = C.StructType.fromDDL(_SHINGLES)

    def run(batches):
        rows = []

        def batch():
            return pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.string()), ("text", pa.binary()), ("place", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("gram", pa.int64()), ("win", pa.binary())]))

        for b in batches:
            for name, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = _bytes_of_words(text)
                joined = b" ".join(own)
                words, _ = _words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
                n = min(window, len(own))
                k, digest = min(SHINGLE, n), C.digest(text)
                for i, g in enumerate(_grams(words, k).view(np.int64).tolist() if n else []):
                    win = _spaced(own[i : i + n]) if i + n <= len(own) else None
                    rows.append({"item_id": name, "text": digest, "place": i, "n": n, "k": k, "gram": g, "win": win})
                    if len(rows) == _ROWS:
                        yield batch()
                        rows.clear()
        yield batch()

    return items.distinct().mapInArrow(run, schema)


def _counted(docs: DataFrame, some: Filter, ks: list[int]) -> DataFrame:
    """gram, c: how often the shingles that the filter lets through stand in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        for batch in batches:
            for _, _, words, w in _batches(batch.column("text")):
                for k in ks:
                    grams = _grams(words, k)
                    at, _ = _within(grams, k, w, shared.value)
                    key, n = np.unique(grams[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "c"])
        C.tidy()

    return docs.select(C.text_bytes()).mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _windows(shingles: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """win, item_id, n, k, gram (the rarest shingle), shift (its place in the window); a row a window and item."""
    ahead = Window.partitionBy("item_id", "text").orderBy("place").rowsBetween(0, max(0, window - SHINGLE))
    rows = shingles.join(counts, "gram", "left").withColumn("rare", F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram", "place")).over(ahead))
    found = rows.where("win is not null and rare.c > 0")
    return found.select("win", "item_id", "n", "k", "rare.gram", (F.col("rare.place") - F.col("place")).cast("int").alias("shift")).distinct()


_PLACES = "text binary, gram long, lefts int, rights int, before binary, after binary, places array<long>"


def _places(docs: DataFrame, some: Filter, most: dict[int, int]) -> DataFrame:
    """A row for each text, shingle let through and words around it; most: the longest window by its shingle's words."""
    shared = docs.sparkSession.sparkContext.broadcast(some)
    names = C.StructType.fromDDL(_PLACES).names

    def run(batches):
        seen = set()  # digests of this task's texts with places: copies are looked through once
        for batch in batches:
            for low, o, words, w in _batches(batch.column("text")):
                found = defaultdict(list)
                for k in most:
                    grams = _grams(words, k)
                    for p, d in zip(*(x.tolist() for x in _within(grams, k, w, shared.value)), strict=True):
                        found[d].append((p - int(w[d]), k, int(grams[p].view(np.int64))))
                for d, at in found.items():
                    text = low[o[d] : o[d + 1]].tobytes()
                    own, key = text.translate(C.ALNUM_TEXT).split(), C.digest(text)
                    if key in seen:
                        continue
                    seen.add(key)
                    for a in range(0, len(at), _ROWS):
                        rows = defaultdict(list)
                        for p, k, g in at[a : a + _ROWS]:
                            left, right = own[max(0, p - most[k] + k) : p], own[p : p + most[k]]
                            rows[g, len(left), len(right), _spaced(left), b" ".join([*right, b""])].append(p)
                        columns = [[key] * len(rows), *zip(*rows, strict=True), list(rows.values())]
                        types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        C.tidy()

    return docs.select(C.text_bytes()).mapInArrow(run, _PLACES)


def _occurrences(places: DataFrame, windows: DataFrame) -> DataFrame:
    """text, win, n, shift, places (of the shingle): where windows stand, by their words' bytes."""
    left = F.expr("concat(cast(substring_index(cast(win as string), ' ', shift + 1) as binary), cast(' ' as binary))")
    some = windows.select("win", "n", "gram", "shift", left.alias("left"))
    some = some.withColumn("right", F.expr("substring(win, octet_length(left) + 1)"))
    bounds = (F.col("lefts") >= F.col("shift")) & (F.col("rights") >= F.col("n") - F.col("shift"))
    words = F.endswith("before", "left") & F.startswith("after", "right")
    return places.join(some.distinct(), (places.gram == some.gram) & bounds & words).select("text", "win", "n", "shift", "places")


def _found(occurrences: DataFrame, windows: DataFrame) -> DataFrame:
    """text, n_hit, n_items, items_sha256 of the texts with occurrences."""
    spans = occurrences.select("text", "n", "shift", F.explode("places").alias("p")).select("text", (F.col("p") - F.col("shift")).alias("a"), (F.col("p") - F.col("shift") + F.col("n")).alias("b"))
    spans = spans.groupBy("text", "a").agg(F.max("b").alias("b"))
    before = Window.partitionBy("text").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("fresh", F.greatest("a", F.max("b").over(before)))  # greatest() passes nulls over
    hits = spans.groupBy("text").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("fresh"))).alias("n_hit"))
    members = windows.select("win", "item_id").where(F.col("item_id").isNotNull()).distinct()
    items = occurrences.select("text", "win").distinct().join(members, "win").groupBy("text").agg(F.collect_set("item_id").alias("items"))
    items = items.select("text", F.size("items").cast("long").alias("n_items"), _sha(F.array_sort("items")).alias("items_sha256"))
    return hits.join(items, "text", "left")


def _sha(items):
    return F.sha2(F.array_join(items, ","), 256)


def _measured(texts: pa.Array) -> list[pa.Array]:
    """n_words, and the digest that _places() has."""
    n, keys = np.zeros(len(texts), np.int64), []
    buf, off = C.flat(texts)
    for a, b in C.chunks(off):
        low, o = C.lowered(buf[off[a] : off[b]]), off[a : b + 1] - off[a]
        n[a:b] = np.diff(C.spans(low, o, C.ALNUM)[2])
        keys += [C.digest(low[x:y].tobytes()) for x, y in zip(o.tolist(), o[1:].tolist(), strict=False)]
    return [pa.array(n), pa.array(keys, pa.binary())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, carry=("doc_id",)) -> DataFrame:
    """row (a struct of the carried columns), n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    spark = docs.sparkSession
    C.short_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), C.text_bytes()).where("octet_length(text) > 0")
    shingles = C.stash(_shingles(items, window), "shingles")
    ks = sorted(r.k for r in shingles.select("k").distinct().collect())
    counts = _counted(docs, Filter(shingles, shingles.count()), ks)
    windows = C.stash(_windows(shingles, counts, window), "windows")
    most = {r.k: r.n for r in windows.groupBy("k").agg(F.max("n").alias("n")).collect()}
    places = _places(docs, Filter(windows, windows.count()), most)
    occurrences = C.stash(_occurrences(places, windows), "occurrences")
    found = C.stash(_found(occurrences, windows), "found")
    C.drop(shingles, windows, occurrences)
    measured = C.per_text(_measured, "n_words long, text binary")
    rows = docs.select(F.struct(*carry).alias("row"), measured(C.text_bytes()).alias("m")).select("row", "m.*")
    out = rows.join(C.small(found, 250), "text", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), _sha(F.array().cast("array<string>"))
    bad = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    return out.select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), bad.alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), dw AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), occ AS (SELECT rid, i, win.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM occ) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.rid = hit.rid LEFT JOIN its ON d.rid = its.rid
"""
