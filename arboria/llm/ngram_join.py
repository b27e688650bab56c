"""Jaccard similarity join on word n-grams, rare first [operator 5].

A document's set is its distinct k-word shingles as 64-bit hashes.  Documents of equal sets are one class, and
classes A, B link when 100 |A & B| >= percent |A | B|.

1. Blocks of documents learn, through `tally`, in how many documents each of their shingles stands.  Shingles
   are ordered by that count, then hash: rare first.  A partner shares one of the first n - ceil(t n) + 1, and a
   shingle that stands in one document has no partner, so only shared shingles of the prefix are looked at.
2. Prefix shingles join, under the length filter, the positional filter (what of the shared shingles can still
   be in both before and after this place), the suffix filter (the shared shingles after it, counted in eight
   ranges of the hash) and a parity sketch of all shared shingles, whose differing bits bound the difference.
   First each class meets only the leader of its band of sizes in each shingle's group, the class whose shingles
   stand in most documents, which merges groups of copies; then classes of *different* components meet, in cells
   of MEET by MEET rows where a group is larger.  So a group of n copies gives about n pairs, not n * n.
3. Each pair is verified once, on the shared shingles of both.  Components come from contraction.

Every link either is found or runs inside a component, so components are those of all links.

Defined results: null or wordless text has an empty set, n_shingles 0, and is its own component; a document of
fewer than k words has one shingle of them all; repeated rows give a row each; null doc_ids join as members, and
component_id is the smallest doc_id that isn't null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tally
from .components import components

BLOCK = 6 << 20  # characters of text in a block
SUFFIX_RANGES = 8
SKETCH = 4  # longs of the parity sketch
_BITS = [f"p{k}" for k in range(SKETCH)]
_PREFIX = "tok:long,pos:int,suf:long"
_SIDE = ["node", "n", "s", *_BITS]
_DOC = "doc_id long, h long, n_shingles long, node long, typical int, prefix array<struct<" + _PREFIX + ">>, sketch array<long>, shared array<long>"


def _sets(t: pa.Table, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    buf, off = C.flat(t.column("text"))
    out = []
    for a, b in C.chunks(off):
        low = C.lowered(buf[off[a] : off[b]])
        s, e, w = C.spans(low, off[a : b + 1] - off[a], C.NOT_SPACE)
        h, o = C.shingle_hashes(C.word_hashes(low, s, e), w, k)
        out += [np.unique(h[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
    return out


def _keys(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)) >> np.uint64(32 - bits)


def prefix_length(n: int, percent: int) -> int:
    """Of a set of n: shingles of which a partner must share one."""
    return n - -(-n * percent // 100) + 1


def _sketch(shared: np.ndarray) -> list[int]:
    """For each of 256 cells whether an odd number of the hashes falls in it."""
    odd = np.bincount(((shared >> np.uint64(20)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def _describe(sets, counts: np.ndarray, offsets: np.ndarray, percent: int):
    """node, typical, prefix, sketch and shared of each document; counts: of its shingles' documents, as tally.steps has them."""
    for i, h in enumerate(sets):
        n = len(h)
        if not n:
            yield (None,) * 5
            continue
        node = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)
        q = counts[offsets[i] : offsets[i + 1]]
        alone, p = int((q == 1).sum()), prefix_length(n, percent)
        if alone >= p:
            yield node, None, None, None, None
            continue
        shared, q = h[q > 1], q[q > 1]
        order = np.lexsort((shared, q))
        in_order = shared[order]
        bins = (in_order >> np.uint64(61)).astype(np.int64)
        left = np.zeros((len(bins) + 1, SUFFIX_RANGES), np.int64)
        np.cumsum(np.eye(SUFFIX_RANGES, dtype=np.int64)[bins], axis=0, out=left[1:])
        take = min(p - alone, len(shared))
        after = np.minimum(left[-1] - left[1 : take + 1], 127)
        packed = (after << (8 * np.arange(SUFFIX_RANGES))).sum(axis=1)
        prefix = [{"tok": t, "pos": j, "suf": s} for j, (t, s) in enumerate(zip(in_order[:take].view(np.int64).tolist(), packed.tolist(), strict=True))]
        yield node, int(1000 * int(q.astype(np.int64).sum()) // n), prefix, _sketch(shared), shared.view(np.int64)


def _signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each document, with its class and, where it may have partners, prefix and shared shingles."""
    C.short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes())
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    bits = tally.bucket_bits(size // 5)
    dealt = rows.withColumns({"h": F.xxhash64("text"), "m": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))}).repartition(blocks, "m")

    def asks(t: pa.Table) -> pa.Table:
        keys, many = np.unique(_keys(_sets(t, k), bits), return_counts=True)
        C.tidy()
        return tally.ask(t.column("m")[0].as_py(), keys, many, bits)

    def signs(t: pa.Table, replies: pa.Table) -> pa.Table:
        sets = _sets(t, k)
        every = _keys(sets, bits)
        counts = tally.in_order(replies, np.uint8)[np.searchsorted(np.unique(every), every)] if len(every) else np.zeros(0, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        longs, places = pa.list_(pa.int64()), pa.list_(pa.struct([("tok", pa.int64()), ("pos", pa.int32()), ("suf", pa.int64())]))
        kinds = {"node": pa.int64(), "typical": pa.int32(), "prefix": places, "sketch": longs, "shared": longs}
        found = list(zip(*_describe(sets, counts, offsets, percent), strict=True)) or [()] * len(kinds)
        columns = [pa.array(c, kind) for c, kind in zip(found, kinds.values(), strict=True)]
        del sets, every, counts, found
        C.tidy()
        return pa.table([t.column("doc_id"), t.column("h"), pa.array(np.diff(offsets)), *columns], ["doc_id", "h", "n_shingles", *kinds])

    replies = tally.answered(dealt.groupBy("m").applyInArrow(asks, tally.ASKED), tally.steps)
    return C.stash(dealt.groupBy("m").cogroup(replies.groupBy("m")).applyInArrow(signs, _DOC), "signed")


def _may_link(percent: int):
    """The length, positional, suffix and sketch filters on rows x, y of one prefix shingle."""
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    need = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / F.lit(100 + percent))
    before = F.least("x_pos", "y_pos") + 1
    rest = F.least(F.col("x_s") - F.col("x_pos"), F.col("y_s") - F.col("y_pos")) - 1
    byte = lambda c, j: F.shiftright(F.col(c), 8 * j).bitwiseAND(F.lit(127))
    both = [F.when(F.least(byte("x_suf", j), byte("y_suf", j)) == 127, F.lit(1 << 30)).otherwise(F.least(byte("x_suf", j), byte("y_suf", j))) for j in range(SUFFIX_RANGES)]
    suffix = sum(both[1:], both[0])
    differ = [F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _BITS]
    sketch = F.col("x_s") + F.col("y_s") - sum(differ[1:], differ[0])
    return (small * 100 >= large * percent) & (before + rest >= need) & (before + suffix >= need) & (sketch >= 2 * need)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs a < b those that link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("shared").alias(f"{c}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("a_s", "b_s")))
    return both.where(F.col("i") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("i")) * percent).select("a", "b")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h (xxhash64 of the text's bytes), n_shingles, component_id and label, the component, of each document.

    label is null for a document without words, which is linked with nothing.
    """
    wide = _signed(docs, k, percent)
    keep = ["typical", "prefix", "sketch", "shared"]
    nodes = C.stash(wide.where("prefix is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in keep]), "nodes")
    signed = C.stash(wide.select("doc_id", "h", "n_shingles", "node"), "classed")
    C.drop(wide)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.12))).cast("int")
    bits = [F.col("sketch")[k].alias(p) for k, p in enumerate(_BITS)]
    tokens = nodes.select("node", F.col("n").cast("int").alias("n"), F.size("shared").alias("s"), "typical", *bits, band.alias("band"), F.inline("prefix"))
    group = tokens.groupBy("tok").agg(F.count("*").alias("c"))
    tokens = C.stash(tokens.join(group.where("c > 1").select("tok"), "tok", "left_semi"), "tokens")

    def side(rows: DataFrame, x: str, *others) -> DataFrame:
        return rows.select("tok", *others, *[F.col(c).alias(f"{x}_{c}") for c in (*_SIDE, "pos", "suf")])

    first = ["typical", "node", *(c for c in (*_SIDE, "pos", "suf") if c != "node")]
    leaders = tokens.groupBy("tok", "band").agg(F.max(F.struct(*first)).alias("y"), F.count("*").alias("c")).where("c > 1")
    leaders = C.stash(side(leaders.select("tok", "band", "y.*"), "y", "band"), "leaders")
    tried = side(tokens, "x", "band").join(leaders, ["tok", "band"]).where("x_node <> y_node").where(_may_link(percent))
    tried = C.stash(tried.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "pairs")
    links = C.stash(_verified(tried, nodes, percent), "links")

    merged = components(links)
    placed = tokens.join(merged.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = C.stash(placed, "placed")
    open_ = C.stash(_open(placed), "open")
    some = C.stash(_meetings(placed, open_), "meetings")
    C.drop(tokens, leaders, placed, open_)
    x, y = (side(some.where(which), c, "cell", F.col("label").alias(f"{c}_label"), F.col("part").alias(f"{c}_part")) for c, which in (("x", "ours"), ("y", "theirs")))
    more = x.join(y, ["tok", "cell"]).where("(x_part <> y_part or x_node < y_node) and x_label <> y_label").where(_may_link(percent))
    more = C.stash(more.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "pairs")
    fresh = C.stash(_verified(more.join(tried, ["a", "b"], "left_anti"), nodes, percent), "links")
    labels = merged
    if not fresh.isEmpty():
        labels = components(links.select("a", "b").unionByName(fresh))
        C.drop(merged)
    C.drop(nodes, some, tried, links, more, fresh)

    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = C.stash(classes, "classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of = C.stash(classes.join(least, "label").select("node", "label", "component_id"), "classes")
    C.drop(labels, classes)
    return signed.join(of, "node", "left").select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")


#: Rows of a shingle that meet in one task; the rows of a larger group are cut into so many for either side.
MEET = 1000


def _open(placed: DataFrame) -> DataFrame:
    """Shingles whose group still holds different components, and into how many parts its rows are cut."""
    open_ = placed.groupBy("tok").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("c"))
    return open_.where("l < h").select("tok", F.ceil(F.col("c") / MEET).cast("int").alias("parts"))


def _meetings(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of open groups in the cells in which they meet: the rows of `part` there are the one side, the others the other.

    A group of one part has one cell.  Of a larger group any two parts have a cell, and each part has one of its own,
    so that no cell has more than about MEET times MEET pairs and no pair is in two.
    """
    rows = placed.join(open_, "tok").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long"))
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct((F.least(F.col("part"), o) * F.col("parts") + F.greatest(F.col("part"), o)).alias("cell"), (F.col("part") <= o).alias("ours"), (F.col("part") >= o).alias("theirs")))
    return rows.select(*placed.columns, "part", F.inline(each))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (null first), of equal ones the smallest text hash.

    Rows alike in doc_id and text are one document; documents without words all stay.
    """
    found = C.stash(ngram_join(docs, k, percent).select("doc_id", "h", "label").where("label is not null"), "found")
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    gone = found.join(first, "label").where(~F.struct("doc_id", "h").eqNullSafe(F.col("first")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(C.text_bytes()).alias("h"))
    # texts are moved only where the keys of those that go are too many for a broadcast
    kept = packed.join(C.small(C.stash(gone, "gone"), 32), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    if not found.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "h"])
    C.drop(found)
    return kept.select("row.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), sets AS (
  SELECT rid, count(*) AS n, list(g ORDER BY g) AS gs FROM s GROUP BY rid
), node AS (
  SELECT rid, n, min(rid) OVER (PARTITION BY gs) AS node FROM sets
), t AS (
  SELECT node, n, g FROM s JOIN node ON node.rid = s.rid AND node.node = s.rid
), link AS (
  SELECT a.node AS a, b.node AS b FROM t AS a JOIN t AS b ON a.g = b.g AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ends AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(node, other) AS (
  SELECT DISTINCT node, node FROM node UNION SELECT reach.node, ends.b FROM reach JOIN ends ON ends.a = reach.other
), least AS (
  SELECT reach.node, min(doc_id) AS component_id FROM reach JOIN node ON node.node = reach.other JOIN d ON d.rid = node.rid GROUP BY reach.node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN node ON node.rid = d.rid LEFT JOIN least ON least.node = node.node
"""
