"""Mixing sources to target weights by capped water-filling [operator 9].

Sources share the words of all documents by weight.  No source may be read more than `epochs` times: one that
would be is clamped there and its excess goes to the others by weight, again until nothing is above.  A source's
target then is so many whole repetitions of its documents and a fraction of one more; the fraction is drawn in
the order of a seeded hash of doc_id, up to the very document with which the target is reached, of which only
the words still missing are taken (`mix`).  Where no document may be cut (`mix_whole`), of the `around` documents before
the stop and as many from there on those are taken whose sizes add up nearest to what is missing.

Only sums over sources reach the driver, and no task needs all sources.  A source's place in the hash order where
drawing stops is found in steps of 256: from as many sums a source, from as many of the bin that holds the stop, and
then among the documents of the last such bin.

Defined results: null text has size 0 and takes nothing; the null source comes last and is one source; rows of
one doc_id in one source share a place in the order, and at the stop share what is left by size; an empty table
gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)


def n_words(column: str = "text"):
    """Number of `[^\\x20\\x09-\\x0D]+`."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.size(words).cast("long")


def draw(seed: str):
    """A document's place in the order of drawing: 52 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def water_filling(sources: DataFrame, epochs: int) -> DataFrame:
    """target for each source (source_size, weight), from sums over sources alone."""
    cap = F.col("source_size") * epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight, clamped = int(total or 0), int(weight or 0), -1
    left, free = total, weight
    while True:
        over = cap * F.lit(free) <= F.lit(left) * F.col("weight")  # at or above its share: clamped
        n, caps, heavy = sources.where(over).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == clamped or weight - int(heavy or 0) <= 0:
            break
        clamped, left, free = n, total - int(caps or 0), weight - int(heavy or 0)
    share = F.lit(left) * F.col("weight") / F.lit(max(free, 1))
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(share.cast("double")))


def _drawn(sized: DataFrame, seed: str) -> DataFrame:
    return sized.where("size > 0").select("source", "doc_id", "size", draw(seed).alias("u"))


def _stops(sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Where drawing a source's fraction stops: place u_stop, doc_id id_stop, words rest still to take there of `held`."""
    left = C.stash(_drawn(sized, seed), "drawn")
    at, steps = plan.select(F.col("source").alias("src"), F.lit(0).cast("long").alias("at"), "part"), []
    for shift in (44, 36):  # of 52 bits
        same = F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("u", shift + 8) == F.col("at"))
        sums = left.join(at, same).groupBy("src", "part", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("s"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("src").orderBy("bin")))
        at = C.stash(sums.where("upto - s <= part and part < upto").select("src", F.col("bin").alias("at"), (F.col("part") - F.col("upto") + F.col("s")).alias("part")), "bins")
        steps.append(at)
    inside = left.join(at, F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("u", 36) == F.col("at"))).groupBy("src", "u", "doc_id", "part").agg(F.sum("size").alias("held"))
    run = F.sum("held").over(Window.partitionBy("src").orderBy("u", F.col("doc_id").asc_nulls_first()))
    inside = inside.withColumn("run", run).where("run - held <= part and part < run")
    stops = C.stash(inside.select("src", F.col("u").alias("u_stop"), F.col("doc_id").alias("id_stop"), (F.col("part") - F.col("run") + F.col("held")).alias("rest"), "held"), "stops")
    C.drop(left, *steps)
    return stops


def _earlier():
    """Whether a document stands before the one where its source's drawing stops."""
    number = lambda c: F.coalesce(c, F.lit(-(2**63)))
    return F.coalesce((F.col("u") < F.col("u_stop")) | ((F.col("u") == F.col("u_stop")) & (number("doc_id") < number("id_stop"))), F.lit(False))


def _planned(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: str, carry) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, source, size, u), sizes alone, and a row a source: src, source_size, target, whole, stop."""
    narrow = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    narrow_only = [str(c) for c in carry] == ["doc_id"]
    sized = C.stash(narrow if narrow_only else narrow.drop("row"), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = C.running(sources.withColumn("one", F.lit(1).cast("long")), F.col("source").asc_nulls_last(), "one")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    plan = water_filling(C.stash(ranked.select("source", "source_size", weight.alias("weight")), "sources"), epochs)
    goal = F.floor("target")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    plan = C.stash(plan.withColumn("part", (goal - F.col("whole") * F.col("source_size")).cast("long")), "plan")
    C.drop(ranked)
    stops = _stops(sized, plan, seed)
    plan = plan.join(stops, plan["source"].eqNullSafe(stops["src"]), "left").drop("src")
    return (sized if narrow_only else narrow).withColumn("u", draw(seed)), sized, C.stash(plan.withColumnRenamed("source", "src"), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: str = "mix-1", carry=("doc_id",)) -> DataFrame:
    """row (a struct of the carried columns), size, source_size, target, taken of each document."""
    rows, _, plan = _planned(docs, weights, epochs, seed, carry)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["src"]))
    here = (F.col("u") == F.col("u_stop")) & F.col("doc_id").eqNullSafe(F.col("id_stop"))
    extra = F.when(here, F.floor(F.col("size") * F.col("rest") / F.col("held"))).when(_earlier(), F.col("size")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("size") * F.col("whole") + extra).otherwise(0).cast("long")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"))


def nearest_subset(sizes: list[int], goal: int) -> list[int]:
    """Numbers of the items whose sizes add up nearest to the goal; of two such sums the smaller."""
    sums, steps, most = 1, [], (1 << (goal + max(sizes, default=0) + 1)) - 1  # bit k: k is a sum of some items
    for n in sizes:
        steps.append(sums)
        sums |= (sums << n) & most
    below = (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = sums >> (goal + 1)
    above = goal + (above & -above).bit_length() if above else None
    left, out = below if above is None or goal - below <= above - goal else above, []
    for i in range(len(sizes) - 1, -1, -1):
        if not steps[i] >> left & 1:  # not without this one
            out.append(i)
            left -= sizes[i]
    return out[::-1]


_AROUND = "src string, picks array<struct<u:long,id:long>>, u_first long, id_first long"


def _picked(t: pa.Table) -> pa.Table:
    """Of the documents around a source's stop those that its mix takes, and the first of them all."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["u"], -(2**63) if r["doc_id"] is None else r["doc_id"]))
    goal = rows[0]["rest"] + sum(r["held"] for r in rows if r["before"])
    picks = [{"u": rows[i]["u"], "id": rows[i]["doc_id"]} for i in nearest_subset([r["held"] for r in rows], goal)]
    kind = pa.list_(pa.struct([("u", pa.int64()), ("id", pa.int64())]))
    return pa.table([pa.array([rows[0]["src"]], pa.string()), pa.array([picks], kind), pa.array([rows[0]["u"]], pa.int64()), pa.array([rows[0]["doc_id"]], pa.int64())], ["src", "picks", "u_first", "id_first"])


def mix_whole(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: str = "mix-1", carry=("doc_id",), around: int = 16) -> DataFrame:
    """row, and copies: how often the mix takes each document, of which none is cut.

    A document that shares its doc_id with others of its source is taken with them.
    """
    rows, sized, plan = _planned(docs, weights, epochs, seed, carry)
    left = _drawn(sized, seed).join(plan.where("rest > 0").select("src", "u_stop", "id_stop", "rest"), F.col("source").eqNullSafe(F.col("src")))
    held = left.groupBy("src", "rest", "u", "doc_id", _earlier().alias("before")).agg(F.sum("size").alias("held"))
    near = []
    for before, order in ((True, [F.desc("u"), F.col("doc_id").desc_nulls_last()]), (False, [F.asc("u"), F.col("doc_id").asc_nulls_first()])):
        n = F.row_number().over(Window.partitionBy("src").orderBy(*order))
        near.append(held.where(F.col("before") == before).withColumn("n", n).where(F.col("n") <= around).drop("n"))
    picked = near[0].union(near[1]).groupBy("src").applyInArrow(_picked, _AROUND).withColumnRenamed("src", "src_")
    plan = C.stash(plan.join(picked, F.col("src").eqNullSafe(F.col("src_")), "left").drop("src_"), "plan")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["src"])).where("size > 0")
    number = lambda c: F.coalesce(c, F.lit(-(2**63)))
    first = (F.col("u") < F.col("u_first")) | ((F.col("u") == F.col("u_first")) & (number("doc_id") < number("id_first")))
    among = (F.col("u") >= F.col("u_first")) & F.exists("picks", lambda x: (x["u"] == F.col("u")) & x["id"].eqNullSafe(F.col("doc_id")))
    part = F.when(F.col("picks").isNull(), _earlier()).otherwise(first | among)
    return out.select("row", (F.col("whole") + F.coalesce(part, F.lit(False)).cast("long")).cast("int").alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s
), p AS (
  SELECT k, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER before_, 0) AS left_, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before_, 0) AS free,
         cap, weight FROM r WINDOW before_ AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT k AS from_, left_::BIGINT AS left_, free::BIGINT AS free FROM p WHERE cap * free > left_ * weight ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN k < from_ THEN cap::DOUBLE ELSE ((left_ * weight)::BIGINT)::DOUBLE / free::DOUBLE END AS target FROM r, f
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.*, source_size, target, whole, floor(target)::BIGINT - whole * source_size AS part,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, part - (run - size))))::BIGINT AS taken FROM o
"""
