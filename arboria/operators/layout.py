"""Radial layout: children on circles around their parents, offsets added up along the path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp


def symbol_radius(count: Column) -> Column:
    return clamp(F.lit(0.006) + count * F.lit(0.0018), 0.018, 0.052)


def zoom_threshold(node_type: Column, depth: Column) -> Column:
    return F.when(node_type == "project", 0.45).when(node_type == "directory", 2.0 + 1.5 * depth).when(node_type == "file", 7.0 + 1.5 * depth).when(node_type == "symbol", 14.0 + 1.5 * depth).otherwise(20.0)


def offsets(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, node_type, sort_key, parent_is_root) with the offset dx, dy from the parent."""
    ring = Window.partitionBy("parent_id", "node_type")
    at = F.row_number().over(ring.orderBy("sort_key", "id")) - 1
    n = F.count("*").over(ring)
    radius = F.when(F.col("node_type") == "directory", F.when(F.col("parent_is_root"), 0.18).otherwise(0.07)).when(F.col("node_type") == "file", F.when(F.col("parent_is_root"), 0.095).otherwise(0.045)).otherwise(symbol_radius(n))
    start = F.lit(-math.pi / 2) + F.when(F.col("node_type") == "file", F.lit(math.pi) / F.greatest(F.lit(2), n)).otherwise(0.0)
    angle = start + F.lit(2 * math.pi) * at / n
    root = F.col("parent_id").isNull()
    return nodes.withColumns({"dx": F.when(root, 0.0).otherwise(F.cos(angle) * radius), "dy": F.when(root, 0.0).otherwise(F.sin(angle) * radius)})


def placed(nodes: DataFrame) -> DataFrame:
    """x, y: the offsets of all nodes on the path (array `path_ids`, root first), added up and clamped level by level."""
    own = offsets(nodes)
    steps = nodes.select("id", F.posexplode("path_ids").alias("level", "step")).join(own.select(F.col("id").alias("step"), "dx", "dy"), "step")
    path = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "dx", "dy"))).alias("path"))
    total = lambda c: F.aggregate("path", F.lit(0.0), lambda acc, s: clamp(acc + s[c], -1.0, 1.0))
    return nodes.join(path.select("id", total("dx").alias("x"), total("dy").alias("y")), "id")


def largest_gap(siblings: DataFrame, group: str, angle: str = "angle") -> DataFrame:
    """Middle of the largest gap between the angles of each group; the first of equal ones."""
    w = Window.partitionBy(group).orderBy(angle)
    whole = Window.partitionBy(group)
    following = F.coalesce(F.lead(angle).over(w), F.first(angle).over(w) + F.lit(2 * math.pi))
    rows = siblings.withColumns({"gap": following - F.col(angle), "n": F.count("*").over(whole), "k": F.row_number().over(w)})
    best = rows.groupBy(group).agg(F.max(F.struct("gap", (-F.col("k")).alias("k"), F.col(angle).alias("a"), "n")).alias("b"))
    middle = F.when(F.col("b.n") == 1, F.col("b.a") + math.pi).otherwise(F.col("b.a") + F.col("b.gap") / 2)
    wrapped = F.pmod(middle + math.pi, F.lit(2 * math.pi)) - math.pi
    return best.select(group, F.col("b.gap").alias("gap"), wrapped.alias("theta"))


def inserted(rings: DataFrame, wanted: DataFrame, group: str, angle: str = "angle") -> DataFrame:
    """group, nth, theta: the angles of the nodes that are put into each ring one after another, siblings staying in place.

    rings: group, angle of the siblings there are.  wanted: group, k.  Each node halves the largest gap that there is then,
    of equal ones that of the smallest angle; the first node of an empty ring goes to the top.  A gap's halves are shorter
    than it, so the first k nodes halve the k largest of all gaps, halves of gaps, quarters, ...; the largest gap is never
    below a whole turn by the number of siblings, which bounds how far a gap need be cut up: a ring has no more than twice
    as many candidates as siblings in the end, and no node waits for another.
    """
    whole, turn = Window.partitionBy("ring"), F.lit(2 * math.pi)
    w = whole.orderBy("a")
    there = rings.select(F.col(group).alias("ring"), F.col(angle).alias("a")).where("a is not null")
    asked = wanted.select(F.col(group).alias("ring"), "k").where("k > 0")
    real = there.join(asked, "ring")
    gap = F.coalesce(F.lead("a").over(w), F.min("a").over(whole) + turn) - F.col("a")
    gaps = real.select("ring", "k", "a", gap.alias("g"), F.count("*").over(whole).alias("n"), F.lit(0).alias("before"))
    bare = asked.join(there.select("ring").distinct(), "ring", "left_anti")
    top = bare.select("ring", F.lit(1).alias("nth"), F.lit(-math.pi / 2).alias("theta"))
    gaps = gaps.unionByName(bare.where("k > 1").select("ring", (F.col("k") - 1).alias("k"), F.lit(-math.pi / 2).alias("a"), turn.alias("g"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("before")))
    least = turn / (F.col("n") + F.col("k")) * (1 - 1e-9)
    levels = F.when(F.col("g") >= least, F.floor(F.log2(F.col("g") / least)).cast("int")).otherwise(-1)
    cut = gaps.where(F.col("g") >= least).withColumn("level", F.explode(F.sequence(F.lit(0), levels)))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, level)") - 1))).withColumn("length", F.col("g") / F.expr("shiftleft(1L, level)"))
    wrapped = lambda x: F.pmod(x + math.pi, turn) - math.pi
    starts = F.col("a") + F.col("part") * F.col("length")
    first = whole.orderBy(F.col("length").desc(), wrapped(starts))
    nth = cut.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= F.col("k"))
    return nth.select(F.col("ring").alias(group), (F.col("_n") + F.col("before")).alias("nth"), wrapped(F.col("a") + (F.col("part") + 0.5) * F.col("length")).alias("theta")).unionByName(top.withColumnRenamed("ring", group))
