"""Names in their innermost spans: an interval stab join without pairs of names and spans.

Spans (definitions) are few, names are many.  Each span is cut into dyadic intervals, of which one in each hold only the
innermost span is kept; the places where spans begin or end look their dyadic intervals up, which says what is innermost
from each such place to the next.  The names at a place then take the last such place before it, in one pass in order.
Spans may nest, touch, be equal or cross: the one that began last counts, of equal starts the shorter, of equal spans the
one of greater id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dyadic(start: Column, stop: Column, levels: int) -> Column:
    """The dyadic intervals (level, no) that make up [start, stop): two a level at most."""
    zero = F.struct(start.cast("long").alias("l"), stop.cast("long").alias("r"), F.array().cast("array<struct<level:int,no:long>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        l, r = acc["l"], acc["r"]  # noqa: E741
        take_l, take_r = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
        at = lambda no: F.array(F.struct(level.cast("int").alias("level"), no.alias("no")))
        none = F.array().cast("array<struct<level:int,no:long>>")
        out = F.concat(acc["out"], F.when(take_l, at(l)).otherwise(none), F.when(take_r, at(r - 1)).otherwise(none))
        return F.struct(F.shiftright(F.when(take_l, l + 1).otherwise(l), 1).alias("l"), F.shiftright(F.when(take_r, r - 1).otherwise(r), 1).alias("r"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), zero, step, lambda acc: acc["out"])


def innermost(spans: DataFrame, levels: int | None = None) -> DataFrame:
    """rel, at, top (start, id, name): what span is innermost from a place on; null: none.

    spans: rel, id, name, start, stop (exclusive), numbers from 0 on; empty spans hold nothing.  levels: bits of the largest
    stop and one more; looked up where not given.
    """
    real = spans.where("start < stop")
    if levels is None:
        levels = max(1, int(real.agg(F.max("stop")).first()[0] or 0).bit_length() + 1)
    top = F.struct("start", (-F.col("stop")).alias("shut"), "id", "name")
    held = real.select("rel", F.explode(_dyadic(F.col("start"), F.col("stop"), levels)).alias("p"), top.alias("top"))
    held = held.groupBy("rel", "p.level", "p.no").agg(F.max("top").alias("top"))
    places = real.select("rel", F.explode(F.array(F.col("start").cast("long"), F.col("stop").cast("long"))).alias("at")).distinct()
    asked = places.select("rel", "at", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    asked = asked.withColumn("no", F.expr("shiftright(at, level)"))
    found = asked.join(held, ["rel", "level", "no"]).groupBy("rel", "at").agg(F.max("top").alias("top"))
    return places.join(found, ["rel", "at"], "left")


def _stabbed(spans: DataFrame, names: DataFrame, levels: int | None) -> DataFrame:
    """names (rel, at, names: those at that place) with `top`, the innermost span there; and a row with `own` for each span."""
    place = innermost(spans, levels)
    none = lambda kind: F.lit(None).cast(kind)
    marks = place.select("rel", "at", F.lit(0).alias("kind"), none("array<string>").alias("names"), F.struct("top").alias("mark"))
    mark, own = marks.schema["mark"].dataType, F.struct("id", "name", "start", "stop")
    marks = marks.withColumn("own", none(spans.select(own.alias("own")).schema["own"].dataType))
    given = names.select("rel", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), "names", none(mark).alias("mark"), none(marks.schema["own"].dataType).alias("own"))
    selves = spans.select("rel", F.col("start").cast("long").alias("at"), F.lit(2).alias("kind"), none("array<string>").alias("names"), none(mark).alias("mark"), own.alias("own"))
    upto = Window.partitionBy("rel").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.unionByName(given).unionByName(selves).withColumn("top", F.last("mark", ignorenulls=True).over(upto)["top"])
    return seen.where("kind = 2 or kind = 1 and top is not null").select("rel", "at", "names", "top", "own")


def stab_references(spans: DataFrame, names: DataFrame, levels: int | None = None) -> DataFrame:
    """rel, id, name, start, stop of spans (ids distinct in a rel), and refs: the distinct names other than its own that
    stand in a span and in none within it, sorted.

    names: rel, at, and the array of names at that place; all is dealt out once, by rel, and names never one by one.
    """
    rows = _stabbed(spans, names, levels).withColumn("id", F.coalesce("own.id", "top.id"))
    every = rows.groupBy("rel", "id").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("refs"))
    return every.select("rel", "id", "own.name", "own.start", "own.stop", F.array_remove("refs", F.coalesce("own.name", F.lit(""))).alias("refs"))
