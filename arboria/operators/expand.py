"""Seeds to candidates: the neighbours of each query's matches, in the order in which they are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import span

SYNTAX = "syntax_dependency"


def expanded(seeds: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates of each query: query_id, id, score, role, origin, link_type, label, at (order of insertion).

    seeds: query_id, rank, id, score.  nodes: id, line_start, line_end.  links: from, to, type, label, ord.
    Each seed, then what it calls and what calls it, narrowest first, then the other of its first four links; a node
    is taken where it first stands.
    """
    width = nodes.select("id", span(F.col("line_start"), F.col("line_end")).alias("span"))
    s = seeds.select("query_id", "rank", F.col("id").alias("seed"), "score")
    none = F.lit(None).cast("string")
    own = s.select("query_id", "rank", F.lit(0).alias("part"), F.lit(0).alias("span"), F.lit(0).alias("ord"), F.col("seed").alias("id"), "score", none.alias("role"), none.alias("origin"), none.alias("link_type"), none.alias("label"))

    def near(end: str, other: str, part: int, role: str) -> DataFrame:
        some = links.where(F.col("type") == SYNTAX).select(F.col(end).alias("seed"), F.col(other).alias("id"), "type", "label", "ord")
        rows = s.join(some, "seed").join(width, "id")
        return rows.select("query_id", "rank", F.lit(part).alias("part"), "span", "ord", "id", "score", F.lit(role).alias("role"), F.col("seed").alias("origin"), F.col("type").alias("link_type"), "label")

    four = links.withColumn("_n", F.row_number().over(Window.partitionBy("from").orderBy("ord", "to", "type", "label"))).where(F.col("_n") <= 4).where(F.col("type") != SYNTAX)
    others = s.join(four.select(F.col("from").alias("seed"), F.col("to").alias("id"), "type", "label", "ord"), "seed").join(width.select("id"), "id", "left_semi")
    others = others.select("query_id", "rank", F.lit(3).alias("part"), F.lit(0).alias("span"), "ord", "id", F.greatest(F.lit(1), F.col("score") - 1).alias("score"), F.lit("callee").alias("role"), F.col("seed").alias("origin"), F.col("type").alias("link_type"), "label")
    every = own.unionByName(near("from", "to", 1, "callee")).unionByName(near("to", "from", 2, "caller")).unionByName(others)
    at = ["rank", "part", "span", "ord", "label"]
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*at))).where("_n = 1")
    return first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(*at, "id"))).drop("_n", *at[:-1])


def tiered(candidates: DataFrame) -> DataFrame:
    """pos: the focus, its own syntactic neighbours, then the rest, critical ones first, by score and title.

    candidates: as from expanded(), with title and critical.
    """
    q = Window.partitionBy("query_id")
    rows = candidates.withColumn("focus", F.min(F.when(F.col("at") == 1, F.col("id"))).over(q))
    pinned = F.coalesce((F.col("origin") == F.col("focus")) & (F.col("link_type") == SYNTAX), F.lit(False))
    rows = rows.withColumn("tier", F.when(F.col("at") == 1, 0).when(pinned, 1).otherwise(2))
    rest = F.col("tier") == 2
    order = ["tier", F.when(rest, ~F.col("critical")), F.when(rest, -F.col("score")), F.when(rest, F.col("title")), "at"]
    return rows.withColumn("pos", F.row_number().over(q.orderBy(*order)))
