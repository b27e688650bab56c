"""Retrieval metrics over ranked lists and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall, mrr, hit and ndcg at k of each query.

    ranked: query_id, id, rank.  gold: query_id, id (distinct).
    """
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "id"], "left_semi")
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hit"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = size.join(found, "query_id", "left").fillna(0, ["n_hit"])
    return rows.select("query_id", (F.col("n_hit") / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("n_hit") > 0).cast("int").alias("hit"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def averaged(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("recall", "mrr", "hit", "ndcg")])


def only_in(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Pairs (query_id, id) of the first list that no other has (what only the graph finds)."""
    for o in others:
        first = first.join(o.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return first


def common_names(rows: DataFrame, name: str, most: int = 3) -> DataFrame:
    """Rows whose name, whatever its case, stands more than `most` times."""
    n = rows.groupBy(F.lower(name).alias("_l")).agg(F.count("*").alias("_c")).where(F.col("_c") > most)
    return rows.join(n, F.lower(rows[name]) == n["_l"], "left_semi")


def latencies(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Median, 95th percentile (the element at int(n * 0.95)) and greatest value of each group, exactly."""
    w = Window.partitionBy(*group).orderBy(value)
    ranked = rows.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*group))})
    at = lambda k: F.max(F.when(F.col("_k") == F.greatest(F.lit(1), F.floor(k)), F.col(value)))
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), at(F.col("_n") * 0.5 + 0.5).alias("p50"), at(F.col("_n") * 0.95).alias("p95"), F.max(value).alias("most"))
