"""Answering a table of queries: ranked search, expansion over links, packing into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import embed, expand, extract, links, pack, search


def seeded(nodes: DataFrame, queries: DataFrame, limit: int = 24, semantic: bool = True, embedder=embed.hash_embedding) -> DataFrame:
    if semantic:
        queries = queries.withColumn("query_embedding", embedder("query"))
    return search.search(nodes, queries, limit=limit, semantic=semantic)


def contexts(nodes: DataFrame, edges: DataFrame, files, queries: DataFrame, semantic: bool = True, keep=lambda df, name: df, embedder=embed.hash_embedding) -> DataFrame:
    """query_id, query, budget, used, selected_count, selected, compiled_context.

    nodes and edges as from plans.index; files: rel, text (and index_root), or a function that gives those of a table of
    rel (and index_root); queries: query_id, query, budget, root.  keep() materialises what several steps read.
    """
    seeds = keep(seeded(nodes, queries.select("query_id", "query", "root"), semantic=semantic, embedder=embedder), "seeds")
    real = links.within(edges, nodes)
    found = expand.expanded(seeds.select("query_id", "rank", "id", "score"), nodes, real)
    facts = nodes.select("id", "title", "summary", "detail_content", "node_type", "source_path", "rel", "index_root", "line_start", "line_end")
    rows = keep(found.join(facts, "id"), "candidates")
    if callable(files):
        files = files(rows.select("index_root", "rel").distinct())
    key = [c for c in ("index_root", "rel") if c in files.columns]
    rows = rows.join(files.select(*key, "text"), key, "left")
    start = F.greatest(F.lit(1), F.coalesce("line_start", F.lit(1)))
    own = F.slice(T.lines("text"), start, F.greatest(F.lit(0), F.coalesce("line_end", start + 60) - start + 1))
    rows = rows.withColumn("brace_contract", F.when(F.col("text").isNotNull() & (F.col("node_type") != "file"), extract.brace_contract(own)))
    raw = F.when(F.col("text").isNotNull(), T.snippet("text", F.col("line_start"), F.col("line_end"), 1 << 30))
    rows = rows.withColumn("critical", S.critical(F.col("title"), F.coalesce("summary", F.lit("")), F.coalesce("detail_content", F.lit("")), F.coalesce(raw, F.lit(""))))
    rows = expand.tiered(rows)
    rows = rows.join(nodes.select(F.col("id").alias("origin"), F.col("title").alias("origin_title")), "origin", "left")
    rows = rows.join(queries.select("query_id", T.terms("query").alias("words")), "query_id")
    return pack.packed(queries.select("query_id", "query", "budget"), pack.rendered(rows))


def zoomed(nodes: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """The best nodes of each query by words alone, and the camera to look at the first: 1.15 times its threshold."""
    best = search.search(nodes, queries, limit=limit)
    place = nodes.select("id", "title", "x", "y", "zoom_threshold")
    rows = best.join(place, "id")
    return rows.withColumn("zoom", F.greatest(F.lit(1.0), 1.15 * F.col("zoom_threshold"))).select("query_id", "rank", "id", "title", "score", "blended", "x", "y", "zoom")


