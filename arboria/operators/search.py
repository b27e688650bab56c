"""Ranked search for a table of queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import scoring as S
from ..functions import text as T
from ..sources import work
from . import matching

#: Queries that meet all nodes in one pass; more are taken in blocks of so many, and of so many bytes, so what goes to
#: every task stays small.
QUERY_BLOCK, QUERY_BYTES = 1000, 8 << 20


def blocks_of(queries: DataFrame) -> list[DataFrame]:
    """queries (query_id, ...) in parts of about QUERY_BLOCK rows and QUERY_BYTES of text."""
    size = F.sum(F.coalesce(F.octet_length("query"), F.lit(0))) if "query" in queries.columns else F.lit(0)
    n, size = queries.agg(F.count("*"), size).first()
    blocks = max(1, -(-n // QUERY_BLOCK), -(-(size or 0) // QUERY_BYTES))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def in_blocks(queries: DataFrame, run) -> DataFrame:
    """run() for each block of queries, one after another."""
    out = None
    for some in blocks_of(queries):
        rows = run(F.broadcast(some))
        out = rows if out is None else out.unionByName(rows)
    return out


def scored(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Every node in each query's root with its lexical score, by column expressions: query_id, id, title, score.

    nodes: id, title, summary, detail_content, node_type, source_path, index_root.  queries: query_id, query, root (null: all).
    """

    def run(some: DataFrame) -> DataFrame:
        some = some.withColumn("words", T.terms("query"))
        pairs = nodes.join(some, F.col("root").isNull() | (F.col("root") == F.col("index_root")))
        score = S.lexical_score(F.col("query"), F.col("words"), F.col("title"), F.col("summary"), F.col("detail_content"), F.col("node_type"), F.col("source_path"))
        return pairs.select("query_id", "id", "title", score.alias("score"))

    return in_blocks(queries, run)


def search(nodes: DataFrame, queries: DataFrame, limit: int = 12, semantic: bool = False, alpha: float = 5.0, whole: bool = False) -> DataFrame:
    """The best nodes of each query: query_id, rank, id, score, semantic, source_rank, blended.

    nodes: id, title, summary, detail_content, node_type, source_path, index_root, zoom_threshold (and embedding).
    queries: query_id, query, root (null: all) (and query_embedding).

    Admitted are nodes with a score, or near enough by meaning; ties go by zoom threshold, title, id.  A first pass over
    the nodes gives the best score of each query, a second those nodes of each task that may be among the query's
    `limit` best; only these are shuffled.  whole: details are searched to their ends, not as lexical_score() does.
    """
    return over_fields(fields(nodes, semantic, whole), asked(queries, semantic), max(1, limit), semantic, alpha)


def asked(queries: DataFrame, semantic: bool = False) -> DataFrame:
    """Queries with their terms."""
    return queries.select("query_id", "query", F.lower("query").alias("low"), T.terms("query").alias("words"), "root", S.asks_for_tests(F.col("query")).alias("asks"), *(["query_embedding"] if semantic else []))


def fields(nodes: DataFrame, semantic: bool = False, whole: bool = False) -> DataFrame:
    """What a search looks at."""
    return nodes.select("id", "title", "zoom_threshold", "index_root", *S.search_fields(F.col("title"), F.col("summary"), F.col("detail_content"), F.col("node_type"), F.col("source_path"), whole), *(["embedding"] if semantic else []))


def over_fields(fields: DataFrame, asked: DataFrame, limit: int, semantic: bool = False, alpha: float = 5.0) -> DataFrame:
    """search() over fields() and asked()."""
    out = None
    for some in blocks_of(asked):
        rows = _searched(fields, some, limit, semantic, alpha)
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("query_id").orderBy(F.round("blended", 4).desc(), "zoom_threshold", "title", "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "id", "score", "semantic", "source_rank", F.round("blended", 4).alias("blended"))


def _searched(fields: DataFrame, some: DataFrame, limit: int, semantic: bool, alpha: float) -> DataFrame:
    spark = fields.sparkSession
    rows = some.collect()
    block = matching.Block(rows)
    shared = spark.sparkContext.broadcast(block)

    def best(batches):
        found = matching.best_scores(shared.value, batches, semantic)
        at = np.flatnonzero(found >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], ["q", "best"])

    for r in fields.mapInArrow(best, "q int, best long").groupBy("q").agg(F.max("best").alias("best")).collect():
        block.best[r.q] = r.best
    ready = spark.sparkContext.broadcast(block)

    def top(batches):
        found = matching.Top(ready.value, limit, alpha, semantic)
        for batch in batches:
            for i, j, score, cosine, rank, blended in found.of(batch):
                own = [batch.column(c).take(pa.array(i)) for c in ("id", "title", "zoom_threshold")]
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), *own, pa.array(score, pa.int32()), pa.array(cosine), pa.array(rank), pa.array(blended)], ["q", "id", "title", "zoom_threshold", "score", "semantic", "source_rank", "blended"])

    numbers = [StructField("score", IntegerType()), *(StructField(c, DoubleType()) for c in ("semantic", "source_rank", "blended"))]
    schema = StructType([StructField("q", IntegerType()), *(fields.schema[c] for c in ("id", "title", "zoom_threshold")), *numbers])
    ids = work.of_driver(spark, [(k, r.query_id) for k, r in enumerate(rows)], StructType([StructField("q", IntegerType()), some.schema["query_id"]]))
    return fields.mapInArrow(top, schema).join(F.broadcast(ids), "q").drop("q")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors (id, embedding) of greatest cosine for each query (query_id, query_embedding), itself left out.

    Each task takes matrix products of its vectors with a block of queries and hands on those that may be among a
    query's k best; these alone are compared exactly and shuffled.  Equal cosines go by id.  A vector that is missing
    or not of numbers has cosine 0; rows without an id and queries without one are left out.
    """
    schema = StructType([StructField("q", IntegerType()), vectors.schema["id"], vectors.schema["embedding"]])
    given, out = vectors.where("id is not null").select("id", "embedding"), None
    asked = queries.where("query_id is not null").select("query_id", "query_embedding", F.col("query_id").cast(vectors.schema["id"].dataType).alias("own"))
    for some in blocks_of(asked):
        rows = _nearest(given, some, k, schema)
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(given: DataFrame, some: DataFrame, k: int, schema: StructType) -> DataFrame:
    spark = given.sparkSession
    rows = some.collect()
    shared = spark.sparkContext.broadcast(matching.Vectors([r.own for r in rows], [r.query_embedding for r in rows]))

    def near(batches):
        found = matching.Nearest(shared.value, k)
        for batch in batches:
            for i, j in found.of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), *(batch.column(c).take(pa.array(i)) for c in ("id", "embedding"))], ["q", "id", "embedding"])

    numbered = work.of_driver(spark, [(n, r.query_id, r.query_embedding) for n, r in enumerate(rows)], StructType([StructField("q", IntegerType()), some.schema["query_id"], some.schema["query_embedding"]]))
    pairs = given.mapInArrow(near, schema).join(F.broadcast(numbered), "q")
    return pairs.select("query_id", "id", F.nanvl(S.cosine("embedding", "query_embedding"), F.lit(0.0)).alias("cosine"))


def find_node(nodes: DataFrame, query: str) -> DataFrame:
    """The one node meant: by id, then by a part of the id, then by most terms (three more for the whole in the title)."""
    q = F.lower(F.lit(query))
    hay = F.lower(F.concat_ws(" ", "title", "summary", "source_path", "id"))
    hits = F.size(F.filter(T.terms(F.lit(query)), lambda t: F.contains(hay, t))) + F.when(F.contains(F.lower("title"), q), 3).otherwise(0)
    tier = F.when(F.lower("id") == q, 0).when(F.contains(F.lower("id"), q), 1).when(hits > 0, 2)
    return nodes.withColumns({"tier": tier, "hits": hits}).where("tier is not null").orderBy("tier", F.when(F.col("tier") == 2, -F.col("hits")).otherwise(0), "id").limit(1)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, drawn by a seeded hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def span(start: Column, end: Column) -> Column:
    """Lines from start to end; a node without lines is the widest."""
    return F.coalesce(F.greatest(F.lit(0), end - start), F.lit(10**9))
