"""Registered graph queries over all rows and whole texts of small tables, against plain computations."""

import numpy as np
import pytest

import __spark_entry__ as entry
from arboria.functions import constants as K
from arboria.operators import embed
from arboria.sources import scan


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    late = "y " * 300 + K.BROAD_HINTS[0]
    text = "The start of(\nThing select from orders"
    docs = [(1, text, "en", "a", 10), (2, text, "de", "a", 10), (3, text, None, None, 10), (4, late, "de", "b", 10), (5, "\n".join(["z" * 3000] * 3), "fr", "b", 10)]
    put(spark, d, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    put(spark, d, "benchmark", [(k, "x" * 41 + " b/fr/5.txt") for k in range(25)], "item_id long, text string")
    v = np.random.default_rng(4).normal(size=(101, 8)).astype(np.float32)
    put(spark, d, "embeddings", [(i, [float(x) for x in e], i % 5) for i, e in enumerate(v)], "vec_id long, embedding array<float>, label int")
    put(spark, d, "orders", [(i, i, 5.0) for i in range(1, 61)], "o_orderkey long, o_custkey long, o_totalprice double")
    put(spark, d, "part", [(1, 3)], "p_partkey long, p_size int")
    put(spark, d, "lineitem", [(i, 1, 1, "N", "O") for i in range(1, 61)], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string")
    return d


def rows(spark, d, name):
    return entry.queries()[name](spark, d).collect()


@pytest.mark.parametrize("name", ["query_zoom", "minified_sniff", "call_refs", "table_refs", "risk_score"])
def test_every_document_has_a_row(spark, small, name):
    assert sorted(r.doc_id for r in rows(spark, small, name)) == [1, 2, 3, 4, 5]


def test_every_language_is_read(spark, small):
    assert {r.rel for r in rows(spark, small, "markdown_sections")} == {"1", "2", "3"}
    assert {r.rel for r in rows(spark, small, "named_blocks")} == {"1", "2", "3"}
    assert {r.rel for r in rows(spark, small, "py_symbols")} == {f"{k}.py" for k in range(1, 6)}
    assert {(r.source, r.taken) for r in rows(spark, small, "pack_greedy")} == {("a", "1,2"), ("b", "4,5"), (None, "3")}


def test_texts_are_read_whole(spark, small, monkeypatch):
    zoom = {r.doc_id: r.zoom for r in rows(spark, small, "query_zoom")}
    assert zoom[4] > zoom[1]
    assert {r.doc_id: r.minified for r in rows(spark, small, "minified_sniff")} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert {r.id for r in rows(spark, small, "search_batch") if r["rank"] == 1} == {"5"}
    from pyspark.sql import functions as F

    monkeypatch.setattr(embed, "hash_embedding", lambda c: F.array(F.length(c).cast("double")))
    assert {r.doc_id: r.norm for r in rows(spark, small, "hash_embed")}[5] == 9002.0**2


def test_vector_searches_take_every_fiftieth_row(spark, small):
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    cos = lambda a, b: e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b])
    best = {q: sorted((k for k in e if k != q), key=lambda k: -cos(q, k))[:10] for q in (0, 50, 100)}
    got = rows(spark, small, "vector_topk")
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(q, n, k) for q, ks in best.items() for n, k in enumerate(ks, 1)}
    recall = {q: sum(k % 5 == q % 5 for k in ks) / sum(k % 5 == q % 5 and k != q for k in e) for q, ks in best.items()}
    assert {r.query_id: r.recall for r in rows(spark, small, "mrr_ndcg")} == {q: round(x, 6) for q, x in recall.items()}
    blend = rows(spark, small, "hybrid_blend")
    assert sorted({r.query_id for r in blend}) == [0, 50, 100] and len(blend) == 60
    assert {q: next(r.id for r in blend if r.query_id == q and r["rank"] == 1) for q in best} == {q: str(q) for q in best}


def test_all_customers_and_items_are_queries(spark, small):
    assert {r.query_id for r in rows(spark, small, "expand_callers_callees")} == set(range(1, 61))
    packed = rows(spark, small, "context_pack")
    assert sorted(r.query_id for r in packed) == list(range(25))


def test_every_file_is_gated(spark, tmp_path):
    docs = [(k, f"text {k % 700}" + ("\0" if k % 100 == 0 else ""), "en", "a", 1) for k in range(1500)]
    put(spark, str(tmp_path), "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    want, seen = {}, set()
    for _, text, *_ in sorted(docs, key=lambda r: f"{r[0]}.txt"):
        outcome = "binary" if "\0" in text else "duplicate" if text in seen else "kept"
        seen.add(text)
        n, size = want.get(outcome, (0, 0))
        want[outcome] = n + 1, size + len(text)
    assert {r.outcome: (r.n, r.bytes) for r in rows(spark, str(tmp_path), "scan_gate")} == want
    files = scan.documents_as_files(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("rel", "content")
    assert scan.gated(files).count() == K.MAX_FILES and scan.gated(files, max_files=70).count() == 70
    assert {r.rel: r.outcome for r in scan.gated(files, max_files=1500).collect()} == {r.rel: r.outcome for r in scan.gated(files, max_files=None).collect()}


def test_nearest_vectors_agree_with_all_pairs(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from arboria.functions import scoring as S
    from arboria.operators import matching, search

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[i % 3][1]) for i in range(300, 360)]  # copies, which tie
    rows += [(5, rows[5][1]), (400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 2.0]), (404, [float("nan")] * 6), (405, rows[9][1][:4]), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    queries = vectors.where("id % 20 = 0 or id is null or id = 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pairs = vectors.join(F.broadcast(queries), F.col("id") != F.col("query_id")).select("query_id", "id", F.nanvl(S.cosine("embedding", "query_embedding"), F.lit(0.0)).alias("cosine"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))).where("rank <= 4")
    columns = ["query_id", "rank", "id", "cosine"]
    assert sorted(search.vector_topk(vectors, queries, 4).select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert search.vector_topk(vectors, queries.limit(0), 4).count() == search.vector_topk(vectors.limit(0), queries, 4).count() == 0
    block = matching.Vectors(list(range(4)), [[1.0, float(i)] for i in range(4)])
    assert matching.cosines([[1.0, 0.0]], block.vectors)[0, 0] == 1.0


def test_search_batch_reads_texts_to_their_ends(spark, tmp_path):
    import duckdb

    texts = ["needl " * 900, "x y. " * 5000 + "Needle", "Ñé needle" + " z" * 900, "", "the end " * 200 + "of a NEEDLE/2"]
    put(spark, tmp_path, "documents", [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    put(spark, tmp_path, "benchmark", [(1, "needle"), (2, "end of needle/2"), (3, "")], "item_id long, text string")
    got = rows(spark, str(tmp_path), "search_batch")
    assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1][:3] == ["1", "2", "4"]
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duckdb.sql(entry.oracle_sql()["search_batch"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 15
