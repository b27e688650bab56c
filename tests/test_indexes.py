"""The gram index and the inverted lists against searches that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arboria.operators import grams, ivf, search
from arboria.plans import structures
from arboria.sources import scan, work

NODE = "id string, title string, summary string, detail_content string, node_type string, source_path string, index_root string, zoom_threshold double"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(500):
        path = f"{rng.choice(['src', 'docs', 'x'])}/{rng.choice(words)}.py" if i % 17 else None
        rows.append((f"n{i:03}", f"{rng.choice(words)} of" if i % 5 else "same", rng.choice(["", "a summary", None]), " ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["file", "symbol", "directory"]), path, rng.choice(["r1", "r2", None]), float(i % 3)))
    return spark.createDataFrame(rows, NODE), words


def test_gram_index_gives_the_rows_of_a_scan(spark, nodes):
    df, words = nodes
    rng, keep = random.Random(5), work.shared(spark)
    asked = [" ".join(rng.choices(words, k=k)) for k in (1, 1, 2, 2, 3, 5) for _ in range(4)] + ["", "of", "ab", "same", "no such wordatall", "summary same", "é", "docs test", words[3][:3], f"{words[0]} {words[0]}"]
    queries = spark.createDataFrame([(i, q, [None, "r1", "none"][i % 3 if i % 4 else 0]) for i, q in enumerate(asked)], "query_id long, query string, root string")
    index = grams.build(df, keep)
    for limit, common in ((12, 1 / 16), (3, 0.5), (100, 0.0)):
        out, report = index.search(queries, keep, limit, common)
        assert _rows(out) == _rows(search.search(df, queries, limit))
        told = {r.query_id: r.scanned for r in report.collect()}
        assert set(told) == set(range(len(asked)))
        if common == 0.5:
            assert sum(told.values()) < len(told) / 2


def test_gram_index_of_nothing(spark):
    keep = work.shared(spark)
    index = grams.build(spark.createDataFrame([], NODE), keep)
    assert index.search(spark.createDataFrame([(1, "word", None)], "query_id long, query string, root string"), keep)[0].collect() == []


def test_most_queries_of_long_words_need_no_scan(spark, sf):
    keep = work.shared(spark)
    docs = scan.documents_as_nodes(spark.read.parquet(f"{sf}/documents.parquet"))
    _, report = grams.build(docs, keep).search(structures.longest_words(spark, sf), keep, 5)
    assert report.where("scanned").count() < report.count() / 2


def test_inverted_lists_find_nine_of_ten(spark, sf):
    rows = structures.vector_ivf(spark, sf).collect()
    assert rows[0].recall >= 0.9 and {r["rank"] for r in rows} == set(range(1, 11))


def test_all_lists_are_an_exact_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(300)] + [(300 + i, [1.0] * 12) for i in range(200)]
    rows += [(600, None), (601, [0.0] * 12), (602, [1.0] * 5), (603, [float("nan")] * 12)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.where("id % 29 = 0 or id > 598").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = ivf.build(v, work.shared(spark))
    assert index.table.count() == len(rows)
    found = {(r.query_id, r["rank"]): round(r.cosine, 9) for r in index.search(q.where("query_id < 599"), 10, probes=len(index.centroids)).collect()}
    want = {(r.query_id, r["rank"]): round(r.cosine, 9) for r in search.vector_topk(v, q.where("query_id < 599"), 10).collect()}
    assert found == want
    assert index.search(q, 10).where("query_id > 598").select("query_id").distinct().count() > 0


def test_a_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "VECTORS", 50)
    monkeypatch.setattr(ivf, "QUERIES", 7)
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(400)] + [(i, [0.0, 0.0, 1.0 + i]) for i in range(400, 420)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = ivf.build(v, work.shared(spark), lists=2)
    got = index.search(q, 5, probes=2)
    assert ivf.recall(got, search.vector_topk(v, q, 5)) > 0.99


def test_no_vectors(spark):
    v = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    assert ivf.build(v, work.shared(spark)).search(q, 3).collect() == []


def test_hash_vectors_of_many_texts_are_those_of_each():
    """A distinct token of all texts is hashed once; a worker's memory of tokens may begin anew."""
    import hashlib

    import numpy as np

    from arboria.operators import embed

    texts = ["one two one", "It's été 🙂 x", "...", "a" * 50, "x " * 3000, *(f"w{i} w{i + 1} one" for i in range(200))]
    assert np.array_equal(embed.hash_vectors(texts), np.array([embed.hash_vector(t) for t in texts]))
    known: dict = {}
    embed.hash_vectors(texts, known=known)
    asked, blake2b = [], hashlib.blake2b
    try:
        hashlib.blake2b = lambda *a, **k: asked.append(1) or blake2b(*a, **k)
        embed.hash_vectors(texts, known=known)
        assert not asked
        embed.REMEMBERED, old = 5, embed.REMEMBERED
        assert np.array_equal(embed.hash_vectors(texts, known=known), embed.hash_vectors(texts)) and len(known) < 20
        embed.REMEMBERED = old
    finally:
        hashlib.blake2b = blake2b


def test_a_gram_has_a_row_a_piece_and_not_a_row_a_node(spark, nodes, monkeypatch):
    df = nodes[0].coalesce(1)
    index = grams.build(df, work.shared(spark))
    want = {(place, x[i : i + n], r.id) for r in index.fields.collect() for place, x, sizes in (("text", r.h, (3,)), ("name", r.t, (2, 3)), ("name", r.p, (2, 3))) for n in sizes for i in range(len(x or "") - n + 1)}
    assert index.postings.count() == index.counts.count() == len({(place, gram) for place, gram, _ in want})
    assert index.counts.agg(F.sum("n")).first()[0] == len(want)
    monkeypatch.setattr(grams, "PIECE", 300)
    pieces = [(r.place, r.gram, x) for r in grams._postings(index.fields.coalesce(1)).collect() for x in r.ids]
    assert len(pieces) == len(want) and set(pieces) == want


def test_lists_of_texts_with_very_many_characters():
    texts = [None if k % 9 == 0 else "".join(chr(0x10000 + k * 40 + j) for j in range(40)) for k in range(5000)]
    got = [(g, r) for spelt, ends, rows in grams._lists([texts], 3) for g, a, b in zip(spelt, [0, *ends], ends, strict=False) for r in rows[a:b].tolist()]
    want = {(x[i : i + 3], k) for k, x in enumerate(texts) if x for i in range(38)}
    assert len(got) == len(want) and set(got) == want
    assert list(grams._lists([["", None], ["a", ""]], 2))[0][0] == [] and [x[0] for x in grams._lists([[]], 2)] == [[]]
