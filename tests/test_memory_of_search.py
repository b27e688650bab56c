"""Memory of a worker in searches: bounded by steps, however many rows a batch has."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from arboria.operators import matching, search


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def vectors(n: int, seed: int = 0) -> list:
    return np.random.default_rng(seed).normal(size=(n, 16)).tolist()


def test_nearest_vectors_of_two_sizes_take_the_same_memory():
    asked = matching.Vectors(list(range(-1000, 0)), vectors(1000, 1))
    peaks = []
    for n in (5_000, 20_000):
        batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "embedding": pa.array(vectors(n), pa.list_(pa.float64()))})
        peaks.append(peak_mb(lambda: sum(len(i) for i, _ in matching.Nearest(asked, 10).of(batch))))  # noqa: B023
    assert max(peaks) < 80 and peaks[1] < 1.3 * peaks[0] + 2


def test_tables_of_queries_need_no_python_on_executors(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate(vectors(40))], "id long, embedding array<double>").localCheckpoint()
    q = v.where("id < 5").selectExpr("id as query_id", "embedding as query_embedding")
    found = search.vector_topk(v, q, 3)
    assert found._jdf.queryExecution().logical().toString().count("LogicalRDD") == 1  # the vectors alone
    assert found.count() == 15


def test_terms_are_found_wherever_they_stand(monkeypatch):
    draw = np.random.default_rng(4)
    monkeypatch.setattr(matching, "_WINDOW", 16)
    word = lambda letters, n: "".join(draw.choice(list(letters), n))
    terms = dict(enumerate(sorted({word("ab.9é Z", draw.integers(1, 8)) for _ in range(400)})))
    find = matching.Terms(terms)
    for n in [0, 1, 2, 3, *draw.integers(4, 200, 100)]:
        text = word("ab.9é Z字", n)
        found = find(text)
        assert sorted(found) == [k for k, x in terms.items() if x in text]


def test_points_are_added_by_steps_as_at_once(monkeypatch):
    rows = [SimpleNamespace(low=q, words=q.split(), root=None, asks=False) for q in ("ab cd ab", "cd", "file: s/ab", "", "none")]
    texts = [f"file: s/{t}  {t} x file s/{t}" for t in ("ab", "cd ab", "e", "abcd", "ab") * 20]
    given = ([t.split("  ")[0] for t in texts], [t.split(" ")[-1] for t in texts])
    at_once = matching.Block(rows).scores(*given, iter(texts), np.full(100, 2))
    monkeypatch.setattr(matching, "_CELLS", 40)
    assert (matching.Block(rows).scores(*given, iter(texts), np.full(100, 2)) == at_once).all()
    points = lambda t, p, h, r: 2 + sum(10 * (w in t) + 6 * (w in p) + 2 * (w in h) for w in r.words) + 20 * (r.low in t) + 12 * (r.low in p)
    assert at_once.tolist() == [[points(t, p, h, r) for r in rows] for t, p, h in zip(*given, texts, strict=True)]
