"""The pipeline's stages by hand on a small corpus, and each stage on awkward rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from arboria.llm import common as C
from test_operators import base_failed, shingles, split, words7  # noqa: I001


def plain(docs):
    return [tuple(r) for r in docs.collect()]


def test_names_and_columns(spark, docs, sf):
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token ids"]
    for _, stage in P.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf)
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            assert some is docs or out.count() == 0
        out.collect()
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_quality_rules_keep_clean_documents(spark, docs, rows, sf):
    kept = plain(P.quality_rules(spark, docs, sf).select("doc_id", "text"))
    want = [(i, t) for i, t, *_ in rows if not base_failed(t)]
    assert len(want) > 3
    assert Counter(kept) == Counter(want)


def test_one_document_of_each_group_stays(spark, docs, rows, sf):
    kept = plain(P.near_duplicates(spark, docs, sf).select("doc_id", "text"))
    ids = Counter(i for i, _ in kept)
    assert ids[1] == 1 and not ids[2] and ids[7] == 1 and not ids[8]
    assert sum(not split(t) for _, t in kept) == sum(not split(r[1]) for r in rows)  # wordless ones are nobody's copies


def test_contaminated_documents_go(spark, sf):
    item = C.table(spark, sf, "benchmark").where(F.length("text") > 120).first()
    rows = [(1, item.text), (2, "clean text of no item at all"), (3, item.text + " filler" * 4000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert sorted(r.doc_id for r in P.decontamination(spark, docs, sf).collect()) == [2, 3, 4]


def test_mixing_repeats_and_cuts(spark, sf):
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}_{k}\n" for k in range(5 + i))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.length("text"))
    out = P.mixed_sources(spark, docs, sf).collect()
    size, taken, full = defaultdict(int), defaultdict(int), {i: t for i, _, t in rows}
    for _, s, t in rows:
        size[s] += len(t.split())
    for r in out:
        taken[r.source] += len(r.text.split())
        assert full[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    total = sum(size.values())
    assert abs(sum(taken.values()) - total) <= 3 and taken["s0"] > taken["s1"] > taken["s2"]
    assert max(Counter(r.doc_id for r in out).values()) <= 3


def test_mixing_keeps_texts_whole(spark, sf):
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}_{k}\n" for k in range(5 + 40 * (i % 7)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.length("text"))
    out, full = P.mixed_sources(spark, docs, sf).collect(), {i: t for i, _, t in rows}
    assert all(r.text == full[r.doc_id] and r.n_chars == len(r.text) for r in out)
    got, goal, size = defaultdict(int), {}, {i: len(t.split()) for i, _, t in rows}
    for r in out:
        got[r.source] += size[r.doc_id]
    for r in P.mixing.mix(docs, carry=("doc_id", "source")).collect():
        goal[r.row.source] = r.target
    longest = max(size.values())
    assert all(abs(got[s] - t) <= longest / 2 + 1 for s, t in goal.items())


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = C.table(spark, sf, "documents"), []
    for _, stage in P.STAGES:
        docs = C.stash(stage(spark, docs, sf), "test")
        out.append(docs.collect())
    return out


def test_stages_on_documents(spark, sf, stages):
    rows = C.table(spark, sf, "documents").collect()
    first, second, third, fourth, last = stages
    assert len(rows) > len(first) > len(second) >= len(third)
    sets = {r.doc_id: shingles(r.text) for r in second}
    ids = list(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    items = [words7(r.text) for r in C.table(spark, sf, "benchmark").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12))}
    for r in third:
        w, hit = words7(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        assert not (hit and 20 * len(hit) >= len(w))
    assert Counter(r.doc_id for r in fourth) == Counter(r.doc_id for r in last)
    ends = [(r.start, r.start + r.n_tokens) for r in sorted(last, key=lambda r: (r.start, r.n_tokens))]
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_run_gives_the_last_stage(spark, sf, stages):
    assert Counter(map(tuple, P.run(spark, sf).collect())) == Counter(map(tuple, stages[-1]))
