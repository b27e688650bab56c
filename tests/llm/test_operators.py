"""Every operator against a plain computation, on driver tables and on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arboria.llm import common as C
from arboria.llm import context_mixing, decontaminate, html_extract, license_scan, line_dedup, mixing, ngram_join, quality, token_store, warc


def split(text):
    return (text or "").encode().lower().split()


def words7(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


@pytest.fixture(scope="session")
def table(spark, sf):
    return [tuple(r)[:5] for r in C.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]


# ---- shared ----------------------------------------------------------------------------------------------------


def test_spans_and_hashes_follow_the_words(rows):
    texts = [(r[1] or "").encode() for r in rows]
    buf, off = C.flat(pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary()))
    low = C.lowered(buf)
    s, e, w = C.spans(low, off, C.NOT_SPACE)
    assert [low[a:b].tobytes() for a, b in zip(s, e, strict=True)] == [x for t in texts for x in t.lower().split()]
    assert np.diff(w).tolist() == [len(t.split()) for t in texts]
    h, seen = C.word_hashes(low, s, e), {}
    for a, b, x in zip(s, e, h.tolist(), strict=True):
        assert seen.setdefault(x, low[a:b].tobytes()) == low[a:b].tobytes()


def test_range_bounds_depend_on_rows_alone(spark):
    df = spark.range(10_000).selectExpr("case when id < 5000 then id else id * 1000000 end as k", "1L as w")
    bounds = C.range_bounds(df, "k", F.col("w"), 700).tolist()
    assert bounds == C.range_bounds(df.repartition(7), "k", F.col("w"), 700).tolist()
    sizes = Counter(r[0] for r in df.select(C.shard_of(spark, "k", np.array(bounds))).collect())
    assert sum(sizes.values()) == 10_000 and max(sizes.values()) <= 1400


def test_many_shards_are_bounded(spark):
    """100,000 shards, of twice the target at most, whose bounds take eight bytes each."""
    df = spark.range(400_000).selectExpr("id * id as k", "1 + id % 3 as w")
    bounds = C.range_bounds(df, "k", F.col("w"), 8)
    assert len(bounds) + 1 == 100_000 and bounds.nbytes < 1 << 20
    sums = df.groupBy(C.shard_of(spark, "k", bounds).alias("s")).agg(F.sum("w").alias("w")).agg(F.max("w"), F.sum("w"), F.count("*")).first()
    assert sums[0] <= 16 and sums[1] == 400_000 * 2 - 1 and sums[2] == 100_000
    dealt = C.dealt_to_shards(df.withColumn("shard", C.shard_of(spark, "k", bounds)), len(bounds) + 1, "k")
    assert dealt.rdd.getNumPartitions() == C.MOST_TASKS
    C.MOST_TASKS, before = 7, C.MOST_TASKS
    try:
        parts = C.dealt_to_shards(df.withColumn("shard", C.shard_of(spark, "k", bounds)), len(bounds) + 1, "k").select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    finally:
        C.MOST_TASKS = before
    assert len(parts) == 100_000 and all(r.p == r.shard * 7 // 100_000 for r in parts)


def thue_morse(n, flip=0):
    return bytes(97 + (bin(i).count("1") + flip) % 2 for i in range(n))


def test_words_that_polynomial_hashes_confuse_are_told_apart():
    for n in (64, 1024, 2048):
        both = thue_morse(n) + b" " + thue_morse(n, 1)
        low = np.frombuffer(both, np.uint8)
        a, b = C.word_hashes(low, np.array([0, n + 1]), np.array([n, 2 * n + 1])).tolist()
        assert a != b
    r = np.random.default_rng(1)
    spans = [(int(a), int(a + n)) for a, n in zip(r.integers(0, 5000, 3000), r.integers(0, 200, 3000), strict=True)]
    low = np.frombuffer(bytes(r.integers(97, 99, 5200).astype(np.uint8)), np.uint8)
    seen = {}
    for h, (a, b) in zip(C.word_hashes(low, *np.array(spans).T).tolist(), spans, strict=True):
        assert seen.setdefault(low[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: "x"))
    with pytest.raises(RuntimeError):
        C.shared_dir(fake)
    fake.sparkContext.master = "local[3]"
    assert C.shared_dir(fake).startswith("file:/") and conf["spark.checkpoint.dir"] == C.shared_dir(fake)


# ---- 1 ---------------------------------------------------------------------------------------------------------


def check_scores(rows, docs):
    got = context_mixing.score_documents(docs, slot_bits=14).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = [(i, [*split(t), None]) for i, t, *_ in rows]
    c = Counter(x for i, ts in tokens if not held(i) for x in ts)
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 4)) for i, ts in tokens]
    same([(*tuple(r)[:5], round(r.base_score, 4)) for r in got], want)
    assert all(r.score < 0 and abs(r.bits_per_byte + r.score / math.log10(2) / r.n_bytes) < 1e-9 for r in got)
    return got


def test_scores(docs, rows, no_docs):
    check_scores(rows, docs)
    assert context_mixing.score_documents(no_docs, slot_bits=14).collect() == []


def test_scores_of_words_that_share_most_of_their_hash(spark):
    """The pairs share the first 38 bits of their hashes; each word is counted apart all the same."""
    pairs = [("k391552", "k824541"), ("k110495", "k1491459"), ("k582518", "k1022744"), ("k578889", "k1388409")]
    words = [w.encode() for pair in pairs for w in pair]
    h = C.word_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])[:-1], np.cumsum([*map(len, words)]))
    assert (h[::2] >> np.uint64(26) == h[1::2] >> np.uint64(26)).all() and len(np.unique(h)) == len(h)
    rows = [(i, " ".join([a] * (i + 1) + [b] * (i % 2))) for i, (a, b) in enumerate(pairs)] + [(i, f"{a} {b}") for i, (a, b) in enumerate(pairs, 50)]
    check_scores(rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_model_beats_words_on_held_out_texts(spark, sf, table):
    got = check_scores(table, C.table(spark, sf, "documents"))
    again = context_mixing.score_documents(C.table(spark, sf, "documents").repartition(5), slot_bits=14).collect()
    same([(r.doc_id, round(r.score, 6)) for r in got], [(r.doc_id, round(r.score, 6)) for r in again])
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def plain_model_scores(rows):
    """The model's score of each text, byte by byte from counts in dicts; only the learnt weights are the operator's own."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [(t or "").encode().lower() + b"\0" for _, t in rows]
    counts, held_grams = defaultdict(lambda: [0, 0]), Counter()
    decisions = lambda t, at: [(k, t[at - k : at] if at >= k else b"\0" * (k - at) + t[:at], d, t[at] >> (8 - d)) for d in range(8) for k in range(5)]
    for t, out in zip(texts, held, strict=True):
        for at in range(0 if out else len(t)):
            held_grams[int.from_bytes((b"\0" * 4 + t)[at : at + 5], "big")] += 1
            for key in decisions(t, at):
                counts[key][t[at] >> (7 - key[2]) & 1] += 1
    g = np.array(sorted(held_grams), np.uint64)
    n = np.array([held_grams[int(x)] for x in g], np.int64)
    low = context_mixing.low_counts(np.bincount((g & np.uint64(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16).astype(np.int64))
    total = np.zeros(context_mixing.start_weights().shape)
    for b in range(64):
        some = context_mixing.bucket_of(g) == b
        total += some.sum() * context_mixing.learn_weights(g[some], n[some], context_mixing.Nodes(g[some], n[some], low)).astype(float) if some.any() else 0
    weights = total / len(g)

    def byte_nats(t, at):
        out = 0.0
        for d in range(8):
            n0, n1 = zip(*(counts.get(key, (0, 0)) for key in decisions(t, at)[5 * d : 5 * d + 5]), strict=True)
            seen = [sum(n0[k] + n1[k] >= x for x in (1, 4)) for k in (4, 3)]
            dot = sum(w * math.log((b + 0.08) / (a + 0.08)) for w, a, b in zip(weights[d][4 * seen[0] + seen[1]], n0, n1, strict=True))
            out -= math.log1p(math.exp(-max(-20, min(20, dot)) * (1 if t[at] >> (7 - d) & 1 else -1)))
        return out

    def mix(own, known):
        better = tried = 0
        out = []
        for a, b in zip(own, known, strict=True):
            if b is None:
                out.append(a)
                continue
            rate = (better + 1) / (tried + 2)
            out.append(math.log((1 - rate) * math.exp(a) + rate * math.exp(b)) if max(a, b) > -700 else np.logaddexp(math.log(1 - rate) + a, math.log(rate) + b))
            better, tried = better + (b > a), tried + 1
        return out

    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t[:-1])] for t in texts]
    words = Counter(t[a:b] for t, ws, out in zip(texts, spans, held, strict=True) if not out for a, b in ws)
    every = sum(words.values())
    ends = [0, *range(9, 14), 32]
    share = {c: math.prod((counts.get((0, b"", d, c >> (8 - d)), (0, 0))[c >> (7 - d) & 1] + 0.5) / (sum(counts.get((0, b"", d, c >> (8 - d)), (0, 0))) + 1) for d in range(8)) for c in ends}
    closing = {c: math.log(x / sum(share.values())) for c, x in share.items()}

    def phrases(t, ws):
        h = [int(C.word_hashes(np.frombuffer(t, np.uint8), np.array([a]), np.array([b]))[0]) for a, b in ws]
        picked = C.mix64(np.array([(3 * p + q) % 2**64 for p, q in zip([0, *h], h, strict=False)], np.uint64)) & np.uint64(15) == 0
        cut = sorted({b + 1 for (_, b), ok in zip(ws, picked, strict=True) if ok} | {len(t)})
        return list(zip([0, *cut], cut, strict=False))

    cuts = [phrases(t, ws) for t, ws in zip(texts, spans, strict=True)]
    keys = [list(zip([None, *(t[a:b] for a, b in c)], (t[a:b] for a, b in c), strict=False)) for t, c in zip(texts, cuts, strict=True)]
    out, used = [], 0
    for i, (t, ws) in enumerate(zip(texts, spans, strict=True)):
        last, hits, tried, nats = {}, 0, 0, []
        for at in range(len(t)):
            x = byte_nats(t, at)
            before = t[at - 6 : at] if at >= 6 else None
            if before in last:
                rate, hit = (hits + 0.4) / (tried + 1.6), last[before] == t[at]
                x, hits, tried = math.log((1 - rate) * math.exp(x) + rate * hit), hits + hit, tried + 1
            if before:
                last[before] = t[at]
            nats.append(x)
        own = [sum(nats[a : b + 1]) for a, b in ws]
        known = [math.log(words[t[a:b]] / every) + closing[t[b]] if words[t[a:b]] else -math.inf for a, b in ws]
        gain = [x - y for x, y in zip(mix(own, known), own, strict=True)]
        whole = [sum(nats[a:b]) + sum(x for x, (s, _) in zip(gain, ws, strict=True) if a <= s < b) for a, b in cuts[i]]
        others = [k for j, ks in enumerate(keys) if j != i and not held[j] for k in ks]
        context, pair = Counter(c for c, _ in others), Counter(others)
        said = [(math.log(pair[k]) if pair[k] else -math.inf) - math.log(context[k[0]] + 0.5) if context[k[0]] else None for k in keys[i]]
        used += sum(x is not None and x > -math.inf for x in said)
        out.append((rows[i][0], sum(mix(whole, said)) / math.log(10)))
    return out, used


def test_scores_by_plain_counting(spark):
    import random

    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("Re", "mo", "ta", "xi", "über") for b in ("line", "set", "k", "ration", "中", "s,")]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [sentence(50) for _ in range(2)]
    rows = [(i, sentence(r.randrange(5, 30)) + ("\n" + shared[i % 2] if i % 3 == 0 else "")) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, rows[0][1]), (44, "abcdefgh " * 12), (44, "abcdefgh " * 12), (None, "unseen word")]
    want, used = plain_model_scores(rows)
    got = context_mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((x.doc_id, x.score) for x in got), key=key)
    assert used > 10
    assert [x[0] for x in got] == [x[0] for x in sorted(want, key=key)]
    assert all(abs(a - b) < 1e-3 * (1 + abs(b)) for (_, a), (_, b) in zip(got, sorted(want, key=key), strict=True)), list(zip(got, sorted(want, key=key), strict=True))


def test_a_byte_model_is_a_distribution():
    rng, bits = np.random.default_rng(3), 12
    counts = [rng.integers(0, 90, context_mixing.table_size(bits)).astype(np.uint8) for _ in range(2)]
    m = context_mixing.Model(*counts, context_mixing.start_weights(), bits)
    for context in (0, 0x61626364, 0x20746865):
        g = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs(np.exp(m.nats(g)).sum() - 1) < 1e-6
        assert np.array_equal(m.nats(g), m.nats(g))
    assert abs(np.exp(m.closing).sum() - 1) < 1e-9


def test_grams_hold_the_bytes_before():
    texts = [b"abcdef", b"", b"xy"]
    buf, off = C.flat(pa.array(texts, pa.binary()))
    g, ends = context_mixing.grams(buf, off)
    assert g.tolist() == [int.from_bytes((b"\0" * 4 + t + b"\0")[i : i + 5], "big") for t in texts for i in range(len(t) + 1)]
    assert ends.tolist() == [0, 7, 8, 11]


def test_counts_of_orders_0_and_1_have_no_top():
    """Shares stay right in contexts that a corpus of many GB has more than four million times."""
    pairs = np.zeros((256, 256), np.int64)
    pairs[ord("e"), ord(" ")], pairs[ord("e"), ord("\n")], pairs[ord("a"), ord("b")] = 5_046_884_000, 95_512_000, 3
    n0, n1 = context_mixing.low_counts(pairs.reshape(-1))
    closing = np.exp(context_mixing.Model(n0, n1, context_mixing.start_weights(), 14).closing)
    assert abs(closing[10] / closing[32] - 95_512 / 5_046_884) < 1e-6
    for k in range(8):  # every decision on the way to a line feed
        node, want = (1 << k) | (10 >> (8 - k)), [sum(n for c, n in ((32, 5_046_884_000), (10, 95_512_000), (98, 3)) if c >> (8 - k) == 10 >> (8 - k) and c >> (7 - k) & 1 == b) for b in (0, 1)]
        assert [n0[node], n1[node]] == want
    g = np.array([int.from_bytes(b"abcd" + c, "big") for c in (b"e", b"f")], np.uint64)
    # e (01100101) and f (01100110) part at the seventh bit
    n0, n1 = context_mixing.Nodes(g, np.array([60_000_000, 3_000_000_000]), np.zeros((2, 65_792), np.int64)).counts(6)
    assert np.allclose(n1[2:] / n0[2:], 50)


def test_contexts_are_kept_apart_however_many():
    """40,000 contexts of a bucket, more than the 16,384 slots it once had: counts are those of each context alone."""
    assert context_mixing.score_documents.__defaults__[1] is None
    rng = np.random.default_rng(5)
    g = np.unique((rng.integers(0, 40_000, 90_000).astype(np.uint64) << np.uint64(24)) | np.uint64(0x656E00) | rng.integers(97, 105, 90_000).astype(np.uint64))
    counts = rng.integers(0, 9, len(g))
    want = defaultdict(lambda: [0, 0])
    for x, n in zip(g.tolist(), counts.tolist(), strict=True):
        for k in range(2, 5):
            for depth in range(8):
                want[k, x >> 8 & (1 << 8 * k) - 1, depth, (x & 255) >> (8 - depth)][x >> (7 - depth) & 1] += n
    nodes = context_mixing.Nodes(g, counts, np.zeros((2, 65_792), np.int64))
    for depth in (0, 5, 7):
        got = np.stack(nodes.counts(depth))
        for i in range(0, len(g), 7):
            for k in range(2, 5):
                x = int(g[i])
                assert got[:, k, i].tolist() == want[k, x >> 8 & (1 << 8 * k) - 1, depth, (x & 255) >> (8 - depth)]


def test_buckets_grow_with_the_corpus():
    assert context_mixing.bucket_bits(10 << 20) == 6 and context_mixing.bucket_bits(30 << 30) == 10
    g = np.arange(1 << 16, dtype=np.uint64) << np.uint64(8)
    b = context_mixing.bucket_of(g, 10)
    assert len(np.unique(b)) == 1024 and np.array_equal(b, context_mixing.bucket_of(g | np.uint64(0x7F000000AA), 10))


# ---- 2 ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><div class="cookie-notice">We use cookies, as all do.</div>
<article><h1>A &amp; B  title</h1><p>First   paragraph, with <b>bold</b> and &eacute;t&eacute;; it goes on for a while.<p>Second one is unclosed, but it is text.</p>
<div class="ad">Buy this now.</div><ul><li>A point that is made here.</li></ul></article><section class="comments"><div class="comment"><p>I disagree with all of this, and so do my friends, really.</p></div></section>
<script>var t = "</p>";</script><form>Your mail</form><aside>Related things to read</aside><footer>&copy; someone, somewhere.</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>unclosed <b>and <i>odd"), (4, "x", "<" * 50 + "a<b " + "<div>" * 300), (1, "u", PAGE), (5, "y", "<article><p>" + "word, " * 40_000)]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    want = "A & B title\nFirst paragraph, with bold and été; it goes on for a while.\nSecond one is unclosed, but it is text.\nA point that is made here."
    assert [r.text for r in by[1]] == [want, want]
    assert by[2][0].text == "" and by[None][0].text == "" and len(by[5][0].text.split()) == 40_000 and len(got) == len(rows)
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_nothing_of_an_article_is_lost(spark):
    """Texts with characters that lower-casing lengthens, formulas, and what stands in for scripts and plug-ins."""
    main = "<p>A first paragraph that is long enough to be one, surely, and goes on.</p>"
    cases = [
        "<p>" + "İ" * 30 + "</p><script>x = 1</script><p>After the script, the text goes on, as it should.</p>",
        "<p>Area is <math><mi>x</mi><mo>·</mo><mn>2</mn></math> and so on, for all of us.</p>",
        "<noscript><p>A paragraph for readers without scripts, long enough to be one.</p></noscript>",
        "<p>Before <object><b>an object</b></object>, <canvas>a canvas</canvas> and <svg><title>no</title><text>a drawing</text></svg>, it says.</p>",
        "<SCRIPT>var a = '<p>no</p>';</ScRiPt ><p>Upper-case end tags end scripts, too, as everyone knows.</p>",
    ]
    want = [["İ" * 30, "After the script, the text goes on, as it should."], ["Area is x·2 and so on, for all of us."], ["A paragraph for readers without scripts, long enough to be one."], ["Before an object, a canvas and a drawing, it says."], ["Upper-case end tags end scripts, too, as everyone knows."]]
    pages = [(k, "u", f"<html><body><nav><a href=/>Home</a></nav><article><h1>A title for all</h1>{main}{c}{main}</article><footer>© x</footer></body></html>") for k, c in enumerate(cases)]
    schema = "page_id long, url string, html string, `text` string, `n_chars` long, `row` string, `a.b` string"
    got = {r.page_id: r for r in html_extract.html_extract(spark.createDataFrame([(*p, "x", 1, "y", "z") for p in pages], schema)).collect()}
    p = "A first paragraph that is long enough to be one, surely, and goes on."
    for k, w in enumerate(want):
        assert got[k].text.split("\n") == ["A title for all", p, *w, p]


def brute_force_text(source, weights, pair):
    """The page's kept blocks, by enumeration of all labellings of its elements."""
    page = html_extract.Page(source)
    n, unary = len(page.tag), html_extract.Batch([page]).x @ weights
    total, ones = 0.0, [0.0] * n
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        p = math.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(pair[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += p
        for i in range(n):
            ones[i] += p * y[i]
    return "\n".join(t for e, t, _ in page.blocks if ones[e] / total > 0.5)


def test_extraction_by_enumeration_and_another_parser():
    """Small random pages: the operator's text by brute force, and all words of the blocks by the standard library's parser."""
    import random
    from html.parser import HTMLParser

    weights, pair = html_extract.trained()
    r = random.Random(12)
    names = ["div", "p", "section", "article", "aside", "footer", "nav", "b", "i", "a", "blockquote", "main", "noscript"]

    def made(depth):
        out = ""
        for _ in range(r.randint(1, 3)):
            k = r.random()
            if k < 0.45 or depth > 2:
                out += r.choice(["some words &amp; more of them, ", "İx ", "2 &lt; 3 ", "a long sentence that says a thing or two, and then ends. "])
            elif k < 0.5:
                out += r.choice(["<script>var x = 1</script>", "<style>p{}</style>", "<!-- no -->", "<br>"])
            else:
                name = r.choice(names)
                out += f'<{name}{r.choice(["", " class=menu", " id=content"])}>{made(depth + 1)}</{name}>'
        return out

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.words.append(" " if tag == "br" or tag not in html_extract._INLINE else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            self.words.append(" " if tag not in html_extract._INLINE else "")

        def handle_data(self, data):
            self.words.append("" if self.hidden else data)

    seen = 0
    for _ in range(250):
        source = made(0)
        page = html_extract.Page(source)
        plain = Plain()
        plain.feed(source)
        plain.close()
        assert " ".join(t for _, t, _ in page.blocks).split() == "".join(plain.words).split()
        if len(page.tag) < 11:
            seen += 1
            assert html_extract.texts_of([source], weights, pair) == [brute_force_text(source, weights, pair)]
    assert seen > 100


#: Pages as several publishing systems make them, written by hand, none by the generator that the model learns from.
WRITTEN = [
    ("""<html><head><title>T</title></head><body class="home blog"><div id="wrap"><div id="masthead"><a href="/">My weblog</a><p>Notes on this and that</p></div>
<ul class="menu"><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li></ul>
<div id="primary"><div class="hentry"><h2 class="entry-title">On keeping bees in town</h2><div class="entry-content"><p>We have kept two hives on the roof since spring, and nobody has complained so far.</p>
<p>The first thing that one learns is patience; the second is to wear gloves.</p></div></div></div>
<div id="secondary" class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Bread</a></li><li><a href="/2">Rain again</a></li></ul></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely piece, thank you for writing this, we did the same.</p></div></div><div id="footer">Copyright 2019 My weblog</div></div></body></html>""",
     "On keeping bees in town\nWe have kept two hives on the roof since spring, and nobody has complained so far.\nThe first thing that one learns is patience; the second is to wear gloves."),
    ("""<!DOCTYPE html><html><body><header role="banner"><nav role="navigation"><a href="#">Politics</a> <a href="#">Sport</a> <a href="#">Weather</a></nav></header>
<div class="cookie-consent"><p>We value your privacy. We and our partners store information on a device.</p><button>Accept</button></div>
<main><article><header><h1>Council votes to rebuild the old bridge</h1></header><p>The council voted on Tuesday evening to rebuild the bridge, which has been closed for two years.</p>
<div class="advert">Advertisement: new shoes, half the price.</div><p>Work is to begin in March, a spokesperson said, and should take fourteen months.</p>
<blockquote>It is a good day for the town, said the mayor.</blockquote></article></main><aside class="related-stories"><h2>More on this</h2><ul><li><a href="/x">Bridge closed after flood</a></li></ul></aside>
<footer><p>© 2021 The Paper. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>""",
     "Council votes to rebuild the old bridge\nThe council voted on Tuesday evening to rebuild the bridge, which has been closed for two years.\nWork is to begin in March, a spokesperson said, and should take fourteen months.\nIt is a good day for the town, said the mayor."),
    ("""<html><body><div id="content"><h1>Granite</h1><p><b>Granite</b> is a coarse-grained rock that is mostly of quartz, alkali feldspar and plagioclase.</p>
<h2>Occurrence</h2><p>It forms from magma with a high content of silica, which slowly cools below the ground.</p><ul><li>Batholiths can reach hundreds of square kilometres.</li><li>Dikes are far smaller.</li></ul></div>
<div id="navigation"><ul><li><a href="/">Main page</a></li><li><a href="/r">Random article</a></li><li><a href="/h">Help</a></li></ul></div><div id="footer"><ul><li>Text is available under a free licence.</li></ul></div></body></html>""",
     "Granite\nGranite is a coarse-grained rock that is mostly of quartz, alkali feldspar and plagioclase.\nOccurrence\nIt forms from magma with a high content of silica, which slowly cools below the ground.\nBatholiths can reach hundreds of square kilometres.\nDikes are far smaller."),
    ("""<html><body><div class="navbar"><a href="/">Docs</a><a href="/api">API</a><form><input name="q"> <label>Search the docs</label></form></div><div class="container"><section class="main-content">
<h1>Installing</h1><p>Unpack the archive and run the installer; it asks for a folder.</p><pre>tar xf tool.tgz
./install</pre><p>Afterwards, open a new shell, so that the path is read again.</p></section></div><div class="newsletter">Subscribe to our newsletter for more tips, every week.</div>
<div class="site-footer">Built with care. © 2020</div><script>track("<p>x</p>")</script></body></html>""",
     "Installing\nUnpack the archive and run the installer; it asks for a folder.\ntar xf tool.tgz ./install\nAfterwards, open a new shell, so that the path is read again."),
]


def test_extraction_on_pages_written_by_hand():
    weights, pair = html_extract.trained()
    for source, want in WRITTEN:
        assert html_extract.texts_of([source], weights, pair) == [want]


def test_messages_give_exact_marginals():
    pages, labels = html_extract.training_pages(6, 5)
    page = next(p for p in pages if 4 < len(p.tag) < 14) if any(4 < len(p.tag) < 14 for p in pages) else html_extract.Page("<div><p>a</p><p>b</p></div><ul><li>c</ul>")
    batch, rng = html_extract.Batch([page]), np.random.default_rng(1)
    unary, pair = rng.normal(size=len(page.tag)), rng.normal(size=(2, 2))
    n, total, ones = len(page.tag), 0.0, np.zeros(len(page.tag))
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        w = math.exp(sum(unary[i] * y[i] for i in range(n)) + sum(pair[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += w
        ones += w * np.array(y)
    assert np.allclose(batch.marginals(unary, pair)[0], ones / total)


def test_extraction_on_pages_it_was_not_trained_on():
    weights, pair = html_extract.trained()
    pages, labels = html_extract.training_pages(80, 777)
    batch = html_extract.Batch(pages)
    p, _ = batch.marginals(batch.x @ weights, pair)
    right = wrong = 0
    for page, y, a in zip(pages, labels, batch.first.tolist(), strict=False):
        for e, text, _ in page.blocks:
            n = len(text.split())
            right, wrong = (right + n, wrong) if (p[a + e] > 0.5) == y[e] else (right, wrong + n)
    assert right / (right + wrong) > 0.93


# ---- 3 ---------------------------------------------------------------------------------------------------------


def check_warc(rows, got):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[digest(h)] = max(top.get(digest(h), i), i)
    seen, want = set(), []
    for i, _, h in sorted(rows, key=repr):
        k = digest(h)
        first = i == top.get(k) and (k, i) not in seen
        seen.add((k, i))
        want.append((i, len((h or "").encode()), k, "response" if first else "revisit", None if first else top.get(k)))
    same([tuple(r) for r in got], want)


def test_warc_round_trip(spark, sf):
    folder = C.new_dir(spark, "warc")
    pages = C.table(spark, sf, "pages")
    files = warc.write_warc(pages, folder, shard_bytes=40_000, roll_bytes=6_000).collect()
    assert len(files) > 4 and sum(f.n_records for f in files) == pages.count()
    check_warc([tuple(r) for r in pages.select("page_id", "url", "html").collect()], warc.read_warc(spark, folder).drop("url").collect())
    again = C.new_dir(spark, "warc")
    redo = warc.write_warc(pages.repartition(5), again, shard_bytes=40_000, roll_bytes=6_000).collect()
    assert sorted(map(tuple, files)) == sorted(map(tuple, redo))  # names, sizes and digests of the files


def test_warc_of_awkward_pages(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (2, None, "x"), (3, "a b\r\nInjected: 1", None), (4, "v", ""), (None, "w", "y"), (5, "q", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = C.new_dir(spark, "warc")
    warc.write_warc(df, folder)
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.page_id in (1, 2)) == [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (3, 4)} == {(3, "revisit", 4), (4, "response", None)}
    assert [r.record_type for r in got if r.page_id is None] == ["response"] and len(got) == len(rows)
    empty = C.new_dir(spark, "warc")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).collect() == []


# ---- 4 ---------------------------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_and_keys():
    import random

    r = random.Random(5)
    for _ in range(4000):
        a = "".join(r.choices("abé", k=r.randint(0, 12)))
        b = "".join(c for c in a if r.random() > 0.15) + "".join(r.choices("abé", k=r.randint(0, 3)))
        assert all(line_dedup.within(a, b, t) == (distance(a, b) <= t) for t in (1, 2, 3))
    for _ in range(500):
        a = "".join(r.choices("ab c", k=r.randint(26, 50)))
        i, j = r.randrange(len(a)), r.randrange(len(a))
        b = a[:i] + r.choice(["", "x", a[i] + "y"]) + a[i + 1 :]
        b = b[:j] + r.choice(["", "z", b[j : j + 1] + "q"]) + b[j + 1 :]
        if a == b or distance(a, b) > 2:
            continue
        line, key, own = line_dedup.Lines([a, b]).keys(2, 24)
        short = 0 if len(a) <= len(b) else 1
        assert set(key[(line == short) & own].tolist()) & set(key[line != short].tolist())


def check_lines(rows, got):
    low = -(2**63)
    occ, first = [], {}
    for n, (i, t, *_) in enumerate(rows):
        for no, raw in enumerate((t or "").encode().split(b"\n")):
            if line := raw.strip():
                at = (low if i is None else i, no)
                occ.append((n, at, line))
                first[line] = min(first.get(line, at), at)
    text = {x: x.decode() for x in first}
    links, late = Counter(), set()
    for x in text:
        for y in text:
            if x < y and abs(len(text[x]) - len(text[y])) <= 2 and line_dedup.within(text[x], text[y], 2):
                links[x] += 1
                links[y] += 1
                if first[x] != first[y]:
                    late.add(max((first[x], x), (first[y], y))[1])
    want = [[i, 0, 0, 0, 0] for i, *_ in rows]
    for n, at, line in occ:
        w = want[n]
        w[1] += 1
        if first[line] < at:
            w[2] += 1
        else:
            w[3] += line in late
            w[4] += links[line]
    same([tuple(r) for r in got], [(*w, w[1] - w[2] - w[3]) for w in want])
    return sum(links.values())


def test_lines(spark, docs, rows, no_docs):
    assert check_lines(rows, line_dedup.duplicates(docs).collect()) >= 2
    assert line_dedup.duplicates(no_docs).collect() == []


def test_lines_of_documents(spark, sf, table):
    check_lines(table, line_dedup.duplicates(C.table(spark, sf, "documents")).collect())


def check_kept_lines(rows, got):
    """Each duplicate's class and the place it repeats, and the texts without them."""
    first, text = {}, {}
    for i, t, *_ in rows:
        for no, x in enumerate((t or "").encode().split(b"\n")):
            if x.strip():
                at = (-(2**63) if i is None else i, no)
                first[x.strip()] = min(first.get(x.strip(), at), at)
    long = list(first)
    near, group = defaultdict(set), {x: {x} for x in first}
    for k, x in enumerate(long):
        for y in long[:k]:
            if abs(len(x.decode()) - len(y.decode())) <= 2 and line_dedup.within(x.decode(), y.decode(), 2):
                near[x].add(y)
                near[y].add(x)
                group[x] |= group[y]
                for z in group[x]:
                    group[z] = group[x]
    ident = {x: hashlib.blake2b(x, digest_size=16).hexdigest() for x in first}
    want = []
    for i, t, *_ in rows:
        gone, kept = [], []
        for no, x in enumerate((t or "").encode().split(b"\n")):
            line, at = x.strip(), (-(2**63) if i is None else i, no)
            before = min((first[y] for y in near[line] if first[y] < first[line]), default=None) if line else None
            if line and (first[line] < at or before):
                kind, place = ("exact", first[line]) if first[line] < at else ("near", before)
                gone.append((no, kind, None if place[0] == -(2**63) else place[0], place[1], min(ident[y] for y in group[line])))
            else:
                kept.append(x)
        want.append((i, gone, b"\n".join(kept).decode()))
    same([(r.doc_id, [tuple(x) for x in r.duplicates], r.text) for r in got], want)
    assert all(r.n_exact + r.n_near == len(r.duplicates) for r in got)
    return sum(len(x[1]) for x in want)


def test_lines_that_hashes_confuse_are_kept(spark):
    rows = [(k, thue_morse(n, k % 2).decode(), "en", "s", n) for k, n in enumerate((1024, 1024, 2048, 2048))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_lines(rows, line_dedup.duplicates(df).collect())
    check_kept_lines(rows, line_dedup.deduplicated(df).collect())


def test_short_lines_link_like_all_others(spark):
    """Lines of one code point up, with and without characters of several bytes."""
    import random

    r = random.Random(5)
    rows = [(i, "\n".join("".join(r.choice("abü🙂") for _ in range(r.randint(0, 12))) for _ in range(6)), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert check_lines(rows, line_dedup.duplicates(df).collect()) > 1000
    check_kept_lines(rows, line_dedup.deduplicated(df).collect())
    long = line_dedup.duplicates(df, min_chars=24).agg(F.sum("n_links")).first()[0]
    assert long == 0


def test_lines_of_one_key_meet_part_by_part(spark, monkeypatch):
    """Many lines with equal segments: the same links, whether their rows meet in one task or in many."""
    import random

    r = random.Random(8)
    rows = [(i, "the same long beginning of all these lines " + r.choice("abcd") * r.randint(1, 3) + " and the same long end", "en", "s", 1) for i in range(150)]
    rows = [(i, t + r.choice(["", "x", "xy", " zz"]), *x) for i, t, *x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(line_dedup, "MEET", 5)
    assert check_lines(rows, line_dedup.duplicates(df).collect()) > 100
    check_kept_lines(rows, line_dedup.deduplicated(df).collect())


def test_duplicate_lines_and_kept_texts(spark, sf, docs, rows, no_docs, table):
    assert check_kept_lines(rows, line_dedup.deduplicated(docs).collect()) >= 4
    check_kept_lines(table, line_dedup.op4_line_dedup(spark, sf).collect())
    assert line_dedup.deduplicated(no_docs).collect() == []


# ---- 5 ---------------------------------------------------------------------------------------------------------


def shingles(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def check_join(rows, got, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        least[find(a)] += [] if i is None else [i]
    want = [(i, len(s), (min(least[find(a)], default=None)) if s else i) for a, ((i, *_), s) in enumerate(zip(rows, sets, strict=True))]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], want)


def test_join(docs, rows, no_docs):
    check_join(rows, ngram_join.ngram_join(docs).collect())
    assert ngram_join.ngram_join(no_docs).collect() == []


def test_join_of_documents(spark, sf, table):
    check_join(table, ngram_join.ngram_join(C.table(spark, sf, "documents")).collect())


def test_join_of_many_near_copies(spark):
    """A chain and a crowd of mutated copies: links that do not go through one leader."""
    import random

    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows, now = [], base
    for i in range(120):
        source = base if i % 3 else now
        now = [f"v{r.randrange(10**6)}" if r.random() < 0.02 else w for w in source]
        rows.append((i, " ".join(now), "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_join(rows, ngram_join.ngram_join(df).collect())


def test_join_in_cells(spark, monkeypatch):
    """Shingles that many different documents share: the same components when their rows meet in many cells."""
    import random

    r, seen = random.Random(4), []
    frame = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(frame[: r.randint(20, 30)] + [f"v{r.randrange(40)}" for _ in range(r.randint(0, 9))]), "en", "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    meetings = ngram_join._meetings
    monkeypatch.setattr(ngram_join, "_meetings", lambda *x: seen.append(meetings(*x)) or seen[-1])
    monkeypatch.setattr(ngram_join, "MEET", 6)
    check_join(rows, ngram_join.ngram_join(df).collect())
    placed = spark.createDataFrame([(1, n, n) for n in range(40)], "tok long, node long, label long")
    cells = meetings(placed, spark.createDataFrame([(1, 7)], "tok long, parts int")).collect()
    pairs = Counter()
    for cell in {c.cell for c in cells}:
        some = [c for c in cells if c.cell == cell]
        pairs.update(frozenset((x.node, y.node)) for x in some for y in some if x.ours and y.theirs and (x.part != y.part or x.node < y.node))
    assert len(pairs) == 40 * 39 // 2 and set(pairs.values()) == {1}


# ---- 6 ---------------------------------------------------------------------------------------------------------


def check_licenses(rows, got):
    want = []
    for i, t, *_ in rows:
        w = words7(t)
        places = []
        for phrase, label in license_scan.BASE:
            places += [(k, label) for k in range(len(w) - len(phrase) + 1) if tuple(w[k : k + len(phrase)]) == phrase]
        base = sorted({x for _, x in places})
        text, kept = b" ".join(w).decode("utf-8", "replace"), []
        every = [(m.start(), m.end(), priority, label, weight) for pattern, label, priority, weight in license_scan.rules() for m in pattern.finditer(text)]
        for d in sorted(every, key=lambda d: (d[2], d[0] - d[1], d[0])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        labels = sorted({*base, *(d[3] for d in kept)})
        score = max([0.6 * bool(base), *(d[4] for d in kept)])
        spans = [(d[0], d[1], d[3]) for d in sorted(kept)]
        want.append((i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(base), ",".join(labels), score, spans))
    same([(r.row.doc_id, *tuple(r)[1:8], [tuple(x) for x in r.spans]) for r in got], want)
    assert all(0 <= r.score <= 1 for r in got)


def test_licenses(spark, sf, docs, rows, no_docs, table):
    check_licenses(rows, license_scan.license_scan(docs).collect())
    check_licenses(table, license_scan.license_scan(C.table(spark, sf, "documents")).collect())
    assert license_scan.license_scan(no_docs).collect() == []


def test_rules():
    assert len(license_scan.rules()) > 300
    of = lambda t: license_scan.scan(t.encode())[5]
    assert of("Licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert of("SPDX-License-Identifier: LGPL-2.1-or-later") == "lgpl-2.1"
    assert of("under the terms of the GNU Lesser General Public License version 3") == "gpl,lgpl-3.0"  # gpl by a base phrase
    assert license_scan.scan(b"MIT\n * License, mit-license")[:4] == (4, 2, 0, 2)
    inner, outer = (5, 9, 2, "b", 0.5), (0, 9, 1, "a", 0.9)
    assert license_scan.suppressed([inner, outer]) == [outer]


def test_licence_bodies_without_a_name():
    of = lambda t: license_scan.scan(t.encode())[5:7]
    assert of("Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software") == ("mit", 0.9)
    assert of("Redistribution and use in source and binary forms, with or without\n * modification, are permitted") == ("bsd", 0.9)
    assert of("Permission to use, copy, modify, and/or distribute this software for any purpose") == ("isc", 0.9)
    assert of("This software is provided 'as-is', without any express or implied warranty.") == ("zlib", 0.9)
    assert of("Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software") == ("ofl-1.1", 0.9)
    assert of("Released under the Internet Systems Consortium licence")[0] == "isc"


def sampled(items, r):
    """A string that a parsed regex of literals, choices, options and groups matches."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(r.choice(arg)[1])
        elif name == "SUBPATTERN":
            out += sampled(arg[-1], r)
        elif name == "BRANCH":
            out += sampled(r.choice(arg[1]), r)
        elif name == "MAX_REPEAT":
            out += "".join(sampled(arg[2], r) for _ in range(r.randint(arg[0], arg[1])))
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_every_rule_passes_its_own_gate():
    """Whatever a rule matches has one of each set of the rule's literals, and the rule's label or a longer match's is given."""
    import random
    from re import _parser

    r = random.Random(3)
    for pattern, label, *_ in license_scan.rules():
        sets = license_scan.literals(pattern.pattern)
        assert sets, pattern.pattern
        for k in range(12):
            text = sampled(_parser.parse(pattern.pattern), r)
            assert pattern.search(text), (pattern.pattern, text)
            assert all(any(x in text for x in some) for some in sets)
            if not k:
                text = f"see {text} here"
                got = license_scan.detections(text.encode())
                assert got == license_scan.detections(text.encode(), gated=False) and got, text
    gate = license_scan.literals(r"(?:a|an? )?(?:mit|bsd (?:new|old))+ licen[cs]ed?(?: \d+)?")
    assert frozenset({"mit", "bsd new", "bsd old"}) in gate


def test_suppression_is_by_containment_in_any_kept_one():
    import random

    r = random.Random(9)
    for _ in range(300):
        found = [(a, a + r.randint(1, 12), r.randrange(4), str(k), 0.5) for k, a in enumerate(r.choices(range(30), k=r.randint(0, 14)))]
        kept = []
        for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], int(d[3]))):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert license_scan.suppressed(found) == sorted(kept)
    many = [(i, i + 5, i % 5, "x", 0.5) for i in range(60_000)] + [(0, 10**6, 9, "y", 0.5)]
    assert len(license_scan.suppressed(many)) == 60_001


# ---- 7 ---------------------------------------------------------------------------------------------------------


def check_contamination(rows, items, got):
    windows = defaultdict(set)
    for name, t in items:
        w = words7(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(name)
    want = []
    for i, t, *_ in rows:
        w, hit, names = words7(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[x]
        ids = sorted(str(x) for x in names if x is not None)
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same([(r.row.doc_id, *tuple(r)[1:]) for r in got], want)
    return sum(x[2] > 0 for x in want)


ITEMS = [(7, "the quick brown fox jumps over a lazy dog while seven wizards watch from the hill"), (7, "one two"), (70, "watch from the hill and nobody says a word about it today my friend"), (8, None), (9, "!!"), (None, "ganz normale Zeile"), (10, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13"), (11, "Zeile"), (12, "one two"), (13, "straße 中文")]


def test_contamination(spark, sf, docs, rows, table):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert check_contamination(rows, ITEMS, decontaminate.decontaminate(docs, bench).collect()) >= 5
    bench = C.table(spark, sf, "benchmark")
    check_contamination(table, [tuple(r) for r in bench.select("item_id", "text").collect()], decontaminate.decontaminate(C.table(spark, sf, "documents"), bench).collect())
    check_contamination(rows, [], decontaminate.decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == []


def test_contamination_with_maps_and_many_findings(spark, docs, rows, monkeypatch):
    """Map columns are carried; a filter that lets much through, and findings that are not broadcast, change nothing."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    mapped = docs.withColumn("props", F.create_map(F.lit("a"), F.col("doc_id")))
    monkeypatch.setattr(C, "small", lambda rows, *_: rows)
    monkeypatch.setattr(decontaminate.Filter, "MOST", 1)
    got = decontaminate.decontaminate(mapped, bench, carry=[F.col(f"`{c}`") for c in mapped.columns]).collect()
    assert check_contamination(rows, ITEMS, got) >= 5 and all(r.row.props == {"a": r.row.doc_id} for r in got)


def test_contamination_of_random_texts(spark):
    """Few different words, so that windows, rarest shingles and occurrences overlap in all ways."""
    import random

    r = random.Random(11)
    text = lambda most: " ".join(r.choice("abc") for _ in range(r.randint(0, most)))
    items = [(i % 40, text(18)) for i in range(60)]
    rows = [(i, text(60) + (" " + r.choice(items)[1]) * r.randint(0, 2)) for i in range(80)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert check_contamination(rows, items, got) >= 40


def test_contamination_is_by_the_words_themselves(spark):
    """Documents with a word that a polynomial hash confuses with an item's, alone and in windows."""
    rows = [(n + k, "a few words " + thue_morse(n, k).decode() + " and others", "en", "s", 1) for n in (64, 1024, 2048) for k in (0, 1)]
    items = [(n, thue_morse(n).decode()) for n in (64, 1024, 2048)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert check_contamination(rows, items, decontaminate.decontaminate(docs, bench).collect()) == 3


# ---- 8 ---------------------------------------------------------------------------------------------------------


def check_tokens(rows, got):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = sorted(((r[0] is not None, r[0] or 0, np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")) for r in rows), key=lambda x: (x[0], x[1], x[2].astype("<u2").tobytes()))
    want, start = [], 0
    for real, i, ids in coded:
        want.append((i if real else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[2])) == want


def test_units_that_hashes_confuse_have_their_own_ids(spark):
    """Words alike in a polynomial hash modulo 2^64, and units forced into one slot."""
    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.SLOTS = 1
    enc.forget()
    texts = [b"x " + thue_morse(n, k) + b" y" for n in (16, 1024, 2048) for k in (0, 1)] + [b"a b c d", b"d c b a", b"a b"]
    for _ in range(2):
        ids, off = enc.batch(*C.flat(pa.array(texts, pa.binary())))
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            assert ids[a:b].tolist() == [*enc.tok.encode(t.decode(), add_special_tokens=False).ids, 0]


def test_tokens(spark, sf, docs, rows, no_docs, table):
    check_tokens(rows, token_store.token_store(docs, shard_chars=2000).collect())
    check_tokens(table, token_store.token_store(C.table(spark, sf, "documents"), shard_chars=50_000).collect())
    assert token_store.token_store(no_docs).collect() == []


def test_units_encode_as_whole_texts_do():
    import random

    r, enc = random.Random(1), token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [" ", "  ", "\n", "\n\n", "\t", "a", "Z", "é", "ß", " ", "　", "\u0085", "12", "'s", "!", "<|endoftext|>", "中", "🙂", "\r\n", "ñ", "\x1c", "Ġ", " x", "\nq", " the"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 25))) for _ in range(1500)]
    ids, off = enc.batch(*C.flat(pa.array([t.encode() for t in texts], pa.binary())))
    for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
        assert ids[a:b].tolist() == [*enc.tok.encode(t, add_special_tokens=False).ids, 0]


def test_elias_fano():
    for n in (0, 1, 2, 700, 3000):
        v = np.sort(np.random.default_rng(n).integers(0, 50 * n + 1, n))
        ef = token_store.EliasFano.load(token_store.EliasFano.of(v).dump())
        assert ef.values(0, n + 1).tolist() == v.tolist() and [ef.select(i) for i in range(n)] == v.tolist()
        for a, b in ((0, 1), (511, 513), (512, 1024), (n // 3, n // 2), (n - 1, n)):
            assert ef.values(max(0, a), b).tolist() == v[max(0, a) : b].tolist()
        assert ef._samples is None or ef._samples.nbytes <= 8 * (1 + n // ef.EVERY)
    assert len(token_store.EliasFano.of(np.arange(0, 10**6, 100)).dump()) < 10_000 * 1.4  # bytes a document


def test_shards_give_single_documents(spark, rows, docs):
    folder = C.new_dir(spark, "tokens")
    files = token_store.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), shard_chars=1000).collect()
    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for f in files:
        s = token_store.Shard(folder, f.file)
        for k, i in enumerate(s.doc_ids()):
            if i is not None:
                assert s.ids(k).tolist() == [*enc.tok.encode(texts[i] or "", add_special_tokens=False).ids, 0]


# ---- 9 ---------------------------------------------------------------------------------------------------------


def check_mix(rows, got):
    size = defaultdict(int)
    for _, t, _, s, *_ in rows:
        size[s] += len(split(t))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped, target = sum(size.values()), set(), {}
    while True:
        left, free = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and 3 * size[s] * free <= left * weight[s]}
        if not over or over | capped == set(order):
            break
        capped |= over
    target = {s: float(3 * size[s]) if s in capped else left * weight[s] / max(free, 1) for s in order}
    taken = defaultdict(int)
    by = Counter((r[0], len(split(r[1])), r[3]) for r in rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        by[r.row.doc_id, r.size, r.source] -= 1
        taken[r.source] += r.taken
    assert not any(by.values())
    assert all(abs(taken[s] - target[s]) <= 3 for s in order if size[s])


def with_source(df, docs_rows):
    from pyspark.sql import functions as F

    return mixing.mix(df, carry=("doc_id", "source")).withColumn("source", F.col("row.source"))


def test_mix(spark, sf, docs, rows, no_docs, table):
    check_mix(rows, with_source(docs, rows).collect())
    df = C.table(spark, sf, "documents")
    first = with_source(df, table).collect()
    check_mix(table, first)
    same([tuple(r) for r in with_source(df.repartition(6), table).collect()], [tuple(r) for r in first])
    assert mixing.mix(no_docs).collect() == []


def test_nearest_subset():
    import itertools
    import random

    r = random.Random(6)
    for _ in range(300):
        sizes, goal = [r.randint(1, 30) for _ in range(r.randint(0, 9))], r.randint(0, 120)
        got = mixing.nearest_subset(sizes, goal)
        sums = {sum(x) for n in range(len(sizes) + 1) for x in itertools.combinations(sizes, n)}
        assert sorted(set(got)) == got and abs(sum(sizes[i] for i in got) - goal) == min(abs(x - goal) for x in sums)


# ---- 10 --------------------------------------------------------------------------------------------------------


def base_failed(text):
    w = (text or "").encode().split()
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(hit) > 20 * len(w)


def check_quality(rows, got):
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    same([(r.row.doc_id, *tuple(r)[2:8]) for r in got], want)


def test_quality(spark, sf, docs, rows, no_docs, table):
    got = quality.quality_rules(docs).collect()
    check_quality(rows, got)
    assert all(not (r.base_failed and r.kept) for r in got)
    check_quality(table, quality.quality_rules(C.table(spark, sf, "documents")).collect())
    assert quality.quality_rules(no_docs).collect() == []


def test_bad_hosts_lose_their_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, clean, "en", "good", 1) for i in range(60)] + [(100 + i, "too short", "en", "bad", 1) for i in range(60)] + [(300, clean, "en", "bad", 1), (301, "short", "en", "rare", 1), (302, clean, "en", "rare", 1)]
    got = {r.row.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[0] and not got[100] and not got[300] and not got[301] and got[302]
