"""Conversation tries, the token automaton and centroid clustering against plain computations, on awkward rows."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arboria.llm import bpe, prefix_trie, yinyang
from arboria.llm import common as C

# ---- conversations ---------------------------------------------------------------------------------------------


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    smallest = {p: min(c for c, _ in m) for p, m in members.items()}
    sha = lambda p: hashlib.sha256(",".join(str(c) for c, end in sorted(members[p]) if end).encode()).hexdigest()
    return [(smallest[p], len(p), smallest[p[:-1]] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(p)) for p in members]


def talks():
    rng = random.Random(11)
    rows = []
    for c in [*range(-3, 60), *range(95, 260), 305, 7_000_000_001]:
        if c % 3 == 0:  # copies of one conversation
            rows += [(c, t, "user", f"hot {t}") for t in range(7)]
        elif c % 3 == 1:  # a frequent beginning
            rows += [(c, t, "user" if t % 2 else "assistant", f"m{t}" if t < 3 else f"über {rng.randrange(4)} 🙂") for t in range(rng.randrange(1, 9))]
        else:
            rows += [(c, t, "user", f"{c % 7}") for t in range(rng.randrange(1, 4))]
    rows += [(12, None, None, "no number"), (12, 3, None, None), (12, 3, "user", None), (12, 3, "user", None), (13, 0, "", ""), (None, 1, "user", "no conversation"), (14, 2, "user", "x" * 70_000)]
    rows += [(500, t, "user", f"long {t}") for t in range(2500)] + [(501, t, "user", f"long {t}") for t in range(2400)]
    return rows


@pytest.mark.parametrize("sizes", [(1 << 17, 1 << 20, 64), (50, 40, 3)])
def test_trie_of_awkward_conversations(spark, sizes, monkeypatch):
    if sizes[0] == 50:  # blocks of few turns merge in several levels, ids come in pieces, tables are not broadcast
        monkeypatch.setattr(C, "small", lambda stashed, *_: stashed)
    rows = talks()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, path string, base string, t string")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df.repartition(7)), *sizes)
    assert got.columns == prefix_trie.NODE
    assert Counter(map(tuple, got.collect())) == Counter(plain_trie(rows))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(df)).collect() == []
    df = spark.createDataFrame([(150, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    h = zlib.crc32(b"150") % 6
    assert h > 0  # its hundred's first conversation is not there, its own turn is replaced: only the root is left
    assert list(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(df)).collect())) == plain_trie([(150, 0, "user", "gone")])


def test_louds_bits_give_the_parents():
    paths = sorted({bytes(16 * [a]) + bytes(16 * [b]) * k for a in range(5) for b in range(4) for k in range(3)} | {b""})
    tree = prefix_trie.Louds(paths, np.zeros(sum(len(p) // 16 for p in paths), np.int64))
    nodes = sorted({p[: 16 * d] for p in paths for d in range(len(p) // 16 + 1)}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(nodes)}
    assert tree.parents().tolist() == [number[p[:-16]] if p else -1 for p in nodes]
    assert tree.depth.tolist() == [len(p) // 16 for p in nodes]
    assert [x.tobytes() for x in tree.labels] == [p[-16:] for p in nodes[1:]]


# ---- tokens ----------------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def auto():
    return bpe.automaton(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


ODD = ["", "  ", "a  <|endoftext|> b <|endoftext|><|endoftext|>x\n\n<|endoftext|>", " <|endoftext", "é <|endoftext|>\n中 a", "x" * 30_000, " " * 5000 + "y", "日本語テキスト" * 400, "🙂‍👩‍👩‍👧" * 50, "\r\n\t\x1c\x85  a'sB'LL d'd", "ab  cd", "́a é", "١٢٣ ½Ⅷ"]


def test_automaton_encodes_as_the_library(spark, auto, library, docs, rows, no_docs):
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    coded = bpe.encode(docs.select("doc_id", "text").unionByName(odd), auto).withColumn("back", bpe.decoded(spark, auto)).withColumn("sha", bpe.decimal_sha256(auto.dtype))
    want = []
    for i, t in [(r[0], r[1]) for r in rows] + [(100 + i, t) for i, t in enumerate(ODD)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, np.frombuffer(r.ids, auto.dtype).tolist(), r.back, r.sha) for r in coded.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    assert [r.columns for r in [bpe.encode(docs, auto)]] == [["doc_id", "ids"]] and bpe.encode(no_docs, auto).collect() == []


def test_automaton_on_random_texts(auto, library):
    rng, enc = random.Random(5), bpe.WordEncoder(auto)
    pieces = [library.decode([i]) for i in rng.sample(range(50_000), 400)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += ["".join(rng.choice("abcéß中 \n'.,0🙂") for _ in range(rng.randrange(200))) for _ in range(400)] + [chr(c) for c in range(0xD7FF)][::97] + [f"a{chr(c)}b {chr(c)}" for c in range(0x3100)][::7]
    raw = [t.encode() for t in texts]
    ids, at = enc.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_automaton_decodes_any_ids(spark, auto, library):
    rng = random.Random(6)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(40))] for _ in range(300)] + [[]]
    df = spark.createDataFrame([(i, bytearray(np.array(x, auto.dtype).tobytes())) for i, x in enumerate(lists)], "i int, ids binary")
    got = {r.i: r.t for r in df.select("i", bpe.decoded(spark, auto).alias("t")).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def small_vocabulary(merges):
    chars = sorted(bpe._byte_chars(), key=bpe._byte_chars().get)
    vocab = {c: i for i, c in enumerate([*chars, *("".join(m) for m in merges)])}
    return {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}


def merged(word, merges):
    """The ids' texts of a word by the merges, one rule after another, from the left."""
    parts = list(word)
    for u, v in merges:
        out = []
        for p in parts:
            if out and out[-1] == u and p == v:
                out[-1] = u + v
            else:
                out.append(p)
        parts = out
    return parts


def test_gadgets_against_merging_on_random_vocabularies():
    rng = random.Random(7)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                tokens.append(u + v)
                merges.append([u, v])
        spec = small_vocabulary(merges)
        auto, text = bpe.Automaton(spec), {i: t for t, i in spec["model"]["vocab"].items()}
        for _ in range(120):
            word = "".join(rng.choice("aabc") for _ in range(rng.randrange(1, 130)))
            ids, n = auto.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
            assert [text[i] for i in ids.tolist()] == merged(word, merges), (word, merges)


def test_other_vocabularies_are_refused():
    spec = small_vocabulary([["a", "b"], ["ab", "c"]])
    bpe.Automaton(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": [["ab", "c"], ["a", "b"]]}}, {"model": spec["model"] | {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            bpe.Automaton(json.loads(json.dumps(spec | change)))


def test_tables_stay_small(auto):
    assert auto.lacks.nbytes + auto.bits.nbytes + auto.first.nbytes < 32 << 20


# ---- clusters --------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=256, seed=2):
    keep = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [max(-yinyang.MOST, min(yinyang.MOST, math.floor(scale * x))) for x in v]) for i, v in keep]
    order = sorted(range(len(keep)), key=lambda n: (hashlib.sha256(f"{seed}:{'' if keep[n][0] is None else keep[n][0]}".encode()).hexdigest(), keep[n][1]))
    c = [whole[n][1] for n in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in whole]  # noqa: B023
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(whole, at, strict=True) if a == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, a, far(v, c[a])) for (i, v), a in zip(whole, at, strict=True)], c


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dims))
    out = [(i, (middles[i % 9] * 0.3 + rng.normal(size=dims) * 0.2).astype(np.float32).tolist()) for i in range(n)]
    out += [(7, [0.5] * dims)] * 40 + [(i, [0.25, -0.25] * (dims // 2)) for i in range(900, 960)]  # repeated rows, a hot vector
    out += [(None, [0.125] * dims), (1000, None), (1001, [0.1] * (dims - 1)), (1002, [0.1] * (dims - 1) + [None]), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims), (1005, []), (1006, [-3e38] * dims), (1007, [0.5 + 2**-20] * dims)]
    return out


@pytest.mark.parametrize(("n", "k", "groups", "rounds"), [(400, 40, None, 5), (300, 17, 5, 3), (60, 40, 40, 4), (120, 1, 1, 2), (80, 7, 2, 0)])
def test_clusters_are_exact(spark, n, k, groups, rounds):
    rows = vectors(n, 8, n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, x string")
    got, c = yinyang.cluster(df.repartition(5), k, rounds, groups, dims=8)
    want, centroids = plain_clusters(rows, k, rounds, 8)
    assert c.tolist() == centroids
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, c = yinyang.cluster(df, 40, 5, dims=2)
    want, centroids = plain_clusters(rows, 40, 5, 2)
    assert c.tolist() == centroids and Counter(map(tuple, got.collect())) == Counter(want)
    got, c = yinyang.cluster(df, 40, 5, dims=64)
    assert got.collect() == [] and len(c) == 0


def test_bounds_pass_over_most_distances():
    rng = np.random.default_rng(3)
    middles = rng.integers(-900, 900, (40, 16))
    x = (middles[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int32)
    c = x[:40].copy()
    group = yinyang.grouped(c.astype(np.float64), 4)
    cluster, upper, lower, seen = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), 4)), []
    for _ in range(6):
        seen.append(yinyang.assign(x, cluster, upper, lower, c, group))
        assert (cluster == yinyang.distances(x, c).argmin(1)).all()
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)], np.int32)
        moved = np.sqrt(((new - c).astype(float) ** 2).sum(1))
        upper, lower, c = upper + moved[cluster] * 1.0001, lower - np.array([moved[group == g].max() for g in range(group.max() + 1)]) * 1.0001, new
    assert seen[0] >= 40 * len(x) and seen[-1] < seen[0] / 3


def test_query_columns(spark, sf):
    out = yinyang.op13_yinyang(spark, sf)
    assert out.agg(F.countDistinct("inertia")).first()[0] == 1
    per = out.groupBy("cluster").agg(F.sum("distance").alias("s"), F.max("cluster_inertia").alias("c")).collect()
    assert all(r.s == r.c for r in per) and sum(r.s for r in per) == out.first().inertia


def test_automaton_encoder_begins_and_begins_anew(auto, library):
    """The encoder is made with an empty memory of units, and gives the same ids from an empty one, a full one and one given up."""
    enc, texts = bpe.WordEncoder(auto), ["one unit, one unit", "", "été 🙂 " * 3, "x" * 200]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for again in (True, False, True):
        ids, at = enc.documents(buf, off)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        if again:
            enc.forget()
            assert enc.used == 0 and not enc.long
