"""Embeddings: hash vectors, the vector cache, two-dimensional projection."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

_TOKEN = re.compile(r"[\w']+")


def hash_vector(text: str, size: int = K.EMBEDDING_SIZE) -> np.ndarray:
    """Each token's 32 digest bytes give sixteen signed slots; longer tokens weigh more; unit length."""
    out = np.zeros(size)
    low = text.lower()
    for token in _TOKEN.findall(low) or [low]:
        digest = np.frombuffer(hashlib.blake2b(token.encode(), digest_size=32).digest(), ">u2").astype(np.int64)
        np.add.at(out, digest % size, np.where((digest >> 8) & 1, 1.0, -1.0) * (1.0 + min(len(token), 32) / 32.0))
    return out / (np.linalg.norm(out) or 1.0)


#: Tokens of which a worker keeps what they add; then its memory begins anew.
REMEMBERED = 1 << 16


def hash_vectors(texts: list[str], size: int = K.EMBEDDING_SIZE, known: dict | None = None) -> np.ndarray:
    """hash_vector() of each text: a distinct token is hashed once (known: token -> slots and signed weights), and counted.

    Weights are multiples of 1/32, so sums are exact in whatever order they are made.
    """
    known = {} if known is None else known
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        low = text.lower()
        counts = Counter(_TOKEN.findall(low) or [low])
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [t for t in counts if t not in known]
        if fresh:
            digest = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=32).digest() for t in fresh), ">u2").astype(np.int64).reshape(len(fresh), 16)
            weight = 1.0 + np.minimum(np.fromiter(map(len, fresh), np.int64, len(fresh)), 32) / 32.0
            slots, signed = (digest % size).astype(np.int16 if size < 1 << 15 else np.int64), np.where((digest >> 8) & 1, weight[:, None], -weight[:, None])
            known.update(zip(fresh, zip(slots, signed.astype(np.float32), strict=True), strict=True))
        parts = [known[t] for t in counts]
        times = np.fromiter(counts.values(), np.float64, len(counts))
        slots, signed = (np.concatenate(x).reshape(len(parts), 16) for x in zip(*parts, strict=True))
        row += np.bincount(slots.ravel(), weights=(signed * times[:, None]).ravel(), minlength=size)
        row /= np.linalg.norm(row) or 1.0
    return out


def hash_embedding(text: Column | str, size: int = K.EMBEDDING_SIZE) -> Column:
    """In pieces of Arrow batches; a blank text is embedded as 'empty concept'."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for texts in batches:
            parts = []
            for a in range(0, len(texts), 512):
                some = hash_vectors([t if t and t.strip() else "empty concept" for t in texts.slice(a, 512).to_pylist()], size, known)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), pa.array(some.ravel())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run(T.col(text))


def model_embedding(load, size: int = 256):
    """An embedder by a model: load() is called once a worker and gives a function of a list of texts to their vectors.

    Texts reach it in lists of `size`; a blank text is embedded as 'empty concept'.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            whole = [t if t and t.strip() else "empty concept" for t in texts]
            yield pd.Series([np.asarray(v, np.float64).tolist() for a in range(0, len(whole), size) for v in model(whole[a : a + size])])

    return lambda text: run(T.col(text))


def embedded(rows: DataFrame, cache: DataFrame | None = None, embedder=hash_embedding) -> tuple[DataFrame, DataFrame]:
    """rows (with embed_text) with their embedding, and the new cache rows (text_sha1, vector).

    Only distinct texts that the cache lacks reach the embedder.
    """
    keyed = rows.withColumn("text_sha1", F.sha1(F.col("embed_text").cast("binary")))
    wanted = keyed.select("text_sha1", "embed_text").dropDuplicates(["text_sha1"])
    missing = wanted if cache is None else wanted.join(cache, "text_sha1", "left_anti")
    fresh = missing.select("text_sha1", embedder("embed_text").alias("vector"))
    every = fresh if cache is None else fresh.unionByName(cache)
    return keyed.join(every, "text_sha1", "left").withColumnRenamed("vector", "embedding").drop("text_sha1"), fresh


def projected(vectors: DataFrame, key: str = "id") -> DataFrame:
    """x, y in [-1, 1]: the first two principal components, centred, over their greatest absolute value.

    The sign of a component makes its largest loading positive.  One vector lies at 0, 0; vectors without spread lie on
    a circle in order of key.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    if n <= 1:
        return vectors.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rows = vectors.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="pc").fit(rows)
    loads = model.pc.toArray()
    sign = [1.0 if loads[np.argmax(np.abs(loads[:, k])), k] >= 0 else -1.0 for k in (0, 1)]
    pc = vector_to_array("pc")
    points = model.transform(rows).select(key, (pc[0] * sign[0]).alias("a"), (pc[1] * sign[1]).alias("b"))
    ma, mb, la, ha, lb, hb = points.agg(F.avg("a"), F.avg("b"), F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    most = max(ma - la, ha - ma, mb - lb, hb - mb)
    if most <= 1e-12:
        from pyspark.sql import Window

        turn = F.lit(2 * math.pi) * (F.row_number().over(Window.orderBy(key)) - 1) / n
        return vectors.select(key, (0.65 * F.cos(turn)).alias("x"), (0.65 * F.sin(turn)).alias("y"))
    inside = lambda c, m: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col(c) - m) / most))
    return points.select(key, inside("a", ma).alias("x"), inside("b", mb).alias("y"))


def embedding_text(title: Column, node_type: Column, rel: Column, signature: Column, doc: Column, summary: Column) -> Column:
    """Title; type and place; signature and documentation, or the summary where there is neither."""
    bare = F.regexp_replace(rel, r"(?<=[^/])\.[^./]+$", "")
    place = F.when(F.coalesce(rel, F.lit("")) != "", F.concat(node_type, F.lit(" in "), bare))
    sign, docs = F.nullif(F.trim(signature), F.lit("")), F.nullif(F.trim(doc), F.lit(""))
    rest = F.when(sign.isNull() & docs.isNull(), F.nullif(F.trim(summary), F.lit("")))
    return F.concat_ws("\n", title, place, sign, docs, rest)
