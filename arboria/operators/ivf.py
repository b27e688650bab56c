"""Vector search by inverted lists: near centroids first, the vectors in their lists then compared exactly.

Centroids are fitted on the driver from a sample of SAMPLE vectors a list, drawn by a hash of the id, so its size follows
the number of lists (the root of the number of vectors, MOST_LISTS at most).  Every vector is assigned to a list.  A query
looks at the `probes` nearest lists; each list is cut into blocks of vectors and of queries, so that one large list, or
one that many queries look at, is many small tasks.  Vectors that are missing, without length or of another size than most
have a list of their own, which every query looks at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources import work
from . import matching

MOST_LISTS, SAMPLE = 1024, 32
#: Vectors and queries that meet in one task.
VECTORS, QUERIES = 20_000, 2_000
_CELLS = 1 << 20
#: The list of vectors that no centroid is near to.
ODD = -1


def fitted(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; the first are spread over the sample, one that loses all its vectors takes the worst placed."""
    c = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = sample @ c.T
        at = near.argmax(1)
        worst = np.argsort(near[np.arange(len(sample)), at])
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        total[n == 0] = sample[worst[: int((n == 0).sum())]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers of the given size, at unit length, and which rows they are."""
    rows = column.to_pylist()
    some = [i for i, v in enumerate(rows) if v is not None and len(v) == size and None not in v]
    x = np.array([rows[i] for i in some], np.float64).reshape(len(some), size)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], np.array(some, np.int64)[good]


@dataclass
class Index:
    centroids: np.ndarray
    #: list, id, embedding of every vector.
    table: DataFrame
    #: Lists that a query looks at where not told otherwise.
    probes: int = 1

    def _lists(self, column: str, probes: int):
        """The nearest lists of a vector, nearest first."""
        c = self.centroids

        def run(vectors: pa.Array) -> pa.Array:
            out: list[list[int]] = [[ODD]] * len(vectors)
            step = max(1, _CELLS // max(1, len(c)))
            for a in range(0, len(vectors), step):
                x, some = _units(vectors.slice(a, step), c.shape[1])
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes] if len(c) else np.zeros((len(x), 0), int)
                for i, row in zip(some.tolist(), near.tolist(), strict=True):
                    out[a + i] = row
            return pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>")(F.col(column))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, cosine, rank: of the vectors in the nearest lists the k nearest to each query (query_id, query_embedding), itself left out.

        A query without a usable vector has cosine 0 with all; it looks at the odd list alone.
        """
        probes = probes or self.probes
        asked = queries.where("query_id is not null").select("query_id", "query_embedding", F.col("query_id").cast(self.table.schema["id"].dataType).alias("own"))
        asked = asked.withColumn("list", F.explode(F.array_distinct(F.concat(self._lists("query_embedding", probes), F.array(F.lit(ODD))))))
        sizes = {r.list: r.n for r in self.table.groupBy("list").agg(F.count("*").alias("n")).collect()}
        wanted = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
        cuts = [(x, -(-n // VECTORS), -(-wanted[x] // QUERIES)) for x, n in sizes.items() if x in wanted]
        cuts = F.broadcast(work.of_driver(queries.sparkSession, cuts, "list int, vs int, qs int"))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        vectors = self.table.join(cuts, "list").select("list", part("id", "vs").alias("v"), every("qs").alias("q"), "id", "embedding")
        sides = asked.join(cuts, "list").select("list", every("vs").alias("v"), part("query_id", "qs").alias("q"), "query_id", "query_embedding", "own")

        def near(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("id")
            ids, vs = left.column("id").to_pylist(), left.column("embedding")
            block = matching.Vectors(right.column("own").to_pylist(), right.column("query_embedding").to_pylist())
            best, step = matching.Kept(block.n, k), max(1, _CELLS // max(1, block.n))
            for a in range(0, len(ids), step):
                best.add(ids[a : a + step], np.nan_to_num(matching.cosines(vs.slice(a, step).to_pylist(), block.vectors), nan=0.0), block.own)
            j, i, cosine = best.rows()
            return pa.table({"query_id": right.column("query_id").take(pa.array(j, pa.int64())), "id": pa.array(i, left.schema.field("id").type), "cosine": pa.array(cosine, pa.float64())})

        schema = StructType([queries.schema["query_id"], self.table.schema["id"], StructField("cosine", DoubleType())])
        keys = ["list", "v", "q"]
        found = vectors.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(near, schema)
        order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, target: float, most: int = 500) -> int:
    """The fewest lists in which `target` of the k nearest of sampled vectors lie, as the sample itself tells."""
    if len(sample) < 2:
        return 1
    asked = np.linspace(0, len(sample) - 1, min(most, len(sample))).astype(int)
    cosine = sample[asked] @ sample.T
    cosine[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[asked] @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    lists = (sample @ c.T).argmax(1)
    needed = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def build(vectors: DataFrame, keep, lists: int | None = None, k: int = 10, target: float = 0.95) -> Index:
    """An index of vectors (id, embedding); rows without id are left out.  keep(df, name) writes a table and reads it again.

    k, target: a query looks at so many lists that this share of the k nearest is found, by the sample.
    """
    given = vectors.where("id is not null").select("id", "embedding")
    sizes = given.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).where("size > 0").orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return Index(np.zeros((0, 1)), keep(given.select(F.lit(ODD).alias("list"), "id", "embedding"), "lists"))
    lists = max(1, min(MOST_LISTS, lists or int(sizes.n**0.5)))
    drawn = given.where(F.size("embedding") == sizes.size).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE * lists).select("embedding").toArrow()
    sample, _ = _units(drawn.column(0).combine_chunks(), sizes.size)
    out = Index(fitted(sample, min(lists, len(sample))) if len(sample) else np.zeros((0, sizes.size)), given)
    out.probes = probes_for(sample, out.centroids, k, target) if len(sample) else 1
    out.table = keep(given.withColumn("list", out._lists("embedding", 1)[0]).select("list", "id", "embedding"), "lists")
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, id) pairs that were found."""
    n = exact.count()
    return exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0
