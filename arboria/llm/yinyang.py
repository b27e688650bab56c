"""Centroid clustering with Yinyang bounds, in whole numbers [operator 13].

Vectors become integers (floor of a scale times each component), centroids too, so distances are exact and the result
does not depend on how rows are dealt out.  The first centroids are put into groups once.  A vector keeps its cluster,
an upper bound of the distance to its centroid and one lower bound a group, of the distances to all other centroids in
it.  After centroids have moved the bounds move with them, and a round looks at

    the vectors whose upper bound reaches one of their lower bounds           (global filter)
    of these, the groups whose lower bound the vector's best distance reaches (group filter)
    of these, all centroids, exactly; bounds of a scanned group are set anew

Bounds are rounded away from each other, so a vector that is passed over has its nearest centroid already, ties included.
A round is one pass: it reads the table of vectors and bounds that the last one wrote and writes the next; a task adds
its clusters' sums as rows of their own, and the driver gets one row a cluster and component.

Defined results: kept are vectors of exactly `dims` components, none of them null or not finite; others have no row.
Components beyond 2**27 in size after scaling count as 2**27, as squared distances have to fit a long.  Of equally
near centroids the one of smaller number is taken; a cluster without vectors keeps its centroid.  Vectors of equal id
are vectors of their own (as first centroids ordered by components); a null id counts as an empty one in the choice of
first centroids.  Fewer kept vectors than centroids make as many centroids as vectors; none make no rows.  Other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MOST = 1 << 27
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
STATE = "vec_id long, x binary, cluster int, upper double, lower binary, distance long, sums array<struct<cluster:int, n:long, s:array<long>>>"


def integers(batch: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Components of kept vectors as whole numbers, a row a vector."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):  # beyond double's range is beyond MOST
        return np.clip(np.floor(scale * flat), -MOST, MOST).astype(np.int32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * x.shape[1] < 1 << 25:  # no sum passes 2**53
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] + (cf * cf).sum(1) - 2 * xf @ cf.T).astype(np.int64)
    out, wide = np.empty((len(x), len(c)), np.int64), x.astype(np.int64)
    for j, row in enumerate(c.astype(np.int64)):
        out[:, j] = ((wide - row) ** 2).sum(1)
    return out


def own_distances(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - c[cluster].astype(np.int64)) ** 2).sum(1)


def grouped(c: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Each centroid's group: a few rounds of clustering the centroids themselves, from every len/groups-th of them."""
    middles = c[np.linspace(0, len(c) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(rounds):
        of = ((c[:, None, :] - middles[None]) ** 2).sum(2).argmin(1)
        for g in set(of.tolist()):
            middles[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray) -> int:
    """Moves every vector to its nearest centroid, in place, with its bounds; returns how many distances were computed."""
    some = np.flatnonzero(upper >= lower.min(1))
    own = own_distances(x[some], c, cluster[some])
    upper[some] = np.sqrt(own) * _UP
    still = upper[some] >= lower[some].min(1)
    some, own = some[still], own[still]
    seen, best, near = len(still), cluster[some].copy(), own.copy()
    scans = []
    for g in range(lower.shape[1]):
        rows = np.flatnonzero(lower[some, g] <= np.sqrt(near) * _UP)
        members = np.flatnonzero(group == g)
        d = distances(x[some[rows]], c[members])
        seen += d.size
        at = d.argmin(1)
        first = d[np.arange(len(rows)), at]
        d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        second = d.min(1)
        closer = (first < near[rows]) | ((first == near[rows]) & (members[at] < best[rows]))
        best[rows[closer]], near[rows[closer]] = members[at[closer]], first[closer]
        scans.append((g, rows, members[at], first, second))
    left = best != cluster[some]  # the centroid left is one of its group's others from now on
    was = group[cluster[some]]
    at = some[left]
    lower[at, was[left]] = np.minimum(lower[at, was[left]], np.sqrt(own[left]) * _DOWN)
    for g, rows, who, first, second in scans:
        others = np.where(who == best[rows], second, first)
        lower[some[rows], g] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others) * _DOWN)
    cluster[some], upper[some] = best, np.sqrt(near) * _UP
    return seen


def _sums(x: np.ndarray, cluster: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
    order = np.argsort(cluster, kind="stable")
    which, at = np.unique(cluster[order], return_index=True)
    if len(which):
        s[which] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
        n[which] += np.diff(np.append(at, len(order)))


def _pass(state: DataFrame, c: np.ndarray, group: np.ndarray, before: np.ndarray | None, dims: int, scale: int, last: bool) -> DataFrame:
    """The next table of vectors and bounds; before: the centroids that the bounds in `state` are about, none at first."""
    groups, k, first = int(group.max()) + 1, len(c), before is None
    moved = np.zeros(k) if first else np.sqrt(((c - before).astype(np.float64) ** 2).sum(1)) * _UP
    most = np.array([moved[group == g].max() for g in range(groups)])
    schema = pa.schema([
        ("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("distance", pa.int64()),
        ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))),
    ])

    def rows_of(a: np.ndarray) -> pa.Array:
        a = np.ascontiguousarray(a)
        ends = np.arange(len(a) + 1, dtype=np.int32) * (a.itemsize * a.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(a)])

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                x = integers(batch.column(1), dims, scale)
                cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), groups))
            else:
                x = np.frombuffer(C.flat(batch.column(1))[0], np.int32).reshape(-1, dims)
                cluster = batch.column(2).to_numpy().copy()
                upper = batch.column(3).to_numpy() * _UP + moved[cluster]
                lower = np.maximum(np.frombuffer(C.flat(batch.column(4))[0], np.float64).reshape(-1, groups) * _DOWN - most, 0)
            assign(x, cluster, upper, lower, c, group)
            own = pa.array(own_distances(x, c, cluster)) if last else pa.nulls(len(x), pa.int64())
            _sums(x, cluster, n, s)
            none = pa.nulls(len(x), schema.field("sums").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows_of(x), pa.array(cluster), pa.array(upper), rows_of(lower), own, none], schema=schema)
        added = [{"cluster": j, "n": int(n[j]), "s": s[j].tolist()} for j in np.flatnonzero(n).tolist()]
        if added:
            yield pa.RecordBatch.from_pylist([{"sums": added}], schema=schema)

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floors of the means of all clusters; those without vectors stay."""
    rows = state.where("cluster IS NULL").select(F.explode("sums").alias("t")).select("t.cluster", "t.n", F.posexplode("t.s").alias("i", "v"))
    out = c.copy()
    for r in rows.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.i] = int(r.v) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, groups: int | None = None, dims: int = 64, scale: int = 256, seed: int = 2):
    """(vec_id, cluster, distance) of every kept vector, and the final centroids (k x dims whole numbers).

    groups: the number of groups of centroids, a tenth of the centroids where not given.
    """
    e = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size(e) == dims) & ~F.exists(e, odd))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "embedding").limit(k).select("embedding").toArrow().column(0).combine_chunks()
    c = integers(first, dims, scale) if len(first) else np.zeros((0, dims), np.int32)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), c
    group, before, state = grouped(c.astype(np.float64), min(len(c), groups or max(1, len(c) // 10))), None, kept
    for r in range(rounds + 1):
        done = C.stash(_pass(state, c, group, before, dims, scale, last=r == rounds), "vectors")
        if r:
            C.drop(table)
        table, state = done, done.where("cluster IS NOT NULL")
        if r < rounds:
            before, c = c, _moved(done, c)
    return state.select("vec_id", "cluster", "distance"), c


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = cluster(C.table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    facts = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_D, _K, _ROUNDS = 64, 40, 5


def _round_sql(r: int) -> str:
    """Assignment to the centroids c{r} and, from it, the centroids c{r+1}."""
    near = f"""a{r} AS MATERIALIZED (SELECT v.rid, min_by(c.j, c.far * 64 + c.j) AS j, min(c.far) AS far FROM v, LATERAL (
  SELECT j, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM c{r}) c GROUP BY v.rid)"""
    if r == _ROUNDS:
        return near
    return f"""{near},
s{r} AS (SELECT j, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (rid), range(1, {_D + 1}) AS t(i) GROUP BY j, i),
m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (j))"""


ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {_D} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS j, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {_K}),
{reduce(lambda a, r: f"{a}{',' if a else ''}{chr(10)}{_round_sql(r)}", range(_ROUNDS + 1), "")}
SELECT vec_id, a{_ROUNDS}.j AS cluster, far AS distance, (sum(far) OVER (PARTITION BY a{_ROUNDS}.j))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{_ROUNDS}.x, ',')) AS centroid_sha256
FROM a{_ROUNDS} JOIN v USING (rid) JOIN c{_ROUNDS} ON c{_ROUNDS}.j = a{_ROUNDS}.j"""
