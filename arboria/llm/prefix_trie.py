"""The trie of conversations' prefixes, from succinct level-order tries of prefix shards [operator 11].

A turn is known by 128 bits of its role's and text's digest, a conversation by the sequence of its turns' digests.
Conversations are dealt out in the order of these sequences (then of their ids), so a shard holds neighbouring prefixes,
and a very frequent prefix, or many copies of one conversation, spread over as many shards as they fill.  A task reads its
range in blocks of about BLOCK turns.  Of each block numpy builds a level-order trie (LOUDS bits, labels, code points)
and adds up from the last level to the first, by add.at over the parents that the bits give.

All nodes of a block are whole but those on its first and its last path, which other blocks may share: their sums so far
go on as two rows.  These heavy upper levels merge separately, in the same way, in ever fewer blocks until one is left.
Ids of conversations that end at a node are hashed in their order where they lie in one block; what a range's border
cuts, or what passes PIECE bytes, goes on in pieces of the ids' text, and is hashed in the order of the pieces.

Defined results: rows without conv_id belong to no conversation and are left out; null role and text are empty.  Turns
of one number are ordered by their digests (null numbers first), repeated rows are turns of their own.  Other columns are
ignored.  An empty table gives no rows.  A conversation's digests (36 bytes a turn, without texts) stand in one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

KEY = 16
BLOCK = 1 << 17
PIECE = 1 << 20
#: Fewest paths of a block: of longer paths too, the upper levels get fewer from merge to merge.
PATHS = 64
EMPTY = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max
#: What is summed up a node: members, smallest member, children, childless nodes, saved tokens.
_N, _MIN, _KIDS, _LEAVES, _SAVED = range(5)
#: Stands for a hash that is still to be put together from pieces.
OPEN = "?"

OUT = """kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string,
own binary, parent binary, path binary, sums binary, hashes array<string>, first long, ids binary"""
_SCHEMA = pa.schema([
    ("kind", pa.string()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()),
    *((c, pa.binary()) for c in ("own", "parent", "path", "sums")), ("hashes", pa.list_(pa.string())), ("first", pa.int64()), ("ids", pa.binary()),
])
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _table(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def prefix_digests(path: bytes) -> list[bytes]:
    """Digests of the path's prefixes of 0, 1, ... turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for k in range(0, len(path), KEY):
        h.update(path[k : k + KEY])
        out.append(h.copy().digest())
    return out


class Louds:
    """Level-order trie of sorted paths: bits (a node's children in unary), labels and code points in level order."""

    def __init__(self, paths: list[bytes], chars: np.ndarray):
        lens = np.array([len(p) // KEY for p in paths], np.int64)
        keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, KEY // 8)
        off = np.cumsum(lens) - lens
        shared, some, d = np.zeros(len(paths), np.int64), np.arange(1, len(paths)), 0
        while len(some):  # turns that a path has in common with the one before
            some = some[(lens[some] > d) & (lens[some - 1] > d)]
            some = some[(keys[off[some] + d] == keys[off[some - 1] + d]).all(1)]
            shared[some] = d = d + 1
        new = lens - shared
        self.lens, self.shared, self.made = lens, shared, np.cumsum(new)
        of = np.repeat(np.arange(len(paths)), new)
        depth = np.arange(len(of)) - np.repeat(self.made - new, new) + shared[of] + 1
        depth, at = np.concatenate([[0], depth]), off[of] + depth - 1
        self.order = np.argsort(depth, kind="stable")  # nodes were made in preorder
        self.depth = depth[self.order]
        self.starts = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))
        self.labels, self.chars = keys[at[self.order[1:] - 1]], np.concatenate([[0], chars[at[self.order[1:] - 1]]])
        m = len(depth)
        degree = np.zeros(m, np.int64)
        for d in range(1, len(self.starts) - 1):
            up, a, b = self.starts[d - 1 : d + 2]
            degree[up:a] = np.bincount(np.searchsorted(self.order[up:a], self.order[a:b]) - 1, minlength=a - up)
        bits = np.ones(2 * m + 1, np.uint8)
        bits[1], bits[2 + np.cumsum(degree) + np.arange(m)] = 0, 0
        self.bits = np.packbits(bits)

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 of the root: the zeros before its one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * len(self.depth) + 1))
        return ones - np.arange(len(ones)) - 1

    def nodes(self, path: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The nodes at a depth of paths."""
        out = np.empty(len(path), np.int64)
        by = np.argsort(depth, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(depth[by])) + 1) if len(by) else []:
            a, b = self.starts[depth[some[0]] : depth[some[0]] + 2]
            out[some] = a + np.searchsorted(self.order[a:b], self.made[path[some]], "right") - 1
        return out

    def spine(self, path: int) -> np.ndarray:
        d = np.arange(self.lens[path] + 1)
        return self.nodes(np.full(len(d), path), d)

    def add_up(self, sums: np.ndarray, parent: np.ndarray, shared: np.ndarray) -> None:
        """Sums of all nodes but the shared ones go to their parents, last level first."""
        for d in range(len(self.starts) - 2, -1, -1):
            v = np.arange(self.starts[d], self.starts[d + 1])
            v = v[~shared[v]]
            sums[_LEAVES, v] += sums[_KIDS, v] == 0
            sums[_SAVED, v] += (sums[_N, v] - 1) * self.chars[v]
            if d:
                up = parent[v]
                for k in (_N, _LEAVES, _SAVED):
                    np.add.at(sums[k], up, sums[k, v])
                np.add.at(sums[_KIDS], up, 1)
                np.minimum.at(sums[_MIN], up, sums[_MIN, v])


def block(paths: list[bytes], chars: np.ndarray, path: np.ndarray, depth: np.ndarray, values: np.ndarray, hashes: list, upper: bool, last: bool):
    """Rows of a block.  values (5 x n) and hashes belong to the nodes at `depth` of `path`; last: nothing is shared."""
    tree = Louds(paths, chars)
    m, parent = len(tree.depth), tree.parents()
    sums = np.zeros((5, m), np.int64)
    sums[_MIN] = _NONE
    at = tree.nodes(path, depth)
    for k in (_N, _KIDS, _LEAVES, _SAVED):
        np.add.at(sums[k], at, values[k])
    np.minimum.at(sums[_MIN], at, values[_MIN])
    ends = dict(p for p in zip(at.tolist(), hashes, strict=True) if p[1])
    shared, digest, own = np.zeros(m, bool), {}, [None] * m
    if upper:
        for i, p in enumerate(paths):
            some = tree.spine(i)
            for v, x in zip(some.tolist(), prefix_digests(p), strict=True):
                own[v] = x
    sides = [] if last else [(0, tree.spine(0))] + ([(len(paths) - 1, tree.spine(len(paths) - 1))] if len(paths) > 1 else [])
    for i, some in sides:
        shared[some] = True
        digest |= zip(some.tolist(), prefix_digests(paths[i]), strict=True)
    tree.add_up(sums, parent, shared)
    done = np.flatnonzero(~shared)
    for v in done.tolist() if not upper else []:
        if ends.get(v) == OPEN:
            own[v] = C.digest(paths[path[np.flatnonzero(at == v)[0]]])
    if len(done):
        up = parent[done]
        out = shared[up] & (up >= 0)
        above = np.where(up < 0, _NONE, sums[_MIN, up])
        yield _table(
            len(done), kind=["node"] * len(done), conv_id=sums[_MIN, done], depth=tree.depth[done], n_convs=sums[_N, done], n_children=sums[_KIDS, done],
            n_leaves=sums[_LEAVES, done], saved_tokens=sums[_SAVED, done], parent_conv_id=pa.array(above, mask=out | (up < 0)),
            ends_sha256=[ends.get(v, EMPTY) for v in done.tolist()], own=[own[v] for v in done.tolist()],
            parent=[digest[p] if o else None for p, o in zip(up.tolist(), out.tolist(), strict=True)],
        )
    told: set[int] = set()
    for i, some in sides:  # a node on both sides is told of once
        mine = np.array([v not in told for v in some.tolist()])
        told |= set(some.tolist())
        blank = np.array([0, _NONE, 0, 0, 0])[:, None]
        packed = np.concatenate([tree.chars[some][None], np.where(mine, sums[:, some], blank)])
        yield _table(1, kind=["spine"], path=[paths[i]], sums=[packed.tobytes()], hashes=[[ends.get(v) if x else None for v, x in zip(some.tolist(), mine.tolist(), strict=True)]])


def _lowest(block_turns: int, piece_bytes: int, fewest: int):
    """Blocks of a range of conversations, sorted by path and id."""

    def run(batches):
        paths, chars, values, hashes, turns = [], [], [], [], 0
        now, ids, size, n, low, opened, first = None, [], 0, 0, 0, True, 0

        def piece():
            return _table(1, kind=["ids"], own=[C.digest(now)], first=[first], ids=[",".join(ids).encode()])

        def close(border: bool):
            """The path `now` is whole, or ends with the range; ids not yet sent on are hashed, or sent."""
            nonlocal turns
            if opened or border:
                if ids:
                    yield piece()
                hashes.append(OPEN)
            else:
                hashes.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            paths.append(now)
            values.append((n, low))
            turns += len(now) // KEY

        def build():
            nonlocal turns
            count = np.array(values, np.int64).reshape(-1, 2)
            v = np.zeros((5, len(paths)), np.int64)
            v[_N], v[_MIN] = count.T
            yield from block(paths, np.concatenate(chars) if chars else np.zeros(0, np.int64), np.arange(len(paths)), np.array([len(p) // KEY for p in paths]), v, hashes, False, False)
            for x in (paths, chars, values, hashes):
                x.clear()
            turns = 0

        for batch in batches:
            flat, at = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            ends = np.cumsum(at)
            for k, (conv, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if path != now:
                    if now is not None:
                        yield from close(False)
                        if turns >= block_turns and len(paths) >= fewest:
                            yield from build()
                    chars.append(flat[ends[k] - at[k] : ends[k]].astype(np.int64))
                    opened, now, ids, size, n, low = now is None, path, [], 0, 0, conv
                if not ids:
                    first = conv
                ids.append(str(conv))
                size, n = size + len(ids[-1]) + 1, n + 1
                if size >= piece_bytes:
                    yield piece()
                    opened, ids, size = True, [], 0
        if now is not None:
            yield from close(True)
            yield from build()
        C.tidy()

    return run


def _merging(last: bool, block_turns: int, fewest: int):
    """Blocks of the upper levels: rows of paths with what is known of the nodes on them."""

    def run(batches):
        rows, turns = [], 0

        def build():
            packed = [np.frombuffer(s, np.int64).reshape(6, -1) for _, s, _ in rows]
            lens = [p.shape[1] for p in packed]
            every = np.concatenate(packed, axis=1)
            text = np.concatenate([p[0, 1:] for p in packed])
            yield from block([p for p, _, _ in rows], text, np.repeat(np.arange(len(rows)), lens), np.concatenate([np.arange(x) for x in lens]), every[1:], [h for _, _, x in rows for h in x], True, last)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                turns += len(row[0]) // KEY
                if not last and turns >= block_turns and len(rows) >= fewest:
                    yield from build()
                    rows, turns = [], 0
        if rows:
            yield from build()
        C.tidy()

    return run


def _hashed(batches):
    """Hashes of the pieces of a node's ids, in order; a node's pieces come one after another."""
    now, h = None, None
    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"node": [now], "sha": [h.hexdigest()]})
                now, h = own, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids)
    if now is not None:
        yield pa.RecordBatch.from_pydict({"node": [now], "sha": [h.hexdigest()]})


def _looked_up(rows: DataFrame, key: str, found: DataFrame, width: int = 128) -> DataFrame:
    """rows with the columns of `found` (a stash) for their key; a frequent key's rows are dealt to 32 copies where `found` is large."""
    side = C.small(found, width)
    if side is not found:
        return rows.join(side, F.col(key) == F.col("node"), "left").drop("node")
    copies = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(31))))
    salted = rows.withColumn("_t", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(32)).cast("int"))
    return salted.join(copies, (F.col(key) == F.col("node")) & (F.col("_t") == F.col("_s")), "left").drop("node", "_s", "_t")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests), chars of each conversation, begun anew with the first turns of its hundred's first one.

    The h first turns come from conversation c - c % 100, h being crc32(c in decimal) % 6, and c's own after its first h.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    conv = F.col("conv_id").cast("long")
    narrow = turns.where(conv.isNotNull()).select((conv - conv % 100).alias("base"), conv.alias("conv_id"), "turn", key.alias("key"), F.length(text).alias("chars"))
    own = narrow.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "chars"))).alias("t"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("t", 1, 5))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    both = own.select("conv_id", "t", head.alias("head"), h.alias("h"))
    begin = F.when(F.col("head").isNull(), F.slice("t", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    whole = both.select("conv_id", F.concat(begin, F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x.key), "")).alias("path"), F.transform("t", lambda x: x.chars).alias("chars"))


def prefix_trie(convs: DataFrame, block_turns: int = BLOCK, piece_bytes: int = PIECE, fewest: int = PATHS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, path, chars, as rebuilt() gives them)."""
    paths = C.stash(convs, "paths")
    level = C.stash(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_lowest(block_turns, piece_bytes, fewest), OUT), "nodes")
    C.drop(paths)
    lowest, nodes, pieces = level.where("kind = 'node'"), [], level.where("kind = 'ids'").select("own", "first", "ids")
    while True:
        spine = level.where("kind = 'spine'").select("path", "sums", "hashes")
        size = spine.agg(F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("b")).first()
        last = size.n <= fewest or (size.b or 0) <= KEY * block_turns
        dealt = spine.repartition(1) if last else spine.repartitionByRange("path")
        level = C.stash(dealt.sortWithinPartitions("path").mapInArrow(_merging(last, block_turns, fewest), OUT), "nodes")
        nodes.append(level.where("kind = 'node'"))
        if last:
            break
    hashes = C.stash(pieces.repartition("own").sortWithinPartitions("own", "first").select("own", "ids").mapInArrow(_hashed, "node binary, sha string"), "hashes")
    upper = nodes[0]
    for more in nodes[1:]:
        upper = upper.unionByName(more)
    tops = C.stash(upper.select(F.col("own").alias("node"), F.col("conv_id").alias("top")), "tops")
    settled = F.col("parent").isNull() & (F.col("ends_sha256") != OPEN)
    open_ = _looked_up(_looked_up(lowest.where(~settled).unionByName(upper), "parent", tops), "own", hashes)
    sha = F.when(F.col("ends_sha256") == OPEN, F.col("sha")).otherwise(F.col("ends_sha256"))
    open_ = open_.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top")).withColumn("ends_sha256", sha)
    return lowest.where(settled).select(*NODE).unionByName(open_.select(*NODE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(C.table(spark, sf_dir, "conversations")))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""
ORACLE_SQL = f"""WITH t AS (SELECT conv_id AS c, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {2 * KEY}) AS key, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, key, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS pos FROM t),
convs AS (SELECT c, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
lens AS (SELECT c AS base, count(*) AS n FROM own GROUP BY c),
turns AS (SELECT convs.c, pos AS d, key, chars FROM convs JOIN own ON own.c = base AND pos <= h
  UNION ALL SELECT convs.c, pos - h + least(h, coalesce(n, 0)), key, chars FROM convs JOIN own ON own.c = convs.c AND pos > h LEFT JOIN lens USING (base)),
steps AS (SELECT c, d, chars, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS p FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, max_by(p, d) AS p FROM steps GROUP BY c) GROUP BY p),
nodes AS MATERIALIZED (SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM steps GROUP BY p),
kids AS (SELECT left(p, length(p) - {2 * KEY}) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtree AS (SELECT left(nodes.p, k * {2 * KEY}) AS p, sum(saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM nodes LEFT JOIN kids USING (p), range(0, depth + 1) AS r(k) GROUP BY 1)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, subtree.saved::BIGINT AS saved_tokens,
  coalesce(sha, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN kids USING (p) JOIN subtree USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes above ON nodes.depth > 0 AND above.p = left(nodes.p, length(nodes.p) - {2 * KEY})"""
