"""Corpus-wide counts for blocks of documents, without broadcasting them and without a row for each key.

A block asks with its sorted distinct keys, cut into buckets by their leading bits, as arrays of 32-bit rests and
counts; each bucket adds up what all blocks hold and answers every block with an array in the block's own order.
Where counts must be those of the keys themselves, a block asks with whole 64-bit keys: among 400,000 words two pairs share
38 bits of their hashes, among 200,000,000 one in a thousand such tables has a pair that shares 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

ASKED = "m long, b int, keys binary, counts binary"


def bucket_bits(keys: int) -> int:
    """Leading bits, so that a bucket gets some four million keys; 32 more bits tell keys of a bucket apart."""
    return max(6, (max(1, keys) >> 22).bit_length())


def ask(m: int, keys: np.ndarray, counts: np.ndarray, bits: int, first: int = 0, whole: bool = False) -> pa.Table:
    """keys: sorted distinct, of 32 + bits bits, or (whole) of 64; first: the number of the first bucket."""
    b = (keys >> np.uint64(64 - bits if whole else 32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    low, many = keys.astype(np.uint64 if whole else np.uint32), counts.astype(np.uint32)
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return pa.table([
        pa.array([m] * len(cut), pa.int64()), pa.array(b[edges[:-1]] + first, pa.int32()),
        pa.array([low[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([many[x:y].tobytes() for x, y in cut], pa.binary()),
    ], ["m", "b", "keys", "counts"])


def totals(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of one bucket: distinct keys, their totals, each asked key's place among them, ends of the askers' parts."""
    keys, counts = t.column("keys").to_pylist(), t.column("counts").to_pylist()
    many, every = np.frombuffer(b"".join(counts), np.uint32), b"".join(keys)
    every = np.frombuffer(every, np.uint64 if len(every) == 8 * len(many) else np.uint32)
    distinct, back = np.unique(every, return_inverse=True)
    total = np.bincount(back, weights=many, minlength=len(distinct)).astype(np.int64)
    return distinct, total, back, np.cumsum([len(c) // 4 for c in counts]).tolist()


def answered(asked: DataFrame, encode, schema: str = "m long, b int, reply binary") -> DataFrame:
    """encode: totals as an array of fixed width, an element for each key."""

    def run(t: pa.Table) -> pa.Table:
        _, total, back, ends = totals(t)
        coded = encode(total)[back]
        parts = [coded[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        del total, back, coded
        C.tidy()
        return pa.table([t.column("m"), t.column("b"), pa.array(parts, pa.binary())], ["m", "b", "reply"])

    return asked.groupBy("b").applyInArrow(run, schema)


def in_order(replies: pa.Table, dtype) -> np.ndarray:
    """A block's answers, in the order of its keys."""
    rows = sorted(zip(replies.column("b").to_pylist(), replies.column("reply").to_pylist(), strict=True))
    return np.frombuffer(b"".join(r for _, r in rows), dtype)


def steps(total: np.ndarray) -> np.ndarray:
    """Counts on one byte, in order: exact below 128, then 8 steps to each doubling."""
    big = np.maximum(total, 1)
    return np.where(total < 128, total, np.minimum(255, 128 + np.floor(8 * (np.log2(big) - 7)))).astype(np.uint8)


def unstepped(coded: np.ndarray) -> np.ndarray:
    """The least counts that steps() gives these codes."""
    return np.where(coded < 128, coded, np.ceil(np.exp2(7 + (coded.astype(np.float64) - 128) / 8))).astype(np.int64)
