"""What the training-data operators share: folders, whole-batch tokenising, deterministic range shards.

Texts reach Python as binary columns.  A batch is handled as one byte buffer with document offsets, so the
per-token work is a handful of numpy passes and memory is bounded by ``CHUNK`` bytes of text at a time (a
single longer document is its own chunk).
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK = 1 << 20

#: Words of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z), by byte.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower-cases A-Z and blanks whatever is not of an ALNUM word, for bytes.translate().
ALNUM_TEXT = bytes(int(LOWER[i]) if ALNUM[LOWER[i]] else 32 for i in range(256))

_B = 0x9E3779B97F4A7C15
#: The first k bytes of a little-endian word, k from 0 to 8.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEPS = 16


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), by value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on as one number; zeros follow its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a byte buffer, alike for equal bytes wherever they stand.

    Eight bytes are mixed in a step (one step tells all words of a length up to eight apart); spans of over
    128 bytes are hashed by a digest.  Where bytes must be the same, callers compare the bytes or 128-bit digests.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    wide, length = eights(low), ends - starts
    h = mix64(length.astype(np.uint64) * np.uint64(_B))
    h = mix64(h ^ (wide[starts] & FIRST[np.minimum(length, 8)]))
    some = np.arange(len(starts))
    for k in range(1, _STEPS):
        some = some[length[some] > 8 * k]
        if not len(some):
            return h
        h[some] = mix64(h[some] * np.uint64(_B) ^ (wide[starts[some] + 8 * k] & FIRST[np.minimum(length[some] - 8 * k, 8)]))
    for i in some[length[some] > 8 * _STEPS].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def digest(data: bytes) -> bytes:
    """Stands for the bytes themselves: 128 bits."""
    return hashlib.blake2b(data, digest_size=16).digest()


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = pc.fill_null(column, b"")
    wide = pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(low: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and n+1 offsets into them by document."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order, and n+1 offsets; a document of 1..k-1 words has one, of them all."""
    counts = np.diff(word_offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * np.uint64(pow(_B, 2 * j + 1, 2**64)) if len(total) else 0
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(out[-1]) - out[doc] + word_offsets[doc]
    short = np.flatnonzero((counts > 0) & (counts < k))
    h = np.zeros(out[-1], np.uint64)
    whole = counts[doc] >= k
    h[whole] = total[at[whole]]
    for d in short:
        a, b = word_offsets[d], word_offsets[d + 1]
        h[out[d]] = np.uint64(sum(int(words[a + j]) * pow(_B, 2 * j + 1, 2**64) for j in range(b - a)) % 2**64) + np.uint64(b - a)
    return mix64(h), out


def lowered(buf: np.ndarray) -> np.ndarray:
    return LOWER[buf]


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system; idle workers count against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- folders -------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a single-machine session (master local or local[n]) gets a folder of its own; a cluster has to name one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="arboria-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the folders made within: for work whose result has by then been written elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/arboria-{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Spark deletes the shuffle files of what is run within as each execution ends, not once the driver collects its garbage.

    For executions of which the result alone is used again; one that is run twice would be shuffled anew.
    """
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def stash(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage by a written table in the shared folder: a lost executor costs no recomputation."""
    path = new_dir(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Deletes stashes, once all that is read from them has been written."""
    for df in stashed:
        delete(df.sparkSession, df._stashed)


def small(stashed: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """A stash marked for broadcast if its rows, counted, take no more than `most` bytes; else as it is."""
    return F.broadcast(stashed) if stashed.count() * row_bytes <= most else stashed


def of_driver(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver as a table, through Arrow: from a list, Spark would start Python workers for it on executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema), ddl)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text"):
    """A text column as bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def short_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Whole texts go to Python and back in Arrow batches of about `most` bytes, where the session has larger ones.

    A batch stands in the JVM's direct memory (twice while a vector grows) and in Python at once, for each task, and
    rows that carry their text hold it twice.  The setting stays with the session; a smaller one is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def with_row(rows: DataFrame, ddl: str):
    """A schema of the column `row` of rows, whatever names that holds, and the columns of a DDL string."""
    return StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(ddl).fields])


def per_text(measure, ddl: str):
    """A function of a binary column to a struct column; measure: an Arrow array to arrays of the struct's fields.

    Only the texts go to Python, in Arrow batches; all other columns of a row wait for it in the JVM.  It is marked
    as not deterministic so that the optimizer evaluates it once, wherever the struct is used.
    """
    names = [f.name for f in StructType.fromDDL(ddl).fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays(measure(texts), names)
        tidy()

    return F.arrow_udf(run, ddl).asNondeterministic()


# ---- range shards --------------------------------------------------------------------------------------------

#: Most shards that a key is cut into: their bounds (8 bytes each) are broadcast.
MOST_SHARDS = 1 << 24
#: Most tasks that shards are dealt to; a task writes its shards one after another.
MOST_TASKS = 20_000


def running(rows: DataFrame, order, weight: str) -> DataFrame:
    """rows with `before`, the sum of `weight` over rows of smaller keys; a key stands in one row.

    Sums run in tasks over ranges of the key; the driver gets a sum a task.  They depend on the rows alone.  The result
    reads a stash (for drop()), and has the sum of all as `_total`.
    """
    dealt = stash(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "dealt")
    total, offsets = 0, []
    for r in sorted(dealt.groupBy("_p").agg(F.sum(weight).alias("w")).collect(), key=lambda r: r[0]):
        offsets.append((r[0], total))
        total += r.w
    offsets = of_driver(rows.sparkSession, offsets, "_p int, _offset long")
    upto = F.sum(weight).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    summed = dealt.join(F.broadcast(offsets), "_p").withColumn("before", F.col("_offset") + F.coalesce(upto, F.lit(0)))
    summed = summed.drop("_p", "_offset")
    summed._stashed, summed._total = dealt._stashed, total
    return summed


def range_bounds(df: DataFrame, key: str, weight, target: int) -> np.ndarray:
    """Upper bounds (exclusive) of contiguous ranges of a long key, of `target` weight each and less than a key's more.

    A key's range is the sum of the weights before it, by `target`, so ranges depend on the rows alone and not on how
    these are dealt out.  The driver gets the bounds, eight bytes each, MOST_SHARDS at most.
    """
    keyed = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.sum(weight).cast("long").alias("w"))
    summed = running(keyed, F.col("k").asc(), "w")
    if summed._total // target >= MOST_SHARDS:
        raise ValueError(f"a target of {target} makes {summed._total // target + 1} shards, more than {MOST_SHARDS}; take a larger one")
    first = summed.groupBy(F.expr(f"before div {int(target)}").alias("shard")).agg(F.min("k").alias("k")).toArrow()
    drop(summed)
    return np.sort(first.column("k").to_numpy())[1:].astype(np.int64)


def shards_in(keys: pa.Array, bounds: np.ndarray) -> pa.Array:
    """shard_of() of long keys at hand, in a task."""
    filled = pc.fill_null(keys, -(2**63)).to_numpy(zero_copy_only=False)
    return pa.array(np.searchsorted(bounds, filled, "right").astype(np.int32))


def shard_of(spark: SparkSession, key: str, bounds: np.ndarray):
    """The number of the range of `bounds` that a key is in; null is in the first."""
    if not len(bounds):
        return F.lit(0)
    shared = spark.sparkContext.broadcast(bounds)

    def run(keys: pa.Array) -> pa.Array:
        return shards_in(keys, shared.value)

    return F.arrow_udf(run, "int")(F.col(key).cast("long"))


def dealt_to_shards(rows: DataFrame, shards: int, *order) -> DataFrame:
    """Rows sorted by `shard` and then `order`, neighbouring shards in one task where there are more than MOST_TASKS."""
    tasks = min(shards, MOST_TASKS)
    task = F.floor(F.col("shard").cast("long") * tasks / F.lit(shards)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("shard", *order)


# ---- files that executors write --------------------------------------------------------------------------------


def file_system(uri: str):
    """pyarrow's file system and the path in it; a local path may come as file:/x, file:///x or /x."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Committed:
    """A file that appears under its own name only once it is whole: written under a temporary name, then moved.

    A second attempt of a task writes the same bytes under another temporary name, so either may win the move.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.final, self.tmp = f"{root}/{name}", f"{root}/_tmp/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{root}/_tmp", recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.tmp, compression=None), 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.final)


def swept(folder: str) -> None:
    """Removes what attempts that lost left under temporary names, once the manifest stands."""
    from pyarrow import fs

    system, root = file_system(folder)
    if system.get_file_info(f"{root}/_tmp").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/_tmp")
