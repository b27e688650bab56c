"""Scanning a source tree, and tables standing in for one.

Names are listed by the driver (directories that are passed over are not entered); contents are read by executors,
through the file system of the root's URI, so a tree may lie on any store that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import work


def _file_system(root: str):
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].strip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.rstrip("/") or "/"


def _skipped(name: str) -> bool:
    return name in K.SKIPPED_DIRECTORIES or name.startswith(".cache") or name.endswith(".egg-info")


def listed(root: str, suffixes: tuple[str, ...] = K.TEXT_SUFFIXES) -> Iterator[tuple[str, int, int]]:
    """(rel, bytes, mtime in ns) of the files below a root that may be read."""
    from pyarrow import fs

    system, base = _file_system(root)
    todo = [base]
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop())):
            if info.type == fs.FileType.Directory:
                if not _skipped(info.base_name):
                    todo.append(info.path)
            elif "." in info.base_name.lstrip(".") and "." + info.base_name.rsplit(".", 1)[-1].lower() in suffixes:
                yield info.path[len(base) :].lstrip("/"), info.size or 0, info.mtime_ns or 0


def walk_key(rel: Column | str) -> Column:
    """Orders paths as a walk does: by name, the files of a directory before its subdirectories."""
    parts = F.split(T.col(rel), "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).alias("d"), p.alias("n")))


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = K.TEXT_SUFFIXES, only: list[str] | None = None) -> DataFrame:
    """rel, content of the files below root (or of those of `only` that are there)."""
    some = None if only is None else set(only)
    rows = [(rel, size) for rel, size, _ in listed(root, suffixes) if some is None or rel in some]
    names = spark.createDataFrame(rows, "rel string, size long")
    parts = max(1, min(len(rows), sum(s for _, s in rows) // (16 << 20) + spark.sparkContext.defaultParallelism)) if rows else 1

    def run(batches):
        system, base = _file_system(root)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{rel}", compression=None) as f:
                        yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([f.read()], pa.binary())], ["rel", "content"])
                except OSError:
                    continue  # gone since it was listed

    return names.repartition(parts).mapInArrow(run, "rel string, content binary")


def minified(rel: Column, content: Column) -> Column:
    """By name, or web files whose first five lines with text, of the first 8 KB, are longer than 500 on average."""
    by_name = F.lit(False)
    for s in K.MINIFIED_SUFFIXES:
        by_name = by_name | F.endswith(F.lower(T.file_name(rel)), F.lit(s))
    head = F.make_valid_utf8(F.substring(content, 1, 8192).cast("string"))
    first = F.slice(F.filter(T.lines(head), lambda x: F.trim(x) != ""), 1, 5)
    long = F.aggregate(first, F.lit(0), lambda a, x: a + F.length(x)) > K.MINIFIED_LINE * F.size(first)
    return by_name | (T.suffix(rel).isin(*K.MINIFIED_SNIFFED) & (F.size(first) > 0) & long)


def has_nul(content: Column) -> Column:
    return F.locate("\0", content.cast("string")) > 0


#: What is known of a file without its text.
FACTS = ["rel", "size", "sha1", "truncated", "binary", "minified", "preview", "line_count"]


def previews(text: str) -> dict[str, Column]:
    return {"preview": T.snippet(text, F.lit(1), F.lit(36), 2600), "line_count": T.line_count(text).cast("int")}


def measured(raw: DataFrame, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """FACTS and text of files (rel, content); a long file's text and digest are of its first `max_bytes` bytes."""
    cut = F.substring("content", 1, max_bytes)
    rows = raw.withColumns({"minified": minified(F.col("rel"), F.col("content")), "binary": has_nul(F.col("content")), "size": F.octet_length("content").cast("long"), "truncated": F.octet_length("content") > max_bytes, "sha1": F.sha1(cut), "text": F.make_valid_utf8(cut.cast("string"))})
    return rows.withColumns(previews("text")).select(*FACTS, "text")


def chosen(rows: DataFrame, max_files: int | None = K.MAX_FILES) -> DataFrame:
    """The first files of a walk, with ord (from 1; none where all are taken) and outcome: kept, binary, duplicate.

    Order: minified files are not files of the walk; then the first `max_files` (None: all); then binary ones go, and of
    equal contents the first in walk order stays.
    """
    rows = rows.where(~F.col("minified"))
    if max_files is None:
        rows = rows.withColumns({"walk": walk_key("rel"), "ord": F.lit(None).cast("int")})
    else:
        names = rows.select("rel", walk_key("rel").alias("walk")).withColumn("ord", F.row_number().over(Window.orderBy("walk"))).where(F.col("ord") <= max_files)
        rows = rows.join(names, "rel")
    first = F.row_number().over(Window.partitionBy("sha1", "binary").orderBy("walk"))
    outcome = F.when(F.col("binary"), "binary").when(first > 1, "duplicate").otherwise("kept")
    return rows.withColumn("outcome", outcome).drop("walk")


def gated(raw: DataFrame, max_files: int | None = K.MAX_FILES, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """rel, ord, size, sha1, truncated, text, preview, line_count and outcome of the first files of a walk."""
    return chosen(measured(raw, max_bytes), max_files).drop("binary", "minified")


def scan(spark: SparkSession, root: str, max_files: int = K.MAX_FILES, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    return gated(read_tree(spark, root), max_files, max_bytes)


def numbered_walk(files: DataFrame, name: str = "ord") -> DataFrame:
    """files with their number in the walk of the whole tree."""
    return work.numbered(files.withColumn("_walk", walk_key("rel")), name, "_walk").drop("_walk")


# ---- tables as trees -------------------------------------------------------------------------------------------


def documents_as_files(documents: DataFrame) -> DataFrame:
    """rel (source/lang/id.txt), text and content of each document."""
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", rel.alias("rel"), "text", F.col("text").cast("binary").alias("content"))


def documents_as_nodes(documents: DataFrame) -> DataFrame:
    """File nodes: title and path from the place of the document, its text as detail."""
    files = documents_as_files(documents)
    return files.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("file: "), F.col("rel")).alias("title"), F.lit("").alias("summary"), F.col("text").alias("detail_content"), F.lit("file").alias("node_type"), F.col("rel").alias("source_path"), F.split("rel", "/")[0].alias("index_root"), F.lit(10.0).alias("zoom_threshold"))
