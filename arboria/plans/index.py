"""From files to a graph: nodes with places and ids, symbols, links, vectors."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import embed, extract, layout, links
from ..sources import scan

NODE_COLUMNS = ["id", "title", "summary", "detail_content", "node_type", "parent_id", "sort_key", "source_path", "rel", "index_root", "content_hash", "line_start", "line_end", "depth"]


@dataclass
class Graph:
    nodes: DataFrame
    links: DataFrame
    symbols: DataFrame
    files: DataFrame


def _python_facts(raw: Column) -> Column:
    """signature and doc of Python definitions, by their syntax trees; null where there is none."""

    def run(raw: pd.Series) -> pd.DataFrame:
        found = [extract.described(x) if x is not None else None for x in raw]
        return pd.DataFrame([(None, None) if f is None else f[2:] for f in found], columns=["signature", "doc"])

    return F.pandas_udf(run, "struct<signature:string,doc:string>")(raw)


#: Symbols as they are kept: of which file contents, with what is read from the text once.
SYMBOLS = ["rel", "sha1", "kind", "name", "line_start", "line_end", "refs", "exact", "snippet", "signature", "doc"]


def parsed(files: DataFrame) -> DataFrame:
    """SYMBOLS of files (rel, sha1, text)."""
    rows = extract.symbols(files).join(files.select("rel", "sha1", "text"), "rel").withColumn("lines", T.lines("text"))
    start = F.greatest(F.lit(1), F.col("line_start"))
    own = F.slice("lines", start, F.greatest(F.lit(0), F.col("line_end") - start + 1))
    syntax = _python_facts(F.when(F.endswith(F.lower("rel"), F.lit(".py")), F.array_join(own, "\n")))
    rows = rows.withColumns({"snippet": T.snippet("text", F.col("line_start"), F.col("line_end")), "syntax": syntax, "head": extract.brace_signature(own), "comment": extract.leading_comment(F.col("lines"), F.col("line_start"))})
    known = F.col("syntax.signature").isNotNull()
    return rows.withColumns({"signature": F.when(known, F.col("syntax.signature")).otherwise(F.col("head")), "doc": F.when(known, F.col("syntax.doc")).otherwise(F.col("comment"))}).select(*SYMBOLS)


def _selected(symbols: DataFrame, files: DataFrame, max_symbols: int) -> DataFrame:
    """Symbols within the budgets, with ids and their order of definition."""
    rows = symbols.join(files.select("rel", "sha1", F.col("ord").alias("file_ord")), ["rel", "sha1"]).drop("sha1")
    rows = rows.withColumn("lang", T.language("rel"))
    rows = extract.budgeted(rows, "lang", ["file_ord", "line_start", "name", "kind"], extract.symbol_cap(F.col("lang")), max_symbols)
    salt = F.concat_ws(":", "kind", "name", F.col("line_start").cast("string"))
    rows = rows.withColumn("node_id", T.stable_id(F.lit("symbol"), F.col("rel"), salt))
    one = F.row_number().over(Window.partitionBy("node_id").orderBy("line_end", "snippet"))
    return rows.withColumn("_n", one).where("_n = 1").drop("_n").withColumn("ord", F.struct("file_ord", "line_start", "name"))


def _details(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Detail and summary of each file: its first thirty symbols, and a preview of its text."""
    row = F.concat(F.lit("- "), "kind", F.lit(" "), "name", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    listed = symbols.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("line_start", "name", row.alias("row")))).alias("rows"), F.count("*").alias("n"))
    files = files.join(listed, "rel", "left")
    rows = F.transform(F.slice(F.coalesce("rows", F.array().cast(listed.schema["rows"].dataType)), 1, 30), lambda r: r["row"])
    note = F.when(F.col("truncated"), F.lit("\n[file truncated during indexing]")).otherwise("")
    detail = F.concat(F.lit("File: "), "rel", F.lit("\nSymbols:\n"), F.array_join(rows, "\n"), F.lit("\n\nPreview:\n"), "preview", note)
    kind = F.nullif(T.suffix("rel"), F.lit(""))
    summary = F.concat(F.coalesce(kind, F.lit("text")), F.lit(" file, "), F.col("line_count").cast("string"), F.lit(" lines, "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" indexed symbols"))
    return files.withColumns({"detail": detail, "file_summary": summary})


def tree(files: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """Project, directory, file and symbol nodes with parents and the ids of their paths (no recursion: prefixes)."""
    name = root.rstrip("/").rsplit("/", 1)[-1] or root
    spark = files.sparkSession
    place = lambda rel: F.concat(F.lit(root.rstrip("/") + "/"), rel)
    root_id = T.stable_id(F.lit("project"), F.lit(name), F.lit(root))
    directory_id = lambda rel: T.stable_id(F.lit("directory"), rel, F.lit(root))
    parent_of = lambda rel: F.when(F.contains(rel, F.lit("/")), directory_id(F.regexp_replace(rel, "/[^/]*$", ""))).otherwise(root_id)
    depth = lambda rel: F.size(F.split(rel, "/"))
    none, nil = F.lit(None).cast("string"), F.lit(None).cast("int")

    top = spark.range(1).select(root_id.alias("id"), F.lit(name).alias("title"), F.lit(f"Project root: {root}").alias("summary"), F.lit("").alias("detail_content"), F.lit("project").alias("node_type"), none.alias("parent_id"), F.lit("").alias("sort_key"), F.lit(root).alias("source_path"), F.lit("").alias("rel"), F.lit(root).alias("index_root"), none.alias("content_hash"), nil.alias("line_start"), nil.alias("line_end"), F.lit(0).alias("depth"))
    above = links.ancestors(files.select("rel"), "rel").select(F.col("ancestor").alias("rel")).distinct()
    dirs = above.select(directory_id(F.col("rel")).alias("id"), F.concat(F.lit("dir: "), "rel").alias("title"), F.concat(F.lit("Directory "), "rel").alias("summary"), F.lit("").alias("detail_content"), F.lit("directory").alias("node_type"), parent_of(F.col("rel")).alias("parent_id"), F.lower(place(F.col("rel"))).alias("sort_key"), place(F.col("rel")).alias("source_path"), "rel", F.lit(root).alias("index_root"), none.alias("content_hash"), nil.alias("line_start"), nil.alias("line_end"), depth(F.col("rel")).alias("depth"))
    file_id = T.stable_id(F.lit("file"), F.col("rel"), F.col("sha1"))
    whole = _details(files, symbols)
    file_nodes = whole.select(file_id.alias("id"), F.concat(F.lit("file: "), "rel").alias("title"), F.col("file_summary").alias("summary"), F.col("detail").alias("detail_content"), F.lit("file").alias("node_type"), parent_of(F.col("rel")).alias("parent_id"), F.lower(place(F.col("rel"))).alias("sort_key"), place(F.col("rel")).alias("source_path"), "rel", F.lit(root).alias("index_root"), F.col("sha1").alias("content_hash"), F.lit(1).alias("line_start"), F.col("line_count").alias("line_end"), depth(F.col("rel")).alias("depth"))
    owner = file_nodes.select("rel", F.col("id").alias("owner"))
    span = F.concat("rel", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    symbol_nodes = symbols.join(owner, "rel").select(F.col("node_id").alias("id"), F.concat("kind", F.lit(": "), "name").alias("title"), F.concat("kind", F.lit(" in "), span).alias("summary"), F.col("snippet").alias("detail_content"), F.lit("symbol").alias("node_type"), F.col("owner").alias("parent_id"), F.lower(place(F.col("rel"))).alias("sort_key"), place(F.col("rel")).alias("source_path"), "rel", F.lit(root).alias("index_root"), F.sha1(F.col("snippet").cast("binary")).alias("content_hash"), "line_start", "line_end", depth(F.col("rel")).alias("depth"))
    every = top.unionByName(dirs).unionByName(file_nodes).unionByName(symbol_nodes)

    parts = F.split("rel", "/")
    inner = F.when(F.col("rel") == "", 0).when(F.col("node_type") == "directory", F.size(parts)).otherwise(F.size(parts) - 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), inner)), lambda n: directory_id(F.array_join(F.slice(parts, 1, n), "/")))
    path = F.concat(F.array(root_id), F.when(inner > 0, prefixes).otherwise(F.array().cast("array<string>")))
    path = F.when(F.col("node_type") == "file", F.concat(path, F.array("id"))).when(F.col("node_type") == "symbol", F.concat(path, F.array("parent_id", "id"))).otherwise(path)
    return every.withColumns({"path_ids": path, "parent_is_root": F.coalesce(F.col("parent_id") == root_id, F.lit(False)), "zoom_threshold": layout.zoom_threshold(F.col("node_type"), F.col("depth"))})


def with_children(nodes: DataFrame, most: int = 80) -> DataFrame:
    """Details and summaries of containers: their first children by type and place, and how many more."""
    inner = nodes.where("node_type <> 'symbol'")
    ranked = inner.where("parent_id is not null").withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("node_type", "sort_key", "id")))
    row = F.concat(F.lit("- "), "node_type", F.lit(": "), "title")
    groups = ranked.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("node_type") == "file").alias("files"), F.count_if(F.col("node_type") == "directory").alias("dirs"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", row.alias("row"))))).alias("rows"))
    out = nodes.join(groups, "id", "left")
    more = F.when(F.col("n") > most, F.concat(F.lit("\n- ... "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    listing = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    detail = F.concat("node_type", F.lit(": "), "title", F.lit("\nChildren:\n"), F.coalesce(listing, F.lit("")), F.coalesce(more, F.lit("")))
    box = F.col("node_type").isin("project", "directory")
    summary = F.concat(F.lit("Directory with "), F.coalesce("files", F.lit(0)).cast("string"), F.lit(" files and "), F.coalesce("dirs", F.lit(0)).cast("string"), F.lit(" child directories"))
    return out.withColumns({"detail_content": F.when(box, detail).otherwise(F.col("detail_content")), "summary": F.when(F.col("node_type") == "directory", summary).otherwise(F.col("summary"))}).drop("n", "files", "dirs", "rows")


def graph(scanned: DataFrame, root: str, max_symbols: int = K.MAX_SYMBOLS, keep=lambda df, name: df, vectors: bool = True, cache: DataFrame | None = None, embedder=embed.hash_embedding) -> Graph:
    """The graph of scanned files (from sources.scan).  keep() materialises what several later steps read."""
    files = keep(scanned.where("outcome = 'kept'"), "files")
    return built(files, keep(parsed(files), "parsed"), root, max_symbols, keep, vectors, cache, embedder)


def built(files: DataFrame, found: DataFrame, root: str, max_symbols: int = K.MAX_SYMBOLS, keep=lambda df, name: df, vectors: bool = True, cache: DataFrame | None = None, embedder=embed.hash_embedding) -> Graph:
    """The graph of kept files (rel, ord, sha1, truncated, preview, line_count) and their SYMBOLS, without their texts."""
    symbols = keep(_selected(found, files, max_symbols), "symbols")
    nodes = layout.placed(keep(with_children(keep(tree(files, symbols, root), "tree")), "described"))
    nodes = nodes.withColumns({c: F.col(s) for c, s in (("semantic_x", "x"), ("semantic_y", "y"), ("fixed_x", "x"), ("fixed_y", "y"))})
    nodes = keep(nodes.join(symbols.select(F.col("node_id").alias("id"), "signature", "doc"), "id", "left"), "placed")
    if vectors:
        own = embed.embedding_text(F.col("title"), F.col("node_type"), F.col("rel"), F.col("signature"), F.col("doc"), F.col("summary"))
        nodes, _ = embed.embedded(nodes.withColumn("embed_text", own), cache, embedder)
        nodes = nodes.withColumn("embedding", F.when(F.col("node_type").isin("file", "symbol"), F.col("embedding"))).drop("embed_text")
    resolved = links.resolved(symbols.select("node_id", "rel", "kind", "name", "line_start", "snippet", "refs", "exact", "ord"))
    resolved = resolved.withColumns({"index_root": F.lit(root), "weight": F.lit(1.0)})
    resolved = links.normalized(resolved, ["label"]).withColumn("ord", F.xxhash64("from", "to", "type", "label"))
    return Graph(keep(nodes, "nodes"), keep(resolved, "links"), symbols, files)


def registry(facts: DataFrame, picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is kept of all files of a root: their facts, whether their symbols are, and their nodes."""
    ids = nodes.where("node_type in ('file', 'symbol')").groupBy("rel").agg(F.sort_array(F.collect_list("id")).alias("node_ids"))
    read = picked.where("outcome = 'kept'").select("rel", F.lit(True).alias("parsed"))
    out = facts.select(*scan.FACTS).join(read, "rel", "left").join(ids, "rel", "left")
    return out.withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "node_ids": F.coalesce("node_ids", F.array().cast("array<string>"))})
