"""The engine: index, search, context, concepts, views and status over one store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import embed, search, view
from ..sources import scan, store, work
from . import context, index


@dataclass
class Root:
    """Which root a query is about, and what to tell about that."""

    root: str | None
    warnings: list[str] = field(default_factory=list)


def resolve_root(asked: str | None, active: str | None, indexed: list[str]) -> Root:
    """The asked root, even if it isn't indexed (then nothing is found); else the active one; else the only one; else all."""
    if asked:
        return Root(asked, [] if asked in indexed else [f"{asked} is not indexed"])
    if active in indexed:
        return Root(active)
    if len(indexed) == 1:
        return Root(indexed[0])
    return Root(None, ["several roots are indexed; name one"] if indexed else [])


def owning_root(paths: DataFrame, roots: list[str]) -> DataFrame:
    """path, root: the longest of the roots that a path lies in, if any."""
    some = F.array(*[F.lit(r.rstrip("/")) for r in sorted(roots, key=len, reverse=True)]) if roots else F.array().cast("array<string>")
    inside = F.filter(some, lambda r: (F.col("path") == r) | F.startswith(F.col("path"), F.concat(r, F.lit("/"))))
    return paths.select("path", F.try_element_at(inside, F.lit(1)).alias("root"))


class Engine:
    """embedder: a function of a text column to a vector column, as embed.hash_embedding or embed.model_embedding()."""

    def __init__(self, spark: SparkSession, path: str, embedder=embed.hash_embedding):
        self.spark, self.store, self.embedder = spark, store.Store(spark, path), embedder
        self._folder = f"{self.store.path}/_work"
        self._kept = work.keeper(self._folder)

    def _done(self) -> None:
        """Removes what steps left for each other."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def nodes(self) -> DataFrame | None:
        return self.store.read("nodes")

    def links(self) -> DataFrame | None:
        return self.store.read("links")

    def roots(self) -> list[str]:
        rows = self.nodes()
        return [] if rows is None else [r.index_root for r in rows.where("index_root is not null").select("index_root").distinct().orderBy("index_root").collect()]

    def index(self, root: str, reset: bool = False, max_files: int = K.MAX_FILES, max_symbols: int = K.MAX_SYMBOLS) -> dict:
        """Indexes a tree in place of what is known of it; other roots stay, unless reset, which drops all.

        Files whose contents are known already are not parsed again.  The limits are kept for ingest().
        """
        root = root.rstrip("/")
        if reset:
            self.store.reset()
        files = self._kept(scan.measured(scan.read_tree(self.spark, root)), "scan")
        report = self._update(root, max_files, max_symbols, files.drop("text"), lambda rels: files.join(rels, "rel", "left_semi").select("rel", "text"))
        self._done()
        return report

    def _of_root(self, table: str, root: str) -> DataFrame | None:
        rows = self.store.read(table, strict=True)
        return None if rows is None else rows.where(F.col("index_root") == root)

    def _update(self, root: str, max_files: int, max_symbols: int, facts: DataFrame, texts) -> dict:
        """Commits the graph of a root's files, of which texts() gives those that have to be parsed."""
        picked = self._kept(scan.chosen(facts, max_files), "picked")
        kept = picked.where("outcome = 'kept'")
        old, old_files, old_symbols = self.store.read("nodes", strict=True), self._of_root("files", root), self._of_root("symbols", root)
        if old is None or old_files is None:
            same = kept.select("rel", "sha1").limit(0)
        else:
            same = store.reusable(kept.select("rel", "sha1"), old_files.where("parsed").select("rel", "sha1", "node_ids"), old.where(F.col("index_root") == root).select("id"))
        same = self._kept(same, "same")
        new = kept.select("rel", "sha1").join(same, ["rel", "sha1"], "left_anti")
        found = index.parsed(texts(new.select("rel")).join(new, "rel"))
        if old_symbols is not None:
            found = found.unionByName(old_symbols.join(same, ["rel", "sha1"], "left_semi").select(*index.SYMBOLS))
        found = self._kept(found, "parsed")
        cache = None
        if old is not None and "embedding" in old.columns:
            known = old.where("embedding is not null and node_type in ('file', 'symbol')")
            own = embed.embedding_text(F.col("title"), F.col("node_type"), F.col("rel"), F.col("signature"), F.col("doc"), F.col("summary"))
            cache = known.select(F.sha1(own.cast("binary")).alias("text_sha1"), F.col("embedding").alias("vector")).dropDuplicates(["text_sha1"])
        g = index.built(kept, found, root, max_symbols, self._kept, cache=cache, embedder=self.embedder)
        tables = {"nodes": g.nodes, "links": g.links, "files": index.registry(facts, picked, g.nodes).withColumn("index_root", F.lit(root)), "symbols": found.withColumn("index_root", F.lit(root))}
        for name, rows in tables.items():
            before = self.store.read(name, strict=True)
            if before is not None:
                tables[name] = store.other_roots(before, root).unionByName(rows, allowMissingColumns=True)
        tables["files"], tables["symbols"] = self._kept(tables["files"], "files"), self._kept(tables["symbols"], "symbols")
        written = self.store.commit(tables, root, {root: {"max_files": max_files, "max_symbols": max_symbols}})
        by = {r.outcome: r.n for r in picked.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        kinds = {r.node_type: r.n for r in g.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
        return {"root": root, "node_count": sum(kinds.values()), "directory_count": kinds.get("directory", 0), "file_count": kinds.get("file", 0), "symbol_count": kinds.get("symbol", 0), "link_count": g.links.count(), "skipped_files": by.get("binary", 0), "deduped_files": by.get("duplicate", 0), "truncated_files": picked.where("truncated").count(), "parsed_files": new.count(), "written": written}

    def ingest(self, root: str, paths: list[str]) -> dict:
        """Takes changed files of an indexed root over, by the limits it was indexed with.

        Only these are read (and files that the registry lacks or that take the place of others), and parsed; what is
        known of all others comes from the registry.  Links are resolved again, so the graph is that of a full index.
        Files that are gone go, whether they are among the paths or not.
        """
        root = root.rstrip("/")
        limits = self.store.manifest()["limits"].get(root, {})
        known = self._of_root("files", root)
        if known is None:
            return {"files": {p: "error" for p in paths}, "error": f"{root} is not indexed", "written": {}}
        known = self._kept(known, "known")
        names = self.spark.createDataFrame([(rel,) for rel, _, _ in scan.listed(root)], "rel string")
        asked = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "rel string")
        fresh = [r.rel for r in names.join(known.select("rel"), "rel", "left_anti").unionByName(names.join(asked, "rel", "left_semi")).distinct().collect()]
        read = self._kept(scan.measured(scan.read_tree(self.spark, root, only=fresh)), "read")
        before = {r.rel: r.sha1 for r in known.join(asked, "rel", "left_semi").select("rel", "sha1").collect()}
        after = {r.rel: r.sha1 for r in read.select("rel", "sha1").collect()}
        state = {p: "deleted" if p in before and p not in after else "created" if p in after and p not in before else "skipped" if p not in after or before[p] == after[p] else "modified" for p in paths}
        gone = not known.join(names, "rel", "left_anti").isEmpty()
        if not gone and set(state.values()) <= {"skipped"} and set(after) <= set(before):
            self._done()
            return {"files": state, "written": {}}
        facts = known.select(*scan.FACTS).join(names, "rel", "left_semi").join(read.select("rel"), "rel", "left_anti").unionByName(read.drop("text"))

        def texts(rels: DataFrame) -> DataFrame:
            other = [r.rel for r in rels.join(read.select("rel"), "rel", "left_anti").collect()]
            rows = read.join(rels, "rel", "left_semi").select("rel", "text")
            return rows.unionByName(scan.measured(scan.read_tree(self.spark, root, only=other)).select("rel", "text")) if other else rows

        report = self._update(root, limits.get("max_files", K.MAX_FILES), limits.get("max_symbols", K.MAX_SYMBOLS), self._kept(facts, "facts"), texts)
        self._done()
        return {"files": state, "parsed_files": report["parsed_files"], "written": report["written"]}

    def watch(self, root: str, checkpoint: str, seconds: float = 1.0, said=None, quiet: float = 0.0):
        """Ingests changes as they happen; quiet: seconds for which a file has to stay as it is before that."""
        from ..streaming import watch

        return watch.watch(self.spark, root, lambda paths: self.ingest(root, paths), checkpoint, seconds, said, quiet)

    def queries(self, asked: list[tuple[str, int | None, str | None]]) -> DataFrame:
        """A table of (query, budget, root)."""
        active, indexed = self.store.manifest()["active_root"], self.roots()
        rows = [(i, q, b, resolve_root(r, active, indexed).root) for i, (q, b, r) in enumerate(asked)]
        return self.spark.createDataFrame(rows, "query_id long, query string, budget int, root string")

    def context(self, query: str, budget: int | None = None, root: str | None = None) -> dict:
        return self.contexts([(query, budget, root)])[0]

    def contexts(self, asked: list[tuple[str, int | None, str | None]]) -> list[dict]:
        """Contexts of a list of queries, made at once."""
        nodes = self.nodes()
        if nodes is None:
            return [{"query": q, "used": 0, "selected_count": 0, "selected": [], "compiled_context": "", "warnings": ["nothing is indexed"]} for q, _, _ in asked]

        def texts(wanted: DataFrame) -> DataFrame:
            """Of the candidates' files alone, as they are now."""
            out = self.spark.createDataFrame([], "index_root string, rel string, text string")
            by_root: dict[str, list[str]] = {}
            for r in wanted.where("index_root is not null and rel <> ''").collect():
                by_root.setdefault(r.index_root, []).append(r.rel)
            for root, rels in sorted(by_root.items()):
                files = scan.read_tree(self.spark, root, only=rels)
                out = out.unionByName(files.select(F.lit(root).alias("index_root"), "rel", F.make_valid_utf8(F.substring("content", 1, K.MAX_FILE_BYTES).cast("string")).alias("text")))
            return out

        rows = context.contexts(nodes, self.links(), texts, self.queries(asked), semantic=True, keep=self._kept, embedder=self.embedder).orderBy("query_id").collect()
        self._done()
        active, indexed = self.store.manifest()["active_root"], self.roots()
        return [r.asDict(True) | {"warnings": resolve_root(a[2], active, indexed).warnings, "indexed_roots": indexed} for r, a in zip(rows, asked, strict=True)]

    def zoom_query(self, query: str, limit: int = 8, root: str | None = None) -> list[dict]:
        """Ranked nodes of a query, by words alone, over all roots unless one is named."""
        q = self.spark.createDataFrame([(0, query, root)], "query_id long, query string, root string")
        return [r.asDict() for r in context.zoomed(self.nodes(), q, limit).orderBy("rank").collect()]

    def inject_concept(self, title: str, summary: str, detail: str = "") -> str:
        """Adds a concept node and places all concepts anew by their vectors."""
        one = self.spark.createDataFrame([(title, summary, detail)], "title string, summary string, detail_content string")
        text = F.concat_ws("\n", "title", "summary")
        one = one.withColumns({"id": T.concept_id(F.col("title"), F.col("summary")), "node_type": F.lit("concept"), "zoom_threshold": F.lit(20.0), "embedding": self.embedder(text)})
        old = self.store.read("nodes", strict=True)
        nodes = one if old is None else store.spliced(old, one, one, "id")
        concepts = self._kept(nodes.where("node_type = 'concept'"), "concepts")
        places = embed.projected(concepts.select("id", "embedding")).select("id", F.col("x").alias("px"), F.col("y").alias("py"))
        nodes = nodes.join(places, "id", "left")
        for c, p in (("x", "px"), ("y", "py")):
            nodes = nodes.withColumn(c, F.coalesce(p, c) if c in nodes.columns else F.col(p))
        nodes = nodes.drop("px", "py")
        if "source_path" not in nodes.columns:
            nodes = nodes.withColumns({"source_path": F.lit(None).cast("string"), "index_root": F.lit(None).cast("string"), "rel": F.lit(None).cast("string")})
        self.store.commit({"nodes": nodes})
        self._done()
        return one.first().id

    def _links_or_none(self) -> DataFrame:
        links = self.links()
        return links if links is not None else self.spark.createDataFrame([], "from string, to string, type string, label string, ord long")

    def view(self, x: float, y: float, zoom: float) -> tuple[DataFrame, DataFrame]:
        """Nodes and links to draw for a camera."""
        nodes = self.nodes()
        top = view.stream_top(nodes, x, y, zoom)
        ids, shown = view.with_links(top, nodes, self._links_or_none(), zoom, keep=self._kept, camera=(x, y))
        return view.node_view(nodes.join(ids, "id", "left_semi"), x, y, zoom), shown

    def state(self, x: float = 0.0, y: float = 0.0, zoom: float = 1.0) -> dict:
        """All that a viewer draws: camera, field of view, counts, nodes and links (both bounded by the stream's limits)."""
        nodes, links = self.view(x, y, zoom)
        shown, joined = [r.asDict(True) for r in nodes.drop("embedding").collect()], [r.asDict(True) for r in links.collect()]
        counts = {"rendered_count": len(shown), "visible_count": sum(n["visible"] for n in shown), "unlocked_count": sum(n["detail_state"] == "unlocked" for n in shown)}
        self._done()
        return {"camera": {"x": x, "y": y, "zoom": zoom}, "fov": 2.0 / max(0.1, zoom), "node_count": self.nodes().count(), "link_count": len(joined)} | counts | {"nodes": shown, "links": joined}

    def focus(self, node: str, reveal: bool = True, zoom: float = 0.0) -> dict:
        """The node meant by an id or words, and the camera to look at it: the given zoom, or one that opens it or shows it closed."""
        nodes = self.nodes()
        found = None if nodes is None else search.find_node(nodes, node).first()
        if found is None:
            return {"status": "not_found", "query": node, "node_count": 0 if nodes is None else nodes.count()}
        at = found["zoom_threshold"] if found["zoom_threshold"] else 20.0
        target = zoom if zoom > 0 else at * 1.15 if reveal else max(1.0, 0.75 * at)
        x, y = found["x"] or 0.0, found["y"] or 0.0
        around = view.visible(nodes, x, y, target).orderBy("distance", "id").limit(12).select("id", "title", "node_type").collect()
        return {"status": "ok", "focused_node": {c: found[c] for c in ("id", "title", "node_type", "summary", "zoom_threshold")}, "camera": {"x": x, "y": y, "zoom": target}, "visible_nodes": [r.asDict() for r in around]}

    def compact_status(self, x: float = 0.0, y: float = 0.0, zoom: float = 1.0, visible: int = 12, sample: int = 16) -> dict:
        """Counts, the first visible nodes and the first nodes of the map, few enough for a prompt."""
        nodes = self.nodes()
        if nodes is None:
            return {"node_count": 0, "link_count": 0, "visible_count": 0, "visible_nodes": [], "map_sample": [], "map_sample_count": 0}
        few = ["id", "title", "node_type", "zoom_threshold"]
        seen = view.visible(nodes, x, y, zoom)
        near = [r.asDict() for r in seen.orderBy("distance", "id").limit(visible).select(*few).collect()]
        rank = view.type_rank()
        some = [r.asDict() for r in nodes.where("node_type in ('project', 'directory', 'file')").orderBy(rank, "sort_key", "id").limit(sample).select(*few).collect()]
        return {"node_count": nodes.count(), "link_count": self._links_or_none().count(), "camera": {"x": x, "y": y, "zoom": zoom}, "fov": 2.0 / max(0.1, zoom), "visible_count": seen.count(), "visible_nodes": near, "map_sample_count": len(some), "map_sample": some}

    def status(self) -> dict:
        nodes = self.nodes()
        if nodes is None:
            return {"node_count": 0}
        return view.status(nodes, self._links_or_none()).first().asDict() | {"active_root": self.store.manifest()["active_root"], "shards": self.store.stats()}

    def export(self) -> tuple[DataFrame, DataFrame]:
        return view.exported(self.nodes(), self.links())

    def reset(self) -> None:
        self.store.reset()


