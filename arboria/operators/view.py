"""Views of the map: what a camera sees, what is streamed, and the export of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as T
from ..sources import work

LOCKED = "[zoom in to unlock]"


def _camera(nodes: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    x, y, zoom = min(1.0, max(-1.0, x)), min(1.0, max(-1.0, y)), max(0.1, zoom)
    return nodes.withColumns({"distance": S.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)), "fov": F.lit(2.0 / zoom), "zoom": F.lit(zoom)})


def _by(values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col("node_type") == k, F.lit(v)) if out is None else out.when(F.col("node_type") == k, F.lit(v))
    return out.otherwise(F.lit(other))


def visible(nodes: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """Nodes within the field of view whose threshold the zoom reaches, with focus 0 to 1."""
    rows = _camera(nodes, x, y, zoom).where("distance <= fov and zoom >= zoom_threshold")
    return rows.withColumn("focus", S.clamp(1 - F.col("distance") / F.col("fov"), 0.0, 1.0)).drop("fov", "zoom")


def streamed(nodes: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """Nodes to send: near the field of view, unlocked or close to it; with their priority fields."""
    rows = _camera(nodes, x, y, zoom)
    near = F.col("distance") <= F.col("fov") * 1.12 + 0.06
    soon = (F.col("zoom") >= F.col("zoom_threshold") * _by(K.PREVIEW_GATES, 0.9)) & (F.col("distance") <= F.col("fov"))
    keep = F.when(F.col("node_type") == "project", F.col("distance") <= F.greatest(F.col("fov") * 1.2, F.lit(0.35))).otherwise(near & ((F.col("zoom") >= F.col("zoom_threshold")) | soon))
    return rows.where(keep).withColumns({"locked": F.when(F.col("zoom") >= F.col("zoom_threshold"), 0).otherwise(1), "nearness": F.col("distance") / F.col("fov"), "type_rank": type_rank()})


PRIORITY = ["locked", "nearness", "type_rank", "id"]


def stream_top(nodes: DataFrame, x: float, y: float, zoom: float, limit: int = K.STREAM_NODES) -> DataFrame:
    return streamed(nodes, x, y, zoom).orderBy(*PRIORITY).limit(limit)


def type_rank() -> Column:
    return _by(K.TYPE_RANKS, 5)


def wormholes(views: DataFrame, links: DataFrame, neighbours: int = K.STREAM_NEIGHBOURS, most: int = K.STREAM_LINKS) -> tuple[DataFrame, DataFrame]:
    """(view, id, since) of what is in each view at last and the links (view, from, to, place) that it takes.

    views: view, id of what is in view at first.  links: from, to, place (of any type that orders; equal links are one
    place).  Links are taken in order: one that touches what is in view brings its other end in, up to a number of
    neighbours, and what is brought in counts as in view for later links; a view is done with `most` links.  So a node
    comes in with the first link after its neighbour came in (since; null: at first): earliest arrivals.  All views go on
    together, by rounds over the links that touch what came in, until a round changes no row.  An arrival depends on
    earlier ones alone, so of a view only as many as may come in go on to the next round.
    """
    keep = work.shared(views.sparkSession)
    start = keep(views.select("view", "id").distinct().withColumn("since", F.lit(None).cast(links.schema["place"].dataType)), "in_view")
    seen, known = start, None
    while True:
        ends = []
        for a, b in (("from", "to"), ("to", "from")):
            touch = links.join(seen.withColumnRenamed("id", a), a).where("since is null or since < place")
            ends.append(touch.select("view", F.col(b).alias("id"), "place"))
        came = ends[0].unionByName(ends[1]).join(start.select("view", "id"), ["view", "id"], "left_anti").groupBy("view", "id").agg(F.min("place").alias("since"))
        nth = F.row_number().over(Window.partitionBy("view").orderBy("since", "id"))
        came = keep(came.withColumn("nth", nth).where(F.col("nth") <= neighbours).drop("nth"), "came")
        both = came.join(known, ["view", "id", "since"], "full") if known is not None else None
        same = both is not None and came.count() == known.count() == both.count()
        if known is not None:
            work.forget(known)
        known, seen = came, start.unionByName(came)
        if same:
            break
    both = links
    for end in ("from", "to"):
        on = [end] if end == "from" else [end, "view"]
        both = both.join(seen.select("view", F.col("id").alias(end), F.col("since").alias(f"{end}_since")), on)
    first = lambda end: F.col(f"{end}_since").isNull() | (F.col(f"{end}_since") < F.col("place"))
    there = lambda end: F.col(f"{end}_since").isNull() | (F.col(f"{end}_since") <= F.col("place"))
    nth = F.row_number().over(Window.partitionBy("view").orderBy("place"))
    taken = both.where((first("from") | first("to")) & there("from") & there("to")).withColumn("nth", nth).where(F.col("nth") <= most)
    taken = keep(taken.select("view", "from", "to", "place", "nth"), "taken")
    last = taken.where(F.col("nth") == most).select("view", F.col("place").alias("last"))
    inside = seen.join(last, "view", "left").where("since is null or last is null or since <= last").select("view", "id", "since")
    return inside, taken.drop("nth")


def with_links(top: DataFrame, nodes: DataFrame, links: DataFrame, zoom: float, keep=lambda df, name: df, camera: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids of the streamed nodes with neighbours pulled in by links (see wormholes), and those links; none below the links' zoom.

    With a camera, what is in view at last is cut to the stream's limit, and links to what is left.
    """
    ids = top.select("id")
    if zoom < K.STREAM_LINK_ZOOM:
        return ids, links.limit(0)
    order = ["ord", "from", "to", "type", "label"]
    place = F.struct(*order, *(c for c in links.columns if c not in order)).alias("place")
    real = links.where("`from` <> `to`").join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    inside, taken = wormholes(ids.withColumn("view", F.lit(0)), real.select("from", "to", place))
    inside, shown = inside.select("id"), taken.select("place.*")
    if camera is not None:
        x, y = camera
        rows = _camera(nodes.join(F.broadcast(inside), "id", "left_semi"), x, y, zoom)
        rows = rows.withColumns({"locked": F.when(F.col("zoom") >= F.col("zoom_threshold"), 0).otherwise(1), "nearness": F.col("distance") / F.col("fov"), "type_rank": type_rank()})
        inside = keep(rows.orderBy(*PRIORITY).limit(K.STREAM_NODES).select("id"), "inside")
        for end in ("from", "to"):
            shown = shown.join(F.broadcast(inside.withColumnRenamed("id", end)), end, "left_semi")
    return inside, shown.select(*links.columns)


def node_view(nodes: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """State of each node for a viewer: unlocked, locked or outside; the detail only where unlocked."""
    rows = _camera(nodes, x, y, zoom)
    inside, open_ = F.col("distance") <= F.col("fov"), F.col("zoom") >= F.col("zoom_threshold")
    detail = F.when(inside & open_, F.col("detail_content")).otherwise(F.lit(LOCKED))
    return rows.withColumns({
        "visible": inside & open_, "focus": F.when(inside & open_, S.clamp(1 - F.col("distance") / F.col("fov"), 0.0, 1.0)).otherwise(0.0),
        "detail_state": F.when(inside & open_, "unlocked").when(inside, "locked").otherwise("outside_fov"), "detail": detail, "detail_preview": F.left(detail, F.lit(260)),
    }).drop("fov", "zoom")


def coordinate_mode() -> Column:
    fixed = F.col("fixed_x").isNotNull() & F.col("fixed_y").isNotNull()
    return F.when(fixed & F.col("index_root").isNotNull(), "radial").when(fixed, "fixed").otherwise("projected")


def exported(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with language, label and risk (a container's is the highest below it), and syntactic edges between them.

    nodes: id, title, summary, detail_content, node_type, parent_id, path_ids, source_path, line_start, line_end.
    """
    own = nodes.withColumn("own_risk", S.risk_score(F.col("title"), F.col("summary"), F.col("detail_content")))
    below = own.select("own_risk", F.explode("path_ids").alias("id")).groupBy("id").agg(F.max("own_risk").alias("risk_score"))
    label = F.trim(F.when(F.contains("title", F.lit(": ")), F.regexp_extract("title", "(?s)^.*?: (.*)$", 1)).otherwise(F.col("title")))
    out = own.join(below, "id").select("id", F.col("node_type").alias("type"), "title", label.alias("label"), F.col("parent_id").alias("parent"), F.col("source_path").alias("path"), "line_start", "line_end", T.language("source_path").alias("lang"), "summary", "risk_score")
    lang = out.select("id", "lang")
    edges = links.where("type = 'syntax_dependency'").join(lang.toDF("from", "l1"), "from").join(lang.toDF("to", "l2"), "to")
    return out, edges.select("from", "to", "type", "label", F.lit(True).alias("via_wormhole"), (F.col("l1") != F.col("l2")).alias("cross_language"))


def status(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes by type, links by type, roots."""
    n = lambda t: F.count_if(F.col("node_type") == t).alias(f"{t}_count")
    a = nodes.agg(F.count("*").alias("node_count"), n("directory"), n("file"), n("symbol"), n("concept"), F.array_sort(F.collect_set("index_root")).alias("indexed_roots"))
    b = links.agg(F.count("*").alias("link_count"), F.count_if(F.col("type") == "syntax_dependency").alias("syntax_link_count"))
    return a.crossJoin(b)


def totals(rows: DataFrame, levels: list[str], sums: list[Column]) -> DataFrame:
    """Sums of rows on every level of a tree whose levels are columns, outermost first.

    level: a bit for each column that a row adds up over, the last column's being 1 (0: a leaf, all bits: everything), so
    that a null folder stays apart from the total of all.  rows should be narrow, as each stands once a level before they
    are added up in their tasks.
    """
    return rows.rollup(*levels).agg(F.grouping_id().alias("level"), *sums)


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes in the order of a walk: parents before children, children by ordinal (path_ords, an array of them)."""
    return work.numbered(nodes, "walk", "path_ords", "id")
