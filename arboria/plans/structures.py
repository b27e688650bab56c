"""Registered queries of spans, trees and rings, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grams, ivf, layout, search, spans, trees, view
from ..sources import scan, work
from ..streaming import debounce
from .queries import _PI, _search_sql, _t, query

_LINES_SQL = "l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM l)"


@query(f"""WITH {_LINES_SQL}, s AS (SELECT doc_id, no AS start, no + 1 + (length(line) // 4) % 9 AS stop, regexp_extract(line, '[A-Za-z]+') AS name FROM x WHERE length(line) % 4 = 1),
n AS (SELECT DISTINCT doc_id, no, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS name FROM x),
i AS (SELECT n.doc_id, n.name, max(s.start) AS start FROM n JOIN s ON s.doc_id = n.doc_id AND s.start <= n.no AND n.no < s.stop GROUP BY n.doc_id, n.no, n.name),
r AS (SELECT i.doc_id, i.start, list_sort(list_distinct(list(i.name))) AS refs FROM i JOIN s ON s.doc_id = i.doc_id AND s.start = i.start AND s.name <> i.name GROUP BY 1, 2)
SELECT s.doc_id, s.start::INT AS start, s.name, coalesce(len(refs), 0)::INT AS n_refs, md5(coalesce(array_to_string(refs, ','), '')) AS refs_md5 FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.start = s.start""")
def stab_references(spark, d):
    """Every word of a document in the innermost of the spans of lines that some of its lines open; spans nest, touch and cross."""
    lines = _t(spark, d, "documents").select(F.col("doc_id").alias("rel"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)
    size = F.length("line")
    opened = lines.where(size % 4 == 1).select("rel", F.col("at").alias("id"), F.regexp_extract("line", "[A-Za-z]+", 0).alias("name"), F.col("at").alias("start"), (F.col("at") + 1 + F.floor(size / 4) % 9).cast("int").alias("stop"))
    names = lines.select("rel", "at", F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("names"))
    rows = spans.stab_references(opened, names)
    return rows.select(F.col("rel").alias("doc_id"), "start", "name", F.size("refs").alias("n_refs"), F.md5(F.array_join("refs", ",").cast("binary")).alias("refs_md5"))


_TREE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, 0::BIGINT AS v FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, coalesce('o' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'c' || o_custkey), round(o_totalprice * 100)::BIGINT FROM orders)"""


def _tree(spark, d):
    """Regions, nations, customers, and each customer's orders as a chain; known by parent_id alone."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(0).cast("long").alias("v")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = _t(spark, d, "orders").select(key("o", "o_orderkey").alias("id"), F.coalesce(F.concat(F.lit("o"), before.cast("string")), key("c", "o_custkey")).alias("parent_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    rows = _t(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), none)
    rows = rows.union(_t(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), none))
    return rows.union(_t(spark, d, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), none)).union(orders)


@query(f"""WITH RECURSIVE {_TREE_SQL}, up AS (SELECT id, id AS above, parent_id, 0 AS d, v FROM nodes UNION ALL SELECT up.id, n.id, n.parent_id, d + 1, up.v FROM up JOIN nodes n ON n.id = up.parent_id),
t AS (SELECT id, max(d) AS depth, max_by(above, d) AS top FROM up GROUP BY id), b AS (SELECT above AS id, count(*) AS size, sum(v)::BIGINT AS total, max(v) AS most FROM up GROUP BY 1)
SELECT id, top, depth::BIGINT AS depth, size, total, most FROM t JOIN b USING (id)""")
def tree_rollup(spark, d):
    rows = _tree(spark, d).select("id", "parent_id", F.lit(1).cast("long").alias("size"), F.col("v").alias("total"), F.col("v").alias("most"))
    return trees.doubled(rows, {"size": "sum", "total": "sum", "most": "max"}).drop("cycle")


@query(f"""WITH RECURSIVE {_TREE_SQL}, down AS (SELECT id, [id] AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, list_append(path, n.id) FROM down JOIN nodes n ON n.parent_id = down.id)
SELECT id, row_number() OVER (ORDER BY path) AS walk FROM down""")
def tree_walk(spark, d):
    return trees.walked(_tree(spark, d).select("id", "parent_id"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) + 1 AS parent_id FROM customer),
up AS (SELECT id, parent_id AS above FROM n UNION SELECT up.id, n.parent_id FROM up JOIN n ON n.id = up.above),
ring AS (SELECT id FROM up WHERE above = id), below AS (SELECT above AS id, count(*) FILTER (id <> above) AS n FROM up GROUP BY 1)
SELECT n.id, ring.id IS NOT NULL AS cycle, CASE WHEN ring.id IS NULL THEN coalesce(below.n, 0) + 1 END AS size FROM n LEFT JOIN ring ON ring.id = n.id LEFT JOIN below ON below.id = n.id""")
def tree_cycles(spark, d):
    """Customers with each one's parent by a formula: trees that hang on cycles."""
    customer = _t(spark, d, "customer")
    key = F.col("c_custkey")
    rows = customer.select(key.alias("id"), ((key * key + 1) % customer.count() + 1).alias("parent_id"), F.lit(1).cast("long").alias("size"))
    return trees.doubled(rows, {"size": "sum"}).select("id", "cycle", "size")


@query(f"""WITH RECURSIVE a AS (SELECT label, atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) AS a FROM embeddings), n AS (
  SELECT label, a, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY label) + 2 * {_PI}) - a AS g FROM a WINDOW w AS (PARTITION BY label ORDER BY a)),
f AS (SELECT label, 0 AS nth, NULL::DOUBLE AS theta, list(struct_pack(g := g, a := a)) AS gaps FROM n GROUP BY label
 UNION ALL SELECT label, nth + 1, (b.a + b.g / 2 + {_PI}) - 2 * {_PI} * floor((b.a + b.g / 2 + {_PI}) / (2 * {_PI})) - {_PI},
   list_filter(gaps, lambda x: x <> b) || [struct_pack(g := b.g / 2, a := b.a), struct_pack(g := b.g / 2, a := (b.a + b.g / 2 + {_PI}) - 2 * {_PI} * floor((b.a + b.g / 2 + {_PI}) / (2 * {_PI})) - {_PI})]
  FROM (SELECT *, list_reduce(gaps, lambda p, q: CASE WHEN p.g > q.g OR (p.g = q.g AND p.a < q.a) THEN p ELSE q END) AS b FROM f WHERE nth < 25 + label))
SELECT label, nth::INT AS nth, round(theta, 6) AS theta FROM f WHERE nth > 0""")
def ring_inserts(spark, d):
    """25 nodes and more put into the ring of each label, siblings staying where they are."""
    e = _t(spark, d, "embeddings")
    rings = e.select("label", F.atan2(F.element_at("embedding", 2).cast("double"), F.element_at("embedding", 1).cast("double")).alias("angle"))
    wanted = e.select("label").distinct().withColumn("k", F.col("label") + 25)
    return layout.inserted(rings, wanted, "label").select("label", F.col("nth").cast("int").alias("nth"), F.round("theta", 6).alias("theta"))


@query("""WITH e AS (SELECT DISTINCT user_id, ts FROM events WHERE user_id IS NOT NULL), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM e)
SELECT user_id, ts FROM n WHERE (nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000::BIGINT) AND epoch_us(ts) // 1000 + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def debounce_stream(spark, d):
    """The ends of bursts of each user's events, by a stream over the table with keyed state and timers, run to the table's end."""
    schema = _t(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, as the stream takes no single file
    folder = work.new_folder(spark, "debounced")
    run = debounce.settled(events, "user_id", "ts", 3600).writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id long, ts timestamp").parquet(folder).where("user_id is not null")


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS ord, o_custkey AS a, (o_custkey * 7 + o_orderkey % 3) % (SELECT count(*) FROM customer) + 1 AS b FROM orders),
f AS (SELECT c_nationkey AS nation, -1::BIGINT AS ord, NULL::BIGINT AS a, NULL::BIGINT AS b, list(c_custkey) AS ids, 0 AS came, 0 AS taken FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1
 UNION ALL SELECT nation, x.ord, x.a, x.b, CASE WHEN x.old THEN ids ELSE list_distinct(ids || [x.a, x.b]) END, came + CASE WHEN x.old THEN 0 ELSE 1 END, taken + 1
 FROM (SELECT nation, any_value(ids) AS ids, any_value(came) AS came, any_value(taken) AS taken, min_by(struct_pack(ord := l.ord, a := l.a, b := l.b, old := list_contains(ids, l.a) AND list_contains(ids, l.b)), l.ord) AS x
  FROM f JOIN l ON l.ord > f.ord AND l.a <> l.b AND (list_contains(ids, l.a) OR list_contains(ids, l.b)) AND (came < 30 OR (list_contains(ids, l.a) AND list_contains(ids, l.b))) WHERE taken < 60 GROUP BY nation))
SELECT nation, ord, a AS "from", b AS "to" FROM f WHERE ord >= 0""")
def wormholes(spark, d):
    """A view a nation, of one market segment: orders in their sequence link customers, and pull up to 30 of them in by up to 60 links."""
    customer = _t(spark, d, "customer")
    key = F.col("o_custkey")
    links = _t(spark, d, "orders").select(key.alias("from"), ((key * 7 + F.col("o_orderkey") % 3) % customer.count() + 1).alias("to"), F.col("o_orderkey").alias("place")).where("`from` <> `to`")
    views = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("view"), F.col("c_custkey").alias("id"))
    taken = view.wormholes(views, links, 30, 60)[1]
    return taken.select(F.col("view").alias("nation"), F.col("place").alias("ord"), "from", "to")


@query("""WITH f AS (SELECT source AS root, lang AS dir, source || '/' || lang || '/' || doc_id || '.txt' AS file, length(coalesce(text, '')) AS chars,
  len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents)
SELECT root, dir, file, grouping(root, dir, file)::BIGINT AS level, count(*) AS files, sum(lines)::BIGINT AS lines, sum(chars)::BIGINT AS chars, max(chars)::BIGINT AS longest FROM f GROUP BY ROLLUP (root, dir, file)""")
def tree_totals(spark, d):
    """Files, lines and characters of every file, folder, root and of all."""
    docs = _t(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("source").alias("root"), F.col("lang").alias("dir"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.size(F.split(text, "\n")).alias("lines"), F.length(text).alias("chars"))
    return view.totals(rows, ["root", "dir", "file"], [F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.max("chars").cast("long").alias("longest")])


# ---- indexes ---------------------------------------------------------------------------------------------------


_RARE_SQL = """SELECT item_id AS query_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda w: struct_pack(n := -length(w), w := w)))[1:3],
  lambda s: s.w), ' ') AS query FROM benchmark"""


def longest_words(spark, d):
    """Of each benchmark item the three longest words, as a query over all roots."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    first = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.transform(first, lambda s: s["w"]), " ").alias("query"), F.lit(None).cast("string").alias("root"))


@query(_search_sql(_RARE_SQL, 5))
def search_indexed(spark, d):
    """The longest words of the benchmark's items over documents, by an index of grams."""
    keep = work.shared(spark)
    return grams.build(scan.documents_as_nodes(_t(spark, d, "documents")), keep).search(longest_words(spark, d), keep, limit=5)[0]


@query()
def vector_ivf(spark, d):
    """The ten nearest vectors of each fiftieth, by inverted lists, with the recall of all of them against the exact ones."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    keep = work.shared(spark)
    found = keep(ivf.build(v, keep).search(q, 10), "found")
    recall = ivf.recall(found, search.vector_topk(v, q, 10))
    return found.select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"), F.lit(round(recall, 4)).alias("recall"))
