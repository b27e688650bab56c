"""Links between symbols: resolving references, bridges between languages, normal form, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import extract as X

EMITTING = ("class", "function", "block")


def first_targets(refs: DataFrame, targets: DataFrame, scope: str | None = None, file: str = "rel", own: bool = True) -> DataFrame:
    """refs with `to`, the target of the same name (ref) and `scope`: another file's before the own file's, then by to_ord, to.

    refs: node_id, ref, and `file`, the file they stand in; targets: to (distinct in a name), ref, to_ord, and to_`file`.
    Refs that have no target but themselves are left out, without `own` those too that have one in their own file alone.
    A null file is one of its own.

    References and targets of a name are never paired: of a name's definitions in a file the first two are kept (one may
    be the reference's own), and of the files the first three, so what is joined and sorted grows with the rows, not
    with their products, however many share a name.
    """
    keys = ["ref", *([scope] if scope else [])]
    given = targets.select(*keys, F.col(f"to_{file}").alias("_file"), F.struct(F.col("to_ord").alias("ord"), F.col("to").alias("to")).alias("_place"))
    places = given.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_file").orderBy("_place"))).where("_n <= 2")
    files = places.groupBy(*keys, "_file").agg(F.array_sort(F.collect_list("_place")).alias("_here"))
    few = files.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_here")[0]))).where("_n <= 3")
    rows = refs.join(few.groupBy(*keys).agg(F.collect_list(F.struct("_file", "_here")).alias("_few")), keys)
    others = F.flatten(F.transform(F.filter("_few", lambda f: ~f["_file"].eqNullSafe(F.col(file))), lambda f: f["_here"]))
    first = lambda these: F.get(F.array_sort(F.filter(these, lambda p: p["to"] != F.col("node_id"))), F.lit(0))
    rows = rows.withColumn("_to", first(others)).drop("_few")
    if own:
        mine = files.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_file"), "_here")
        same = F.col(file).eqNullSafe(F.col("_file"))
        for k in keys:
            same &= F.col(k) == F.col(f"_{k}")
        rows = rows.join(mine, same, "left").withColumn("_to", F.coalesce("_to", first(F.col("_here")))).drop(*[f"_{k}" for k in keys], "_file", "_here")
    return rows.where("_to is not null").withColumns({"to": F.col("_to.to"), "to_ord": F.col("_to.ord")}).drop("_to")


def resolved(symbols: DataFrame) -> DataFrame:
    """from, to, type, label of each reference that names a definition.

    symbols: node_id, rel, kind, name, line_start, snippet, refs, exact, ord (global order of definitions).

    A reference that is also the name of a called procedure, a table or an edge function goes to the database or that
    function, in whatever language; any other stays in its language.  One target a reference: another file's before
    the own file's, the first definition first.  Then string literals that name a symbol of another language.
    """
    src = symbols.where(F.col("kind").isin(*EMITTING)).withColumns({
        "rpc": X.rpc_references(F.col("snippet")), "edge": X.edge_references(F.col("snippet")), "tab": X.table_references(F.col("snippet")),
        "lang": T.language("rel"), "own": F.coalesce("refs", X.references(F.col("snippet"))),
    })
    src = src.withColumn("db", F.array_union("rpc", "tab"))
    src = src.withColumn("every", F.array_distinct(F.concat("own", F.array_sort(F.array_union("db", "edge")))))
    targets = symbols.select(F.col("name").alias("ref"), F.col("node_id").alias("to"), F.col("rel").alias("to_rel"), F.col("ord").alias("to_ord"), T.language("rel").alias("to_lang"))

    refs = src.select("node_id", "rel", "lang", "exact", "db", "edge", F.col("refs").isNotNull().alias("given"), F.explode("every").alias("ref"))
    refs = refs.withColumns({"is_db": F.array_contains("db", F.col("ref")), "is_edge": F.array_contains("edge", F.col("ref"))})
    # where a name is looked for: in its language, or in databases and edge functions, whatever the language
    edge = (F.col("to_lang") == "jsts") & X.is_edge_path(F.col("to_rel"))
    scopes = F.array(F.concat(F.lit("in "), "to_lang"), F.when(F.col("to_lang") == "sql", "db"), F.when(edge, "edge"), F.when((F.col("to_lang") == "sql") | edge, "both"))
    placed = targets.withColumn("scope", F.explode(F.array_compact(scopes)))
    scope = F.when(F.col("is_db") & F.col("is_edge"), "both").when(F.col("is_db"), "db").when(F.col("is_edge"), "edge").otherwise(F.concat(F.lit("in "), "lang"))
    both = first_targets(refs.withColumn("scope", scope), placed, "scope")
    kind = F.when(F.col("is_db") | F.col("is_edge") | (F.col("exact") & F.col("given")), "syntax_dependency").otherwise("dependency")
    direct = both.select(F.col("node_id").alias("from"), "to", kind.alias("type"), F.col("ref").alias("label"))

    words = src.select("node_id", "lang", F.explode(F.array_except(X.string_tokens(F.col("snippet")), F.array_union("db", "edge"))).alias("ref"))
    over = first_targets(words, targets, file="lang", own=False)
    over = over.join(direct.select(F.col("from").alias("node_id"), "to", F.col("label").alias("ref")), ["node_id", "to", "ref"], "left_anti")
    over = over.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("ref"))).where(F.col("n") <= K.BRIDGES_PER_SYMBOL)
    bridges = over.select(F.col("node_id").alias("from"), "to", F.lit("syntax_dependency").alias("type"), F.col("ref").alias("label"))
    return direct.unionByName(bridges)


def normalized(links: DataFrame, order: list) -> DataFrame:
    """Without empty ends and loops; of links alike in from, to, type and label the first."""
    real = links.where("`from` <> '' and `to` <> '' and `from` <> `to`")
    first = Window.partitionBy("from", "to", "type", "label").orderBy(*order)
    return real.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of which both ends are nodes."""
    ids = nodes.select("id").distinct()
    return links.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("from").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("to").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def neighbours(links: DataFrame) -> DataFrame:
    """Ids linked to each id in either direction (the gold sets of retrieval)."""
    pairs = links.select(F.col("from").alias("id"), F.col("to").alias("near")).unionByName(links.select(F.col("to").alias("id"), F.col("from").alias("near")))
    return pairs.where("id <> near").distinct()


def ancestors(nodes: DataFrame, key: str = "path") -> DataFrame:
    """Each path with every directory above it, by exploding its prefixes (no recursion)."""
    parts = F.split(F.col(key), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return nodes.where(F.size(parts) > 1).select("*", F.explode(above).alias("ancestor"))
