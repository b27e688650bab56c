"""Scores as column expressions: lexical match, source rank, cosine, zoom, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col, contains_any, terms


def lexical_score(query: Column, words: Column, title: Column, summary: Column, detail: Column, node_type: Column, path: Column) -> Column:
    """Ten for each term in the title, six in the path, two anywhere; more for the whole query, and for symbols and files.

    The lower-cased fields are bound once, by transforming a one-element array, so that each term costs three searches.
    """
    path_, none = F.coalesce(path, F.lit("")), F.lit("")
    fields = F.struct(
        F.lower(title).alias("t"), F.lower(path_).alias("p"),
        F.lower(F.concat_ws(" ", title, F.coalesce(summary, none), F.left(F.coalesce(detail, none), F.lit(1200)), node_type, path_)).alias("h"),
    )

    kind = F.when(node_type == "symbol", 3).when(node_type == "file", 2).otherwise(0)
    return F.element_at(F.transform(F.array(fields), lambda f: field_points(words, F.lower(query), f["t"], f["p"], f["h"])), 1) + kind


def field_points(words: Column, low: Column, title: Column, path: Column, text: Column) -> Column:
    """Points of a lower-cased query and its terms in lower-cased fields."""
    points = lambda where, n, t: F.when(F.contains(where, t), n).otherwise(0)
    by_term = F.aggregate(words, F.lit(0), lambda acc, t: acc + points(title, 10, t) + points(path, 6, t) + points(text, 2, t))
    return by_term + points(title, 20, low) + points(path, 12, low)


def search_fields(title: Column, summary: Column, detail: Column, node_type: Column, path: Column, whole: bool = False) -> list[Column]:
    """What lexical_score() looks at, lower-cased: t, p, h; points by kind; and the rank by path.  whole: details to their ends."""
    path_, none = F.coalesce(path, F.lit("")), F.lit("")
    detail = F.coalesce(detail, none)
    text = F.lower(F.concat_ws(" ", title, F.coalesce(summary, none), detail if whole else F.left(detail, F.lit(1200)), node_type, path_))
    kind = F.when(node_type == "symbol", 3).when(node_type == "file", 2).otherwise(0)
    return [F.lower(title).alias("t"), F.lower(path_).alias("p"), text.alias("h"), kind.alias("kind"), path_rank(path).alias("path_rank")]


def asks_for_tests(query: Column) -> Column:
    """Whether a query asks for tests or documents."""
    return F.coalesce(F.arrays_overlap(terms(query), F.array(*[F.lit(w) for w in K.TEST_DOC_WORDS])), F.lit(False))


def path_rank(path: Column) -> Column:
    """Runtime paths before others, tests and documents after them."""
    p = F.concat(F.lit("/"), F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")), "^/+", ""))
    up = F.when(contains_any(p, K.RUNTIME_PATHS), 0.08).otherwise(0.0)
    down = F.when(contains_any(p, K.TEST_DOC_PATHS) | F.endswith(p, F.lit("/readme.md")) | F.endswith(p, F.lit("/readme.mdx")), 0.10).otherwise(0.0)
    return up - down


def source_rank(query: Column, path: Column) -> Column:
    """Runtime paths before tests and documents, unless the query asks for those."""
    return F.when(asks_for_tests(query), 0.0).otherwise(path_rank(path))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Over the dimensions that both have; 0 where a norm is 0 or a vector is missing."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norms > 0), dot(x, y) / norms).otherwise(0.0)


def blended(score: Column, best: Column, semantic: Column, rank: Column, alpha: float = 5.0) -> Column:
    lexical = F.when(best > 0, score / best).otherwise(0.0)
    return F.greatest(F.lit(0.0), lexical + F.lit(alpha) * F.greatest(semantic, F.lit(0.0)) + rank)


def query_zoom(query: Column, budget: Column) -> Column:
    """0 (detail) to 1 (breadth), from hints in the query and the budget."""
    q = F.lower(query)
    z = F.lit(0.5) + F.when(contains_any(q, K.BROAD_HINTS), 0.35).otherwise(0.0) - F.when(contains_any(q, K.DETAIL_HINTS), 0.35).otherwise(0.0)
    z = z + F.when(budget >= 9000, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), z))


def critical(*parts: Column) -> Column:
    return F.rlike(F.lower(F.concat_ws("\n", *parts)), F.lit("|".join(K.CRITICAL_WORDS)))


def risk_score(*parts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    total = F.lit(0)
    for word, weight in K.RISK_WEIGHTS.items():
        total = total + F.when(F.contains(text, F.lit(word)), weight).otherwise(0)
    return F.least(F.lit(5), total)


def field_of_view(zoom: Column) -> Column:
    return F.lit(2.0) / F.greatest(F.lit(0.1), zoom)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
