"""Keys, paths, lines and terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: Column | str) -> Column:
    """Lower-cased runs of term characters of two or more, repetitions kept."""
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(K.TERM), F.lit(0)), lambda t: F.length(t) >= 2)


def lines(text: Column | str) -> Column:
    """The lines of a text at any line end; no empty one after the last."""
    t = col(text)
    parts = F.split(t, LINE_END)
    return F.when((F.coalesce(F.length(t), F.lit(0)) == 0), F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column | str) -> Column:
    """Line feeds and one; 0 for an empty text."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)


def snippet(text: Column | str, start, end, most: int = 3500) -> Column:
    """Lines start to end; beyond `most` characters cut, with a note."""
    all_lines = lines(text)
    a = F.greatest(F.lit(1), start)
    b = F.least(F.size(all_lines), F.greatest(a, end))
    s = F.array_join(F.when(b >= a, F.slice(all_lines, a, b - a + 1)).otherwise(F.array().cast("array<string>")), "\n")
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.left(s, F.lit(most))), F.lit("\n[snippet truncated]"))).otherwise(s)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased suffix with its dot; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.LANGUAGES.items() for x in pair])
    s = suffix(F.coalesce(col(path), F.lit("")))
    return F.coalesce(F.element_at(known, s), s)


def slug(text: Column, most: int, other: Column) -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))
    return F.when(s == "", other).otherwise(s)


def stable_id(kind: Column, key: Column, salt: Column) -> Column:
    """slug of kind-key, and ten hex digits of sha1(kind|key|salt)."""
    digest = F.sha1(F.concat_ws("|", kind, key, salt).cast("binary"))
    return F.concat(slug(F.concat_ws("-", kind, key), 52, kind), F.lit("-"), F.left(digest, F.lit(10)))


def concept_id(title: Column, summary: Column) -> Column:
    digest = F.sha1(F.concat_ws("\n", title, summary).cast("binary"))
    return F.concat(slug(title, 42, F.lit("node")), F.lit("-"), F.left(digest, F.lit(8)))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def human_bytes(n: float) -> str:
    """For reports: 1536 -> '1.5 KB'."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""
