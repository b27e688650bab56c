"""Budget-bounded packing: one fold over each query's candidates, each in the densest form that fits.

A candidate comes with its forms rendered: full, stub, contract, line, skeleton.  The fold is a higher-order
aggregate, so a whole table of queries is packed in one stage, without Python.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from . import extract as X

ITEM = "struct<pos:int,id:string,score:int,role:string,level:string,text:string>"
FORMS = "full string, stub string, contract string, line string, base string, rest array<string>, demoted string"


# ---- forms -----------------------------------------------------------------------------------------------------


def numbered(lines: list[str], start: int, end: int) -> str:
    return "\n".join(f"{n:>4}: {lines[n - 1]}" for n in range(max(1, start), min(len(lines), end) + 1))


def header(r) -> str:
    path = r.source_path or "(memory)"
    return f"### {r.title}\nsource: {path}:{r.line_start}-{r.line_end}" if r.line_start and r.line_end else f"### {r.title}\nsource: {path}"


def skeleton(head: str, path: str, text: str, words: list[str]) -> tuple[str, list[str], str] | None:
    """Of a file: header with the meant symbols in full, the contracts of the others, and all in contracts."""
    lines, low = text.splitlines(), [w.lower() for w in words]
    if path.lower().endswith(".py"):
        try:
            tops = [n for n in ast.parse(text).body if isinstance(n, X._SCOPES)]
        except (SyntaxError, ValueError, RecursionError):
            return None
        parts = [(n.name, numbered(lines, n.lineno, n.end_lineno), X.contract(n)) for n in tops]
        banner = "# --- module skeleton: focus symbol full, rest as contracts ---"
    else:
        parts, banner = _brace_parts(path, lines), "# --- module skeleton (generic): focus symbol full, rest as contracts ---"
    if not parts:
        return None
    meant = [p for p in parts if p[0] and any(w in p[0].lower() for w in low)]
    base = "\n".join([head, banner, *(p[1] for p in meant)])
    return base, [p[2] for p in parts if p not in meant], "\n".join([head, banner, *(p[2] for p in meant or parts[:1])])


def _brace_parts(path: str, lines: list[str]) -> list[tuple[str, str, str]]:
    import re

    suffix = "." + path.rsplit(".", 1)[-1].lower()
    specs = [(re.compile(p.replace("(?U)", "")), kind) for p, kind in K.DEFINITIONS.get(suffix, ())]
    out = []
    for no, line in enumerate(lines, 1):
        hit = next(((m[1], kind) for p, kind in specs if (m := p.match(line))), None)
        if hit:
            balance, saw, end = 0, False, min(len(lines), no + 32)
            for k in range(no, min(len(lines), no + 120) + 1):
                balance += lines[k - 1].count("{") - lines[k - 1].count("}")
                saw |= "{" in lines[k - 1]
                if saw and balance <= 0 and k > no:
                    end = k
                    break
            bare = line.strip()
            bare = bare[: bare.index("{") + 1] + " … }" if "{" in bare else bare
            out.append((hit[0], numbered(lines, no, end), f"{hit[1]} {hit[0]}  →  {bare}"))
    return out


def forms(r) -> tuple:
    """The forms of a candidate row: node fields, text of its file and brace_contract of its lines, role, origin_title, link_type, label, words."""
    text = r.text if isinstance(r.text, str) else None
    lines, head, is_file = (text or "").splitlines(), header(r), r.node_type == "file"
    prefix = ""
    if r.role:
        relation = "called by" if r.role == "caller" else "calls"
        prefix = f"### Wormhole [{r.link_type}]: {r.origin_title} {relation} this\nvia: {r.label or r.link_type}()\n"
    start = int(r.line_start or 1)
    end = int(r.line_end or min(len(lines), start + 60))
    body = numbered(lines, start, end) if text is not None else ""
    body = (body or r.detail_content or r.summary or "").strip()
    full = f"{prefix}{head}\n{body}" if body else None
    tag = lambda word: f"{prefix.rstrip()} [{word}]\n" if prefix else ""
    stub = contract = line = None
    sign = short = ""
    if text and not is_file:
        known = X.described("\n".join(lines[max(1, start) - 1 : end])) if (r.source_path or "").lower().endswith(".py") else None
        sign, short = known[:2] if known else ("", r.brace_contract or "")
    if r.role and not is_file:
        where = f"{r.source_path or '(memory)'}" + (f":{r.line_start}-{r.line_end}" if r.line_start and r.line_end else "")
        stub = (tag(f"{r.role}-contract") + f"### {r.title}\nsource: {where}" + (f"\n{sign}" if sign else ""))[: K.STUB_CHARS]
        at = (r.source_path or "") + (f":{r.line_start}" if r.source_path and r.line_start else "")
        line = f"{r.role}: {r.title} — {at}" if at else f"{r.role}: {r.title}"
    if short and not is_file:
        contract = f"{tag('contract')}{head}\n{short}"
    parts = skeleton(head, r.source_path or "", text, list(r.words if r.words is not None else [])) if is_file and text else None
    base, rest, demoted = (tag("skeleton") + parts[0], parts[1], tag("skeleton") + parts[2]) if parts else (None, None, None)
    return full, stub, contract, line, base, rest, demoted


def rendered(candidates: DataFrame) -> DataFrame:
    """candidates with their forms; Python, as contracts need syntax trees, over a query's few candidates only."""
    keep = ["query_id", "pos", "id", "score", "role", "node_type", "title", "critical"]
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            nullable = pdf.astype(object).where(pdf.notna(), None)
            out = [(*(getattr(r, c) for c in keep), *forms(r)) for r in nullable.itertuples()]
            yield pd.DataFrame(out, columns=[*keep, *(f.split()[0] for f in FORMS.split(", "))])

    return candidates.mapInPandas(run, f"{kinds}, {FORMS}")


# ---- the fold --------------------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _choice(c: Column, room: Column) -> Column:
    """(level, text) of the first form of the ladder that fits; null text if none does."""
    fits = lambda x: x.isNotNull() & (F.length(x) <= room)
    of = lambda level, x: F.struct(F.lit(level).alias("level"), x.alias("text"))
    focus, via, file_ = c["pos"] == 1, c["role"].isNotNull(), c["node_type"] == "file"
    full, micro = c["full"], F.length(c["full"]) <= K.MICRO_FOCUS
    bare = F.concat_ws(": ", c["role"], c["title"])
    joined = lambda parts: F.array_join(F.concat(F.array(c["base"]), parts), "\n")
    # so many of the other parts as fit: of all prefixes the longest
    count = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c["rest"]))), lambda k: F.length(joined(F.slice(c["rest"], 1, k))) <= room))
    skeleton_ = F.when(F.size(c["rest"]) <= 0, c["base"]).otherwise(joined(F.slice(c["rest"], 1, count)))
    skeleton_ = F.when(c["base"].isNull(), None).when(fits(c["base"]), skeleton_).when(fits(c["demoted"]), c["demoted"])
    nothing = F.struct(F.lit("none").alias("level"), F.lit(None).cast("string").alias("text"))
    return (
        F.when(full.isNull(), nothing).when(fits(full), of("full", full))
        .when(c["critical"] & focus & micro, of("full", full)).when(c["critical"] & ~via, nothing)
        .when(via & ~file_ & fits(c["stub"]), of("contract", c["stub"])).when(~file_ & fits(c["contract"]), of("contract", c["contract"]))
        .when(via & ~file_ & fits(c["line"]), of("stub", c["line"])).when(via & ~file_ & fits(bare), of("stub", bare))
        .when(file_ & fits(skeleton_), of("skeleton", skeleton_)).when(focus & micro, of("full", full)).otherwise(nothing)
    )


def folded(candidates: Column, budget: Column, zoom: Column) -> Column:
    """used and items of one query's candidates (an array of structs in order)."""
    cap = F.greatest(F.lit(K.LEAST_SECTION), F.floor(budget / (3 + F.bround(9 * zoom, 0))).cast("int"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast(f"array<{ITEM}>").alias("items"))

    def step(acc: Column, c: Column) -> Column:
        left = budget - acc["used"]
        room = F.when((c["pos"] == 1) | c["critical"] | (zoom < 0.34), left).otherwise(F.least(left, cap))
        return F.when(acc["done"], acc).when(left < K.LEAST_SECTION, stopped(acc)).otherwise(_let(_choice(c, room), lambda pick: with_pick(acc, c, pick)))

    def stopped(acc: Column) -> Column:
        return F.struct(acc["used"].alias("used"), F.lit(True).alias("done"), acc["items"].alias("items"))

    def with_pick(acc: Column, c: Column, pick: Column) -> Column:
        n = F.length(pick["text"])
        taken = pick["text"].isNotNull() & ((acc["used"] + n <= budget) | ((c["pos"] == 1) & (pick["level"] == "full") & (n <= K.MICRO_FOCUS)))
        item = F.struct(c["pos"].cast("int").alias("pos"), c["id"].alias("id"), c["score"].cast("int").alias("score"), c["role"].alias("role"), pick["level"].alias("level"), pick["text"].alias("text"))
        grown = F.struct((acc["used"] + n).alias("used"), (acc["used"] + n >= budget).alias("done"), F.concat(acc["items"], F.array(item.cast(ITEM))).alias("items"))
        return F.when(taken, grown).otherwise(acc)

    return F.aggregate(candidates, zero, step)


def packed(queries: DataFrame, forms_: DataFrame) -> DataFrame:
    """query_id, budget, used, selected_count, selected, compiled_context of each query.

    queries: query_id, query, budget.  forms_: candidates with pos and their forms; a query's candidates are bounded
    by its seeds and their links.
    """
    cols = [c for c in forms_.columns if c not in ("query_id", "pos")]
    lists = forms_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("cands"))
    q = queries.withColumn("budget", F.greatest(F.lit(K.LEAST_BUDGET), F.coalesce("budget", F.lit(K.CONTEXT_BUDGET))).cast("int"))
    rows = q.join(lists, "query_id", "left").withColumn("zoom", S.query_zoom(F.col("query"), F.col("budget")))
    some = F.coalesce("cands", F.array().cast(lists.schema["cands"].dataType))
    rows = rows.withColumn("out", folded(some, F.col("budget"), F.col("zoom")))
    text = F.array_join(F.transform("out.items", lambda i: i["text"]), "\n\n")
    return rows.select("query_id", "query", "budget", F.col("out.used").alias("used"), F.size("out.items").alias("selected_count"), F.transform("out.items", lambda i: i.dropFields("text")).alias("selected"), text.alias("compiled_context"))


def greedy(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Of each group the items that a greedy pass takes: an item that doesn't fit is passed over, the pass goes on.

    The groups are folded whole, so they have to be of bounded size (a query's candidates).
    """
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("size")))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    fold = F.aggregate("xs", zero, lambda acc, x: F.when(acc["used"] + x["size"] <= budget, F.struct((acc["used"] + x["size"]).cast("long").alias("used"), F.concat(acc["taken"], F.array(x[order[-1]].cast("long"))).alias("taken"))).otherwise(acc))
    return lists.select(group, fold.alias("f")).select(group, F.col("f.used").alias("used"), F.col("f.taken").alias("taken"))
