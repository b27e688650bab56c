"""Spans, trees and rings against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arboria.operators import layout, spans, trees, view


def plain_stab(defs, names):
    """defs: (rel, id, name, start, stop); names: (rel, at, name)."""
    refs = {(d[0], d[1]): set() for d in defs}
    for rel, at, name in names:
        inside = [(d[3], -d[4], d[1], d[2]) for d in defs if d[0] == rel and d[3] <= at < d[4]]
        if inside and max(inside)[3] != name:
            refs[rel, max(inside)[2]].add(name)
    return sorted((k, sorted(v)) for k, v in refs.items())


def _stab(spark, defs, names):
    out = spans.stab_references(spark.createDataFrame(defs, "rel string, id int, name string, start int, stop int"), spark.createDataFrame([(r, a, [n, n]) for r, a, n in names], "rel string, at int, names array<string>"))
    return sorted(((r.rel, r.id), r.refs) for r in out.collect())


def test_nested_equal_touching_crossing_and_empty_spans(spark):
    rng = random.Random(1)
    defs = [("a", 1, "A", 0, 10), ("a", 2, "B", 2, 5), ("a", 3, "C", 5, 8), ("a", 4, "D", 2, 5), ("a", 5, "E", 7, 12), ("a", 6, "F", 4, 4), ("b", 1, "G", 3, 1 << 18)]
    defs += [("r", i, f"n{i % 9}", s := rng.randrange(200), s + rng.randrange(40)) for i in range(120)]
    names = [("a", i, f"x{i}") for i in range(14)] + [("a", 3, "D"), ("a", 3, "B"), ("b", 1 << 17, "y"), ("b", 2, "z"), ("c", 1, "alone")]
    names += [("r", rng.randrange(260), f"n{rng.randrange(12)}") for _ in range(900)]
    assert _stab(spark, defs, names) == plain_stab(defs, names)
    assert _stab(spark, defs, []) == plain_stab(defs, []) and _stab(spark, [], names) == []


def test_ten_thousand_names_of_a_file_make_no_pairs(spark):
    defs = [("f", i, f"d{i}", 10 * i, 10 * i + 9) for i in range(2000)]
    names = spark.range(10_000).selectExpr("'f' AS rel", "cast(2 * id AS int) AS at", "array(concat('m', id % 5)) AS names")
    out = spans.stab_references(spark.createDataFrame(defs, "rel string, id int, name string, start int, stop int"), names)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "start <= " not in plan and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert {len(r.refs) for r in out.collect()} == {5}


def plain_tree(nodes):
    """id -> (top, depth, on a cycle, ids below and itself or None on a cycle)."""
    parent = {i: p if p in {n[0] for n in nodes} else None for i, p in nodes}
    out, below = {}, {i: 0 for i in parent}
    for i in parent:
        seen, x = [i], parent[i]
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        ring = x == i
        out[i] = (None if x is not None else seen[-1], None if x is not None else len(seen) - 1, ring)
        for y in seen:
            below[y] += 1
    return {i: (*v, None if v[2] else below[i]) for i, v in out.items()}


def _tree(spark, nodes):
    df = spark.createDataFrame(nodes, "id long, parent_id long").selectExpr("id", "parent_id", "1L AS n", "1L AS steps", "id AS most")
    rows = trees.doubled(df, {"n": "sum", "most": "max"}, ["steps"]).collect()
    assert all((r.steps is None) == (r.depth is None) and (r.depth is None or r.steps == r.depth + 1) for r in rows)
    return {r.id: (r.top, r.depth, r.cycle, r.n) for r in rows}


def test_trees_cycles_and_lost_parents(spark):
    rng = random.Random(2)
    nodes = [(1, None), (2, 1), (3, 1), (4, 99), (5, 5), (6, 5), (7, 6), (8, 9), (9, 10), (10, 8), (11, 10), (12, 11)]
    nodes += [(i, 100 + rng.randrange(i - 100) if i > 100 else None) for i in range(100, 300)] + [(i, 400 + rng.randrange(80)) for i in range(400, 480)]
    assert _tree(spark, nodes) == plain_tree(nodes)


def test_a_chain_of_ten_thousand_takes_fourteen_rounds(spark):
    n = 10_000
    df = spark.range(n).selectExpr("id", "nullif(id, 0) - 1 AS parent_id", "1L AS n")
    rows = {r.id: r for r in trees.doubled(df, {"n": "sum"}).collect()}
    assert len(rows) == n and all(r.depth == i and r.n == n - i and r.top == 0 and not r.cycle for i, r in rows.items())


def test_walk_of_several_roots_and_a_cycle(spark):
    rng = random.Random(3)
    nodes = [(i, None if i < 3 else rng.randrange(i), rng.randrange(5)) for i in range(150)] + [(200, 201, 0), (201, 200, 0), (202, 201, 0)]
    kids = {}
    for i, p, o in nodes:
        kids.setdefault(p, []).append((o, i))
    order, todo = [], sorted(kids[None], reverse=True)
    while todo:
        _, i = todo.pop()
        order.append(i)
        todo += sorted(kids.get(i, []), reverse=True)
    order += [200, 201, 202]
    got = trees.walked(spark.createDataFrame(nodes, "id long, parent_id long, ord int"), "ord").orderBy("walk").collect()
    assert [(r.walk, r.id) for r in got] == list(enumerate(order, 1))


def one_by_one(angles, k):
    """k single inserts; gaps as (length, start)."""
    wrap = lambda x: (x + math.pi) % (2 * math.pi) - math.pi
    if not angles:
        return [-math.pi / 2, *one_by_one([-math.pi / 2], k - 1)] if k else []
    a = sorted(angles)
    gaps = [(b - x, x) for x, b in zip(a, [*a[1:], a[0] + 2 * math.pi], strict=True)]
    out = []
    for _ in range(k):
        best = max(gaps, key=lambda g: (g[0], -g[1]))
        gaps.remove(best)
        gaps += [(best[0] / 2, best[1]), (best[0] / 2, wrap(best[1] + best[0] / 2))]
        out.append(wrap(best[1] + best[0] / 2))
    return out


@pytest.mark.parametrize("k", [1, 2, 7, 64])
def test_several_inserts_are_single_ones(spark, k):
    rng = random.Random(k)
    rings = {1: [], 2: [0.3], 3: [-math.pi / 2, 0.0, math.pi / 2, -math.pi], 4: [rng.uniform(-math.pi, math.pi) for _ in range(30)], 5: [0.1, 0.1, 0.1, 3.0]}
    df = spark.createDataFrame([(g, a) for g, x in rings.items() for a in x], "g int, angle double")
    rows = layout.inserted(df, spark.createDataFrame([(g, k) for g in rings], "g int, k int"), "g").collect()
    for g, angles in rings.items():
        got = [r.theta for r in sorted((r for r in rows if r.g == g), key=lambda r: r.nth)]
        assert len(got) == k and got == pytest.approx(one_by_one(angles, k), abs=1e-9), g


def link_by_link(ids, links, neighbours, most):
    """The links that a view takes, one after another."""
    ids, came, out = set(ids), 0, []
    for place, a, b in sorted(links):
        new = {a, b} - ids
        if len(new) == 2 or (new and came >= neighbours):
            continue
        ids |= new
        came += len(new)
        out.append((place, a, b))
        if len(out) >= most:
            break
    return out, ids


@pytest.mark.parametrize("neighbours, most", [(180, 320), (3, 320), (180, 4), (0, 9)])
def test_wormholes_are_taken_link_by_link(spark, neighbours, most):
    rng = random.Random(neighbours + most)
    links = [(i, *rng.sample(range(60), 2)) for i in range(150)] + [(200 + i, 100 + i, 101 + i) for i in range(9)] + [(300, 111, 112), (301, 110, 111)]
    views = {0: [], 1: [1], 2: [2, 3, 100], 3: list(range(40)), 4: [500], 5: [112]}
    inside, taken = view.wormholes(spark.createDataFrame([(v, i) for v, ids in views.items() for i in ids], "view int, id long"), spark.createDataFrame(links, "place long, from long, to long"), neighbours, most)
    got, end = taken.collect(), inside.collect()
    for v, ids in views.items():
        want, there = link_by_link(ids, links, neighbours, most)
        assert sorted((r.place, r["from"], r["to"]) for r in got if r.view == v) == want
        assert {r.id for r in end if r.view == v} == there


def test_totals_of_every_level(spark):
    rows = [("a", "x", "f", 1), ("a", "x", "g", 2), ("a", None, "h", 4), ("b", "x", "f", 8), (None, None, None, 16)]
    got = view.totals(spark.createDataFrame(rows, "root string, dir string, file string, n int"), ["root", "dir", "file"], [F.sum("n").alias("n")]).collect()
    want = {}
    for *path, n in rows:
        for k in range(4):
            key = (*path[:k], *[None] * (3 - k), (1 << 3 - k) - 1)
            want[key] = want.get(key, 0) + n
    assert {(r.root, r.dir, r.file, r.level): r.n for r in got} == want and len(got) == len(want)


def test_trees_are_merged_not_broadcast(spark, monkeypatch):
    """Nothing of a tree is broadcast, and nodes that came to their top ask for no ancestor, though most do in the first rounds."""
    from arboria.operators import trees

    plans, shared = [], trees.work.shared

    def watching(session):
        keep = shared(session)

        def kept(df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df, name)

        return kept

    monkeypatch.setattr(trees.work, "shared", watching)
    nodes = spark.range(300).selectExpr("id", "if(id < 200, null, id - 100) parent_id", "1L size")
    got = {r.id: (r.top, r.depth, r.size) for r in trees.doubled(nodes, {"size": "sum"}).collect()}
    assert got == {i: (i if i < 200 else i - 100, int(i >= 200), 2 if 100 <= i < 200 else 1) for i in range(300)}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
    assert all("isnotnull(up" in p for p in plans[1:])
