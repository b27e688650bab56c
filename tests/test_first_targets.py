"""The first target of each reference, by plain search, and of a name that all share."""

import random

from arboria.operators import links


def plain(refs, targets, own):
    out = set()
    for n, rel, ref, scope in refs:
        some = [(r == rel, o, t) for t, r, f, s, o in targets if (f, s) == (ref, scope) and t != n and (own or r != rel)]
        if some:
            out.add((n, ref, min(some)[2]))
    return out


def test_first_targets_by_search(spark):
    rng = random.Random(4)
    targets = [(i, rng.choice("abcd"), rng.choice("xyz"), rng.choice("st"), rng.randrange(5)) for i in range(60)]
    refs = [(i, targets[i][1] if i < 60 and i % 3 else rng.choice("abcde"), ref, rng.choice("st")) for i in range(90) for ref in "xyzw"]
    refs += [(100, "a", "once", "s"), (101, "a", "twice", "s"), (102, None, "twice", "s")]
    targets += [(100, "a", "once", "s", 0), (101, "a", "twice", "s", 0), (102, None, "twice", "s", 1)]
    t = spark.createDataFrame(targets, "to long, to_rel string, ref string, scope string, to_ord long")
    r = spark.createDataFrame(refs, "node_id long, rel string, ref string, scope string")
    for own in (True, False):
        got = [(x.node_id, x.ref, x.to) for x in links.first_targets(r, t, "scope", own=own).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(refs, targets, own)


def test_a_name_of_all(spark):
    """40,000 references to a name with 40,000 definitions: pairs would be 1.6 milliards."""
    rows = spark.range(40_000)
    t = rows.selectExpr("id to", "concat('f', id % 7) to_rel", "'run' ref", "id to_ord")
    r = rows.selectExpr("id node_id", "concat('f', id % 7) rel", "'run' ref")
    got = {x.node_id: x.to for x in links.first_targets(r, t).collect()}
    assert got == {i: 1 if i % 7 == 0 else 0 for i in range(40_000)}
