"""Trees that are known by parent_id alone: totals below and above each node by doubling.

After k rounds a node knows its ancestor 2**k steps up, what lies on the way there, and what lies less than 2**k steps
below it, so a tree of depth d takes log2(d) rounds, each of two joins; no path and no closure is ever held.  A node that
still has an ancestor after as many rounds as its tree could be deep stands on a cycle or below one.

Nodes that have come to their top (after some rounds most) don't ask for an ancestor any more: they would all ask for null,
in one task.  Tables of nodes are merged, never broadcast, so nothing that grows with them passes through the driver.

Ids are distinct; a parent that is no node counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import work

_COMBINE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def doubled(nodes: DataFrame, below: dict[str, str] | None = None, above: list[str] | None = None) -> DataFrame:
    """id, top, depth, cycle, and columns of `nodes` (id, parent_id, ...) added up.

    below: column -> sum, max or min over the node and all below it; null for nodes on a cycle.
    above: columns summed over the node and all above it; null, as top and depth, for nodes on a cycle or below one.
    cycle: whether the node is on a cycle.
    """
    below, above = below or {}, above or []
    keep, spark = work.shared(nodes.sparkSession), nodes.sparkSession
    there = nodes.select(F.col("id").alias("up"))
    rows = nodes.select("id", F.col("parent_id").alias("up"), *below, *above).join(there.withColumn("_is", F.lit(True)).hint("merge"), "up", "left")
    up = F.when(F.col("_is"), F.col("up"))
    state = keep(rows.select("id", up.alias("up"), F.coalesce(up, "id").alias("top"), up.isNotNull().cast("long").alias("depth"), *below, *above), "tree")
    rounds, left = 0, state.where("up is not null").count()
    most = state.count().bit_length()
    while left and rounds <= most:
        far = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in above])
        arrived = state.where("up is null")
        following = state.where("up is not null").join(far.hint("merge"), "up", "left").unionByName(arrived, allowMissingColumns=True)
        if below:
            got = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(*[_AGG[how](c).alias(f"_{c}") for c, how in below.items()])
            following = following.join(got.hint("merge"), "id", "left")
        columns = [F.coalesce(_COMBINE[how](F.col(c), F.coalesce(f"_{c}", c) if how != "sum" else F.coalesce(F.col(f"_{c}"), F.lit(0))), c).alias(c) for c, how in below.items()]
        columns += [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in above]
        following = following.select("id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), *columns)
        following = keep(following, "tree")
        work.forget(state)
        state, rounds = following, rounds + 1
        left = state.where("up is not null").count()
    if not left:
        return state.select("id", "top", "depth", F.lit(False).alias("cycle"), *below, *above)
    ring = state.where("up is not null").select(F.col("up").alias("id")).distinct().withColumn("cycle", F.lit(True))  # 2**rounds steps up is on the cycle
    out = state.join(ring.hint("merge"), "id", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))
    clear = F.col("up").isNull()
    return out.select("id", F.when(clear, F.col("top")).alias("top"), F.when(clear, F.col("depth")).alias("depth"), "cycle", *[F.when(~F.col("cycle"), F.col(c)).alias(c) for c in below], *[F.when(clear, F.col(c)).alias(c) for c in above])


def walked(nodes: DataFrame, *order) -> DataFrame:
    """id, walk: the number (from 1) of a node in a walk that has parents before children, siblings by `order` and id.

    What stands on a cycle or below one comes last, by id.  A node's number is the sum, on the path from the top, of one
    and the sizes of the subtrees of earlier siblings.
    """
    keep = work.shared(nodes.sparkSession)
    ids = nodes.select(F.col("id").alias("parent_id")).withColumn("_is", F.lit(True))
    own = nodes.join(ids.hint("merge"), "parent_id", "left").withColumn("parent_id", F.when(F.col("_is"), F.col("parent_id"))).drop("_is").withColumn("size", F.lit(1).cast("long"))
    sized = doubled(own, {"size": "sum"})
    clear = keep(own.drop("size").join(sized.where("depth is not null").select("id", "size").hint("merge"), "id"), "walk")
    before = keep(work.summed_before(clear, "before", "size", F.col("parent_id").asc_nulls_first(), *order, "id").select("id", "parent_id", "before"), "walk")
    first = before.groupBy(F.col("parent_id").alias("p")).agg(F.min("before").alias("first"))
    steps = before.join(first.hint("merge"), F.col("parent_id").eqNullSafe(F.col("p"))).select("id", "parent_id", (F.col("before") - F.col("first") + 1).alias("walk"))
    numbers = doubled(steps, above=["walk"]).select("id", "walk")
    rest = sized.where("depth is null").select("id")
    if rest.isEmpty():
        return numbers
    n = clear.count()
    return numbers.unionByName(work.numbered(rest, "walk", "id").select("id", (F.col("walk") + n).cast("long").alias("walk")))
