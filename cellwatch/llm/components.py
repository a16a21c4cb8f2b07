"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, root)`` for every node that has a link.

    Each round every node joins the class of the neighbour (or itself) with the least random
    rank, and the links are rewritten between classes. A class is connected and the quotient of
    a connected graph is connected, so no component is split; random ranks shrink the graph by a
    constant factor each round whatever its shape, so long chains end in few rounds. All steps are
    partial aggregations and equi-joins; nothing is collected. Null ends and self-links are ignored.
    """
    edges = scratch.save(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-edges-0",
    )
    member, stale = None, []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        step = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
        step = scratch.save(step.select("node", F.least("m", rank("node")).getField("id").alias("to")), f"{name}-step-{k}")
        ends = edges.join(step.toDF("a", "ta"), "a").join(step.toDF("b", "tb"), "b")
        ends = ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        next_edges = scratch.save(ends, f"{name}-edges-{k + 1}")
        if member is None:
            next_member = step.toDF("node", "root")
        else:
            next_member = member.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        member = scratch.save(next_member, f"{name}-member-{k}")
        scratch.drop(f"{name}-edges-{k}", f"{name}-step-{k}", *stale)
        edges, stale = next_edges, [f"{name}-member-{k}"]
    else:
        raise RuntimeError("components did not settle")
    if member is None:
        return scratch.spark.createDataFrame([], "node bigint, root bigint")
    return member
