"""Graph operators over edge tables: connected components and descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.plans.runtime import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """``node``, ``component`` (the least node of the component) by minimum labels with pointer jumping.

    Each round takes the least label among a node's neighbours (a pre-aggregated group-by, so a hub costs no more than its
    edges) and then jumps to the label's own label, which halves the distance to the root: rounds grow with the
    logarithm of the longest path. Labels are cut to the checkpoint folder every round; nothing is collected but a count.

    Defined cases: null ends are no edges; self loops and repeated edges add nothing; ``nodes`` (a column ``node``) adds
    nodes without edges as components of their own; an empty edge table gives just those.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    loops = edges.select(F.col(src).alias("node")).where(f"{src} = {dst}") if nodes is None else nodes.select("node").where("node is not null")
    every = both.select(F.col("a").alias("node")).unionByName(loops).distinct()
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:  # every round lowers a label or ends it
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("up"), F.col("component").alias("old"))
        roots = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = cut(new.join(roots, "up", "left").select("node", F.least("up", "top").alias("component"), "old"))
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            break
    return every.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shared_pairs(members: DataFrame, group: str, member: str, least: int = 2, block: int = 256) -> DataFrame:
    """``x``, ``y``, ``shared``: pairs of members (x < y) with the number of groups they share, at least ``least``.

    Every group counts. Memberships are made distinct first, and members of fewer than ``least`` groups, who can be in no
    pair, leave before the join. A group of more than ``block`` members is paired in blocks: each pair of blocks is a
    join key of its own, so the largest group spreads over tasks as many small ones do. Null groups and members are none.
    """
    m = members.select(F.col(group).alias("_g"), F.col(member).alias("_m")).where("_g is not null and _m is not null").distinct()
    m = cut(m.join(m.groupBy("_m").count().where(F.col("count") >= least).select("_m"), "_m", "left_semi"))
    blocks = m.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    d = m.join(blocks, "_g").withColumn("_b", F.pmod(F.xxhash64("_m"), F.col("_n")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = d.select("_g", F.col("_m").alias("x"), F.col("_b").alias("_i"), others.alias("_j"))
    b = d.select("_g", F.col("_m").alias("y"), F.col("_b").alias("_j"), others.alias("_i"))
    pairs = a.join(b, ["_g", "_i", "_j"]).where("x < y")
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
