"""Road graph, routes and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import weld_key
from ..plans.ordered import block_of, with_neighbours
from ..session import materialize
from .spatial import nearest_join


def build_road_graph(vertices: DataFrame, cell: float = 4.0, road: str = "road_id", block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, z) welded on a grid, and directed edges (src, dst, w) both ways.

    The first vertex in (road, seq) order gives a node its place; parallel edges collapse.
    """
    kx, kz = weld_key(F.col("x"), F.col("z"), cell)
    keyed = vertices.select(road, "seq", "x", "z", (kx * F.lit(4294967296) + (kz + F.lit(2147483648))).alias("node"))
    first = F.struct(road, "seq")
    nodes = keyed.groupBy("node").agg(F.min_by(F.struct("x", "z"), first).alias("p")).select("node", "p.x", "p.z")
    steps = with_neighbours(keyed, [road], ["seq"], ["node"], block if block is not None else block_of("seq"), prev=None)
    pairs = steps.where("next_node is not null and next_node != node").select(
        F.least("node", "next_node").alias("u"), F.greatest("node", "next_node").alias("v")
    ).distinct()
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("z").alias("uz"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("z").alias("vz"))
    w = F.hypot(F.col("vx") - F.col("ux"), F.col("vz") - F.col("uz"))
    once = pairs.join(a, "u").join(b, "v").select("u", "v", w.alias("w"))
    edges = once.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(
        once.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w")
    )
    return nodes, edges


def shortest_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes for many (pair_id, sx, sz, gx, gz) at once: pair_id, path, length, snapped.  Loop.

    ``path`` lists the nodes from start to goal; ``length`` adds the way to and from
    the road.  Without a connection the path is empty, ``length`` is the straight
    line and ``snapped`` is false.  Pairs that start at one node share a search.  Each
    round relaxes the edges of the nodes that improved, dropping any that already cost
    as much as the last of the start's goals; the paths are then read off by pointer
    jumping, in rounds that grow with the logarithm of their length.
    """
    starts = pairs.select("pair_id", F.col("sx").alias("x"), F.col("sz").alias("z"))
    goals = pairs.select("pair_id", F.col("gx").alias("x"), F.col("gz").alias("z"))
    s = nearest_join(starts, nodes, "pair_id", "node", out="s_node").select("pair_id", "s_node", F.col("dist").alias("s_off"))
    g = nearest_join(goals, nodes, "pair_id", "node", out="g_node").select("pair_id", "g_node", F.col("dist").alias("g_off"))
    ends = materialize(pairs.join(s, "pair_id").join(g, "pair_id"))
    edges = materialize(edges)
    none = F.lit(None).cast("long")
    routes = materialize(ends.where("s_node is not null and g_node is not null").select("s_node", "g_node").distinct())
    reached = materialize(routes.select("s_node").distinct().select(
        "s_node", F.col("s_node").alias("node"), F.lit(0.0).alias("d"), none.alias("prev"), F.lit(0).alias("hop"), F.lit(True).alias("new")
    ))

    def to_goals(reached: DataFrame) -> DataFrame:
        return routes.join(reached.select("s_node", F.col("node").alias("g_node"), F.col("d").alias("_d")), ["s_node", "g_node"], "left")

    while not reached.where("new").isEmpty():
        bound = to_goals(reached).groupBy("s_node").agg(F.when(F.count("_d") == F.count(F.lit(1)), F.max("_d")).alias("best"))
        front = reached.where("new").join(bound, "s_node", "left").where("best is null or d < best")
        tried = front.select("s_node", F.col("node").alias("src"), "d", "hop").join(edges, "src").select(
            "s_node", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.col("src").alias("prev"), (F.col("hop") + 1).alias("hop"), F.lit(True).alias("new")
        )
        pool = reached.withColumn("new", F.lit(False)).unionByName(tried)
        # at equal cost the settled row stays, so the loop ends
        best = pool.groupBy("s_node", "node").agg(F.min_by(F.struct("d", "prev", "hop", "new"), F.struct("d", "new", "prev")).alias("b"))
        reached = materialize(best.select("s_node", "node", "b.*"))
    # the nodes before each goal, by jumps of doubling length along ``prev``
    there = materialize(to_goals(reached).where("_d is not null"))
    on = there.select("s_node", "g_node", F.col("g_node").alias("node"))
    jump = reached.where("prev is not null").select("s_node", "node", F.col("prev").alias("to"))
    while not jump.isEmpty():
        on = materialize(on.unionByName(on.join(jump, ["s_node", "node"]).select("s_node", "g_node", F.col("to").alias("node"))))
        further = jump.select("s_node", F.col("node").alias("to"), F.col("to").alias("end"))
        jump = materialize(jump.join(further, ["s_node", "to"]).select("s_node", "node", F.col("end").alias("to")))
    steps = on.join(reached.select("s_node", "node", "hop"), ["s_node", "node"])
    steps = steps.groupBy("s_node", "g_node").agg(F.array_sort(F.collect_list(F.struct("hop", "node"))).alias("steps"))
    done = there.join(steps.select("s_node", "g_node", F.col("steps.node").alias("path")), ["s_node", "g_node"])
    straight = F.hypot(F.col("gx") - F.col("sx"), F.col("gz") - F.col("sz"))
    out = ends.join(done, ["s_node", "g_node"], "left")
    return out.select(
        "pair_id",
        F.coalesce("path", F.array().cast("array<bigint>")).alias("path"),
        F.coalesce(F.col("_d") + F.col("s_off") + F.col("g_off"), straight).alias("length"),
        F.col("_d").isNotNull().alias("snapped"),
    )


def random_walks(edges: DataFrame, starts: DataFrame, hops: int, seed: int) -> DataFrame:
    """Walks from (walk_id, node) that do not turn straight back unless they must: walk_id, hop, node.

    The choice is a seeded hash over (walk, hop, candidate), so it does not depend on partitioning.  Loop.
    """
    edges = materialize(edges.select("src", "dst").distinct())
    at = starts.select("walk_id", "node", F.lit(None).cast("long").alias("prev"))
    out = at.select("walk_id", F.lit(0).alias("hop"), "node")
    for hop in range(1, hops + 1):
        options = at.join(edges, at.node == edges.src).select("walk_id", "node", "prev", "dst")
        draw = F.struct(
            F.coalesce(F.col("dst") == F.col("prev"), F.lit(False)).alias("back"),
            F.xxhash64(F.lit(seed), "walk_id", F.lit(hop), "dst").alias("h"), F.col("dst"),
        )
        at = materialize(
            options.groupBy("walk_id", "node").agg(F.min_by("dst", draw).alias("to"))
            .select("walk_id", F.col("to").alias("node"), F.col("node").alias("prev"))
        )
        out = out.unionByName(at.select("walk_id", F.lit(hop).alias("hop"), "node"))
    return out


def node_degree(edges: DataFrame, min_degree: int = 3) -> DataFrame:
    """Nodes with at least ``min_degree`` distinct neighbours."""
    return edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree")
    ).where(F.col("degree") >= min_degree)
