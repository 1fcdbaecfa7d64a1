"""Spatial joins: containment, overlap, nearest, radius, corridor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rings import ring_bbox, segment_dist2
from ..plans.cells import boxes_meet, cell_at, levels_in_use, points_in_boxes, probe_points, size_level
from ..plans.cover import EDGES, cover, holds, holds_many, unrolled
from ..plans.search import Box, best_item, nearest_bounds
from ..session import materialize, spread


# ---- points and polygons ----------------------------------------------------
def points_in_polygons(
    points: DataFrame,
    polys: DataFrame,
    buffer: float = 0.0,
    mode: str = "all",
    order: str | None = None,
    point_id: str | None = None,
    x: str = "x",
    z: str = "z",
    ring: str = "ring",
) -> DataFrame:
    """Points with the closed polygons (grown by ``buffer`` metres) that hold them.

    ``mode="first"`` keeps, for each ``point_id``, the polygon lowest in ``order``.
    The ring itself is not returned.  Rings are covered by cells (``plans/cover.py``); a point meets a ring's cell, and
    the few edges there, not the ring.  Null, empty and non-finite rings hold nothing.
    """
    x0, x1, z0, z1 = ring_bbox(F.col(ring))
    boxed = polys.select("*", (x0 - buffer).alias("_bx0"), (x1 + buffer).alias("_bx1"), (z0 - buffer).alias("_bz0"), (z1 + buffer).alias("_bz1"))
    cells = materialize(cover(spread(boxed), ring, float(buffer)))
    most = dict(cells.groupBy("_lv").agg(F.max(F.size("_edges"))).collect())  # as many as powers of two among the cell sizes
    if mode == "first":
        cells = _unbeaten(cells, order)
    placed = points.where(~F.isnan(x) & ~F.isnan(z) & F.col(x).isNotNull() & F.col(z).isNotNull())
    placed = placed.withColumn("_px", F.coalesce(F.col(x).cast("double"), F.lit(0.0))).withColumn("_pz", F.coalesce(F.col(z).cast("double"), F.lit(0.0)))
    kept = [*points.columns, *[c for c in polys.columns if c != ring]]

    def hits_in(part: DataFrame, levels: list[int], test: Callable[..., DataFrame]) -> DataFrame:
        near = probe_points(placed, "_px", "_pz", levels).join(part, ["_lv", "_cx", "_cz"])
        near = near.where(F.col("_px").between(F.col("_bx0"), F.col("_bx1")) & F.col("_pz").between(F.col("_bz0"), F.col("_bz1")))
        return test(near, kept, "_px", "_pz", float(buffer))

    hits = hits_in(unrolled(cells), sorted(most) or [0], holds)
    crowded = sorted(lv for lv, n in most.items() if n > 4 * EDGES)
    if crowded:
        hits = hits.unionByName(hits_in(cells.where(F.size("_edges") > 4 * EDGES), crowded, holds_many))
    if mode == "all":
        return hits
    rest = [c for c in hits.columns if c != point_id]
    best = hits.groupBy(point_id).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_b"))
    return best.select(point_id, "_b.*")


def _unbeaten(cells: DataFrame, order: str) -> DataFrame:
    """Rows of a covering that may hold the lowest ``order`` at some point: none above a ring that fills their cell."""
    at = ["_lv", "_cx", "_cz"]
    fills = cells.where((F.size("_edges") == 0) & F.col(order).isNotNull()).groupBy(*at).agg(F.min(order).alias("_least"))
    rows = cells.join(fills, at, "left")
    rows = rows.where(F.col("_least").isNull() | F.col(order).isNull() | (F.col(order) <= F.col("_least")))
    return materialize(rows.drop("_least"))


def road_crosses_box(vertices: DataFrame, boxes: DataFrame, box_id: str, road_id: str) -> DataFrame:
    """Boxes (x0, x1, z0, z1) that one road passes: vertices strictly on both sides of a mid-line.

    A box is filed in the cell of its lower corner only, and the vertices of a road are gathered in each cell with those
    of the cells beyond, so a box meets a road in one row and their pairs are not shuffled.  Boxes that share an id but
    not their place are judged together.
    """
    places = boxes.select(box_id, "x0", "x1", "z0", "z1").distinct()
    counted = materialize(places.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(box_id))))
    sole, shared = counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")
    found = _road_crosses_place(vertices, sole, box_id, road_id)
    if levels_in_use(shared, "x0", "x1", "z0", "z1"):
        inside = points_in_boxes(vertices, shared, "x", "z", "x0", "x1", "z0", "z1")
        mx, mz = (F.col("x0") + F.col("x1")) / 2, (F.col("z0") + F.col("z1")) / 2
        sides = inside.groupBy(box_id, road_id).agg(
            F.bool_or(F.col("x") < mx).alias("w"), F.bool_or(F.col("x") > mx).alias("e"),
            F.bool_or(F.col("z") < mz).alias("n"), F.bool_or(F.col("z") > mz).alias("s"),
        )
        found = found.unionByName(sides.where("(w and e) or (n and s)").select(box_id, road_id))
    return found


def _road_crosses_place(vertices: DataFrame, boxes: DataFrame, box_id: str, road_id: str) -> DataFrame:
    """``road_crosses_box`` for boxes of one place each."""
    c = F.col
    grown = 1 + 1e-9  # a box is surely narrower than its cell
    lv = size_level((c("x1") - c("x0")) * grown, (c("z1") - c("z0")) * grown)
    filed = boxes.where("x0 <= x1 and z0 <= z1").withColumn("_lv", lv)
    levels = sorted(r[0] for r in filed.select("_lv").where("_lv is not null").distinct().collect()) or [0]
    filed = filed.withColumn("_cx", cell_at(c("x0"), c("_lv"))).withColumn("_cz", cell_at(c("z0"), c("_lv")))
    back = F.array(F.lit(0), F.lit(1))
    known = vertices.select(road_id, "x", "z").where("x is not null and z is not null and not isnan(x) and not isnan(z)")
    lines = (
        probe_points(spread(known), "x", "z", levels)
        .withColumn("_i", F.explode(back)).withColumn("_j", F.explode(back))
        .groupBy("_lv", (c("_cx") - c("_i")).alias("_cx"), (c("_cz") - c("_j")).alias("_cz"), road_id)
        .agg(F.collect_list(F.struct("x", "z")).alias("_pts"), F.min("x").alias("_w"), F.max("x").alias("_e"), F.min("z").alias("_n"), F.max("z").alias("_s"))
        .where("_w < _e or _n < _s")
    )
    mx, mz = (c("x0") + c("x1")) / 2, (c("z0") + c("z1")) / 2

    def some(test) -> Column:
        return F.exists("_pts", lambda p: p["x"].between(c("x0"), c("x1")) & p["z"].between(c("z0"), c("z1")) & test(p))

    met = lines.join(filed, ["_lv", "_cx", "_cz"])
    met = met.where((c("_w") <= c("x1")) & (c("_e") >= c("x0")) & (c("_n") <= c("z1")) & (c("_s") >= c("z0")))
    across = (c("_w") < mx) & (c("_e") > mx) & some(lambda p: p["x"] < mx) & some(lambda p: p["x"] > mx)
    along = (c("_n") < mz) & (c("_s") > mz) & some(lambda p: p["z"] < mz) & some(lambda p: p["z"] > mz)
    return met.where(across | along).select(box_id, road_id)


def free_points(
    points: DataFrame,
    boxes: DataFrame,
    point_id: str,
    margin: float = 3.0,
    min_from: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Points outside every box grown by ``margin`` and not nearer than d to (x, z, d)."""
    grown = boxes.select(
        (F.col("x0") - margin).alias("_bx0"), (F.col("x1") + margin).alias("_bx1"),
        (F.col("z0") - margin).alias("_bz0"), (F.col("z1") + margin).alias("_bz1"),
    ).distinct()
    if min_from is not None:
        fx, fz, d = min_from
        points = points.where(F.hypot(F.col("x") - fx, F.col("z") - fz) >= d)
    probe = points.select(point_id, "x", "z")
    taken = points_in_boxes(probe, grown, "x", "z", "_bx0", "_bx1", "_bz0", "_bz1").select(point_id)
    return points.join(taken.distinct(), point_id, "left_anti")


# ---- boxes ------------------------------------------------------------------
def aabb_overlap(a: DataFrame, b: DataFrame, a_id: str = "a_id", b_id: str = "b_id", on: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes that overlap, with the push-out normal and depth.

    Sides have ``<a|b>_x0, _x1, _y0, _y1, _z0, _z1``.  Touching is no overlap.  The
    normal points from b to a along the axis of least overlap.  Both sides are dealt over all cores before they meet,
    however few files hold them.
    """
    met = boxes_meet(
        spread(a), spread(b), ("a_x0", "a_x1", "a_z0", "a_z1"), ("b_x0", "b_x1", "b_z0", "b_z1"), tuple(on)
    )
    c = F.col
    ox = F.least(c("a_x1"), c("b_x1")) - F.greatest(c("a_x0"), c("b_x0"))
    oz = F.least(c("a_z1"), c("b_z1")) - F.greatest(c("a_z0"), c("b_z0"))
    met = met.where((c("a_y1") > c("b_y0")) & (c("a_y0") < c("b_y1")) & (ox > 0) & (oz > 0))
    sx = F.when(c("a_x0") + c("a_x1") >= c("b_x0") + c("b_x1"), 1.0).otherwise(-1.0)
    sz = F.when(c("a_z0") + c("a_z1") >= c("b_z0") + c("b_z1"), 1.0).otherwise(-1.0)
    return met.select(
        *on, a_id, b_id,
        F.when(ox < oz, sx).otherwise(0.0).alias("nx"),
        F.when(ox < oz, 0.0).otherwise(sz).alias("nz"),
        F.least(ox, oz).alias("pen"),
    )


def _oriented(df: DataFrame, p: str) -> DataFrame:
    """Rectangle that surely holds the oriented box p_x, p_z, p_yaw, p_hx, p_hz."""
    c, s = F.abs(F.cos(F.col(f"{p}_yaw"))), F.abs(F.sin(F.col(f"{p}_yaw")))
    ex = F.col(f"{p}_hx") * c + F.col(f"{p}_hz") * s + 1e-9
    ez = F.col(f"{p}_hx") * s + F.col(f"{p}_hz") * c + 1e-9
    x, z = F.col(f"{p}_x"), F.col(f"{p}_z")
    return (
        df.withColumn(f"_{p}x0", x - ex).withColumn(f"_{p}x1", x + ex)
        .withColumn(f"_{p}z0", z - ez).withColumn(f"_{p}z1", z + ez)
    )


def _least_depth(p: str, q: str, turn: Callable[[str], tuple[Column, Column]]) -> Column:
    """Separating-axis test of two oriented boxes: their own axis of least depth, (pen, i, nx, nz) with the normal towards ``p``.

    A depth of nought or less means apart.  ``turn`` gives cosine and sine of a box; local +X is (cos, -sin), +Z is (sin, cos).
    """

    def axes(s: str) -> list[tuple[Column, Column]]:
        c, n = turn(s)
        return [(c, -n), (n, c)]

    def reach(s: str, ux: Column, uz: Column) -> Column:
        (xx, xz), (zx, zz) = axes(s)
        return F.abs(F.col(f"{s}_hx") * (xx * ux + xz * uz)) + F.abs(F.col(f"{s}_hz") * (zx * ux + zz * uz))

    dx, dz = F.col(f"{p}_x") - F.col(f"{q}_x"), F.col(f"{p}_z") - F.col(f"{q}_z")
    trials = []
    for i, (ux, uz) in enumerate(axes(p) + axes(q)):
        along = dx * ux + dz * uz
        depth = reach(p, ux, uz) + reach(q, ux, uz) - F.abs(along)
        sign = F.when(along >= 0, 1.0).otherwise(-1.0)
        trials.append(F.struct(depth.alias("pen"), F.lit(i).alias("i"), (ux * sign).alias("nx"), (uz * sign).alias("nz")))
    return F.array_min(F.array(*trials))


def obb_overlap(a: DataFrame, b: DataFrame, a_id: str = "a_id", b_id: str = "b_id", on: Sequence[str] = ()) -> DataFrame:
    """Pairs of overlapping oriented boxes with normal (towards a) and depth.

    Cosines are taken once a box.  The exact test is unnested, not filtered by, so that it stays behind the join's
    comparison of rectangles (and of ids, where the caller adds one) and runs once a pair.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        yaw = F.col(f"{p}_yaw")
        return _oriented(df, p).withColumn(f"_{p}cos", F.cos(yaw)).withColumn(f"_{p}sin", F.sin(yaw))

    met = boxes_meet(
        side(a, "a"), side(b, "b"), ("_ax0", "_ax1", "_az0", "_az1"), ("_bx0", "_bx1", "_bz0", "_bz1"), tuple(on),
    )
    best = _least_depth("a", "b", lambda s: (F.col(f"_{s}cos"), F.col(f"_{s}sin")))
    hit = F.filter(F.array(best), lambda v: v["pen"] > 0)
    return met.select(*on, a_id, b_id, F.explode(hit).alias("_h")).select(*on, a_id, b_id, "_h.nx", "_h.nz", "_h.pen")


# ---- nearest ----------------------------------------------------------------
def _distinct_places(right: DataFrame, on: Sequence[str], rid: str, x: str, z: str, keep: int) -> DataFrame:
    """The ``keep`` lowest ids at each place; copies of a place can never win."""
    w = Window.partitionBy(*on, x, z).orderBy(rid)
    ranked = right.select(*on, rid, x, z).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return ranked.select(
        *on, F.col(rid).alias("_rid"), F.col(x).alias("_mx"), F.col(z).alias("_mz"),
        F.col(x).alias("_x0"), F.col(x).alias("_x1"), F.col(z).alias("_z0"), F.col(z).alias("_z1"),
    )


#: Right rows of a group that are met one by one; a larger group goes through the pyramid.
_GROUP = 512


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    max_dist: float | None = None,
    min_dist: float = 0.0,
    partition_by: Sequence[str] = (),
    exclude_self: bool = False,
    out: str = "nearest_id",
    x: str = "x",
    z: str = "z",
) -> DataFrame:
    """Nearest right row of each left row: left columns, ``out`` and ``dist`` (NULL if none).

    ``max_dist`` and ``min_dist`` are exclusive; ties go to the lowest right id.  Groups of ``partition_by`` with few right
    rows meet in one join, which stores and sends less than the descent through the pyramid; larger ones descend.
    """
    on = list(partition_by)
    lx, lz = F.col("_lx"), F.col("_lz")
    probe = left.select(
        *on, F.col(left_id).alias("_lid"), F.col(x).alias("_lx"), F.col(z).alias("_lz")
    ).where(F.col("_lx").isNotNull() & F.col("_lz").isNotNull())
    least = float(min_dist) ** 2 if min_dist > 0 else -1.0

    def bounds(box: Box):
        lower, upper = nearest_bounds(lx, lz, box)
        sure = lower > least
        if exclude_self:
            sure = sure & (box.n > 1)
        return upper > least, lower, F.when(sure, upper)

    dx, dz = F.col("_mx") - lx, F.col("_mz") - lz
    score = dx * dx + dz * dz
    allowed = F.col("_score") > least
    if exclude_self:
        allowed = allowed & (F.col("_rid") != F.col("_lid"))
    limit = None if max_dist is None else float(max_dist) ** 2
    best = None
    if on:  # the rows of a small group meet as they are
        sizes = right.groupBy(*on)
        if exclude_self:  # rows that come twice hide each other in the pyramid; their groups stay with it
            sizes = right.groupBy(*on, right_id, x, z).agg(F.count(F.lit(1)).alias("_c")).groupBy(*on)
        n, most = (F.sum("_c"), F.max("_c")) if exclude_self else (F.count(F.lit(1)), F.lit(1))
        crowded = materialize(sizes.agg(n.alias("_n"), most.alias("_most")).where((F.col("_n") > _GROUP) | (F.col("_most") > 1)).select(*on))
        some = not crowded.isEmpty()
        small = right.join(crowded, on, "left_anti") if some else right
        here = small.select(*on, F.col(right_id).alias("_rid"), F.col(x).alias("_mx"), F.col(z).alias("_mz"))
        here = here.where((F.abs("_mx") < float("inf")) & (F.abs("_mz") < float("inf")))
        met = spread(probe, *on).join(spread(here, *on), on).withColumn("_score", score).where(allowed & ~F.isnan("_score"))
        if limit is not None:
            met = met.where(F.col("_score") < limit)
        best = met.groupBy("_lid").agg(F.min(F.struct("_score", "_rid")).alias("_b")).select("_lid", "_b.*")
        right = right.join(crowded, on, "left_semi")
    if best is None or some:
        items = _distinct_places(right, on, right_id, x, z, 2 if exclude_self else 1)
        far = best_item(probe, items, "_lid", on, bounds, score, allowed, limit, ["_rid"], ["_rid"])
        best = far if best is None else best.unionByName(far).groupBy("_lid").agg(F.min(F.struct("_score", "_rid")).alias("_b")).select("_lid", "_b.*")
    best = best.select(F.col("_lid").alias(left_id), F.col("_rid").alias(out), F.sqrt("_score").alias("dist"))
    return left.join(best, left_id, "left")


def within_distance(left: DataFrame, right: DataFrame, r: float, left_id: str, right_id: str, how: str = "semi") -> DataFrame:
    """Left rows with (semi) or without (anti) a right row nearer than ``r``."""
    found = nearest_join(left, right, left_id, right_id, max_dist=r, out="_near")
    test = F.col("_near").isNotNull() if how == "semi" else F.col("_near").isNull()
    return found.where(test).select(*left.columns)


def nearest_other(poses: DataFrame, entity_id: str, frame: Sequence[str], max_r: float = 40.0) -> DataFrame:
    """Nearest other entity of the same frame, with its offset in the ego frame of ``yaw``."""
    from ..functions.angles import ego_frame

    keyed = poses.withColumn("_key", F.struct(*frame, entity_id))
    near = nearest_join(
        keyed, keyed.withColumnRenamed(entity_id, "_e"), "_key", "_key", max_dist=max_r,
        partition_by=frame, exclude_self=True, out="_o",
    )
    near = near.withColumn("other_id", F.col("_o")[entity_id])
    there = poses.select(*frame, F.col(entity_id).alias("other_id"), F.col("x").alias("_ox"), F.col("z").alias("_oz"))
    joined = near.join(there, [*frame, "other_id"], "left")
    fwd, lat = ego_frame(F.col("_ox") - F.col("x"), F.col("_oz") - F.col("z"), F.col("yaw"))
    return joined.withColumn("fwd", fwd).withColumn("lat", lat).select(*poses.columns, "other_id", "dist", "fwd", "lat")


def nearest_segment(
    points: DataFrame,
    segments: DataFrame,
    point_id: str,
    carry: Sequence[str] = (),
    max_dist: float | None = 120.0,
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    keep_degenerate: bool = False,
) -> DataFrame:
    """Closest spot on any segment (ax, az, bx, bz) nearer than ``max_dist``.

    Adds px, pz, the unit direction dir_x, dir_z, the fraction t, dist, and the
    ``carry`` columns of the segment.  Equal distances go to the lowest ``tie``.
    """
    on, carry, tie = list(partition_by), list(carry), list(tie)
    ends = ["ax", "az", "bx", "bz"]
    len2 = (F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2
    if not keep_degenerate:
        segments = segments.where(len2 >= 1e-6)
    extra = list(dict.fromkeys([*tie, *carry]))
    rank = F.struct(*[F.col(c) for c in (tie or extra or ends)])
    whole = F.struct(*[F.col(c) for c in (extra or ends)])
    shapes = segments.groupBy(*on, *ends).agg(F.min_by(whole, rank).alias("_w"))
    items = shapes.select(
        *on, *ends, *[F.col("_w")[c].alias(c) for c in extra],
        F.least("ax", "bx").alias("_x0"), F.greatest("ax", "bx").alias("_x1"),
        F.least("az", "bz").alias("_z0"), F.greatest("az", "bz").alias("_z1"),
        ((F.col("ax") + F.col("bx")) / 2).alias("_mx"), ((F.col("az") + F.col("bz")) / 2).alias("_mz"),
    )
    lx, lz = F.col("_lx"), F.col("_lz")
    probe = points.select(*on, F.col(point_id).alias("_lid"), F.col("x").alias("_lx"), F.col("z").alias("_lz"))
    score = segment_dist2(lx, lz, *[F.col(c) for c in ends])

    def bounds(box: Box):
        lower, upper = nearest_bounds(lx, lz, box)
        return F.lit(True), lower, upper

    best = best_item(
        probe, items, "_lid", on, bounds, score, F.lit(True),
        None if max_dist is None else float(max_dist) ** 2, tie or ends, [*ends, *extra],
    ).withColumnRenamed("_lid", point_id)
    joined = points.join(best, point_id, "left")
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    l2 = F.nullif(dx * dx + dz * dz, F.lit(0.0))
    t = F.coalesce(((F.col("x") - F.col("ax")) * dx + (F.col("z") - F.col("az")) * dz) / l2, F.lit(0.0))
    t = F.when(F.col("ax").isNotNull(), F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    joined = joined.withColumn("t", t)
    return joined.select(
        *points.columns,
        (F.col("ax") + F.col("t") * dx).alias("px"), (F.col("az") + F.col("t") * dz).alias("pz"),
        (dx / F.sqrt(l2)).alias("dir_x"), (dz / F.sqrt(l2)).alias("dir_z"),
        "t", F.sqrt("_score").alias("dist"), F.sqrt(l2).alias("seg_len"), *extra,
    )


def project_on_route(points: DataFrame, route: DataFrame, point_id: str, block: Column) -> DataFrame:
    """Arc length ``s`` and ``lateral`` distance of points on one ordered route (seq, x, z)."""
    from .polylines import segments_of

    segs = segments_of(route.withColumn("_r", F.lit(0)), ["_r"], block)
    near = nearest_segment(points, segs, point_id, ["seq", "s0"], None, ["seq"], keep_degenerate=True)
    s = F.col("s0") + F.col("t") * F.coalesce(F.col("seg_len"), F.lit(0.0))
    return near.select(*points.columns, s.alias("s"), F.col("dist").alias("lateral"))


def corridor_ahead(
    df: DataFrame,
    targets: DataFrame,
    left_id: str,
    target_id: str,
    max_dist: float = 22.0,
    lane: float = 4.0,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Nearest target ahead: 0 < forward <= ``max_dist`` and |lateral| <= ``lane``.

    ``df`` has x, z, yaw.  Adds ``ahead_id`` and ``ahead_dist`` (NULL if the way is clear).
    """
    on = list(partition_by)
    items = _distinct_places(targets, on, target_id, "x", "z", 1)
    probe = df.select(
        *on, F.col(left_id).alias("_lid"), F.col("x").alias("_lx"), F.col("z").alias("_lz"),
        F.cos("yaw").alias("_fx"), (-F.sin("yaw")).alias("_fz"),
    )
    fx, fz = F.col("_fx"), F.col("_fz")

    def span(a: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        return F.least(a * lo, a * hi), F.greatest(a * lo, a * hi)

    def bounds(box: Box):
        rx = (box.x0 - F.col("_lx"), box.x1 - F.col("_lx"))
        rz = (box.z0 - F.col("_lz"), box.z1 - F.col("_lz"))
        (f1, f2), (f3, f4) = span(fx, *rx), span(fz, *rz)
        (s1, s2), (s3, s4) = span(-fz, *rx), span(fx, *rz)
        near, far, left, right = f1 + f3, f2 + f4, s1 + s3, s2 + s4
        possible = (far > 0) & (near <= max_dist) & (left <= lane) & (right >= -lane)
        sure = (near > 0) & (far <= max_dist) & (left >= -lane) & (right <= lane)
        return possible, F.greatest(near, F.lit(0.0)), F.when(sure, far)

    rx, rz = F.col("_mx") - F.col("_lx"), F.col("_mz") - F.col("_lz")
    fwd, side = rx * fx + rz * fz, -rx * fz + rz * fx
    allowed = (F.col("_score") > 0) & (F.col("_score") <= max_dist) & (F.abs(side) <= lane)
    best = best_item(probe, items, "_lid", on, bounds, fwd, allowed, None, ["_rid"], ["_rid"])
    best = best.select(F.col("_lid").alias(left_id), F.col("_rid").alias("ahead_id"), F.col("_score").alias("ahead_dist"))
    return df.join(best, left_id, "left")


# ---- radius pairs -----------------------------------------------------------
BLOCK = 1024  # rows of a cell that meet in one group of the join; a merge join keeps as many in memory


def self_within_distance(df: DataFrame, r: float, id_col: str, x: str = "x", z: str = "z", on: Sequence[str] = ()) -> DataFrame:
    """All pairs a < b at most ``r`` apart.  The pairs are the result: clustering and
    suppression have operators of their own that never list them.

    Points meet those of their own cell and of half the cells around it.  The rows of a crowded cell are dealt over
    blocks, and a point asks each block of a cell, so one cell is many tasks and a point meets ``BLOCK`` rows or so at
    a time.  The pairs are spread by cell and block over all cores, however small the tables are.
    """
    on, c = list(on), F.col
    base = df.select(*on, c(id_col).alias("_i"), c(x).alias("_x"), c(z).alias("_z"))
    base = base.where(c("_i").isNotNull() & c("_x").isNotNull() & c("_z").isNotNull() & ~F.isnan("_x") & ~F.isnan("_z"))
    base = base.withColumn("_cx", F.floor(c("_x") / r)).withColumn("_cz", F.floor(c("_z") / r))
    base = materialize(spread(base).withColumn("_n", F.monotonically_increasing_id()))  # stored: a row never changes its block
    cell = [*on, "_cx", "_cz"]
    sizes = base.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    crowded = materialize(sizes.where("_blocks > 1"))  # a row for BLOCK points or more
    blocks = F.coalesce("_blocks", F.lit(1).cast("long"))
    right = base.join(crowded, cell, "left").withColumn("_b", F.pmod(F.xxhash64("_n"), blocks))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = base.withColumn("_s", F.explode(steps)).select(
        *on, c("_i").alias("_i1"), c("_x").alias("_x1"), c("_z").alias("_z1"),
        (c("_cx") + c("_s.i")).alias("_cx"), (c("_cz") + c("_s.j")).alias("_cz"),
        ((c("_s.i") == 0) & (c("_s.j") == 0)).alias("_own"),
    )
    left = left.join(crowded, cell, "left").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dx, dz = c("_x1") - c("_x"), c("_z1") - c("_z")
    d2 = dx * dx + dz * dz
    met = spread(left.drop("_blocks"), *cell, "_b").join(spread(right.drop("_blocks", "_n"), *cell, "_b"), [*cell, "_b"])
    pairs = met.where((d2 <= r * r) & F.when(c("_own"), c("_i1") < c("_i")).otherwise(c("_i1") != c("_i")))
    return pairs.select(
        *on, F.least("_i1", "_i").alias("a"), F.greatest("_i1", "_i").alias("b"), F.sqrt(d2).alias("dist")
    )
