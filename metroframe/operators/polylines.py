"""Polylines as vertex tables (keys, seq, x, z) or as array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cells import points_in_boxes
from ..plans.onerow import beside
from ..plans.ordered import (
    block_of, fill_forward, ordered_fold, row_numbers, running_total, with_neighbours, with_tail,
)
from ..plans.select import order_statistics


def segments_of(vertices: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Segments ax, az, bx, bz with ``len`` and the arc length ``s0`` at their start."""
    rest = [c for c in vertices.columns if c not in ("x", "z")]
    steps = with_neighbours(vertices, keys, ["seq"], ["x", "z"], block, prev=None)
    segs = steps.where("next_x is not null").select(
        *rest, F.col("x").alias("ax"), F.col("z").alias("az"), F.col("next_x").alias("bx"), F.col("next_z").alias("bz")
    )
    segs = segs.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")))
    return running_total(segs, keys, ["seq"], {"s0": "len"}, block, exclusive=True)


# ---- resampling and thinning -------------------------------------------------
def resample_polyline(vertices: DataFrame, keys: Sequence[str], step: float, block: Column | None = None) -> DataFrame:
    """Stations every ``step`` metres of arc length, both endpoints kept: keys, s, x, z."""
    keys = list(keys)
    block = block if block is not None else block_of("seq")
    segs = segments_of(vertices.select(*keys, "seq", "x", "z"), keys, block).where("len >= 1e-6")
    first = F.greatest(F.ceil(F.col("s0") / step), F.lit(1))
    last = F.ceil((F.col("s0") + F.col("len")) / step) - 1
    stations = segs.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    t = (F.col("_k") * step - F.col("s0")) / F.col("len")
    stations = stations.select(
        *keys, (F.col("_k") * F.lit(float(step))).alias("s"),
        (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("az") + (F.col("bz") - F.col("az")) * t).alias("z"),
    )
    spot = F.struct("x", "z")
    ends = vertices.groupBy(*keys).agg(
        F.min_by(spot, "seq").alias("a"), F.max_by(spot, "seq").alias("b"), F.count(F.lit(1)).alias("n")
    )
    total = segs.groupBy(*keys).agg(F.max(F.col("s0") + F.col("len")).alias("t"))
    ends = ends.join(total, keys, "left")
    head = ends.select(*keys, F.lit(0.0).alias("s"), "a.x", "a.z")
    tail = ends.where("n > 1").select(*keys, F.coalesce("t", F.lit(0.0)).alias("s"), "b.x", "b.z")
    return head.unionByName(stations).unionByName(tail)


def dedupe_min_distance(
    vertices: DataFrame, keys: Sequence[str], d: float, keep_last: bool = False, strict: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Drop vertices within ``d`` of the last kept one.

    Greedy and sequential, but a vertex more than 2d from its predecessor is kept
    whatever came before, so sequences are cut there and the runs go in parallel;
    a run of one vertex needs no Python at all.  ``keep_last`` keeps both endpoints:
    a last vertex too near its kept predecessor replaces it.
    """
    keys = list(keys)
    block = block if block is not None else block_of("seq")
    near = with_neighbours(vertices.select(*keys, "seq", "x", "z"), keys, ["seq"], ["x", "z"], block)
    far_in = F.col("prev_x").isNull() | (F.hypot(F.col("x") - F.col("prev_x"), F.col("z") - F.col("prev_z")) > 2 * d)
    far_out = F.col("next_x").isNull() | (F.hypot(F.col("x") - F.col("next_x"), F.col("z") - F.col("next_z")) > 2 * d)
    if keep_last:
        ends = near.where("next_x is null")
        near = near.where("next_x is not null")
    marked = near.withColumn("_cut", F.when(far_in, 1).otherwise(0)).withColumn("_alone", far_in & far_out)
    runs = running_total(marked, keys, ["seq"], {"_run": "_cut"}, block)
    cols = [*keys, "seq", "x", "z"]
    types = dict(runs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols)

    def thin(state: dict, rows: pd.DataFrame, fresh: np.ndarray) -> pd.DataFrame:
        xs, zs = rows["x"].to_numpy(), rows["z"].to_numpy()
        keep = np.zeros(len(rows), bool)
        at = state.get("at")
        for i in range(len(rows)):
            gap = math.inf if fresh[i] else math.hypot(xs[i] - at[0], zs[i] - at[1])
            if gap > d or (not strict and gap == d):
                keep[i], at = True, (xs[i], zs[i])
        state["at"] = at
        return rows.loc[keep, cols]

    folded = ordered_fold(runs.where("not _alone").select(*cols, "_run"), [*keys, "_run"], ["seq"], schema, thin)
    kept = runs.where("_alone").select(*cols).unionByName(folded)
    if not keep_last:
        return kept
    spot = F.struct("seq", "x", "z")
    latest = kept.groupBy(*keys).agg(F.max_by(spot, "seq").alias("_k"), F.count(F.lit(1)).alias("_n"))
    both = ends.select(*keys, F.struct("seq", "x", "z").alias("_e")).join(latest, keys, "left")
    gap = F.hypot(F.col("_e.x") - F.col("_k.x"), F.col("_e.z") - F.col("_k.z"))
    replaced = both.where((F.col("_n") >= 2) & (gap < d)).select(*keys, F.col("_k.seq").alias("seq"))
    return kept.join(replaced, [*keys, "seq"], "left_anti").unionByName(both.select(*keys, "_e.*"))


def dedupe_consecutive_equal(vertices: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """Round to whole metres (half to even) and drop vertices equal to their predecessor."""
    keys = list(keys)
    rounded = vertices.select(*keys, "seq", F.bround("x").cast("long").alias("x"), F.bround("z").cast("long").alias("z"))
    near = with_neighbours(rounded, keys, ["seq"], ["x", "z"], block if block is not None else block_of("seq"), nxt=None)
    same = (F.col("x") == F.col("prev_x")) & (F.col("z") == F.col("prev_z"))
    return near.where(~F.coalesce(same, F.lit(False))).drop("prev_x", "prev_z")


def split_runs(
    vertices: DataFrame, keys: Sequence[str], inside: Column, min_len: int = 2, block: Column | None = None
) -> DataFrame:
    """Contiguous in-bounds runs of at least ``min_len`` vertices, numbered by ``run``."""
    keys = list(keys)
    block = block if block is not None else block_of("seq")
    marked = vertices.withColumn("_out", F.when(inside, 0).otherwise(1))
    runs = running_total(marked, keys, ["seq"], {"run": "_out"}, block).where("_out = 0").drop("_out")
    sizes = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_len)
    return runs.join(sizes.drop("_n"), [*keys, "run"], "left_semi").select(*vertices.columns, "run")


# ---- array columns ------------------------------------------------------------
def chaikin(pts: Column, iters: int = 3) -> Column:
    """Corner cutting of ARRAY<STRUCT<x, z>>; both endpoints stay."""

    def mix(a: Column, b: Column, w: float) -> Column:
        return F.struct((a["x"] * w + b["x"] * (1 - w)).alias("x"), (a["z"] * w + b["z"] * (1 - w)).alias("z"))

    for _ in range(iters):
        n = F.size(pts)
        inner = F.zip_with(
            F.slice(pts, 1, F.greatest(n - 1, F.lit(0))), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.array(mix(a, b, 0.75), mix(a, b, 0.25)),
        )
        ends = F.transform(F.array(F.get(pts, F.lit(0)), F.get(pts, n - 1)), lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))
        cut = F.concat(F.slice(ends, 1, 1), F.flatten(inner), F.slice(ends, 2, 1))
        pts = F.when(n < 3, F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))).otherwise(cut)
    return pts


def gaussian_profile(ys: Column, sigma: float = 2.2, truncate: float = 4.0, min_n: int = 5) -> Column:
    """Gaussian smoothing of an array, edge values repeated; short arrays stay as they are."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(w / sum(raw)) for w in raw])
    taps = F.sequence(F.lit(0), F.lit(2 * radius))
    last = F.size(ys) - 1

    def at(i: Column) -> Column:
        def tap(acc: Column, k: Column) -> Column:
            j = F.greatest(F.least(i + k - radius, last), F.lit(0))
            return acc + F.get(weights, k) * F.get(ys, j)

        return F.aggregate(taps, F.lit(0.0), tap)

    return F.when(F.size(ys) < min_n, ys).otherwise(F.transform(F.sequence(F.lit(0), last), at))


def clamp_profile(ys: Column, ground: Column, lo: float = 0.2, hi: float = 0.6) -> Column:
    """Keep a profile between ``lo`` below and ``hi`` above the ground."""
    return F.zip_with(ys, ground, lambda y, g: F.least(F.greatest(y, g - lo), g + hi))


def limit_grade(ys: Column, seg_len: Column, max_grade: float = 0.22, iters: int = 4) -> Column:
    """Cap |dy| <= grade * length by alternating forward and backward passes."""

    def swept(profile: Column, lengths: Column) -> Column:
        """Each height held within reach of the one before it; the first stays."""
        first = F.slice(profile.cast("array<double>"), 1, 1)
        steps = F.zip_with(F.slice(profile, 2, F.greatest(F.size(profile) - 1, F.lit(0))), lengths, lambda y, s: F.struct(y.cast("double").alias("y"), (max_grade * s).alias("cap")))

        def hold(done: Column, v: Column) -> Column:
            ref = F.element_at(done, -1)
            return F.concat(done, F.array(F.least(F.greatest(v["y"], ref - v["cap"]), ref + v["cap"])))

        return F.aggregate(steps, first, hold)

    # every step sweeps once and turns the line round; an even number of steps leaves it as it was
    def step(profile: Column, k: Column) -> Column:
        return F.reverse(swept(profile, F.when(k % 2 == 1, seg_len).otherwise(F.reverse(seg_len))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * iters)), ys.cast("array<double>"), step)


# ---- positions along a line ----------------------------------------------------
def midpoint_by_length(vertices: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """Point at half the arc length, with ``length``: keys, length, x, z."""
    keys = list(keys)
    block = block if block is not None else block_of("seq")
    segs = segments_of(vertices.select(*keys, "seq", "x", "z"), keys, block)
    total = segs.groupBy(*keys).agg(F.sum("len").alias("length"))
    half = F.col("length") / 2
    holding = segs.join(total, keys).where(F.col("s0") + F.col("len") >= half - 1e-9 * half)
    t = F.when(F.col("len") > 0, F.least((half - F.col("s0")) / F.col("len"), F.lit(1.0))).otherwise(0.0)
    spot = F.struct(
        (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("az") + (F.col("bz") - F.col("az")) * t).alias("z")
    )
    return holding.groupBy(*keys, "length").agg(F.min_by(spot, "seq").alias("m")).select(*keys, "length", "m.*")


def vertex_midpoint(vertices: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """The vertex at position n // 2."""
    keys = list(keys)
    block = block if block is not None else block_of("seq")
    numbered = running_total(vertices.withColumn("_one", F.lit(1)), keys, ["seq"], {"_i": "_one"}, block, totals=True)
    return numbered.where(F.col("_i") - 1 == F.floor(F.col("_i_total") / 2)).select(*keys, "x", "z")


def point_at(queries: DataFrame, route: DataFrame, s: str = "s", block: Column | None = None) -> DataFrame:
    """Points of one ordered route at arc lengths ``s`` (clamped to the route)."""
    block = block if block is not None else block_of("seq")
    segs = segments_of(route.select(F.lit(0).alias("_r"), "seq", "x", "z"), ["_r"], block)
    total = segs.agg(F.coalesce(F.sum("len"), F.lit(0.0)).alias("_total"))
    asked = beside(queries.select(s).distinct(), total)
    asked = asked.withColumn("_s", F.least(F.greatest(F.col(s), F.lit(0.0)), F.col("_total"))).withColumn("_zero", F.lit(0.0))
    spans = segs.withColumn("_s1", F.col("s0") + F.col("len") + 1e-9).withColumn("_s0", F.col("s0") - 1e-9).withColumn("_o", F.lit(0.0))
    hits = points_in_boxes(asked, spans, "_s", "_zero", "_s0", "_s1", "_o", "_o")
    best = hits.groupBy(s).agg(F.min_by(F.struct("_s", "s0", "len", "ax", "az", "bx", "bz"), "seq").alias("g"))
    t = F.when(F.col("g.len") > 0, F.least(F.greatest((F.col("g._s") - F.col("g.s0")) / F.col("g.len"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    found = best.select(
        s, (F.col("g.ax") + (F.col("g.bx") - F.col("g.ax")) * t).alias("x"), (F.col("g.az") + (F.col("g.bz") - F.col("g.az")) * t).alias("z")
    )
    return queries.join(found, s, "left")


def road_direction(vertices: DataFrame, keys: Sequence[str], offset: float = 0.0, block: Column | None = None) -> DataFrame:
    """Unit perpendicular (ux, uz) of each vertex from its adjacent segments, and the shifted point."""
    near = with_neighbours(vertices, keys, ["seq"], ["x", "z"], block if block is not None else block_of("seq"))
    x, z = F.col("x"), F.col("z")
    dx = F.coalesce(x - F.col("prev_x"), F.lit(0.0)) + F.coalesce(F.col("next_x") - x, F.lit(0.0))
    dz = F.coalesce(z - F.col("prev_z"), F.lit(0.0)) + F.coalesce(F.col("next_z") - z, F.lit(0.0))
    length = F.hypot(dx, dz)
    length = F.when(length == 0, 1.0).otherwise(length)
    near = near.withColumn("ux", -dz / length).withColumn("uz", dx / length)
    return near.select(
        *vertices.columns, "ux", "uz", (x + offset * F.col("ux")).alias("lane_x"), (z + offset * F.col("uz")).alias("lane_z")
    )


def second_difference(df: DataFrame, keys: Sequence[str], value: str = "y", block: Column | None = None) -> DataFrame:
    """|previous - 2 * value + next| of inner vertices, as ``d2``."""
    near = with_neighbours(df, keys, ["seq"], [value], block if block is not None else block_of("seq"))
    d2 = F.abs(F.col(f"prev_{value}") - 2 * F.col(value) + F.col(f"next_{value}"))
    return near.withColumn("d2", d2).where("d2 is not null").select(*df.columns, "d2")


def roughness(df: DataFrame, keys: Sequence[str], value: str = "y", block: Column | None = None) -> DataFrame:
    """Median and 95th percentile of the second difference, picked by rank; 0 without inner vertices."""
    d2 = second_difference(df, keys, value, block)
    picks = {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)}
    one = order_statistics(d2, [], "d2", picks, resolution=1.0 / 64)
    return one.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in picks])


def weld_endpoints(vertices: DataFrame, keys: Sequence[str], r: float = 1.0) -> DataFrame:
    """Move road ends that lie within ``r`` of each other onto their mean x, y, z."""
    from .clustering import cluster_within

    keys = list(keys)
    span = vertices.groupBy(*keys).agg(F.min("seq").alias("_a"), F.max("seq").alias("_b")).where("_a < _b")
    ends = vertices.join(span, keys).where("seq = _a or seq = _b").withColumn("_id", F.struct(*keys, "seq"))
    groups = cluster_within(ends.select("_id", "x", "z"), r, "_id")
    has_y = "y" in vertices.columns
    axes = ["x", "y", "z"] if has_y else ["x", "z"]
    joined = ends.select("_id", *axes).join(groups.select("_id", "cluster"), "_id")
    means = joined.groupBy("cluster").agg(*[F.avg(a).alias(f"_m{a}") for a in axes], F.count(F.lit(1)).alias("_n")).where("_n > 1")
    moved = joined.join(means, "cluster").select(*[F.col("_id")[k].alias(k) for k in [*keys, "seq"]], *[f"_m{a}" for a in axes])
    out = vertices.join(moved, [*keys, "seq"], "left")
    for a in axes:
        out = out.withColumn(a, F.coalesce(f"_m{a}", a))
    return out.select(*vertices.columns)


# ---- motion -------------------------------------------------------------------
def motion(poses: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, block: Column) -> DataFrame:
    """Velocity (vx, vz) and speed from consecutive poses; NULL for the first or a zero interval."""
    near = with_neighbours(poses, keys, order, [t, "x", "z"], block, nxt=None)
    dt = F.nullif(F.col(t) - F.col(f"prev_{t}"), F.lit(0.0))
    near = near.withColumn("vx", (F.col("x") - F.col("prev_x")) / dt).withColumn("vz", (F.col("z") - F.col("prev_z")) / dt)
    return near.select(*poses.columns, "vx", "vz", F.hypot("vx", "vz").alias("speed"))


def path_length(poses: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Distance travelled per track."""
    near = with_neighbours(poses, keys, order, ["x", "z"], block, nxt=None)
    step = F.coalesce(F.hypot(F.col("x") - F.col("prev_x"), F.col("z") - F.col("prev_z")), F.lit(0.0))
    return near.groupBy(*keys).agg(F.sum(step).alias("path_len"), F.count(F.lit(1)).alias("poses"))


def contact_phases(pairs: DataFrame, keys: Sequence[str], last_frame: int, block: Column | None = None) -> DataFrame:
    """Contact rows (keys, frame) as enter or stay, plus an exit row one frame after each spell.

    Spells still open at ``last_frame`` have no exit yet.
    """
    keys = list(keys)
    near = with_neighbours(pairs.select(*keys, "frame"), keys, ["frame"], ["frame"], block if block is not None else block_of("frame", 4096))
    phase = F.when(F.col("prev_frame") == F.col("frame") - 1, "stay").otherwise("enter")
    rows = near.select(*keys, "frame", phase.alias("phase"))
    ended = F.coalesce(F.col("next_frame") != F.col("frame") + 1, F.lit(True)) & (F.col("frame") < last_frame)
    return rows.unionByName(near.where(ended).select(*keys, (F.col("frame") + 1).alias("frame"), F.lit("exit").alias("phase")))


def settle(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column, window: int = 5, max_range: float = 1.0) -> DataFrame:
    """Upper median of the trailing ``window`` samples once they agree, else NULL (``settled``)."""
    keys = list(keys)
    numbered = row_numbers(df, keys, order, block, "_seq")
    w = Window.partitionBy(*keys, "_blk").orderBy("_seq").rowsBetween(-(window - 1), 0)
    framed = with_tail(numbered, keys, "_seq", window - 1).withColumn("_w", F.array_sort(F.collect_list(value).over(w)))
    return framed.where("not _halo").select(*df.columns, settled_value(F.col("_w"), window, max_range).alias("settled"))


def settled_value(sorted_samples: Column, window: int = 5, max_range: float = 1.0) -> Column:
    n = F.size(sorted_samples)
    tight = F.get(sorted_samples, n - 1) - F.get(sorted_samples, F.lit(0)) <= max_range
    return F.when((n >= min(4, window)) & tight, F.get(sorted_samples, F.floor(n / 2).cast("int")))


def anchored_heading(poses: DataFrame, keys: Sequence[str], min_move: float = 0.5, block: Column | None = None) -> DataFrame:
    """Heading in degrees from the last anchor; it changes once a track has moved ``min_move``.

    The anchors are the vertices greedy thinning keeps, so the thinning does the fold.
    """
    from ..functions.angles import heading_from_motion

    keys = list(keys)
    block = block if block is not None else block_of("seq")
    anchors = dedupe_min_distance(poses, keys, min_move, strict=False, block=block)
    turns = with_neighbours(anchors, keys, ["seq"], ["x", "z"], block, nxt=None)
    h = heading_from_motion(F.col("x") - F.col("prev_x"), F.col("z") - F.col("prev_z"))
    turns = turns.select(*keys, "seq", F.coalesce(h, F.lit(0.0)).alias("_h"))
    return fill_forward(poses.join(turns, [*keys, "seq"], "left"), keys, ["seq"], "_h", block, "heading").drop("_h")
