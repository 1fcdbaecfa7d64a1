"""Grouped statistics over points, footprints, roads and motion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rings import polyline_length as ring_line_length
from ..functions.rings import ring_area, ring_centroid
from ..plans.onerow import beside
from ..plans.ordered import block_of
from ..plans.select import exact_percentile, order_statistics
from ..session import materialize
from .lookups import grid_nearest_fill
from .polylines import midpoint_by_length, segments_of, vertex_midpoint
from .spatial import points_in_polygons, road_crosses_box


# ---- buildings ----------------------------------------------------------------
def roof_height(
    points: DataFrame,
    footprints: DataFrame,
    ground: DataFrame,
    spec: dict,
    pct: float = 85.0,
    min_pts: int = 5,
    clip: tuple[float, float] = (3.0, 200.0),
    buffer: float = 2.0,
    default_h: float = 7.0,
) -> DataFrame:
    """Height of each footprint (box_id, ring, tag_h): roof percentile minus ground.

    The roof is the ``pct`` percentile of the returns within ``buffer`` of the
    footprint, the ground the cell under its centroid (else the 3rd percentile
    less 1 m).  With fewer than ``min_pts`` returns the tag or the default counts.
    """
    rings = footprints.select("box_id", "ring")
    hits = points_in_polygons(points.select("x", "z", "y"), rings, buffer)
    roofs = exact_percentile(hits.select("box_id", "y"), ["box_id"], "y", {"roof": pct / 100.0, "low": 0.03})
    cx, cz = ring_centroid(F.col("ring"))
    # a one-element explode evaluates the centroid once instead of inlining it everywhere
    centre = F.explode(F.array(F.struct(cx.alias("x"), cz.alias("z"))))
    base = grid_nearest_fill(footprints.select("box_id", "tag_h", centre.alias("c")).select("box_id", "tag_h", "c.*"), ground, spec)
    joined = base.join(roofs, "box_id", "left")
    n = F.coalesce("_n", F.lit(0))
    measured = n >= min_pts
    tag = F.coalesce(F.nullif("tag_h", F.lit(0.0)), F.lit(default_h))
    h = F.when(measured, F.col("roof") - F.coalesce("ground_y", F.col("low") - 1.0)).otherwise(tag)
    return joined.select(
        "box_id",
        F.least(F.greatest(h, F.lit(clip[0])), F.lit(clip[1])).alias("height_m"),
        n.cast("long").alias("point_count"),
        F.when(measured, "osm+lidar").otherwise("osm").alias("provenance"),
        "ground_y",
    )


def robust_range(df: DataFrame, keys: Sequence[str], value: str = "y", lo: float = 2, hi: float = 98) -> DataFrame:
    """Percentile range per group; min and max where it is empty or inverted."""
    p = exact_percentile(df, keys, value, {"lo": lo / 100.0, "hi": hi / 100.0, "_min": 0.0, "_max": 1.0})
    bad = F.col("hi") <= F.col("lo")
    return p.select(*keys, F.when(bad, F.col("_min")).otherwise(F.col("lo")).alias("lo"), F.when(bad, F.col("_max")).otherwise(F.col("hi")).alias("hi"))


#: One road of so many is tried first.
_SHARE = 64


def footprint_ground(boxes: DataFrame, sample, vertices: DataFrame, pct: float = 15, bridge_float: float = 2.5) -> DataFrame:
    """Ground under each box (box_id, x0, x1, z0, z1, base_y) and how far it floats.

    ``sample(df)`` adds ``v`` at x, z.  The ground is a low percentile of a 4x4 grid
    of samples.  A box floating more than ``bridge_float`` over a crossing road is a bridge.
    Only boxes that may be bridges are tried, first against a small share of the roads, picked by a hash: what one of
    these crosses needs no other road, so under many roads few pairs are made.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(3)))
    grid = boxes.withColumn("_i", at).withColumn("_j", at)
    grid = grid.withColumn("x", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_i") / 3).withColumn(
        "z", F.col("z0") + (F.col("z1") - F.col("z0")) * F.col("_j") / 3
    )
    ground = sample(grid.select("box_id", "base_y", "x", "z")).groupBy("box_id", "base_y").agg(
        F.percentile("v", pct / 100.0).alias("ground_y")  # sixteen values
    )
    ground = materialize(ground.withColumn("float_h", F.col("base_y") - F.col("ground_y")))
    high = F.col("float_h") > bridge_float
    places = boxes.select("box_id", "x0", "x1", "z0", "z1")
    rest = places.join(ground.where(F.coalesce(high, F.lit(True))).select("box_id").distinct(), "box_id", "left_semi")
    few = F.pmod(F.xxhash64("road_id"), F.lit(_SHARE)) == 0
    first = materialize(road_crosses_box(vertices.where(few), rest, "box_id", "road_id").select("box_id").distinct())
    rest = materialize(rest.join(first, "box_id", "left_anti"))
    crossed = first.unionByName(road_crosses_box(vertices.where(~few), rest, "box_id", "road_id").select("box_id").distinct())
    out = ground.join(crossed.withColumn("_road", F.lit(True)), "box_id", "left")
    bridge = high & F.coalesce("_road", F.lit(False))
    return out.select("box_id", "ground_y", "float_h", bridge.alias("bridge"))


def grounding_counts(grounded: DataFrame) -> DataFrame:
    """Boxes dropped, raised and left as bridges, with median and greatest move."""
    moved = grounded.where("not bridge").withColumn("_m", F.abs("float_h"))
    mid = exact_percentile(moved, [], "_m", {"median_move": 0.5}).select("median_move")
    sums = grounded.agg(
        F.count_if(~F.col("bridge") & (F.col("float_h") > 0)).alias("dropped"),
        F.count_if(~F.col("bridge") & (F.col("float_h") < 0)).alias("raised"),
        F.count_if("bridge").alias("bridges"),
        F.max(F.when(~F.col("bridge"), F.abs("float_h"))).alias("max_move"),
    )
    return beside(sums, mid)


def provenance_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("provenance").agg(F.count(F.lit(1)).alias("buildings"))


def building_shape_gate(df: DataFrame) -> DataFrame:
    """Recovered shapes that look like buildings: area 40..4000 m2, on road <= 15 %,
    on known footprints <= 20 %, height 2..120 m."""
    return df.where(
        F.col("area").between(40, 4000) & (F.col("road_frac") <= 0.15) & (F.col("osm_frac") <= 0.20)
        & F.col("height_m").between(2, 120)
    )


def footprint_gate(df: DataFrame, bbox: tuple[float, float, float, float], min_area: float = 15.0) -> DataFrame:
    """Rings with enough area whose centroid lies in the extent."""
    cx, cz = ring_centroid(F.col("ring"))
    x0, z0, x1, z1 = bbox
    return df.where((ring_area(F.col("ring")) >= min_area) & cx.between(x0, x1) & cz.between(z0, z1))


# ---- bounds and histograms ------------------------------------------------------
def bounds(df: DataFrame, keys: Sequence[str] = (), cols: Sequence[str] = ("x", "z")) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def class_histogram(df: DataFrame, cls: str = "cls") -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def channel_stats(df: DataFrame, cols: Sequence[str], ps: Sequence[int] = (1, 25, 50, 75, 99)) -> DataFrame:
    """Mean and exact percentiles of columns: one row per channel."""
    pairs = [F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    pct = exact_percentile(long, ["channel"], "v", {f"p{p}": p / 100.0 for p in ps}).drop("_n")
    return long.groupBy("channel").agg(F.avg("v").alias("mean")).join(pct, "channel")


def centroid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("z").alias("z"))


def layer_stats(layers: dict[str, DataFrame], totals: dict[str, str] | None = None) -> DataFrame:
    """Row count, and the sum of one column where named, per layer."""
    out = None
    for name, df in layers.items():
        total = F.sum(totals[name]).cast("double") if totals and name in totals else F.lit(None).cast("double")
        row = df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("rows"), total.alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- roads ------------------------------------------------------------------------
def node_usage(ways: DataFrame, min_count: int = 2) -> DataFrame:
    """Nodes that at least ``min_count`` way references share."""
    refs = ways.select(F.explode("nodes").alias("node_id"))
    return refs.groupBy("node_id").agg(F.count(F.lit(1)).alias("ways")).where(F.col("ways") >= min_count)


def polyline_length(vertices: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """Length per polyline; ends and gaps add nothing."""
    segs = segments_of(vertices, keys, block if block is not None else block_of("seq"))
    return segs.groupBy(*keys).agg(F.sum("len").alias("length"))


def longest_by_name(vertices: DataFrame, key: str = "road_id", name: str = "name", middle: str = "vertex", block: Column | None = None) -> DataFrame:
    """Longest polyline per name with its middle (``vertex`` n // 2 or half ``length``)."""
    block = block if block is not None else block_of("seq")
    length = polyline_length(vertices, [key], block)
    names = vertices.groupBy(key).agg(F.first(name, ignorenulls=True).alias("name"))
    mids = (vertex_midpoint if middle == "vertex" else midpoint_by_length)(vertices, [key], block).select(key, "x", "z")
    rows = length.join(names.where("name is not null"), key).join(mids, key)
    best = rows.groupBy("name").agg(F.max_by(F.struct("length", key, "x", "z"), F.struct(F.col("length"), -F.col(key))).alias("b"))
    return best.select("name", "b.*")


def prominent_per_cell(named: DataFrame, cell: float = 650.0, limit: int = 2000) -> DataFrame:
    """Longest name per map cell, then the longest ``limit`` of those."""
    cx = F.floor(F.col("x") / cell + 0.5)
    cz = F.floor(F.col("z") / cell + 0.5)
    best = named.groupBy(cx.alias("cx"), cz.alias("cz")).agg(
        F.max_by(F.struct("name", "length", "x", "z"), F.struct(F.col("length"), F.col("name"))).alias("b")
    )
    return best.select("cx", "cz", "b.*").orderBy(F.desc("length"), "name").limit(limit)


def label_candidates(roads: DataFrame, inner_names: DataFrame) -> DataFrame:
    """Named arterials that the inner (detailed) layer does not already label."""
    from ..functions.predicates import label_class

    return roads.where(label_class(F.col("class")) & F.col("name").isNotNull()).join(
        inner_names.select("name").distinct(), "name", "left_anti"
    )


def group_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("rank", "width")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(f"max_{c}") for c in cols])


def array_line_lengths(lines: DataFrame) -> DataFrame:
    """``length`` of array polylines, without any shuffle."""
    return lines.withColumn("length", ring_line_length(F.col("pts")))


# ---- directions ---------------------------------------------------------------------
def circular_mean(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.atan2(F.sum(F.sin(col)), F.sum(F.cos(col))).alias("mean_angle"), F.count(F.lit(1)).alias("n"))


def principal_axis(df: DataFrame, keys: Sequence[str], dx: str = "dx", dz: str = "dz") -> DataFrame:
    """Axis of undirected motion: dominant eigenvector of the mean of u u^T over unit vectors.

    Groups with fewer than two real vectors are left out.
    """
    length = F.hypot(dx, dz)
    unit = df.where(length >= 1e-9).withColumn("_ux", F.col(dx) / length).withColumn("_uz", F.col(dz) / length)
    t = unit.groupBy(*keys).agg(
        F.avg(F.col("_ux") * F.col("_ux")).alias("a"), F.avg(F.col("_ux") * F.col("_uz")).alias("b"),
        F.avg(F.col("_uz") * F.col("_uz")).alias("c"), F.count(F.lit(1)).alias("n"),
    ).where("n >= 2")
    tr, det = F.col("a") + F.col("c"), F.col("a") * F.col("c") - F.col("b") * F.col("b")
    l1 = tr / 2 + F.sqrt(F.greatest(tr * tr / 4 - det, F.lit(0.0)))
    tilted = F.abs("b") > 1e-12
    ax = F.when(tilted, l1 - F.col("c")).when(F.col("a") >= F.col("c"), 1.0).otherwise(0.0)
    az = F.when(tilted, F.col("b")).when(F.col("a") >= F.col("c"), 0.0).otherwise(1.0)
    norm = F.hypot(ax, az)
    return t.select(
        *keys, (ax / norm).alias("ax"), (az / norm).alias("az"),
        F.when(l1 > 1e-12, (2 * l1 - tr) / tr).otherwise(0.0).alias("coherence"), "n",
    )


def split_two_way(df: DataFrame, axis: DataFrame, keys: Sequence[str], dx: str = "dx", dz: str = "dz") -> DataFrame:
    """Mean direction, count and mean speed on each side of the axis; side 1 is along it."""
    along = F.col(dx) * F.col("ax") + F.col(dz) * F.col("az")
    length = F.hypot(dx, dz)
    safe = F.when(length == 0, 1.0).otherwise(length)
    sided = df.join(axis.select(*keys, "ax", "az"), list(keys)).withColumn("side", F.when(along >= 0, 1).otherwise(-1))
    g = sided.groupBy(*keys, "side").agg(
        F.sum(F.col(dx) / safe).alias("_x"), F.sum(F.col(dz) / safe).alias("_z"),
        F.count(F.lit(1)).alias("count"), F.avg(length).alias("speed"),
    )
    norm = F.hypot("_x", "_z")
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    return g.select(*keys, "side", (F.col("_x") / norm).alias("dir_x"), (F.col("_z") / norm).alias("dir_z"), "count", "speed")


# ---- reports ----------------------------------------------------------------------
def overlap_summary(scored: DataFrame, matches: DataFrame, known_total: DataFrame) -> DataFrame:
    """Totals of a footprint comparison.

    ``scored``: name, provenance, overlaps, best_iou, road_frac; ``matches``: known id per
    match; ``known_total``: one row ``n``.  The median takes the upper middle value.
    """
    hit = matches.select("known_id").distinct().agg(F.count(F.lit(1)).alias("known_matched"))
    med = order_statistics(scored.where("overlaps > 0"), [], "best_iou", {"median_iou": lambda n: F.floor(n / 2)}, 1.0 / 256)
    med = med.agg(F.coalesce(F.max("median_iou"), F.lit(0.0)).alias("median_iou"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("overlaps") > 0).alias("matched"),
        F.count_if(F.col("overlaps") > 1).alias("merged"),
        F.coalesce(F.sum(F.when(F.col("overlaps") > 1, F.col("overlaps"))), F.lit(0)).cast("long").alias("swallowed"),
        F.count_if((F.col("overlaps") == 0) & (F.col("provenance") != "lidar_only")).alias("spurious"),
        F.count_if(F.col("provenance") == "lidar_only").alias("lidar_only"),
        F.count_if(F.col("road_frac") >= 0.05).alias("road_crossing"),
    )
    one = beside(sums, hit, known_total.select(F.col("n").alias("known")), med)
    return one.withColumn("known_missed", F.col("known") - F.col("known_matched"))


def snap_report(cameras: DataFrame, dist: str = "dist", snap: float = 75.0) -> DataFrame:
    """Cameras within ``snap``, and median, 90th percentile and maximum distance picked by rank."""
    picks = {
        "median": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 0.9)), "max": lambda n: n - 1,
    }
    ranks = order_statistics(cameras, [], dist, picks)
    n = cameras.agg(F.count(F.lit(1)).alias("cameras"), F.count_if(F.col(dist) <= snap).alias("matched"))
    return beside(n, ranks.select("median", "p90", "max"))


def max_penetration(poses: DataFrame, entity_id: str, frame: Sequence[str]) -> DataFrame:
    """Deepest overlap of oriented bodies per frame (poses: x, z, yaw, hx, hz) and its pair."""
    from .spatial import obb_overlap

    def side(p: str) -> DataFrame:
        return poses.select(
            *frame, F.col(entity_id).alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "z", "yaw", "hx", "hz")]
        )

    pairs = obb_overlap(side("a"), side("b"), on=frame).where("a_id < b_id")
    worst = pairs.groupBy(*frame).agg(
        F.max_by(F.struct("a_id", "b_id", "pen"), F.struct(F.col("pen"), -F.col("a_id"), -F.col("b_id"))).alias("w"),
        F.count(F.lit(1)).alias("overlaps"),
    )
    return worst.select(*frame, "w.*", "overlaps")


def min_gap(poses: DataFrame, entity_id: str, frame: Sequence[str]) -> DataFrame:
    """Smallest centre distance per frame."""
    from .spatial import nearest_join

    keyed = poses.withColumn("_key", F.struct(*frame, entity_id))
    near = nearest_join(keyed, keyed, "_key", "_key", partition_by=list(frame), exclude_self=True, out="_o")
    return near.groupBy(*frame).agg(F.min("dist").alias("min_gap"))


