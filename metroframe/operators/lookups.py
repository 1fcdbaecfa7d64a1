"""Equi, ordered, raster and snapshot joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grid_cell
from ..plans.cells import points_in_boxes


# ---- map elements -----------------------------------------------------------
def resolve_node_refs(ways: DataFrame, nodes: DataFrame, missing: str = "drop") -> DataFrame:
    """Ways (way_id, nodes ARRAY<BIGINT>) with their coordinates in order.

    ``missing="drop"`` leaves unknown nodes out; ``"reject"`` gives no row for such a way.
    """
    refs = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))
    spots = nodes.select(F.col("id").alias("node_id"), "x", "z")
    how = "inner" if missing == "drop" else "left"
    found = refs.join(spots, "node_id", how)
    vertex = F.struct("pos", "x", "z")
    built = found.groupBy("way_id").agg(
        F.array_sort(F.collect_list(vertex)).alias("_v"), F.count_if(F.col("x").isNull()).alias("_lost")
    )
    if missing == "reject":
        built = built.where("_lost = 0")
    pts = F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["z"].alias("z")))
    return ways.drop("nodes").join(built.select("way_id", pts.alias("pts")), "way_id")


def standalone_ways(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Ways that no relation uses as an outer (or unnamed) or inner member."""
    used = (
        relations.select(F.explode("members").alias("m"))
        .where((F.col("m.type") == "way") & F.coalesce(F.col("m.role"), F.lit("")).isin("outer", "", "inner"))
        .select(F.col("m.ref").alias("way_id")).distinct()
    )
    return ways.join(used, "way_id", "left_anti")


# ---- transit ----------------------------------------------------------------
def route_enrich(vehicles: DataFrame, routes: DataFrame) -> DataFrame:
    """Left join of vehicles with their route's short name, colour and name."""
    r = routes.select(
        F.col("route_id"), F.coalesce(F.nullif("short_name", F.lit("")), "route_id").alias("route_short_name"),
        F.coalesce(F.nullif("color", F.lit("")), F.lit("3b82c4")).alias("route_color"),
        F.coalesce("long_name", F.lit("")).alias("route_long_name"),
    )
    return vehicles.join(r, "route_id", "left")


def stop_routes(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """For each stop, the distinct routes that call there, by sort order then id."""
    calls = stop_times.select("stop_id", "trip_id").distinct()
    served = calls.join(trips.select("trip_id", "route_id").distinct(), "trip_id").select("stop_id", "route_id").distinct()
    ranked = served.join(routes.select("route_id", "sort_order"), "route_id", "left").withColumn(
        "sort_order", F.coalesce("sort_order", F.lit(9999))
    )
    lists = ranked.groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "route_id"))).alias("_r"))
    return lists.select("stop_id", F.transform("_r", lambda r: r["route_id"]).alias("routes"))


def route_shapes(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shape points of each distinct (route, shape): route_id, shape_id, seq and the point columns."""
    used = trips.where("route_id is not null and shape_id is not null").select("route_id", "shape_id").distinct()
    return used.join(shapes, "shape_id")


# ---- rasters ----------------------------------------------------------------
def grid_lookup(
    df: DataFrame, cells: DataFrame, spec: dict, fallback: Column | float | None = None,
    edge: str = "null", out: str = "ground_y",
) -> DataFrame:
    """Cell value at (x, z).  Gaps, and outside points unless ``edge="clamp"``, take the fallback."""
    mode = "clamp" if edge == "clamp" else "trunc"
    ix, iz = grid_cell(F.col("x"), F.col("z"), spec["cell"], spec["x0"], spec["z0"], mode, spec["nx"], spec["nz"])
    keyed = df.withColumn("_ix", ix).withColumn("_iz", iz)
    grid = cells.select(F.col("ix").alias("_ix"), F.col("iz").alias("_iz"), F.col("y").alias("_y"))
    grid = grid.where(F.col("_ix").between(0, spec["nx"] - 1) & F.col("_iz").between(0, spec["nz"] - 1))
    value = F.col("_y")
    if fallback is not None:
        value = F.coalesce(value, fallback if isinstance(fallback, Column) else F.lit(float(fallback)))
    return keyed.join(grid, ["_ix", "_iz"], "left").withColumn(out, value).drop("_ix", "_iz", "_y")


def grid_nearest_fill(df: DataFrame, cells: DataFrame, spec: dict, max_r: int = 5, out: str = "ground_y") -> DataFrame:
    """Cell value at (x, z); a gap takes the median of the smallest square window that has values."""
    ix, iz = grid_cell(F.col("x"), F.col("z"), spec["cell"], spec["x0"], spec["z0"], "trunc")
    inside = ix.between(0, spec["nx"] - 1) & iz.between(0, spec["nz"] - 1)
    keyed = df.withColumn("_ix", F.when(inside, ix)).withColumn("_iz", F.when(inside, iz))
    grid = cells.select(F.col("ix").alias("_ix"), F.col("iz").alias("_iz"), F.col("y").alias("_y"))
    asked = keyed.where("_ix is not null").select("_ix", "_iz").distinct()
    known = asked.join(grid, ["_ix", "_iz"])
    gaps = asked.join(grid, ["_ix", "_iz"], "left_anti")
    steps = F.sequence(F.lit(-max_r), F.lit(max_r))
    around = (
        gaps.withColumn("_dx", F.explode(steps)).withColumn("_dz", F.explode(steps))
        .select(
            F.col("_ix").alias("_gx"), F.col("_iz").alias("_gz"), (F.col("_ix") + F.col("_dx")).alias("_ix"),
            (F.col("_iz") + F.col("_dz")).alias("_iz"), F.greatest(F.abs("_dx"), F.abs("_dz")).alias("_ring"),
        )
    )
    rings = around.join(grid, ["_ix", "_iz"]).groupBy("_gx", "_gz", "_ring").agg(F.percentile("_y", 0.5).alias("_m"))
    filled = rings.groupBy("_gx", "_gz").agg(F.min_by("_m", "_ring").alias("_y"))
    values = known.unionByName(filled.select(F.col("_gx").alias("_ix"), F.col("_gz").alias("_iz"), "_y"))
    return keyed.join(values, ["_ix", "_iz"], "left").withColumnRenamed("_y", out).drop("_ix", "_iz")


def bilinear_sample(df: DataFrame, nodes: DataFrame, spec: dict, out: str = "v") -> DataFrame:
    """Bilinear value of a node grid (i, j, v) at (x, z), plus ``ready``.

    ``spec`` has cols, rows, x0, z0, cell.  Unknown corners take the mean of the known
    ones; with none known the value is 0 and ``ready`` is false.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = nodes.where("v is not null").withColumn("_k", corner).select(
        (F.col("i") - F.col("_k.a")).alias("_i0"), (F.col("j") - F.col("_k.b")).alias("_j0"),
        F.col("_k.a").alias("a"), F.col("_k.b").alias("b"), "v",
    )

    def at(a: int, b: int) -> Column:
        return F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("v"))).alias(f"_v{a}{b}")

    patches = spread.groupBy("_i0", "_j0").agg(at(0, 0), at(1, 0), at(0, 1), at(1, 1), F.avg("v").alias("_mean"))
    fx, fz = (F.col("x") - spec["x0"]) / F.lit(float(spec["cell"])), (F.col("z") - spec["z0"]) / F.lit(float(spec["cell"]))
    lo = F.lit(0).cast("long")
    i0 = F.greatest(F.least(F.floor(fx), F.lit(spec["cols"] - 2)), lo)
    j0 = F.greatest(F.least(F.floor(fz), F.lit(spec["rows"] - 2)), lo)
    one, zero = F.lit(1.0), F.lit(0.0)
    keyed = df.withColumn("_i0", i0).withColumn("_j0", j0)
    keyed = keyed.withColumn("_tx", F.least(F.greatest(fx - F.col("_i0"), zero), one)).withColumn(
        "_tz", F.least(F.greatest(fz - F.col("_j0"), zero), one)
    )
    j = keyed.join(patches, ["_i0", "_j0"], "left")
    v = {k: F.coalesce(F.col(f"_v{k}"), F.col("_mean")) for k in ("00", "10", "01", "11")}
    tx, tz = F.col("_tx"), F.col("_tz")
    near, far = v["00"] * (1 - tx) + v["10"] * tx, v["01"] * (1 - tx) + v["11"] * tx
    value = near * (1 - tz) + far * tz
    return j.select(*df.columns, F.coalesce(value, zero).alias(out), F.col("_mean").isNotNull().alias("ready"))


# ---- ranges, sets, snapshots ------------------------------------------------
def range_lookup(df: DataFrame, ranges: DataFrame, pos: str, start: str, count: str, carry: Sequence[str]) -> DataFrame:
    """Left join of positions with the record whose half-open range [start, start+count) holds them."""
    first = F.col(start).cast("double")
    spans = ranges.where(F.col(count) > 0).select(
        *carry, first.alias("_x0"), (first + F.col(count) - 1).alias("_x1"), F.lit(0.0).alias("_z0"), F.lit(0.0).alias("_z1")
    )
    asked = df.select(pos).distinct().withColumn("_px", F.col(pos).cast("double")).withColumn("_pz", F.lit(0.0))
    found = points_in_boxes(asked, spans, "_px", "_pz", "_x0", "_x1", "_z0", "_z1").select(pos, *carry)
    return df.join(found, pos, "left")


def keep_set(df: DataFrame, produced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not produced (stale ones)."""
    return df.join(produced.select(*keys).distinct(), list(keys), "left_anti")


def replay_compare(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("episode",), atol: float = 1e-4) -> DataFrame:
    """Per episode: steps compared and steps whose rewards differ by more than ``atol``."""
    joined = a.select(*keys, "step", F.col("reward").alias("_ra")).join(
        b.select(*keys, "step", F.col("reward").alias("_rb")), [*keys, "step"]
    )
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.abs(F.col("_ra") - F.col("_rb")) > atol).alias("mismatches")
    )
    return out.withColumn("ok", F.col("mismatches") == 0)


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    """Keys of either snapshot with ``change``: appear, stay or leave."""
    p = prev.select(key).distinct().withColumn("_p", F.lit(True))
    c = cur.select(key).distinct().withColumn("_c", F.lit(True))
    change = F.when(F.col("_p").isNull(), "appear").when(F.col("_c").isNull(), "leave").otherwise("stay")
    return p.join(c, key, "full_outer").select(key, change.alias("change"))
