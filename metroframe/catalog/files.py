"""Round trips: rows of the driver tables written in each file format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..operators.rasters import grid_chunk, ground_grid
from ..session import scratch_path
from ..sources import files as S
from .clouds import _GRID, SPEC
from .feeds import _ALERT, entities
from .registry import query, r

#: Small enough that the files of the small tables are cut.
_SPLIT = 1 << 16


def _f4(sql: str, name: str) -> str:
    return f"CAST(CAST({sql} AS FLOAT) AS DOUBLE) AS {name}"


# ---- binary records ---------------------------------------------------------------
@query(with_views("points") + f" SELECT {_f4('x', 'x')}, {_f4('y', 'y')}, {_f4('z', 'z')}, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b, CAST(255 AS BIGINT) AS a FROM fx_points")
def point_bins(t):
    """Points written as binary chunks and read back in byte ranges."""
    path = scratch_path(t.spark, "points-")
    colours = [(F.col(c) % 256).cast("short").alias(n) for n, c in (("r", "l_partkey"), ("g", "l_suppkey"), ("b", "l_orderkey"))]
    pts = t.points.select("x", "y", "z", *colours)
    S.write_point_bins(grid_chunk(pts, (0.0, 0.0, 1000.7, 1000.7)), path)
    back = S.read_point_chunks(t.spark, path, split=_SPLIT)
    return back.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("long").alias(c) for c in "rgba"])


@query(with_views("points") + " SELECT l_suppkey % 16 AS tile, count(*) AS count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM fx_points GROUP BY ALL")
def point_tiles(t):
    """Manifest of points stored by tile."""
    tiled = t.points.select((F.col("l_suppkey") % 16).alias("tile"), "x", "y", "z")
    out = S.write_point_chunks(tiled, scratch_path(t.spark, "tiles-"))
    return out.withColumn("tile", F.col("tile").cast("long"))


@query(with_views("roads") + f" SELECT o_orderkey // 1024 AS chunk, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS i, {_f4('x', 'x')}, {_f4('y', 'y')}, {_f4('z', 'z')} FROM fx_roads")
def mesh_vertices(t):
    """Meshes written and read back, vertices in their order."""
    path = scratch_path(t.spark, "meshes-")
    S.write_mesh_vertices(t.roads.select(F.floor(F.col("o_orderkey") / 1024).alias("chunk"), F.col("o_orderkey").alias("i"), "x", "y", "z"), path)
    back = S.read_mesh_vertices(t.spark, f"{path}/chunk_*.bin", split=_SPLIT)
    chunk = F.regexp_extract("path", r"chunk_(\d+)\.bin$", 1).cast("long")
    return back.select(chunk.alias("chunk"), "i", *[F.col(c).cast("double").alias(c) for c in "xyz"])


_CORNER = "CAST(CAST(({c} + ({k})*(s_suppkey % 5)/2.0E0)*100 + {o} AS FLOAT) AS DOUBLE)"


@query(with_views("targets") + ", s AS (SELECT target_id AS s_suppkey, x, z, unnest([0, 1, 2, 3]) AS i FROM fx_targets WHERE target_id % 5 <> 0 AND target_id % 11 <> 0) SELECT s_suppkey AS site, CAST(i AS BIGINT) AS i, "
       f"round(({_CORNER.format(c='x', k='CASE WHEN i IN (0, 3) THEN -1 ELSE 1 END', o=500)} - 500)/100, 6)+0.0 AS x, round(({_CORNER.format(c='z', k='CASE WHEN i < 2 THEN -1 ELSE 1 END', o=-700)} + 700)/100, 6)+0.0 AS z FROM s")
def footprint_bins(t):
    """Base rings of extruded bodies; flat ones (a fifth) and short files (an eleventh) are left out."""
    path = scratch_path(t.spark, "bodies-")
    site, i = F.col("target_id"), F.col("i")
    n = F.when(site % 11 == 0, 5).otherwise(9)  # vertices: base, top, middle
    rows = t.targets.select("target_id", "x", "z", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    half = (site % 5) / 2.0
    x = F.col("x") + F.when((i % 4).isin(0, 3), -1).otherwise(1) * half
    z = F.col("z") + F.when(i % 4 < 2, -1).otherwise(1) * half
    S.write_mesh_vertices(rows.select(site.alias("chunk"), "i", (x * 100 + 500).alias("x"), (z * 100 - 700).alias("y"), F.lit(300.0).alias("z")), path)
    rings = S.read_footprint_bins(t.spark, path, (500.0, -700.0, 0.0))
    site = F.regexp_extract("path", r"chunk_(\d+)\.bin$", 1).cast("long").alias("site")
    return rings.select(site, F.posexplode("ring").alias("i", "p")).select("site", F.col("i").cast("long").alias("i"), r("p.x").alias("x"), r("p.z").alias("z"))


@query(with_views("points") + _GRID + " SELECT ix, iz, y FROM grid")
def elevation_grid(t):
    """A ground grid stored with its specification and read back."""
    path = scratch_path(t.spark, "grid-")
    S.write_grid(ground_grid(t.points, SPEC), SPEC, path)
    cells, spec = S.read_grid(t.spark, path)
    return cells.where((F.col("ix") < spec["nx"]) & (F.col("iz") < spec["nz"]))


# ---- text formats -------------------------------------------------------------------
@query("""SELECT CAST(c_custkey AS VARCHAR) AS stop_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('C', c_custkey) END AS code, c_name AS name, 38 + c_custkey/100000.0E0 AS lat, -84 - c_nationkey/100.0E0 AS lon
 FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 7 <> 0""")
def schedule_stops(t):
    """Boardable stops of a schedule folder whose tables begin with a byte-order mark."""
    path, k = scratch_path(t.spark, "schedule-"), F.col("c_custkey")
    t.customer.select(
        k.cast("string").alias("﻿stop_id"), F.when(k % 3 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("stop_code"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("stop_name"),
        F.when(k % 7 == 0, "?").otherwise((38 + k / 100000.0).cast("string")).alias("stop_lat"), (-84 - F.col("c_nationkey") / 100.0).alias("stop_lon"),
        F.element_at(F.array(F.lit(None), F.lit("0"), F.lit("1"), F.lit("2")), (k % 4 + 1).cast("int")).alias("location_type"),
    ).write.option("header", True).csv(f"{path}/stops.txt")
    return S.gtfs_stops(S.read_gtfs(t.spark, path)["stops"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS shape_id, CAST(o_orderkey AS INTEGER) AS seq, -84 - o_orderkey/1000000.0E0 AS lon, 38 + o_custkey/1000000.0E0 AS lat FROM orders WHERE o_orderkey % 9 <> 0")
def schedule_shapes(t):
    """Shape points of a schedule folder; those without a number are left out, tables that are missing are empty."""
    path, k = scratch_path(t.spark, "schedule-"), F.col("o_orderkey")
    t.orders.select(
        F.col("o_custkey").alias("shape_id"), F.when(k % 9 == 0, "x").otherwise(k.cast("string")).alias("shape_pt_sequence"),
        (38 + F.col("o_custkey") / 1000000.0).alias("shape_pt_lat"), (-84 - k / 1000000.0).alias("shape_pt_lon"),
    ).write.option("header", True).csv(f"{path}/shapes.txt")
    tables = S.read_gtfs(t.spark, path)
    used = tables["trips"].select("shape_id")
    return S.gtfs_shapes(tables["shapes"]).join(used, "shape_id", "left_anti")


@query("SELECT event_id // 1000 AS feed_ts, CAST(event_id AS VARCHAR) AS id, event_id*10 AS start, CAST(event_id % 14 AS INTEGER) AS cause, CAST(event_id % 9 AS VARCHAR) AS route FROM events")
def realtime_files(t):
    """Alert feeds, one document per file, read back as entities."""
    path = scratch_path(t.spark, "feed-")
    feed = F.floor(F.col("event_id") / 1000).alias("feed")
    docs = entities(t, _ALERT, "alerts").groupBy(feed).agg(F.collect_list("e").alias("Entities"))
    docs.select("feed", F.struct(F.col("feed").alias("Timestamp")).alias("Header"), "Entities").write.partitionBy("feed").json(path)
    alert = F.col("e.Alert")
    return S.read_gtfs_rt(t.spark, path, "alerts").select(
        "feed_ts", F.col("e.Id").alias("id"), alert["ActivePeriods"][0]["Start"].alias("start"), alert["cause"].alias("cause"), alert["InformedEntities"][0]["RouteId"].alias("route"))


@query("SELECT s_suppkey AS site, -84 - s_suppkey/10000.0E0 AS lon, 38 + s_nationkey/100.0E0 AS lat FROM supplier WHERE s_suppkey % 5 <> 0")
def geojson_points(t):
    """Point features of documents that hold lines too."""
    path, k = scratch_path(t.spark, "features-"), F.col("s_suppkey")
    spot = F.array(-84 - k / 10000.0, 38 + F.col("s_nationkey") / 100.0)
    shape = F.when(k % 5 == 0, F.struct(F.lit("LineString").alias("type"), F.to_json(F.array(spot, spot)).alias("coordinates"))).otherwise(F.struct(F.lit("Point").alias("type"), F.to_json(spot).alias("coordinates")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit('},"properties":{"site":"'), k.cast("string"), F.lit('"}}'))
    docs = t.supplier.select((F.floor(k / 500)).alias("doc"), feature.alias("f")).groupBy("doc").agg(F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), F.array_join(F.collect_list("f"), ",\n"), F.lit("\n]}")).alias("value"))
    docs.write.partitionBy("doc").text(path)
    return S.read_geojson_points(t.spark, path).select(F.col("properties")["site"].cast("long").alias("site"), "lon", "lat")


@query("""SELECT event_id // 500 AS seed, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS step, value AS reward, event_type = 'purchase' AS terminated,
 count(*) OVER (PARTITION BY event_id // 500) AS steps FROM events""")
def episode_log(t):
    """Episodes logged as lines, one file each, read back with their steps numbered."""
    path = scratch_path(t.spark, "episodes-")
    ep = F.floor(F.col("event_id") / 500).alias("ep")
    steps = t.events.select(ep, F.col("event_id").alias("at"), F.to_json(F.struct(
        F.array(F.lit(0.5)).alias("action"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("terminated"), F.lit(False).alias("truncated"))).alias("value"))
    heads = t.events.groupBy(ep).agg(F.count(F.lit(1)).alias("n")).select(
        "ep", F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.struct(F.col("ep").alias("seed"), F.col("n").alias("steps")).alias("meta"))).alias("value"))
    lines = heads.unionByName(steps).repartition("ep").sortWithinPartitions("ep", "at")
    lines.select("ep", "value").write.partitionBy("ep").text(path)
    episodes, numbered = S.read_episode_log(t.spark, path)
    return numbered.join(episodes.select("episode", "seed", F.col("steps")), "episode").select("seed", "step", "reward", "terminated", "steps")
