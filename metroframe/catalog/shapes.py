"""Polygon measures, hulls, outlines, rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..functions import rings as R
from ..operators import polygons as V
from .clouds import square
from .joins import rings
from .lines import lines
from .registry import query, r


@query(with_views("boxes") + " SELECT box_id, round(4*half*half,4)+0.0 AS area, round(cx,4)+0.0 AS x, round(cz,4)+0.0 AS z, round(cx-half,6)+0.0 AS x0, round(cz+half,6)+0.0 AS z1 FROM fx_boxes")
def ring_measures(t):
    """Area, centroid and bounding box of rings."""
    ring = F.col("ring")
    cx, cz = R.ring_centroid(ring)
    x0, _, _, z1 = R.ring_bbox(ring)
    return rings(t).select("box_id", r(R.ring_area(ring), 4).alias("area"), r(cx, 4).alias("x"), r(cz, 4).alias("z"), r(x0).alias("x0"), r(z1).alias("z1"))


@query(with_views("boxes") + """, q AS (SELECT box_id, half, cx+half*1.3 AS px, cz+half*((box_id % 7)/3.0E0-1.03) AS pz, cx, cz FROM fx_boxes)
 SELECT box_id, false AS inside, round(sqrt(pow(abs(px-cx)-half,2)+pow(greatest(abs(pz-cz)-half,0),2)),6)+0.0 AS dist FROM q""")
def ring_distance(t):
    """Point in ring and distance to it."""
    half, ring = F.col("half"), F.col("ring")
    b = t.boxes.select("box_id", square().alias("ring"), (F.col("cx") + half * 1.3).alias("px"), (F.col("cz") + half * ((F.col("box_id") % 7) / 3.0 - 1.03)).alias("pz"))
    return b.select("box_id", R.point_in_ring(F.col("px"), F.col("pz"), ring).alias("inside"), r(R.ring_distance(F.col("px"), F.col("pz"), ring)).alias("dist"))


# a point is a corner where all others lie within less than half a turn
@query(with_views("points") + """, p AS (SELECT DISTINCT l_suppkey AS g, x, z FROM fx_points), a AS (SELECT p.g, p.x, p.z, atan2(q.z-p.z, q.x-p.x) AS t FROM p JOIN p q ON p.g = q.g AND (p.x <> q.x OR p.z <> q.z)),
 s AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY g, x, z ORDER BY t), min(t) OVER (PARTITION BY g, x, z) + 2*pi()) - t AS gap FROM a), h AS (SELECT g, x, z FROM s GROUP BY g, x, z HAVING max(gap) > pi() + 1e-9),
 c AS (SELECT *, avg(x) OVER (PARTITION BY g) AS mx, avg(z) OVER (PARTITION BY g) AS mz FROM h), o AS (SELECT *, atan2(z-mz, x-mx) AS t FROM c),
 n AS (SELECT g, x, z, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz FROM o WINDOW w AS (PARTITION BY g ORDER BY t))
 SELECT g AS l_suppkey, count(*) AS n, round(abs(sum(x*nz-nx*z))/2,4)+0.0 AS area FROM n GROUP BY g""")
def convex_hull(t):
    """Hull of each supplier's points."""
    h = V.convex_hull(t.points, ["l_suppkey"])
    return h.select("l_suppkey", F.size("ring").cast("long").alias("n"), r(R.ring_area(F.col("ring")), 4).alias("area"))


@query(with_views("points") + """, c AS (SELECT DISTINCT l_suppkey, CAST(floor(x/40) AS BIGINT) AS cx, CAST(floor(z/40) AS BIGINT) AS cz FROM fx_points), b AS (SELECT c.l_suppkey, count(*) AS n FROM c, (SELECT unnest([{'i':1,'j':0},{'i':-1,'j':0},{'i':0,'j':1},{'i':0,'j':-1}]) AS s)
 WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.l_suppkey = c.l_suppkey AND o.cx = c.cx+s.i AND o.cz = c.cz+s.j) GROUP BY c.l_suppkey) SELECT l_suppkey, cells, cells*1600.0E0 AS area, n*40.0E0 AS perimeter FROM (SELECT l_suppkey, count(*) AS cells FROM c GROUP BY l_suppkey) JOIN b USING (l_suppkey)""")
def concave_outline(t):
    """Occupied-cell outline of each supplier's points."""
    return V.concave_outline(t.points, ["l_suppkey"], 40.0).select("l_suppkey", "cells", "area", "perimeter")


@query()
def outline_or_polygon(t):
    """Measured hull inside a known polygon, or the polygon where the hull is too small."""
    hull = V.convex_hull(t.points.withColumn("key", F.col("l_suppkey")), ["key"])
    known = t.targets.select(F.col("target_id").alias("key"), F.col("x").alias("cx"), F.col("z").alias("cz"), F.lit(60.0).alias("half"))
    polys = known.select("key", square().alias("ring"))
    out = V.outline_or_polygon(hull, polys, "key")
    return out.select("key", r("area", 3).alias("area"), "source")


@query("WITH RECURSIVE" + with_views("roads")[4:] + """, v AS (SELECT road_id, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS i, x, z FROM fx_roads),
 c AS (SELECT a.road_id, a.i AS lo, b.i AS hi, m.i AS k, a.x AS ax, a.z AS az, b.x-a.x AS cx, b.z-a.z AS cz, m.x-a.x AS mx, m.z-a.z AS mz FROM v a JOIN v b ON b.road_id = a.road_id AND b.i > a.i + 1 JOIN v m ON m.road_id = a.road_id AND m.i > a.i AND m.i < b.i),
 t AS (SELECT *, CASE WHEN cx*cx+cz*cz = 0 THEN 0 ELSE least(greatest((mx*cx+mz*cz)/(cx*cx+cz*cz), 0), 1) END AS f FROM c),
 far AS (SELECT road_id, lo, hi, max(sqrt(pow(mx-f*cx,2)+pow(mz-f*cz,2))) AS d, arg_max(k, {'d': sqrt(pow(mx-f*cx,2)+pow(mz-f*cz,2)), 'k': -k}) AS k FROM t GROUP BY ALL),
 iv AS (SELECT road_id, min(i) AS lo, max(i) AS hi FROM v GROUP BY road_id UNION ALL SELECT iv.road_id, unnest([iv.lo, k]), unnest([k, iv.hi]) FROM iv JOIN far ON far.road_id = iv.road_id AND far.lo = iv.lo AND far.hi = iv.hi AND d > 5),
 n AS (SELECT road_id, count(*) AS before FROM v GROUP BY road_id) SELECT road_id, CAST(before AS INTEGER) AS before, CAST(least(before, 2 + (count(*)-1)/2) AS INTEGER) AS after FROM iv JOIN n USING (road_id) GROUP BY road_id, before""")
def simplify(t):
    """Douglas-Peucker at 5 m."""
    xz = F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))
    s = lines(t).select("road_id", F.size("pts").alias("before"), V.simplify(xz, 5.0).alias("p"))
    return s.select("road_id", "before", F.size("p").alias("after"))


@query("SELECT o_orderkey AS rel_id, count(*) AS rings FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderkey")
def assemble_rings(t):
    """One relation per order: two half rings close to one ring, a lone half (low priority) never does."""
    k = F.col("o_orderkey")
    a, b = F.array(k * 4, k * 4 + 1, k * 4 + 2), F.array(k * 4, k * 4 + 3, k * 4 + 2)
    part = F.when(F.col("o_orderpriority") == "5-LOW", F.array(a)).otherwise(F.array(a, b))
    m = t.orders.select(k.alias("rel_id"), F.posexplode(part).alias("pos", "nodes"))
    return V.assemble_rings(m).groupBy("rel_id").agg(F.count(F.lit(1)).alias("rings"))


@query(with_views("boxes") + " SELECT name, arg_max(box_id, {'h': half, 'i': -box_id}) AS part, round(4*max(half)*max(half),4)+0.0 AS area FROM fx_boxes GROUP BY name")
def largest_part(t):
    """Largest of the rings that share a name."""
    parts = t.boxes.select("name", F.col("box_id").alias("part"), F.array(*[F.struct((i * F.col("half")).alias("x"), (j * F.col("half")).alias("z")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]).alias("ring"))
    return V.largest_part(parts, "name").select("name", "part", r("area", 4).alias("area"))


@query(with_views("boxes") + """, b AS (SELECT box_id, CAST(floor((cx-half)/16) AS BIGINT) AS a, CAST(floor((cx+half)/16) AS BIGINT) AS b, CAST(floor((cz-half)/16) AS BIGINT) AS c, CAST(floor((cz+half)/16) AS BIGINT) AS d FROM fx_boxes),
 x AS (SELECT box_id, unnest(range(a, b+1)) AS cx, c, d FROM b) SELECT box_id, cx, unnest(range(c, d+1)) AS cz FROM x""")
def ring_cells(t):
    return V.ring_cells(rings(t), 16.0).select("box_id", "cx", "cz")
