"""Point clouds: grids, heights, statistics, samples, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import clustering as G
from ..operators import lookups as L
from ..operators import rasters as R
from ..plans.select import exact_percentile
from .registry import query, r

SPEC = {"cell": 8.0, "x0": 0.0, "z0": 0.0, "nx": 126, "nz": 126}
SMALL = {"cell": 40.0, "x0": 100.0, "z0": 100.0, "nx": 20, "nz": 20}


def square(cx: str = "cx", cz: str = "cz", half: str = "half"):
    """Ring of an axis-parallel square."""
    c = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(*[F.struct((F.col(cx) + i * F.col(half)).alias("x"), (F.col(cz) + j * F.col(half)).alias("z")) for i, j in c])


_GRID = """, grid AS (
  SELECT greatest(least(CAST(trunc(x/8) AS BIGINT),125),0) AS ix, greatest(least(CAST(trunc(z/8) AS BIGINT),125),0) AS iz, min(y) AS y
  FROM fx_points WHERE cls = 2 GROUP BY ALL)"""

_FILL = """, ask AS (SELECT box_id, CAST(trunc(cx/8) AS BIGINT) AS ix, CAST(trunc(cz/8) AS BIGINT) AS iz FROM fx_boxes),
ring AS (SELECT a.box_id, greatest(abs(g.ix-a.ix), abs(g.iz-a.iz)) AS rr, g.y FROM ask a JOIN grid g
  ON g.ix BETWEEN a.ix-5 AND a.ix+5 AND g.iz BETWEEN a.iz-5 AND a.iz+5
  WHERE a.ix BETWEEN 0 AND 125 AND a.iz BETWEEN 0 AND 125),
near AS (SELECT box_id, min(rr) AS rr FROM ring GROUP BY box_id),
fill AS (SELECT n.box_id, quantile_cont(y, 0.5) AS ground_y FROM near n JOIN ring USING (box_id, rr) GROUP BY n.box_id)"""


@query(with_views("points") + _GRID + " SELECT ix, iz, y FROM grid")
def ground_grid(t):
    """Lowest ground return per 8 m cell."""
    return R.ground_grid(t.points, SPEC)


@query(with_views("points") + _GRID + " SELECT count(*) AS filled, CAST(15876 AS BIGINT) AS total, min(y) AS elev_min, max(y) AS elev_max FROM grid")
def ground_grid_stats(t):
    return R.grid_stats(R.ground_grid(t.points, SPEC), SPEC)


_TRUNC = "CAST(trunc((x-100)/40) AS BIGINT) AS ix, CAST(trunc((z-100)/40) AS BIGINT) AS iz"


@query(with_views("points") + f", c AS (SELECT {_TRUNC}, y FROM fx_points) SELECT ix, iz, round(avg(y),6)+0.0 AS y FROM c "
       "WHERE ix BETWEEN 0 AND 19 AND iz BETWEEN 0 AND 19 GROUP BY ALL")
def mean_heightmap(t):
    return R.mean_heightmap(t.points, SMALL).withColumn("y", r("y"))


@query(with_views("points") + f", c AS (SELECT {_TRUNC}, y FROM fx_points) SELECT ix, iz, max(y) AS y FROM c "
       "WHERE ix BETWEEN 0 AND 19 AND iz BETWEEN 0 AND 19 GROUP BY ALL")
def max_heightmap(t):
    return R.max_heightmap(t.points, SMALL)


@query(with_views("points") + """, e AS (SELECT min(x) AS x0, min(z) AS z0, greatest(max(x)-min(x), max(z)-min(z)) AS span FROM fx_points),
p AS (SELECT greatest(least(CAST(trunc((x-x0)/span*64) AS BIGINT),63),0) AS col,
  63 - greatest(least(CAST(trunc((z-z0)/span*64) AS BIGINT),63),0) AS row, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b
  FROM fx_points, e) SELECT col, row, CAST(trunc(avg(r)) AS INTEGER) AS r, CAST(trunc(avg(g)) AS INTEGER) AS g, CAST(trunc(avg(b)) AS INTEGER) AS b FROM p GROUP BY ALL""")
def topdown_raster(t):
    rgb = t.points.select("x", "z", (F.col("l_orderkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b"))
    return R.topdown_raster(rgb, 64)


_ROOF = with_views("points", "boxes") + _GRID + _FILL + """,
hit AS (SELECT b.box_id, p.y FROM fx_boxes b JOIN (SELECT x, z, y FROM fx_points WHERE cls IN (1,6)) p
  ON p.x BETWEEN b.cx-b.half-2.03 AND b.cx+b.half+2.03 AND p.z BETWEEN b.cz-b.half-2.03 AND b.cz+b.half+2.03
  WHERE greatest(abs(p.x-b.cx)-b.half, 0.0)*greatest(abs(p.x-b.cx)-b.half, 0.0)
      + greatest(abs(p.z-b.cz)-b.half, 0.0)*greatest(abs(p.z-b.cz)-b.half, 0.0) <= 4.1209),
agg AS (SELECT box_id, count(*) AS n, quantile_cont(y, 0.85) AS roof, quantile_cont(y, 0.03) AS low FROM hit GROUP BY box_id),
res AS (SELECT b.box_id, coalesce(n, 0) AS n, ground_y,
  CASE WHEN n >= 5 THEN roof - coalesce(ground_y, low - 1) ELSE coalesce(tag_h, 7.0) END AS h
  FROM fx_boxes b LEFT JOIN agg USING (box_id) LEFT JOIN fill USING (box_id))"""


def roofs(t):
    foot = t.boxes.select("box_id", square().alias("ring"), "tag_h")
    points = t.points.where(F.col("cls").isin(1, 6))
    return A.roof_height(points, foot, R.ground_grid(t.points, SPEC), SPEC, buffer=2.03)


@query(_ROOF + """ SELECT box_id, round(least(greatest(h, 3.0), 200.0), 6)+0.0 AS height_m, CAST(n AS BIGINT) AS point_count,
  CASE WHEN n >= 5 THEN 'osm+lidar' ELSE 'osm' END AS provenance, ground_y FROM res""")
def roof_height(t):
    """Building heights: 85th percentile of the returns in a footprint less the ground under it."""
    return roofs(t).withColumn("height_m", r("height_m"))


@query(_ROOF + " SELECT CASE WHEN n >= 5 THEN 'osm+lidar' ELSE 'osm' END AS provenance, count(*) AS buildings FROM res GROUP BY ALL")
def provenance_counts(t):
    return A.provenance_counts(roofs(t))


@query(with_views("points") + """ SELECT l_suppkey,
  CASE WHEN quantile_cont(y,0.98) <= quantile_cont(y,0.02) THEN min(y) ELSE round(quantile_cont(y,0.02),6)+0.0 END AS lo,
  CASE WHEN quantile_cont(y,0.98) <= quantile_cont(y,0.02) THEN max(y) ELSE round(quantile_cont(y,0.98),6)+0.0 END AS hi FROM fx_points GROUP BY ALL""")
def robust_range(t):
    out = A.robust_range(t.points, ["l_suppkey"])
    return out.withColumn("lo", r("lo")).withColumn("hi", r("hi"))


@query(with_views("points") + " SELECT cls, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM fx_points GROUP BY cls")
def bounds(t):
    return A.bounds(t.points, ["cls"])


@query(with_views("points") + " SELECT cls, count(*) AS n FROM fx_points GROUP BY cls")
def class_histogram(t):
    return A.class_histogram(t.points)


@query(with_views("points") + """, c AS (SELECT 'x' AS channel, x AS v FROM fx_points UNION ALL SELECT 'y', y FROM fx_points)
 SELECT channel, round(avg(v),6)+0.0 AS mean, round(quantile_cont(v,0.01),6)+0.0 AS p1, round(quantile_cont(v,0.25),6)+0.0 AS p25,
 round(quantile_cont(v,0.5),6)+0.0 AS p50, round(quantile_cont(v,0.75),6)+0.0 AS p75, round(quantile_cont(v,0.99),6)+0.0 AS p99 FROM c GROUP BY channel""")
def channel_stats(t):
    out = A.channel_stats(t.points, ["x", "y"])
    return out.select("channel", *[r(c).alias(c) for c in ("mean", "p1", "p25", "p50", "p75", "p99")])


@query(with_views("points") + " SELECT l_partkey, round(quantile_cont(x, 0.37),6)+0.0 AS q, count(*) AS n FROM fx_points GROUP BY l_partkey")
def exact_percentiles(t):
    return exact_percentile(t.points, ["l_partkey"], "x", {"q": 0.37}).select("l_partkey", r("q").alias("q"), F.col("_n").alias("n"))


@query(with_views("points") + " SELECT l_suppkey, round(avg(x),6)+0.0 AS x, round(avg(z),6)+0.0 AS z FROM fx_points GROUP BY ALL")
def centroid(t):
    return A.centroid(t.points, ["l_suppkey"]).select("l_suppkey", r("x").alias("x"), r("z").alias("z"))


@query(with_views("points") + """ SELECT 'points' AS layer, count(*) AS rows, CAST(sum(y) AS DOUBLE) AS total FROM fx_points
 UNION ALL SELECT 'parts', count(*), CAST(sum(p_size) AS DOUBLE) FROM part UNION ALL SELECT 'suppliers', count(*), NULL FROM supplier""")
def layer_stats(t):
    return A.layer_stats({"points": t.points, "parts": t.part, "suppliers": t.supplier}, {"points": "y", "parts": "p_size"})


# ---- raster lookups --------------------------------------------------------------
@query(with_views("points", "sites") + _GRID + """ SELECT s.site_id, coalesce(g.y, 281.0) AS ground_y FROM fx_sites s
 LEFT JOIN grid g ON g.ix = CAST(trunc((s.x)/8) AS BIGINT) AND g.iz = CAST(trunc((s.z)/8) AS BIGINT)""")
def grid_lookup(t):
    return L.grid_lookup(t.sites, R.ground_grid(t.points, SPEC), SPEC, 281.0).select("site_id", "ground_y")


@query(with_views("points", "sites") + _GRID + """ SELECT s.site_id, coalesce(g.y, 281.0) AS ground_y FROM fx_sites s
 LEFT JOIN grid g ON g.ix = greatest(least(CAST(trunc((s.x-300)/8) AS BIGINT),125),0) AND g.iz = greatest(least(CAST(trunc((s.z+200)/8) AS BIGINT),125),0)""")
def grid_lookup_clamped(t):
    moved = t.sites.select("site_id", (F.col("x") - 300).alias("x"), (F.col("z") + 200).alias("z"))
    return L.grid_lookup(moved, R.ground_grid(t.points, SPEC), SPEC, 281.0, edge="clamp").select("site_id", "ground_y")


@query(with_views("points", "boxes") + _GRID + _FILL + " SELECT box_id, ground_y FROM fx_boxes LEFT JOIN fill USING (box_id)")
def grid_nearest_fill(t):
    at = t.boxes.select("box_id", F.col("cx").alias("x"), F.col("cz").alias("z"))
    return L.grid_nearest_fill(at, R.ground_grid(t.points, SPEC), SPEC).select("box_id", "ground_y")


NODES = {"cols": 21, "rows": 21, "x0": 0.0, "z0": 0.0, "cell": 50.0}
_NODE_SQL = """, node AS (SELECT CAST(floor(x/50+0.5) AS BIGINT) AS i, CAST(floor(z/50+0.5) AS BIGINT) AS j, avg(c_acctbal) AS v FROM fx_sites
  WHERE c_acctbal < 4000 GROUP BY ALL)"""


def _nodes(t):
    s = t.sites.where("c_acctbal < 4000")
    return s.groupBy(F.floor(F.col("x") / 50 + 0.5).alias("i"), F.floor(F.col("z") / 50 + 0.5).alias("j")).agg(F.avg("c_acctbal").alias("v"))


@query(with_views("sites", "targets") + _NODE_SQL + """,
q AS (SELECT target_id, greatest(least(CAST(floor(x/50) AS BIGINT),19),0) AS i0, greatest(least(CAST(floor(z/50) AS BIGINT),19),0) AS j0, x, z FROM fx_targets),
w AS (SELECT target_id, least(greatest(x/50-i0,0.0),1.0) AS tx, least(greatest(z/50-j0,0.0),1.0) AS tz, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM q
 LEFT JOIN node a ON a.i=i0 AND a.j=j0 LEFT JOIN node b ON b.i=i0+1 AND b.j=j0 LEFT JOIN node c ON c.i=i0 AND c.j=j0+1 LEFT JOIN node d ON d.i=i0+1 AND d.j=j0+1),
m AS (SELECT *, list_avg(list_filter([a,b,c,d], lambda e: e IS NOT NULL)) AS f FROM w)
SELECT target_id, f IS NOT NULL AS ready, round(coalesce((coalesce(a,f)*(1-tx)+coalesce(b,f)*tx)*(1-tz)+(coalesce(c,f)*(1-tx)+coalesce(d,f)*tx)*tz, 0.0),6)+0.0 AS v FROM m""")
def bilinear_sample(t):
    return L.bilinear_sample(t.targets, _nodes(t), NODES).select("target_id", "ready", r("v").alias("v"))


def _crossing(boxes="fx_boxes", verts="fx_roads"):
    return f"""SELECT DISTINCT box_id FROM (SELECT box_id, road_id,
    bool_or(v.x < ((b.cx-b.half)+(b.cx+b.half))/2) AND bool_or(v.x > ((b.cx-b.half)+(b.cx+b.half))/2) AS ew, bool_or(v.z < ((b.cz-b.half)+(b.cz+b.half))/2) AND bool_or(v.z > ((b.cz-b.half)+(b.cz+b.half))/2) AS ns
    FROM {boxes} b JOIN {verts} v ON v.x BETWEEN b.cx-b.half AND b.cx+b.half AND v.z BETWEEN b.cz-b.half AND b.cz+b.half
    GROUP BY ALL) WHERE ew OR ns"""


def _boxes(t):
    return t.boxes.select(
        "box_id", (F.col("cx") - F.col("half")).alias("x0"), (F.col("cx") + F.col("half")).alias("x1"),
        (F.col("cz") - F.col("half")).alias("z0"), (F.col("cz") + F.col("half")).alias("z1"),
        (F.lit(248.0) + (F.col("box_id") % 40) * 0.5).alias("base_y"),
    )


_GROUNDED = with_views("points", "boxes", "roads") + _GRID + f""", k AS (SELECT unnest([0,1,2,3]) AS k),
s AS (SELECT box_id, 248 + (box_id % 40)*0.5 AS base_y, (cx-half) + ((cx+half)-(cx-half))*i.k/3 AS x, (cz-half) + ((cz+half)-(cz-half))*j.k/3 AS z FROM fx_boxes, k i, k j),
g AS (SELECT box_id, base_y, quantile_cont(coalesce(y, 250.0), 0.15) AS ground_y FROM s LEFT JOIN grid
  ON ix = greatest(least(CAST(trunc(x/8) AS BIGINT),125),0) AND iz = greatest(least(CAST(trunc(z/8) AS BIGINT),125),0) GROUP BY ALL),
crossed AS ({_crossing()}),
res AS (SELECT g.box_id, ground_y, base_y - ground_y AS float_h, base_y - ground_y > 2.5 AND c.box_id IS NOT NULL AS bridge FROM g LEFT JOIN crossed c USING (box_id))"""


def _grounded(t):
    grid = R.ground_grid(t.points, SPEC)
    return A.footprint_ground(_boxes(t), lambda d: L.grid_lookup(d, grid, SPEC, 250.0, edge="clamp", out="v"), t.roads)


@query(_GROUNDED + " SELECT box_id, round(ground_y,6)+0.0 AS ground_y, round(float_h,6)+0.0 AS float_h, bridge FROM res")
def footprint_ground(t):
    return _grounded(t).select("box_id", r("ground_y").alias("ground_y"), r("float_h").alias("float_h"), "bridge")


@query(_GROUNDED + """ SELECT count(*) FILTER (NOT bridge AND float_h > 0) AS dropped, count(*) FILTER (NOT bridge AND float_h < 0) AS raised,
 count(*) FILTER (bridge) AS bridges, round(max(abs(float_h)) FILTER (NOT bridge),6)+0.0 AS max_move,
 round(quantile_cont(abs(float_h), 0.5) FILTER (NOT bridge),6)+0.0 AS median_move FROM res""")
def grounding_counts(t):
    out = A.grounding_counts(_grounded(t))
    return out.withColumn("max_move", r("max_move")).withColumn("median_move", r("median_move"))


# ---- sampling, chunks -------------------------------------------------------------
def _chunks_sql(limit: int) -> str:
    """Manifest of the first grid whose fullest cell holds at most ``limit`` points, else of the last."""
    grids = ((8, 8), (8, 16), (16, 16), (16, 32))
    cell = "greatest(least(CAST(trunc(z/1001*{nz}) AS BIGINT),{nz}-1),0)*{nx} + greatest(least(CAST(trunc(x/1001*{nx}) AS BIGINT),{nx}-1),0)"
    cells = ", ".join(f"{cell.format(nx=nx, nz=nz)} AS c{k}" for k, (nx, nz) in enumerate(grids))
    fullest = ", ".join(f"(SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY c{k})) AS m{k}" for k in range(4))
    pick = "CASE " + " ".join(f"WHEN m{k} <= {limit} THEN {k}" for k in range(3)) + " ELSE 3 END"
    chunk, name = ("CASE g " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(of)) + " END" for of in (["c0", "c1", "c2", "c3"], [f"'{nx}x{nz}'" for nx, nz in grids]))
    return with_views("points") + f""", c AS (SELECT {cells}, x, y, z FROM fx_points), f AS (SELECT {fullest}), p AS (SELECT {pick} AS g FROM f), q AS (SELECT {chunk} AS chunk, {name} AS grid, x, y, z FROM c, p)
 SELECT chunk, grid, count(*) AS count, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y FROM q GROUP BY chunk, grid"""


def _chunked(t, limit: int):
    chunks = R.grid_chunk(t.points, (0.0, 0.0, 1001.0, 1001.0), limit)
    return R.chunk_manifest(chunks.withColumn("cell", F.struct("chunk", "grid")), "cell").select("cell.*", "*").drop("cell")


@query(_chunks_sql(1_000_000))
def grid_chunk(t):
    """Chunks of the grid that holds a million points per cell."""
    return _chunked(t, 1_000_000)


@query(_chunks_sql(110))
def grid_chunk_small(t):
    """Chunks of a low limit, so that a finer grid is chosen."""
    return _chunked(t, 110)


@query(_chunks_sql(1))
def grid_chunk_finest(t):
    """No grid meets the limit: the finest one stays."""
    return _chunked(t, 1)


@query()
def hash_ranked_sample(t):
    """At most 40 points per supplier tile, the same whatever the partitioning."""
    return R.hash_ranked_sample(t.points, ["l_suppkey"], 40, 7, ["pid", "l_partkey", "l_suppkey", "x", "z", "y"])


@query(with_views("points") + " SELECT l_suppkey, least(count(*), 40) AS n FROM fx_points GROUP BY ALL")
def hash_ranked_sample_sizes(t):
    return R.hash_ranked_sample(t.points, ["l_suppkey"], 40, 7, ["pid", "l_partkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query()
def bernoulli_sample(t):
    return R.bernoulli_sample(t.points, 0.25, 11, ["pid", "l_partkey", "l_suppkey"]).select("pid", "x", "z", "y")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey FROM n WHERE (rn-1) % greatest(CAST(ceil(n/1000.0E0) AS BIGINT), 1) = 0""")
def stride_decimate(t):
    from ..plans.ordered import block_of

    return R.stride_decimate(t.orders.select("o_orderkey"), 1000, ["o_orderkey"], block_of("o_orderkey", 4096))


@query(with_views("points") + """ SELECT l_partkey, pid, y, CAST(rank AS INTEGER) AS rank FROM (SELECT l_partkey, pid, y, row_number() OVER (PARTITION BY l_partkey ORDER BY y DESC, pid, l_suppkey, x) AS rank FROM fx_points) WHERE rank <= 4""")
def rank_in_group(t):
    from ..operators.sets import rank_in_group as top

    return top(t.points, ["l_partkey"], [F.desc("y"), "pid", "l_suppkey", "x"], 4).select("l_partkey", "pid", "y", "rank")


# ---- colours ------------------------------------------------------------------------
_RAMP = "[[38,70,120],[54,110,90],[96,150,70],[176,190,90],[206,180,120],[180,140,100],[200,190,175],[245,245,245]]"


@query(with_views("points") + f""", h AS (SELECT pid, x, z, l_partkey, l_suppkey, least(greatest((y-235.0)/80.0, 0.0), 1.0)*7 AS t FROM fx_points),
 i AS (SELECT *, least(CAST(floor(t) AS INTEGER), 6) AS i, {_RAMP} AS ramp FROM h)
 SELECT pid, l_partkey, l_suppkey, x, z, CAST(trunc(ramp[i+1][1]*(1-(t-i)) + ramp[i+2][1]*(t-i)) AS INTEGER) AS r,
 CAST(trunc(ramp[i+1][2]*(1-(t-i)) + ramp[i+2][2]*(t-i)) AS INTEGER) AS g, CAST(trunc(ramp[i+1][3]*(1-(t-i)) + ramp[i+2][3]*(t-i)) AS INTEGER) AS b FROM i""")
def hypsometric_rgb(t):
    red, green, blue = S.hypsometric_rgb(F.col("y"))
    return t.points.select("pid", "l_partkey", "l_suppkey", "x", "z", red.alias("r"), green.alias("g"), blue.alias("b"))


@query(with_views("boxes") + """, e AS (SELECT min(half) AS lo, max(half) AS hi FROM fx_boxes)
 SELECT box_id, round((half-lo)/CASE WHEN hi = lo THEN 1 ELSE hi-lo END, 6)+0.0 AS ratio FROM fx_boxes, e""")
def height_ratio(t):
    return S.height_ratio(t.boxes, "half").select("box_id", r("ratio").alias("ratio"))


# ---- clustering -----------------------------------------------------------------------
_LINK = """, e AS (SELECT a.i AS a, b.i AS b FROM core a JOIN core b ON b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cz BETWEEN a.cz-1 AND a.cz+1
   AND (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) <= RR),
 reach AS (SELECT i AS a, i AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
 comp AS (SELECT a AS i, min(b) AS rep FROM reach GROUP BY a)"""

_DB_SQL = with_views("points").replace("WITH ", "WITH RECURSIVE ", 1) + """,
 p AS (SELECT x, z, min(pid) AS id0, count(*) AS w, floor(x/5) AS cx, floor(z/5) AS cz, row_number() OVER (ORDER BY x, z) AS i FROM fx_points WHERE cls = 6 GROUP BY x, z),
 n AS (SELECT a.i, sum(b.w) AS n FROM p a JOIN p b ON b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cz BETWEEN a.cz-1 AND a.cz+1
   AND (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) <= 25 GROUP BY a.i),
 core AS (SELECT p.* FROM p JOIN n USING (i) WHERE n >= 4)""" + _LINK.replace("RR", "25") + """,
 lab AS (SELECT rep, min(id0) AS cluster FROM comp JOIN core USING (i) GROUP BY rep),
 cc AS (SELECT core.*, lab.cluster FROM core JOIN comp USING (i) JOIN lab USING (rep)),
 bord AS (SELECT p.i, min(cc.cluster) AS cluster FROM p JOIN cc ON cc.cx BETWEEN p.cx-1 AND p.cx+1 AND cc.cz BETWEEN p.cz-1 AND p.cz+1
   AND (cc.x-p.x)*(cc.x-p.x)+(cc.z-p.z)*(cc.z-p.z) <= 25 WHERE p.i NOT IN (SELECT i FROM core) GROUP BY p.i),
 res AS (SELECT p.x, p.z, coalesce(cc.cluster, bord.cluster) AS cluster, CASE WHEN cc.i IS NOT NULL THEN 'core' WHEN bord.i IS NOT NULL THEN 'border' ELSE 'noise' END AS kind
  FROM p LEFT JOIN cc USING (i) LEFT JOIN bord USING (i))"""


@query(_DB_SQL + " SELECT f.pid, f.x, f.z, res.cluster, res.kind FROM fx_points f JOIN res ON res.x = f.x AND res.z = f.z WHERE f.cls = 6")
def dbscan(t):
    """Density clusters of building returns within 5 m."""
    return G.dbscan(t.points.where("cls = 6").select("pid", "x", "z"), 5.0, 4, "pid")


@query(with_views("roads").replace("WITH ", "WITH RECURSIVE ", 1) + """,
 core AS (SELECT x, z, min(o_orderkey) AS id0, floor(x/3) AS cx, floor(z/3) AS cz, row_number() OVER (ORDER BY x, z) AS i FROM fx_roads GROUP BY x, z)"""
       + _LINK.replace("RR", "9") + """, lab AS (SELECT rep, min(id0) AS cluster FROM comp JOIN core USING (i) GROUP BY rep)
 SELECT f.o_orderkey, lab.cluster FROM fx_roads f JOIN core c ON c.x = f.x AND c.z = f.z JOIN comp USING (i) JOIN lab USING (rep)""")
def cluster_within(t):
    """Single-link groups of junction candidates within 3 m."""
    return G.cluster_within(t.roads.select("o_orderkey", "x", "z"), 3.0, "o_orderkey")
