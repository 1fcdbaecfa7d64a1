"""Spatial and snapshot joins."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..fixtures import with_views
from ..operators import aggregates as A
from ..operators import lookups as L
from ..operators import polygons as V
from ..operators import spatial as D
from ..plans.ordered import block_of
from ..session import materialize
from .clouds import square
from .registry import query, r, r_many

_INSIDE = "p.x BETWEEN b.cx-b.half AND b.cx+b.half AND p.z BETWEEN b.cz-b.half AND b.cz+b.half"


def lots(t):
    """Squares around the sites."""
    return t.sites.select(F.col("site_id").alias("box_id"), F.col("x").alias("cx"), F.col("z").alias("cz"), (F.lit(3.0) + F.col("c_nationkey") * 0.25).alias("half"))


def rings(t):
    return t.boxes.select("box_id", square().alias("ring"))


@query(with_views("points", "boxes") + f" SELECT p.pid, p.x, p.z, p.y, b.box_id FROM fx_points p JOIN fx_boxes b ON {_INSIDE} WHERE p.cls = 6")
def points_in_polygons(t):
    """Every building point with every footprint that holds it."""
    return D.points_in_polygons(t.points.where("cls = 6").select("pid", "x", "z", "y"), rings(t))


@query(with_views("points", "boxes") + f" SELECT p.x, p.z, min(b.box_id) AS box_id FROM fx_points p JOIN fx_boxes b ON {_INSIDE} GROUP BY p.x, p.z")
def points_in_polygons_first(t):
    """Lowest footprint of each distinct place."""
    places = t.points.select("x", "z").distinct().withColumn("place", F.struct("x", "z"))
    return D.points_in_polygons(places, rings(t), mode="first", order="box_id", point_id="place").select("x", "z", "box_id")


_PAIR = """, lots AS (SELECT site_id AS box_id, x AS cx, z AS cz, 3 + c_nationkey*0.25E0 AS half FROM fx_sites), q AS (SELECT a.box_id AS a, b.box_id AS b, least(a.cx+a.half, b.cx+b.half)-greatest(a.cx-a.half, b.cx-b.half) AS ox,
  least(a.cz+a.half, b.cz+b.half)-greatest(a.cz-a.half, b.cz-b.half) AS oz, a.cx AS acx, a.cz AS acz, b.cx AS bcx, b.cz AS bcz, a.half AS ah, b.half AS bh
  FROM fx_boxes a JOIN lots b ON a.cx-a.half <= b.cx+b.half AND a.cx+a.half >= b.cx-b.half AND a.cz-a.half <= b.cz+b.half AND a.cz+a.half >= b.cz-b.half)"""


@query(with_views("boxes", "sites") + _PAIR + """, o AS (SELECT a, b, greatest(ox,0)*greatest(oz,0) AS area, 4*ah*ah AS pa, 4*bh*bh AS pb FROM q)
 SELECT a AS a_id, b AS b_id, round(area,4)+0.0 AS area, round(area/(pa+pb-area),6)+0.0 AS iou FROM o WHERE area > 0 AND area >= 0.1037*least(pa,pb)""")
def polygon_overlap(t):
    """Footprint pairs sharing a tenth of the smaller one, with IoU."""
    a = rings(t).select(F.col("box_id").alias("a_id"), F.col("ring").alias("a_ring"))
    b = lots(t).select(F.col("box_id").alias("b_id"), square().alias("b_ring"))
    return V.polygon_overlap(a, b, 0.1037).select("a_id", "b_id", r_many("area", 4).alias("area"), r_many("iou").alias("iou"))


@query()
def overlap_fraction_with_union(t):
    """Share of each footprint under the union of all lots (no double count)."""
    a = rings(t).select(F.col("box_id").alias("a_id"), F.col("ring").alias("a_ring"))
    b = lots(t).select(square().alias("b_ring"))
    return V.overlap_fraction_with_union(a, b).withColumn("frac", r("frac"))


def _aabb(df, p: str, wide):
    c = F.col
    return df.select(
        c("box_id").alias(f"{p}_id"), (c("cx") - wide).alias(f"{p}_x0"), (c("cx") + wide).alias(f"{p}_x1"),
        F.lit(0.0).alias(f"{p}_y0"), (c("half") - 1).alias(f"{p}_y1"), (c("cz") - c("half")).alias(f"{p}_z0"), (c("cz") + c("half")).alias(f"{p}_z1"),
    )


@query(with_views("boxes", "sites") + _PAIR + """ SELECT a AS a_id, b AS b_id, CASE WHEN ox < oz THEN CASE WHEN acx >= bcx THEN 1.0E0 ELSE -1.0E0 END ELSE 0.0E0 END AS nx,
 CASE WHEN ox < oz THEN 0.0E0 ELSE CASE WHEN acz >= bcz THEN 1.0E0 ELSE -1.0E0 END END AS nz, round(least(ox,oz),6)+0.0 AS pen FROM q WHERE ox > 0 AND oz > 0""")
def aabb_overlap(t):
    """Overlapping box pairs with the push-out normal, along z where both overlaps are equal."""
    half = F.col("half")
    a, b = _aabb(t.boxes, "a", half), _aabb(lots(t), "b", half)
    return D.aabb_overlap(a, b).withColumn("pen", r_many("pen"))


def bodies(t):
    """Cars at 2 m x 1 m half extents, one frame per 200 events."""
    return t.poses.select(
        F.floor(F.col("event_id") / 200).cast("long").alias("frame"), F.col("event_id").alias("id"), "x", "z", "yaw",
        F.lit(2.25).alias("hx"), F.lit(0.95).alias("hz"),
    )


_SAT = """, b AS (SELECT CAST(floor(event_id/200) AS BIGINT) AS frame, event_id AS id, x, z, cos(yaw) AS c, sin(yaw) AS s FROM fx_poses),
p AS (SELECT a.frame, a.id AS a_id, b.id AS b_id, a.x-b.x AS dx, a.z-b.z AS dz, a.c AS ac, a.s AS asn, b.c AS bc, b.s AS bs FROM b a JOIN b ON a.frame = b.frame AND a.id < b.id AND abs(a.x-b.x) < 5 AND abs(a.z-b.z) < 5),
ax AS (SELECT *, unnest([{'i':0,'ux':ac,'uz':-asn},{'i':1,'ux':asn,'uz':ac},{'i':2,'ux':bc,'uz':-bs},{'i':3,'ux':bs,'uz':bc}]) AS u FROM p),
ov AS (SELECT *, dx*u.ux+dz*u.uz AS al, abs(2.25*(ac*u.ux-asn*u.uz))+abs(0.95*(asn*u.ux+ac*u.uz))+abs(2.25*(bc*u.ux-bs*u.uz))+abs(0.95*(bs*u.ux+bc*u.uz)) AS rr FROM ax),
best AS (SELECT frame, a_id, b_id, min(rr-abs(al)) AS pen, arg_min({'x': u.ux*CASE WHEN al>=0 THEN 1 ELSE -1 END, 'z': u.uz*CASE WHEN al>=0 THEN 1 ELSE -1 END}, rr-abs(al)) AS n FROM ov GROUP BY ALL)"""


@query(with_views("poses") + _SAT + " SELECT frame, a_id, b_id, round(n.x,5)+0.0 AS nx, round(n.z,5)+0.0 AS nz, round(pen,6)+0.0 AS pen FROM best WHERE pen > 0")
def obb_overlap(t):
    """Overlapping oriented bodies per frame with their minimum translation."""
    b = bodies(t)

    def side(p):
        return b.select("frame", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "z", "yaw", "hx", "hz")])

    out = D.obb_overlap(side("a"), side("b"), on=["frame"]).where("a_id < b_id")
    return out.select("frame", "a_id", "b_id", r("nx", 5).alias("nx"), r("nz", 5).alias("nz"), r("pen").alias("pen"))


@query(with_views("poses") + _SAT + " SELECT frame, count(*) AS overlaps, round(max(pen),6)+0.0 AS pen FROM best WHERE pen > 0 GROUP BY frame")
def max_penetration(t):
    return A.max_penetration(bodies(t), "id", ["frame"]).select("frame", "overlaps", r("pen").alias("pen"))


@query(with_views("poses") + """, b AS (SELECT CAST(floor(event_id/200) AS BIGINT) AS frame, event_id AS id, x, z FROM fx_poses)
 SELECT a.frame, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z))),6)+0.0 AS min_gap FROM b a JOIN b ON a.frame = b.frame AND a.id < b.id GROUP BY a.frame""")
def min_gap(t):
    return A.min_gap(bodies(t), "id", ["frame"]).withColumn("min_gap", r("min_gap"))


# ---- nearest -----------------------------------------------------------------------
_NEAR = """, n AS (SELECT s.site_id, arg_min(t.target_id, {'d': (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z), 'i': t.target_id}) AS nearest_id,
 sqrt(min((s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z))) AS dist FROM fx_sites s, fx_targets t COND GROUP BY s.site_id)"""


def _near(cond: str = "") -> str:
    return with_views("sites", "targets") + _NEAR.replace("COND", cond)


@query(_near() + " SELECT site_id, nearest_id, round(dist,6)+0.0 AS dist FROM n")
def nearest_join(t):
    """Nearest target of each site."""
    return D.nearest_join(t.sites, t.targets, "site_id", "target_id").select("site_id", "nearest_id", r("dist").alias("dist"))


@query(_near("WHERE (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z) > 400 AND (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z) < 2500")
       + " SELECT s.site_id, nearest_id, round(dist,6)+0.0 AS dist FROM fx_sites s LEFT JOIN n USING (site_id)")
def nearest_join_ring(t):
    """Nearest target more than 20 m and less than 50 m away, if any."""
    out = D.nearest_join(t.sites, t.targets, "site_id", "target_id", max_dist=50.0, min_dist=20.0)
    return out.select("site_id", "nearest_id", r("dist").alias("dist"))


@query(_near() + " SELECT count(*) AS cameras, count(*) FILTER (dist <= 75) AS matched, list_sort(list(round(dist,6)+0.0))[CAST(floor(count(*)/2) AS BIGINT)+1] AS median, list_sort(list(round(dist,6)+0.0))[least(count(*)-1, CAST(floor(count(*)*0.9) AS BIGINT))+1] AS p90, max(round(dist,6)+0.0) AS max FROM n")
def snap_report(t):
    """How far cameras snap to their junction."""
    near = D.nearest_join(t.sites, t.targets, "site_id", "target_id").withColumn("dist", r("dist"))
    return A.snap_report(near)


@query(_near("WHERE (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z) < 2025") + " SELECT site_id FROM n")
def within_distance(t):
    """Sites with a target nearer than 45 m."""
    return D.within_distance(t.sites, t.targets, 45.0, "site_id", "target_id").select("site_id")


@query(_near("WHERE (s.x-t.x)*(s.x-t.x)+(s.z-t.z)*(s.z-t.z) < 2025") + " SELECT site_id FROM fx_sites WHERE site_id NOT IN (SELECT site_id FROM n)")
def not_within_distance(t):
    return D.within_distance(t.sites, t.targets, 45.0, "site_id", "target_id", how="anti").select("site_id")


@query(with_views("sites") + """ SELECT a.site_id AS a, b.site_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z)),6)+0.0 AS dist FROM fx_sites a JOIN fx_sites b
 ON a.site_id < b.site_id AND abs(a.x-b.x) <= 18 AND abs(a.z-b.z) <= 18 WHERE (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) <= 324""")
def self_within_distance(t):
    """Site pairs at most 18 m apart."""
    return D.self_within_distance(t.sites, 18.0, "site_id").withColumn("dist", r_many("dist"))


@query(with_views("poses") + """, b AS (SELECT CAST(floor(event_id/200) AS BIGINT) AS frame, event_id AS id, x, z, yaw FROM fx_poses),
 n AS (SELECT a.frame, a.id, arg_min({'o': b.id, 'x': b.x-a.x, 'z': b.z-a.z}, {'d': (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z), 'i': b.id}) AS o FROM b a JOIN b ON a.frame = b.frame AND a.id <> b.id
  WHERE (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) < 1600 GROUP BY ALL)
 SELECT b.frame, b.id, o.o AS other_id, round(sqrt(o.x*o.x+o.z*o.z),6)+0.0 AS dist, round(o.x*cos(yaw)-o.z*sin(yaw),6)+0.0 AS fwd, round(o.x*sin(yaw)+o.z*cos(yaw),6)+0.0 AS lat FROM b LEFT JOIN n USING (frame, id)""")
def nearest_other(t):
    """Nearest other body within 40 m in the same frame, in the ego frame."""
    out = D.nearest_other(bodies(t), "id", ["frame"])
    return out.select("frame", "id", "other_id", r("dist").alias("dist"), r("fwd").alias("fwd"), r("lat").alias("lat"))


_SEGS = """, seg AS (SELECT road_id, seq, x AS ax, z AS az, lead(x) OVER (PARTITION BY road_id ORDER BY seq) AS bx, lead(z) OVER (PARTITION BY road_id ORDER BY seq) AS bz FROM fx_roads),
 sg AS (SELECT *, (bx-ax)*(bx-ax)+(bz-az)*(bz-az) AS l2 FROM seg WHERE bx IS NOT NULL)"""


def road_segments(t):
    from ..operators.polylines import segments_of

    return segments_of(t.roads.select("road_id", "seq", "x", "z", "class", "name"), ["road_id"], block_of("seq"))


@query(with_views("targets", "roads") + _SEGS + """, c AS (SELECT target_id, t.x, t.z, sg.*, least(greatest(((t.x-ax)*(bx-ax)+(t.z-az)*(bz-az))/l2, 0.0), 1.0) AS tt FROM fx_targets t, sg WHERE l2 >= 1e-6),
 d AS (SELECT target_id, (x-ax-tt*(bx-ax))*(x-ax-tt*(bx-ax))+(z-az-tt*(bz-az))*(z-az-tt*(bz-az)) AS d2 FROM c)
 SELECT target_id, round(sqrt(min(d2) FILTER (d2 < 14400)),6)+0.0 AS dist FROM fx_targets LEFT JOIN d USING (target_id) GROUP BY target_id""")
def nearest_segment(t):
    """Distance from each target to the nearest road piece within 120 m, null where none is."""
    near = D.nearest_segment(t.targets, road_segments(t), "target_id", ["road_id"], 120.0, ["road_id", "seq"])
    return near.select("target_id", r("dist").alias("dist"))


def _route(t):
    """One long route through all box centres."""
    return t.boxes.select(F.col("box_id").alias("seq"), (F.col("cx") * 10).alias("x"), (F.col("cz") * 10).alias("z"))


_ROUTE = """, rt AS (SELECT box_id AS seq, cx*10 AS x, cz*10 AS z FROM fx_boxes),
 rs AS (SELECT seq, x AS ax, z AS az, lead(x) OVER (ORDER BY seq) AS bx, lead(z) OVER (ORDER BY seq) AS bz FROM rt),
 rl AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(bz-az)*(bz-az)) AS len FROM rs WHERE bx IS NOT NULL),
 rc AS (SELECT *, sum(len) OVER (ORDER BY seq) - len AS s0 FROM rl)"""


@query(with_views("targets", "boxes") + _ROUTE + """, c AS (SELECT target_id, t.x*10 AS x, t.z*10 AS z, rc.*, CASE WHEN len = 0 THEN 0 ELSE least(greatest(((t.x*10-ax)*(bx-ax)+(t.z*10-az)*(bz-az))/(len*len), 0.0), 1.0) END AS tt FROM fx_targets t, rc),
 d AS (SELECT *, (x-ax-tt*(bx-ax))*(x-ax-tt*(bx-ax))+(z-az-tt*(bz-az))*(z-az-tt*(bz-az)) AS d2 FROM c)
 SELECT target_id, round(arg_min(s0+tt*len, {'d': d2, 'q': seq}),3)+0.0 AS s, round(sqrt(min(d2)),4)+0.0 AS lateral FROM d GROUP BY target_id""")
def project_on_route(t):
    """Arc length and lateral distance of targets on one long route."""
    pts = t.targets.select("target_id", (F.col("x") * 10).alias("x"), (F.col("z") * 10).alias("z"))
    out = D.project_on_route(pts, _route(t), "target_id", block_of("seq", 512))
    return out.select("target_id", r("s", 3).alias("s"), r("lateral", 4).alias("lateral"))


@query(with_views("targets", "boxes") + _ROUTE + """, q AS (SELECT DISTINCT CAST(target_id*977 AS DOUBLE) AS s FROM fx_targets), tot AS (SELECT sum(len) AS total FROM rl),
 c AS (SELECT q.s, least(greatest(q.s, 0.0), total) AS ss, rc.* FROM q, tot, rc WHERE s0+len + 1e-9 >= least(greatest(q.s, 0.0), total)),
 f AS (SELECT s, arg_min({'x': ax+(bx-ax)*CASE WHEN len=0 THEN 0 ELSE least(greatest((ss-s0)/len,0.0),1.0) END, 'z': az+(bz-az)*CASE WHEN len=0 THEN 0 ELSE least(greatest((ss-s0)/len,0.0),1.0) END}, seq) AS p FROM c GROUP BY s)
 SELECT s, round(p.x,4)+0.0 AS x, round(p.z,4)+0.0 AS z FROM f""")
def point_at(t):
    """Points of the route at given arc lengths."""
    from ..operators.polylines import point_at as at

    q = t.targets.select((F.col("target_id") * 977).cast("double").alias("s")).distinct()
    return at(q, _route(t), block=block_of("seq", 512)).select("s", r("x", 4).alias("x"), r("z", 4).alias("z"))


@query(with_views("poses", "targets") + """, c AS (SELECT event_id, target_id, (t.x/5-p.x)*cos(yaw) + (t.z/5-p.z)*(-sin(yaw)) AS fwd, -(t.x/5-p.x)*(-sin(yaw)) + (t.z/5-p.z)*cos(yaw) AS side FROM fx_poses p, fx_targets t),
 n AS (SELECT event_id, arg_min(target_id, {'f': fwd, 't': target_id}) AS ahead_id, min(fwd) AS ahead_dist FROM c WHERE fwd > 0 AND fwd <= 22 AND abs(side) <= 4 GROUP BY event_id)
 SELECT event_id, ahead_id, round(ahead_dist,6)+0.0 AS ahead_dist FROM fx_poses LEFT JOIN n USING (event_id)""")
def corridor_ahead(t):
    """Nearest target in the lane ahead of each pose."""
    targets = t.targets.select("target_id", (F.col("x") / 5).alias("x"), (F.col("z") / 5).alias("z"))
    out = D.corridor_ahead(t.poses.select("event_id", "x", "z", "yaw"), targets, "event_id", "target_id")
    return out.select("event_id", "ahead_id", r("ahead_dist").alias("ahead_dist"))


_BOX = """, bx AS (SELECT box_id, cx-half AS x0, cx+half AS x1, cz-half AS z0, cz+half AS z1 FROM fx_boxes)"""


def _boxes(t):
    c = F.col
    return t.boxes.select(
        "box_id", (c("cx") - c("half")).alias("x0"), (c("cx") + c("half")).alias("x1"), (c("cz") - c("half")).alias("z0"), (c("cz") + c("half")).alias("z1")
    )


@query(with_views("roads", "boxes") + """ SELECT box_id, road_id FROM (SELECT box_id, road_id, bool_or(v.x < ((b.cx-b.half)+(b.cx+b.half))/2) AND bool_or(v.x > ((b.cx-b.half)+(b.cx+b.half))/2) AS ew, bool_or(v.z < ((b.cz-b.half)+(b.cz+b.half))/2) AND bool_or(v.z > ((b.cz-b.half)+(b.cz+b.half))/2) AS ns
 FROM fx_boxes b JOIN fx_roads v ON v.x BETWEEN b.cx-b.half AND b.cx+b.half AND v.z BETWEEN b.cz-b.half AND b.cz+b.half GROUP BY ALL) WHERE ew OR ns""")
def road_crosses_box(t):
    return D.road_crosses_box(t.roads, _boxes(t), "box_id", "road_id")


@query(with_views("sites", "boxes") + """ SELECT site_id FROM fx_sites s WHERE sqrt((x-500)*(x-500)+(z-500)*(z-500)) >= 40 AND NOT EXISTS (SELECT 1 FROM fx_boxes b
 WHERE s.x BETWEEN b.cx-b.half-3 AND b.cx+b.half+3 AND s.z BETWEEN b.cz-b.half-3 AND b.cz+b.half+3)""")
def free_points(t):
    """Sites clear of every footprint and of the start point."""
    return D.free_points(t.sites, _boxes(t), "site_id", 3.0, (500.0, 500.0, 40.0)).select("site_id")


@query(with_views("points", "roads") + _SEGS + """ SELECT DISTINCT p.pid FROM fx_points p JOIN sg ON l2 > 0 AND p.x BETWEEN least(ax,bx)-3.513 AND greatest(ax,bx)+3.513 AND p.z BETWEEN least(az,bz)-3.513 AND greatest(az,bz)+3.513
 WHERE p.cls = 6 AND ((p.x-ax)*(bx-ax)+(p.z-az)*(bz-az))/sqrt(l2) BETWEEN 0 AND sqrt(l2) AND abs((bx-ax)*(p.z-az)-(bz-az)*(p.x-ax))/sqrt(l2) <= 3.513""")
def road_surface_hit(t):
    """Building points that lie on a road surface."""
    segs = road_segments(t).withColumn("width", F.lit(7.026))
    return V.road_surface_hit(t.points.where("cls = 6").select("pid", "x", "z"), segs, "pid").select("pid").distinct()


# ---- ranges, sets, snapshots -------------------------------------------------------
_RUNS = """, rg AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS start FROM part)"""


@query("WITH q AS (SELECT o_orderkey*3 AS pos FROM orders), rg AS (SELECT p_partkey, p_size, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size AS BIGINT) AS start FROM part) "
       "SELECT q.pos, rg.p_partkey FROM q LEFT JOIN rg ON q.pos >= rg.start AND q.pos < rg.start + rg.p_size")
def range_lookup(t):
    """Owner of each index position among packed parts."""
    from ..sources.files import pack_with_offsets

    packed = pack_with_offsets(t.part.select("p_partkey", "p_size"), ["p_partkey"], block_of("p_partkey", 1024), ["p_size"])
    q = t.orders.select((F.col("o_orderkey") * 3).alias("pos"))
    return L.range_lookup(q, packed, "pos", "p_size_start", "p_size", ["p_partkey"])


@query("SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size AS BIGINT) AS p_size_start, p_size FROM part")
def pack_with_offsets(t):
    """Exclusive running offsets of concatenated parts."""
    from ..sources.files import pack_with_offsets as pack

    return pack(t.part.select("p_partkey", "p_size"), ["p_partkey"], block_of("p_partkey", 1024), ["p_size"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def keep_set(t):
    made = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return L.keep_set(t.customer.select("c_custkey", "c_name"), made, ["c_custkey"])


@query("""WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
 SELECT coalesce(p.user_id, c.user_id) AS user_id, CASE WHEN p.user_id IS NULL THEN 'appear' WHEN c.user_id IS NULL THEN 'leave' ELSE 'stay' END AS change FROM p FULL OUTER JOIN c ON p.user_id = c.user_id""")
def snapshot_diff(t):
    e = t.events
    return L.snapshot_diff(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")


@query("""WITH a AS (SELECT conv_id AS episode, turn AS step, CAST(length(text) AS DOUBLE) AS reward FROM conversations),
 b AS (SELECT episode, step, reward + CASE WHEN (episode*31+step) % 11 = 0 THEN 1 ELSE 0 END AS reward FROM a)
 SELECT episode, count(*) AS steps, count(*) FILTER (abs(a.reward-b.reward) > 1e-4) AS mismatches, count(*) FILTER (abs(a.reward-b.reward) > 1e-4) = 0 AS ok FROM a JOIN b USING (episode, step) GROUP BY episode""")
def replay_compare(t):
    """Two reward logs compared step by step."""
    a = t.conversations.select(F.col("conv_id").alias("episode"), F.col("turn").alias("step"), F.length("text").cast("double").alias("reward"))
    b = a.withColumn("reward", F.col("reward") + F.when((F.col("episode") * 31 + F.col("step")) % 11 == 0, 1.0).otherwise(0.0))
    return L.replay_compare(a, b)


@query(with_views("boxes") + " SELECT box_id FROM fx_boxes WHERE cx-half <= 400 AND cx+half >= 300 AND cz-half <= 700 AND cz+half >= 500")
def boxes_intersect(t):
    from ..functions.predicates import boxes_intersect as meet

    q = (F.lit(300.0), F.lit(400.0), F.lit(500.0), F.lit(700.0))
    return _boxes(t).where(meet((F.col("x0"), F.col("x1"), F.col("z0"), F.col("z1")), q)).select("box_id")


def overlap_parts(t):
    """Scored footprints, matches and known total of a comparison."""
    a = rings(t).select(F.col("box_id").alias("a_id"), F.col("ring").alias("a_ring"))
    b = lots(t).select(F.col("box_id").alias("b_id"), square().alias("b_ring"))
    m = V.polygon_overlap(a, b, 0.1037)
    # the pairs are found once, for both sides
    sides = m.groupingSets([["a_id"], ["b_id"]], "a_id", "b_id").agg(F.grouping("b_id").alias("of_a"), F.count(F.lit(1)).alias("overlaps"), F.round(F.max("iou"), 3).alias("best_iou"))
    sides = materialize(sides)
    best = sides.where("of_a = 1").select("a_id", "overlaps", "best_iou")
    scored = a.select("a_id").join(best, "a_id", "left").select(
        "a_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"),
        F.when(F.col("a_id") % 5 == 0, "lidar_only").otherwise("osm+lidar").alias("provenance"),
        (F.col("a_id") % 20 / 100.0).alias("road_frac"),
    )
    return scored, sides.where("of_a = 0").select(F.col("b_id").alias("known_id")), b.agg(F.count(F.lit(1)).alias("n"))


@query(with_views("boxes", "sites") + _PAIR + """, o AS (SELECT a, b, greatest(ox,0)*greatest(oz,0) AS area, 4*ah*ah AS pa, 4*bh*bh AS pb FROM q),
 m AS (SELECT a, b, area/(pa+pb-area) AS iou FROM o WHERE area > 0 AND area >= 0.1037*least(pa,pb)),
 s AS (SELECT x.box_id AS a, count(m.b) AS nov, coalesce(round(max(iou),3),0.0) AS best_iou, CASE WHEN x.box_id % 5 = 0 THEN 'lidar_only' ELSE 'osm+lidar' END AS provenance, (x.box_id % 20)/100.0 AS road_frac
  FROM fx_boxes x LEFT JOIN m ON m.a = x.box_id GROUP BY x.box_id)
 SELECT count(*) AS extracted, count(*) FILTER (nov > 0) AS matched, count(*) FILTER (nov > 1) AS merged, CAST(coalesce(sum(nov) FILTER (nov > 1),0) AS BIGINT) AS swallowed,
 count(*) FILTER (nov = 0 AND provenance <> 'lidar_only') AS spurious, count(*) FILTER (provenance = 'lidar_only') AS lidar_only, count(*) FILTER (road_frac >= 0.05) AS road_crossing,
 (SELECT count(DISTINCT b) FROM m) AS known_matched, (SELECT count(*) FROM lots) AS known, list_sort(list(best_iou) FILTER (nov > 0))[CAST(floor(count(*) FILTER (nov > 0)/2) AS BIGINT)+1] AS median_iou,
 (SELECT count(*) FROM lots) - (SELECT count(DISTINCT b) FROM m) AS known_missed FROM s""")
def overlap_summary(t):
    """Totals of a footprint comparison, with the upper median IoU."""
    return A.overlap_summary(*overlap_parts(t))


@query(with_views("boxes") + """, s AS (SELECT box_id, 4*half*half AS area, (box_id % 30)/100.0E0 AS road_frac, (box_id % 40)/100.0E0 AS osm_frac, half*3-4 AS height_m FROM fx_boxes)
 SELECT box_id FROM s WHERE area BETWEEN 40 AND 4000 AND road_frac <= 0.15 AND osm_frac <= 0.20 AND height_m BETWEEN 2 AND 120""")
def building_shape_gate(t):
    b = t.boxes.select(
        "box_id", (4 * F.col("half") * F.col("half")).alias("area"), (F.col("box_id") % 30 / 100.0).alias("road_frac"),
        (F.col("box_id") % 40 / 100.0).alias("osm_frac"), (F.col("half") * 3 - 4).alias("height_m"),
    )
    return A.building_shape_gate(b).select("box_id")


@query(with_views("boxes") + """, s AS (SELECT box_id, (half*half*half/20)/greatest(sqrt(4*half*half/ (1 + box_id % 900)), 0.01) AS a FROM fx_boxes)
 SELECT box_id, CASE WHEN a > 10 THEN 'very_tall' WHEN a < 0.1 THEN 'very_flat' END AS suspicious FROM s""")
def aspect_flag(t):
    from ..functions.predicates import aspect_flag as flag

    half = F.col("half")
    return t.boxes.select("box_id", flag(half * half * half / 20, 4 * half * half / (1 + F.col("box_id") % 900)).alias("suspicious"))


@query(with_views("boxes") + " SELECT box_id FROM fx_boxes WHERE 4*half*half >= 60 AND cx BETWEEN 100 AND 900 AND cz BETWEEN 100 AND 900")
def footprint_gate(t):
    return A.footprint_gate(rings(t), (100.0 - 1e-9, 100.0 - 1e-9, 900.0 + 1e-9, 900.0 + 1e-9), 60.0 - 1e-6).select("box_id")


