"""Polylines and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..functions.rings import polyline_length as array_length
from ..operators import aggregates as A
from ..operators import polylines as W
from ..operators import sets as O
from ..plans.ordered import block_of
from .registry import query, r

BLK = ("seq", 4)  # small blocks, so the checks cross many borders


def lines(t):
    """Array form of the short roads: at most sixteen vertices each by construction."""
    v = F.struct("seq", "x", "z", "y")
    return t.roads.groupBy("road_id", "class", "name").agg(F.array_sort(F.collect_list(v)).alias("pts"))


_SEG = """, sg AS (SELECT road_id, seq, name, x AS ax, z AS az, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM fx_roads WINDOW w AS (PARTITION BY road_id ORDER BY seq)),
 sl AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(bz-az)*(bz-az)) AS len FROM sg WHERE bx IS NOT NULL),
 sc AS (SELECT *, sum(len) OVER (PARTITION BY road_id ORDER BY seq) - len AS s0, sum(len) OVER (PARTITION BY road_id) AS total FROM sl)"""


@query(with_views("vertices") + """, sg AS (SELECT road_id, x, z, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM fx_vertices WINDOW w AS (PARTITION BY road_id ORDER BY seq))
 SELECT road_id, round(sum(sqrt((bx-x)*(bx-x)+(bz-z)*(bz-z))),4)+0.0 AS length FROM sg WHERE bx IS NOT NULL GROUP BY road_id""")
def polyline_length(t):
    return A.polyline_length(t.vertices, ["road_id"], block_of("seq", 4096)).withColumn("length", r("length", 4))


@query(with_views("roads") + _SEG + " SELECT road_id, round(coalesce(max(total), 0),4)+0.0 AS length FROM (SELECT DISTINCT road_id FROM fx_roads) LEFT JOIN sc USING (road_id) GROUP BY road_id")
def array_line_lengths(t):
    return A.array_line_lengths(lines(t)).select("road_id", r("length", 4).alias("length"))


@query(with_views("roads") + _SEG + """, st AS (SELECT road_id, ax, az, bx, bz, len, s0, unnest(range(greatest(CAST(ceil(s0/7.3) AS BIGINT),1), CAST(ceil((s0+len)/7.3) AS BIGINT))) AS k FROM sc WHERE len >= 1e-6),
 o AS (SELECT road_id, k*7.3E0 AS s, ax+(bx-ax)*(k*7.3E0-s0)/len AS x, az+(bz-az)*(k*7.3E0-s0)/len AS z FROM st
  UNION ALL SELECT road_id, 0.0, x, z FROM (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn FROM fx_roads) WHERE rn = 1
  UNION ALL SELECT road_id, s0+len, bx, bz FROM (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq DESC) AS rn FROM sc) WHERE rn = 1)
 SELECT road_id, round(s,4)+0.0 AS s, round(x,4)+0.0 AS x, round(z,4)+0.0 AS z FROM o""")
def resample_polyline(t):
    """Stations every 7.3 m with both ends."""
    out = W.resample_polyline(t.roads, ["road_id"], 7.3, block_of(*BLK))
    return out.select("road_id", r("s", 4).alias("s"), r("x", 4).alias("x"), r("z", 4).alias("z"))


@query(with_views("roads").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn FROM fx_roads),
 f AS (SELECT road_id, rn, seq, x AS kx, z AS kz, true AS kept FROM n WHERE rn = 1 UNION ALL
  SELECT n.road_id, n.rn, n.seq, CASE WHEN sqrt((n.x-kx)*(n.x-kx)+(n.z-kz)*(n.z-kz)) > 15.003 THEN n.x ELSE kx END, CASE WHEN sqrt((n.x-kx)*(n.x-kx)+(n.z-kz)*(n.z-kz)) > 15.003 THEN n.z ELSE kz END,
   sqrt((n.x-kx)*(n.x-kx)+(n.z-kz)*(n.z-kz)) > 15.003 FROM f JOIN n ON n.road_id = f.road_id AND n.rn = f.rn + 1)
 SELECT road_id, seq FROM f WHERE kept""")
def dedupe_min_distance(t):
    """Greedy thinning to 15 m from the last kept vertex."""
    return W.dedupe_min_distance(t.roads, ["road_id"], 15.003, block=block_of(*BLK)).select("road_id", "seq")


@query(with_views("roads") + """, c AS (SELECT road_id, seq, CAST(round_even(x/20,0) AS BIGINT) AS x, CAST(round_even(z/20,0) AS BIGINT) AS z FROM fx_roads),
 p AS (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM c WINDOW w AS (PARTITION BY road_id ORDER BY seq)) SELECT road_id, seq, x, z FROM p WHERE px IS NULL OR px <> x OR pz <> z""")
def dedupe_consecutive_equal(t):
    coarse = t.roads.select("road_id", "seq", (F.col("x") / 20).alias("x"), (F.col("z") / 20).alias("z"))
    return W.dedupe_consecutive_equal(coarse, ["road_id"], block_of(*BLK))


@query(with_views("vertices") + """, m AS (SELECT *, x BETWEEN 100 AND 900 AND z BETWEEN 100 AND 900 AS inb FROM fx_vertices), g AS (SELECT *, sum(CASE WHEN inb THEN 0 ELSE 1 END) OVER (PARTITION BY road_id ORDER BY seq) AS run FROM m)
 SELECT road_id, seq, CAST(run AS BIGINT) AS run FROM g WHERE inb QUALIFY count(*) OVER (PARTITION BY road_id, run) >= 2""")
def split_runs(t):
    """Contiguous stretches inside the extent."""
    from ..functions.predicates import in_bbox

    inside = in_bbox(F.col("x"), F.col("z"), (100.0, 100.0, 900.0, 900.0))
    return W.split_runs(t.vertices, ["road_id"], inside, 2, block_of("seq", 256)).select("road_id", "seq", "run")


@query(with_views("roads").replace("WITH ", "WITH RECURSIVE ", 1) + """, l0 AS (SELECT road_id, 0 AS k, list({'x': x, 'z': z} ORDER BY seq) AS p FROM fx_roads GROUP BY road_id),
 ch AS (SELECT * FROM l0 UNION ALL SELECT road_id, k+1, CASE WHEN len(p) < 3 THEN p ELSE list_concat(list_concat([p[1]], flatten(list_transform(range(1, len(p)), lambda i: [{'x': 0.75*p[i].x+0.25*p[i+1].x, 'z': 0.75*p[i].z+0.25*p[i+1].z}, {'x': 0.25*p[i].x+0.75*p[i+1].x, 'z': 0.25*p[i].z+0.75*p[i+1].z}]))), [p[len(p)]]) END FROM ch WHERE k < 2),
 u AS (SELECT road_id, len(p) AS n, unnest(p) AS q FROM ch WHERE k = 2)
 SELECT road_id, n, round(sum(q.x),4)+0.0 AS sx, round(sum(q.z),4)+0.0 AS sz FROM u GROUP BY ALL""")
def chaikin(t):
    """Corner cutting, twice."""
    cut = lines(t).select("road_id", W.chaikin(F.col("pts"), 2).alias("p"))
    total = lambda a: F.aggregate("p", F.lit(0.0), lambda s, q: s + q[a])
    return cut.select("road_id", F.size("p").cast("long").alias("n"), r(total("x"), 4).alias("sx"), r(total("z"), 4).alias("sz"))


@query(with_views("roads") + _SEG + """, h AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn FROM sc WHERE s0+len >= total/2 - 1e-9*total/2)
 SELECT road_id, round(total,4)+0.0 AS length, round(ax+(bx-ax)*least((total/2-s0)/len,1),4)+0.0 AS x, round(az+(bz-az)*least((total/2-s0)/len,1),4)+0.0 AS z FROM h WHERE rn = 1""")
def midpoint_by_length(t):
    out = W.midpoint_by_length(t.roads, ["road_id"], block_of(*BLK))
    return out.select("road_id", r("length", 4).alias("length"), r("x", 4).alias("x"), r("z", 4).alias("z"))


@query(with_views("roads") + """, n AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY road_id) AS n FROM fx_roads) SELECT road_id, x, z FROM n WHERE rn - 1 = n // 2""")
def vertex_midpoint(t):
    return W.vertex_midpoint(t.roads, ["road_id"], block_of(*BLK)).select("road_id", "x", "z")


_W = "[" + ",".join(repr(2.718281828459045 ** (-0.5 * (k / 2.2) ** 2)) for k in range(-9, 10)) + "]"


@query(with_views("roads") + f""", l AS (SELECT road_id, list(y ORDER BY seq) AS ys FROM fx_roads GROUP BY road_id), w AS (SELECT {_W} AS w),
 e AS (SELECT road_id, ys, unnest(range(1, len(ys)+1)) AS i, w FROM l, w),
 g AS (SELECT road_id, i, CASE WHEN len(ys) < 5 THEN ys[i] ELSE list_sum(list_transform(range(1,20), lambda k: w[k]*ys[least(greatest(i+k-10,1),len(ys))]))/list_sum(w) END AS y, ys[i] AS raw FROM e)
 SELECT road_id, i-1 AS i, round(least(greatest(y, raw-0.2), raw+0.6),7)+0.0 AS y FROM g""")
def gaussian_profile(t):
    """Elevation low-pass, then clamped to the ground band."""
    ys = F.transform("pts", lambda p: p["y"])
    out = lines(t).select("road_id", ys.alias("raw"), W.gaussian_profile(ys).alias("ys"))
    out = out.select("road_id", F.posexplode(W.clamp_profile(F.col("ys"), F.col("raw"))).alias("i", "y"))
    return out.select("road_id", F.col("i").cast("long").alias("i"), r("y", 7).alias("y"))


@query("WITH RECURSIVE" + with_views("roads")[4:] + """, p AS (SELECT road_id, list(y ORDER BY seq) AS ys, list({'x': x, 'z': z} ORDER BY seq) AS pt FROM fx_roads GROUP BY road_id),
 c AS (SELECT road_id, ys, list_transform(range(1, len(pt)), lambda i: 0.22E0*sqrt(pow(pt[i+1].x-pt[i].x,2)+pow(pt[i+1].z-pt[i].z,2))) AS cap FROM p),
 s AS (SELECT road_id, 0 AS k, ys, cap FROM c UNION ALL SELECT road_id, k + 1, ys[:i-1] || [least(greatest(ys[i], ys[j] - cap[least(i, j)]), ys[j] + cap[least(i, j)])] || ys[i+1:], cap
  FROM (SELECT *, CASE WHEN ahead THEN pos + 2 ELSE len(cap) - pos END AS i, CASE WHEN ahead THEN pos + 1 ELSE len(cap) - pos + 1 END AS j FROM (SELECT *, (k // len(cap)) % 2 = 0 AS ahead, k % len(cap) AS pos FROM s WHERE k < 8*len(cap)))),
 d AS (SELECT road_id, unnest(range(len(ys))) AS i, unnest(ys) AS y FROM s WHERE k = 8*len(cap)) SELECT road_id, CAST(i AS INTEGER) AS i, round(y,6)+0.0 AS y FROM d""")
def limit_grade(t):
    """Elevation profiles with no segment steeper than 22 %."""
    pts = F.col("pts")
    ys, n = F.transform(pts, lambda p: p["y"]), F.size("pts")
    seg = F.zip_with(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["z"] - a["z"]))
    return lines(t).select("road_id", F.posexplode(W.limit_grade(ys, seg)).alias("i", "y")).withColumn("y", r("y"))


@query(with_views("roads") + """, d AS (SELECT road_id, seq, abs(lag(y) OVER w - 2*y + lead(y) OVER w) AS d2 FROM fx_roads WINDOW w AS (PARTITION BY road_id ORDER BY seq)) SELECT road_id, seq, round(d2,6)+0.0 AS d2 FROM d WHERE d2 IS NOT NULL""")
def second_difference(t):
    return W.second_difference(t.roads, ["road_id"], "y", block_of(*BLK)).select("road_id", "seq", r("d2").alias("d2"))


@query(with_views("roads") + """, d AS (SELECT abs(lag(y) OVER w - 2*y + lead(y) OVER w) AS d2 FROM fx_roads WINDOW w AS (PARTITION BY road_id ORDER BY seq)), s AS (SELECT list_sort(list(d2)) AS l FROM d WHERE d2 IS NOT NULL)
 SELECT round(l[len(l)//2+1],6)+0.0 AS median, round(l[CAST(floor(len(l)*0.95) AS BIGINT)+1],6)+0.0 AS p95 FROM s""")
def roughness(t):
    """Vertical roughness of all roads."""
    return W.roughness(t.roads, ["road_id"], "y", block_of(*BLK)).select(r("median").alias("median"), r("p95").alias("p95"))


@query(with_views("roads") + """, d AS (SELECT road_id, seq, x, z, coalesce(x-lag(x) OVER w,0)+coalesce(lead(x) OVER w-x,0) AS dx, coalesce(z-lag(z) OVER w,0)+coalesce(lead(z) OVER w-z,0) AS dz FROM fx_roads WINDOW w AS (PARTITION BY road_id ORDER BY seq)),
 u AS (SELECT *, CASE WHEN sqrt(dx*dx+dz*dz) = 0 THEN 1 ELSE sqrt(dx*dx+dz*dz) END AS l FROM d) SELECT road_id, seq, round(-dz/l,6)+0.0 AS ux, round(dx/l,6)+0.0 AS uz, round(x-1.5*dz/l,6)+0.0 AS lane_x, round(z+1.5*dx/l,6)+0.0 AS lane_z FROM u""")
def road_direction(t):
    out = W.road_direction(t.roads.select("road_id", "seq", "x", "z"), ["road_id"], 1.5, block_of(*BLK))
    return out.select("road_id", "seq", *[r(c).alias(c) for c in ("ux", "uz", "lane_x", "lane_z")])


# ---- motion ------------------------------------------------------------------------


@query(with_views("poses") + """, m AS (SELECT event_id, track_id, epoch_us(ts)/1000000.0E0 AS t, x, z FROM fx_poses), d AS (SELECT *, t-lag(t) OVER w AS dt, x-lag(x) OVER w AS dx, z-lag(z) OVER w AS dz FROM m WINDOW w AS (PARTITION BY track_id ORDER BY t, event_id))
 SELECT event_id, round(dx/nullif(dt,0),5)+0.0 AS vx, round(dz/nullif(dt,0),5)+0.0 AS vz FROM d""")
def motion(t):
    """Velocity of each pose from the one before."""
    p = t.poses.withColumn("t", F.unix_micros("ts") / 1000000.0)
    out = W.motion(p, ["track_id"], ["t", "event_id"], "t", F.floor(F.col("t") / 86400))
    return out.select("event_id", r("vx", 5).alias("vx"), r("vz", 5).alias("vz"))


@query(with_views("poses") + """, d AS (SELECT track_id, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) AS s FROM fx_poses WINDOW w AS (PARTITION BY track_id ORDER BY ts, event_id))
 SELECT track_id, count(*) AS poses, round(coalesce(sum(s),0),4)+0.0 AS path_len FROM d GROUP BY track_id""")
def path_length(t):
    out = W.path_length(t.poses, ["track_id"], ["ts", "event_id"], F.floor(F.unix_seconds("ts") / 86400))
    return out.withColumn("path_len", r("path_len", 4))


_PAIRS = """, c AS (SELECT DISTINCT user_id AS a, event_id % 3 AS b, CAST(floor(epoch(ts)/43200) AS BIGINT) AS frame FROM events), w AS (SELECT *, lag(frame) OVER q AS p, lead(frame) OVER q AS n FROM c WINDOW q AS (PARTITION BY a, b ORDER BY frame))"""


@query("WITH z AS (SELECT 1)" + _PAIRS + """ SELECT a, b, frame, CASE WHEN p = frame-1 THEN 'stay' ELSE 'enter' END AS phase FROM w UNION ALL SELECT a, b, frame+1, 'exit' FROM w WHERE (n IS NULL OR n <> frame+1) AND frame < (SELECT max(frame) FROM c)""")
def contact_phases(t):
    """Enter, stay and exit of each pair over half-day frames."""
    frame = F.floor(F.unix_seconds("ts") / 43200).cast("long")
    pairs = t.events.select(F.col("user_id").alias("a"), (F.col("event_id") % 3).alias("b"), frame.alias("frame")).distinct()
    last = pairs.agg(F.max("frame")).first()[0]
    return W.contact_phases(pairs, ["a", "b"], last, block_of("frame", 8))


@query("""WITH w AS (SELECT event_id, user_id, list_sort(list(value/20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS l FROM events)
 SELECT event_id, CASE WHEN len(l) >= 4 AND l[len(l)]-l[1] <= 1.0 THEN round(l[len(l)//2+1],6)+0.0 END AS settled FROM w""")
def settle(t):
    """Upper median of the last five samples per user once they agree."""
    e = t.events.select("event_id", "user_id", "ts", (F.col("value") / 20).alias("v"))
    out = W.settle(e, ["user_id"], ["ts", "event_id"], "v", F.floor(F.unix_seconds("ts") / 86400))
    return out.select("event_id", r("settled").alias("settled"))


@query(with_views("poses").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS rn FROM fx_poses),
 f AS (SELECT track_id, rn, event_id, x AS ax, z AS az, 0.0E0 AS h FROM n WHERE rn = 1 UNION ALL
  SELECT n.track_id, n.rn, n.event_id, CASE WHEN m THEN n.x ELSE ax END, CASE WHEN m THEN n.z ELSE az END, CASE WHEN m THEN degrees(atan2(-(n.z-az), n.x-ax)) ELSE h END
  FROM f JOIN n ON n.track_id = f.track_id AND n.rn = f.rn+1, LATERAL (SELECT sqrt((n.x-ax)*(n.x-ax)+(n.z-az)*(n.z-az)) >= 60.003 AS m))
 SELECT track_id, event_id, round(h,6)+0.0 AS heading FROM f""")
def anchored_heading(t):
    """Heading that changes only after 60 m from the last anchor."""
    p = t.poses.select("track_id", F.col("event_id").alias("seq"), "x", "z")
    out = W.anchored_heading(p, ["track_id"], 60.003, block_of("seq", 256))
    return out.select("track_id", F.col("seq").alias("event_id"), r("heading").alias("heading"))


# ---- names, signatures, suppression --------------------------------------------------
@query(with_views("roads") + _SEG + """, k AS (SELECT DISTINCT road_id, name, total FROM sc), m AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY road_id) AS n FROM fx_roads),
 b AS (SELECT k.name, arg_max(road_id, {'t': total, 'r': -road_id}) AS road_id, max(total) AS length FROM k GROUP BY k.name)
 SELECT b.name, b.road_id, round(length,4)+0.0 AS length, m.x, m.z FROM b JOIN m ON m.road_id = b.road_id AND m.rn - 1 = m.n // 2""")
def longest_by_name(t):
    """Longest road of each street name with its middle vertex."""
    out = A.longest_by_name(t.roads, block=block_of(*BLK))
    return out.withColumn("length", r("length", 4))


@query(with_views("roads") + _SEG + """, k AS (SELECT DISTINCT road_id, name, total FROM sc), m AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY road_id) AS n FROM fx_roads),
 b AS (SELECT k.name, arg_max(road_id, {'t': total, 'r': -road_id}) AS road_id, max(total) AS length FROM k GROUP BY k.name),
 p AS (SELECT b.name, length, CAST(floor(m.x/250+0.5) AS BIGINT) AS cx, CAST(floor(m.z/250+0.5) AS BIGINT) AS cz FROM b JOIN m ON m.road_id = b.road_id AND m.rn - 1 = m.n // 2)
 SELECT cx, cz, arg_max(name, {'l': length, 'n': name}) AS name, round(max(length),4)+0.0 AS length FROM p GROUP BY cx, cz ORDER BY length DESC LIMIT 10""")
def prominent_per_cell(t):
    """Longest name of each 250 m map cell, ten longest."""
    out = A.prominent_per_cell(A.longest_by_name(t.roads, block=block_of(*BLK)), 250.0, 10)
    return out.select("cx", "cz", "name", r("length", 4).alias("length"))


@query(with_views("roads") + """, i AS (SELECT DISTINCT name FROM fx_roads WHERE name LIKE '%7') SELECT DISTINCT road_id, name FROM fx_roads WHERE class IN ('motorway','trunk','primary','secondary','tertiary','motorway_link','trunk_link','primary_link') AND name NOT IN (SELECT name FROM i)""")
def label_candidates(t):
    r_ = t.roads.select("road_id", "name", "class").distinct()
    return A.label_candidates(r_, r_.where("name like '%7'")).select("road_id", "name")


@query(with_views("roads") + """, e AS (SELECT name, road_id, count(*) AS n, CAST(round_even(arg_min(x,seq)/200,0) AS BIGINT) AS a, CAST(round_even(arg_min(z,seq)/200,0) AS BIGINT) AS b, CAST(round_even(arg_max(x,seq)/200,0) AS BIGINT) AS c, CAST(round_even(arg_max(z,seq)/200,0) AS BIGINT) AS d FROM fx_roads GROUP BY name, road_id)
 SELECT name, min(road_id) AS road_id FROM e GROUP BY name, n, a, b, c, d""")
def dedupe_polylines(t):
    """One line per coarse signature (vertex count and rounded ends) of each street."""
    coarse = lines(t).withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] / 200).alias("x"), (p["z"] / 200).alias("z"))))
    return O.dedupe_polylines(coarse, ["name"], ["road_id"]).select("name", "road_id")


def _greedy(order: str, near: str, rounds: int = 24) -> str:
    """Greedy suppression by rounds: a point is kept once all earlier neighbours are gone, gone once one is kept."""
    sql = with_views("sites") + f""", n AS MATERIALIZED (SELECT site_id, x, z, row_number() OVER (ORDER BY {order}) AS rn FROM fx_sites),
 adj AS MATERIALIZED (SELECT a.rn AS a, b.rn AS b FROM n a JOIN n b ON b.rn < a.rn AND abs(a.x-b.x) <= 45 AND abs(a.z-b.z) <= 45 AND (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) {near} 2025),
 s0 AS MATERIALIZED (SELECT rn, 0 AS st FROM n)"""
    for k in range(1, rounds + 1):
        p = f"s{k - 1}"
        sql += f""", s{k} AS MATERIALIZED (SELECT {p}.rn, CASE WHEN {p}.st <> 0 THEN {p}.st WHEN max(q.st) = 2 THEN 1 WHEN coalesce(min(q.st), 1) = 1 THEN 2 ELSE 0 END AS st
 FROM {p} LEFT JOIN adj ON adj.a = {p}.rn LEFT JOIN {p} q ON q.rn = adj.b GROUP BY {p}.rn, {p}.st)"""
    return sql + f", fin AS (SELECT site_id, CASE st WHEN 2 THEN true WHEN 1 THEN false END AS kept FROM n JOIN s{rounds} USING (rn))"


@query(_greedy("c_nationkey DESC, site_id", "<=") + " SELECT site_id, kept FROM fin")
def spacing_suppress(t):
    """Greedy 45 m spacing by priority."""
    return O.spacing_suppress(t.sites, 45.0, "site_id", [-F.col("c_nationkey")]).select("site_id", "kept")


@query(_greedy("site_id", "<") + " SELECT site_id FROM fin WHERE kept IS DISTINCT FROM false")
def merge_keep_first(t):
    """Sites kept when no earlier kept site is nearer than 45 m."""
    return O.merge_keep_first(t.sites, 45.0, "site_id", []).select("site_id")


@query(with_views("roads").replace("WITH ", "WITH RECURSIVE ", 1) + """, ends AS (SELECT r.* FROM fx_roads r JOIN (SELECT road_id, min(seq) AS a, max(seq) AS b FROM fx_roads GROUP BY road_id HAVING min(seq) < max(seq)) USING (road_id) WHERE seq IN (a, b)),
 core AS (SELECT x, z, floor(x/3) AS cx, floor(z/3) AS cz, row_number() OVER (ORDER BY x, z) AS i FROM ends GROUP BY x, z),
 e AS (SELECT a.i AS a, b.i AS b FROM core a JOIN core b ON b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cz BETWEEN a.cz-1 AND a.cz+1 AND (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) <= 9),
 reach AS (SELECT i AS a, i AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), comp AS (SELECT a AS i, min(b) AS rep FROM reach GROUP BY a),
 g AS (SELECT ends.road_id, ends.seq, rep, ends.x, ends.y, ends.z FROM ends JOIN core USING (x, z) JOIN comp USING (i)), mean AS (SELECT rep, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g GROUP BY rep HAVING count(*) > 1)
 SELECT r.road_id, r.seq, round(coalesce(m.x,r.x),6)+0.0 AS x, round(coalesce(m.y,r.y),8)+0.0 AS y, round(coalesce(m.z,r.z),6)+0.0 AS z FROM fx_roads r LEFT JOIN g USING (road_id, seq) LEFT JOIN mean m USING (rep)""")
def weld_endpoints(t):
    """Road ends within 3 m share their mean position and elevation."""
    out = W.weld_endpoints(t.roads.select("road_id", "seq", "x", "y", "z"), ["road_id"], 3.0)
    return out.select("road_id", "seq", r("x").alias("x"), r("y", 8).alias("y"), r("z").alias("z"))


@query(with_views("roads") + _SEG + " SELECT class, round(sum(total),3)+0.0 AS metres FROM (SELECT DISTINCT road_id, total FROM sc) JOIN (SELECT DISTINCT road_id, class FROM fx_roads) USING (road_id) GROUP BY class")
def length_by_class(t):
    out = lines(t).select("class", array_length(F.col("pts")).alias("l"))
    return out.groupBy("class").agg(r(F.sum("l"), 3).alias("metres"))
