"""Camera calibration, tracks and traffic flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_views
from ..operators import aggregates as A
from ..operators import calibration as C
from ..operators import tracks as K
from ..streaming import feeds as ST
from .joins import road_segments
from .registry import query, r


def calib(t):
    """One invertible matrix per camera and quad."""
    k = F.col("n_nationkey")
    cam, quad = (k % 8).cast("long"), (k / 8).cast("int")
    h = F.array(F.lit(100.0) + k, F.lit(5.0), F.lit(10.0), F.lit(-4.0), F.lit(90.0) + k, F.lit(20.0), F.lit(0.1), F.lit(0.05), F.lit(1.0))
    return t.nation.select(cam.alias("camera"), quad.alias("quad"), h.alias("h"))


_CAL = "cal AS (SELECT n_nationkey AS k, n_nationkey % 8 AS camera, n_nationkey // 8 AS quad FROM nation)"


@query(with_views("detections") + f""", {_CAL}, q AS (SELECT det_id, camera, CASE WHEN v < 0.5 THEN 0 ELSE 2 END + CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS quad, (u-CASE WHEN u < 0.5 THEN 0 ELSE 0.5 END)*2 AS a, (v-CASE WHEN v < 0.5 THEN 0 ELSE 0.5 END)*2 AS b FROM fx_detections)
 SELECT det_id, round(((100.0+k)*a+5*b+10)/(0.1*a+0.05*b+1),6)+0.0 AS x, round((-4*a+(90.0+k)*b+20)/(0.1*a+0.05*b+1),6)+0.0 AS z FROM q LEFT JOIN cal ON cal.camera = q.camera AND cal.quad = q.quad""")
def image_to_scene(t):
    """Full-frame points to the scene through their quad's homography."""
    d = t.detections.select("det_id", "camera", "u", "v")
    return C.image_to_scene(d, calib(t)).select("det_id", r("x").alias("x"), r("z").alias("z"))


@query(with_views("detections") + """ SELECT det_id, round(CASE WHEN camera < 1 OR quad < 3 THEN u END,6)+0.0 AS u, round(CASE WHEN camera < 1 OR quad < 3 THEN v END,6)+0.0 AS v FROM (SELECT det_id, camera, u, v, CASE WHEN v < 0.5 THEN 0 ELSE 2 END + CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS quad FROM fx_detections)""")
def scene_to_image(t):
    """Scene points back into the frame."""
    d = t.detections.select("det_id", "camera", "u", "v")
    placed = C.image_to_scene(d, calib(t)).select("det_id", "camera", "quad", "x", "z")
    return C.scene_to_image(placed, calib(t)).select("det_id", r("u").alias("u"), r("v").alias("v"))


def pairs(t):
    """Exact correspondences of one known matrix per customer group, spread over the image."""
    u, v = F.col("u"), F.col("v")
    w = 0.1 * u + 0.05 * v + 1
    p = t.detections.select("camera", "quad", F.col("det_id").alias("pair"), "u", "v")
    return p.withColumn("x", (120.0 * u + 5 * v + 10) / w).withColumn("z", (-4 * u + 95.0 * v + 20) / w)


@query(with_views("detections") + " SELECT camera, quad, count(*) AS n, 120.0E0 AS h0, 95.0E0 AS h4, 0.1E0 AS h6, true AS tight FROM fx_detections GROUP BY camera, quad HAVING count(*) >= 4")
def fit_homography(t):
    """Recovers the known matrix of every camera and quad."""
    f = C.fit_homography(pairs(t), ["camera", "quad"])
    h = F.col("h")
    return f.select("camera", "quad", "n", r(h[0], 4).alias("h0"), r(h[4], 4).alias("h4"), r(h[6], 4).alias("h6"), (F.col("max_residual") < 1e-5).alias("tight"))


@query(with_views("detections") + """, c AS (SELECT DISTINCT a.camera, a.quad FROM fx_detections a JOIN fx_detections b ON a.camera = b.camera AND a.quad = b.quad AND a.det_id < b.det_id AND abs(a.u-b.u) < 1e-3 AND abs(a.v-b.v) < 1e-3 WHERE sqrt((a.u-b.u)*(a.u-b.u)+(a.v-b.v)*(a.v-b.v)) < 1e-3)
 SELECT d.camera, d.quad, count(*) AS n FROM fx_detections d LEFT JOIN c ON c.camera = d.camera AND c.quad = d.quad WHERE c.camera IS NULL GROUP BY ALL HAVING count(*) >= 4""")
def calibration_gate(t):
    """Groups without coincident image points whose fit is in bounds."""
    return C.calibration_gate(pairs(t), ["camera", "quad"]).select("camera", "quad", "n")


@query(with_views("points") + " SELECT count(*) AS n, 0.5E0 AS scale, 12.0E0 AS tx, true AS tight FROM fx_points")
def fit_similarity(t):
    """Recovers a known scale, turn and shift."""
    p = t.points.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    moved = p.withColumn("dx", 12.0 - 0.5 * F.col("sz")).withColumn("dy", 0.5 * F.col("sy") + 3).withColumn("dz", 0.5 * F.col("sx") - 7)
    f = C.fit_similarity(moved)
    return f.select("n", r("scale", 6).alias("scale"), r(F.col("elements")[12], 4).alias("tx"), (F.col("residual_max") < 1e-6).alias("tight"))


# ---- directions -------------------------------------------------------------------------
@query("SELECT user_id, round(atan2(sum(sin(value)), sum(cos(value))),5)+0.0 AS mean_angle, count(*) AS n FROM events GROUP BY user_id")
def circular_mean(t):
    return A.circular_mean(t.events, ["user_id"], "value").withColumn("mean_angle", r("mean_angle", 5))


_VEC = """, v AS (SELECT camera, quad, x-20 AS dx, (z-20)/3 AS dz FROM fx_detections), u AS (SELECT *, sqrt(dx*dx+dz*dz) AS l FROM v),
 m AS (SELECT camera, quad, avg(dx*dx/(l*l)) AS a, avg(dx*dz/(l*l)) AS b, avg(dz*dz/(l*l)) AS c, count(*) AS n FROM u WHERE l >= 1e-9 GROUP BY camera, quad HAVING count(*) >= 2),
 e AS (SELECT *, (a+c)/2 + sqrt(greatest((a+c)*(a+c)/4-(a*c-b*b),0)) AS l1 FROM m),
 ax AS (SELECT camera, quad, n, l1, a+c AS tr, CASE WHEN abs(b) > 1e-12 THEN l1-c WHEN a >= c THEN 1 ELSE 0 END AS vx, CASE WHEN abs(b) > 1e-12 THEN b WHEN a >= c THEN 0 ELSE 1 END AS vz FROM e),
 axis AS (SELECT camera, quad, n, vx/sqrt(vx*vx+vz*vz) AS ax, vz/sqrt(vx*vx+vz*vz) AS az, (2*l1-tr)/tr AS coherence FROM ax)"""


def _vectors(t):
    return t.detections.select("camera", "quad", (F.col("x") - 20).alias("dx"), ((F.col("z") - 20) / 3).alias("dz"))


@query(with_views("detections") + _VEC + " SELECT camera, quad, n, round(ax,5)+0.0 AS ax, round(az,5)+0.0 AS az, round(coherence,5)+0.0 AS coherence FROM axis")
def principal_axis(t):
    """Dominant undirected motion axis."""
    out = A.principal_axis(_vectors(t), ["camera", "quad"])
    return out.select("camera", "quad", "n", *[r(c, 5).alias(c) for c in ("ax", "az", "coherence")])


@query(with_views("detections") + _VEC + """, s AS (SELECT camera, quad, dx, dz, l, CASE WHEN dx*ax+dz*az >= 0 THEN 1 ELSE -1 END AS side FROM u JOIN axis USING (camera, quad)),
 g AS (SELECT camera, quad, side, sum(dx/CASE WHEN l = 0 THEN 1 ELSE l END) AS sx, sum(dz/CASE WHEN l = 0 THEN 1 ELSE l END) AS sz, count(*) AS count, avg(l) AS speed FROM s GROUP BY camera, quad, side)
 SELECT camera, quad, side, round(sx/sqrt(sx*sx+sz*sz),5)+0.0 AS dir_x, round(sz/sqrt(sx*sx+sz*sz),5)+0.0 AS dir_z, count, round(speed,5)+0.0 AS speed FROM g""")
def split_two_way(t):
    """The two flow directions along the axis."""
    v = _vectors(t)
    out = A.split_two_way(v, A.principal_axis(v, ["camera", "quad"]), ["camera", "quad"])
    return out.select("camera", "quad", "side", "count", *[r(c, 5).alias(c) for c in ("dir_x", "dir_z", "speed")])


# ---- tracks -----------------------------------------------------------------------------
@query()
def merge_cross_view(t):
    """Detections of different quads of a frame merged within 4 m."""
    return K.merge_cross_view(t.detections)


@query(with_views("detections") + " SELECT camera, frame, count(*) AS dets FROM fx_detections GROUP BY camera, frame")
def merge_cross_view_counts(t):
    """Every detection ends up in exactly one cluster."""
    return K.merge_cross_view(t.detections).groupBy("camera", "frame").agg(F.sum("n").alias("dets"))


@query()
def associate_tracks(t):
    """Vehicle tracks per camera."""
    out = K.associate_tracks(t.detections)
    return out.select("camera", "frame", "track_id", r("x").alias("x"), r("z").alias("z"), r("heading").alias("heading"), "cls", "quad", "quads")


def image_tracks(t):
    return K.associate_image_tracks(t.detections.select("camera", "quad", "frame", "det_id", "cls", "u", "v").where(F.col("cls").isin(2, 3, 5, 7)))


@query(with_views("detections") + " SELECT camera, quad, frame, det_id FROM fx_detections WHERE cls IN (2,3,5,7)")
def associate_image_tracks(t):
    """Every vehicle detection belongs to one image track."""
    return image_tracks(t).where("track_id >= 1").select("camera", "quad", "frame", "det_id")


@query()
def moving_tracks(t):
    """Tracks with three points and real displacement."""
    return K.moving_tracks(image_tracks(t)).select("camera", "quad", "track_id", "pts", r("dx").alias("dx"), r("dz").alias("dz"))


@query(with_views("detections") + """, p AS (SELECT camera, quad, cls AS track_id, count(*) AS pts, arg_max({'u': u, 'v': v}, {'f': frame, 'i': det_id}) AS b, arg_min({'u': u, 'v': v}, {'f': frame, 'i': det_id}) AS a,
 avg(u) AS mid_u, avg(v) AS mid_v, max(frame) - min(frame) AS frames FROM fx_detections GROUP BY ALL) SELECT camera, quad, track_id, pts, round(b.u-a.u,6)+0.0 AS dx, round(b.v-a.v,6)+0.0 AS dz, round(mid_u,6)+0.0 AS mid_u, round(mid_v,6)+0.0 AS mid_v, frames FROM p
 WHERE pts >= 3 AND sqrt(pow(b.u-a.u,2)+pow(b.v-a.v,2)) >= 0.06""")
def moving_classes(t):
    """Net displacement of each class of a view, as one track each."""
    out = K.moving_tracks(t.detections.withColumn("track_id", F.col("cls")))
    return out.select("camera", "quad", "track_id", "pts", *[r(c).alias(c) for c in ("dx", "dz", "mid_u", "mid_v")], "frames")


@query()
def propose_pairs(t):
    """Image to road seeds of every camera near a road."""
    cams = t.targets.groupBy((F.col("target_id") % 8).alias("camera")).agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    out = K.propose_pairs(K.moving_tracks(image_tracks(t)), road_segments(t), cams)
    return out.select("camera", "quad", "pair", r("u").alias("u"), r("v").alias("v"), r("x", 4).alias("x"), r("z", 4).alias("z"), "side")


@query()
def flow_window(t):
    """Flow directions per camera, quad and window of twelve seconds, at two frames a second."""
    out = ST.flow_window(t.detections.withColumn("ts", F.timestamp_seconds(F.col("frame") / 2)), 12)
    return out.select("camera", "window_start", "quad", "side", "count", r("dir_x", 5).alias("dir_x"), r("dir_z", 5).alias("dir_z"), r("speed", 5).alias("speed"))
