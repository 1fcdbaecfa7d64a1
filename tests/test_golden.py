"""Literal expectations for the Column math and the tracker kernels."""

import math

import pytest
from pyspark.sql import functions as F

from metroframe.functions import angles, camera, geo, scalars
from metroframe.operators.lookups import bilinear_sample
from metroframe.operators.polylines import settled_value
from metroframe.operators.tracks import merge_cross_view

CORNERS = [
    (-84.614899, 37.960404, -9709.685573200462, 8751.947804004885),
    (-84.394988, 38.120465, 9114.759249502094, -9529.642774366774),
    (-84.614899, 38.120465, -10165.603037427645, -9011.011665766127),
    (-84.394988, 37.960404, 9612.789347421727, 8234.036341561936),
]
ELEMENTS = [
    0.9965012826316548, 0.07540847331370641, 0.032264993455353504, 0.0,
    0.07925076557576816, -0.7838558061114713, -0.6156554761534254, 0.0,
    -0.02113726107689028, 0.6161378995927309, -0.7871909417773663, 0.0,
    -843.6174901865147, -6369164.875048548, -21120.116280738614, 1.0,
]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("lon,lat,sx,sz", CORNERS)
def test_projection_corners(spark, lon, lat, sx, sz):
    x, z = geo.lonlat_to_scene(F.lit(lon), F.lit(lat), 719242.59, 4212857.25)
    e, n = geo.lonlat_to_utm16n(F.lit(lon), F.lit(lat))
    row = one(spark, x.alias("x"), z.alias("z"), *[c.alias(a) for c, a in zip(geo.utm16n_to_lonlat(e, n), ("lon", "lat"))])
    assert abs(row.x - sx) < 0.01 and abs(row.z - sz) < 0.01
    assert abs(row.lon - lon) < 1e-9 and abs(row.lat - lat) < 1e-9


@pytest.mark.parametrize("lon,lat,sx,sz", CORNERS)
def test_affine_on_ecef(spark, lon, lat, sx, sz):
    ecef = geo.geodetic_to_ecef(F.lit(lon), F.lit(lat), F.lit(236.5))
    x, _, z = geo.apply_affine4(ELEMENTS, *ecef)
    row = one(spark, x.alias("x"), z.alias("z"))
    assert math.hypot(row.x - sx, row.z - sz) <= 5.0


def test_state_plane_origin(spark):
    lon, lat = geo.stateplane_ky_to_lonlat(F.lit(4921250.0), F.lit(3280833.333333333))
    row = one(spark, lon.alias("lon"), lat.alias("lat"))
    assert abs(row.lon + 85.75) < 1e-8 and abs(row.lat - (36 + 20 / 60)) < 1e-8


@pytest.mark.parametrize("dx,dz,deg", [(1, 0, 0), (0, -1, 90), (-1, 0, 180), (0, 1, -90)])
def test_heading(spark, dx, dz, deg):
    assert one(spark, angles.heading_from_motion(F.lit(float(dx)), F.lit(float(dz))))[0] == pytest.approx(deg)


def test_tire_point_through_homography(spark):
    h = F.array(*[F.lit(float(v)) for v in (30, 0, 100, 0, 20, 200, 0, 0, 1)])
    u, v = camera.tire_point(F.array(*[F.lit(float(c)) for c in (300, 150, 340, 360)]), 640, 360)
    x, z = camera.apply_homography(h, u, v)
    assert tuple(one(spark, x, z)) == (115.0, 220.0)


def test_singular_homography_is_null(spark):
    h = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 2, 4, 6, 1, 1, 1)])
    x, _ = camera.apply_homography(F.array(*[F.lit(0.0)] * 9), F.lit(1.0), F.lit(1.0))
    assert tuple(one(spark, camera.invert_homography(h), x)) == (None, None)


def test_md5_offset_and_hue(spark):
    import hashlib

    row = one(spark, scalars.hash_offset(F.lit("int_0007"), F.lit(88)), scalars.hash_hue(F.lit("Route 12")))
    h = 0
    for ch in "Route 12":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    assert row[0] == int(hashlib.md5(b"int_0007").hexdigest(), 16) % 88 and row[1] == h % 360


@pytest.mark.parametrize("x,z,v", [(0, 0, 0), (10, 10, 30), (5, 0, 5), (5, 5, 15), (2.5, 2.5, 7.5), (-100, -100, 0)])
def test_bilinear(spark, x, z, v):
    nodes = spark.createDataFrame([(0, 0, 0.0), (1, 0, 10.0), (0, 1, 20.0), (1, 1, 30.0)], "i int, j int, v double")
    spec = {"cols": 2, "rows": 2, "x0": 0.0, "z0": 0.0, "cell": 10.0}
    at = spark.createDataFrame([(float(x), float(z))], "x double, z double")
    assert bilinear_sample(at, nodes, spec).first()["v"] == pytest.approx(v)
    part = bilinear_sample(at, nodes.where("i = 1 and j = 1"), spec).first()
    assert part["v"] == 30.0 and part["ready"]
    assert not bilinear_sample(at, nodes.where("i = 9"), spec).first()["ready"]


@pytest.mark.parametrize("samples,want", [([1.0, 1.1, 0.9, 1.05, 1.0], 1.0), ([1.0, 5.0, 1.0, 5.0, 1.0], None), ([1.0, 1.0], None), ([2.0, 2.0, 2.0, 8.0], None)])
def test_settle(spark, samples, want):
    assert one(spark, settled_value(F.array_sort(F.array(*[F.lit(s) for s in samples]))))[0] == want


def test_cross_view_merge(spark):
    rows = [(115.0, 220.0, 0, 2), (105.0, 215.0, 0, 2), (140.0, 230.0, 1, 7), (115.6, 220.3, 1, 2)]
    dets = spark.createDataFrame([("c", 0, i, x, z, q, k) for i, (x, z, q, k) in enumerate(rows)], "camera string, frame long, det_id int, x double, z double, quad int, cls int")
    out = merge_cross_view(dets).orderBy("cluster").collect()
    assert [(r.cls, r.quads) for r in out] == [(2, 2), (2, 1), (7, 1)]
    assert out[0].x == pytest.approx(115.3)


def test_detections_without_quad_join_any_cluster():
    from metroframe.operators.tracks import TrackState, merge_frame

    assert [r[:3] for r in merge_frame([0.0, 1.0], [0.0, 0.0], [None, None], [2, 2]).rows()] == [(0.5, 0.0, 2)]
    same = merge_frame([0.0, 1.0, 0.4], [0.0, 0.0, 0.0], [1, 1, None], [None, 3, 5])
    assert [(r[0], r[2], r[5]) for r in same.rows()] == [(0.2, 2, 2), (1.0, 1, 1)] and same.cls[0] == 5
    t = TrackState()
    assert [r[0] for r in t.update(0, merge_frame([0.0, 20.0], [0.0, 0.0], [0, 0], [2, 2]))] == [1, 2]
    assert [(r[0], round(r[3], 6)) for r in t.update(1, merge_frame([1.0], [0.0], [1], [2]))] == [(1, 0.0)]
    assert t.next_id >= 3
