"""Joins whose work must not grow with rows that cannot change the result."""

import numpy as np
from pyspark.sql import functions as F

from metroframe.operators import spatial as D

BOX = "box_id long, x0 double, x1 double, z0 double, z1 double"
PLACE = "road_id long, x double, z double"


def crossed(rows, boxes):
    found = set()
    for b in {b[0] for b in boxes}:
        for road in {r[0] for r in rows}:
            sides = set()
            for _, x0, x1, z0, z1 in (q for q in boxes if q[0] == b):
                for _, x, z in (r for r in rows if r[0] == road and x0 <= r[1] <= x1 and z0 <= r[2] <= z1):
                    mx, mz = (x0 + x1) / 2, (z0 + z1) / 2
                    sides |= {s for s, on in zip("wens", (x < mx, x > mx, z < mz, z > mz)) if on}
            if {"w", "e"} <= sides or {"n", "s"} <= sides:
                found.add((b, road))
    return found


def test_road_crosses_box_in_one_row(spark):
    """Boxes of many sizes, copies of a box, ids with two places; and no pair of a vertex and a box is grouped."""
    rng = np.random.default_rng(3)
    rows = [(int(k // 9), *map(float, rng.integers(-40, 40, 2) + k // 90 * 3)) for k in range(900)]
    boxes = []
    for k in range(120):
        x, z = rng.integers(-40, 60, 2) / 2
        w, h = rng.choice([0.0, 0.5, 4.0, 8.0, 30.0], 2)
        boxes.append((k % 110, float(x), float(x + w), float(z), float(z + h)))
    boxes += boxes[:5]
    v, b = spark.createDataFrame(rows, PLACE), spark.createDataFrame(boxes, BOX)
    out = D.road_crosses_box(v, b, "box_id", "road_id").collect()
    assert len(out) == len({tuple(r) for r in out})
    assert {tuple(r) for r in out} == crossed(rows, boxes)
    plan = D._road_crosses_place(v, b, "box_id", "road_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_first_polygon_looks_at_few(spark):
    """Hundreds of rings over one place: those above a ring that fills a cell are left out there, with the same result."""
    rng = np.random.default_rng(5)
    polys = []
    for k, (x, z) in enumerate(rng.uniform(20, 30, (200, 2))):
        h = float(rng.uniform(4, 12))
        polys.append((k, [(float(x + i * h), float(z + j * h)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
    rings = spark.createDataFrame(polys, "poly long, ring array<struct<x: double, z: double>>")
    places = [(k, float(x), float(z)) for k, (x, z) in enumerate(rng.uniform(0, 50, (400, 2)))]
    points = spark.createDataFrame(places, "pid long, x double, z double")
    got = {r.pid: r.poly for r in D.points_in_polygons(points, rings, mode="first", order="poly", point_id="pid").collect()}
    every = D.points_in_polygons(points, rings).groupBy("pid").agg(F.min("poly").alias("poly"))
    assert got == {r.pid: r.poly for r in every.collect()}
    cells = D.materialize(D.cover(rings, "ring"))
    assert D._unbeaten(cells, "poly").count() < cells.count() / 2


def test_box_pairs_are_made_by_all_tasks(spark):
    """both sides of a box join are dealt out before they meet, although each is one partition here."""
    side = lambda p, n: spark.range(0, n, 1, 1).selectExpr(f"id AS {p}_id", *[f"id * {k} % 50 + {j}D AS {p}_{c}" for k, j, c in ((7, 0, "x0"), (7, 3, "x1"), (0, 0, "y0"), (0, 2, "y1"), (11, 0, "z0"), (11, 3, "z1"))])
    out = D.aabb_overlap(side("a", 60), side("b", 70))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") >= 2
    want = sum(abs(i * 7 % 50 - j * 7 % 50) < 3 and abs(i * 11 % 50 - j * 11 % 50) < 3 for i in range(60) for j in range(70))
    assert out.count() == want > 50


def test_crossed_boxes_need_one_road(spark, monkeypatch):
    """boxes that cannot be bridges meet no road, and those that a first few roads cross meet no others."""
    from metroframe.operators import aggregates as A

    rows = [(k, 0.0, 10.0, 0.0, 10.0, 5.0 if k % 2 else 0.0) for k in range(40)] + [(k, 500.0, 510.0, 0.0, 10.0, 5.0) for k in (100, 101)] + [(102, 800.0, 810.0, 0.0, 10.0, 5.0), (103, 0.0, 10.0, 0.0, 10.0, None)]
    boxes = spark.createDataFrame(rows, "box_id int, x0 double, x1 double, z0 double, z1 double, base_y double")
    near = [(k, x, 5.0) for k in range(400) for x in (1.0, 9.0)]
    roads = spark.createDataFrame(near + [(1000, x, 5.0) for x in (501.0, 509.0)] + [(7, 802.0, 3.0)], "road_id long, x double, z double")
    asked, inner = [], A.road_crosses_box
    monkeypatch.setattr(A, "road_crosses_box", lambda v, b, *k: asked.append((v.count(), b.count())) or inner(v, b, *k))
    got = {r.box_id: r.bridge for r in A.footprint_ground(boxes, lambda d: d.withColumn("v", d.z * 0), roads).collect()}
    assert got == {k: (None if b is None else b > 2.5 and x < 700) for k, x, _, _, _, b in rows}
    assert asked[0][1] == 24 and asked[0][0] < 60 and asked[1][1] <= 3


def test_small_frames_meet_without_a_pyramid(spark, monkeypatch):
    """only frames of many rows go through the pyramid; both kinds give the nearest other row."""
    import numpy as np

    from metroframe.operators import aggregates as A

    rng = np.random.default_rng(8)
    at = rng.uniform(0, 100, (700, 2)).round(1)
    rows = [(0 if k < 600 else 1 + k % 3, k, float(x), float(z), 0.3) for k, (x, z) in enumerate(at)]
    rows += [(9, 900, 1.0, 1.0, 0.0), (1, 901, None, 1.0, 0.0), (1, 902, float("nan"), 1.0, 0.0), (None, 903, 1.0, 1.0, 0.0), (None, 904, 1.0, 1.0, 0.0)]
    poses = spark.createDataFrame(rows, "frame int, id int, x double, z double, yaw double")
    asked, inner = [], D.best_item
    monkeypatch.setattr(D, "best_item", lambda left, items, *v: asked.append(items.select("frame").distinct().collect()) or inner(left, items, *v))
    got = {r.id: (r.other_id, r.dist) for r in D.nearest_other(poses, "id", ["frame"]).collect()}
    assert asked == [[(0,)]]
    gaps = {}
    for f, k, x, z, _ in rows:
        near = [((x - u) ** 2 + (z - v) ** 2, j) for g, j, u, v, _ in rows if f is not None and g == f and j != k and None not in (x, u) and not {x, u} & {float("nan")} and u == u and x == x]
        best = min(near, default=(None, None))
        if best[0] is not None:
            gaps[f] = min(gaps.get(f, np.inf), best[0] ** 0.5)
        if best[0] is None or best[0] >= 1600:
            assert got[k] == (None, None)
        else:
            assert got[k][0] == best[1] and abs(got[k][1] - best[0] ** 0.5) < 1e-9
    least = {r.frame: r.min_gap for r in A.min_gap(poses, "id", ["frame"]).collect()}
    assert {k: round(v, 9) for k, v in least.items() if v is not None} == {k: round(v, 9) for k, v in gaps.items()}
