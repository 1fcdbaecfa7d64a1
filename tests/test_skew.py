"""Operators against brute force on data where one place, cell or key holds a third of the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metroframe.operators.clustering import cluster_within, dbscan
from metroframe.operators.lookups import grid_nearest_fill
from metroframe.operators.polylines import dedupe_min_distance, resample_polyline
from metroframe.operators.rasters import hash_ranked_sample, stride_decimate
from metroframe.operators.sets import spacing_suppress
from metroframe.operators.spatial import corridor_ahead, nearest_join, points_in_polygons
from metroframe.plans.linkage import components
from metroframe.plans.ordered import block_of, fill_forward, running_total, with_neighbours
from metroframe.plans.select import exact_percentile


def hot_points(n=900, seed=5):
    """A third copies of one place, a third crowded in one small cell, a third spread out."""
    rng = random.Random(seed)
    pts = [(50.0, 50.0)] * (n // 3)
    pts += [(20 + rng.random() * 0.7, 20 + rng.random() * 0.7) for _ in range(n // 3)]
    pts += [(rng.random() * 100, rng.random() * 100) for _ in range(n // 3)]
    return [(i, x, z) for i, (x, z) in enumerate(pts)]


def frame(spark, rows, parts=7):
    return spark.createDataFrame(rows, "id long, x double, z double").repartition(parts)


def reference_dbscan(rows, eps, m):
    xy = np.array([r[1:] for r in rows])
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(rows)), len(rows))
    while True:
        spread = np.where(near & core[None], label[None], len(rows)).min(1)
        new = np.where(core, np.minimum(label, spread), len(rows))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(rows)).min(1)
    return [(i, None if b == len(rows) else int(b), "core" if c else "noise" if b == len(rows) else "border") for i, (b, c) in enumerate(zip(border, core))]


@pytest.mark.parametrize("eps,m", [(3.0, 4), (1.0, 10), (8.0, 3)])
def test_dbscan_with_crowded_cells(spark, eps, m):
    rows = hot_points()
    got = dbscan(frame(spark, rows), eps, m).select("id", "cluster", "kind").orderBy("id").collect()
    assert [tuple(r) for r in got] == reference_dbscan(rows, eps, m)


def test_linked_crowded_cells_are_halved(spark):
    """Two crowded cells whose boxes are undecided: linked by a single pair, or by none."""
    rng = random.Random(1)
    base = [(rng.random() * 0.6, rng.random() * 0.6) for _ in range(120)]
    for gap, clusters in ((1.0001, 1), (1.25, 2)):
        left = base + [(0.65, 0.35)]
        right = [(1.66 + (gap - 1.0) + x * 0.3, z) for x, z in base] + [(0.65 + gap, 0.35)]
        rows = [(i, x, z) for i, (x, z) in enumerate(left + right)]
        got = cluster_within(frame(spark, rows), 1.01, "id").select("cluster").distinct().count()
        want = len(set(c for _, c, _ in reference_dbscan(rows, 1.01, 1)))
        assert got == want == clusters


def test_chain_of_a_thousand(spark):
    nodes = spark.range(1000)
    edges = spark.range(999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(nodes, edges).select("comp").distinct().collect()[0][0] == 0


def test_nearest_join_brute_force(spark):
    right, left = hot_points(), hot_points(300, 9)
    got = {r.id: (r.nearest_id, r.dist) for r in nearest_join(frame(spark, left), frame(spark, right), "id", "id").collect()}
    for i, x, z in left:
        d, k = min((math.hypot(x - a, z - b), j) for j, a, b in right)
        assert got[i][0] == k and got[i][1] == pytest.approx(d)


def test_nearest_with_wild_items(spark):
    """A NaN, an infinite and a far-off item change nothing for the others, and the far one does not stretch the cells."""
    left, right = hot_points(60, 3), hot_points(400, 4)
    wild = [(9001, float("nan"), 0.0), (9002, 1.0, float("inf")), (9003, 1e12, -1e12)]
    plain = {r.id: (r.nearest_id, r.dist) for r in nearest_join(frame(spark, left), frame(spark, right), "id", "id").collect()}
    more = frame(spark, right).unionByName(spark.createDataFrame([dict(zip(("id", "x", "z"), w)) for w in wild], frame(spark, right).select("id", "x", "z").schema), allowMissingColumns=True)
    odd = frame(spark, left).unionByName(spark.createDataFrame([dict(zip(("id", "x", "z"), (9000, float("nan"), 1.0)))], frame(spark, left).select("id", "x", "z").schema), allowMissingColumns=True)
    got = {r.id: (r.nearest_id, r.dist) for r in nearest_join(odd, more, "id", "id").collect()}
    assert {k: v for k, v in got.items() if k != 9000} == plain and got.get(9000, (None, None)) == (None, None)


def test_scratch_can_be_dropped(spark):
    from metroframe.session import drop_scratch, materialize

    kept = materialize(spark.range(5))
    assert kept.count() == 5 and drop_scratch(spark)
    assert materialize(spark.range(3)).count() == 3


def test_nearest_other_copy(spark):
    rows = hot_points(90)
    f = frame(spark, rows)
    got = {r.id: r.o for r in nearest_join(f, f, "id", "id", exclude_self=True, out="o").collect()}
    for i, x, z in rows:
        assert got[i] == min((math.hypot(x - a, z - b), j) for j, a, b in rows if j != i)[1]


def test_corridor_brute_force(spark):
    rows, targets = hot_points(240, 3), hot_points(600, 4)
    df = frame(spark, rows).withColumn("yaw", F.col("id") % 7 * 0.9)
    got = {r.id: r.ahead_id for r in corridor_ahead(df, frame(spark, targets), "id", "id", 15.0, 3.0).collect()}
    for i, x, z in rows:
        fx, fz = math.cos(i % 7 * 0.9), -math.sin(i % 7 * 0.9)
        opts = [((a - x) * fx + (b - z) * fz, j) for j, a, b in targets if abs(-(a - x) * fz + (b - z) * fx) <= 3.0]
        opts = [o for o in opts if 0 < o[0] <= 15.0]
        want = min(opts)[0] if opts else None
        if want is None:
            assert got[i] is None
        else:
            _, a, b = targets[got[i]]
            assert (a - x) * fx + (b - z) * fz == pytest.approx(want)


def test_spacing_brute_force(spark):
    rows = hot_points(300)
    got = {r.id for r in spacing_suppress(frame(spark, rows), 6.0, "id", [-F.col("x")]).where("kept").collect()}
    kept = []
    for i, x, z in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(math.hypot(x - a, z - b) > 6.0 for _, a, b in kept):
            kept.append((i, x, z))
    assert got == {k[0] for k in kept}


def test_percentile_of_a_hot_key(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.full(400, 7.25), rng.normal(0, 40, 800)])
    df = spark.createDataFrame([(0 if i < 800 else i % 5, float(v)) for i, v in enumerate(vals)], "k int, v double")
    for r in exact_percentile(df, ["k"], "v", {"a": 0.15, "b": 0.85}).collect():
        mine = [v for i, v in enumerate(vals) if (0 if i < 800 else i % 5) == r.k]
        assert r.a == pytest.approx(np.percentile(mine, 15)) and r.b == pytest.approx(np.percentile(mine, 85))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, parts):
    f = frame(spark, hot_points(), parts).withColumn("k", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 5))
    one = frame(spark, hot_points(), 2).withColumn("k", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 5))
    for op in (lambda d: hash_ranked_sample(d, ["k"], 25, 3, ["id"]), lambda d: stride_decimate(d, 100, ["id"], block_of("id", 64)), lambda d: dbscan(d, 2.0, 4)):
        a, b = ({tuple(r) for r in op(d).select("id").collect()} for d in (f, one))
        assert a == b


def test_ordered_blocks_match_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("seq"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    a = with_neighbours(df, ["k"], ["seq"], ["v"], block_of("seq", 16)).select("seq", "prev_v", "next_v")
    assert a.exceptAll(df.select("seq", F.lag("v").over(w), F.lead("v").over(w))).isEmpty()
    b = running_total(df, ["k"], ["seq"], {"s": "v"}, block_of("seq", 16)).select("seq", "s")
    assert b.exceptAll(df.select("seq", F.sum("v").over(w))).isEmpty()
    holes = df.withColumn("v", F.when(F.col("seq") % 50 == 3, F.col("v")))
    c = fill_forward(holes, ["k"], ["seq"], "v", block_of("seq", 16), "f").select("seq", "f")
    assert c.exceptAll(holes.select("seq", F.last("v", True).over(w))).isEmpty()


def walk(n, seed=2):
    rng, x, z, out = random.Random(seed), 0.0, 0.0, []
    for i in range(n):
        x, z = x + rng.uniform(-1, 1.4), z + rng.uniform(-1, 1)
        out.append((0, i, x, z))
    return out


@pytest.mark.parametrize("keep_last", [False, True])
def test_thinning_one_long_line(spark, keep_last):
    pts = walk(400)
    got = sorted(r.seq for r in dedupe_min_distance(spark.createDataFrame(pts, "k int, seq long, x double, z double"), ["k"], 0.8, keep_last, not keep_last, block_of("seq", 32)).collect())
    out = [pts[0]]
    for p in pts[1:-1] if keep_last else pts[1:]:
        d = math.hypot(p[2] - out[-1][2], p[3] - out[-1][3])
        if d > 0.8 or (keep_last and d >= 0.8):
            out.append(p)
    if keep_last:
        last = pts[-1]
        if len(out) >= 2 and math.hypot(last[2] - out[-1][2], last[3] - out[-1][3]) < 0.8:
            out[-1] = last
        else:
            out.append(last)
    assert got == [p[1] for p in out]


def test_resample_one_long_line(spark):
    pts = walk(300)
    got = resample_polyline(spark.createDataFrame(pts, "k int, seq long, x double, z double"), ["k"], 2.5, block_of("seq", 16)).orderBy("s").collect()
    xs, zs = np.array([p[2] for p in pts]), np.array([p[3] for p in pts])
    s = np.r_[0, np.cumsum(np.hypot(np.diff(xs), np.diff(zs)))]
    want = np.r_[np.arange(0, s[-1], 2.5), s[-1]]
    assert np.allclose([r.s for r in got], want)
    assert np.allclose([r.x for r in got], np.interp(want, s, xs)) and np.allclose([r.z for r in got], np.interp(want, s, zs))


def test_polygon_with_a_notch(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    polys = spark.createDataFrame([(1, [{"x": float(x), "z": float(z)} for x, z in ring])], "poly long, ring array<struct<x: double, z: double>>")
    pts = spark.createDataFrame([(1, 5.0, 3.0), (2, 5.0, 8.0), (3, 10.0, 5.0), (4, 11.5, 5.0), (5, 50.0, 50.0)], "id long, x double, z double")
    assert {r.id for r in points_in_polygons(pts, polys).collect()} == {1, 3}
    assert {r.id for r in points_in_polygons(pts, polys, 2.0).collect()} == {1, 3, 4}


def test_gap_fill_takes_the_smallest_window(spark):
    cells = spark.createDataFrame([(2, 2, 5.0), (2, 3, 7.0), (6, 6, 9.0)], "ix long, iz long, y double")
    at = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.5, 2.5), (3, 4.5, 4.5), (4, -9.0, 0.0)], "id long, x double, z double")
    spec = {"cell": 1.0, "x0": 0.0, "z0": 0.0, "nx": 10, "nz": 10}
    got = {r.id: r.ground_y for r in grid_nearest_fill(at, cells, spec).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 7.0, 4: None}
