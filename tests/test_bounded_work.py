"""Steps whose rows must not grow with work that the result does not need."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from metroframe.catalog.registry import r, r_many
from metroframe.operators import calibration, graph, polygons, spatial, tracks
from metroframe.plans import search
from metroframe.streaming import state as SS


def test_small_cells_are_judged_in_the_join(spark):
    """no pair of a point and a ring is handed to Python where its cell has few edges."""
    ring = "array(struct(0D AS x, 0D AS z), struct(9D AS x, 0D AS z), struct(9D AS x, 6D AS z), struct(0D AS x, 6D AS z))"
    rings = spark.range(3).selectExpr("id AS poly", f"{ring} AS ring")
    points = spark.range(400).selectExpr("id AS pid", "id % 20 - 5D AS x", "id div 20 - 5D AS z")
    out = spatial.points_in_polygons(points, rings, 1.0)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    near = {(r.pid) for r in points.collect() if np.hypot(max(-r.x, r.x - 9, 0), max(-r.z, r.z - 6, 0)) <= 1}
    assert {(r.pid, r.poly) for r in out.collect()} == {(p, k) for p in near for k in range(3)}


def test_long_segments_stop_the_pyramid(spark, monkeypatch):
    """cells are not made much narrower than the segments, and the nearest one is still exact."""
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 100, (3000, 2))
    b = a + rng.uniform(-20, 20, (3000, 2))
    rows = [(k, *map(float, (*p, *q))) for k, (p, q) in enumerate(zip(a, b))]
    segs = spark.createDataFrame(rows, "seg long, ax double, az double, bx double, bz double")
    at = rng.uniform(-10, 110, (60, 2))
    points = spark.createDataFrame([(k, float(x), float(z)) for k, (x, z) in enumerate(at)] + [(99, 900.0, 900.0)], "pid long, x double, z double")
    depths, leaves = [], search._leaves
    monkeypatch.setattr(search, "_leaves", lambda *v: depths.append(v[-1]) or leaves(*v))
    got = {r.pid: (r.seg, r.dist) for r in spatial.nearest_segment(points, segs, "pid", ["seg"], 120.0, ["seg"]).collect()}
    assert max(depths) <= 2
    assert got.pop(99) == (None, None)
    for k, p in enumerate(at):
        t = (((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1)).clip(0, 1)
        gap = np.hypot(*(a + t[:, None] * (b - a) - p).T)
        assert got[k][0] == gap.argmin() and abs(got[k][1] - gap.min()) < 1e-9


def test_filled_cells_spare_pairs(spark, monkeypatch):
    """most points under many roads meet no rectangle at all."""
    rng = np.random.default_rng(2)
    rows = [(float(x), float(z), float(x + u), float(z + v), 7.0) for x, z, u, v in zip(*rng.uniform(0, 60, (2, 300)), *rng.uniform(-15, 15, (2, 300)))]
    rows += [(5.0, 5.0, 5.0, 5.0, 7.0), (70.0, 70.0, 80.0, 70.0, None)]
    segs = spark.createDataFrame(rows, "ax double, az double, bx double, bz double, width double")
    at = [(k, float(x), float(z)) for k, (x, z) in enumerate(rng.uniform(-5, 85, (800, 2)))] + [(900, 75.0, 70.5), (901, None, 1.0)]
    asked, inner = [], polygons.points_in_boxes
    monkeypatch.setattr(polygons, "points_in_boxes", lambda p, *v: asked.append(p.count()) or inner(p, *v))
    points = spark.createDataFrame(at, "pid long, x double, z double")
    got = sorted(r.pid for r in polygons.road_surface_hit(points, segs, "pid").collect())
    want = set()
    for ax, az, bx, bz, w in rows:
        n, half = np.hypot(bx - ax, bz - az), max(w or 1.0, 1.0) / 2
        for k, x, z in at:
            if n and x is not None and 0 <= ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / n <= n and abs((bx - ax) * (z - az) - (bz - az) * (x - ax)) / n <= half:
                want.add(k)
    assert got == sorted(want)
    assert asked[0] < len(at) - 0.7 * len(want)


def test_routes_from_one_place_share_a_search(spark, monkeypatch):
    """forty pairs that start at one node store no more rows than one of them."""
    nodes = spark.createDataFrame([(i, float(i * 10), 0.0) for i in range(12)], "node long, x double, z double")
    edges = spark.createDataFrame([(a, b, 10.0) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, w double")
    pairs = spark.createDataFrame([(k, 0.0, 1.0, 110.0 - k % 3 * 10, 0.0) for k in range(40)], "pair_id long, sx double, sz double, gx double, gz double")
    most, store = [0], graph.materialize

    def counted(df):
        out = store(df)
        if "hop" in out.columns:
            most.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    got = {r.pair_id: r for r in graph.shortest_path(nodes, edges, pairs).collect()}
    assert max(most) == 12 and len(got) == 40
    assert all(got[k].path == list(range(12 - k % 3)) and got[k].length == 111.0 - k % 3 * 10 for k in got)


def test_seeds_are_picked_from_one_stored_table(spark, monkeypatch):
    """the flows are stored once, not again in each round."""
    flows = spark.range(30).selectExpr(
        "0 AS camera", "id % 2 AS quad", "id AS track_id", "0.2D + id / 100 AS dx", "0.01D AS dz", "id / 30 AS mid_u", "0.5D AS mid_v")
    roads = spark.createDataFrame([(0.0, 0.0, 50.0, 0.0)], "ax double, az double, bx double, bz double")
    stored, store = [], tracks.materialize
    monkeypatch.setattr(tracks, "materialize", lambda df: stored.append(df.columns) or store(df))
    out = tracks.propose_pairs(flows, roads, spark.createDataFrame([(0, 20.0, 5.0)], "camera int, x double, z double")).collect()
    assert sum("_s" in c for c in stored) == 1
    for quad in (0, 1):
        u = [r.u for r in sorted(out, key=lambda r: r.pair) if r.quad == quad]
        assert len(u) == 8 and np.allclose(u, [(quad + 2 * i) / 30 for i in range(8)])


def test_crowded_groups_are_settled_by_cells(spark, monkeypatch):
    """a group with two points in one cell is not searched for neighbours; the verdicts are those of the search."""
    grid = [(g, i * 8 + j, i / 8, j / 8) for g in range(3) for i in range(8) for j in range(8)]
    grid += [(0, 100, 0.5, 0.50001), (1, 100, 0.5, 0.5009)]  # one cell, and two cells
    pairs = spark.createDataFrame(grid, "g long, pair long, u double, v double").withColumn("x", F.col("u") * 9).withColumn("z", F.col("v") * 7)
    asked, inner = [], spatial.nearest_join
    monkeypatch.setattr(spatial, "nearest_join", lambda left, *v, **k: asked.append({r.g for r in left.select("g").distinct().collect()}) or inner(left, *v, **k))
    assert [r.g for r in calibration.calibration_gate(pairs, ["g"]).collect()] == [2]
    assert asked == [{1, 2}]


class _Held:
    def __init__(self):
        self.rows = {}

    def iterator(self):
        return iter(self.rows.items())

    def keys(self):
        return list(self.rows)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value


def test_tracker_hands_on_results_as_they_come(spark, monkeypatch):
    """the rows of a micro-batch do not wait for its end, and are those of one pass in order."""
    rng = np.random.default_rng(3)
    dets = pd.DataFrame({"frame": np.repeat(np.arange(60.0), 5), "det_id": np.arange(300), "x": rng.uniform(0, 40, 300), "z": rng.uniform(0, 40, 300),
                         "quad": rng.integers(0, 4, 300), "cls": rng.integers(1, 8, 300)})
    dets.loc[7, "frame"] = np.nan
    mixed = dets.sample(frac=1, random_state=1)
    monkeypatch.setattr(SS, "_OUT_ROWS", 50, raising=False)
    t = SS._Tracker(4.0, 8.0, 10)
    t.tracks, t.next = _Held(), _Held()
    parts = list(t.handleInputRows((1,), iter([mixed[:100], mixed[100:101], mixed[101:]]), None))
    assert max(map(len, parts)) < 60 and len(parts) > 4
    state, want = tracks.TrackState(), []
    for f, g in dets.dropna().groupby("frame"):
        want += [(1, int(f), *r) for r in state.update(int(f), tracks.merge_frame(*[g[c].tolist() for c in ("x", "z", "quad", "cls")]), 8.0, 10)]
    assert [tuple(r) for r in pd.concat(parts).itertuples(index=False)] == want


def test_pairs_of_one_cell_are_many_tasks(spark, monkeypatch):
    """the rows of a crowded cell are dealt over blocks and tasks; copies, repeated ids and missing values as before."""
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k // 2 if k < 20 else k, float(x), float(z)) for k, (x, z) in enumerate(rng.uniform(0, 12, (200, 2)).round(1))]
    rows += [(500 + k, 3.0, 4.0) for k in range(40)] + [(600 + k, float(x), 30.0 + k) for k, x in enumerate(rng.uniform(-40, 40, 60))]
    rows += [rows[-1], (700, None, 1.0), (None, 1.0, 1.0), (701, float("nan"), 1.0), (702, -6.0, 4.0), (703, 12.0, 4.0)]
    sites = spark.createDataFrame(rows, "id long, x double, z double").coalesce(1)
    out = spatial.self_within_distance(sites, 9.0, "id")
    assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    got = sorted((p.a, p.b, round(p.dist, 9)) for p in out.collect())
    known = [p for p in rows if p[0] is not None and p[1] is not None]
    want = [
        (min(i, j), max(i, j), round(float(np.hypot(x - u, z - v)), 9))
        for k, (i, x, z) in enumerate(known) for j, u, v in known[k + 1:] if i != j and (x - u) ** 2 + (z - v) ** 2 <= 81
    ]
    assert got == sorted(want)


def test_many_numbers_round_as_few(spark):
    """rounding by whole numbers gives what ``round`` gives, near ties and out of range too."""
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.5e-6, -2.5e-6, 1.4999995, 1e5 + 0.4999995, 1e12 + 0.1, -1e300, 1e300, float("nan"), float("inf"), float("-inf"), None]
    values = odd + [float(v) for v in rng.uniform(-20, 20, 3000)] + [k / 1e7 for k in range(-500, 500)] + [float(np.sqrt(k) / 10) for k in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", r_many("v").alias("got"), r("v").alias("want"))
    assert df.where("NOT (got <=> want)").collect() == []
    assert [str(p.got) for p in df.collect()] == [str(p.want) for p in df.collect()]
