"""File formats: round trips and the odd inputs they must take."""

import json

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from metroframe.operators.rasters import grid_chunk
from metroframe.sources import files as S


def test_point_chunks(spark, tmp_path):
    pts = spark.range(500).select(*[(F.col("id") * k % 97).cast("float").alias(c) for c, k in (("x", 3), ("y", 5), ("z", 7))], *[(F.col("id") % 200).cast("short").alias(c) for c in "rgba"])
    chunked = grid_chunk(pts, (0.0, 0.0, 97.0, 97.0), max_per_cell=10)
    written = S.write_point_bins(chunked, str(tmp_path / "bins")).agg(F.sum("count")).first()[0]
    back = S.read_point_chunks(spark, str(tmp_path / "bins" / "*.bin")).drop("path")
    assert written == 500 and back.exceptAll(pts.select(*back.columns)).isEmpty() and back.count() == 500
    manifest = S.write_point_chunks(chunked.withColumn("tile", F.col("chunk")), str(tmp_path / "pq"))
    assert manifest.agg(F.sum("count")).first()[0] == 500
    (tmp_path / "short.bin").write_bytes(np.uint32(9).tobytes() + b"\0" * 20)
    with pytest.raises(PythonException, match="truncated"):
        S.read_point_chunks(spark, str(tmp_path / "short.bin")).count()


def test_layer_files_of_both_forms(spark, tmp_path):
    cams = spark.createDataFrame([(f"c{i}",) for i in range(5)], "id string")
    layer, field = "cameras", spark.createDataFrame([], f"r {S.schemas.LAYERS['cameras']}").schema["r"].dataType.names[0]
    S.write_layer_json(cams.withColumnRenamed("id", field), str(tmp_path / "mixed"), layer)
    (tmp_path / "mixed" / "whole.json").write_text(json.dumps({layer: [{field: "w1"}, {field: "w2"}]}, indent=2))
    got = {r[field] for r in S.read_layer_json(spark, str(tmp_path / "mixed"), layer).select(field).collect()}
    assert got == {"c0", "c1", "c2", "c3", "c4", "w1", "w2"}


def test_meshes_and_rings(spark, tmp_path):
    pos = np.arange(21, dtype="<f4").reshape(7, 3) ** 2
    raw = np.array([7, 0], "<u4").tobytes() + pos.tobytes()
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "b.bin").write_bytes(raw[:40])
    v = S.read_mesh_vertices(spark, str(tmp_path / "a.bin")).orderBy("i").collect()
    assert [(r.x, r.y, r.z) for r in v] == [tuple(p) for p in pos.tolist()]
    rings = S.read_footprint_bins(spark, str(tmp_path / "*.bin"), (1.0, 2.0, 0.0)).collect()
    assert len(rings) == 1 and [(p.x, p.z) for p in rings[0].ring] == [((float(a) - 1) / 100, (float(b) - 2) / 100) for a, b, _ in pos[:3]]


def test_grids(spark, tmp_path):
    spec = {"cell": 8.0, "x0": 0.0, "z0": 0.0, "nx": 3, "nz": 2}
    dense = np.array([[1, np.nan, 3], [4, 5, np.nan]], "<f4")
    dense.tofile(tmp_path / "g.f32")
    cells = S.read_dense_grid(spark, str(tmp_path / "g.f32"), spec)
    assert {(r.ix, r.iz, r.y) for r in cells.collect()} == {(0, 0, 1.0), (2, 0, 3.0), (0, 1, 4.0), (1, 1, 5.0)}
    S.write_grid(cells, spec, str(tmp_path / "grid"))
    back, spec2 = S.read_grid(spark, str(tmp_path / "grid"))
    assert spec2 == spec and back.count() == 4


def test_gtfs_with_bom_and_missing_table(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,stop_lat,stop_lon,location_type\nA, Main ,38.0,-84.5,\nB,Station,38.0,-84.5,1\nC,Bad,x,-84.5,0\n", encoding="utf-8")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name,route_color,route_sort_order\n1, 5 ,,12\n2,6,00ff00,x\n", encoding="utf-8")
    g = S.read_gtfs(spark, str(tmp_path))
    assert [(r.stop_id, r.name) for r in S.gtfs_stops(g["stops"]).collect()] == [("A", "Main")]
    assert {(r.route_id, r.short_name, r.color, r.sort_order) for r in S.gtfs_routes(g["routes"]).collect()} == {("1", "5", "3b82c4", 12), ("2", "6", "00ff00", 9999)}
    assert g["trips"].count() == 0 and g["stop_times"].columns == ["stop_id", "trip_id"]


def test_documents(spark, tmp_path):
    osm = {"elements": [{"type": "node", "id": 1, "lon": -84.5, "lat": 38.0}, {"type": "way", "id": 2, "nodes": [1], "tags": {"highway": "primary"}}, {"type": "relation", "id": 3, "members": [{"type": "way", "ref": 2, "role": "outer"}]}]}
    (tmp_path / "osm.json").write_text(json.dumps(osm, indent=1))
    nodes, ways, rel = S.read_osm(spark, str(tmp_path / "osm.json"))
    assert nodes.first().lat == 38.0 and ways.first().tags == {"highway": "primary"} and rel.first().members[0].ref == 2
    gj = {"features": [{"geometry": {"type": "Point", "coordinates": [-84.5, 38.0]}, "properties": {"a": "b"}}, {"geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(gj, indent=1))
    assert [(r.lon, r.lat) for r in S.read_geojson_points(spark, str(tmp_path / "s.geojson")).collect()] == [(-84.5, 38.0)]
    roads = {"roads": [{"pts": [[1, 2, 3], [4, 5, 6]], "width": 7, "class": "primary", "name": "Main"}], "intersections": []}
    (tmp_path / "roads.json").write_text(json.dumps(roads))
    assert S.read_layer_json(spark, str(tmp_path / "roads.json"), "roads").first().pts == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    feed = {"Header": {"Timestamp": 5}, "Entities": [{"Id": "1", "Alert": {"cause": 10}}]}
    (tmp_path / "alert.json").write_text(json.dumps(feed))
    assert S.read_gtfs_rt(spark, str(tmp_path / "alert.json"), "alerts").first().e.Alert.cause == 10


def test_calibration_fit_reproduces_itself(spark, tmp_path):
    from metroframe.operators.calibration import fit_homography

    h = [245.4, -167.3, 666.4, 2837.2, -1488.5, 7440.9, 0.378, -0.199, 1.0]
    pts = []
    for u, v in ((0.1, 0.2), (0.9, 0.3), (0.8, 0.9), (0.2, 0.7), (0.5, 0.5)):
        w = h[6] * u + h[7] * v + 1
        pts.append({"img": [u, v], "scene": [(h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w]})
    doc = {"version": 1, "cameras": {"c": {"intersection": "i", "quads": {"1": {"H": h, "points": pts, "reprojError": 0.0}, "2": {"H": h[:5]}}}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    cal = S.read_calibration(spark, str(tmp_path / "c.json"))
    assert [(r.camera, r.quad) for r in cal.collect()] == [("c", 1)]
    pairs = cal.select("camera", "quad", F.explode("points").alias("p")).select("camera", "quad", F.col("p.img")[0].alias("u"), F.col("p.img")[1].alias("v"), F.col("p.scene")[0].alias("x"), F.col("p.scene")[1].alias("z"))
    fit = fit_homography(pairs, ["camera", "quad"]).first()
    assert np.allclose(fit.h, h, rtol=1e-6) and fit.max_residual < 1e-4
    flat = pairs.withColumn("v", F.col("u"))
    assert fit_homography(flat, ["camera", "quad"]).first().h is None
    new = cal.withColumn("reproj", F.lit(9.0)).unionByName(cal.withColumn("quad", F.lit(3)))
    assert sorted((r.quad, r.reproj) for r in S.upsert_calibration(cal, new).collect()) == [(1, 9.0), (3, 0.0)]


def test_episode_log(spark, tmp_path):
    for k in (1, 2):
        lines = [{"meta": {"seed": k, "steps": 50, "success": True}}] + [{"action": [0.1], "reward": float(i * k), "terminated": False, "truncated": False} for i in range(50)]
        (tmp_path / f"e{k}.jsonl").write_text("\n".join(json.dumps(v) for v in lines))
    episodes, steps = S.read_episode_log(spark, str(tmp_path / "*.jsonl"))
    assert sorted(r.seed for r in episodes.collect()) == [1, 2]
    joined = steps.join(episodes.select("episode", "seed"), "episode")
    assert joined.where(F.col("reward") != F.col("step") * F.col("seed")).isEmpty() and joined.count() == 100


def test_manifest_aliases(spark, tmp_path):
    m = {"lidar": {"offset_cm": [1, 2, 3], "chunks": [{"path": "p.bin", "points": 4}, {}]}, "tiles": [{"name": "t", "jpg": "j.jpg"}, {"visible": False}], "buildings": {"tiles": [{"name": "b", "heightCm": 5, "groundYm": 0.5}]}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    d = S.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.name, r.mesh, r.texture, r.visible) for r in d["tiles"].orderBy("i").collect()] == [("t", "meshes/t.bin", "j.jpg", True), ("tile_1", "meshes/tile_1.bin", "textures/tile_1.jpg", False)]
    assert [(r.file, r["count"]) for r in d["chunks"].orderBy("i").collect()] == [("p.bin", 4), ("lidar/chunk_001.bin", None)]
    b = d["buildings"].first()
    assert (b.height_cm, b.ground_y_m, b.bridge) == (5.0, 0.5, False) and d["origin"].first()[0] == [1.0, 2.0, 3.0]
