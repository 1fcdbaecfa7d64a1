"""Binary record files: ranges, patterns, commits."""

import os

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from metroframe.sources import files as S
from metroframe.sources import records as R


def test_ranges_cut_large_files_and_pack_small_ones():
    large = 5 * 2**30  # beyond what one binary cell can hold
    parts = R.packed([("big", large + 4)], 4, 16, 64 << 20)
    cuts = [p for part in parts for p in part.pieces]
    assert len(parts) == 80 and cuts[0][2] == 0 and cuts[-1][3] == large // 16
    assert all(a[3] == b[2] for a, b in zip(cuts, cuts[1:]))
    small = R.packed([(f"f{i}", 164) for i in range(1000)], 4, 16, 1640)
    assert len(small) == 100 and sum(len(p.pieces) for p in small) == 1000
    assert R.packed([("empty", 4), ("short", 1)], 4, 16, 100)[0].pieces == [("empty", 4, 0, 0), ("short", 1, 0, 0)]
    assert R.packed([], 4, 16, 100) == [] and [p.pieces for p in R.packed([("w", 1000)], 8, 12, 100, whole=True)] == [[("w", 1000, 0, 82)]]


def test_one_file_is_many_tasks(spark, tmp_path):
    rec = np.zeros(10_000, R.POINT)
    rec["x"] = np.arange(10_000)
    (tmp_path / "a.bin").write_bytes(np.uint32(9_990).tobytes() + rec.tobytes())  # ten records beyond the count
    df = S.read_point_chunks(spark, f"file:{tmp_path}/a.bin", split=16_000)
    assert df.rdd.getNumPartitions() == 10
    got = df.agg(F.count("*"), F.countDistinct("x"), F.max("x")).first()
    assert tuple(got) == (9_990, 9_990, 9_989.0)
    assert S.read_point_chunks(spark, f"file://{tmp_path}/*.bin").count() == 9_990


def test_patterns_folders_and_missing_paths(spark, tmp_path):
    for name in ("t1/a.bin", "t1/b.bin", "t2/a.bin", "t1/_x.bin", "t1/.y.bin", "t1/files.json"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(np.uint32(1).tobytes() + np.zeros(1, R.POINT).tobytes())
    count = lambda p: S.read_point_chunks(spark, f"{tmp_path}/{p}").count()
    assert (count("t1"), count("t1/a.bin"), count("*/a.bin"), count("t[12]/?.bin"), count("t3*/a.bin")) == (2, 1, 2, 3, 0)
    with pytest.raises(Exception, match="t9"):
        count("t9")


def test_chunks_go_on_in_further_files_and_nothing_else_is_left(spark, tmp_path):
    df = spark.range(2_500).select((F.col("id") % 3).alias("chunk"), F.col("id").cast("float").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    files = S.write_point_bins(df, str(tmp_path / "out"), most=400).collect()
    assert sum(f["count"] for f in files) == 2_500 and max(f["count"] for f in files) == 400 and len(files) == 9
    assert sorted(os.listdir(tmp_path / "out")) == sorted([os.path.basename(f.file) for f in files] + ["files.json"])
    back = S.read_point_chunks(spark, str(tmp_path / "out"))
    assert back.select("x").distinct().count() == 2_500 and back.where("a = 255 and r = 255").count() == 2_500
    chunk = F.regexp_extract("path", r"chunk_(\d+)", 1).cast("double")
    assert back.where(F.col("x") % 3 != chunk).isEmpty()


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    broken = spark.range(5_000).select((F.col("id") % 4).alias("chunk"), F.col("id").cast("float").alias("x"), F.lit(0.0).alias("y"), F.expr("if(id = 4999, raise_error('broken row'), 0.0)").alias("z"))
    with pytest.raises(Exception, match="broken row"):
        S.write_point_bins(broken, str(tmp_path / "out"), most=10)
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_empty_table_and_dense_grid_ranges(spark, tmp_path):
    none = spark.createDataFrame([], "chunk long, x float, y float, z float")
    assert S.write_point_bins(none, str(tmp_path / "none")).count() == 0
    assert S.read_point_chunks(spark, str(tmp_path / "none")).count() == 0
    grid = np.arange(70 * 30, dtype="<f4").reshape(30, 70)
    grid[3, 5] = np.nan
    grid.tofile(tmp_path / "g.f32")
    spec = {"nx": 70, "nz": 30}
    cells = S.read_dense_grid(spark, str(tmp_path / "g.f32"), spec, split=1_000)  # ranges that end inside rows
    assert cells.rdd.getNumPartitions() == 9 and cells.count() == 2_099 and cells.where("y != iz * 70 + ix").isEmpty()
    with pytest.raises(PythonException, match="truncated"):
        S.read_dense_grid(spark, str(tmp_path / "g.f32"), {"nx": 70, "nz": 31}).count()
