"""Coverings of rings: containment against plain ray casting, whatever the ring."""

import numpy as np
import pytest

from metroframe.operators.spatial import points_in_polygons

POLY = "poly long, ring array<struct<x: double, z: double>>"


def inside(ring, x, z, buffer=0.0):
    a, b = ring, np.roll(ring, -1, 0)
    d = b - a
    out = []
    for px, pz in zip(x, z):
        with np.errstate(divide="ignore", invalid="ignore"):
            over = ((a[:, 1] > pz) != (b[:, 1] > pz)) & (px < d[:, 0] * (pz - a[:, 1]) / d[:, 1] + a[:, 0])
            t = np.nan_to_num(((px - a[:, 0]) * d[:, 0] + (pz - a[:, 1]) * d[:, 1]) / (d**2).sum(1)).clip(0, 1)
        d2 = (px - a[:, 0] - t * d[:, 0]) ** 2 + (pz - a[:, 1] - t * d[:, 1]) ** 2
        out.append(over.sum() % 2 == 1 or d2.min() <= (buffer + 1e-9) ** 2)
    return np.array(out)


def star(n, radius, seed, at=(0.0, 0.0)):
    """A concave ring without crossings of its own."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = radius * rng.uniform(0.3, 1.0, n)
    return np.stack([at[0] + r * np.cos(angle), at[1] + r * np.sin(angle)], 1)


def frame(spark, rings):
    return spark.createDataFrame([(k, [{"x": float(x), "z": float(z)} for x, z in r]) for k, r in rings], POLY)


@pytest.mark.parametrize("buffer", [0.0, 1.7])
def test_rings_of_all_sizes(spark, buffer):
    rng = np.random.default_rng(1)
    rings = [(k, star(int(rng.integers(3, 200)), float(rng.uniform(0.1, 60)), k, tuple(rng.uniform(-100, 100, 2)))) for k in range(30)]
    rings += [(90, np.array([[0, 0], [8, 0], [8, 8], [0, 8]])), (91, np.array([[5.0, 5.0]])), (92, np.array([[-4.0, 0.0], [4.0, 0.0]])), (93, np.array([[0, 0], [6, 6], [6, 0], [0, 6]]))]
    odd = [(94, []), (95, [(float("nan"), 0.0), (1.0, 1.0), (0.0, 1.0)])]
    x, z = (np.r_[rng.uniform(-120, 120, 1500), rng.integers(-8, 9, 300).astype(float)] for _ in range(2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, z))] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, x double, z double")
    polys = frame(spark, rings + odd).unionByName(spark.createDataFrame([(96, None)], POLY))
    got = {(r.id, r.poly) for r in points_in_polygons(pts, polys, buffer).collect()}
    assert got == {(int(i), k) for k, ring in rings for i in np.flatnonzero(inside(np.asarray(ring, float), x, z, buffer))}


def test_ring_of_100_000_vertices(spark):
    rng = np.random.default_rng(2)
    angle = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    r = 50_000 * (0.6 + 0.3 * np.sin(7 * angle)) + rng.uniform(-3, 3, 100_000)
    ring = np.stack([r * np.cos(angle), r * np.sin(angle)], 1)
    x, z = rng.uniform(-50_000, 50_000, (2, 1500))
    x[:200], z[:200] = ring[:200].T
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, z))], "id long, x double, z double")
    spikes = star(3000, 50_000.0, 4)
    both = {r.id for r in points_in_polygons(pts, frame(spark, [(1, spikes)])).collect()}
    assert both == set(np.flatnonzero(inside(spikes, x, z)).tolist())
    got = points_in_polygons(pts, frame(spark, [(1, ring)]), mode="first", order="poly", point_id="id")
    assert {r.id for r in got.collect()} == set(np.flatnonzero(inside(ring, x, z)).tolist())


def test_nothing(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, z double")
    assert points_in_polygons(pts, frame(spark, [])).count() == points_in_polygons(pts.limit(0), frame(spark, [(1, star(9, 5.0, 1))])).count() == 0
