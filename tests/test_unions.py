"""Areas under unions, and common areas of convex rings."""

import numpy as np
import pytest

from metroframe.operators import polygons as V

RING = "array<struct<x: double, z: double>>"


def square(x, z, h):
    return [(x - h, z - h), (x + h, z - h), (x + h, z + h), (x - h, z + h)]


def test_covers_are_dissolved(spark):
    """rings meet pieces of the union, whose number does not grow with the covers on top of each other."""
    rng = np.random.default_rng(5)
    covers = [square(float(x), float(z), float(h)) for x, z, h in zip(*rng.integers(0, 40, (2, 1500)), rng.integers(2, 9, 1500))]
    covers += [square(80.0, 80.0, 5.0), square(88.0, 80.0, 5.0), square(80.0, 80.0, 5.0), [(120.0, 0.0), (130.0, 10.0), (130.0, 0.0), (120.0, 10.0)], None]
    rings = {1: square(20.0, 20.0, 10.0), 2: square(80.0, 80.0, 5.0), 3: square(84.0, 85.0, 4.0), 4: square(200.0, 0.0, 3.0), 5: square(-9.0, 20.0, 3.0), 6: square(125.0, 5.0, 5.0)}
    cover = spark.createDataFrame([(c,) for c in covers], f"b_ring {RING}")
    pieces = V._dissolved(cover, V.TILE_M).collect()
    assert len(pieces) < 400
    near = V.overlap_fraction_with_union(spark.createDataFrame([*rings.items(), (7, None)], f"a_id int, a_ring {RING}"), cover)
    got = {r.a_id: r.frac for r in near.collect()}
    assert got.pop(7) is None
    at = lambda v: (np.arange(int(v[0] * 2), int(v[1] * 2)) + 0.5) / 2  # noqa: E731  covers lie on whole metres
    x, z = np.meshgrid(at((-12, -6)), at((17, 23)))
    under = np.zeros(x.shape, bool)
    for c in covers[:1500]:
        under |= (x > c[0][0]) & (x < c[2][0]) & (z > c[0][1]) & (z < c[2][1])
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 1 - 4 / 8, 4: 0.0, 5: under.mean(), 6: 0.5})


def test_pieces_have_nothing_in_common(spark):
    """pieces of slanted, turned and self-crossing covers add up to the union, counted by a fine grid."""
    rng = np.random.default_rng(6)
    covers = [[tuple(map(float, p)) for p in rng.uniform(0, 30, 2) + rng.uniform(-6, 6, (int(rng.integers(3, 7)), 2))] for _ in range(60)]
    pieces = V._dissolved(spark.createDataFrame([(c,) for c in covers], f"b_ring {RING}"), V.TILE_M).collect()
    x, z = (v.ravel() for v in np.meshgrid(*[np.arange(-8, 38, 0.2) + 0.0217] * 2))

    def inside(ring):
        ring, odd = np.array(ring), np.zeros(len(x), bool)
        for (ax, az), (bx, bz) in zip(ring, np.roll(ring, -1, 0)):
            if az != bz:
                odd ^= ((az > z) != (bz > z)) & (x < (bx - ax) * (z - az) / (bz - az) + ax)
        return odd

    union = np.any([inside(c) for c in covers], 0)
    times = np.sum([inside(np.array(p._bv).reshape(-1, 2)).astype(int) for p in pieces], 0)
    assert (times != union).mean() < 1e-4 and times.max() == 1


def test_convex_rings_are_clipped_by_sides(monkeypatch):
    """pairs of convex rings do not go through the slabs between all crossings."""
    rng = np.random.default_rng(7)
    turn = np.sort(rng.uniform(0, 2 * np.pi, (2, 400, 6)), 2)
    a, b = (rng.uniform(0, 12, (400, 1, 2)) + 9 * np.stack([np.cos(t), np.sin(t)], 2) for t in turn)
    b[::2] = b[::2, ::-1]
    want = V._pair_areas(a, b)
    asked, slow = [], V._pair_areas
    monkeypatch.setattr(V, "_pair_areas", lambda p, q: asked.append(len(p)) or slow(p, q))
    n = np.full(400, 6)
    got = V._clip_areas(a.reshape(-1, 2), n, b.reshape(-1, 2), n)
    assert got == pytest.approx(want, abs=1e-9) and ((got > 0) == (want > 0)).all()
    assert sum(asked) < 100
    star = np.array([[np.cos(4 * np.pi * k / 5), np.sin(4 * np.pi * k / 5)] for k in range(5)])
    dart = np.array([[0.0, 0.0], [4.0, 0.0], [1.0, 1.0], [0.0, 4.0]])
    flat = np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]])
    back = np.array([[0.0, 0.0], [4.0, 0.0], [1.0, 0.0], [1.0, 3.0]])
    assert [bool(V._convex(*p.T[:, :, None])[0]) for p in (star, dart, flat, flat[::-1], back)] == [False, False, True, True, False]


def test_pairs_of_a_summary_are_found_once(spark):
    """both sides of the comparison are read from one stored table, so that no pair is clipped twice."""
    from types import SimpleNamespace

    from metroframe.catalog import joins
    from metroframe.operators import aggregates as A

    boxes = spark.range(1, 41).selectExpr("id AS box_id", "id * 7 % 40 + 0D AS cx", "id * 11 % 40 + 0D AS cz", "2D AS half")
    sites = spark.range(1, 31).selectExpr("id AS site_id", "id * 3 % 40 + 0D AS x", "id * 13 % 40 + 0D AS z", "CAST(id % 5 AS INT) AS c_nationkey")
    parts = joins.overlap_parts(SimpleNamespace(boxes=boxes, sites=sites))
    plans = [p._jdf.queryExecution().optimizedPlan().toString() for p in parts[:2]]
    assert not any("ArrowEvalPython" in p for p in plans)
    row = A.overlap_summary(*parts).first()
    pairs = [(a.box_id, b.site_id) for a in boxes.collect() for b in sites.collect() for h in [3 + b.c_nationkey * 0.25]
             if (w := min(a.cx + 2, b.x + h) - max(a.cx - 2, b.x - h)) > 0 and (v := min(a.cz + 2, b.z + h) - max(a.cz - 2, b.z - h)) > 0 and w * v >= 0.1037 * 16]
    assert (row.matched, row.known_matched, row.extracted, row.known) == (len({a for a, _ in pairs}), len({b for _, b in pairs}), 40, 30)
    assert row.swallowed == sum(n for n in (sum(a == k for a, _ in pairs) for k in range(41)) if n > 1)
