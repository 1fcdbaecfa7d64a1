"""Oriented boxes of mixed sizes against corner projections."""

import math
import random

from metroframe.operators.spatial import obb_overlap


def depth(a, b):
    """Least overlap of the two boxes' corner projections, taken about their centres."""
    best = math.inf
    for _, _, _, yaw, _, _ in (a, b):
        for ux, uz in ((math.cos(yaw), -math.sin(yaw)), (math.sin(yaw), math.cos(yaw))):
            reach = 0.0
            for _, _, _, t, hx, hz in (a, b):
                corners = [(i * hx * math.cos(t) + j * hz * math.sin(t), -i * hx * math.sin(t) + j * hz * math.cos(t)) for i in (-1, 1) for j in (-1, 1)]
                reach += max(x * ux + z * uz for x, z in corners)
            best = min(best, reach - abs((a[1] - b[1]) * ux + (a[2] - b[2]) * uz))
    return best


def test_boxes_of_mixed_sizes(spark):
    rnd = random.Random(4)
    size = lambda: rnd.choice([0.3, 1.0, 4.5, 40.0])
    make = lambda n: [(i, rnd.uniform(0, 200), rnd.uniform(0, 200), rnd.uniform(-4, 4), size(), size()) for i in range(n)]
    a, b = make(60), make(80) + [(99, None, 1.0, 0.0, 1.0, 1.0)]
    frame = lambda rows, p: spark.createDataFrame(rows, ", ".join(f"{p}_{c} {t}" for c, t in (("id", "int"), ("x", "double"), ("z", "double"), ("yaw", "double"), ("hx", "double"), ("hz", "double"))))
    got = {(r.a_id, r.b_id): r for r in obb_overlap(frame(a, "a"), frame(b, "b")).collect()}
    want = {(p[0], q[0]): depth(p, q) for p in a for q in b if q[1] is not None and depth(p, q) > 0}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k].pen - d) < 1e-9 for k, d in want.items())
    for (i, j), r in got.items():  # the normal points from b to a
        assert r.nx * (a[i][1] - b[j][1]) + r.nz * (a[i][2] - b[j][2]) >= -1e-9
