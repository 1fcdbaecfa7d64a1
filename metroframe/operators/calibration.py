"""Camera homographies and similarity fits.

The sums over correspondences are Spark aggregates; only the small solved systems
(8x8 or 3x3, one row per group) run in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import apply_homography, invert_homography, quad_of, quad_to_full
from ..plans.onerow import beside
from ..session import materialize


def _normal_terms() -> tuple[list[Column], list[Column]]:
    """Summed entries of A^T A (row-major upper triangle) and A^T b of the direct linear transform."""
    x, y, p, q = F.col("_nu"), F.col("_nv"), F.col("_nx"), F.col("_nz")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [
        ([x, y, one, zero, zero, zero, -x * p, -y * p], p),
        ([zero, zero, zero, x, y, one, -x * q, -y * q], q),
    ]
    ata = [F.sum(rows[0][0][i] * rows[0][0][j] + rows[1][0][i] * rows[1][0][j]) for i in range(8) for j in range(i, 8)]
    atb = [F.sum(rows[0][0][i] * rows[0][1] + rows[1][0][i] * rows[1][1]) for i in range(8)]
    return ata, atb


def fit_homography(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares homography of (u, v) -> (x, z) per group: keys, h ARRAY(9), n, max_residual.

    Needs four pairs; degenerate groups get a NULL ``h``.
    """
    keys = list(keys)
    centre = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"_c{c}") for c in "uvxz"], F.count(F.lit(1)).alias("n")).where("n >= 4")
    centre = materialize(centre)  # of known size, so that few groups meet their pairs without a shuffle of these
    moved = pairs.join(centre, keys)
    ri = F.hypot(F.col("u") - F.col("_cu"), F.col("v") - F.col("_cv"))
    ro = F.hypot(F.col("x") - F.col("_cx"), F.col("z") - F.col("_cz"))
    spread = moved.groupBy(*keys).agg(F.avg(ri).alias("_ri"), F.avg(ro).alias("_ro"))
    root2 = 2**0.5
    stats = centre.join(spread, keys)
    for s, r in (("_si", "_ri"), ("_so", "_ro")):
        stats = stats.withColumn(s, root2 / F.when(F.col(r) == 0, 1.0).otherwise(F.col(r)))
    stats = materialize(stats)
    n = pairs.join(stats, keys)
    for name, c, s in (("_nu", "u", "_si"), ("_nv", "v", "_si"), ("_nx", "x", "_so"), ("_nz", "z", "_so")):
        n = n.withColumn(name, (F.col(c) - F.col(f"_c{c}")) * F.col(s))
    ata, atb = _normal_terms()
    norm = ["_cu", "_cv", "_cx", "_cz", "_si", "_so", "n"]
    sums = n.groupBy(*keys, *norm).agg(
        *[a.alias(f"_m{i}") for i, a in enumerate(ata)], *[b.alias(f"_b{i}") for i, b in enumerate(atb)]
    )
    sums = sums.select(
        *keys, *norm, F.array(*[f"_m{i}" for i in range(36)]).alias("_m"), F.array(*[f"_b{i}" for i in range(8)]).alias("_b")
    )
    types = dict(sums.dtypes)

    def solve(batches):
        for batch in batches:
            batch = batch.copy()
            batch["h"] = [_solve(r._asdict()) for r in batch.rename(columns=lambda c: c.lstrip("_") if c not in keys else c).itertuples(index=False)]
            yield batch[[*keys, "h", "n"]]

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", h array<double>, n bigint"
    fitted = materialize(sums.mapInPandas(solve, schema))
    x, z = apply_homography(F.col("h"), F.col("u"), F.col("v"))
    miss = F.hypot(x - F.col("x"), z - F.col("z"))
    worst = pairs.join(fitted.where("h is not null"), keys).groupBy(*keys).agg(F.max(miss).alias("max_residual"))
    return fitted.join(worst, keys, "left")


def _solve(r: dict) -> list[float] | None:
    m = np.zeros((8, 8))
    m[np.triu_indices(8)] = r["m"]
    m = m + np.triu(m, 1).T
    if not np.isfinite(m).all() or np.linalg.cond(m) > 1e14:
        return None
    hn = np.append(np.linalg.solve(m, np.asarray(r["b"])), 1.0).reshape(3, 3)
    src = np.array([[r["si"], 0, -r["si"] * r["cu"]], [0, r["si"], -r["si"] * r["cv"]], [0, 0, 1]])
    back = np.array([[1 / r["so"], 0, r["cx"]], [0, 1 / r["so"], r["cz"]], [0, 0, 1]])
    h = back @ hn @ src
    if not np.isfinite(h[2, 2]) or abs(h[2, 2]) < 1e-18:
        return None
    return (h / h[2, 2]).ravel().tolist()


def _crowded_groups(pairs: DataFrame, keys: list[str], apart: float) -> DataFrame:
    """Groups of distinct ids with two points in one cell of a diagonal below ``apart``."""
    side, sane = apart / 1.5, (F.abs("u") < 1e6) & (F.abs("v") < 1e6)
    cell = [F.floor(F.col(c) / side).alias(f"_{c}") for c in "uv"]
    full = pairs.where(sane).groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(*keys).distinct()
    twice = pairs.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(*keys).distinct()
    return full.join(twice, keys, "left_anti")


def calibration_gate(pairs: DataFrame, keys: Sequence[str], max_residual: float = 30.0, apart: float = 1e-3) -> DataFrame:
    """Fitted groups that pass: four pairs, no two image points within ``apart``, residual in bounds.

    Two points in a cell narrower than ``apart`` settle their group; only groups without such a cell, or whose ids
    repeat, are searched for nearest neighbours.
    """
    from .spatial import nearest_join

    keys = list(keys)
    crowded = materialize(_crowded_groups(pairs, keys, apart))
    open_ = pairs.join(crowded, keys, "left_anti")
    unique = open_.withColumn("_key", F.struct(*keys, "pair")).withColumn("_u", F.col("u")).withColumn("_v", F.col("v"))
    near = nearest_join(unique, unique, "_key", "_key", max_dist=apart, partition_by=keys, exclude_self=True, out="_o", x="_u", z="_v")
    clash = near.where("_o is not null").select(*keys).unionByName(crowded).distinct()
    fitted = fit_homography(pairs, keys).where(F.col("h").isNotNull() & (F.col("max_residual") <= max_residual))
    return fitted.join(clash, keys, "left_anti")


def image_to_scene(points: DataFrame, calib: DataFrame) -> DataFrame:
    """Full-frame (camera, u, v) to scene x, z with the quad's homography; uncalibrated quads give NULL."""
    q, qu, qv = quad_of(F.col("u"), F.col("v"))
    split = points.withColumn("quad", q.cast("int")).withColumn("_qu", qu).withColumn("_qv", qv)
    j = split.join(calib.select("camera", F.col("quad").cast("int").alias("quad"), "h"), ["camera", "quad"], "left")
    x, z = apply_homography(F.col("h"), F.col("_qu"), F.col("_qv"))
    return j.select(*points.columns, "quad", x.alias("x"), z.alias("z"))


def scene_to_image(points: DataFrame, calib: DataFrame) -> DataFrame:
    """Scene (camera, quad, x, z) to full-frame u, v by the inverse homography."""
    inverse = calib.select("camera", F.col("quad").cast("int").alias("quad"), invert_homography(F.col("h")).alias("_hi"))
    j = points.join(inverse, ["camera", "quad"], "left")
    qu, qv = apply_homography(F.col("_hi"), F.col("x"), F.col("z"))
    u, v = quad_to_full(F.col("quad"), qu, qv)
    return j.select(*points.columns, u.alias("u"), v.alias("v"))


_SRC, _DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")


def fit_similarity(pairs: DataFrame) -> DataFrame:
    """Scale, rotation and shift from (sx, sy, sz) to (dx, dy, dz) by least squares.

    One row: scale, elements (column-major 4x4), and mean and greatest residual in
    space and on the ground (first and third axis).
    """
    means = pairs.agg(*[F.avg(c).alias(f"_m_{c}") for c in (*_SRC, *_DST)], F.count(F.lit(1)).alias("n"))
    c = beside(pairs, means)
    rel = {k: F.col(k) - F.col(f"_m_{k}") for k in (*_SRC, *_DST)}
    moments = c.agg(
        F.array(*[F.avg(rel[d] * rel[s]) for d in _DST for s in _SRC]).alias("cov"),
        F.avg(sum((rel[s] * rel[s] for s in _SRC[1:]), rel[_SRC[0]] * rel[_SRC[0]])).alias("var"),
        F.first("n").alias("n"),
        F.array(*[F.first(f"_m_{s}") for s in _SRC]).alias("ms"), F.array(*[F.first(f"_m_{d}") for d in _DST]).alias("md"),
    )

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                u, d, vt = np.linalg.svd(np.asarray(r.cov).reshape(3, 3))
                flip = np.diag([1.0, 1.0, -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0])
                s = float(np.trace(np.diag(d) @ flip) / r.var)
                rot = s * (u @ flip @ vt)
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rot, np.asarray(r.md) - rot @ np.asarray(r.ms)
                out.append((s, m.T.ravel().tolist(), int(r.n)))
            yield pd.DataFrame(out, columns=["scale", "elements", "n"])

    fit = moments.mapInPandas(solve, "scale double, elements array<double>, n bigint")
    p = beside(pairs, fit)
    e = F.col("elements")
    miss = [e[i] * F.col("sx") + e[4 + i] * F.col("sy") + e[8 + i] * F.col("sz") + e[12 + i] - F.col(d) for i, d in enumerate(_DST)]
    full = F.sqrt(miss[0] ** 2 + miss[1] ** 2 + miss[2] ** 2)
    flat = F.hypot(miss[0], miss[2])
    return p.groupBy("scale", "elements", "n").agg(
        F.avg(full).alias("residual_mean"), F.max(full).alias("residual_max"),
        F.avg(flat).alias("ground_mean"), F.max(flat).alias("ground_max"),
    )
