"""Homographies and the 2x2 camera quad layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-18


def finite(c: Column) -> Column:
    """True for real numbers; false for NaN, infinities and NULL."""
    d = c.try_cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def apply_homography(h: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Row-major 3x3 array on (u, v); NULL where the divisor vanishes."""
    w = h[6] * u + h[7] * v + h[8]
    ok = finite(w) & (F.abs(w) >= F.lit(_TINY))
    x = F.when(ok, (h[0] * u + h[1] * v + h[2]) / w)
    y = F.when(ok, (h[3] * u + h[4] * v + h[5]) / w)
    return x, y


def invert_homography(h: Column) -> Column:
    """Inverse as a row-major array; NULL where singular."""

    def minor(p: int, q: int, r: int, s: int) -> Column:
        return h[p] * h[q] - h[r] * h[s]

    c0, c1, c2 = minor(4, 8, 5, 7), minor(5, 6, 3, 8), minor(3, 7, 4, 6)
    det = h[0] * c0 + h[1] * c1 + h[2] * c2
    adjugate = [
        c0, minor(2, 7, 1, 8), minor(1, 5, 2, 4),
        c1, minor(0, 8, 2, 6), minor(2, 3, 0, 5),
        c2, minor(1, 6, 0, 7), minor(0, 4, 1, 3),
    ]
    ok = finite(det) & (F.abs(det) >= F.lit(_TINY))
    return F.when(ok, F.array(*[a / det for a in adjugate]))


def quad_of(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Full-frame (u, v) to quad number and position inside the quad."""
    col, row = F.when(u < 0.5, 0).otherwise(1), F.when(v < 0.5, 0).otherwise(1)
    return row * 2 + col, (u - col * 0.5) * 2, (v - row * 0.5) * 2


def quad_to_full(q: Column, u: Column, v: Column) -> tuple[Column, Column]:
    col, row = q % 2, F.when(q >= 2, 1).otherwise(0)
    return col * 0.5 + u * 0.5, row * 0.5 + v * 0.5


def tire_point(box: Column, w: float = 1.0, h: float = 1.0) -> tuple[Column, Column]:
    """Bottom centre of an [x1, y1, x2, y2] box, as a fraction of the sub-image."""
    return (box[0] + box[2]) / 2 / F.lit(float(w)), box[3] / F.lit(float(h))
