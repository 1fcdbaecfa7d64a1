"""Spatial equi-joins: boxes go to grid cells, points look their cell up.

Cells come in powers of two.  A box is filed at the level whose cell is at least
as wide as the box, so it meets at most four cells however large it is, and a
point asks one cell per level in use.  The number of levels is bounded by the
exponent range of the box sizes, never by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIN_LEVEL = -4


def size_level(width: Column, height: Column) -> Column:
    side = F.greatest(width, height, F.lit(2.0**_MIN_LEVEL))
    level = F.ceil(F.log2(side) - F.lit(1e-12)).cast("int")
    return F.greatest(level, F.lit(_MIN_LEVEL))


def cell_at(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level.cast("double"))).cast("long")


def levels_in_use(boxes: DataFrame, x0: str, x1: str, z0: str, z1: str) -> list[int]:
    """Distinct size levels of a table of boxes (as many numbers as there are powers of two among their sizes)."""
    lv = size_level(F.col(x1) - F.col(x0), F.col(z1) - F.col(z0))
    rows = boxes.select(lv.alias("lv")).where("lv is not null").distinct().collect()
    return sorted(r.lv for r in rows)


def _range(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


def file_boxes(boxes: DataFrame, x0: str, x1: str, z0: str, z1: str) -> DataFrame:
    """Boxes with their level and each (at most four) cell they meet at it."""
    lv = F.col("_lv")
    return (
        boxes.withColumn("_lv", size_level(F.col(x1) - F.col(x0), F.col(z1) - F.col(z0)))
        .withColumn("_cx", _range(cell_at(F.col(x0), lv), cell_at(F.col(x1), lv)))
        .withColumn("_cz", _range(cell_at(F.col(z0), lv), cell_at(F.col(z1), lv)))
    )


def probe_points(points: DataFrame, x: str, z: str, levels: list[int]) -> DataFrame:
    """Points once per level, with the cell that holds them there."""
    lv = F.col("_lv")
    return (
        points.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("_cx", cell_at(F.col(x), lv))
        .withColumn("_cz", cell_at(F.col(z), lv))
    )


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, x: str, z: str, x0: str, x1: str, z0: str, z1: str, on: tuple[str, ...] = ()
) -> DataFrame:
    """Inner join of points with every closed box that holds them; columns of both.

    ``on`` names equality columns the two sides share.
    """
    levels = levels_in_use(boxes, x0, x1, z0, z1) or [0]
    left = probe_points(points, x, z, levels)
    right = file_boxes(boxes, x0, x1, z0, z1)
    hit = F.col(x).between(F.col(x0), F.col(x1)) & F.col(z).between(F.col(z0), F.col(z1))
    return left.join(right, ["_lv", "_cx", "_cz", *on]).where(hit).drop("_lv", "_cx", "_cz")


def boxes_meet(a: DataFrame, b: DataFrame, ab: tuple[str, ...], bb: tuple[str, ...], on: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of two box tables on overlap of their closed rectangles.

    ``ab`` and ``bb`` name x0, x1, z0, z1 of each side; column names must not
    clash except for the equality columns ``on``.  A pair is found at the larger
    level of the two, in the cell that holds the lower corner of the overlap, so
    no distinct is needed.
    """
    la, lb = levels_in_use(a, *ab), levels_in_use(b, *bb)
    one = _meet(a, b, ab, bb, la, on, lambda own, other: own >= other)
    two = _meet(b, a, bb, ab, lb, on, lambda own, other: own > other)
    cols = [*on, *[c for c in a.columns if c not in on], *[c for c in b.columns if c not in on]]
    return one.select(*cols).unionByName(two.select(*cols))


def _meet(filed, asked, fb, qb, levels, on, keep) -> DataFrame:
    """``filed`` boxes in own cells, ``asked`` boxes at each filed level not below their own."""
    lv, own = F.col("_lv"), F.col("_own")
    q = (
        asked.withColumn("_own", size_level(F.col(qb[1]) - F.col(qb[0]), F.col(qb[3]) - F.col(qb[2])))
        .withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in (levels or [0])])))
        .where(keep(lv, own))
        .withColumn("_cx", _range(cell_at(F.col(qb[0]), lv), cell_at(F.col(qb[1]), lv)))
        .withColumn("_cz", _range(cell_at(F.col(qb[2]), lv), cell_at(F.col(qb[3]), lv)))
        .drop("_own")
    )
    f = file_boxes(filed, *fb)
    lowx, lowz = F.greatest(F.col(fb[0]), F.col(qb[0])), F.greatest(F.col(fb[2]), F.col(qb[2]))
    meets = (
        (lowx <= F.least(F.col(fb[1]), F.col(qb[1])))
        & (lowz <= F.least(F.col(fb[3]), F.col(qb[3])))
        & (cell_at(lowx, lv) == F.col("_cx"))
        & (cell_at(lowz, lv) == F.col("_cz"))
    )
    return f.join(q, ["_lv", "_cx", "_cz", *on]).where(meets).drop("_lv", "_cx", "_cz")
