"""Best-match joins by branch and bound over a grid pyramid.

Nearest-point, nearest-segment and corridor queries all ask, for each left row,
for the item with the lowest score.  Items are summarised as bounding boxes at
each pyramid level (sixteen children per cell).  Left rows descend level by
level and keep only cells whose lower bound does not exceed the best upper bound
seen, so a dense cell is never paired with all of its neighbours: each step adds
at most sixteen rows per kept cell.  Every step is an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_MAX_DEPTH = 15
_LEAF = 32


@dataclass
class Box:
    """Columns of an item's or cell's bounding box."""

    x0: Column
    x1: Column
    z0: Column
    z1: Column
    n: Column  # items inside


def axis_gap(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p, p - hi, F.lit(0.0))


def axis_reach(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.abs(p - lo), F.abs(hi - p))


def nearest_bounds(x: Column, z: Column, box: Box) -> tuple[Column, Column]:
    """Squared distance from a point to the nearest and farthest spot of a box."""
    dx, dz = axis_gap(x, box.x0, box.x1), axis_gap(z, box.z0, box.z1)
    fx, fz = axis_reach(x, box.x0, box.x1), axis_reach(z, box.z0, box.z1)
    return dx * dx + dz * dz, fx * fx + fz * fz


def best_item(
    left: DataFrame,
    items: DataFrame,
    left_id: str,
    on: Sequence[str],
    bounds: Callable[[Box], tuple[Column, Column, Column]],
    score: Column,
    allowed: Column,
    limit: float | None,
    tie: Sequence[str],
    payload: Sequence[str],
) -> DataFrame:
    """For each left row, the allowed item of lowest score: ``left_id``, ``_score``, payload.

    ``items`` needs ``_x0,_x1,_z0,_z1`` (bounding box) and ``_mx,_mz`` (anchor).
    ``bounds(box)`` returns (possible, lower, upper): whether the box may hold an
    allowed item, a lower bound on the score in it, and an upper bound that holds
    for at least one allowed item (NULL when none is sure).  ``limit`` is an
    exclusive cap on the score.  ``left`` rows need a unique ``left_id``.
    """
    on, tie, payload = list(on), list(tie), list(payload)
    finite = reduce(and_, [F.abs(c) < float("inf") for c in ("_x0", "_x1", "_z0", "_z1", "_mx", "_mz")])  # NaN is above infinity
    items = materialize(items.where(finite))  # read once per pyramid level
    # the square spans all but the outermost thousandths, so that a few wild places do not stretch it; those go to its border cells
    ends = [F.percentile_approx(c, [0.001, 0.999], 10_000) for c in ("_mx", "_mz")]
    ext = items.agg(
        ends[0][0].alias("x0"), ends[0][1].alias("x1"), ends[1][0].alias("z0"), ends[1][1].alias("z1"), F.count(F.lit(1)).alias("n"),
        F.percentile_approx(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_z1") - F.col("_z0")), 0.5, 1000).alias("wide"),
    ).first()
    if not ext.n:
        empty = [F.lit(None).cast(dict(items.dtypes)[c]).alias(c) for c in payload]
        return left.limit(0).select(left_id, F.lit(0.0).alias("_score"), *empty)
    span = max(ext.x1 - ext.x0, ext.z1 - ext.z0, 1e-6) * (1 + 1e-9)
    # cells much narrower than the items in them bound nothing better, there are only more of them
    deepest = _MAX_DEPTH
    if ext.wide > 0:
        deepest = max(1, min(_MAX_DEPTH, math.floor(math.log(max(4 * span / ext.wide, 4), 4))))
    depth = max(1, min(deepest, math.ceil(math.log(max(ext.n / 4, 2), 16))))
    while True:
        leafed = _leaves(items, ext.x0, ext.z0, span, depth)
        if depth >= deepest:
            break
        full = leafed.groupBy(*on, "_cx", "_cz").count().agg(F.max("count")).first()[0]
        if full <= _LEAF:
            break
        depth = min(deepest, depth + max(1, math.ceil(math.log(full / _LEAF, 16))))

    big = float("inf")
    front = left.withColumn("_cx", F.lit(0).cast("long")).withColumn("_cz", F.lit(0).cast("long"))
    front = front.withColumn("_ub", F.lit(big if limit is None else float(limit)))
    per_left = Window.partitionBy(left_id)
    for level in range(1, depth + 1):
        shift = 2 * (depth - level)
        cx, cz = F.shiftright("_cx", shift), F.shiftright("_cz", shift)
        kids = leafed.groupBy(*on, cx.alias("_kx"), cz.alias("_kz")).agg(
            F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"),
            F.min("_z0").alias("_z0"), F.max("_z1").alias("_z1"), F.count(F.lit(1)).alias("_n"),
        )
        kids = kids.withColumn("_cx", F.shiftright("_kx", 2)).withColumn("_cz", F.shiftright("_kz", 2))
        possible, lower, upper = bounds(Box(F.col("_x0"), F.col("_x1"), F.col("_z0"), F.col("_z1"), F.col("_n")))
        step = (
            front.join(kids, [*on, "_cx", "_cz"])
            .withColumn("_lb", lower)
            .where(possible & (F.col("_lb") <= _slack(F.col("_ub"))))
            .withColumn("_ub", F.least(F.col("_ub"), F.min(F.coalesce(upper, F.lit(big))).over(per_left)))
            .where(F.col("_lb") <= _slack(F.col("_ub")))
        )
        front = step.select(*left.columns, F.col("_kx").alias("_cx"), F.col("_kz").alias("_cz"), "_ub")
    if ext.wide > 0:
        # the least score first, as a plain number, so that of the many items in a left row's leaves only the best are gathered
        front = materialize(front)
        scored = front.join(leafed, [*on, "_cx", "_cz"]).withColumn("_score", score).where(allowed)
        least = materialize(scored.groupBy(left_id).agg(F.min("_score").alias("_least")))
        if limit is not None:
            least = least.where(F.col("_least") < F.lit(float(limit)))
            limit = None
        front = front.join(least, left_id)
        allowed = allowed & (F.col("_score") <= F.col("_least"))
    hits = front.join(leafed, [*on, "_cx", "_cz"]).withColumn("_score", score).where(allowed)
    if limit is not None:
        hits = hits.where(F.col("_score") < F.lit(float(limit)))
    rank = F.struct(F.col("_score"), *[F.col(c) for c in tie])
    best = hits.groupBy(left_id).agg(F.min_by(F.struct("_score", *payload), rank).alias("_best"))
    return best.select(left_id, "_best.*")


def _slack(bound: Column) -> Column:
    return bound * F.lit(1 + 1e-9) + F.lit(1e-9)


def _leaves(items: DataFrame, x0: float, z0: float, span: float, depth: int) -> DataFrame:
    cells = float(4**depth)
    first, last = F.lit(0).cast("long"), F.lit(int(cells) - 1).cast("long")

    def cell(c: str, c0: float) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.lit(c0)) / F.lit(span)))
        return F.greatest(first, F.least(F.floor(share * F.lit(cells)).cast("long"), last))

    return items.withColumn("_cx", cell("_mx", x0)).withColumn("_cz", cell("_mz", z0))
