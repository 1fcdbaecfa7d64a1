"""Angles and ego frames.  World forward at heading yaw is (cos yaw, -sin yaw) in (x, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def heading_from_motion(dx: Column, dz: Column) -> Column:
    return F.degrees(F.atan2(-dz, dx))


def yaw_from_bearing(deg: Column) -> Column:
    """Compass bearing (clockwise from north; missing = north) to yaw."""
    th = F.radians(F.coalesce(deg, F.lit(0.0)))
    return F.atan2(F.cos(th), F.sin(th))


def wrap_pi(a: Column) -> Column:
    """Into [-pi, pi]; values already inside are left alone."""
    turn = F.lit(2 * math.pi)
    r = F.pmod(a, turn)
    above, below = F.when(r > math.pi, r - turn).otherwise(r), F.when(r < math.pi, r).otherwise(r - turn)
    return F.when(a > math.pi, above).when(a < -math.pi, below).otherwise(a)


def shortest_angle(a: Column, b: Column) -> Column:
    """Signed turn from ``a`` to ``b``."""
    return wrap_pi(b - a)


def angle_diff(a: Column, b: Column) -> Column:
    return F.abs(F.atan2(F.sin(a - b), F.cos(a - b)))


def heading_360(yaw: Column) -> Column:
    return F.round(F.pmod(F.degrees(yaw), F.lit(360.0)), 1)


def ego_frame(dx: Column, dz: Column, yaw: Column) -> tuple[Column, Column]:
    """World offset to (forward, lateral)."""
    c, s = F.cos(yaw), F.sin(yaw)
    return dx * c - dz * s, dx * s + dz * c
