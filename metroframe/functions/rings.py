"""Geometry of rings held as ARRAY<STRUCT<x, z>> (closing vertex optional)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs, last back to first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("ax"), a["z"].alias("az"), b["x"].alias("bx"), b["z"].alias("bz")))


def _fold(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    return _fold(_edges(ring), lambda e: e["ax"] * e["bz"] - e["bx"] * e["az"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid; the vertex mean for rings without area.  Sums run relative to the first vertex."""
    x0, z0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["z"]
    names = ("a2", "cx", "cz", "mx", "mz")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def add(acc: Column, e: Column) -> Column:
        ax, az, bx, bz = e["ax"] - x0, e["az"] - z0, e["bx"] - x0, e["bz"] - z0
        cross = ax * bz - bx * az
        terms = (cross, (ax + bx) * cross, (az + bz) * cross, ax, az)
        return F.struct(*[(acc[n] + t).alias(n) for n, t in zip(names, terms)])

    def finish(acc: Column) -> Column:
        flat = acc["a2"] == 0
        x = F.when(flat, acc["mx"] / F.size(ring)).otherwise(acc["cx"] / (3 * acc["a2"]))
        z = F.when(flat, acc["mz"] / F.size(ring)).otherwise(acc["cz"] / (3 * acc["a2"]))
        return F.struct((x0 + x).alias("x"), (z0 + z).alias("z"))

    c = F.aggregate(_edges(ring), zero, add, finish)
    return c["x"], c["z"]


def ring_bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    """x0, x1, z0, z1."""
    xs, zs = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["z"])
    return F.array_min(xs), F.array_max(xs), F.array_min(zs), F.array_max(zs)


def point_in_ring(x: Column, z: Column, ring: Column) -> Column:
    """Ray cast: odd number of crossings to the right."""

    def crosses(e: Column) -> Column:
        straddles = (e["az"] > z) != (e["bz"] > z)
        at = (e["bx"] - e["ax"]) * (z - e["az"]) / F.nullif(e["bz"] - e["az"], F.lit(0.0)) + e["ax"]
        return F.when(straddles & (x < at), 1).otherwise(0)

    hits = F.aggregate(_edges(ring), F.lit(0), lambda acc, e: acc + crosses(e))
    return hits % 2 == 1


def segment_dist2(x: Column, z: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dz = bx - ax, bz - az
    len2 = dx * dx + dz * dz
    t = F.coalesce(((x - ax) * dx + (z - az) * dz) / F.nullif(len2, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    px, pz = x - (ax + t * dx), z - (az + t * dz)
    return px * px + pz * pz


def ring_distance(x: Column, z: Column, ring: Column) -> Column:
    """Distance from a point to a polygon: 0 inside, else to the nearest edge."""
    d2 = F.array_min(F.transform(_edges(ring), lambda e: segment_dist2(x, z, e["ax"], e["az"], e["bx"], e["bz"])))
    return F.when(point_in_ring(x, z, ring), 0.0).otherwise(F.sqrt(d2))


def polyline_length(pts: Column) -> Column:
    """Length in the x-z plane of ARRAY<STRUCT<x, z, ...>>."""
    n = F.size(pts)
    steps = F.zip_with(
        F.slice(pts, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(pts, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.hypot(b["x"] - a["x"], b["z"] - a["z"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)
