"""Row predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import CLASS_WIDTH

FLOW_CLASSES = (2, 3, 5, 7)
LABEL_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link",
)


def in_bbox(x: Column, z: Column, bbox: tuple[float, float, float, float], pad: float = 0.0) -> Column:
    """``bbox`` is x0, z0, x1, z1; a negative pad shrinks it."""
    x0, z0, x1, z1 = bbox
    return x.between(x0 - pad, x1 + pad) & z.between(z0 - pad, z1 + pad)


def boxes_intersect(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed rectangles given as x0, x1, z0, z1."""
    return (a[0] <= b[1]) & (a[1] >= b[0]) & (a[2] <= b[3]) & (a[3] >= b[2])


def keep_highway(cls: Column, name: Column, service: bool = False) -> Column:
    """Drivable classes; service roads only on request and only when named."""
    kept = [c for c in CLASS_WIDTH if service or c != "service"]
    return cls.isin(*kept) & ~((cls == "service") & name.isNull())


def boardable(location_type: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(location_type), F.lit("")), F.lit("0")) == "0"


def fresh(ts: Column, now: Column, ttl: float) -> Column:
    """Age in seconds at most ``ttl`` (both sides unix seconds)."""
    return (now - ts) <= F.lit(ttl)


def arrival_in_horizon(arrival: Column, now: Column, horizon: float = 3600) -> Column:
    eta = arrival - now
    return F.coalesce((arrival != 0) & (eta > -120) & (eta < F.lit(horizon)), F.lit(False))


def text_match(q: str, *cols: Column) -> Column:
    """Case-insensitive substring of any column; an empty query matches all."""
    needle = q.strip().lower()
    hit = F.lit(needle == "")
    for c in cols:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(needle)
    return hit


def flow_class(cls: Column) -> Column:
    return cls.isin(*FLOW_CLASSES)


def label_class(cls: Column) -> Column:
    return cls.isin(*LABEL_CLASSES)


def ground_class(cls: Column, wanted: tuple[int, ...] = (2,)) -> Column:
    """Point classes; apply it before any projection so it reaches the scan."""
    return cls.isin(*wanted)


def aspect_flag(height_m: Column, area_m2: Column) -> Column:
    aspect = height_m / F.greatest(F.sqrt(area_m2), F.lit(0.01))
    return F.when(aspect > 10, "very_tall").when(aspect < 0.1, "very_flat")
