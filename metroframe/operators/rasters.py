"""Point clouds to grids, sampling, chunks and tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import grid_cell
from ..plans.onerow import beside
from ..plans.select import take_lowest


def grid_spec(bbox: tuple[float, float, float, float], cell: float) -> dict:
    """Grid over x0, z0, x1, z1."""
    x0, z0, x1, z1 = bbox
    return {"cell": cell, "x0": x0, "z0": z0, "nx": math.ceil((x1 - x0) / cell), "nz": math.ceil((z1 - z0) / cell)}


def ground_grid(points: DataFrame, spec: dict, cls: int | None = 2) -> DataFrame:
    """Lowest y per cell; outside points count for the border cells."""
    if cls is not None:
        points = points.where(F.col("cls") == cls)
    ix, iz = grid_cell(F.col("x"), F.col("z"), spec["cell"], spec["x0"], spec["z0"], "clamp", spec["nx"], spec["nz"])
    return points.groupBy(ix.alias("ix"), iz.alias("iz")).agg(F.min("y").alias("y"))


def grid_stats(cells: DataFrame, spec: dict) -> DataFrame:
    return cells.agg(
        F.count(F.lit(1)).alias("filled"), F.lit(spec["nx"] * spec["nz"]).cast("long").alias("total"),
        F.min("y").alias("elev_min"), F.max("y").alias("elev_max"),
    )


def _heightmap(points: DataFrame, spec: dict, how: Column) -> DataFrame:
    ix, iz = grid_cell(F.col("x"), F.col("z"), spec["cell"], spec["x0"], spec["z0"], "trunc")
    inside = points.withColumn("ix", ix).withColumn("iz", iz).where(
        F.col("ix").between(0, spec["nx"] - 1) & F.col("iz").between(0, spec["nz"] - 1)
    )
    return inside.groupBy("ix", "iz").agg(how.alias("y"))


def mean_heightmap(points: DataFrame, spec: dict) -> DataFrame:
    """Mean y per cell; outside points are dropped."""
    return _heightmap(points, spec, F.avg("y"))


def max_heightmap(points: DataFrame, spec: dict) -> DataFrame:
    return _heightmap(points, spec, F.max("y"))


def topdown_raster(points: DataFrame, px: int = 1200) -> DataFrame:
    """Mean colour per square pixel, row 0 at the north (greatest z row flipped)."""
    ext = points.agg(
        F.min("x").alias("_x0"), F.min("z").alias("_z0"),
        F.greatest(F.max("x") - F.min("x"), F.max("z") - F.min("z")).alias("_span"),
    )

    def index(v: str, v0: str) -> Column:
        raw = ((F.col(v) - F.col(v0)) / F.col("_span") * px).cast("long")
        return F.greatest(F.least(raw, F.lit(px - 1)), F.lit(0).cast("long"))

    placed = beside(points, ext)
    cells = placed.groupBy(index("x", "_x0").alias("col"), (F.lit(px - 1) - index("z", "_z0")).alias("row"))
    return cells.agg(*[F.avg(ch).cast("int").alias(ch) for ch in ("r", "g", "b")])


def grid_chunk(
    points: DataFrame,
    bounds: tuple[float, float, float, float],
    max_per_cell: int = 1_000_000,
    grids: Sequence[tuple[int, int]] = ((8, 8), (8, 16), (16, 16), (16, 32)),
) -> DataFrame:
    """Add ``chunk`` from the first grid whose fullest cell is small enough (else the last).

    One pass counts every candidate grid; at most as many counters as cells come back.
    """
    x0, z0, x1, z1 = bounds

    def cell(nx: int, nz: int) -> Column:
        ix = ((F.col("x") - x0) / (x1 - x0) * nx).cast("long")
        iz = ((F.col("z") - z0) / (z1 - z0) * nz).cast("long")
        zero = F.lit(0).cast("long")
        return F.greatest(F.least(iz, F.lit(nz - 1)), zero) * nx + F.greatest(F.least(ix, F.lit(nx - 1)), zero)

    keys = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), cell(*grids[g]).alias("c")) for g in range(len(grids))]))
    fullest = points.select(keys.alias("k")).groupBy("k").count().groupBy("k.g").agg(F.max("count").alias("m"))
    worst = {r.g: r.m for r in fullest.collect()}
    pick = next((g for g in range(len(grids)) if worst.get(g, 0) <= max_per_cell), len(grids) - 1)
    return points.withColumn("chunk", cell(*grids[pick])).withColumn("grid", F.lit("%dx%d" % grids[pick]))


def chunk_manifest(points: DataFrame, key: str = "chunk") -> DataFrame:
    """Row count and bounds per chunk."""
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")]
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("count"), *ends)


# ---- sampling ---------------------------------------------------------------
def _hash32(seed: int, ids: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(4294967296))


def hash_ranked_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """At most ``n`` rows per group, drawn by a seeded hash of ``ids``; repeatable whatever the partitioning."""
    h = _hash32(seed, ids)
    return take_lowest(df.withColumn("_h", h), keys, n, ["_h", *ids], F.floor(F.col("_h") / 65536)).drop("_h")


def bernoulli_sample(df: DataFrame, p: float, seed: int, ids: Sequence[str]) -> DataFrame:
    """Each row independently with probability ``p``, decided by its hash."""
    return df.where(_hash32(seed, ids) < F.lit(int(p * 4294967296)))


def stride_decimate(df: DataFrame, cap: int, order: Sequence[str], block: Column) -> DataFrame:
    """Every ceil(n / cap)-th row in the given order; all rows if they are at most ``cap``."""
    from ..plans.ordered import running_total

    numbered = running_total(df.withColumn("_one", F.lit(1)), [], order, {"_rn": "_one"}, block, totals=True)
    stride = F.greatest(F.ceil(F.col("_rn_total") / F.lit(float(cap))), F.lit(1))
    return numbered.where((F.col("_rn") - 1) % stride == 0).select(*df.columns)


# ---- tiles ------------------------------------------------------------------
def list_tiles(tiles: DataFrame, limit: int | None = None) -> DataFrame:
    """Tiles with a usable link, by name; optionally only the first ones."""
    from ..functions.scalars import pick_phase

    picked = pick_phase(tiles).where("url is not null").select("tile", "url", "year", "phase").distinct().orderBy("tile")
    return picked.limit(limit) if limit else picked


def tiles_per_year(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("year").agg(F.count(F.lit(1)).alias("tiles"))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """Top ``k`` rows per group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
