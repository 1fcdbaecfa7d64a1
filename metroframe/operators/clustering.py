"""Single-link and density clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.linkage import RING, cell_boxes, cell_key, components, in_cells, linked_cells, offsets, strip
from ..session import materialize


def _places(points: DataFrame, r: float, id_col: str) -> DataFrame:
    """Distinct places with weight and lowest id, in cells of side r/sqrt(2); copies cost one row."""
    grouped = points.groupBy("x", "z").agg(F.count(F.lit(1)).alias("w"), F.min(id_col).alias("id0"))
    return materialize(in_cells(grouped, r))


def cluster_within(points: DataFrame, r: float, id_col: str = "id") -> DataFrame:
    """Single-link components of points at most ``r`` apart: id, cluster (lowest id).  Loop."""
    pts = _places(points, r, id_col)
    cells = pts.select(cell_key().alias("id")).distinct()
    comp = components(cells, linked_cells(pts, r), strip())
    tagged = pts.withColumn("cell", cell_key()).join(comp.select(F.col("id").alias("cell"), "comp"), "cell")
    names = tagged.groupBy("comp").agg(F.min("id0").alias("cluster"))
    named = tagged.join(names, "comp").select("x", "z", "cluster")
    return points.select(id_col, "x", "z").join(named, ["x", "z"]).select(id_col, "cluster")


def _beside_cells(points: DataFrame, boxes: DataFrame, payload: list[str], e2: float, ring=RING) -> DataFrame:
    """Points (px, pz) with each filled cell around their own that lies in reach of the own cell's box.

    Cells meet first, so a point costs a row for each filled cell in reach and none for empty ones.
    """
    own = points.groupBy("_gx", "_gz").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    around = own.select(F.col("_gx").alias("_ox"), F.col("_gz").alias("_oz"), "x0", "x1", "z0", "z1", offsets(ring).alias("s"))
    around = around.withColumn("_gx", F.col("_ox") + F.col("s.i")).withColumn("_gz", F.col("_oz") + F.col("s.j"))
    dx = F.greatest(F.col("bx0") - F.col("x1"), F.col("x0") - F.col("bx1"), F.lit(0.0))
    dz = F.greatest(F.col("bz0") - F.col("z1"), F.col("z0") - F.col("bz1"), F.lit(0.0))
    cells = around.join(boxes.select("_gx", "_gz", "bx0", "bx1", "bz0", "bz1", *payload), ["_gx", "_gz"]).where(dx * dx + dz * dz <= e2)
    probes = points.select(F.col("x").alias("px"), F.col("z").alias("pz"), F.col("_gx").alias("_ox"), F.col("_gz").alias("_oz"))
    return probes.join(cells.drop("s", "x0", "x1", "z0", "z1"), ["_ox", "_oz"])


def dbscan(points: DataFrame, eps: float, min_samples: int, id_col: str = "id") -> DataFrame:
    """Density clusters: id, cluster (lowest core id, NULL for noise), kind.  Loop.

    A point is core with at least ``min_samples`` points within ``eps``, itself
    included.  A border point within reach of several clusters joins the lowest.
    """
    e2 = eps * eps
    pts = _places(points, eps, id_col)
    boxes = materialize(cell_boxes(pts, F.sum("w").alias("n")))
    sparse = pts.join(boxes.where(F.col("n") < min_samples).select("_gx", "_gz", "n"), ["_gx", "_gz"])
    asked = _beside_cells(sparse, boxes, ["n"], e2)

    def reach() -> tuple:
        """Squared least and greatest distance from (px, pz) to the cell's box."""
        near, far = F.lit(0.0), F.lit(0.0)
        for p, lo, hi in (("px", "bx0", "bx1"), ("pz", "bz0", "bz1")):
            d = F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0))
            m = F.greatest(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(hi) - F.col(p)))
            near, far = near + d * d, far + m * m
        return near, far

    near, far = reach()
    dx, dz = F.col("x") - F.col("px"), F.col("z") - F.col("pz")
    close = dx * dx + dz * dz <= e2
    met = asked.withColumn("_far", far).where(near <= e2)
    own = sparse.select(F.col("x").alias("px"), F.col("z").alias("pz"), F.col("n").alias("c"))
    whole = met.where(F.col("_far") <= e2).select("px", "pz", F.col("n").alias("c"))
    part = met.where(F.col("_far") > e2).select("px", "pz", "_gx", "_gz")
    part = part.join(pts.select("_gx", "_gz", "x", "z", "w"), ["_gx", "_gz"]).where(close).select("px", "pz", F.col("w").alias("c"))
    counts = own.unionByName(whole).unionByName(part).groupBy("px", "pz").agg(F.sum("c").alias("c"))
    sparse_core = counts.where(F.col("c") >= min_samples).select(F.col("px").alias("x"), F.col("pz").alias("z"))
    dense_cells = boxes.where(F.col("n") >= min_samples).select("_gx", "_gz")
    core = materialize(
        pts.join(dense_cells, ["_gx", "_gz"], "left_semi").unionByName(pts.join(sparse_core, ["x", "z"], "left_semi").select(*pts.columns))
    )
    comp = components(core.select(cell_key().alias("id")).distinct(), linked_cells(core, eps), strip())
    core_cells = core.withColumn("cell", cell_key()).join(comp.select(F.col("id").alias("cell"), "comp"), "cell")
    names = core_cells.groupBy("comp").agg(F.min("id0").alias("cluster"))
    labelled = materialize(core_cells.join(names, "comp").select("x", "z", "_gx", "_gz", "cluster"))

    # border: places of sparse cells that are not core but reach a core place
    lone = sparse.select(*pts.columns).join(core.select("x", "z"), ["x", "z"], "left_anti")
    core_boxes = cell_boxes(labelled, F.min("cluster").alias("cluster"))
    near2, far2 = reach()
    met2 = _beside_cells(lone, core_boxes, ["cluster"], e2, [(0, 0), *RING]).withColumn("_far", far2).where(near2 <= e2)
    sure2 = met2.where(F.col("_far") <= e2).select("px", "pz", "cluster")
    part2 = met2.where(F.col("_far") > e2).select("px", "pz", "_gx", "_gz").join(
        labelled, ["_gx", "_gz"]
    ).where(close).select("px", "pz", "cluster")
    border = sure2.unionByName(part2).groupBy("px", "pz").agg(F.min("cluster").alias("cluster"))
    places = labelled.select("x", "z", "cluster", F.lit("core").alias("kind")).unionByName(
        border.select(F.col("px").alias("x"), F.col("pz").alias("z"), "cluster", F.lit("border").alias("kind"))
    )
    out = points.select(id_col, "x", "z").join(places, ["x", "z"], "left")
    return out.select(id_col, "x", "z", "cluster", F.coalesce("kind", F.lit("noise")).alias("kind"))


def cluster_centroids(points: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean position and size of each cluster (noise left out)."""
    joined = points.select(id_col, "x", "z").join(labels.select(id_col, "cluster").where("cluster is not null"), id_col)
    return joined.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))
