"""Which grid cells are linked by a point pair within a radius, and their components.

Cells have side r/sqrt(2), so points of one cell are always within r.  Only cell
pairs need a test, and most are settled by their bounding boxes.  The rest are
tested point by point when both cells are small, else by halving both cells until
one pair of sub-boxes is surely near or all are surely far.  A crowded cell is
never paired with its neighbours point by point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_HELD = 1_000_000  # nodes that one task holds at once
_DIRECT = 4096  # point pairs tested at most per cell pair without halving
RING = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]


def side_of(r: float) -> float:
    return r / 2**0.5


def in_cells(df: DataFrame, r: float, x: str = "x", z: str = "z") -> DataFrame:
    s = side_of(r)
    return df.withColumn("_gx", F.floor(F.col(x) / s)).withColumn("_gz", F.floor(F.col(z) / s))


def cell_key(gx: str = "_gx", gz: str = "_gz") -> Column:
    """One number per cell (cell indices below 2^31 in size)."""
    return F.col(gx) * F.lit(4294967296) + (F.col(gz) + F.lit(2147483648))


def offsets(pairs=RING) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]))


def cell_boxes(pts: DataFrame, *extra: Column) -> DataFrame:
    return pts.groupBy("_gx", "_gz").agg(
        F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("z").alias("bz0"), F.max("z").alias("bz1"),
        F.count(F.lit(1)).alias("np"), *extra,
    )


def _gap2(p: str, q: str) -> tuple[Column, Column]:
    """Squared least and greatest distance of two boxes p and q."""
    near, far = F.lit(0.0), F.lit(0.0)
    for a in ("x", "z"):
        p0, p1, q0, q1 = (F.col(f"{s}_b{a}{e}") for s in (p, q) for e in (0, 1))
        d = F.greatest(p0 - q1, q0 - p1, F.lit(0.0))
        m = F.greatest(p1 - q0, q1 - p0)
        near, far = near + d * d, far + m * m
    return near, far


def linked_cells(pts: DataFrame, r: float) -> DataFrame:
    """Cell pairs (a, b as cell keys) with points at most ``r`` apart.

    ``pts`` are distinct places x, z with _gx, _gz; it is read several times, so pass a stored table.
    """
    boxes = cell_boxes(pts).withColumn("key", cell_key())
    cols = ["key", "_gx", "_gz", "bx0", "bx1", "bz0", "bz1", "np"]
    p = boxes.select(*[F.col(c).alias(f"p_{c}") for c in cols], offsets([o for o in RING if o > (0, 0)]).alias("s"))
    p = p.withColumn("_gx", F.col("p__gx") + F.col("s.i")).withColumn("_gz", F.col("p__gz") + F.col("s.j"))
    q = boxes.select("_gx", "_gz", *[F.col(c).alias(f"q_{c}") for c in cols])
    near, far = _gap2("p", "q")
    met = p.join(q, ["_gx", "_gz"]).withColumn("_near", near).withColumn("_far", far).where(F.col("_near") <= r * r)
    sure = met.where(F.col("_far") <= r * r).select(F.col("p_key").alias("a"), F.col("q_key").alias("b"))
    open_ = met.where(F.col("_far") > r * r)
    small = F.col("p_np") * F.col("q_np") <= _DIRECT
    keyed = pts.select(cell_key().alias("key"), "x", "z")
    pa = keyed.select(F.col("key").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"))
    pb = keyed.select(F.col("key").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    pairs = open_.where(small).select(F.col("p_key").alias("a"), F.col("q_key").alias("b"))
    dx, dz = F.col("ax") - F.col("bx"), F.col("az") - F.col("bz")
    direct = pairs.join(pa, "a").join(pb, "b").where(dx * dx + dz * dz <= r * r).select("a", "b").distinct()
    links = sure.unionByName(direct)
    if (boxes.agg(F.max("np")).first()[0] or 0) ** 2 <= _DIRECT:
        return links
    big = open_.where(~small).select(F.col("p_key").alias("a"), F.col("q_key").alias("b"))
    return links.unionByName(_halved(pts, big, r))


def strip(key: str = "a") -> Column:
    """Column of cells a key lies in, sixteen cells wide."""
    return F.floor(F.col(key) / F.lit(4294967296 * 16))


def _halved(pts: DataFrame, pairs: DataFrame, r: float) -> DataFrame:
    """Decide crowded cell pairs by comparing ever smaller sub-boxes of both sides."""
    pairs = materialize(pairs)
    links = pairs.limit(0)
    if pairs.isEmpty():
        return links
    s = side_of(r)
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    crowd = materialize(pts.select(cell_key().alias("key"), "x", "z").join(wanted, "key"))
    front = pairs.select("a", "b", *[F.floor(F.lit(0)).alias(c) for c in ("p_sx", "p_sz", "q_sx", "q_sz")])
    level = 0
    while True:
        level += 1
        step = s / 2**level
        sub = crowd.withColumn("sx", F.floor(F.col("x") / step)).withColumn("sz", F.floor(F.col("z") / step))
        boxes = sub.groupBy("key", "sx", "sz").agg(
            F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("z").alias("bz0"), F.max("z").alias("bz1")
        )

        def side(name: str, key: str) -> DataFrame:
            out = boxes.select(
                F.col("key").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("sx", "sz", "bx0", "bx1", "bz0", "bz1")],
                F.floor(F.col("sx") / 2).alias(f"{name}_ux"), F.floor(F.col("sz") / 2).alias(f"{name}_uz"),
            )
            return out

        if level == 1:
            grown = front.select("a", "b").join(side("p", "a"), "a").join(side("q", "b"), "b")
        else:
            up = front.select("a", "b", *[F.col(f"{n}_s{c}").alias(f"{n}_u{c}") for n in "pq" for c in "xz"])
            grown = up.join(side("p", "a"), ["a", "p_ux", "p_uz"]).join(side("q", "b"), ["b", "q_ux", "q_uz"])
        near, far = _gap2("p", "q")
        tested = materialize(
            grown.withColumn("_near", near).withColumn("_far", far).where(F.col("_near") <= r * r)
            .select("a", "b", "p_sx", "p_sz", "q_sx", "q_sz", "_far")
        )
        found = tested.where(F.col("_far") <= r * r).select("a", "b").distinct()
        links = links.unionByName(found)
        front = materialize(tested.join(found, ["a", "b"], "left_anti").drop("_far"))
        if front.isEmpty():
            return links


def components(nodes: DataFrame, edges: DataFrame, near: Column | None = None) -> DataFrame:
    """Connected components: (id, comp) with comp the lowest id.  Loop.

    Every task first reduces its own edges to stars; ``near`` is a column of ``a`` that
    brings neighbouring edges together, to let it reduce more.  Then each round takes
    the lowest label among neighbours, moves whole trees with their root, and jumps
    along labels twice, so long chains close in a logarithmic number of rounds.
    """
    kind = dict(edges.dtypes)["a"]
    placed = edges.select("a", "b").where("a != b").repartition(F.col("a") if near is None else near)
    both = materialize(placed.mapInPandas(_stars, f"src {kind}, dst {kind}"))
    labels = nodes.select("id").distinct().withColumn("comp", F.col("id"))
    if both.isEmpty():
        return labels
    labels = materialize(labels)
    while True:
        heard = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("low"))
        hooked = labels.join(heard, labels.id == heard.src, "left").select(
            "id", F.col("comp").alias("old"), F.least("comp", F.coalesce("low", "comp")).alias("comp")
        )
        roots = hooked.where("comp < old").groupBy(F.col("old").alias("id")).agg(F.min("comp").alias("via"))
        hooked = materialize(
            hooked.join(roots, "id", "left").select("id", "old", F.least("comp", F.coalesce("via", "comp")).alias("comp"))
        )
        if hooked.where("comp != old").isEmpty():
            return labels
        labels = hooked.select("id", "comp")
        for _ in range(2):
            up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
            labels = labels.join(up, "comp").select("id", F.col("up").alias("comp"))
        labels = materialize(labels)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one task's edges: every touched node with its lowest local node, both ways."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(v, v) != top:
            parent[v], v = top, parent[v]
        return top

    def stars() -> pd.DataFrame:
        pairs = [(v, root(v)) for v in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pd.DataFrame(pairs + [(b, a) for a, b in pairs], columns=["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist()):
            ra, rb = root(a), root(b)
            lo, hi = (ra, rb) if ra < rb else (rb, ra)
            parent[lo] = lo
            parent[hi] = lo
        if len(parent) > _HELD:  # partial stars: the rounds that follow join them
            yield stars()
            parent.clear()
    yield stars()
