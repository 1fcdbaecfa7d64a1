"""Union, dedupe and greedy suppression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _stack(dfs: Sequence[DataFrame]) -> DataFrame:
    numbered = [d.withColumn("_load", F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def _pick(dfs: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    stacked = _stack(dfs)
    rest = [c for c in stacked.columns if c not in keys and c != "_load"]
    rank = F.struct("_load", *order)
    chosen = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return stacked.groupBy(*keys).agg(chosen.alias("_r")).select(*keys, "_r.*")


def union_keep_last(dfs: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union; of equal keys the row of the latest table (then highest ``order``) stays."""
    return _pick(dfs, keys, order, True)


def union_keep_first(dfs: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union; of equal keys the row of the earliest table (then lowest ``order``) stays."""
    return _pick(dfs, keys, order, False)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def dedupe_polylines(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One line per (keys, vertex count, rounded ends) of ``pts ARRAY<STRUCT<x, z>>``, first in ``order``."""
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    ends = [F.bround(p[c]).cast("long") for p in (a, b) for c in ("x", "z")]
    sig = F.struct(F.size("pts"), *ends)
    rest = [c for c in lines.columns if c not in keys]
    kept = lines.groupBy(*keys, sig.alias("_sig")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, "_r.*")


def spacing_suppress(df: DataFrame, r: float, id_col: str, priority: Sequence[Column], closed: bool = True) -> DataFrame:
    """Greedy thinning: in ``priority`` order keep a point if no kept point is within ``r``.

    Adds ``kept``.  All points of a cell of side r/sqrt(2) exclude each other, so a
    round tries only the best open point of each cell: it is kept when no open point
    within ``r`` comes before it, and then closes the points near it.  A point meets at
    most 25 candidates, so a round is linear however crowded a cell is.
    ``closed`` counts a distance of exactly ``r`` as near.  Loop.
    """
    side = r / 2**0.5
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], F.col(id_col).alias("id"))
    cell = F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("z") / side).alias("_cz")
    state = materialize(df.select(F.col(id_col).alias("_id"), F.col("x").alias("_x"), F.col("z").alias("_z"), rank.alias("_p"), *cell))
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    won = None
    while not state.isEmpty():
        lead = state.groupBy("_cx", "_cz").agg(F.min_by(F.struct("_id", "_x", "_z", "_p"), "_p").alias("c"))
        tried = lead.select("c", around.alias("s"), "_cx", "_cz").select(
            "c", (F.col("_cx") + F.col("s.i")).alias("_cx"), (F.col("_cz") + F.col("s.j")).alias("_cz")
        )
        dx, dz = F.col("_x") - F.col("c._x"), F.col("_z") - F.col("c._z")
        d2 = dx * dx + dz * dz
        near = (d2 <= r * r) if closed else (d2 < r * r)
        pairs = materialize(
            state.join(tried, ["_cx", "_cz"]).where(near | (F.col("_id") == F.col("c._id")))
            .select(F.col("c._id").alias("_c"), "_id", (F.col("_p") < F.col("c._p")).alias("_before"))
        )
        kept = pairs.groupBy("_c").agg(F.bool_or("_before").alias("_b")).where("not _b").select("_c")
        gone = pairs.join(kept, "_c", "left_semi").select("_id").distinct()
        won = kept if won is None else won.unionByName(kept)
        state = materialize(state.join(gone, "_id", "left_anti"))
    if won is None:
        return df.withColumn("kept", F.lit(True))
    flags = won.select(F.col("_c").alias(id_col), F.lit(True).alias("kept"))
    return df.join(flags, id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def merge_keep_first(df: DataFrame, r: float, id_col: str, order: Sequence[Column]) -> DataFrame:
    """Points kept when no earlier kept point is nearer than ``r``."""
    return spacing_suppress(df, r, id_col, order, closed=False).where("kept").drop("kept")


def split_ids(runs: DataFrame, n_train: int, n_test: int, test_base: int, id_col: str = "seed") -> DataFrame:
    """Rows of the training and held-out id ranges, with ``split``; overlapping ranges are refused."""
    if test_base < n_train and test_base + n_test > 0:
        raise ValueError("training and test ids overlap")
    i = F.col(id_col)
    split = F.when(i.between(0, n_train - 1), "train").when(i.between(test_base, test_base + n_test - 1), "test")
    return runs.withColumn("split", split).where("split is not null")


def natural_order(df: DataFrame, *cols: str) -> DataFrame:
    """Sort text so that embedded numbers count as numbers."""
    from ..functions.scalars import numeric_aware_key

    return df.orderBy(*[k for c in cols for k in numeric_aware_key(F.col(c))], *cols)


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """All rows with their place (from 1) in a total order.

    Rows are sorted across partitions and counted there; only one number per partition is added up.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(starts, "_part").select(*df.columns, (F.col("_before") + at + 1).alias(rank))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows of each group with their ``rank``; Spark trims groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
