"""Neighbour and running-total windows over sequences of any length.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here a
sequence is cut into blocks along its order column; the windows run inside the
blocks, and one summary row per block carries the edge values across.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def block_of(order: str, size: int = BLOCK) -> Column:
    """Block number along an integer order column."""
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    block: Column,
    prev: str | None = "prev_",
    nxt: str | None = "next_",
) -> DataFrame:
    """Add the previous and/or next row's ``cols`` within ``keys`` by ``order``."""
    keys, order, cols = list(keys), list(order), list(cols)
    base = df.withColumn("_blk", block)
    edge_order = F.struct(*order)
    values = F.struct(*cols)
    edges = base.groupBy(*keys, "_blk").agg(
        F.min_by(values, edge_order).alias("_first"), F.max_by(values, edge_order).alias("_last")
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_blk")
    edges = edges.select(
        *keys,
        "_blk",
        F.lag("_last").over(over_blocks).alias("_before"),
        F.lead("_first").over(over_blocks).alias("_after"),
    )
    joined = base.join(edges, [*keys, "_blk"])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    added = []
    if prev is not None:
        first = F.lag(F.lit(1)).over(w).isNull()
        added += [F.when(first, F.col("_before")[c]).otherwise(F.lag(c).over(w)).alias(prev + c) for c in cols]
    if nxt is not None:
        last = F.lead(F.lit(1)).over(w).isNull()
        added += [F.when(last, F.col("_after")[c]).otherwise(F.lead(c).over(w)).alias(nxt + c) for c in cols]
    return joined.select(*df.columns, *added)


def _whole_table_offsets(sums: DataFrame, names: list[str], wide: int = 4096) -> DataFrame:
    """Block sums of a table without keys, with the sum before their stretch of ``wide`` blocks and that of the table.

    One row for each stretch is summed up in order, not one for each block.
    """
    sums = sums.withColumn("_sup", F.floor(F.col("_blk") / wide))
    stretches = sums.groupBy("_sup").agg(*[F.sum(f"_s_{o}").alias(f"_p_{o}") for o in names])
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(f"_p_{o}").over(before), F.lit(0)).alias(f"_u_{o}") for o in names] + [F.sum(f"_p_{o}").over(whole).alias(f"_t_{o}") for o in names]
    return sums.join(stretches.select("_sup", *told), "_sup")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    block: Column,
    exclusive: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Prefix sums in two levels: inside a block, plus the sum of earlier blocks.

    ``values`` maps an output name to the summed column.  With ``totals`` the
    whole-sequence sum is added as ``<output>_total``.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn("_blk", block)
    sums = base.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in values.items()])
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = part.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    picked = [*keys, "_blk"]
    if not keys:
        sums = _whole_table_offsets(sums, list(values))
        earlier = Window.partitionBy("_sup").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for o in values:
        if not keys:
            picked.append((F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)) + F.col(f"_u_{o}")).alias(f"_o_{o}"))
            if totals:
                picked.append(F.col(f"_t_{o}").alias(f"{o}_total"))
            continue
        picked.append(F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}"))
        if totals:
            picked.append(F.sum(f"_s_{o}").over(part).alias(f"{o}_total"))
    offsets = sums.select(*picked)
    joined = base.join(offsets, [*keys, "_blk"])
    end = -1 if exclusive else 0
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    added = [
        (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_o_{o}")).cast(
            "long" if dict(df.dtypes)[c] in ("int", "bigint", "smallint", "tinyint") else "double"
        ).alias(o)
        for o, c in values.items()
    ]
    extra = [f"{o}_total" for o in values] if totals else []
    return joined.select(*df.columns, *added, *extra)


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, block: Column, out: str
) -> DataFrame:
    """The latest non-NULL value at or before each row."""
    keys, order = list(keys), list(order)
    base = df.withColumn("_blk", block)
    seen = F.struct(F.col(col).alias("v"))
    ends = base.where(F.col(col).isNotNull()).groupBy(*keys, "_blk").agg(F.max_by(seen, F.struct(*order)).alias("_e"))
    blocks = base.select(*keys, "_blk").distinct().join(ends, [*keys, "_blk"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_blk", F.last("_e", ignorenulls=True).over(earlier).alias("_carry"))
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(col, ignorenulls=True).over(w)
    joined = base.join(carried, [*keys, "_blk"])
    return joined.withColumn(out, F.coalesce(here, F.col("_carry")["v"])).drop("_blk", "_carry")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str) -> DataFrame:
    """1-based position of each row in its sequence."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), keys, order, {out: "_one"}, block)
    return numbered.drop("_one")


def with_tail(df: DataFrame, keys: Sequence[str], seq: str, width: int, size: int = BLOCK) -> DataFrame:
    """Blocks of a densely numbered sequence, each led by the last ``width`` rows of
    the block before (``_halo`` true), so short trailing frames need no wider window."""
    base = df.withColumn("_blk", F.floor(F.col(seq) / size).cast("long")).withColumn("_halo", F.lit(False))
    tail = base.where(F.pmod(F.col(seq), F.lit(size)) >= size - width)
    return base.unionByName(tail.withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    step: Callable[[dict, pd.DataFrame, np.ndarray], pd.DataFrame],
    group: Sequence[str] | None = None,
) -> DataFrame:
    """A left fold for steps that are sequential by nature.

    Rows arrive sorted, one Arrow batch at a time, so memory stays at a batch
    however long a key is.  ``step(state, rows, fresh)`` changes ``state`` in place
    and returns output rows; ``fresh`` marks the first row of each key.  Rows that
    share key and ``group`` columns are never split between two calls; with
    ``group=()`` that holds for whole keys.
    """
    keys, order = list(keys), list(order)
    unit = None if group is None else keys + list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        last: tuple | None = None
        for rows in _whole_groups(batches, unit) if unit else batches:
            if rows.empty:
                continue
            fresh = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
            fresh[0] = tuple(rows.iloc[0][keys]) != last
            last = tuple(rows.iloc[-1][keys])
            yield step(state, rows, fresh)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _whole_groups(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """Move a group cut by a batch border wholly into the later batch."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        tail = (rows[cols] == rows.iloc[-1][cols]).all(axis=1)
        held, rows = rows[tail], rows[~tail].reset_index(drop=True)
        yield rows
    if held is not None:
        yield held.reset_index(drop=True)
