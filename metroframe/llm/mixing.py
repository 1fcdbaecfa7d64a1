"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a 60-bit number, a hash of its id and text.  A source whose target is k whole passes and a rest takes
each of its documents k times, and once more those whose number lies below a threshold.  The threshold is found
without sorting: words are summed by source and leading digit of the number, the digit in which the rest is reached is
the boundary, and only documents with that digit are summed again by the next one, until a boundary holds one document.
Thresholds are nested: a larger budget keeps all that a smaller one took.  The document on the boundary is taken if
that brings the source nearer to its target, so a source misses its target by half a document at most.

Rows that share a number (repeated rows of one id and text) are told apart by the place of the stored row: they are
equal, so that it does not matter which of them are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import row_numbers
from ..session import materialize
from .common import checked_join

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and passes over a source at most.
SHARE, PASSES = 1.5, 2
#: Bits of a digit, and digits of a document's number and of a row's place.
BITS, DIGITS, PLACE_DIGITS = 12, 5, 6


def n_words(text: Column) -> Column:
    """Number of runs outside ``\\x20`` and ``\\x09-\\x0D``; null has none."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def number_of(key: Column, text: Column) -> Column:
    """A number of 60 bits: leading digits of the md5 of ``key:text``, nulls as empty texts."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) of distinct (source, source_size).

    Sources by code point, null last, have the repeating ``weights``, and ``share`` of all words is dealt out by them.
    A target stops at ``passes`` times its source's size, and what is left is dealt out again among the others, until
    none is above.  Each round is one sum over the sources.
    """
    if share > passes:
        raise ValueError("the passes do not reach the share")
    # UTF-8 bytes are in the order of code points; the first two make the blocks of the numbering
    block = F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode("source", "UTF-8")), 1, 4), 4, "0"), 16, 10).cast("long"), F.lit(1 << 16))
    ranked = row_numbers(sizes.select("source", "source_size", F.col("source").isNull().alias("_last")), [], ["_last", "source"], block, "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = materialize(ranked.select("source", "source_size", weight.alias("_w")))
    most = F.col("source_size") * F.lit(float(passes))
    everything = share * float(known.agg(F.sum("source_size")).first()[0] or 0)
    full, n_full, dealt = F.lit(False), -1, F.lit(0.0)
    while True:
        told = known.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_w")))).first()
        if told[0] == n_full:
            return known.select("source", "source_size", F.when(full, most).otherwise(dealt).alias("target"))
        n_full = told[0]
        dealt = F.col("_w") * F.lit(everything - float(told[1] or 0.0)) / F.lit(float(told[2] or 1.0))
        full = full | (dealt > most)


def thresholds(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """(key, h, place, upto, size): the boundary document of each key with a rest, and the words up to it, itself included.

    Of rows (key, h, place, size) and (key, rest) with 0 < rest <= the sum of the key's sizes.
    """
    due = rests.select("key", "rest", F.lit(0).cast("long").alias("before"))
    left = rows.where("size > 0")
    done = None
    for column, digits in (("h", DIGITS), ("place", PLACE_DIGITS)):
        for k in range(digits):
            digit = F.shiftright(column, BITS * (digits - 1 - k)).bitwiseAND((1 << BITS) - 1)
            hist = checked_join(left, due, ["key"], "inner").groupBy("key", digit.alias("_digit")).agg(
                F.sum("size").alias("size"), F.count(F.lit(1)).alias("m"), F.min(F.struct("h", "place")).alias("lo"), F.max("rest").alias("rest"), F.max("before").alias("before"))
            upto = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("_digit"))  # 4096 rows a key at most
            reached = hist.withColumn("upto", upto).where("upto >= rest and upto - size < rest")
            edge = materialize(reached.select("key", "_digit", "lo.h", "lo.place", "upto", "size", "m", "rest"))
            one = edge.where("m = 1").select("key", "h", "place", "upto", "size")
            done = one if done is None else done.unionByName(one)
            more = edge.where("m > 1")
            if more.isEmpty():
                return done
            due = materialize(more.select("key", "rest", (F.col("upto") - F.col("size")).alias("before")))
            left = checked_join(left.withColumn("_digit", digit), more.select("key", "_digit"), ["key", "_digit"], "left_semi").drop("_digit")
            left = materialize(left)
    return done


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
) -> DataFrame:
    """Columns ``keep`` (the id, if None) of every row, with size, source_size, target and taken.

    ``size`` is the number of words, ``taken`` how many of them the mix takes: none, all, or all several times.  Columns
    of ``keep`` with these names are replaced.  Null and empty texts have no words and nothing is taken of them; a null
    source is a source of its own, null ids are like others, and of repeated rows as many are taken as the target asks for.
    """
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in ([id_col] if keep is None else keep) if c not in added]
    source = F.col(f"`{source_col}`").cast("string")
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(kept)], source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        n_words(F.col(f"`{text_col}`")).alias("size"), number_of(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows)
    planned = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = materialize(
        planned.withColumn("whole", whole).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")))
    found = thresholds(rows.select("key", "h", "place", "size"), planned.where("rest > 0").select("key", "rest"))
    edges = found.select("key", F.col("h").alias("_h"), F.col("place").alias("_place"), F.col("upto").alias("_upto"), F.col("size").alias("_edge"))
    planned = materialize(planned.join(edges, "key", "left"))
    out = checked_join(rows, planned, ["key"], "inner")
    below = (F.col("h") < F.col("_h")) | ((F.col("h") == F.col("_h")) & (F.col("place") < F.col("_place")))
    nearer = F.col("_upto") - F.col("rest") <= F.col("rest") - (F.col("_upto") - F.col("_edge"))
    more = F.coalesce(below | ((F.col("h") == F.col("_h")) & (F.col("place") == F.col("_place")) & nearer), F.lit(False))
    return out.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken"))
