"""Phrase collocations from a weighted de Bruijn graph.

An edge is a run of ``LONGEST`` words inside a piece of text; it joins the node of its first words to that of its last
ones.  Where a piece ends, the shorter runs up to the end stand in place of edges.  So every place of a text gives
one row, its edge or end, and these are aggregated once.  The count of a shorter phrase is the flow out of its node
plus the ends there: the sum over all rows that begin with it, taken level by level in one pass over sorted rows.

A pair of words that is rarer than a candidate may be ends a piece between them, for no candidate holds such a pair.
Pairs are counted by slots of a table of bounded size beforehand; a bitmap of the slots that are frequent enough parts
the texts.  A rare pair in such a slot costs a row and changes no count; on a corpus so large that all slots are
frequent nothing is parted, and each place sends a row.  Single words are counted by themselves.

Compaction: a phrase whose whole flow passes through one longer phrase (a unary path of the graph) is part of that,
and goes.  It is enough to compare phrases with those one word longer, for a phrase between two others has a count
between theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WordHashes, bounded, checked_join, mixed, shuffles_dropped, small_batches, tidy

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text whose rows are merged before they leave a task.
MERGED_BYTES = 4_000_000
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000
#: Bits of the bitmap of frequent words at most (4 MB), and for each word; bits of that of frequent pairs (16 MB).
MAX_BITS, WORD_BITS, PAIR_BITS = 25, 6, 27
#: Pairs end a piece below this share of the least count: rows then follow the size of the corpus more evenly.
PAIR_SHARE = 4
#: Partial groups in the ranking of a language.
SHARDS = 64

#: A-Z to a-z, and marks that end a piece to newlines.
FOLD = bytes(10 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str | None) -> list[list[bytes]]:
    """Words of each piece of a text; null has none."""
    return [p.split() for p in (text or "").encode("utf-8", "replace").translate(FOLD).split(b"\n")]


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text); a null word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                words = [w.decode("utf-8") for w in c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(c) + 1), pa.string()), pa.array([*words, None], pa.string()), pa.array([*c.values(), sum(c.values())], pa.int64())], ["lang", "word", "n"])
            found.clear()

        for b in bounded(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update((text or "").encode("utf-8", "replace").translate(FOLD).split())
            if sum(map(len, found.values())) > HELD:
                yield from rows()
        yield from rows()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The numbers of (slot) as bits; the driver gets one row for each 64 of them at most."""
    got = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("mask").to_numpy()
    return out.view(np.uint8)


def _set_in(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _word_bitmap(words: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each (lang, word), and the logarithm of its size."""
    bits = min(MAX_BITS, max(12, (words.count() << WORD_BITS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in b.column(1).to_pylist()), np.uint64, b.num_rows)
            salt = np.fromiter(map(_salt, b.column(0).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(h ^ salt, bits))], ["slot"])

    return _bitmap(words.select("lang", "word").mapInArrow(run, "slot long"), bits), bits


def _gathered(batches: Iterator[pa.RecordBatch], merged: Callable[[str, list[bytes], WordHashes], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``merged`` of the words of each language in some megabytes of (lang, text); an empty word parts pieces."""
    hashes, size = WordHashes(), 0
    words: dict[str, list[bytes]] = {}
    for b in bounded(batches, "text"):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            mine = words.setdefault(lang, [])
            for p in pieces(text):
                if p:
                    mine += p
                    mine.append(b"")
            size += len(text or "")
        if size > MERGED_BYTES:
            yield from (merged(lang, w, hashes) for lang, w in words.items())
            words, size = {}, 0
    yield from (merged(lang, w, hashes) for lang, w in words.items())


def _pairs(lang: str, h: np.ndarray) -> np.ndarray:
    """Slot of each word with the next one."""
    return _slots(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] ^ _salt(lang), PAIR_BITS)


def frequent_pairs(texts: DataFrame, frequent: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bitmap with the slots of all pairs of (lang, text) that occur ``least`` times or more, and of some others.

    Pairs are counted by slots of bounded number, so a slot may hold several; only pairs of ``frequent`` words count.
    """
    bitmap, bits = _word_bitmap(frequent)
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def merged(lang: str, words: list[bytes], hashes: WordHashes) -> pa.RecordBatch:
        h = hashes.array(words)
        good = _set_in(held.value, _slots(h ^ _salt(lang), bits)) & (h != hashes[b""])
        slot, n = np.unique(_pairs(lang, h)[good[:-1] & good[1:]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

    counted = texts.mapInArrow(tidy(lambda batches: _gathered(batches, merged)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return _bitmap(counted.where(F.col("n") >= least), PAIR_BITS)


def edges(texts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(lang, head, fourth, fifth, n): edges and ends of two words or more of (lang, text), merged in part.

    ``head`` has up to three words joined by spaces; the other columns are null where a piece ends before.
    """
    held = texts.sparkSession.sparkContext.broadcast(pairs)
    names = ["lang", "head", "fourth", "fifth", "n"]

    def merged(lang: str, words: list[bytes], hashes: WordHashes) -> pa.RecordBatch:
        h = hashes.array(words)
        word = h != hashes[b""]
        go_on = np.append(word[:-1] & word[1:], False)
        go_on[:-1] &= _set_in(held.value, _pairs(lang, h))
        # words from each place to the end of its piece, LONGEST at most
        ends = np.flatnonzero(~go_on)
        start = np.flatnonzero(go_on)
        room = np.minimum(ends[np.searchsorted(ends, start)] - start + 1, LONGEST)
        padded = np.append(h | np.uint64(1), np.zeros(LONGEST, np.uint64))
        head_key = key = np.zeros(len(start), np.uint64)
        for j in range(LONGEST):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.where(room > j, padded[start + j], np.uint64(0)))
            head_key = key if j == 2 else head_key
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(head_key[first])  # rows of one head side by side compress well
        first, n = first[order], n[order]
        start, room = start[first], room[first]
        all_words = pa.array([*words, *[b""] * LONGEST], pa.binary()).cast(pa.string())
        part = [pc.if_else(pa.array(room > j), all_words.take(pa.array(start + j)), pa.scalar(None, pa.string())) for j in range(LONGEST)]
        head = pc.binary_join_element_wise(*part[:3], " ", null_handling="skip")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(start), pa.string()), head, part[3], part[4], pa.array(n, pa.int64())], names)

    return texts.mapInArrow(tidy(lambda batches: _gathered(batches, merged)), "lang string, head string, fourth string, fifth string, n long")


def flows(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, n): phrases of k = 2 to LONGEST words with a count of ``least`` or more, from ``edges``.

    Rows of one head meet in one task in sorted order; sums of a level end where its words change, so a batch and
    the open sum of each level are all that a task holds.  Heads are then summed by their first two words.
    """
    names = ["lang", "k", "phrase", "n"]
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def changes(cols: list[pa.Array]) -> np.ndarray:
        """Whether a row differs from the one before in any of the columns; the first one does."""
        out = np.zeros(len(cols[0]), bool)
        out[:1] = True
        for c in cols:
            c = pc.fill_null(c, "\n")  # no word holds one
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return out

    def groups(t: pa.Table, keys: list[str]) -> pa.Table:
        """Sums of n over runs of equal keys, in order."""
        at = np.flatnonzero(changes([t.column(c).combine_chunks() for c in keys]))
        n = np.add.reduceat(t.column("n").to_numpy(), at)
        return t.select(keys).take(pa.array(at)).append_column("n", pa.array(n, pa.int64()))

    def named(t: pa.Table, k: int) -> pa.RecordBatch:
        """Rows of a level as phrases: those that have k words; whole heads as pairs."""
        spaces = pc.count_substring(t.column("head"), " ")
        if k > 3:
            t = t.filter(pc.and_(pc.is_valid(t.column(("fourth", "fifth")[k - 4])), pc.greater_equal(t.column("n"), least)))
            phrase = pc.binary_join_element_wise(*[t.column(c) for c in ("head", "fourth", "fifth")[: k - 2]], " ")
        elif k == 3:
            t = t.filter(pc.and_(pc.equal(spaces, 2), pc.greater_equal(t.column("n"), least)))
            phrase = t.column("head")
        else:
            t = t.filter(pc.greater_equal(spaces, 1))
            phrase = pc.replace_substring_regex(t.column("head"), r"(?s)^([^ ]+ [^ ]+) .*$", r"\1")
        cols = [t.column("lang"), pa.array(np.full(len(t), k), pa.int32()), phrase, t.column("n")]
        return pa.table(cols, schema=schema)

    levels = {5: ["lang", "head", "fourth", "fifth"], 4: ["lang", "head", "fourth"], 3: ["lang", "head"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, pa.Table] = {}
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            for k, keys in levels.items():
                new = t.select([*keys, "n"])
                summed = groups(pa.concat_tables([open_[k], new]) if k in open_ else new, keys)
                # the last sum may go on in the next batch
                closed, open_[k] = summed.slice(0, len(summed) - 1), summed.slice(len(summed) - 1)
                for level in (k, 2) if k == 3 else (k,):
                    yield from named(closed, level).to_batches()
        for k, t in open_.items():
            for level in (k, 2) if k == 3 else (k,):
                yield from named(t, level).to_batches()

    # two strings instead of four cross the network; no word holds a space, no head a newline
    packed = rows.select(F.concat_ws("\n", "lang", "head").alias("key"), F.concat_ws(" ", "fourth", "fifth").alias("tail"), "n").repartition("key")
    head = F.substring_index("key", "\n", -1)
    apart = packed.select(
        F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), head.alias("head"),
        F.when(F.col("tail") != "", F.substring_index("tail", " ", 1)).alias("fourth"), F.when(F.contains("tail", F.lit(" ")), F.substring_index("tail", " ", -1)).alias("fifth"), "n")
    ordered = apart.sortWithinPartitions("lang", "head", "fourth", "fifth")
    found = ordered.mapInArrow(run, "lang string, k int, phrase string, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names)


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of 2 to 5 words that occurs ``least`` times or more is cut where 1000 * a * n / (l * r) is lowest (the
    first such cut); a is its count, l and r those of the parts, n all words of the language.  Phrases inside a longer
    one with ``share`` percent of their count or more go.  Order: score and a descending, phrase by its bytes.
    Null texts are empty, a null language is ``und``, repeated rows count as often as they stand there, and an empty
    table gives an empty one.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    with shuffles_dropped(df.sparkSession):
        counted = materialize(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)))
        frequent = counted.where("word is not null")
        grams = materialize(flows(edges(texts, frequent_pairs(texts, frequent, -(-least // PAIR_SHARE))), least))
    known = grams.select("lang", "phrase", "n").unionByName(frequent.select("lang", F.col("word").alias("phrase"), "n"))

    words = F.split("phrase", " ")
    inside = grams.where("k > 2").select("lang", "k", "n", words.alias("w")).select("lang", F.explode(F.array(
        F.array_join(F.slice("w", 1, F.col("k") - 1), " "), F.array_join(F.slice("w", 2, F.col("k") - 1), " "))).alias("phrase"), "n")
    longer = inside.groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    left = grams.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < share * F.col("n"), F.lit(True)))

    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "k", words.alias("w")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("_first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l")), ["lang", "_first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r")), ["lang", "_rest"])
    cuts = checked_join(cuts, counted.where("word is null").select("lang", "n"), ["lang"], "inner")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "l", "r", "n", "cut", (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).alias("_over"), (wide["l"] * wide["r"]).alias("_under"))
    cuts = cuts.withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    some = best.withColumn("_shard", shard).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_shard").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
