"""Near-duplicate documents: circulant MinHash, banding, exact confirmation on whole shingle sets.

One permutation places a shingle among ``SLOTS`` positions, a second one, circularly shifted by k, gives coordinate k;
so all coordinates of a shingle are one contiguous run of the second permutation.  Copies with equal sets collapse to
one representative first.  Bands propose pairs, and the full sets of both texts confirm every link.

Shingles that only one candidate holds bound its similarity to all others: with s shared of n shingles, a link to a
text of m shingles needs 175 s >= 75 (n + m) (at 75 percent).  So a candidate has a largest partner size, and those
whose size admits no partner leave before any pair is made; heavily edited copies in a crowd are such.

A band bucket never lists its pairs.  First come stars: a bucket compares one centre (the member that shares most
buckets with others) with the members outside its component, again while that finds links.  What is left in buckets
of more than one component is compared in blocks of bounded size: a pair of blocks is one group, which compares
signatures, confirms the near ones on their full sets and returns links between components only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WordHashes, bounded, checked_join, hand_back, mixed, shingle_hashes, small_batches, tidy, words_of

WORDS = 5
BANDS, ROWS = 64, 6
SLOTS_BITS = 22
SEED = 20
#: Members of a block; a group holds two blocks.
BLOCK = 256
#: Standard deviations by which the share of equal coordinates may fall short of the threshold.
SLACK = 5.0


class Signer:
    """Distinct shingles and band keys of texts."""

    def __init__(self, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = SLOTS_BITS, seed: int = SEED):
        self.words, self.bands, self.rows, self.bits = words, bands, rows, bits
        k = bands * rows
        second = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)
        self.hashes = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words are none."""
        h = self.hashes.array(words_of(text))
        n = min(self.words, len(h))
        return np.unique(shingle_hashes(h, n) + np.uint64(n)) if n else h

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Least value of each shift of the second permutation."""
        slot = (mixed(shingles) >> np.uint64(64 - self.bits)).astype(np.int64)  # the first permutation
        low = self.runs[slot[:512]].min(0)
        for lo in range(512, len(slot), 512):
            np.minimum(low, self.runs[slot[lo : lo + 512]].min(0), out=low)
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of a signature."""
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)


_signers: dict[tuple, Signer] = {}


def signer_of(**how: int) -> Signer:
    """One per worker process and kind."""
    key = tuple(sorted(how.items()))
    if key not in _signers:
        _signers[key] = Signer(**how)
    return _signers[key]


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(id, n_shingles, set_key, bands): size and digest of each shingle set and its band keys (null for an empty set)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = signer_of(**how)
        for b in bounded(batches, "text"):
            n, digest, bands = [], [], []
            for t in b.column(1).to_pylist():
                s = signer.shingles(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(signer.keys(signer.signature(s)) if len(s) else None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "set_key", "bands"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run, lambda: signer_of(**how).hashes), f"id {kind}, n_shingles long, set_key binary, bands array<long>")


def private_counts(texts: DataFrame, **how: int) -> DataFrame:
    """(id, private): number of shingles of each text (id, text) that no other id has, where there are any."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = signer_of(**how)
        for b in bounded(batches, "text"):
            sets = [signer.shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    each = texts.select("id", "text").mapInArrow(tidy(run, lambda: signer_of(**how).hashes), f"id {kind}, shingles array<long>").select("id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("_other")).where("id = _other")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("private"))


def _set(text: str | None, n: int) -> set:
    w = words_of(text)
    return set(zip(*[w[j:] for j in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """Rows of ``pairs`` (centre, member and others) whose texts have 100 * intersection >= percent * union."""
    member = texts.select(F.col("id").alias("member"), F.col("text").alias("_tm"))
    centre = texts.select(F.col("id").alias("centre"), F.col("text").alias("_tc"))
    both = pairs.join(member, "member").join(centre, "centre").select(*pairs.columns, "_tc", "_tm")
    n = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in bounded(batches, "_tm"):
            keep = []
            for tc, tm in zip(b.column(n), b.column(n + 1).to_pylist()):
                tc = tc.as_py()
                if tc != last:
                    last, held = tc, _set(tc, words)
                other = _set(tm, words)
                same = len(held & other)
                keep.append(100 * same >= percent * (len(held) + len(other) - same))
            yield pa.RecordBatch.from_arrays(b.columns[:n], b.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), pairs.schema)


def blockwise(live: DataFrame, texts: DataFrame, percent: int = 75, **how: int) -> DataFrame:
    """(a, b): links between components among all members of each bucket (bucket, id, n, top, comp)."""
    words = how.get("words", WORDS)
    kind = dict(live.dtypes)["id"]
    blocks = live.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_of"))
    mine = F.pmod(F.xxhash64("id"), F.col("_of"))
    # a member meets its own block and every other one; the lower block comes first
    rows = live.join(blocks, "bucket").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    rows = rows.select("bucket", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "id", "n", "top", "comp")
    rows = rows.join(texts, "id").select("bucket", "_i", "_j", "_mine", "id", "n", "top", "comp", "text")

    def links(t: pa.Table) -> pa.Table:
        signer = signer_of(**how)
        texts_, comp = t.column("text").to_pylist(), t.column("comp").to_pylist()
        n, top, side, bucket = (t.column(c).to_numpy() for c in ("n", "top", "_mine", "bucket"))
        low = np.stack([signer.signature(signer.shingles(x)) for x in texts_])
        one = np.unique(np.array(comp, object), return_inverse=True)[1] if None not in comp else np.arange(len(comp))
        keys = np.stack([signer.keys(x) for x in low])
        k = low.shape[1]
        least = k * percent / 100 - SLACK * (k * percent / 100 * (1 - percent / 100)) ** 0.5
        across = t.column("_i")[0].as_py() != t.column("_j")[0].as_py()
        sets: dict[int, set] = {}
        found = set()
        for x in range(len(texts_) - 1):
            rest = slice(x + 1, None)
            may = (one[rest] != one[x]) & (n[rest] <= top[x]) & (n[x] <= top[rest])
            if across:
                may &= side[rest] != side[x]
            at = np.flatnonzero(may) + x + 1
            at = at[(low[at] == low[x]).sum(1) >= least]
            for y in at.tolist():
                if (comp[x], comp[y]) in found or keys[x][(keys[x] == keys[y]).argmax()] != bucket[0]:
                    continue  # each pair is confirmed in its first bucket only
                for z in (x, y):
                    if z not in sets:
                        sets[z] = _set(texts_[z], words)
                same = len(sets[x] & sets[y])
                if 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same):
                    found.add((comp[x], comp[y]))
        pairs = [(min(p), max(p)) for p in found]
        kept = t.schema.field("comp").type
        return pa.table({"a": pa.array([p[0] for p in pairs], kept), "b": pa.array([p[1] for p in pairs], kept)})

    return rows.groupBy("bucket", "_i", "_j").applyInArrow(links, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): lowest id reachable over links (a, b), for the ids that occur in them.

    Each round every tree hears the lowest grandparent among its neighbours, hooks its root and itself to that, and
    halves its own height; rounds grow with the logarithm of the longest path.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    state = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        up = state.join(state.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp").select("id", "comp", "top")
        heard = both.join(up.select(F.col("id").alias("b"), F.col("top").alias("low")), "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        now = up.join(heard, "id").select("id", "comp", F.least("top", "low").alias("low"))
        moves = now.select("id", "low").union(now.select(F.col("comp").alias("id"), "low"))
        new = materialize(
            moves.groupBy("id").agg(F.min("low").alias("low")).join(state, "id")
            .select("id", F.least("low", "comp").alias("comp"), (F.col("low") < F.col("comp")).alias("moved"))
        )
        state = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return state


def _unsettled(live: DataFrame) -> DataFrame:
    """Members of buckets of several components that have a partner of an allowed size there."""
    several = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).where("lo < hi")
    return live.join(several.select("bucket", "least"), "bucket").where("least <= top").drop("least")


def _relabelled(df: DataFrame, joined: DataFrame) -> DataFrame:
    """``df`` with each component that was joined to another replaced by that."""
    to = joined.select(F.col("id").alias("comp"), F.col("comp").alias("_to"))
    return df.join(to, "comp", "left").select(*[F.coalesce("_to", "comp").alias("comp") if c == "comp" else c for c in df.columns])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, **how: int) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Texts link when 100 * intersection >= percent * union of their sets of 5-word shingles (a text with fewer words is
    one shingle).  ``component_id`` is the lowest id reachable over links, the row's own included; ``kept`` says that
    it is the row's own.  Texts without words link with nothing.  Rows with a null id link with nothing and have a
    null component (not kept); repeated rows of one id are one document and have equal results.
    """
    small_batches(df.sparkSession)
    words = how.get("words", WORDS)
    sig = materialize(signatures(df, id_col, text_col, **how))
    full = sig.where("n_shingles > 0 and id is not null")
    sets = materialize(full.groupBy("set_key").agg(F.min("id").alias("rep")))
    # one band row per representative and band, where the bucket has more than one member
    reps = full.join(sets.select("set_key", F.col("rep").alias("id")), ["set_key", "id"], "left_semi").select("id", "n_shingles", "bands")
    rows = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = materialize(rows.join(shared, "bucket"))
    ids = crowd.groupBy("id").agg(F.sum("size").alias("degree"), F.max("n").alias("n"))
    texts = materialize(checked_join(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), materialize(ids.select("id")), ["id"], "left_semi"))
    # the largest partner that the shared shingles of a text allow
    shared = F.col("n") - F.coalesce("private", F.lit(0))
    top = F.floor((100 + percent) * shared / F.lit(percent)) - F.col("n")
    able = materialize(
        ids.join(private_counts(texts, **how), "id", "left").select("id", "degree", "n", top.alias("top"))
        .where(f"100 * (n + top) >= {100 + int(percent)} * n")  # a partner has at least ``percent`` of the size
    )
    live = crowd.select("bucket", "id").join(able, "id").select("bucket", "id", "n", "top", "degree", F.col("id").alias("comp"))
    labels = able.select("id", F.col("id").alias("comp"))
    while True:
        live = materialize(_unsettled(live))
        if live.isEmpty():
            break
        centres = live.groupBy("bucket").agg(F.max(F.struct("degree", "id", "n", "top", "comp")).alias("c"))
        centres = centres.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("cn"), F.col("c.top").alias("ctop"), F.col("c.comp").alias("ccomp"))
        pairs = (
            live.join(centres, "bucket").where("comp != ccomp and n <= ctop and cn <= top")
            .select("centre", F.col("id").alias("member"), F.least("comp", "ccomp").alias("a"), F.greatest("comp", "ccomp").alias("b")).distinct()
        )
        links = materialize(confirm(pairs, texts, percent, words).select("a", "b").distinct())
        if links.isEmpty():
            links = materialize(blockwise(live, texts, percent, **how))
            labels = _relabelled(labels, components(links)) if not links.isEmpty() else labels
            break
        live = live.join(centres.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_anti")
        joined = components(links)
        live, labels = _relabelled(live, joined), materialize(_relabelled(labels, joined))
    found = sets.join(labels, sets.rep == labels.id, "left").select("set_key", F.coalesce("comp", "rep").alias("component_id"))
    linked = sig.where("n_shingles > 0").select("id", "n_shingles", "set_key").join(found, "set_key", "left")
    alone = sig.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
