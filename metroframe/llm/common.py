"""Shared pieces of the text operators: words, hashes, character n-grams, bounded batches, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of a side that may be broadcast: 16 bytes each, so some tens of MB as a hash table.
BROADCAST_ROWS = 500_000


#: Rows of an Arrow batch, where the session has Spark's default: texts can be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in smaller batches than Spark's default, unless the session has a size of its own."""
    for key, default, mine in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", BATCH_BYTES)):
        if spark.conf.get(key).rstrip("bB") == default:
            spark.conf.set(key, str(mine))


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark drops a query's shuffle files when it ends, not when the driver collects its garbage.

    For steps that are each run once and whose results are stored.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: Callable[[], dict]):
    """``run``, after which the worker empties ``caches`` and gives its free memory back: it may serve other stages."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache().clear()
            hand_back()

    return inner


def hand_back() -> None:
    """Return freed memory of Arrow and of the C library to the machine, where they can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def with_columns(
    df: DataFrame, text_col: str, added: dict[str, str], values: Callable[[list[str | None]], list[pa.Array]], keep: list[str] | None = None,
    size: int = 400_000,
) -> DataFrame:
    """Columns ``keep`` of ``df`` (all, if None) with columns computed from the texts of a bounded batch by ``values``.

    ``added`` has the new names and types; columns of ``df`` with these names are replaced.
    """
    small_batches(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text_in"))
    fields = [f for f in rows.schema.fields if f.name != "_text_in"]
    schema = T.StructType(fields + [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_text_in", size):
            cols = [b.column(i) for i in range(len(kept))] + values(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays(cols, [*kept, *added])

    return rows.mapInArrow(tidy(run), schema)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to know."""
    return df.limit(rows + 1).count() <= rows


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only if a count shows it is small; else Spark shuffles both sides."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; null has none."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


class WordHashes(dict):
    """Word to 64-bit hash, remembered for as many words as ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes; fewer words give nothing."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : len(h) - n + 1 + j]
        out ^= out >> np.uint64(29)
    return mixed(out)


def bounded(batches: Iterator[pa.RecordBatch], column: str, size: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Split batches so that the texts of each hold about ``size`` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(n) - n) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with one space before every run of letters, and their text's index.

    All other characters go; a text without letters has nothing.
    """
    joined = "".join("\0" + (t or "").lower().replace("\0", " ") for t in texts)
    x = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    doc = np.cumsum(x == 0, dtype=np.int32) - 1
    letter = letters()[x]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    return np.where(letter, x, np.uint32(32))[keep], doc[keep]


def gram_buckets(x: np.ndarray, doc: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) of every character n-gram inside a text, one pair of arrays for each n in ``sizes``."""
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(x) < n:
            return
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + (x[n - 1 :] + np.uint32(1)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n in sizes:
            inside = doc[: len(x) - n + 1] == doc[n - 1 :]
            if n == 1:
                inside = inside & (x != 32)
            b = (h * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) >> np.uint32(32 - bits)
            yield b[inside].astype(np.int64), doc[: len(x) - n + 1][inside]
