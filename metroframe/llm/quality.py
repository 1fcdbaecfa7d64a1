"""Quality rules: base rules on words and lines, then a hashed n-gram log-likelihood ratio.

A text's n-grams are its words and word pairs, and its runs of punctuation marks and pairs of runs, hashed to
2^``BITS`` buckets.  The ratio of a trusted multinomial to that of the whole corpus, averaged over the text's
n-grams, is compared with a fixed threshold: every document has one verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, bounded, checked_join, mixed, shingle_hashes, small_batches, with_columns

BITS = 14
#: Nats per n-gram below which a text is dropped.
THRESHOLD = -0.15
LEAST_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 20, 8, 30
_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Marks to spaces, and everything else to spaces.
_NO_MARKS = bytes(32 if c in _MARKS else c for c in range(256))
_NO_WORDS = bytes(c if c in _MARKS else 32 for c in range(256))


def _grams(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    """Buckets of the words, word pairs, runs of marks and pairs of runs of a lower-cased text."""
    parts = []
    for k, part in enumerate((text.translate(_NO_MARKS).split(), text.translate(_NO_WORDS).split())):
        h = hashes.array(part)
        if len(h):
            parts += [mixed(h + np.uint64(k)), shingle_hashes(h, 2) + np.uint64(k)]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64) if parts else np.empty(0, np.int64)


def measures(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); null has none."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    repeat = 0
    h = shingle_hashes(hashes.array(words), REPEAT_WORDS)
    if len(h):
        _, place, n = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[place] > 1)
        if len(at):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + REPEAT_WORDS, -1)
            repeat = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat


def fit(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """Log-ratio of each bucket; counts of the trusted ids and of all rows, summed by Spark."""
    small_batches(df.sparkSession)
    marks = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("good", F.lit(True))
    rows = checked_join(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), marks, ["id"], "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = WordHashes(), np.zeros((2, 1 << bits), np.int64)
        for b in bounded(batches, "text"):
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(_grams((text or "").encode("utf-8", "replace").translate(LOWER), hashes, bits), minlength=1 << bits)
                n[0] += c
                if good:
                    n[1] += c
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], ["slot", "every", "good"])

    got = rows.mapInArrow(count, "slot long, every long, good long").groupBy("slot").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).toArrow()
    every, good = np.zeros(1 << bits), np.zeros(1 << bits)
    slot = got.column("slot").to_numpy()
    every[slot], good[slot] = got.column("every").to_numpy(), got.column("good").to_numpy()
    if not good.sum():
        return np.zeros(1 << bits)
    share = [(c + alpha) / (c.sum() + alpha * c.size) for c in (good, every)]
    return np.log(share[0]) - np.log(share[1])


def judge(df: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Null and empty texts have no words, fail the base rules and have an llr of 0; columns already so named go.
    """
    held = df.sparkSession.sparkContext.broadcast(ratio)
    bits = (len(ratio) - 1).bit_length()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own: dict[str, WordHashes] = {}

    def values(texts: list[str | None]) -> list[pa.Array]:
        hashes = own.setdefault("hashes", WordHashes())
        rows = [measures(t, hashes) for t in texts]
        llr = []
        for t in texts:
            g = _grams((t or "").encode("utf-8", "replace").translate(LOWER), hashes, bits)
            llr.append(float(held.value[g].mean()) if len(g) else 0.0)
        return [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array(llr, pa.float64())]

    added = {n: "long" for n in names} | {"llr": "double"}
    base = [c for c in (df.columns if keep is None else keep) if c not in ("base_failed", "kept")]
    out = with_columns(df, text_col, added, values, base)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
