"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket are summed by Spark from labelled rows; the matrix of log-probabilities (languages x
buckets, its size fixed by the parameters) is broadcast, and whole texts are scored in numpy as sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, gram_buckets, letter_codes, small_batches, with_columns

SIZES = (1, 2, 3)
BITS = 16
#: Labelled texts that each language is learned from, about (all, where there are fewer).
FIT_ROWS = 50_000
MAX_LANGS = 200


class Model:
    """Languages in order and the log-probabilities of buckets, one row for each language, priors apart."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray, sizes: tuple[int, ...], bits: int):
        self.langs, self.prior, self.logp, self.sizes, self.bits = langs, prior, logp, sizes, bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; ``und`` and 0 where there is no letter or no model."""
        n = len(texts)
        x, doc = letter_codes(texts)
        known = np.zeros(n, bool)
        known[doc] = True
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total = np.tile(self.prior, (n, 1))
        for bucket, row in gram_buckets(x, doc, self.sizes, self.bits):
            if not len(row):
                continue
            start = np.flatnonzero(np.diff(row, prepend=-1))  # rows of the sparse batch
            for k in range(len(self.langs)):
                total[row[start], k] += np.add.reduceat(self.logp[k][bucket], start)
        best = total.argmax(1)  # ties: the first language by name
        top = total.max(1, keepdims=True)
        score = 1.0 / np.exp(total - top).sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, score, 0.0)


def fit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES,
    bits: int = BITS, alpha: float = 0.1, fit_rows: int = FIT_ROWS, max_langs: int = MAX_LANGS,
) -> Model:
    """Learn from the rows of ``df`` with a language; rows with a null text or language teach nothing.

    Of a language with more than ``fit_rows`` rows, those whose hashed id falls below the matching share are used,
    so the cost of a fit is bounded whatever the corpus; the id and the text tell the draw.  Of more than ``max_langs``
    languages those with the most rows are learned (of equals the first by name), the others teach nothing.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_lang is not null and _text is not null")
    counted = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(max_langs).collect()}
    langs = sorted(counted)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 1 << bits)), sizes, bits)
    share: Column = F.lit(1.0)
    for lang in langs:
        if counted[lang] > fit_rows:
            share = F.when(F.col("_lang") == lang, F.lit(fit_rows / counted[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.col("_text"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(langs) << bits, np.int64)
        for b in bounded(batches, "_text", 300_000):
            lang = np.fromiter(map(place.__getitem__, b.column(1).to_pylist()), np.int64, b.num_rows)
            x, doc = letter_codes(b.column(0).to_pylist())
            for bucket, row in gram_buckets(x, doc, sizes, bits):
                n += np.bincount((lang[row] << bits) | bucket, minlength=n.size)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["slot", "n"])

    summed = rows.where(F.col("_lang").isin(langs) & (draw < share)).select("_text", "_lang").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(langs) << bits)
    n[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    n = n.reshape(len(langs), 1 << bits)
    logp = np.log(n + alpha) - np.log(n.sum(1, keepdims=True) + alpha * (1 << bits))
    size = np.array([counted[v] for v in langs], float)
    return Model(langs, np.log(size / size.sum()), logp, sizes, bits)


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Rows of ``df`` (columns ``keep``, else all) with the predicted language and its posterior.

    Columns already so named are replaced.  Null texts and texts without a letter are ``und`` with score 0; equal
    posteriors give the first language by name.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def values(texts: list[str | None]) -> list[pa.Array]:
        lang, score = held.value.predict(texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return with_columns(df, text_col, {out[0]: "string", out[1]: "double"}, values, keep, 300_000)
