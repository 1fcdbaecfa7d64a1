"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams.  From labelled texts Spark counts, per bucket, the toxic and other
texts that hold it; the smoothed log-ratio of both shares scales the feature.  All buckets whose chi-square statistic
is significant (``LEAST_CHI``) keep their feature, however many there are; weights are fitted by accelerated gradient descent, each gradient
summed by Spark over the stored sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded, gram_buckets, letter_codes, small_batches, with_columns

SIZES = (3, 4, 5)
BITS = 18
#: Labelled texts of each class that a model is learned from, about (all, where there are fewer).
FIT_ROWS = 50_000
#: Chi-square from which a bucket keeps its feature: one degree of freedom, level 0.001.
LEAST_CHI = 10.828


def _distinct(x: np.ndarray, doc: np.ndarray, n: int, sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct buckets of each text, ordered by text; only ``wanted`` ones if given."""
    keys = [np.empty(0, np.int64)]
    for bucket, row in gram_buckets(x, doc, sizes, bits):
        if wanted is not None:
            has = wanted[bucket]
            bucket, row = bucket[has], row[has]
        keys.append((row.astype(np.int64) << bits) | bucket)
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


class Model:
    """Weights of the selected buckets (already multiplied by their log-count ratios) and the intercept."""

    def __init__(self, weight: np.ndarray, bias: float, sizes: tuple[int, ...], bits: int):
        self.weight, self.bias, self.sizes, self.bits = weight, bias, sizes, bits

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic."""
        x, doc = letter_codes(texts)
        row, bucket = _distinct(x, doc, len(texts), self.sizes, self.bits, self.weight != 0)
        z = np.bincount(row, self.weight[bucket], minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(
    df: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, bits: int = BITS,
    least_chi: float = LEAST_CHI, alpha: float = 1.0, ridge: float = 1e-3, rounds: int = 15, fit_rows: int = FIT_ROWS,
) -> Model:
    """Learn from rows labelled 1 or 0; rows with a null text or another label teach nothing.

    Of a class with more than ``fit_rows`` rows, those whose hashed id falls below the matching share are used, with
    the weight that they stand for.  With rows of one class only every score is next to that class, without any it is 0.5.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).cast("int").alias("_y")).where("_text is not null and _y in (0, 1)")
    counted = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 << bits
    n0, n1 = counted.get(0, 0), counted.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(size), 0.0 if n0 == n1 else (20.0 if n1 else -20.0), sizes, bits)
    share = [min(1.0, fit_rows / n) for n in (n0, n1)]
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.col("_text"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(draw < F.when(F.col("_y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))).select("_text", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * size + 2, np.int64)
        for b in bounded(batches, "_text", 300_000):
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            x, doc = letter_codes(b.column(0).to_pylist())
            row, bucket = _distinct(x, doc, b.num_rows, sizes, bits)
            n[: 2 * size] += np.bincount((y[row] << bits) | bucket, minlength=2 * size)
            n[2 * size :] += np.bincount(y, minlength=2)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["slot", "n"])

    summed = picked.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2 * size + 2)
    n[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    m0, m1 = max(n[-2], 1.0), max(n[-1], 1.0)
    p0, p1 = n[:size], n[size : 2 * size]
    ratio = np.log((p1 + alpha) / (m1 + 2 * alpha)) - np.log((p0 + alpha) / (m0 + 2 * alpha))
    # chi-square of presence against class
    q0, q1 = p0 / m0, p1 / m1
    q = (p0 + p1) / (m0 + m1)
    chi = np.divide((q1 - q0) ** 2, q * (1 - q) * (1 / m0 + 1 / m1), out=np.zeros(size), where=(q > 0) & (q < 1))
    top = np.flatnonzero(chi > least_chi)
    if not len(top):
        return Model(np.zeros(size), float(np.log(n1 / n0)), sizes, bits)
    wanted = np.zeros(size, bool)
    wanted[top] = True
    place = np.full(size, -1, np.int64)
    place[top] = np.arange(len(top))
    scale = ratio[top]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_text", 300_000):
            x, doc = letter_codes(b.column(0).to_pylist())
            row, bucket = _distinct(x, doc, b.num_rows, sizes, bits, wanted)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            f = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[bucket].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(1), f], ["y", "f"])

    stored = materialize(picked.mapInArrow(sparse, "y int, f array<int>"))
    weight = (n0 / m0, n1 / m1)

    def gradient(w: np.ndarray, bias: float) -> np.ndarray:
        """Gradient of the summed loss for weights and bias, and the diagonal bound of its curvature."""
        scaled = w * scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(len(scaled) + 1)
            for b in batches:
                y = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                f = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
                z = np.bincount(row, scaled[f], minlength=b.num_rows) + bias
                e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * np.where(y == 1, weight[1], weight[0])
                g[:-1] += np.bincount(f, e[row], minlength=len(scaled)) * scale
                g[-1] += e.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(g)], ["slot", "g"])

        got = stored.mapInArrow(run, "slot long, g double").groupBy("slot").agg(F.sum("g").alias("g")).toArrow()
        out = np.zeros(len(scaled) + 1)
        out[got.column("slot").to_numpy()] = got.column("g").to_numpy()
        return out

    # step sizes from the diagonal of the curvature at 1/4, made safe by the mean number of features of a text
    total = n0 + n1
    per_text = max(1.0, (p0[top].sum() * weight[0] + p1[top].sum() * weight[1]) / total)
    curve = 0.25 * np.append((p0[top] * weight[0] + p1[top] * weight[1]) * scale**2 * np.sqrt(per_text), total) / total + ridge
    theta = np.append(np.zeros(len(top)), np.log(n1 / n0))
    ahead, speed = theta.copy(), 1.0
    for _ in range(rounds):
        g = gradient(ahead[:-1], float(ahead[-1])) / total + ridge * np.append(ahead[:-1], 0.0)
        new = ahead - g / curve
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - theta)
        theta, speed = new, faster
    w = np.zeros(size)
    w[top] = theta[:-1] * scale
    return Model(w, float(theta[-1]), sizes, bits)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Rows of ``df`` (columns ``keep``, else all) with the probability of toxicity (a column so named is replaced).

    Null and empty texts get the score of a text without any feature.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    return with_columns(df, text_col, {out: "double"}, lambda texts: [pa.array(held.value.score(texts), pa.float64())], keep, 300_000)
