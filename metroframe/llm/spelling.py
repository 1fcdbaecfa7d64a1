"""Spelling variants: blocked Gram matrices of letter counts, edits verified, forms followed to their roots.

One edit changes the letter counts of a word by a squared distance of 1 (a letter more or less) or 2 (one letter for
another).  Words lie in cells: their length and the number of their letters in each of ``CLASSES`` classes.  One edit
moves a word to an adjacent length at most, and by one step in one class or from one class to another, so the words of
a cell meet those of 21 cells at most.  A cell is cut into blocks of bounded size; a pair of blocks is one row, whose
squared distances are one matrix product.  Pairs at most two apart are verified letter by letter.

Counts are exact and cover all texts.  The number of block pairs grows with the square of a cell, and cells with the
word length and the number of classes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded, small_batches

#: Runs of these Latin-1 letters are words; A-Z become a-z, all other characters part words.
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTERS else 32 for c in range(256))
SYMBOLS = bytes(sorted(set(_LETTERS.translate(FOLD))))
CODE = np.zeros(256, np.uint8)
CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
CLASSES = 4
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many runs of a document loses a letter where ``noise`` is on.
EVERY = 97
#: Words of a block, and letters of one.
BLOCK, BLOCK_LETTERS = 1024, 1 << 20
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000


def runs(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` as Latin-1 bytes; null has none."""
    return (text or "").encode("latin-1", "replace").translate(FOLD).split()


def thinned(key: str, run: bytes) -> bytes:
    """The run, or the run without one letter if 97 divides the crc32 of ``key:run``."""
    h = zlib.crc32((run if run.isascii() else run.decode("latin-1").encode()), zlib.crc32(f"{key}:".encode()))
    return run if h % EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: bool = False, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur ``least_count`` times or more.

    With ``noise`` some runs lose a letter, told by a hash of the id and the run (a null id counts as the empty text).
    """
    small_batches(df.sparkSession)

    def rows(found: Counter) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in bounded(batches, "text"):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w for w in runs(text) if len(w) >= least_length]
                if not noise:
                    found.update(words)
                    continue
                start = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(words).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % EVERY:
                        found[w] += n
                    elif len(w) > least_length:
                        found[w[: h % len(w)] + w[h % len(w) + 1 :]] += n
            if len(found) > HELD:
                yield from rows(found)
                found.clear()
        yield from rows(found)

    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def matrix(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row for each."""
    return CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    m, k = letters.shape[0], len(SYMBOLS)
    return np.bincount((np.arange(m)[:, None] * k + letters).ravel(), minlength=m * k).reshape(m, k).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` becomes that of ``b`` by one edit; both of one length, or ``b`` one letter longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= n


def near_in(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks that are one edit apart; each pair once where both are the ``same`` block."""
    if len(a[0]) > len(b[0]):
        y, x = near_in(b, a, same)
        return x, y
    la, lb = matrix(a), matrix(b)
    ca, cb = letter_counts(la), letter_counts(lb)
    # counts are small whole numbers, so single precision is exact up to words of thousands of letters
    kind = np.float32 if len(b[0]) < 2000 else np.float64
    ca, cb = ca.astype(kind), cb.astype(kind)
    near = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None] - 2 * (ca @ cb.T) <= 2
    x, y = np.nonzero(np.triu(near, 1) if same else near)
    step = max(1, 4_000_000 // len(b[0]))
    good = [one_edit(la[x[lo : lo + step]], lb[y[lo : lo + step]]) for lo in range(0, len(x), step)]
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return x[keep], y[keep]


def _cell_of(word: str = "word"):
    """Letters of a word in each class; their sum is its length."""
    def count(k: int):
        listed = "".join(chr(c) for c in SYMBOLS if c % CLASSES == k)
        return (F.length(word) - F.length(F.translate(word, listed, ""))).cast("int")

    return F.array(*[count(k) for k in range(CLASSES)])


def _steps() -> list[list[int]]:
    """Half of the ways in which one edit moves a word to another cell."""
    one = [[int(i == k) for i in range(CLASSES)] for k in range(CLASSES)]
    return one + [[x - y for x, y in zip(one[i], one[j])] for i in range(CLASSES) for j in range(i)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near ones; ``form`` is that of largest n.

    Near words differ by exactly one inserted, deleted or replaced letter.  Among equal n the first form in the order
    of code points counts.  Words hold the letters of ``SYMBOLS`` only and are distinct.
    """
    spark = words.sparkSession
    celled = words.select("word", "n", _cell_of().alias("cell"))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_LETTERS) / F.aggregate("cell", F.lit(0), lambda s, x: s + x))))
    cells = materialize(celled.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).select("cell", F.ceil(F.col("m") / size).cast("int").alias("of")))
    blocks = materialize(
        celled.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("of")).cast("int"))
        .groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("held"))  # BLOCK words, about
    )
    # each block with those that follow it in its own cell, and with all blocks of half the adjacent cells
    one = blocks.select("cell", "block", F.col("held").alias("mine"))
    steps = F.array(*[F.array(*map(F.lit, s)) for s in [[0] * CLASSES, *_steps()]])
    asked = one.withColumn("step", F.explode(steps)).withColumn("to", F.zip_with("cell", "step", lambda a, b: a + b))
    asked = asked.join(cells.select(F.col("cell").alias("to"), "of"), "to")
    asked = asked.withColumn("other", F.explode(F.sequence(F.when(F.col("to") == F.col("cell"), F.col("block")).otherwise(F.lit(0)), F.col("of") - 1)))
    pairs = asked.join(blocks.select(F.col("cell").alias("to"), F.col("block").alias("other"), F.col("held").alias("theirs")), ["to", "other"])
    pairs = pairs.select(((F.col("to") == F.col("cell")) & (F.col("block") == F.col("other"))).alias("same"), "mine", "theirs")
    # block pairs differ in size, and there are many of them
    pairs = pairs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def best(words_: list[str], n: np.ndarray, at: np.ndarray, other: list[str], other_n: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            top = other_n[to[lo:hi]].max()
            yield words_[at[lo]], hi - lo, int(top), min(other[k] for k in to[lo:hi][other_n[to[lo:hi]] == top].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = []
                sides = [b.column(c)[k].values for c in (1, 2)]
                (wa, na), (wb, nb) = ((s.field(0).to_pylist(), s.field(1).to_numpy()) for s in sides)
                same = b.column(0)[k].as_py()
                x, y = near_in(wa, wb, same)
                rows += best(wa, na, x, wb, nb, y)
                rows += best(wb, nb, y, wa, na, x)
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "m", "top", "form"])

    found = pairs.mapInArrow(run, "word string, m long, top long, form string")
    least = found.groupBy("word").agg(F.sum("m").alias("n_near"), F.min(F.struct((-F.col("top")).alias("less"), "form")).alias("b"))
    return least.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form): the last form reached.  Each round doubles the steps taken."""
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        to = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = materialize(state.join(to, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        state = new.select("word", "root")
        if new.where("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n).

    ``form`` is the near word of largest n, where that n is at least ``ratio`` (2 or more) times the word's own; so
    forms have no cycles and end after the logarithm of the largest n in steps.  Words without a form are their own
    root.  An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms end only where each is at least twice as frequent")
    words = materialize(words.select("word", "n"))
    near = materialize(near_words(words))
    out = words.join(near, "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    out = materialize(out.select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
