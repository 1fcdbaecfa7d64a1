"""Language-model scoring: deleted interpolation of word bigrams, words and a uniform floor.

P(w | v) = a(b) c(v,w) / c(v) + u(b) c(w) / N + z(b) / (V + 1), where b is the bucket of the context's frequency
c(v) and V the number of distinct training words.  The weights of a bucket are learned by expectation-maximisation on
held-out counts: every training event is held out of its own counts (c - 1), the deleted estimate.  All training events
are used; a histogram of their held-out estimates, of bounded size, is what the driver gathers.

Counts are exact.  Words and bigrams that are frequent in a bounded sample (``HEAD_WORDS``, ``HEAD_PAIRS``) are counted
in place and their counts are broadcast; this bounds how often any other word or bigram occurs, so all the others are
counted by one shuffle in which an event meets the other events of its n-gram.  Which n-grams are in the lists changes
the route of an event, never a count.

The shuffle moves packed arrays: the events of some thousand texts are dealt to as many buckets as the corpus needs for
``BUCKET_EVENTS`` in each, by the hash of their n-gram.  What meets there is stored once (counts of every n-gram and
the texts that hold it); the weights are learned from a histogram of it, and the scores are added up from it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from .common import bounded, mixed, shuffles_dropped, small_batches, tidy, words_of

BITS = 17
START, END, FIRST_WORD = 0, 1, 2
HEAD_WORDS = (1 << BITS) - FIRST_WORD
HEAD_PAIRS = 1 << 18
#: Training documents, about, from which the lists of frequent words and bigrams are taken.
HEAD_DOCS = 8_000
BUCKETS = 21
SCALE = 2.0**26  # of fixed-point sums
STEP = 8  # bins for each doubling of a held-out estimate
LISTED = 3  # role of a bigram in the list
#: Events of a bucket, about, and events gathered before they are dealt to buckets.
BUCKET_EVENTS = 1 << 18
GATHERED = 1 << 19
#: Kinds of stored rows: n-grams with their counts and texts, sums of texts, the two halves of a bigram of unlisted
#: words (word known, context known), histogram.
MET, SUMS, WORD_HALF, CONTEXT_HALF, HISTOGRAM = range(5)
STORED = ["kind", "bucket", "a", "b", "c", "d", "size", "n", "id", "slot", "m"]


class Codes(dict):
    """Word to code: its number for listed words, a negative hash for others."""

    def __init__(self, listed: dict[bytes, int], limit: int = 150_000):
        super().__init__(listed)
        self.listed, self.limit = listed, len(listed) + limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.listed)
        code = self[word] = -1 - (xxhash.xxh3_64_intdigest(word) >> 1)
        return code


class Lists:
    """Frequent words and bigrams, in the order of their numbers."""

    def __init__(self, words: list[bytes], pairs: np.ndarray):
        self.words, self.pairs = words, pairs

    def codes(self) -> Codes:
        return Codes({w: i + FIRST_WORD for i, w in enumerate(self.words)})

    def place(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Number of each bigram in the list, -1 if it is not there."""
        at = np.full(len(v), -1, np.int64)
        both = np.flatnonzero((v >= 0) & (w >= 0))
        if len(self.pairs) and len(both):
            key = (v[both] << BITS) | w[both]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            at[both] = np.where(self.pairs[k] == key, k, -1)
        return at


def events(texts: list[str | None], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and text index of every token; a text ends with END and begins after START."""
    parts, sizes = [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words) + 1)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([END], np.int64))
    w = np.concatenate(parts)
    row = np.repeat(np.arange(len(texts)), sizes)
    v = np.concatenate([[START], w[:-1]])
    v[np.cumsum(sizes) - np.array(sizes)] = START
    return v, w, row


def shuffled(v: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, roles, partners and event index of events; ``at`` is their place in the list of bigrams.

    A listed bigram is keyed by both words (role LISTED, partner its place), an unlisted token by itself (role 0), an
    unlisted context by itself (role 1), any other bigram of two listed words by both (role 0, partner 0); if both are
    unlisted there are two rows.
    """
    e = np.flatnonzero((v >= 0) & (w >= 0))
    a, b = np.flatnonzero(w < 0), np.flatnonzero(v < 0)
    key = np.concatenate([(v[e] << BITS) | w[e], w[a], v[b]])
    role = np.concatenate([np.where(at[e] >= 0, LISTED, 0), np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    other = np.concatenate([np.maximum(at[e], 0), v[a], w[b]])
    return key, role, other, np.concatenate([e, a, b])


def merged(key: np.ndarray, role: np.ndarray, other: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and number of the distinct (key, role, other, row)."""
    k = np.uint64(0x9E3779B97F4A7C15)
    z = mixed(key.view(np.uint64) * k + mixed(other.view(np.uint64) * k + mixed(row.astype(np.uint64) * np.uint64(4) + role.astype(np.uint64))))
    _, first, n = np.unique(z, return_index=True, return_counts=True)
    return first, n


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of equal bytes: small or like numbers take little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    planes = np.frombuffer(pa.decompress(b[4:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def pack_ids(ids: pa.Array) -> bytes:
    """Ids of any type: whole numbers by planes, others as an Arrow batch."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return b"n" + pack(ids.to_numpy())
    raw = pa.record_batch([ids], ["id"]).serialize()
    return b"b" + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_ids(b: bytes, kind: pa.DataType) -> pa.Array:
    if b[:1] == b"n":
        return pa.array(unpack(b[1:])).cast(kind)
    raw = pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), "zstd")
    return pa.ipc.read_record_batch(raw, pa.schema([("id", kind)])).column(0)


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def dealt(key: np.ndarray, n: int) -> np.ndarray:
    return (mixed(key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket; they come sorted by the first column, ``bucket``."""
    open_: list[pa.RecordBatch] = []
    for b in batches:
        at = b.column(0).to_numpy()
        cuts = cuts_of(at)
        for lo, hi in zip(cuts, cuts[1:]):
            if open_ and open_[0].column(0)[0].as_py() != at[lo]:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(b.slice(lo, hi - lo))
    if open_:
        yield pa.Table.from_batches(open_)


def joined(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of packed cells as one array."""
    return np.concatenate([unpack(x) for x in column.to_pylist()] or [np.empty(0, np.int64)])


def ids_joined(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """All ids of packed cells as one array."""
    return pa.concat_arrays([unpack_ids(x, kind) for x in column.to_pylist()] or [pa.array([], kind)])


def summed_by(ids: pa.Array, *values: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct ids (null is one) and the sums of values, whole numbers, of each."""
    coded = ids.dictionary_encode(null_encoding="encode")
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    return coded.dictionary, [np.bincount(at, v, minlength=n).astype(np.int64) for v in values]


def stored(kind: int, bucket: int = 0, ids: pa.Array | None = None, slot: np.ndarray | None = None, m: np.ndarray | None = None, **packed: np.ndarray) -> pa.RecordBatch:
    """One row of the table of what met."""
    lists = [None if x is None else x.tolist() for x in (slot, m)]
    held = pa.array([None if ids is None else pack_ids(ids)], pa.binary())
    cols = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64())]
    cols += [pa.array([pack(packed[c]) if c in packed else None], pa.binary()) for c in ("a", "b", "c", "d", "size", "n")]
    return pa.RecordBatch.from_arrays([*cols, held, *[pa.array([x], pa.list_(pa.int64())) for x in lists]], STORED)


class Histogram:
    """Held-out estimates of n-grams by bins; slot -1 holds the number of unlisted words."""

    def __init__(self):
        self.slot, self.m = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, slot: np.ndarray, m: np.ndarray) -> None:
        self.slot, at = np.unique(np.concatenate([self.slot, slot]), return_inverse=True)
        self.m = np.bincount(at, np.concatenate([self.m, m]), minlength=len(self.slot)).astype(np.int64)


def bins(p: np.ndarray, c: np.ndarray, w: np.ndarray, tokens: int) -> np.ndarray:
    """Bin of events held out of their own counts: a bucket and both estimates in steps."""
    x2 = np.where(p > 1, np.rint(STEP * np.log2(np.maximum(p - 1, 1) / np.maximum(c - 1, 1))), -1000).astype(np.int64)
    x1 = np.where(w > 1, np.rint(STEP * np.log2(np.maximum(w - 1, 1) / max(1, tokens - 1))), -1000).astype(np.int64)
    return (bucket(c - 1) * 1024 - x2) * 1024 - x1


def fixed(x: np.ndarray) -> np.ndarray:
    """Fixed-point numbers: sums of these do not depend on their order."""
    return np.rint(x * SCALE).astype(np.int64)


class Model:
    """Counts of the listed n-grams, number of unlisted training tokens (``rest``), and what is learned."""

    def __init__(self, lists: Lists, count: np.ndarray, pair: np.ndarray, tokens: int, rest: int):
        self.lists, self.count, self.pair, self.tokens, self.rest = lists, count, pair, tokens, rest
        self.distinct, self.weights = 0, np.empty((0, 3))

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        a, u, z = self.weights[bucket(context)].T
        return np.log10(a * pair / np.maximum(context, 1) + u * word / max(self.tokens, 1) + z / (self.distinct + 1))


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole logarithm to base 2, at most BUCKETS - 1."""
    return np.where(c > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(c, 1)))), 0).astype(np.int64)


def _lists(train: DataFrame, n_docs: int, head_docs: int) -> Lists:
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("lists")), F.lit(1_000_000)) / 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for b in bounded(batches, "text"):
            for t in b.column(0).to_pylist():
                w = words_of(t)
                words.update(w)
                pairs.update(zip([b""] + w, w + [b""]))
        for found, kind in ((words, 0), (pairs, 1)):
            some = list(found.items())
            for lo in range(0, len(some), 50_000):
                part = some[lo : lo + 50_000]
                first, second = (([k for k, _ in part], [b""] * len(part)) if kind == 0 else zip(*[k for k, _ in part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(part), pa.int32()), pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array([n for _, n in part], pa.int64())],
                    ["kind", "a", "b", "n"])

    sample = train.where(draw < min(1.0, head_docs / max(1, n_docs))).select("text")
    counted = materialize(sample.mapInArrow(count, "kind int, a binary, b binary, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where("n > 1"))
    top = lambda kind, size: counted.where(f"kind = {kind} and n > {2 * kind}").orderBy(F.desc("n"), "a", "b").limit(size).toArrow()
    words = top(0, HEAD_WORDS).column("a").to_pylist()
    number = {w: i + FIRST_WORD for i, w in enumerate(words)}
    pairs = top(1, HEAD_PAIRS)
    keys = [
        (number.get(a, -1) if a else START) << BITS | (number.get(b, -1) if b else END)
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()) if (not a or a in number) and (not b or b in number)
    ]
    return Lists(words, np.unique(np.array(keys, np.int64)))


def expectation_maximisation(where: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket from held-out events with estimates p2 and p1, n times each."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    each = np.stack([p2, p1, np.full(len(p1), floor)], 1)
    pooled = np.full(3, 1 / 3)
    for _ in range(rounds):
        part = weights[where] * each
        part *= (n / part.sum(1))[:, None]
        sums = np.stack([np.bincount(where, part[:, j], minlength=BUCKETS) for j in range(3)], 1)
        pooled = (sums.sum(0) + 1e-3) / (sums.sum() + 3e-3)
        # one event's worth of the pooled weights, so that no bucket is empty and no weight is nought
        weights = (sums + pooled) / (sums.sum(1, keepdims=True) + 1.0)
    weights[0, 0] = 0.0  # an unseen context has no bigram estimate
    weights[0] = (weights[0] + [0.0, 1e-6, 1e-6]) / (weights[0].sum() + 2e-6)
    return weights


class Fitted:
    """A model, and the stored events of the frame that it was fitted on."""

    def __init__(self, model: Model, source: tuple, met: list[DataFrame]):
        self.model, self.source, self.met = model, source, met

    def __getattr__(self, name: str):
        return getattr(self.model, name)


def _counts(train: DataFrame, lists: Lists) -> Model:
    """Counts of the listed n-grams in the texts of ``train``."""
    n_words, n_pairs = FIRST_WORD + len(lists.words), len(lists.pairs)
    held = train.sparkSession.sparkContext.broadcast(lists)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the listed words and bigrams, and (key -1) of the unlisted words."""
        codes, n, rest = held.value.codes(), np.zeros(n_words + n_pairs, np.int64), 0
        for b in bounded(batches, "text"):
            v, w, _ = events(b.column(0).to_pylist(), codes)
            n[START] += b.num_rows
            n[:n_words] += np.bincount(w[w >= 0], minlength=n_words)
            at = held.value.place(v, w)
            n[n_words:] += np.bincount(at[at >= 0], minlength=n_pairs)
            rest += int((w < 0).sum())
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([rest], pa.int64())], ["key", "n"])

    summed = train.select("text").mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, total = (c.to_numpy() for c in summed.columns)
    n = np.zeros(n_words + n_pairs, np.int64)
    n[key[key >= 0]] = total[key >= 0]
    rest = int(total[key < 0].sum())
    return Model(lists, n[:n_words], n[n_words:], int(n[END:n_words].sum()) + rest, rest)


def _meet(df: DataFrame, model: Model, train_col: str, id_col: str, text_col: str) -> list[DataFrame]:
    """Stored events of all texts, each with the training counts of its n-gram (see ``STORED``).

    Rows of kind MET hold n-grams: a, b, c their counts c(v,w), c(v) and c(w), ``size`` how many of the entries of ``n``
    and ``id`` are theirs.  Rows of kind SUMS hold texts: a tokens, b known ones, c minus the base's logarithms.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    n_buckets = max(1, model.tokens // BUCKET_EVENTS)
    n_halves = max(1, model.rest // BUCKET_EVENTS)
    tokens = model.tokens
    id_type = to_arrow_type(df.schema[id_col].dataType)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        codes = m.lists.codes()
        parts: list[tuple[np.ndarray, ...]] = []
        ids: list[pa.Array] = []
        size = n_rows = 0

        def gathered() -> Iterator[pa.RecordBatch]:
            key, other, meta, row, n_tokens, known, base = (np.concatenate(x) for x in zip(*parts))
            whole = pa.concat_arrays(ids)
            # listed bigrams need not meet: they are dealt by their text
            to = dealt(np.where((meta >> 1) & 3 == LISTED, row * 7_919 + size, key), n_buckets)
            order = np.argsort(to.astype(np.uint16) if n_buckets < 1 << 16 else to, kind="stable")
            cuts = cuts_of(to[order])
            key, other, meta, of = key[order], other[order], meta[order], whole.take(pa.array(row[order]))
            spans = list(zip(cuts, cuts[1:]))
            packed = [pa.array([pack(x[lo:hi]) for lo, hi in spans], pa.binary()) for x in (key, other, meta)]
            packed.append(pa.array([pack_ids(of.slice(lo, hi - lo)) for lo, hi in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts[:-1]]), pa.array(np.full(len(spans), MET, np.int32)), *packed], names)
            some = pa.array(dealt(np.array([size + n_rows]), n_buckets))
            packed = [pa.array([x], pa.binary()) for x in (pack(n_tokens), pack(known), pack(base), pack_ids(whole))]
            yield pa.RecordBatch.from_arrays([some, pa.array([SUMS], pa.int32()), *packed], names)

        names = ["bucket", "kind", "key", "other", "meta", "id"]
        for b in bounded(batches, "text"):
            v, w, row = events(b.column(1).to_pylist(), codes)
            n = b.num_rows
            listed = w >= 0
            c = m.count[w[listed]]
            base = np.bincount(row[listed], np.log10(c + 0.1), minlength=n)
            known = np.bincount(row[listed], c > 0, minlength=n).astype(np.int64)
            key, role, other, at = shuffled(v, w, m.lists.place(v, w))
            row_of = row[at]
            first, times = merged(key, role, other, row_of)
            train = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            meta = times * 8 + role[first] * 2 + train[row_of[first]]
            parts.append((key[first], other[first], meta, row_of[first] + n_rows, np.bincount(row, minlength=n), known, fixed(base)))
            ids.append(b.column(0))
            size, n_rows = size + len(first), n_rows + n
            if size >= GATHERED:
                yield from gathered()
                parts, ids, size, n_rows = [], [], 0, 0
        if parts:
            yield from gathered()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = held.value, Histogram()
        mask = (1 << BITS) - 1
        for t in by_bucket(batches):
            of = t.column("kind").to_numpy()
            for i in np.flatnonzero(of == SUMS).tolist():
                r = t.slice(i, 1)
                n_tokens, known, base = (joined(r.column(c)) for c in ("key", "other", "meta"))
                yield stored(SUMS, ids=ids_joined(r.column("id"), id_type), a=n_tokens, b=known, c=base)
            t = t.filter(pa.array(of == MET))
            if not t.num_rows:
                continue
            key, other, meta = (joined(t.column(c)) for c in ("key", "other", "meta"))
            ids = ids_joined(t.column("id"), id_type)
            role = (meta >> 1) & 3
            order = np.lexsort((other, role, key))
            key, other, role, times = key[order], other[order], role[order], meta[order] >> 3
            trained = times * (meta[order] & 1)
            ids = ids.take(pa.array(order))
            turn = np.concatenate([[True], (np.diff(key) != 0)])
            new = turn | np.concatenate([[True], (np.diff(role) != 0) | (np.diff(other) != 0)])
            first, word = np.flatnonzero(new), np.cumsum(turn) - 1
            gram = np.cumsum(new) - 1
            own = np.bincount(word, trained * (role == 0)).astype(np.int64)
            k, r, o, mine = key[first], role[first], other[first], own[word[first]]
            pair = np.bincount(gram, trained).astype(np.int64)
            ready = r == LISTED
            pair[ready] = m.pair[o[ready]]
            lent = np.where(o >= 0, m.count[np.where((o >= 0) & (k < 0), o, 0)], -1)
            cv = np.where(k >= 0, m.count[np.maximum(k, 0) >> BITS], np.where(r == 1, mine, lent))
            cw = np.where(k >= 0, m.count[np.maximum(k, 0) & mask], np.where(r == 0, mine, lent))
            size = np.diff(np.append(first, len(key)))
            half = (k < 0) & (o < 0)

            def part(which: np.ndarray) -> dict:
                """Entries of the n-grams ``which``, in that order."""
                n = size[which]
                at = np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                return {"size": n, "n": times[at], "ids": ids.take(pa.array(at))}

            one = np.flatnonzero(~half)
            yield stored(MET, a=pair[one], b=cv[one], c=cw[one], **part(one))
            told = ~half & ~ready & (pair > 0)
            seen.add(bins(pair[told], cv[told], cw[told], tokens), pair[told])
            seen.add(np.array([-1]), np.array([int(((key[turn] < 0) & (own > 0)).sum())]))
            rare = (key < 0) & (role == 0)
            if rare.any():
                c = own[word[rare]]
                logs = fixed(times[rare] * np.log10(c + 0.1))
                found, (known, base) = summed_by(ids.filter(pa.array(rare)), times[rare] * (c > 0), logs)
                yield stored(SUMS, ids=found, a=np.zeros(len(found), np.int64), b=known, c=base)
            for sort, side in ((WORD_HALF, 0), (CONTEXT_HALF, 1)):
                which = np.flatnonzero(half & (r == side))
                v, w = (o[which], k[which]) if side == 0 else (k[which], o[which])
                to = dealt(v * 31 + w, n_halves)
                order = np.argsort(to, kind="stable")
                cuts = cuts_of(to[order])
                for lo, hi in zip(cuts, cuts[1:]):
                    at = order[lo:hi]
                    more = part(which[at]) if side == 0 else {}
                    yield stored(sort, int(to[at[0]]), a=v[at], b=w[at], c=mine[which[at]], d=pair[which[at]], **more)
        if len(seen.slot):
            yield stored(HISTOGRAM, slot=seen.slot, m=seen.m)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The halves of a bigram of two unlisted words: each side has every such bigram of the bucket once."""
        seen = Histogram()
        for t in by_bucket(batches):
            of = t.column("kind").to_numpy()
            right, left = (t.filter(pa.array(of == k)) for k in (WORD_HALF, CONTEXT_HALF))
            at, to = (np.lexsort((joined(x.column("a")), joined(x.column("b")))) for x in (left, right))
            cv = np.empty(len(to), np.int64)
            cv[to] = joined(left.column("c"))[at]
            cw, pair, size, n = (joined(right.column(c)) for c in ("c", "d", "size", "n"))
            yield stored(MET, ids=ids_joined(right.column("id"), id_type), a=pair, b=cv, c=cw, size=size, n=n)
            told = pair > 0
            seen.add(bins(pair[told], cv[told], cw[told], tokens), pair[told])
        if len(seen.slot):
            yield stored(HISTOGRAM, slot=seen.slot, m=seen.m)

    shape = f"kind int, bucket long, a binary, b binary, c binary, d binary, size binary, n binary, id binary, slot array<long>, m array<long>"
    with shuffles_dropped(spark):
        sent = rows.mapInArrow(tidy(send), f"bucket long, kind int, key binary, other binary, meta binary, id binary")
        one = materialize(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(met), shape))
        halves = one.where(F.col("kind").isin(WORD_HALF, CONTEXT_HALF)).select("bucket", "kind", "a", "b", "c", "d", "size", "n", "id")
        two = materialize(halves.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(whole), shape))
    return [one, two]


def _histogram(met: list[DataFrame]) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots and numbers of all events outside the list of bigrams, and the number of unlisted training words."""
    both = met[0].unionByName(met[1]).where(F.col("kind") == HISTOGRAM)
    each = both.select(F.explode(F.arrays_zip("slot", "m")).alias("x")).groupBy("x.slot").agg(F.sum("x.m").alias("m")).toArrow()
    slot, m = each.column("slot").to_numpy(), each.column("m").to_numpy()
    return slot[slot >= 0], m[slot >= 0], int(m[slot == -1].sum())


def fit(df: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", head_docs: int = HEAD_DOCS) -> Fitted:
    """Model of the rows where ``train_col`` is true; the events of all rows are stored on the way, for ``score``."""
    small_batches(df.sparkSession)
    train = df.where(F.col(train_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = _lists(train, train.count(), head_docs)
    model = _counts(train, lists)
    met = _meet(df, model, train_col, id_col, text_col)
    slot, m, unlisted = _histogram(met)
    word, pair = model.count, model.pair
    model.distinct = int((word[END:] > 0).sum()) + unlisted
    v, w = lists.pairs >> BITS, lists.pairs & ((1 << BITS) - 1)
    some = pair > 0
    # one order of the bins, so that the weights do not depend on that of the rows
    slot, at = np.unique(np.concatenate([slot, bins(pair[some], word[v[some]], word[w[some]], model.tokens)]), return_inverse=True)
    m = np.bincount(at, np.concatenate([m, pair[some]]), minlength=len(slot)).astype(float)
    x1, x2 = -(slot % 1024), -((slot // 1024) % 1024)
    p2, p1 = (np.where(x <= -1000, 0.0, 2.0 ** (x / STEP)) for x in (x2, x1))
    model.weights = expectation_maximisation(slot // (1024 * 1024), p2, p1, m, 1 / (model.distinct + 1))
    return Fitted(model, (df, train_col, id_col, text_col), met)


def score(df: DataFrame, fitted: Fitted, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): one row for each id.

    A null text is empty: its only token is its end.  Rows that share an id (null too) are parts of one document, each
    with its own end: their tokens and scores are added.  The frame that the model was fitted on has its events stored;
    those of any other meet first, and counts of unlisted n-grams are those of its own training rows.
    """
    model, met, distinct = fitted.model, fitted.met, fitted.distinct
    source = (df, train_col, id_col, text_col)
    if any(a is not b and (i == 0 or a != b) for i, (a, b) in enumerate(zip(source, fitted.source))):
        met = _meet(df, model, train_col, id_col, text_col)
        distinct = int((model.count[END:] > 0).sum()) + _histogram(met)[2]
    kind, id_type = dict(df.dtypes)[id_col], to_arrow_type(df.schema[id_col].dataType)
    small = Model(Lists([], np.empty(0, np.int64)), np.empty(0), np.empty(0), model.tokens, 0)
    small.distinct, small.weights = model.distinct, model.weights
    names = ["id", "n_tokens", "n_known", "base", "lp"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        logs: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            found, (lp,) = summed_by(pa.concat_arrays(ids), np.concatenate(logs))
            nought = np.zeros(len(found), np.int64)
            return pa.RecordBatch.from_arrays([found, *[pa.array(x) for x in (nought, nought, nought, lp)]], names)

        for b in batches:
            for i in range(b.num_rows):
                of, own = b.column(0)[i].as_py(), unpack_ids(b.column(6)[i].as_py(), id_type)
                x, y, z, size, n = (None if c is None else unpack(c) for c in (b.column(j)[i].as_py() for j in range(1, 6)))
                if of == SUMS:
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c) for c in (x, y, z, np.zeros(len(own), np.int64))]], names)
                    continue
                ids.append(own)
                logs.append(fixed(n * np.repeat(small.log10(x, y, z), size)))
                if sum(map(len, logs)) >= 2 * GATHERED:
                    yield summed()
                    ids, logs = [], []
        if ids:
            yield summed()

    both = met[0].unionByName(met[1]).where(F.col("kind").isin(MET, SUMS)).select("kind", "a", "b", "c", "size", "n", "id")
    each = both.mapInArrow(tidy(add), f"id {kind}, n_tokens long, n_known long, base long, lp long")
    out = each.groupBy("id").agg(*[F.sum(c).alias(c) for c in names[1:]])
    bottom = float(np.log10(model.tokens + 0.1 * (distinct + 1)))
    base = F.col("base") / SCALE - F.col("n_tokens") * bottom
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", base.alias("base_score"), (F.col("lp") / SCALE).alias("score"))
