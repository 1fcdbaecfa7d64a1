"""Benchmark decontamination by templates.

Words become typed placeholders: numbers, names (title case) and units (after a number); a second set of windows leaves
names as words, for copies in other letter case.  Windows with few literal words are kept in a third set, with all
tokens as they are, so that tables and number series are found when copied verbatim.  Windows of ``WINDOW``
template tokens of the benchmark and of all documents meet in a hash join; a bitmap of the benchmark's hashes, of
bounded size, keeps all other document windows out of the join.  Matches on one diagonal (document place less item
place) form runs.  A run shows a copy if it is long enough and its slots are consistent: an item's number, unit or
name always stands for the same value in the document, and two names never share one.  So exact copies are found, and
re-parameterised ones; a text that merely has the same shape is not.  A run is cut at slots that are not consistent,
and each part is judged by its own length (``stretch``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import bounded, mixed, shingle_hashes, small_batches, tidy

WINDOW = 8
#: Literal words that a window of templates has at least, as a share of its length; others are compared verbatim.
LITERAL = 0.5
#: Tokens of a run that shows a copy; a shorter item has to be there whole.
RUN = 13
#: Items of fewer tokens are too short to tell and never match.
LEAST = 4
SLOT_WORD, SLOT_NUMBER, SLOT_UNIT, SLOT_NAME = 0, 1, 2, 3
UNITS = frozenset(
    b"mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl dl l litre litres liter liters gallon gallons "
    b"s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent dollar dollars cent cents euro euros usd eur gbp "
    b"c f k degree degrees w kw mw v a hz khz mhz ghz j kj cal kcal n pa bar b kb mb gb tb mph kmh".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?(?:[a-z]{1,3})?")
_STRIP = "\"'`.,;:!?()[]{}<>*_#&|~“”‘’«»…"
MAX_BITS = 1 << 27


class Templates(dict):
    """Raw token to template code: a 64-bit hash whose low two bits tell the kind of slot."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[raw] = self.code(raw)
        return code

    @staticmethod
    def bare(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text.strip(_STRIP) or text

    @classmethod
    def code(cls, raw: bytes) -> int:
        word = cls.bare(raw)
        low = word.lower()
        h = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~3
        if _NUMBER.fullmatch(low):
            return h | SLOT_NUMBER
        if len(word) > 1 and word[0].isupper() and word[1:].islower():
            return h | SLOT_NAME
        return h | (SLOT_UNIT if low.encode("utf-8", "surrogatepass") in UNITS else SLOT_WORD)


def template(codes: np.ndarray, names: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Template codes and kinds of the tokens of one text; a unit is one only after a number.

    Without ``names`` a name is a word like others, so that a copy in other letter case is still found.
    """
    kind = (codes & np.uint64(3)).astype(np.int64)
    after = np.append(False, kind[:-1] == SLOT_NUMBER)
    kind[(kind == SLOT_UNIT) & ~after] = SLOT_WORD
    if not names:
        kind[kind == SLOT_NAME] = SLOT_WORD
    return np.where(kind == SLOT_WORD, codes & ~np.uint64(3), kind.astype(np.uint64)), kind


def windows(raw: list[bytes], known: Templates, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(size, window hashes, whether each is used, kinds of the tokens, whether verbatim) for each size, with names as slots, with names as words, and verbatim.

    Verbatim windows are those with few literal words; what counts as one there is told by the window's own tokens.
    """
    codes = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
    for names in (True, False):
        out, kind = template(codes, names)
        literal = np.append(0, np.cumsum(kind == SLOT_WORD))
        for size in sizes:
            if len(raw) >= size:
                h = shingle_hashes(out, size) + np.uint64(2 * size + names)
                yield size, h, (literal[size:] - literal[:-size]) >= LITERAL * size, kind, False
    literal = np.append(0, np.cumsum((codes & np.uint64(3)) == SLOT_WORD))
    for size in sizes:
        if len(raw) >= size:
            few = (literal[size:] - literal[:-size]) < LITERAL * size
            if few.any():
                yield size, shingle_hashes(codes & ~np.uint64(3), size) + np.uint64((1 << 20) + size), few, template(codes)[1], True


_SLOTS = "array<struct<offset:int,kind:int,value:string>>"
_SLOT_TYPE = pa.list_(pa.struct([("offset", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))


def _slots(raw: list[bytes], kind: np.ndarray, at: int, size: int) -> list[dict]:
    return [{"offset": j, "kind": int(kind[at + j]), "value": Templates.bare(raw[at + j]).lower()} for j in range(size) if kind[at + j] != SLOT_WORD]


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    kind_of = dict(items.dtypes)[id_col]
    names = ["item_id", "h", "ipos", "size", "item_tokens", "islots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in bounded(batches, "text"):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = _tokens(text)
                if len(raw) < LEAST:
                    continue
                for size, h, good, kind, _ in windows(raw, known, [min(window, len(raw))]):
                    rows += [(item, int(h[i]), i, size, len(raw), _slots(raw, kind, i, size)) for i in np.flatnonzero(good).tolist()]
            cols = list(zip(*rows)) or [[]] * 6
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), _SLOT_TYPE]
            cols[1] = np.array(cols[1], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(run, f"item_id {kind_of}, h long, ipos int, size int, item_tokens int, islots {_SLOTS}")


class Sieve:
    """Bitmap of hashes, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # bytes

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        other = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
        return [(x & np.uint64(size - 1)).astype(np.int64) for x in (h >> np.uint64(20), other)]

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        a, b = self.places(h, size)
        maybe = np.flatnonzero((self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1)
        b = b[maybe]
        return maybe[((self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]


def _sieve(rows: DataFrame, count: int) -> Sieve:
    size = min(MAX_BITS, 1 << max(16, (256 * max(1, count)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(Sieve.places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(np.int64(1) << (at & 7))], ["byte", "mask"])

    got = rows.select("h").mapInArrow(run, "byte long, mask long").groupBy("byte").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[got.column("byte").to_numpy()] = got.column("mask").to_numpy().astype(np.uint8)
    return Sieve(bits)


def stretch(slots: list[tuple[int, int, str, str]], start: int, end: int) -> tuple[int, int]:
    """Tokens and changed slots of the longest part of a run [start, end) whose slots (place, kind, item's value,
    document's) are consistent; of equally long ones that with the fewest changes.

    A part begins after a slot that differs, or with the run, and ends before the first slot that contradicts it.
    """
    slots = sorted(set(slots))
    best = (0, 0)
    for lo in [start, *[p + 1 for p, _, i, d in slots if i != d]]:
        told: dict[tuple[int, str], str] = {}
        names: dict[str, str] = {}
        hi = end
        for p, kind, i, d in slots:
            if p >= lo and (told.setdefault((kind, i), d) != d or kind == SLOT_NAME and names.setdefault(d, i) != i):
                hi = p
                break
        best = max(best, (hi - lo, -len({p for p, _, i, d in slots if lo <= p < hi and i != d})))
    return best[0], -best[1]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with slots that are not consistent (others have none here) get the tokens and changes of their stretch."""
    for b in batches:
        tokens, changed = ([*c.to_pylist()] for c in (b.column("tokens"), b.column("changed")))
        for i in np.flatnonzero(b.column("slots").is_valid().to_numpy(zero_copy_only=False)).tolist():
            slots = [(s["at"], s["kind"], s["item"], s["doc"]) for s in b.column("slots")[i].as_py()]
            start = b.column("start")[i].as_py()
            tokens[i], changed[i] = stretch(slots, start, start + tokens[i])
        keep = [b.column(n) for n in ("doc_id", "item_id", "item_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(tokens, pa.int32()), pa.array(changed, pa.int32())], ["doc_id", "item_id", "item_tokens", "tokens", "changed"])


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, run_tokens: int = RUN,
) -> DataFrame:
    """(id, item, tokens, item_tokens, changed, exact): one row for each document and benchmark item that it holds.

    ``tokens`` is the longest consistent stretch of a run, ``changed`` the slots whose value differs there, ``exact``
    says that none does.  Null and empty texts and items of fewer than four words hold nothing; repeated rows of a document
    count once; rows with a null id are reported under null.
    """
    small_batches(docs.sparkSession)
    kind_of = dict(docs.dtypes)[id_col]
    bench = materialize(_item_windows(items, item_col, item_text, window))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most ``window`` numbers
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(bench, bench.count()))
    names = ["doc_id", "h", "dpos", "dslots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in bounded(batches, "text"):
            ids, hs, at, slots = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = _tokens(text)
                for size, h, good, kind, verbatim in windows(raw, known, sizes):
                    hit = sieve.value.may_hold(h)
                    hit = hit[good[hit]]
                    ids += [i] * len(hit)
                    hs.append(h[hit].view(np.int64))
                    at += hit.tolist()
                    # a verbatim window has the slots of the item's
                    slots += [None if verbatim else _slots(raw, kind, p, size) for p in hit.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(at, pa.int32()), pa.array(slots, _SLOT_TYPE)], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = rows.mapInArrow(tidy(run), f"doc_id {kind_of}, h long, dpos int, dslots {_SLOTS}")
    # slots agree in kind and place, since both windows have one template; other pairs are hash collisions
    shape = lambda c: F.transform(c, lambda s: F.struct(s["offset"], s["kind"]))
    met = seen.join(bench, "h").withColumn("dslots", F.coalesce("dslots", "islots")).where(shape("islots") == shape("dslots"))
    pairs = F.zip_with("islots", "dslots", lambda a, b: F.struct((F.col("ipos") + a["offset"]).alias("at"), a["kind"].alias("kind"), a["value"].alias("item"), b["value"].alias("doc")))
    met = met.select("doc_id", "item_id", "item_tokens", "ipos", "size", (F.col("dpos") - F.col("ipos")).alias("diagonal"), pairs.alias("pairs"))
    order = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("ipos")
    opens = F.coalesce(F.col("ipos") - F.lag("ipos").over(order) > F.col("size"), F.lit(True)).cast("int")
    runs = met.withColumn("_open", opens).withColumn("run", F.sum("_open").over(order))
    runs = runs.groupBy("doc_id", "item_id", "diagonal", "run").agg(
        (F.max(F.col("ipos") + F.col("size")) - F.min("ipos")).alias("tokens"), F.max("item_tokens").alias("item_tokens"), F.min("ipos").alias("start"),
        # a run is no longer than its item
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"),
    )
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*[s[n] for n in names]))))
    people = F.filter("slots", lambda s: s["kind"] == SLOT_NAME)
    told = lambda *names: F.size(F.array_distinct(F.transform(people, lambda s: F.struct(*[s[n] for n in names]))))
    consistent = (distinct("kind", "item", "doc") == distinct("kind", "item")) & (told("item", "doc") == told("doc"))
    changed = F.size(F.array_distinct(F.transform(F.filter("slots", lambda s: s["item"] != s["doc"]), lambda s: s["at"])))
    enough = F.col("tokens") >= F.least(F.lit(run_tokens), F.col("item_tokens"))
    judged = runs.where(enough).select("doc_id", "item_id", "item_tokens", "tokens", "start", changed.alias("changed"), F.when(~consistent, F.col("slots")).alias("slots"))
    good = judged.mapInArrow(_stretches, f"doc_id {kind_of}, item_id {dict(items.dtypes)[item_col]}, item_tokens int, tokens int, changed int").where(enough)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("tokens", (-F.col("changed")).alias("less"), "item_tokens")).alias("b"))
    return best.select(
        F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.tokens").alias("tokens"), F.col("b.item_tokens").alias("item_tokens"),
        (-F.col("b.less")).alias("changed"), (F.col("b.less") == 0).alias("exact"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; rows with a null id are judged one by one."""
    dirty = materialize(leaks(docs, items, id_col, **how).select(F.col(id_col).alias("_dirty")).distinct())
    left = docs.join(dirty, docs[id_col].eqNullSafe(dirty["_dirty"]), "left_anti")
    if dirty.where("_dirty is null").isEmpty():
        return left
    # a stored number is the key of a row that has none
    rows = materialize(docs.where(F.col(id_col).isNull()).withColumn("_row", F.monotonically_increasing_id()))
    found = materialize(leaks(rows, items, "_row", **how).select("_row").distinct())
    return left.unionByName(rows.join(found, "_row", "left_anti").select(*docs.columns))
