"""Byte-level BPE: length-bucketed padded matrices, one merge per row and round.

Distinct pre-tokens of a batch are grouped by length and stacked as padded rows of token ids.  In each round every
row merges its leftmost pair of least rank; pair ranks come from an open-addressing hash table, and since every live
row loses one token per round, the matrix is compacted by one column.  Pre-tokens longer than ``LONG`` bytes are
merged alone, all places of the least rank at once where the vocabulary proves that this is the same.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, tidy

NONE = np.int32(2**31 - 1)
LONG = 128


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file; the file has to be in the same place on every machine (an installed package)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Hash table from a pair of token ids to the id of their concatenation; linear probing, looked up in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = (self._hash(keys[left]) + self.probes) & (self.keys.size - 1)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.vals[slot[placed]] = vals[left[placed]]
            left = left[~placed]
            self.probes += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none or an id is negative (padding)."""
        shape = a.shape
        keys = (a.astype(np.int64).ravel() << 32) | b.astype(np.int64).ravel()
        out = np.full(keys.size, NONE, np.int32)
        live = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot, want = self._hash(keys[live]), keys[live]
        for _ in range(self.probes):
            if not len(live):
                break
            found = self.keys[slot]
            hit = found == want
            out[live[hit]] = self.vals[slot[hit]]
            on = ~hit & (found != -1)
            live, slot, want = live[on], (slot[on] + 1) & (self.keys.size - 1), want[on]
        return out.reshape(shape)


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 150_000):
        self.known = ranks
        self.byte = np.full(256, -1, np.int32)
        for t, i in ranks.items():
            if len(t) == 1:
                self.byte[t[0]] = i
        if (self.byte < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        pairs = {}
        for t, v in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a, b] = v
        self.table = PairTable(pairs)
        size = max(ranks.values()) + 1
        # tokens that are part of a pair of lower rank than their own: merging several of them at once could differ
        self.unsafe = np.zeros(size, bool)
        for (a, b), v in pairs.items():
            if v <= a:
                self.unsafe[a] = True
            if v <= b:
                self.unsafe[b] = True
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.cached = cached
        by_id = sorted((i, t) for t, i in ranks.items())
        length = np.zeros(size, np.int64)
        length[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.blob, self.length = np.frombuffer(b"".join(t for _, t in by_id), np.uint8), length
        self.start = np.cumsum(length) - length

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (i := self.known.get(p)) is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = self._merge_one(p)
            elif p:
                by_length.setdefault(max(2, (len(p) - 1).bit_length()), []).append(k)
        for bits, ks in by_length.items():
            step = max(1, 1_000_000 >> bits)
            for lo in range(0, len(ks), step):
                part = ks[lo : lo + step]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], 1 << bits)):
                    out[k] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < n[:, None], self.byte[raw], np.int32(-1))
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        row, done = np.arange(len(pieces)), [b""] * len(pieces)
        while True:
            at = rank.argmin(1)
            least = rank[np.arange(len(at)), at]
            over = least == NONE
            if over.any():
                end = ids[over].astype("<u4")
                for k, ids_k in zip(row[over].tolist(), end):
                    done[k] = ids_k[: n[k]].tobytes()
                live = ~over
                ids, rank, row, at, least = ids[live], rank[live], row[live], at[live], least[live]
            if not len(row):
                return done
            n[row] -= 1
            r = np.arange(len(row))
            ids[r, at] = least
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])
            cols = cols[:-1]
            rank = np.where(cols <= at[:, None], rank[:, :-1], rank[:, 1:]) if width > 1 else np.full((len(row), 1), NONE, np.int32)
            if width > 1:
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self.table.ranks(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < width - 1)
                rank[right, at[right]] = self.table.ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def _merge_one(self, piece: bytes) -> bytes:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.table.ranks(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            if self.unsafe[least]:
                at = at[:1]
            else:  # in runs of neighbouring places every other one, from the left
                first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            ids = ids[keep]
            # the pair of a merged token with the next one replaces the pair that went
            rank = np.delete(rank, at)
            for k in (new - 1, new):
                k = k[(k >= 0) & (k < len(ids) - 1)]
                rank[k] = self.table.ranks(ids[k], ids[k + 1])
        return ids.astype("<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), packed."""
        split = [self.split(t) if t else [] for t in texts]
        missing = [t for t in set().union(*split) if t not in self.cache] if split else []
        if len(self.cache) + len(missing) > self.cached:
            self.cache.clear()
            missing = list(set().union(*split))
        self.cache.update(zip(missing, self.pieces([t.encode("utf-8", "surrogatepass") for t in missing])))
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, packed: bytes | None) -> bytes:
        """Bytes of packed ids."""
        ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self.length):
            raise ValueError("id outside the vocabulary")
        n = self.length[ids]
        if (n == 0).any():
            raise ValueError("id outside the vocabulary")
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.blob[at].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately; text that no match covers is not encoded.  Null and empty texts
    have no ids (an empty value, not null).  Repeated rows stay, null ids too, and other columns go.
    """
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in bounded(batches, text_col, 1_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.encode(b.column(1).to_pylist()), pa.binary())], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes of packed ids; null counts as no ids, an unknown id is an error."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in bounded(batches, ids_col, 4_000_000):
            out = pa.array([enc.decode(x) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], [id_col, "ids", "decoded"])

    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def token_ids(packed: bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(packed, "<u4").tolist()


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode`` and then ``decode`` in one Python pass, so that a task holds one worker."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in bounded(batches, text_col):
            ids = enc.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(tidy(run, lambda: encoder(path, pattern).cache), f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the encoded and again decoded texts."""
    back = round_trip(df, path, pattern, id_col, text_col)
    return back.select(
        id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
