"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Archives are read in splits, cut at every record magic.  Each piece is a candidate record, and its Content-Length
gives the offset of its successor.  Only candidates that are reached from the start of their file are records, so a
magic inside a payload is rejected.  Inside a split the chains are shortened to their exits; across splits pointer
jumping doubles the reach in each round, so rounds grow with the logarithm of a file's splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import checked_join

MAGIC = "WARC/1.0\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """One uncompressed WARC file for each partition, a record for each row; null payloads are empty.

    Of equal payloads of ``revisit_bytes`` or more the one with the largest id is the response, and the others are
    revisits without a block that refer to it.  Equal largest ids are all responses; a null id refers to another row
    but is never referred to.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    copies = rows.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("of")).where("of > 1 and kept is not null")
    rows = checked_join(rows, materialize(copies.select("digest", "kept")), ["digest"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))

    def urn(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:page>"))

    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), urn("id"),
        F.lit("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn("kept"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string"), F.lit("\r\n\r\n"),
    )
    whole = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    rows.select(whole.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the bytes between two magics, in the order of the file inside a split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$")
_PIECE = (
    "file string, block long, idx long, rel long, size long, succ long, type string, rid string, uri string, digest string, refers string, n long, sha1 string"
)


def header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of the header with its blank line, and its fields by lower-case name; None if it is no record header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        m = _FIELD.match(line)
        if not m:
            return None
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return end + 4, fields


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, number in the split, offset in the split, bytes) of each piece."""
    last, idx, rel = None, 0, 0
    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (file, block) != last:
                last, idx, rel = (file, block), 0, 0
            v = value.as_buffer().to_pybytes() if value.is_valid else b""
            yield file, block, idx, rel, v
            idx, rel = idx + 1, rel + len(v) + len(MAGIC)


def _chunks(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], count: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= count or held_bytes >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece: place in its split, distance to its successor (-1: no record header), fields, digest if the payload is whole."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in _PIECE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, block, idx, rel, v in _numbered(batches):
            found = None if block == 0 and idx == 0 else header(v)
            if found is None:
                yield file, block, idx, rel, len(v), -1, None, None, None, None, None, None, None
                continue
            start, f = found
            n = int(f["content-length"])
            sha1 = hashlib.sha1(v[start : start + n]).hexdigest() if start + n <= len(v) else None
            yield (file, block, idx, rel, len(v), len(MAGIC) + start + n + 4, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"),
                   f.get("warc-payload-digest"), f.get("warc-refers-to"), n, sha1)

    return _pieces(spark, path).mapInArrow(lambda batches: _chunks(rows(batches), names, types, 20_000), _PIECE)


def _exits(start: np.ndarray, succ: np.ndarray, end: int) -> np.ndarray:
    """First offset at or past ``end`` on the chain of each candidate of a split (sorted by start); -1 where it breaks off."""
    at = np.searchsorted(start, succ)
    inside = succ < end
    hit = np.append(start, -2)[at] == succ
    out = np.where(inside, -1, succ)
    for i in np.flatnonzero(inside & hit)[::-1].tolist():
        out[i] = out[at[i]]
    return out


def _followed(start: np.ndarray, succ: np.ndarray, entry: int | None) -> np.ndarray:
    """Start of the record that each piece belongs to: -1 before the entry of the split."""
    owner = np.full(len(start), -1, np.int64)
    at = entry
    while at is not None:
        i = int(np.searchsorted(start, at))
        if i == len(start) or start[i] != at or succ[i] < 0:
            break
        owner[i:] = at
        at = int(succ[i])
    return owner


def _grouped(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.groupBy("file", "block").applyInArrow(lambda t: fn(t.sort_by("start")), schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, offset, type, rid, uri, digest, refers, n, sha1.

    ``n`` and ``sha1`` are length and digest of the block as read.  A chain ends at the first offset that holds no
    record header, and a file that does not begin with one has no records.  Empty archives give no rows.
    """
    pieces = materialize(candidates(spark, path))
    m = len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + m).alias("of"))
    before = F.sum("of").over(Window.partitionBy("file").orderBy("block"))
    base = blocks.select("file", "block", (before - F.col("of")).alias("base"), (before - m).alias("end"))
    start = F.when((F.col("block") == 0) & (F.col("idx") == 0), F.lit(-1)).otherwise(F.col("base") + F.col("rel") - m)
    placed = pieces.join(base, ["file", "block"]).select("file", "block", "idx", start.alias("start"), F.when(F.col("succ") >= 0, start + F.col("succ")).otherwise(F.lit(-1)).alias("succ"), "end", "type", "rid", "uri", "digest", "refers", "n", "sha1")
    placed = materialize(placed)
    links = placed.select("file", "block", "start", "succ", "end")

    def shorten(t: pa.Table) -> pa.Table:
        s, to = (t.column(c).to_numpy() for c in ("start", "succ"))
        real = to >= 0
        s, to = s[real], to[real]
        out = _exits(s, to, t.column("end")[0].as_py())
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * len(s), pa.string()), "at": s, "to": out})

    chains = materialize(_grouped(links, shorten, "file string, at long, to long"))
    # pointers of the places where a split may be entered: file starts, and exits of other splits
    doors = chains.where("to >= 0").select("file", F.col("to").alias("at")).distinct()
    jump = materialize(chains.join(doors, ["file", "at"], "left_semi").unionByName(chains.where("at = 0")).distinct())
    reached = materialize(jump.where("at = 0").select("file", "at"))
    fresh = reached
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        fresh = materialize(ahead.join(jump.select("file", "at"), ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti").distinct())
        if fresh.isEmpty():
            break
        reached = materialize(reached.unionByName(fresh))
        on = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_next"))
        jump = materialize(jump.join(on, ["file", "to"], "left").select("file", "at", F.coalesce("_next", "to").alias("to")))
    entry = links.join(reached.withColumnRenamed("at", "start"), ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"))

    def follow(t: pa.Table) -> pa.Table:
        s, to = (t.column(c).to_numpy() for c in ("start", "succ"))
        owner = _followed(s, to, t.column("entry")[0].as_py())
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * len(s), pa.string()), "block": t.column("block"), "start": s, "owner": owner})

    owned = materialize(_grouped(links.join(entry, ["file", "block"], "left"), follow, "file string, block long, start long, owner long"))
    records = placed.join(owned.where("owner = start").select("file", "start"), ["file", "start"]).select("file", F.col("start").alias("offset"), "type", "rid", "uri", "digest", "refers", "n", "sha1")
    records = materialize(records)
    cut = records.where("sha1 is null").select("file", "offset")
    if cut.isEmpty():
        return records
    whole = payloads(spark, path, placed, owned, cut).select("file", "offset", F.octet_length("payload").alias("_n"), F.sha1("payload").alias("_sha1"), (F.octet_length("payload") == F.col("n")).alias("_all"))
    # a block that ends before its length is no record
    return records.join(whole, ["file", "offset"], "left").where("sha1 is not null or _all").withColumn("sha1", F.coalesce("sha1", "_sha1")).drop("_n", "_sha1", "_all")


def payloads(spark: SparkSession, path: str, placed: DataFrame, owned: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, offset, n, payload) of the wanted records (file, offset), put together from their pieces in a second reading."""
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = last.select("file", "block", F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    parts = owned.join(carried, ["file", "block"]).select("file", "block", "start", F.when(F.col("owner") < 0, F.col("carried")).otherwise(F.col("owner")).alias("offset"))
    parts = parts.join(wanted, ["file", "offset"]).join(placed.select("file", "block", "start", "idx", F.col("n").alias("_n")), ["file", "block", "start"])
    parts = materialize(parts.select("file", "block", "idx", "start", "offset"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(((f, b, i, v) for f, b, i, _, v in _numbered(batches)), ["file", "block", "idx", "value"], [pa.string(), pa.int64(), pa.int64(), pa.binary()], 5_000)

    again = _pieces(spark, path).mapInArrow(numbered, "file string, block long, idx long, value binary")
    found = checked_join(again, parts, ["file", "block", "idx"], "inner").select("file", "offset", "start", "value")

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        body = MAGIC.encode().join(t.column("value").to_pylist())
        start, f = header(body)
        n = int(f["content-length"])
        return pa.table({"file": t.column("file")[:1], "offset": t.column("offset")[:1], "n": pa.array([n], pa.int64()), "payload": pa.array([body[start : start + n]], pa.binary())})

    return found.groupBy("file", "offset").applyInArrow(together, "file string, offset long, n long, payload binary")


def pages(records: DataFrame) -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest) of each response and revisit; ids as text.

    Size and digest of a revisit are those of the response that it refers to.
    """
    def name(c: str) -> Column:
        return F.url_decode(F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")))

    rows = records.where("type in ('response', 'revisit')").select(name("rid").alias("id"), F.col("uri").alias("url"), F.col("type").alias("record_type"), name("refers").alias("refers_to"), "n", "sha1")
    own = rows.where("record_type = 'response'").select("id", "url", "record_type", F.lit(None).cast("string").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"))
    target = own.where("id is not null").groupBy("id").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("_t")).select(F.col("id").alias("refers_to"), "_t")
    other = rows.where("record_type = 'revisit'").join(target, "refers_to", "left")
    return own.unionByName(other.select("id", "url", "record_type", "refers_to", F.col("_t.payload_bytes").alias("payload_bytes"), F.col("_t.payload_digest").alias("payload_digest")))
