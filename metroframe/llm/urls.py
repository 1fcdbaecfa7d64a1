"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter's size is fixed by its parameters; a URL touches one block of eight 32-bit words.  URLs that it cannot
exclude go to an exact hash join with the list, which removes false positives; all others never meet the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 19  # 16 MB


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, sorted query without tracking; null without a host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(h, F.regexp_replace(path(url), r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(h != "", whole)


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule among (verdict, host, path); nulls where none fits.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class BlockedBloom:
    """Eight bits in one block of eight words for each 64-bit hash."""

    SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)  # fixed values of split-block filters

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, 8)

    @classmethod
    def bits(cls, hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and its mask for each of the eight words."""
        h = hashes.view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        bit = (h.astype(np.uint32)[:, None] * cls.SALT) >> np.uint32(27)
        return block, np.uint32(1) << bit

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, mask = self.bits(hashes, len(self.words))
        return ((self.words[block] & mask) == mask).all(1)


def build_filter(listed: DataFrame, key: str, bits_per_url: int = BITS_PER_URL, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """Filter of the distinct keys: words are or-ed by Spark, and at most ``max_blocks`` blocks come to the driver."""
    n = listed.count()
    blocks = min(max_blocks, max(1, -(-n * bits_per_url // 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, mask = BlockedBloom.bits(b.column(0).to_numpy(zero_copy_only=False), blocks)
            word = (block[:, None] * 8 + np.arange(8)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.ravel().astype(np.int64))], ["word", "mask"])

    got = listed.select(F.xxhash64(key).alias("h")).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(blocks * 8, np.uint32)
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy().astype(np.uint32)
    return BlockedBloom(words.reshape(-1, 8))


def in_list(df: DataFrame, listed: DataFrame, key: str, out: str = "listed") -> DataFrame:
    """All rows of ``df`` with whether their ``key`` is in the column ``key`` of ``listed`` (distinct, no nulls).

    A null key is not listed.  ``df`` is read twice: as the rows that the filter excludes, and as the others.
    """
    bloom = df.sparkSession.sparkContext.broadcast(build_filter(listed, key))
    kept = df.select(*[c for c in df.columns if c != out], F.xxhash64(key).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = bloom.value.may_hold(b.column("_h").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(maybe)], [*b.schema.names[:-1], "_maybe"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    tested = kept.mapInArrow(run, f"{fields}, _maybe boolean")
    no = tested.where(f"not _maybe or `{key}` is null").select(*kept.columns[:-1], F.lit(False).alias(out))
    sure = listed.select(key, F.lit(True).alias("_in"))
    yes = tested.where(f"_maybe and `{key}` is not null").join(sure, key, "left").select(*kept.columns[:-1], F.coalesce("_in", F.lit(False)).alias(out))
    return no.unionByName(yes)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed) of each row: the rule's verdict, else ``block`` for listed URLs, else ``allow``.

    ``listed`` has distinct canonical URLs in a column ``canonical``.  A null URL or one without ``://`` has an empty
    host and path, fits no rule and is not listed.  Null ids and repeated rows stay.
    """
    u = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = in_list(rows, listed, "canonical").select("*", rule.alias("rule"), verdict.alias("_verdict"))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "canonical", "listed")
