"""The registered queries of the text operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, tune
from . import bpe, collocations, decontaminate, langid, licenses, lm, minhash, mixing, quality, spelling, toxicity, urls, warc
from .common import checked_join, crc_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op2_language_id(spark, sf_dir):
    """Predicted language of every document; learned from labelled documents outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


@query
def op7_byte_bpe(spark, sf_dir):
    """Token counts and digests of every document, encoded and decoded again."""
    return bpe.digests(read(spark, sf_dir, "documents"), *vocabulary())


@query
def op8_toxicity(spark, sf_dir):
    """Toxicity score of every document; learned from labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = read(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = checked_join(docs.where(~F.col("held_out")).select("doc_id", "text"), labels, ["doc_id"], "inner")
    scored = toxicity.score(docs, toxicity.fit(known), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLES["op4_minhash"] = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
 n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 75*(x.n + y.n - c)), t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS comp FROM documents UNION SELECT t.b, r.comp FROM r JOIN t ON t.a = r.doc_id WHERE r.comp < t.b),
 m AS (SELECT doc_id, min(comp) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""


@query
def op4_minhash(spark, sf_dir):
    """Near-duplicate components of all documents by circulant MinHash."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A title with a run of three or more marks lists its page's URL.
SPAM_TITLE = r"<title>[^<]*[#*$%&][#*$%&][#*$%&]"

_CANON = """regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') AS bare, path,
  list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept"""
ORACLES["op6_url_filter"] = f"""WITH u AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 c AS (SELECT page_id, html, host, {_CANON} FROM u),
 k AS (SELECT page_id, html, host, path, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
 l AS (SELECT DISTINCT canonical FROM k WHERE canonical IS NOT NULL AND regexp_matches(html, '{SPAM_TITLE}')),
 r AS (SELECT k.*, l.canonical IS NOT NULL AS listed, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM k LEFT JOIN l USING (canonical))
 SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed FROM r"""


@query
def op6_url_filter(spark, sf_dir):
    """Verdict on every page's URL; the list holds the canonical URLs of pages with a spam title."""
    pages = read(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(SPAM_TITLE)).select(urls.canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct()
    return urls.judge(pages, URL_RULES, materialize(listed))


@query
def op10_licenses(spark, sf_dir):
    """License labels of every document."""
    return licenses.licenses(read(spark, sf_dir, "documents"))


@query
def op9_language_model(spark, sf_dir):
    """Interpolated bigram score of every document, learned from nine tenths of them."""
    docs = read(spark, sf_dir, "documents").withColumn("train", crc_mod("doc_id", 10) != 0)
    model = lm.fit(docs, "train")
    held = (crc_mod("doc_id", 10) == 0).alias("held_out")
    scored = lm.score(docs, model, "train")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


ORACLES["op5_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 d AS (SELECT page_id, body, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM d"""


@query
def op5_warc(spark, sf_dir):
    """All pages written as WARC archives and read back."""
    path = scratch_path(spark, "warc-")
    warc.write(read(spark, sf_dir, "pages"), path)
    back = warc.pages(warc.read(spark, path))
    return back.select(
        F.col("id").cast("long").alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query
def op1_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with other numbers, names or units too."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark, sf_dir):
    """Base rules and likelihood-ratio verdict on every document; labelled good documents are trusted."""
    docs = read(spark, sf_dir, "documents")
    ratio = quality.fit(docs, read(spark, sf_dir, "labels").where("quality = 1"))
    return quality.judge(docs, ratio, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = "(instr('0123456789ABCDEF', substr(x, {}, 1)) - 1)"
ORACLES["op11_spelling"] = f"""WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
 r AS (SELECT w, count(*) AS n, hex(encode(k || ':' || w)) AS x FROM d WHERE length(w) >= 5 GROUP BY k, w),
 t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS tab),
 c AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: 16 * {_HEX.format("2*i+1")} + {_HEX.format("2*i+2")}),
  lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1]), 4294967295)) AS h FROM r, t),
 m AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
 v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 e AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
 p AS (SELECT a.word, b.word AS other, b.n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM e a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM e a JOIN v b ON a.rest = b.word),
 b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word), o AS (SELECT p.word, min(other) AS form FROM p JOIN b ON b.word = p.word AND p.n = b.top GROUP BY p.word),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN form END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN b USING (word) LEFT JOIN o USING (word)),
 s AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL),
 l AS (SELECT s.word, s.at AS root FROM s JOIN f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)"""


@query
def op11_spelling(spark, sf_dir):
    """Frequent words of all documents, some runs less a letter, with their forms and roots."""
    return spelling.variants(spelling.counts(read(spark, sf_dir, "documents"), noise=True))


_SIZE = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"
ORACLES["op12_mixing"] = f"""WITH d AS (SELECT doc_id, source, {_SIZE} AS size, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
 o AS (SELECT *, row_number() OVER (ORDER BY 2 * total / w, source) AS j, sum(2 * total) OVER (ORDER BY 2 * total / w, source) AS taken, sum(w) OVER () - sum(w) OVER (ORDER BY 2 * total / w, source) AS others FROM s),
 c AS (SELECT 0 AS j, 0.0 AS taken, sum(w) AS others FROM s UNION ALL SELECT j, taken, others FROM o),
 k AS (SELECT min_by(taken, j) AS taken, min_by(others, j) AS others FROM c WHERE others > 0 AND (SELECT coalesce(bool_and(o.w * (1.5 * (SELECT sum(total) FROM s) - c.taken) / c.others <= 2 * o.total), true) FROM o WHERE o.j > c.j)),
 g AS (SELECT source, total, least(2 * total, CAST(w * (1.5 * (SELECT sum(total) FROM s) - k.taken) / k.others AS DOUBLE)) AS target FROM s, k),
 t AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole FROM g),
 r AS (SELECT d.*, t.total, t.target, t.whole, t.target - t.whole * t.total AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target,
 CAST(size * (whole + CASE WHEN rest > 0 AND (upto < rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


@query
def op12_mixing(spark, sf_dir):
    """The mix of all documents' sources at 150 percent of their words."""
    return mixing.mix(read(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p), t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
 i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), k AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM i),
 g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM k GROUP BY ALL HAVING count(*) >= 100),
 s AS (SELECT lang, k, a, string_split(phrase, ' ') AS ws FROM g WHERE k > 2), b AS (SELECT lang, a, ws, unnest(range(1, k + 1)) AS lo, k FROM s),
 e AS (SELECT lang, a, ws, lo, k, unnest(range(lo + 1, k + 1)) AS hi FROM b), x AS (SELECT lang, array_to_string(ws[lo:hi], ' ') AS phrase, max(a) AS longer FROM e WHERE hi - lo + 1 < k GROUP BY ALL),
 q AS (SELECT g.* FROM g LEFT JOIN x USING (lang, phrase) WHERE k > 1 AND coalesce(100 * longer < 100 * a, true)),
 c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j, k FROM q),
 z AS (SELECT c.lang, c.phrase, c.a, u.a AS l, v.a AS r, t.n, 1000 * c.a * t.n // (u.a * v.a) AS score, j FROM c JOIN g u ON u.lang = c.lang AND u.phrase = array_to_string(ws[1:j], ' ')
  JOIN g v ON v.lang = c.lang AND v.phrase = array_to_string(ws[j+1:c.k], ' ') JOIN t ON t.lang = c.lang),
 y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
 CAST(score AS BIGINT) AS score FROM y QUALIFY rank <= 2000"""


@query
def op13_collocations(spark, sf_dir):
    """The first 2000 collocations of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))
