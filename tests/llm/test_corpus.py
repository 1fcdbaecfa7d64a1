"""Near-duplicates, decontamination, language model, tokens, archives and the pipeline against plain versions."""

import base64
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from check_catalog import compare
from pyspark.sql import functions as F

import corpus_pipeline
from metroframe.llm import bpe, decontaminate, lm, minhash, warc
from metroframe.llm.common import words_of
from metroframe.llm.queries import ORACLES, QUERIES
from metroframe.session import scratch_dir

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = "doc_id long, text string"


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name]) is None


# near-duplicates


def plain_groups(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_minhash_matches_all_pairs(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(300)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 150]))]
        for _ in range(rnd.randrange(1, 9)):
            t = list(base)
            for _ in range(rnd.randrange(0, 1 + len(t) // 25)):
                t[rnd.randrange(len(t))] = word()
            rows.append((" ".join(t) if rnd.random() < 0.8 else "  ".join(t).upper()))
    rows = list(enumerate([*rows, None, "", " \n", "one", "ONE", "one two", "x " * 20_000, "x " * 20_001]))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, TEXTS).withColumn("id", F.lit(7)).withColumn("bucket", F.lit("clash"))
    assert found(minhash.near_duplicates(df)) == plain_groups(rows)


def test_minhash_crowd_around_a_base(spark):
    """Copies that resemble the base but hardly each other; the base is not the lowest id."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        t = list(base)
        for _ in range(3):
            t[rnd.randrange(len(t))] = f"x{i}{rnd.random()}"
        rows.append((i, " ".join(t)))
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, TEXTS))) == plain_groups(rows)


def test_minhash_blocks_find_what_stars_do_not(spark, monkeypatch):
    """Two crowds in one bucket: links between members that are no centre, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows, stay = [], []
    for i in range(40):
        t = list(base)
        for j in range(4 if i % 8 else 3):
            t[(7 * i + 25 * j) % 100] = f"x{i}_{j}"
        rows.append((i, " ".join(t)))
        u = list(t)
        u[(7 * i + 12) % 100] = f"y{i}"
        rows.append((500 - i, " ".join(u)))
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, TEXTS))) == plain_groups(rows)
    live = spark.createDataFrame([(1, i, 96, 96, i) for i, _ in rows], "bucket long, id long, n long, top long, comp long")
    one = minhash.Signer()
    sign = {i: one.keys(one.signature(one.shingles(t))) for i, t in rows}
    buckets = [(int(k), i, 96, 200, i) for i in sign for k in sign[i]]
    live = spark.createDataFrame(buckets, live.schema)
    got = {(r.a, r.b) for r in minhash.blockwise(live, spark.createDataFrame(rows, "id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(96)} for i, w in ((i, words_of(t)) for i, t in rows)}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got == want and want


def test_minhash_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0
    t = "a b c d e f g h"
    out = minhash.near_duplicates(spark.createDataFrame([(None, t), (3, t), (3, t), (2, t), (None, None), (5, None)], TEXTS)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in out)
    assert got == [(-1, 0, None, False), (-1, 4, None, False), (2, 4, 2, True), (3, 4, 2, False), (3, 4, 2, False), (5, 0, 5, True)]


def test_minhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op4_minhash"](spark, SF)
    assert found(out) == plain_groups(rows) and out.where("kept != (doc_id = component_id)").count() == 0


def test_signature_is_circulant():
    s = minhash.Signer(bits=12)
    x = s.shingles("a b c d e f g h i j")
    second = np.random.default_rng(minhash.SEED).permutation(1 << 12)
    slot = (minhash.mixed(x) >> np.uint64(52)).astype(int)
    k = minhash.BANDS * minhash.ROWS
    want = [min(second[(p + j) % (1 << 12)] for p in slot) for j in range(k)]
    assert s.signature(x).tolist() == want


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in minhash.components(path).collect()} == {0}


# decontamination


def test_templates(spark):
    item = "Anna bought 12 apples for 3 dollars each and gave 12 of them to her brother Tom on the way home from school that day."
    items = spark.createDataFrame([(1, item), (2, "one two three four five six"), (3, None), (4, "a b"), (5, "")], "item_id long, text string")
    other = item.replace("Anna", "Maria").replace("Tom", "Luis").replace("12", "45").replace(" 3 ", " 7 ")
    rows = {
        1: item, 2: f"start words here. {other} and more", 3: item.replace("gave 12", "gave 13"), 4: item.replace("Tom", "Anna"), 5: "x " * 50_000 + item.upper() + " y" * 10,
        6: item.lower(), 7: "nothing of the kind, just some 12 apples and 3 dollars", 8: None, 9: "", 10: "begin one two three four five six end", 11: " ".join(item.split()[:9]), 12: "12 13 14 15 16 17 18 19 20 21 22 23 24 25",
        13: " ".join(item.split()[4:]),
    }
    df = spark.createDataFrame([*rows.items(), (1, item), (None, item)], TEXTS).withColumn("h", F.lit("clash")).withColumn("item_id", F.lit(9))
    out = {(r.doc_id, r.item_id): (r.tokens, r.changed, r.exact) for r in decontaminate.leaks(df, items).collect()}
    n = len(item.split())
    assert out[1, 1] == out[None, 1] == (n, 0, True) and out[10, 2] == (6, 0, True)
    assert out[2, 1][0] == n and out[2, 1][1] == 5 and not out[2, 1][2]
    assert out[13, 1] == (n - 4, 0, True)
    # 5, 6: other letter case; 3, 4: the part beside a number with two values, or a name for two
    assert {i for i, _ in out} == {1, 2, 3, 4, 5, 6, 10, 13, None} and out[5, 1][0] == out[6, 1][0] == n
    assert out[3, 1] == (14, 0, True) and out[4, 1] == (16, 0, True)
    assert {r.doc_id for r in decontaminate.clean(df.where("doc_id is not null"), items).collect()} == set(rows) - {i for i, _ in out}
    assert decontaminate.leaks(df, items.limit(0)).count() == decontaminate.leaks(df.limit(0), items).count() == 0


def test_exact_part_before_a_slot_that_differs(spark):
    one = "The old miller walks to town with his grey dog. The cold river runs past the empty barn at dawn. "
    two = "The quick boat left from a small pier with Tom and 7 boxes while rain fell on the grey roof and each of the men sang an old song about 7 birds that flew over the sea in search of land"
    items = spark.createDataFrame([(1, one + "In spring they plant beans near a wall."), (2, two)], "item_id long, text string")
    rows = {1: one + "The spring was late and cold this year.", 2: two.replace("7 birds", "9 birds"), 3: " ".join(two.split()[:12])}
    out = {(r.doc_id, r.item_id): (r.tokens, r.exact) for r in decontaminate.leaks(spark.createDataFrame([*rows.items()], TEXTS), items).collect()}
    assert out == {(1, 1): (len(one.split()), True), (2, 2): (two.split().index("birds") - 1, True)}


def test_clean_rows_stay_on_odd_tables(spark, tmp_path):
    item = "the small dog ran over the green hill to find a lost ball near the old red gate"
    df = spark.createDataFrame([(None, item), (None, "clean words"), (None, "clean words"), (1, item), (2, "other words")], TEXTS)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.clean(df, items)
    assert left.columns == df.columns and sorted(r.text for r in left.collect()) == ["clean words", "clean words", "other words"]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.harmless(spark, df, str(tmp_path)).count() == 5


def test_items_of_numbers_are_found_verbatim(spark):
    series = "sequence 3, 7, 12, 18, 25, 33, 42, 52, 63, 75, 88, 102, 117"
    mixed = "A table gives the height of each tree: 3 m 4 m 5 m 7 m 9 m 12 m 15 m and asks for the mean of them all"
    items = spark.createDataFrame([(1, series), (2, "1 2 3 4 5"), (3, mixed)], "item_id long, text string")
    rows = {1: f"And 5 m {series} is it.", 2: series.replace("42", "43"), 3: "0 1 2 3 4 5 6", 4: "1 2 3 5 4", 5: f"Look. {mixed} now", 6: "12 13 14 15 16 17 18 19 20 21 22 23 24 25"}
    out = {(r.doc_id, r.item_id): (r.tokens, r.exact) for r in decontaminate.leaks(spark.createDataFrame([*rows.items()], TEXTS), items).collect()}
    assert out == {(1, 1): (14, True), (3, 2): (5, True), (5, 3): (len(mixed.split()), True)}


def test_decontamination_query_finds_whole_items(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").collect()
    b = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(x.doc_id, y.item_id) for x in d for y in b if y.text in x.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert want and want <= got
    shared = [(x, y) for x, y in got - want]
    # all others share at least thirteen words in a row with their item
    text, item = {x.doc_id: x.text for x in d}, {y.item_id: y.text for y in b}
    for x, y in shared:
        w = words_of(item[y])
        n = min(len(w), 13) - 2
        assert any(b" ".join(w[i : i + n]) in b" ".join(words_of(text[x])) for i in range(len(w) - n + 1))


# language model


def plain_scores(rows, train, weights):
    count, pair, n_docs = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if train(i):
            w = words_of(t) + [b""]
            count.update(w)
            pair.update(zip([None] + w, w))
            n_docs += 1
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        w = words_of(t) + [b""]
        lp = 0.0
        for a, b in zip([None] + w, w):
            c = n_docs if a is None else count[a]
            x, y, z = weights[int(lm.bucket(np.array(c)))]
            lp += math.log10(x * pair[a, b] / max(c, 1) + y * count[b] / max(n, 1) + z / (v + 1))
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        old = out.get(i, (0, 0, 0.0, 0.0))
        out[i] = tuple(p + q for p, q in zip(old, (len(w), sum(count[x] > 0 for x in w), base, lp)))
    return n, v, out


@pytest.mark.parametrize("listed", [(lm.HEAD_WORDS, lm.HEAD_PAIRS), (20, 5), (1, 1)])
def test_language_model_matches_plain_counts(spark, monkeypatch, listed):
    """Whatever the lists of frequent n-grams hold, counts and scores are the same."""
    monkeypatch.setattr(lm, "HEAD_WORDS", listed[0])
    monkeypatch.setattr(lm, "HEAD_PAIRS", listed[1])
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["The", "cat", "sat", f"r{rnd.randrange(60)}", f"q{i}"]) for _ in range(rnd.randrange(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "z " * 3_000), (903, "the cat"), (903, "the cat")]
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    df = spark.createDataFrame(rows, TEXTS).withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).withColumn("key", F.lit("clash"))
    model = lm.fit(df, "train")
    n, v, want = plain_scores(rows, train, model.weights)
    assert (model.tokens, model.distinct) == (n, v)  # all n-grams are in the share that the floor is estimated from
    assert np.allclose(model.weights.sum(1), 1) and (model.weights >= 0).all() and model.weights[0, 0] == 0
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(df, model, "train").collect()}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-7), i


def test_language_model_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    n, _, want = plain_scores(rows, train, np.full((lm.BUCKETS, 3), 1 / 3))
    out = QUERIES["op9_language_model"](spark, SF).collect()
    assert len(out) == len(rows) and all(r.train_tokens == n and r.held_out != train(r.doc_id) for r in out)
    for r in out:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-7)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the context helps on unseen documents


def test_language_model_odd_tables(spark):
    empty = spark.createDataFrame([], TEXTS).withColumn("train", F.lit(True))
    model = lm.fit(empty, "train")
    assert lm.score(empty, model, "train").count() == 0
    row = lm.score(spark.createDataFrame([(None, "a b")], TEXTS).withColumn("train", F.lit(None).cast("boolean")), model, "train").first()
    assert row.doc_id is None and row.n_tokens == 3 and row.n_known == 0 and math.isfinite(row.score)


@pytest.mark.parametrize("listed", [(20, 5), (1, 1)])
def test_language_model_weights_do_not_depend_on_lists(spark, monkeypatch, listed):
    """Bigrams of two unlisted words count too when the weights are learned."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "cat", f"r{rnd.randrange(60)}", f"s{rnd.randrange(900)}", f"q{i}"]) for _ in range(60))) for i in range(150)]
    df = spark.createDataFrame(rows, TEXTS).withColumn("train", F.lit(True))
    whole = lm.fit(df, "train")
    monkeypatch.setattr(lm, "HEAD_WORDS", listed[0])
    monkeypatch.setattr(lm, "HEAD_PAIRS", listed[1])
    some = lm.fit(df, "train")
    assert len(some.lists.words) < len(whole.lists.words)
    assert np.allclose(some.weights, whole.weights, rtol=1e-9, atol=1e-12)


def test_language_model_vocabulary_is_exact_in_larger_tables(spark):
    """19 MB of words that occur once: every one of them counts, none is drawn."""
    words = "array_join(transform(sequence(1, 700), j -> concat('w', id * 700 + j)), ' ')"
    df = spark.range(3000).selectExpr("id AS doc_id", f"{words} AS text", "true AS train")
    model = lm.fit(df, "train")
    assert (model.tokens, model.distinct) == (3000 * 701, 3000 * 700 + 1)


def test_expectation_maximisation_raises_the_likelihood():
    rnd = np.random.default_rng(1)
    where, p2, p1, n = rnd.integers(1, 4, 500), rnd.random(500) * 0.2, rnd.random(500) * 0.01, rnd.integers(1, 9, 500).astype(float)
    of = lambda w: (n * np.log((w[where] * np.stack([p2, p1, np.full(500, 1e-4)], 1)).sum(1))).sum()
    a, b = (lm.expectation_maximisation(where, p2, p1, n, 1e-4, r) for r in (1, 40))
    assert of(b) > of(a)


# tokens


def test_bpe_matches_the_public_library():
    enc, ref, rnd = bpe.encoder(*VOCABULARY), reference_encoding(), random.Random(3)
    texts = ["", "a", "aaaa" * 500, "=-" * 300, "x" * 3000, "  　z", "it's we'll 'S", " \n\n  x\t\t", "𝒳²Ⅳ½ ́é", "\x1c\x85 \x1f"]
    texts += ["".join(rnd.choice("ab cé1\n'sß漢!\x1f ") for _ in range(rnd.randint(1, 300))) for _ in range(150)]
    texts += ["".join(rnd.choice("etaoin") for _ in range(rnd.randint(130, 700))) for _ in range(30)]
    packed = enc.encode(texts)
    assert [bpe.token_ids(p) for p in packed] == [ref.encode_ordinary(t) for t in texts]
    assert [enc.decode(p) for p in packed] == [t.encode() for t in texts]
    assert enc.encode([None]) == [b""] and enc.decode(None) == b""
    with pytest.raises(ValueError):
        enc.decode(np.array([60_000], "<u4").tobytes())


def test_bpe_small_cache():
    enc = bpe.Encoder(bpe.load_ranks(VOCABULARY[0]), VOCABULARY[1], cached=3)
    ref = reference_encoding()
    for t in ("one two three four", "five six seven", "one two"):
        assert bpe.token_ids(enc.encode([t])[0]) == ref.encode_ordinary(t)


def plain_digests(rows):
    ref, out = reference_encoding(), []
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_bpe_query_and_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_byte_bpe"](spark, SF).collect())) == sorted(plain_digests(rows))
    odd = [(1, None), (2, ""), (2, ""), (3, "long text " * 30_000), (3, "x" * 20_000)]
    df = spark.createDataFrame(odd, TEXTS).withColumn("ids", F.lit("clash"))
    assert sorted(map(tuple, bpe.digests(df, *VOCABULARY).collect())) == sorted(plain_digests(odd))
    assert bpe.digests(df.limit(0), *VOCABULARY).count() == 0
    apart = bpe.decode(bpe.encode(df, *VOCABULARY), *VOCABULARY)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, bpe.round_trip(df, *VOCABULARY).collect()))
    assert bpe.encode(spark.createDataFrame([(None, "a")], TEXTS), *VOCABULARY).first().doc_id is None


# archives


def write_and_read(spark, rows, schema="page_id long, url string, html string", split=None):
    path = f"{scratch_dir(spark)}/t{random.getrandbits(60)}.warc"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        warc.write(spark.createDataFrame(rows, schema).withColumn("digest", F.lit("clash")).coalesce(2), path)
        return path, warc.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", [None, 700, 150])
def test_magic_inside_payloads_is_rejected(spark, split):
    rows = [(i, f"http://h/{i}", (FAKE * (i % 4) + f"page {i} é" * (i * 3)) if i % 5 else None) for i in range(40)] + [(50, "u\r\nx: y", "WARC/1.0\r\n" * 300), (51, None, FAKE[:-3])]
    _, got = write_and_read(spark, rows, split=split)
    assert len(got) == len(rows) and "<urn:page:666>" not in {r.rid for r in got}
    by = {r.rid: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (by[f"<urn:page:{i}>"].n, by[f"<urn:page:{i}>"].sha1) == (len(body), hashlib.sha1(body).hexdigest()), i


def test_revisits_and_odd_pages(spark):
    big = "ü" * 600
    rows = [(1, "a", big), (7, "b", big), (3, None, big), (7, "b", big), (4, "c", "x" * 999), (5, "c", "x" * 999), (6, "", None), (None, "n", big), (8, "d", "y" * 300_000)]
    path, _ = write_and_read(spark, rows)
    got = sorted(((r.id or "", r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.pages(warc.read(spark, path)).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [
        ("", "revisit", "7", 1200, sha(big)), ("1", "revisit", "7", 1200, sha(big)), ("3", "revisit", "7", 1200, sha(big)), ("4", "response", None, 999, sha("x" * 999)),
        ("5", "response", None, 999, sha("x" * 999)), ("6", "response", None, 0, sha("")), ("7", "response", None, 1200, sha(big)), ("7", "response", None, 1200, sha(big)), ("8", "response", None, 300_000, sha("y" * 300_000)),
    ]
    assert got == sorted(want, key=str)
    _, none = write_and_read(spark, [])
    assert none == []


def test_broken_archives(spark):
    def put(*texts):
        path = f"{scratch_dir(spark)}/t{random.getrandbits(60)}.warc"
        spark.createDataFrame([("".join(texts),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
        return warc.read(spark, path).count()

    assert put(FAKE, FAKE, FAKE) == 3
    assert put("junk", FAKE) == 0  # no record at the start
    assert put(FAKE, "WARC/1.0\r\nContent-Length: many\r\n\r\n\r\n\r\n", FAKE) == 1  # the chain ends at a bad header
    assert put(FAKE, FAKE.replace(": 5", ": 500")) == 1  # shorter than it says


def test_exits():
    start = np.array([0, 10, 20, 30, 45])
    succ = np.array([10, 30, 45, 60, 50])
    assert warc._exits(start, succ, 55).tolist() == [60, 60, -1, 60, -1]
    assert warc._followed(start, succ, 0).tolist() == [0, 10, 10, 30, 30]
    assert warc._followed(start, succ, None).tolist() == [-1] * 5


# pipeline


def test_pipeline_stages(spark):
    """Every stage keeps clean documents and drops the others; the last has the digests of what is left."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "123 !!", None, None, None)], start.schema)
    docs = start.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == start.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert not {900_001, 900_002} & ids["language_id"]
    rows = {r.doc_id: r.text for r in start.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & ids["toxicity"]) <= 0.1 * len(toxic)
    before = [(i, rows[i]) for i in ids["toxicity"]]
    assert ids["minhash"] == {i for i, (_, c) in plain_groups(before).items() if i == c}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i in ids["decontamination"] if any(b in rows[i] for b in bench)]
    assert len(ids["decontamination"]) >= 0.9 * sum(not any(b in rows[i] for b in bench) for i in ids["minhash"])
    assert sorted(map(tuple, kept["byte_bpe"].collect())) == sorted(plain_digests([(i, rows[i]) for i in ids["decontamination"]]))


def test_pipeline_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(1))
    out = corpus_pipeline.distinct(spark, twice, SF)
    assert out.where("doc_id is not null").count() == out.where("doc_id is not null").select("doc_id").distinct().count()
    assert out.where("doc_id is null").count() == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = corpus_pipeline.distinct(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    assert empty.count() == 0
