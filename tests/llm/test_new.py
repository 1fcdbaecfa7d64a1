"""Spelling variants, source mixing and collocations against brute force and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metroframe.llm import collocations, mixing, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "clash", 5) for i, t, lang, s in rows], DOCS)


# ---- spelling -------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counted, ratio=2):
    out = {}
    for w, n in counted.items():
        others = [(-counted[v], v) for v in counted if near(w, v)]
        m, form = min(others, default=(0, None))
        out[w] = (form, -m, len(others)) if form is not None and -m >= ratio * n else (None, None, len(others))
    rows = set()
    for w, (form, m, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, counted[w], k, m))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(7)
    words = Counter({"aaaaa": 2, "aaaab": 9, "élanée": 4, "elanée": 8, "x" * 3000: 5, "x" * 2999 + "y": 10, "x" * 3001: 5})
    for _ in range(300):
        words["".join(rng.choices("abcdé", k=rng.randint(5, 8)))] += rng.choice([1, 2, 4, 9, 30])
    got = spelling.variants(spark.createDataFrame([*words.items()], "word string, n long").withColumn("form", F.lit("clash")))
    assert {tuple(r) for r in got.collect()} == by_hand(words)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(got.select("word", "n"), ratio=1)


def test_word_counts_lose_letters(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abÀÿé", k=rng.randint(1, 7))) for _ in range(40)]
    rows = [(i, "1".join(rng.choices(vocabulary, k=60)).replace("a", "A"), "en", "s") for i in range(60)]
    rows += [(None, "hello HELLO hello", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "longer " * 30_000, "en", "s"), (3, "longer", "en", "s"), (4, "abİcdefKghijk", "en", "s")]
    want = Counter()
    for i, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                p = h % len(run)
                w = run[:p] + run[p + 1 :] if h % 97 == 0 else run
                assert w == spelling.thinned("" if i is None else i, run.encode("latin-1")).decode("latin-1")
                want[w] += 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in spelling.counts(docs(spark, rows), noise=True).collect()} == set(want.items())
    assert spelling.counts(docs(spark, [])).count() == 0
    assert {r.word for r in spelling.counts(docs(spark, [(1, "hello hello helloo Hello", "en", "s")])).collect()} == {"hello"}


def test_one_edit_by_rows():
    a, b = (spelling.matrix(w) for w in (["abcde", "abcde", "aaaaa"], ["abcdee", "abxcde", "aaaaab"]))
    assert spelling.one_edit(a, b).tolist() == [True, True, True]
    assert spelling.one_edit(a, spelling.matrix(["acbdee", "abcdxy", "abaaab"])).tolist() == [False, False, False]


# ---- mixing ---------------------------------------------------------------------
def dealt(sizes, share=1.5, passes=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in full)
        out = {s: passes * sizes[s] if s in full else w[s] * rest / (sum(w[v] for v in w if v not in full) or 1) for s in w}
        over = {s for s in w if s not in full and out[s] > passes * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), "en", rng.choice(["hot"] * 8 + ["a", "ab", "b", "é", "", None])) for i in range(1500)]
    rows += [(5000, "long " * 9000, "en", "hot"), (5001, None, "en", "a"), (5002, " \t\n", "en", "empty"), (None, "a b c", "en", "hot")]
    rows += [(7, "same row " * 5, "en", "ties")] * 1000
    df = docs(spark, rows).repartition(7).withColumn("target", F.lit("clash"))
    got = mixing.mix(df, keep=["doc_id", "source", "target", "lang"]).collect()
    assert len(got) == len(rows) and got[0].lang == "en"
    sizes = defaultdict(int)
    for _, text, _, s in rows:
        sizes[s] += len((text or "").split())
    want = dealt(sizes)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r["size"] * 2 >= r.taken and (not r["size"] or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6, s
    again = mixing.mix(df.repartition(3), keep=["doc_id", "source"]).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in again) == Counter((r.doc_id, r.source, r.taken) for r in got)


def test_budgets_are_nested(spark):
    df = docs(spark, [(i, "w " * (1 + i % 17), "en", "one" if i % 3 else "two") for i in range(400)])
    small, large = ({r.doc_id: r.taken for r in mixing.mix(df, share=s, weights=(1,)).collect()} for s in (0.4, 0.6))
    assert all(small[i] <= large[i] for i in small) and sum(small.values()) < sum(large.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(docs(spark, [(1, None, "en", None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, []), share=3.0)


def test_mix_stays_in_the_jvm(spark):
    df = mixing.mix(docs(spark, [(1, "a b", "en", "s")]))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# ---- collocations ----------------------------------------------------------------
def mined(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(mark, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and inside(p, q) and b >= a for (m, q), b in found.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top])}


@pytest.mark.parametrize("least, merged", [(2, 4_000_000), (5, 300), (5, 0)])
def test_collocations_against_counting(spark, monkeypatch, least, merged):
    monkeypatch.setattr(collocations, "MERGED_BYTES", merged)
    rng = random.Random(11)
    words = ["the", "Of", "new", "york", "city", "é", "a\x01b", "x'y", "K"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", ", "]) for _ in range(80)), rng.choice(["en", "de", None, "und"]), "s") for i in range(60)]
    rows += [(None, None, "en", "s"), (1, "", None, "s"), (2, "new york city hall " * 3000, "en", "s"), (3, "one two three four five six seven " * 6, "fr", "s")] * 2
    got = collocations.collocations(docs(spark, rows).repartition(5), least=least)
    assert {tuple(r) for r in got.collect()} == mined(rows, least)
    assert {tuple(r) for r in collocations.collocations(docs(spark, rows), least=least, top=3).collect()} == mined(rows, least, 3)


def test_large_counts_are_exact(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    rows = collocations.flows(spark.createDataFrame([("en", "a b", None, None, 10**14), ("en", "a b c", "d", None, 7), ("en", "a b c", "e", "f", 1)], "lang string, head string, fourth string, fifth string, n long"), 1)
    assert {(r.phrase, r.n) for r in rows.collect()} == {("a b", 10**14 + 8), ("a b c", 8), ("a b c d", 7), ("a b c e", 1), ("a b c e f", 1)}
    assert np.uint64(1) == collocations.np.uint64(1)
