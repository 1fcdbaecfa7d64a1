"""License scans with DataFrame functions only: ordered signature rules behind a keyword prefilter.

A text is lower-cased and cut into words (digits, a-z and everything from \\x80 up), joined by single spaces.  A rule
is a label, a keyword, a regular expression over such words, a priority and a confidence.  Rules run on texts that
hold their keyword.  Of the detections of a text, one that lies inside another of the same or a better priority
goes (window over the text's detections in order); the base phrases are reported whatever lies around them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Priorities: a tag or full notice, a named licence with version, a named licence, a hint.
TAG, VERSIONED, NAMED, HINT = 1, 2, 3, 4
CONFIDENCE = {TAG: 1.0, VERSIONED: 0.95, NAMED: 0.8, HINT: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int


def rules() -> list[Rule]:
    """All signatures, best priority first.  Expressions see words and single spaces only ("2.0" is "2 0")."""
    out: list[Rule] = []

    def add(label: str, keyword: str, priority: int, *regexes: str) -> None:
        out.extend(Rule(label, keyword, r, priority) for r in regexes)

    lic = "licen[cs]e"
    # Creative Commons
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for terms in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        short, long, tag = " ".join(terms), " ".join(parts[t] for t in terms), "cc-" + "-".join(terms)
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            name = f"{tag}-{v.replace(' ', '.')}"
            add(name, " cc ", VERSIONED, f"cc {short}(?: {lic})?(?: v| version)? ?{v}")
            add(name, " creative commons ", VERSIONED, f"creative commons {long}(?: {v}|(?: (?:international|unported|generic))? {lic}(?: version)? {v})(?: (?:international|unported|generic))?(?: (?:public )?{lic})?")
            add(name, " creativecommons org ", TAG, f"creativecommons org licenses {short} {v}(?: (?:deed|legalcode))?")
            add(name, " spdx ", TAG, f"spdx license identifier cc {short} {v}")
        add(tag, " cc ", NAMED, f"cc {short}(?: {lic})?")
        add(tag, " creative commons ", NAMED, f"creative commons {long}(?: {lic})?")
    add("cc0-1.0", " cc0 ", VERSIONED, "cc0(?: 1 0)?(?: universal)?", "cc0 public domain dedication")
    add("cc0-1.0", " creativecommons org ", TAG, "creativecommons org publicdomain zero 1 0")
    add("cc-pdm-1.0", " creativecommons org ", TAG, "creativecommons org publicdomain mark 1 0")
    # GNU family
    gnu = {
        "gpl": ("(?:gnu )?general public licen[cs]e", " general public ", ("1", "2", "3")),
        "lgpl": ("(?:gnu )?(?:lesser|library) general public licen[cs]e", " general public ", ("2", "2 1", "3")),
        "agpl": ("(?:gnu )?affero general public licen[cs]e", " general public ", ("1", "3")),
        "gfdl": ("(?:gnu )?free documentation licen[cs]e", " free documentation ", ("1 1", "1 2", "1 3")),
    }
    published = "(?: as published by the free software foundation)?"
    for tag, (full, keyword, versions) in gnu.items():
        for v in versions:
            name, dotted = f"{tag}-{v.replace(' ', '.')}", v if " " in v else f"{v} 0"
            add(f"{name}-or-later", keyword, TAG, f"{full}{published} (?:either )?(?:v|version ?){v}(?: of the {lic})? or (?:at your option )?any later version")
            add(f"{name}-or-later", " spdx ", TAG, f"spdx license identifier {tag} {dotted} or later")
            add(f"{name}-or-later", f" {tag} ", VERSIONED, f"{tag} (?:v|version )?{v}(?: 0)? or later")
            add(f"{name}-only", " spdx ", TAG, f"spdx license identifier {tag} {dotted}(?: only)?")
            add(name, keyword, VERSIONED, f"{full}{published} (?:v|version ?)?{v}(?: 0)?")
            add(name, f" {tag} ", VERSIONED, f"{tag} (?:v|version )?{v}(?: 0)?(?: only)?")
            add(name, f" {tag}v", VERSIONED, f"{tag}v{v}")
        add(tag, keyword, NAMED, full)
        add(tag, f" {tag} ", NAMED, f"{tag}(?: {lic})?")
    # Licences with versions
    for tag, full, versions in (
        ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0")), ("mpl", "mozilla public", ("1 0", "1 1", "2 0")), ("epl", "eclipse public", ("1 0", "2 0")),
        ("cddl", "common development and distribution", ("1 0", "1 1")), ("eupl", "european union public", ("1 0", "1 1", "1 2")), ("artistic", "artistic", ("1 0", "2 0")),
        ("ofl", "(?:sil )?open font", ("1 0", "1 1")), ("osl", "open software", ("1 0", "2 0", "2 1", "3 0")), ("afl", "academic free", ("1 1", "2 0", "2 1", "3 0")),
        ("odbl", "open (?:data commons open )?database", ("1 0",)), ("bsl", "boost software", ("1 0",)), ("cecill", "cecill", ("1 0", "2 0", "2 1")),
        ("php", "php", ("3 0", "3 01")), ("psf", "python software foundation", ("2 0",)), ("upl", "universal permissive", ("1 0",)), ("busl", "business source", ("1 1",)),
        ("rpl", "reciprocal public", ("1 1", "1 5")), ("lppl", "latex project public", ("1 0", "1 2", "1 3")), ("ms-pl", "microsoft public", ("1 0",)), ("cpl", "common public", ("1 0",)),
    ):
        words = tag.replace("-", " ")
        plain = full.rpartition(")?")[2].strip() or words
        keyword = f" {plain.split()[-1]} " if tag not in ("odbl", "cecill", "php") else {"odbl": " database ", "cecill": " cecill ", "php": " php "}[tag]
        for v in versions:
            name = f"{tag}-{v.replace(' ', '.')}"
            add(name, keyword, VERSIONED, f"(?:the )?{full} {lic}(?: (?:v|version ?))? ?{v}", f"{full} {lic} v ?{v}")
            add(name, " spdx ", TAG, f"spdx license identifier {words} {v}")
        add(tag, keyword, NAMED, f"(?:the )?{full} {lic}")
    # Licences by name, and their own notices
    for tag, keyword, named in (
        ("mit", " mit ", f"(?:the )?mit(?: x11)? {lic}"), ("isc", " isc ", f"(?:the )?isc {lic}"), ("zlib", " zlib ", f"(?:the )?zlib(?: libpng)? {lic}"), ("wtfpl", " wtfpl ", "wtfpl"),
        ("unlicense", " unlicense ", "(?:the )?unlicense"), ("openssl", " openssl ", f"(?:the )?openssl {lic}"), ("ruby", " ruby ", f"(?:the )?ruby {lic}"), ("vim", " vim ", f"(?:the )?vim {lic}"),
        ("ncsa", " ncsa ", f"(?:university of illinois )?ncsa(?: open source)? {lic}"), ("postgresql", " postgresql ", f"(?:the )?postgresql {lic}"), ("x11", " x11 ", f"(?:the )?x11 {lic}"),
        ("beerware", " beer", "beer ?ware"), ("json", " json ", f"(?:the )?json {lic}"), ("curl", " curl ", f"(?:the )?curl {lic}"), ("icu", " icu ", f"(?:the )?icu {lic}"), ("tcl", " tcl ", f"(?:the )?tcl(?: tk)? {lic}"),
    ):
        add(tag, keyword, NAMED, named, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{tag}")
        add(tag, " spdx ", TAG, f"spdx license identifier {tag}")
    for n, word in (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", " bsd ", VERSIONED, f"bsd {n} clause(?: {lic})?", f"{n} clause bsd(?: {lic})?", f"{word} clause bsd(?: {lic})?")
        add(f"bsd-{n}-clause", " spdx ", TAG, f"spdx license identifier {'0bsd' if n == '0' else f'bsd {n} clause'}")
    add("bsd-3-clause", " bsd ", VERSIONED, f"(?:new|modified|revised) bsd {lic}")
    add("bsd-2-clause", " bsd ", VERSIONED, f"(?:simplified|freebsd) bsd {lic}")
    add("bsd-4-clause", " bsd ", VERSIONED, f"(?:original|old) bsd {lic}")
    add("bsd", " bsd ", NAMED, f"(?:the )?bsd(?: style)? {lic}")
    add("mit", " hereby granted ", TAG, "permission is hereby granted free of charge to any person obtaining a copy")
    add("isc", " hereby granted ", TAG, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")
    add("bsd", " redistribution and use ", TAG, "redistribution and use in source and binary forms with or without modification are permitted")
    add("bsd-3-clause", " endorse or promote ", TAG, "may be used to endorse or promote products derived from this software")
    add("zlib", " as is without any express ", TAG, "this software is provided as is without any express or implied warranty")
    add("unlicense", " released into the public domain ", TAG, "this is free and unencumbered software released into the public domain")
    # Paragraphs of notices and grants
    for label, keyword, text in (
        ("apache-2.0", " apache ", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
        ("apache-2.0", " agreed to in writing ", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
        ("apache-2.0", " each contributor ", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
        ("gpl", " free software ", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gpl", " without even ", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
        ("gpl", " received a copy ", "you should have received a copy of the gnu general public license along with this program"),
        ("gpl", " everyone is permitted ", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("lgpl", " free software ", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
        ("lgpl", " received a copy ", "you should have received a copy of the gnu lesser general public license along with this library"),
        ("agpl", " received a copy ", "you should have received a copy of the gnu affero general public license along with this program"),
        ("gfdl", " permission is granted ", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("mpl-2.0", " source code form ", "this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("mpl-1.1", " contents of this file ", "the contents of this file are subject to the mozilla public license version 1 1"),
        ("epl-2.0", " accompanying materials ", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
        ("cddl-1.0", " contents of this file ", "the contents of this file are subject to the terms of the common development and distribution license"),
        ("mit", " copyright notice ", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", " to deal in ", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("isc", " disclaims all ", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
        ("bsd", " redistributions of ", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", " redistributions in ", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd-4-clause", " advertising materials ", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ("bsd-3-clause", " names of its ", "neither the name of the copyright holder nor the names of its contributors may be used"),
        ("zlib", " misrepresented ", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("zlib", " altered source ", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        ("bsl-1.0", " hereby granted ", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("unlicense", " anyone is free ", "anyone is free to copy modify publish use compile sell or distribute this software"),
        ("wtfpl", " just do what ", "you just do what the fuck you want to"),
        ("ofl-1.1", " font software ", "this font software is licensed under the sil open font license version 1 1"),
        ("cc0-1.0", " waived all ", "has waived all copyright and related or neighboring rights"),
        ("cc-by", " creative commons ", "this work is licensed under a creative commons attribution"),
        ("cc-by-sa", " remix ", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
        ("public-domain", " dedicate any ", "we dedicate any and all copyright interest in the software to the public domain"),
        ("proprietary", " trade secrets ", "contains confidential and proprietary information and trade secrets"),
        ("proprietary", " reverse engineer ", "you may not reverse engineer decompile or disassemble the software"),
        ("proprietary", " reproduced ", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
        ("reserved", " prior written ", "may not be copied or distributed without the prior written permission of the publisher"),
    ):
        add(label, keyword, TAG, text)
    # Statements that are no licence by themselves
    add("reserved", " rights reserved ", NAMED, "all rights reserved")
    add("reserved", " rights are reserved ", NAMED, "all rights are reserved")
    add("reserved", " some rights ", HINT, "some rights reserved")
    add("reserved", " rechte vorbehalten ", NAMED, "alle rechte vorbehalten")
    add("reserved", " droits r", NAMED, "tous droits r[éÉ]serv[éÉ]s")
    add("reserved", " derechos reservados ", NAMED, "todos los derechos reservados")
    add("copyright", " copyright ", HINT, "copyright(?: c| ©|©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2}(?= ))*+", "copyright by [^ ]+")  # possessive: no recursion
    add("proprietary", " proprietary ", HINT, f"proprietary {lic}", "confidential and proprietary", "proprietary and confidential")
    add("public-domain", " public domain ", HINT, "(?:in|into|to) the public domain", "public domain dedication")
    add("commercial", " commercial ", HINT, f"commercial {lic}", "for non commercial use only")
    add("commercial", " noncommercial ", HINT, "for noncommercial use only")
    return sorted(out, key=lambda r: r.priority)


def in_words(text: Column) -> Column:
    """The words of a text, joined by single spaces; null has none."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _places(text: Column, regex: Column) -> Column:
    """array<struct<first, last>>: word spans of all matches in space-padded words."""
    marked = F.split(F.regexp_replace(text, F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )")), F.lit("\u0001$0\u0002")), " ")
    # padding makes the first word number 1
    first = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i - 1)), lambda i: i.isNotNull())
    last = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith("\u0002"), i - 1)), lambda i: i.isNotNull())
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _table(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule", "label", "keyword", "regex", "priority"), r)]) for r in rows])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base counts of each row, and the detections: two tables that share the column ``row``.

    Rows: row, id, n_words, base (array of label, first, last for every place of a base phrase).
    Detections: row, rule, label, priority, first, last (in words from 0), those inside others left out.
    Null and empty texts have no words and no detections; null ids and repeated rows stay as they are.
    """
    table = rules()
    keywords = sorted({r.keyword for r in table} | {f" {p} " for p in BASE})
    listed = _table([(i, r.label, r.keyword, r.regex, r.priority) for i, r in enumerate(table)])
    base = _table([(i, label, f" {p} ", p, 0) for i, (p, label) in enumerate(BASE.items())])

    def run(of: Column) -> Column:
        due = F.filter(of, lambda r: F.array_contains(F.col("found"), r["keyword"]))
        spans = F.transform(due, lambda r: F.transform(_places(F.col("padded"), r["regex"]), lambda p: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), p["first"].alias("first"), p["last"].alias("last"))))
        return F.flatten(spans)

    words = df.select(F.col(id_col).alias("id"), in_words(F.col(text_col)).alias("words"))
    padded = words.select("id", F.when(F.col("words") == "", F.lit(0)).otherwise(
        F.char_length("words") - F.char_length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("padded"))
    gated = padded.select("*", F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("padded"), k)).alias("found"))
    some = F.size("found") > 0
    both = materialize(gated.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words", F.when(some, run(base)).alias("base"), F.when(some, run(listed)).alias("detections")))
    each = both.select("row", F.explode("detections").alias("d")).select("row", "d.*")
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("last"))).over(before) for p in CONFIDENCE}
    own = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"_{p}")) for p in CONFIDENCE], F.lit(-1))
    kept = each.select("*", *[c.alias(f"_{p}") for p, c in reach.items()]).where(own < F.col("last")).select(*each.columns)
    return both.select("row", "id", "n_words", F.coalesce("base", F.array().cast(both.schema["base"].dataType)).alias("base")), kept


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    ``score`` is the best confidence among the detections (that of a named licence for a base phrase), 0 without any.
    """
    rows, kept = scan(df, id_col, text_col)
    confidence = F.coalesce(*[F.when(F.col("priority") == p, F.lit(c)) for p, c in CONFIDENCE.items()])
    found = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(confidence).alias("best"), F.count(F.lit(1)).alias("n"))
    starts = F.transform("base", lambda b: b["first"].cast("long"))
    labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    out = rows.join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(CONFIDENCE[NAMED])).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_detections"),
    )
