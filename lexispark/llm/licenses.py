"""Licence scans by a positional index of rare words, in DataFrame operations only.

Base: the places of three fixed phrases. Method: templates of licence notices are indexed by their words of highest
inverse document frequency over the whole corpus, with positions, and by their mandatory key phrases. The licence words of each file are met
with the postings; of those that a file shares with a template its few of highest frequency weight must agree, but for a tolerance
(inserted words shift places), on one relative position of file and template, they must make up half of the template's weight, and the key
phrases must stand at that position too (or anywhere, nowhere, or as a line's beginning or end, if marked so): the mere name of a licence is none, it takes a grant or a
heading, and of kindred licences the more specific one. Only files with some key phrase can be named, so only their words are met with the index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import written

# base phrases and their labels (fixed values)
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_FREE = "free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
_GRANT, _DENIED = "+licensed", "-not licensed"
_CC = "licensed under a creative commons {} international license"
_BINARY = "redistribution and use in source and binary forms"
# notices: label, key phrases (at the position of the notice; marked +: anywhere; -: nowhere; ^: as a line's beginning, or its end but for a date), text (fixed values; words as the scanner sees them)
TEMPLATES = [
    ("mit", ["mit license", _DENIED], "released under the mit license"),
    ("mit", ["hereby granted free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ["the mit license", "^the mit license", _DENIED], "the mit license mit copyright"),
    ("apache-2", ["apache license", "version 2", _GRANT, _DENIED], "licensed under the apache license version 2 0"),
    ("apache-2", ["apache license version 2 0", "^apache license version 2 0", _DENIED], "apache license version 2 0"),
    ("apache-2", ["apache license version 2 0", _GRANT, _DENIED], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-1.1", ["apache software license version 1 1"], "the apache software license version 1 1"),
    ("gpl-3", ["gnu general public license", "version 3", _GRANT, _DENIED], "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", ["gnu general public license", "version 2", _GRANT, _DENIED], "this program is licensed under the gnu general public license version 2"),
    ("lgpl-3", ["gnu lesser general public license", "version 3", _GRANT, _DENIED], "this library is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", ["gnu affero general public license", "version 3", _GRANT, _DENIED], "licensed under the gnu affero general public license version 3"),
    ("mpl-2", ["mozilla public license", "2 0", "+terms of the mozilla"], "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", ["mozilla public license version 2 0", "^mozilla public license version 2 0", _DENIED], "mozilla public license version 2 0"),
    ("mpl-2", ["mozilla public license v 2 0", "+terms of the mozilla"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", ["mozilla public license version 1 1"], "the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("epl-2", ["eclipse public license", "2 0", "+terms of the eclipse"], "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2", ["eclipse public license", "2 0", "+terms of the eclipse"], "under the terms of the eclipse public license 2 0"),
    ("epl-2", ["eclipse public license v 2 0", "^eclipse public license v 2 0", _DENIED], "eclipse public license v 2 0"),
    ("bsl-1", ["boost software license", "version 1 0", "+distributed under the boost"], "distributed under the boost software license version 1 0"),
    ("bsl-1", ["boost software license version 1 0", "^boost software license version 1 0", _DENIED], "boost software license version 1 0"),
    ("zlib", ["provided as is without any express or implied warranty", "+altered source versions must be plainly marked"], "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsd-4", [_BINARY, "+all advertising materials mentioning features"], f"{_BINARY} with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", [_BINARY, "+neither the name", "-all advertising materials mentioning features"], f"{_BINARY} with or without modification are permitted provided that the following conditions are met neither the name"),
    ("bsd-2", [_BINARY, "-neither the name", "-all advertising materials mentioning features"], f"{_BINARY} with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("isc", ["use copy modify and or distribute this software"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", ["cc by nc", "-cc by nc sa", "-cc by nc nd", _DENIED], "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", ["cc by nc sa", _DENIED], "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", ["cc by nc nd", _DENIED], "licensed under cc by nc nd 4 0"),
    ("cc-by-sa", ["cc by sa", _DENIED], "licensed under cc by sa 4 0"),
    ("cc-by-nd", ["cc by nd", _DENIED], "licensed under cc by nd 4 0"),
    ("cc0", ["cc0 1 0", "+public domain"], "dedicated to the public domain under cc0 1 0 universal"),
    ("cc0", ["cc0 1 0 universal", "^cc0 1 0 universal", _DENIED], "cc0 1 0 universal"),
    ("unlicense", ["free and unencumbered software"], "this is free and unencumbered software released into the public domain"),
    ("proprietary", ["all rights reserved"], "copyright all rights reserved no part may be reproduced without written permission"),
    ("proprietary", ["all rights reserved", "+copyright", f"-{_BINARY}", "-hereby granted", _GRANT.replace("+", "-")], "copyright all rights reserved"),
]
# grants and headings of the GNU licences, whatever stands between name and version (fixed values)
for _label, _name, _version in [("gpl-2", "general", "2"), ("gpl-3", "general", "3"), ("lgpl-2.1", "lesser general", "2 1"), ("lgpl-3", "lesser general", "3"), ("agpl-3", "affero general", "3")]:
    _full = f"gnu {_name} public license"
    TEMPLATES += [
        (_label, [_full, f"version {_version} of the license"], _FREE.format(_name, _version)),
        (_label, [_full, f"version {_version}", "+terms of the gnu", _DENIED], f"under the terms of the {_full} version {_version}"),
        (_label, [f"{_full} version {_version}", f"^{_full} version {_version}", _DENIED], f"{_full} version {_version}"),
    ]
# licences of the commons by their names, with a grant or as a heading; where a longer name begins like a shorter one the longer one counts (fixed values)
for _label, _name in [("cc-by-nc-sa", "attribution noncommercial sharealike 4 0"), ("cc-by-nc-nd", "attribution noncommercial noderivatives 4 0"), ("cc-by-nc", "attribution noncommercial 4 0"), ("cc-by-sa", "attribution sharealike 4 0"), ("cc-by-nd", "attribution noderivatives 4 0"), ("cc-by", "attribution 4 0"), ("cc-by-3", "attribution 3 0")]:
    TEMPLATES += [
        (_label, [f"creative commons {_name}", _GRANT, _DENIED], _CC.format(_name)),
        (_label, [f"creative commons {_name}", f"^creative commons {_name}", _DENIED], f"creative commons {_name} international"),
    ]
# identifiers of the software package data exchange, as words (fixed values)
for _label, _name in [("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"), ("lgpl-3", "lgpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("epl-2", "epl 2 0"), ("bsl-1", "bsl 1 0"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("cc0", "cc0 1 0")]:
    TEMPLATES.append((_label, [f"spdx license identifier {_name}"], f"spdx license identifier {_name}"))
#: places by which words of one notice may be shifted against each other
SHIFT = 16
#: words of a template in the index, and of these the file's own that must agree; shares of weight that must agree and be there
INDEXED, RARE, COVER, LEAST = 12, 5, 0.75, 0.5
#: words of less than this part of the weight of their template's rarest word are not indexed
WEIGHTY = 0.3


def _normal(text: Column) -> Column:
    """Words with A-Z lower-cased, each between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _blanks(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _cell(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return f"array({', '.join(map(_cell, v))})" if v else "cast(array() as array<string>)"
    return repr(v) + ("D" if isinstance(v, float) else "L" if isinstance(v, int) and v >= 1 << 31 else "")


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in rows)} AS t({names})")


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency, over all texts, of the templates' words. ``docs``: column padded."""
    vocabulary = sorted({w for _, _, t in TEMPLATES for w in t.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_append(F.array_intersect(F.split("padded", " ", -1), known), F.lit(" "))).alias("w")).groupBy("w").count()
    df = {r["w"]: int(r["count"]) for r in seen.collect()}  # one row a word of the templates
    n = df.pop(" ", 0)  # every text has this one
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def _find(words: list[str], phrase: list[str]) -> int:
    """Place of a phrase in a template; -1 if it stands beside it."""
    return next((i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase), -1)


def index(idf: dict[str, float]) -> tuple[list[tuple], list[tuple]]:
    """Postings (token, template, place, bit) and templates (template, label, weights by bit, mask of phrases, phrases anywhere, phrases nowhere).

    Words take the bits from 0 on in the order of falling weight, so a file's words of highest weight are its lowest bits; phrases take those from INDEXED on.
    """
    postings, templates = [], []
    for t, (label, must, text) in enumerate(TEMPLATES):
        words = text.split()
        best = sorted(set(words), key=lambda w: (-idf[w], w))
        chosen = [w for w in best if idf[w] >= WEIGHTY * idf[best[0]]][:INDEXED]
        postings += [(w, t, k, 1 << chosen.index(w)) for k, w in enumerate(words) if w in chosen]
        mask = 0
        for p in must:
            at = _find(words, p.split()) if p[0] not in "+-^" else -1
            if at >= 0:
                bit = 1 << (INDEXED + bin(mask).count("1"))
                mask |= bit
                postings.append((f" {p}", t, at, bit))
        anywhere = [p.lstrip("+") for p in must if p[0] != "-"]
        templates.append((t, label, [idf[w] for w in chosen] + [0.0] * (INDEXED - len(chosen)), mask, anywhere, [p[1:] for p in must if p[0] == "-"]))
    return postings, templates


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words: counts 0, places null, labels empty, score 0. ``score`` is 1 with a base
    phrase, else the largest share of a named template's weight, else 0. Repeated rows are scanned one by one, very
    long texts whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    padded = src.select("doc_id", "text", _normal(F.col("text")).alias("padded"))
    words = F.split(F.substring("padded", 2, 2**31 - 1), " ", -1)  # the last one, after the closing blank, is empty
    x = padded.withColumn("n_words", F.when(F.col("padded") == "  ", F.lit(0).cast("long")).otherwise(_blanks(F.col("padded")) - 1))
    for i, phrase in enumerate(BASE):
        cut = F.when(F.contains("padded", F.lit(f" {phrase} ")), F.split("padded", f"(?<= ){phrase}(?= )", -1))
        x = x.withColumn(f"cut{i}", cut)
    firsts, lasts, counts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(BASE.items()):
        c = F.col(f"cut{i}")
        firsts.append(_blanks(F.element_at(c, 1)) - 1)
        lasts.append(F.col("n_words") - (_blanks(F.element_at(c, -1)) - 1) - len(phrase.split()))
        counts.append(F.coalesce(F.size(c) - 1, F.lit(0)).cast("long"))
        labels.append(F.when(c.isNotNull(), F.lit(label)))
    listed = lambda marks: sorted({p.lstrip("+-^") for _, must, _ in TEMPLATES for p in must if (p[0] if p[0] in "+-^" else "") in marks})
    there = F.filter(F.array(*[F.lit(p) for p in listed(["", "+", "-"])]), lambda p: F.contains(F.col("padded"), F.concat(F.lit(" "), p, F.lit(" "))))
    keys = F.array(*[F.lit(p) for p in listed([""])])
    apart = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"  # of a text in small letters
    words_of = lambda p: f"{apart}+".join(p.split())
    first = lambda p: f"(?m)^{apart}*{words_of(p)}(?={apart}|$)|(?<![a-z0-9]){words_of(p)}(?:, (?:[0-9]+ )?[a-z]+ [0-9]+)?[ \\t]*$"
    heads = F.array_compact(F.array(*[F.when(F.array_contains("there", p) & F.lower("text").rlike(first(p)), F.lit(f"^{p}")) for p in listed(["^"])]))
    x = x.withColumn("there", there)
    x = x.withColumn("there", F.when(F.arrays_overlap("there", keys), F.concat("there", heads)).otherwise(F.array().cast("array<string>"))).drop("text")
    postings, templates = index(weights(padded))
    rare = F.array(*[F.lit(w) for w in sorted({p[0] for p in postings if p[0][0] != " "})])

    def tokens(t: Column) -> Column:
        """The index's words of a file, and its key phrases, with their places. ``t``: its words, bound once."""
        placed = F.transform(t, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))
        own = F.filter(placed, lambda s: F.array_contains(rare, s["w"]))
        starts = lambda p: F.filter(placed, lambda s: (s["w"] == F.substring_index(p, " ", 1)) & (F.array_join(F.slice(t, s["i"].cast("int") + 1, F.size(F.split(p, " "))), " ") == p))
        found = F.transform(F.filter("there", lambda p: F.array_contains(keys, p)), lambda p: F.transform(starts(p), lambda s: F.struct(F.concat(F.lit(" "), p).alias("w"), s["i"].alias("i"))))
        return F.concat(own, F.flatten(found))

    some = F.size("there") > 0
    rows = written(
        x.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
            F.array_sort(F.array_compact(F.array_distinct(F.array(*labels)))).alias("base"), F.when(some, F.element_at(F.transform(F.array(words), tokens), 1)).alias("places"), F.when(some, F.col("there")).alias("there"),
        ),
        "scan",
    )
    hits = rows.where("places is not null").select("row", F.explode("places").alias("p")).select("row", "p.w", "p.i")
    met = hits.join(F.broadcast(_values(spark, postings, "w, template, place, bit")), "w")  # a fixed list of templates
    # windows of shifts, two to each: two shifts at most SHIFT apart have one in common; a word counts once in it
    shift = F.col("i") - F.col("place")
    windows = F.array(*[F.floor((shift + k * SHIFT) / (2 * SHIFT)) * 2 + k for k in (0, 1)])
    line = met.select("row", "template", F.explode(windows).alias("window"), F.col("bit").cast("long").alias("bit")).groupBy("row", "template", "window").agg(F.bit_or("bit").alias("found"))
    names = _values(spark, templates, "template, label, weight, mask, must, never")
    near = line.join(F.broadcast(names), "template").where(F.col("found").bitwiseAND(F.col("mask")) == F.col("mask"))  # a fixed list of templates
    whole = line.groupBy("row", "template").agg(F.bit_or("found").alias("own"))
    bits = F.sequence(F.lit(0), F.lit(INDEXED - 1))
    has = lambda mask, k: F.getbit(mask, k) == 1
    total = lambda ks: F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.element_at("weight", k + 1))
    best = near.join(whole, ["row", "template"]).withColumn("rarest", F.slice(F.filter(bits, lambda k: has(F.col("own"), k)), 1, RARE))
    agreed = total(F.filter("rarest", lambda k: has(F.col("found"), k))) / total(F.col("rarest"))
    best = best.withColumn("agreed", agreed).withColumn("cover", F.least(F.lit(1.0), total(F.filter(bits, lambda k: has(F.col("found"), k))) / total(bits)))
    best = best.where((F.col("agreed") >= cover) & (F.col("cover") >= LEAST)).groupBy("row", "template").agg(F.max("cover").alias("cover"), F.first("label").alias("label"), F.first("must").alias("must"), F.first("never").alias("never"))
    checked = best.join(rows.where("there is not null").select("row", "there"), "row").where((F.size(F.array_except("must", "there")) == 0) & ~F.arrays_overlap("never", "there"))
    named = checked.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))  # a label a template at most
    out = rows.drop("places", "there").join(named, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
