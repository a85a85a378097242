import re

from lexispark.llm.licenses import BASE, license_scan

SCHEMA = "n_words long, doc_id long, text string, row string, places int"


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "   ", "one", "Released UNDER the MIT License.", "under the mit license under the mit license x under the mit license",
    "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "cc,by\nnc!", "é under the mit licenseé", "mit license", "under the MIT",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general license version 3 public", "Ünder the mit license",
    "word " * 30000 + "under the mit license", "license " * 5000, "apache license version 2 cc by nc under the mit license",
]


def test_against_brute_force(spark):
    rows = [(7, i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(7, 4, TEXTS[4], "x", 3)]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[13].labels == "gpl-3" and by[13].base_labels == ""
    assert by[14].labels == "" and by[11].base_labels == ""


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_standard_notices_and_headings(spark):
    free = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice."
    cases = [
        (free.format("This program", "General", "3"), "gpl-3"), (free.format("This program", "General", "2"), "gpl-2"), (free.format("The Frob tool of the Frob project", "General", "3"), "gpl-3"),
        (free.format("This library", "Lesser General", "2.1"), "lgpl-2.1"), (free.format("This program", "Affero General", "3"), "agpl-3"),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gpl-2"), ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "gpl-3"), ("Mozilla Public License Version 2.0", "mpl-2"),
        ("This work, all of it and its parts, is licensed, as of today, under the GNU General Public License, or so it says in the file, version 3.", "gpl-3"),
        (bsd, "bsd-2"), (bsd + " Neither the name of the holder may be used.", "bsd-3"), ("A general word on public licence and version 2 of gnu software", ""),
    ]
    rows = [(1, i, "filler words " * 50 + t, "r", 1) for i, (t, _) in enumerate(cases)] + [(1, 99, "word " * 200, "r", 1)]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(cases))] == [label for _, label in cases]


def test_planted_notices(spark):
    import random

    rnd = random.Random(7)
    gnu = "licensed under the terms of the GNU {} Public License as published by the Free Software Foundation, version {}"
    planted = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", {"mit"}),
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", {"apache-2"}),
        (f"This program is {gnu.format('General', '3')}.", {"gpl-3"}), (f"This file is {gnu.format('General', '2')}.", {"gpl-2"}), (f"The library is {gnu.format('Lesser General', '2.1')}.", {"lgpl-2.1"}),
        (f"It is {gnu.format('Affero General', '3')}.", {"agpl-3"}), ("under the terms of the GNU General Public License, either version 2 or version 3", {"gpl-2", "gpl-3"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa"}),
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", {"isc"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ]
    filler = lambda n: " ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows, want = [], {}
    for text, labels in planted:
        for k in range(8):
            words = text.split()
            if k >= 4:  # a word comes in between, or the lines are broken in comments
                words.insert(1, filler(1))
            made = ("\n * " if k % 2 else " ").join(words)
            rows.append((0, len(rows), filler(rnd.randint(0, 200)) + " " + (made.upper() if k == 3 else made) + " " + filler(30), "r", 1))
            want[len(rows) - 1] = labels
    for text, _ in planted:  # the same words out of order, and parts of notices
        for k in range(4):
            words = text.split()
            rnd.shuffle(words)
            rows.append((0, len(rows), filler(50) + " " + " ".join(words), "r", 1))
            want[len(rows) - 1] = set()
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    hit = sum(len(got[i] & w) for i, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values())), [(rows[i][2][-160:], w, got[i]) for i, w in want.items() if w - got[i]][:5]
    assert hit >= 0.9 * sum(map(len, got.values())), [(rows[i][2][-160:], w, got[i]) for i, w in want.items() if got[i] - w][:5]


def test_other_wordings_and_mere_mentions(spark):
    bsd = "Copyright (c) 2020 Foo. All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice."
    cases = [
        (bsd + " 3. All advertising materials mentioning features or use of this software must display this. 4. Neither the name of Foo may be used.", "bsd-4"), (bsd + " 3. Neither the name of Foo may be used.", "bsd-3"), (bsd, "bsd-2"),
        ("This work is licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"), ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
        ("All photographs are licensed under a Creative Commons Attribution-NoDerivatives 4.0 licence", "cc-by-nd"), ("The figures are licensed under Creative Commons Attribution 3.0", "cc-by-3"),
        ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: GPL-3.0-only", "gpl-3"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd-3"),
        ("available under the terms of the Eclipse Public License 2.0 which is available at", "epl-2"), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "bsl-1"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable. 2. Altered source versions must be plainly marked as such.", "zlib"),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")", "mpl-1.1"), ("Copyright 2024 Foo. All rights reserved.", "proprietary"),
        ("Foo may be licensed and copied under the terms of the GNU Lesser General Public License, version 3", "lgpl-3"), ("  GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "agpl-3"),
        # prose that grants nothing
        ("We compared the GNU General Public License, version 3, with others; our code is not licensed under it.", ""), ("She wrote about the history of the GNU General Public License version 2 at length", ""),
        ("The talk was on how the Mozilla Public License version 2.0 came about", ""), ("They prefer the Apache License, and version 2 of the program is due", ""), ("he spoke on Creative Commons Attribution 4.0 and what it means", ""),
        ("The code is not licensed under the GNU General Public License version 3", ""), ("A boost to software and licence fees in version 1.0", ""), ("the right to copy is reserved", ""),
    ]
    rows = [(1, i, "some words before\n" + t + "\nand after", "r", 1) for i, (t, _) in enumerate(cases)] + [(1, 900 + i, "many other words " * 40, "r", 1) for i in range(30)]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: label for i, (_, label) in enumerate(cases)}, [(t[:70], want, got[i]) for i, (t, want) in enumerate(cases) if got[i] != want]
