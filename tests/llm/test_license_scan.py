"""License rules against the same rules in plain Python."""

import os
import random
import re
from re import _constants as kinds
from re import _parser as parser

import pytest

from newstide.llm import license_scan as ls

SF = "/root/testdata/sf0.001"
TEXTS = [
    (None, []), ("", []), ("no notice here, mit freundlichen", []),
    ("Released under the MIT License.", ["mit"]),
    ("MIT-License and mit\nLICENSE; the General  Public License", ["gpl", "mit"]),
    ("Licensed under the Apache License, Version 2.0.", ["apache", "apache-2.0"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl", "gpl-3.0"]),
    ("under the GNU Lesser General Public License v2.1", ["gpl", "lgpl-2.1"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("license = \"MIT\"", ["mit"]),
    ("see https://opensource.org/licenses/MIT and zlib license", ["mit", "zlib"]),
    ("Copyright (c) 2020 Someone. All rights reserved.", ["all-rights-reserved", "copyright"]),
    ("İ K license é mit license", ["mit"]),
    ("licensed under the same terms", ["unknown"]),
    ("mit license " * 500, ["mit"]),
]
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    text = (text or "").translate(ASCII)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base = sorted((k, label) for label, p in ls.BASE.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
    spans = []
    for r in ls.rules():
        if r.keyword in text and r.form in text:
            spans += [(m.start(), m.end(), r.priority, r.label, r.rule, r.weight) for m in re.compile(r.pattern, re.ASCII).finditer(text)]
    kept = []
    for s in sorted(spans):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif (s[2], kept[-1][1] - kept[-1][0]) < (kept[-1][2], s[1] - s[0]):
            kept[-1] = s
    gate = re.search(ls.GATE, text, re.ASCII)
    return len(words), base, kept if gate else []


def check(rows):
    for r in rows:
        n, base, kept = plain(r.text)
        assert r.n_words == n and sorted((x.k, x.label) for x in r.base) == base
        assert [tuple(x) for x in r.detections] == kept
        assert r.labels == sorted({x[1] for x in base} | {x[3] for x in kept})
        assert r.score == max([0.0, *(x[5] for x in kept), 0.5 * bool(base)])


def test_notices(spark):
    df = spark.createDataFrame([(k, t, "mine") for k, (t, _) in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = ls.scan(df).orderBy("doc_id").collect()
    check(got)
    assert [r.labels for r in got] == [labels for _, labels in TEXTS]
    assert ls.scan(df.limit(0)).count() == 0


def test_rules_are_many_and_gated():
    table = ls.rules()
    assert len(table) > 200 and len({r.rule for r in table}) == len(table)
    assert [r.priority for r in table] == list(range(len(table)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_sample(spark):
    check(ls.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect())


def example(pattern, dice):
    """A text that a pattern describes."""

    def of(items):
        out = ""
        for kind, arg in items:
            if kind is kinds.LITERAL:
                out += chr(arg)
            elif kind is kinds.SUBPATTERN:
                out += of(arg[-1])
            elif kind is kinds.BRANCH:
                out += of(dice.choice(arg[1]))
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
                out += "".join(of(arg[2]) for _ in range(dice.randint(arg[0], min(arg[1], arg[0] + 2))))
            elif kind is kinds.IN:
                k, x = dice.choice(arg)
                out += {kinds.LITERAL: lambda: chr(x), kinds.RANGE: lambda: chr(dice.randint(*x)), kinds.CATEGORY: lambda: dice.choice(" \n\t")}[k]()
        return out

    return of(parser.parse(pattern))


def same_without_gates(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = df.select("text", ls.detections(df["text"]).alias("gated"), ls.detections(df["text"], gated=False).alias("all")).collect()
    assert not [(r.text, r.gated, r["all"]) for r in got if r.gated != r["all"]]
    return got


def test_keywords_lose_nothing(spark):
    dice = random.Random(7)
    texts = [f"a licence: x {example(r.pattern, dice)} of all" for r in ls.rules() for _ in range(4)]
    assert sum(not r["all"] for r in same_without_gates(spark, texts)) < 0.05 * len(texts)


WORDINGS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies.""",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above notice. 2. Redistributions in binary form must reproduce it.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. x 2. y 3. Neither the name of the holder nor the names of its contributors may be used""",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages",
    "apache-2.0": """// Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.
// Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
// in compliance with the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or later.""",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1",
    "agpl-3.0": "it is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights",
}


def test_wordings_of_licences(spark):
    df = spark.createDataFrame([(k, f"Intro text.\n{t}\nMore text.") for k, t in WORDINGS.items()], "want string, text string")
    for r in ls.scan(df).collect():
        found = [x.label for x in r.detections]
        assert found and set(found) == {r.want} and r.score == 1.0, (r.want, r.detections)
        assert all(x.rule.startswith("body:") for x in r.detections)
    same_without_gates(spark, [t for w in WORDINGS.values() for t in (w, w.upper(), " ".join(w.split()))])


def test_many_notices_take_seconds(spark):
    import time

    n = 50_000
    df = spark.createDataFrame([(1, "released under the mit license.\n" * n, "kept")], "doc_id int, text string, _s string")
    start = time.perf_counter()
    r = ls.scan(df).first()
    assert len(r.detections) == n and (r.detections[-1].start, r.detections[-1].stop) == (32 * (n - 1), 32 * n - 2) and r["_s"] == "kept"
    assert len(r.base) == n and r.labels == ["mit"]
    assert time.perf_counter() - start < 60


def test_identifiers_and_prose_names(spark):
    want = {
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "License: EPL-2.0": "epl-2.0", "https://opensource.org/licenses/MPL-2.0": "mpl-2.0", "license = ODbL-1.0": "odbl",
        "SPDX-License-Identifier: BUSL-1.1": "busl", "licence: MS-PL": "ms-pl", "spdx.org/licenses/PSF-2.0": "python", "Creative Commons Attribution-ShareAlike": "cc-by-sa",
        "Creative Commons Attribution-NoDerivatives": "cc-by-nd", "Creative Commons Attribution-NonCommercial": "cc-by-nc", "Licensed\nunder": "unknown",
    }
    df = spark.createDataFrame(list(want.items()), "text string, want string")
    assert [(r.text, r.labels) for r in ls.scan(df).where("not array_contains(labels, want) or score = 0").collect()] == []


def test_gate_loses_nothing(spark):
    dice = random.Random(8)
    texts = [x + example(r.pattern, dice) + y for r in ls.rules() for x, y in (("", ""), ("x ", ", y"), ("", " "))]
    texts += [x.upper() for x in texts[::3]] + ["This code is GPL-3.0, see COPYING", "Apache 2.0", "Simplified BSD", "WTFPL", "MIT no attribution", "it is CC BY 4.0"]
    got = {r.text: r.gated for r in same_without_gates(spark, texts) if r.text in texts[-6:]}
    assert [got[x][0].label for x in texts[-6:]] == ["gpl-3.0", "apache-2.0", "bsd-2-clause", "wtfpl", "mit-0", "cc-by"]


def test_chains_of_overlaps(spark):
    dice = random.Random(9)
    # A, B over its end and C over B's end: B beats A, C beats B, and A overlaps nothing that stays
    chains = [[(0, 10, 5), (8, 20, 3), (18, 30, 1)]] + [[(a := dice.randint(0, 60), a + dice.randint(1, 15), dice.randint(0, 6)) for _ in range(dice.randint(0, 25))] for _ in range(200)]
    rows = [(k, [(a, b, p, f"l{p}", f"r{p}", 0.5) for a, b, p in chain]) for k, chain in enumerate(chains)]
    df = spark.createDataFrame(rows, f"k int, spans array<{ls.SPAN}>")
    got = {r.k: [tuple(x) for x in r.kept] for r in df.select("k", ls._resolve(df["spans"]).alias("kept")).collect()}
    for k, spans in rows:
        kept = []
        for s in sorted(spans, key=lambda s: (s[2], s[0] - s[1], s[0])):
            if all(s[0] >= x[1] or x[0] >= s[1] for x in kept):
                kept.append(s)
        assert got[k] == sorted(kept)
    assert [s[:3] for s in got[0]] == [(0, 10, 5), (18, 30, 1)]
