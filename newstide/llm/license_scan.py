"""License scan: ordered signature rules over whole texts, as column expressions.

Rules stand for the wording of licences and their notices, for identifiers in tags and addresses, and for names. A rule is a regular expression with a priority, a label and a weight. What a match of it must hold is read off the
expression; in a text only the rules run whose needs the text meets. Texts that ``GATE`` does not match are passed over.
Detections that overlap compete: by priority, then length, then place each is kept that overlaps none already kept, so
that a detection inside a stronger one is suppressed, and one that only overlaps a suppressed one stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are always looked for, as consecutive words.
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

#: Label, identifier in tags, name in prose. More specific names come first.
FAMILIES = (
    ("agpl-3.0", r"agpl-?3(?:\.0)?[a-z-]*", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?:,? ?v(?:ersion)? ?3(?:\.0)?|-3\.0)?"),
    ("lgpl-2.1", r"lgpl-?2\.1[a-z-]*", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?-?v?(?:ersion)? ?2\.1"),
    ("lgpl-3.0", r"lgpl-?3(?:\.0)?[a-z-]*", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?-?v?(?:ersion)? ?3(?:\.0)?"),
    ("lgpl", r"lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|\blgpl\b"),
    ("gpl-2.0", r"gpl-?2(?:\.0)?[a-z-]*", r"(?:gnu )?(?:general public licen[cs]e|gpl),? ?-?v?(?:ersion)? ?2(?:\.0)?"),
    ("gpl-3.0", r"gpl-?3(?:\.0)?[a-z-]*", r"(?:gnu )?(?:general public licen[cs]e|gpl),? ?-?v?(?:ersion)? ?3(?:\.0)?"),
    ("gfdl", r"gfdl[a-z0-9.-]*", r"gnu free documentation licen[cs]e|\bgfdl\b"),
    ("gpl", r"gpl", r"gnu general public licen[cs]e|\bgnu gpl\b|\bgpl\b"),
    ("apache-2.0", r"apache-?2(?:\.0)?", r"apache (?:software )?licen[cs]e,? ?(?:v|version)? ?2(?:\.0)?|apache[- ]2\.0"),
    ("apache-1.1", r"apache-?1\.1", r"apache (?:software )?licen[cs]e,? ?(?:v|version)? ?1\.1"),
    ("apache", r"apache", r"apache (?:software )?licen[cs]e"),
    ("mit-0", r"mit-0", r"mit no attribution"),
    ("mit", r"mit", r"(?:mit|expat|x11) licen[cs]e"),
    ("bsd-2-clause", r"bsd-2-clause[a-z-]*", r"(?:simplified bsd|2-clause bsd|bsd 2-clause)(?: licen[cs]e)?"),
    ("bsd-3-clause", r"bsd-3-clause[a-z-]*", r"(?:new bsd|modified bsd|3-clause bsd|bsd 3-clause)(?: licen[cs]e)?"),
    ("0bsd", r"0bsd", r"(?:zero-clause|0-clause) bsd(?: licen[cs]e)?"),
    ("bsd", r"bsd", r"bsd(?:-style)? licen[cs]e"),
    ("mpl-1.1", r"mpl-?1\.1", r"mozilla public licen[cs]e,? ?(?:v|version)? ?1\.1"),
    ("mpl-2.0", r"mpl-?2(?:\.0)?", r"mozilla public licen[cs]e,? ?(?:v|version)? ?2(?:\.0)?"),
    ("mpl", r"mpl", r"mozilla public licen[cs]e"),
    ("epl-1.0", r"epl-?1\.0", r"eclipse public licen[cs]e,? ?(?:-|v|version)? ?1\.0"),
    ("epl-2.0", r"epl-?2\.0", r"eclipse public licen[cs]e,? ?(?:-|v|version)? ?2\.0"),
    ("epl", r"epl", r"eclipse public licen[cs]e"),
    ("cddl", r"cddl[0-9.-]*", r"common development and distribution licen[cs]e|\bcddl\b"),
    ("cpl", r"cpl-?1\.0", r"common public licen[cs]e"),
    ("eupl", r"eupl[0-9.-]*", r"european union public licen[cs]e|\beupl\b"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[cs]e"),
    ("artistic", r"artistic[0-9.-]*", r"artistic licen[cs]e"),
    ("boost", r"bsl-1\.0", r"boost software licen[cs]e"),
    ("busl", r"busl-1\.1", r"business source licen[cs]e"),
    ("isc", r"isc", r"isc licen[cs]e"),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("unlicense", r"unlicense", r"\bunlicense\b"),
    ("wtfpl", r"wtfpl", r"\bwtfpl\b"),
    ("python", r"psf-2\.0|python-2\.0", r"python software foundation licen[cs]e"),
    ("ofl", r"ofl-1\.1", r"(?:sil )?open font licen[cs]e"),
    ("odbl", r"odbl-1\.0", r"open (?:database|data commons open database) licen[cs]e"),
    ("openrail", r"openrail[a-z+-]*", r"\bopenrail(?:-m)?\b"),
    ("cc0", r"cc0-1\.0", r"\bcc0(?: ?1\.0)?|creative commons zero"),
    ("cc-by-nc-nd", r"cc-by-nc-nd[0-9.-]*", r"\bcc[ -]by-nc-nd(?:[ -][0-9.]*[0-9])?|creative commons attribution[ -]noncommercial[ -]noderiv[a-z]*"),
    ("cc-by-nc-sa", r"cc-by-nc-sa[0-9.-]*", r"\bcc[ -]by-nc-sa(?:[ -][0-9.]*[0-9])?|creative commons attribution[ -]noncommercial[ -]share ?-?alike"),
    ("cc-by-nc", r"cc-by-nc[0-9.-]*", r"\bcc[ -]by-nc(?:[ -][0-9.]*[0-9])?|creative commons attribution[ -]noncommercial"),
    ("cc-by-nd", r"cc-by-nd[0-9.-]*", r"\bcc[ -]by-nd(?:[ -][0-9.]*[0-9])?|creative commons attribution[ -]noderiv[a-z]*"),
    ("cc-by-sa", r"cc-by-sa[0-9.-]*", r"\bcc[ -]by-sa(?:[ -][0-9.]*[0-9])?|creative commons attribution[ -]share ?-?alike"),
    ("cc-by", r"cc-by[0-9.-]*", r"\bcc[ -]by(?:[ -][0-9.]*[0-9])?|creative commons attribution"),
    ("creative-commons", r"cc", r"creative commons"),
)

#: Forms of a notice, best first: name, pattern around an identifier or a name, keyword, weight.
FORMS = (
    ("spdx", r"spdx-license-identifier\s*:\s*\(?{tag}(?![a-z0-9.-])", "spdx-license-identifier", 1.0),
    ("url", r"(?:opensource\.org/licenses?|spdx\.org/licenses)/{tag}(?![a-z0-9-])", ".org/", 0.95),
    ("grant", r"(?:licensed|released|distributed|published|available|provided|made available|covered) (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:{name})", "under", 0.95),
    ("field", r"\blicen[cs]e\s*[:=]\s*[\"'(]?(?:the )?(?:{tag}(?![a-z0-9.-])|{name})", "licen", 0.9),
    ("name", r"(?<![a-z0-9])(?:{name})", "", 0.7),
)

#: Label and wording of licence texts and of the headers that grant them. A space stands for space and marks of comments.
BODIES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("0bsd", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("bsd-3-clause", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met[\s\S]{0,1500}?neither the names? of"),
    ("bsd-2-clause", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("zlib", r"provided ['`\"]?as-is['`\"]?, without any express or implied warranty\. in no event will the authors? be held liable"),
    ("apache-2.0", r"licensed under the apache licen[cs]e,? version 2\.0 \(the \"?licen[cs]e\"?\); you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    ("agpl-3.0", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("lgpl-2.1", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2(?:\.1)?"),
    ("lgpl-3.0", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3"),
    ("gpl-2.0", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2"),
    ("gpl-3.0", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3"),
    ("gpl", r"free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("epl-2.0", r"the accompanying materials are made available under the terms of the eclipse public licen[cs]e,? (?:v\.? ?|version )?2\.0"),
    ("epl-1.0", r"the accompanying materials are made available under the terms of the eclipse public licen[cs]e,? (?:v\.? ?|version )?1\.0"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cc-by-nc-nd", r"licensed under (?:a|the) creative commons attribution[-\s]non-?commercial[-\s]no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", r"licensed under (?:a|the) creative commons attribution[-\s]non-?commercial[-\s]share ?-?alike"),
    ("cc-by-nc", r"licensed under (?:a|the) creative commons attribution[-\s]non-?commercial"),
    ("cc-by-nd", r"licensed under (?:a|the) creative commons attribution[-\s]no ?deriv(?:ative)?s?"),
    ("cc-by-sa", r"licensed under (?:a|the) creative commons attribution[-\s]share ?-?alike"),
    ("cc-by", r"licensed under (?:a|the) creative commons attribution"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e"),
    ("ofl", r"this font software is licensed under the sil open font licen[cs]e"),
    ("python", r"python software foundation licen[cs]e version 2"),
    ("openrail", r"use-based restrictions as referenced in paragraph 5 must be included"),
)


@dataclass(frozen=True)
class Rule:
    rule: str
    label: str
    keyword: str  # a literal that every match holds, or nothing
    form: str  # likewise, of the form
    pattern: str
    priority: int
    weight: float
    needs: tuple[tuple[str, ...], ...]  # every match holds all literals of one of these


def needs(pattern: str, most: int = 16) -> tuple[tuple[str, ...], ...]:
    """Literals of which every match of a pattern holds all of at least one tuple; a part with too many ways asks for nothing.

    It reads what the rules above are made of: characters, escapes, sets, groups, alternatives, repeats and look-arounds.
    """
    at = 0

    def alternatives() -> list[frozenset[str]]:
        nonlocal at
        ways = sequence()
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            ways = ways + sequence()
        return [w for w in ways if not any(v < w for v in ways)]

    def atom() -> tuple[str, list[frozenset[str]] | None]:
        """A literal character, or nothing and the ways of a group."""
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            ahead = re.compile(r"\?(?::|[!=]|<[!=])").match(pattern, at)
            at = ahead.end() if ahead else at
            ways = alternatives()
            at += 1
            return "", ways if not ahead or ahead.group() == "?:" else None
        if c == "[":
            at = re.compile(r"\^?\]?(?:\\.|[^\]\\])*\]").match(pattern, at).end()
            return "", None
        if c == "\\":
            c = pattern[at]
            at += 1
            return ("" if c.isalnum() else c), None
        return ("" if c in ".^$" else c), None

    def sequence() -> list[frozenset[str]]:
        nonlocal at
        out, run = [frozenset()], ""

        def add(ways: list[frozenset[str]]) -> None:
            nonlocal out
            both = list(dict.fromkeys(a | b for a in out for b in ways))
            out = both if len(both) <= most else out

        def end() -> None:
            nonlocal run
            if len(run) > 1 or run.isdigit():
                add([frozenset({run})])
            run = ""

        while at < len(pattern) and pattern[at] not in "|)":
            literal, ways = atom()
            repeat = re.compile(r"(?:[?*+]|\{(\d+)(?:,\d*)?\})\??").match(pattern, at)
            if repeat:
                at = repeat.end()
            some = not repeat or repeat.group()[0] == "+" or (repeat.group(1) or "0") != "0"
            if literal and not repeat:
                run += literal
                continue
            run += literal if some else ""
            end()
            if ways and some:
                add(ways)
        end()
        return out

    return tuple(sorted({tuple(sorted(w)) for w in alternatives()}))


def _common(ways: tuple[tuple[str, ...], ...]) -> str:
    return max(sorted(set(ways[0]).intersection(*ways)), key=len, default="")


def rules() -> list[Rule]:
    """Wordings, then all forms of all families, best first, then notices that name no licence."""
    out = []
    for k, (label, wording) in enumerate(BODIES):
        pattern = wording.replace(" ?", r"\s*").replace(" ", r"[\s#*/]+")
        ways = tuple(tuple(x for x in w if len(x) > 8 or x == "licen") for w in needs(pattern))  # short words stand in most texts
        out.append(Rule(f"body:{label}:{k}", label, _common(ways), "", pattern, len(out), 1.0, ways))
    for form, pattern, keyword, weight in FORMS:
        for label, tag, name in FAMILIES:
            spaced = pattern.format(tag=f"(?:{tag})", name=name).replace(" ", r"\s+").replace(r"\s+?", r"\s*")
            ways = needs(spaced)
            out.append(Rule(f"{form}:{label}", label, _common(ways), keyword, spaced, len(out), weight, ways))
    for label, keyword, pattern, weight in (
        ("public-domain", "public domain", r"(?:dedicated to|released into|in) the public domain", 0.8),
        ("all-rights-reserved", "rights", r"all\s+rights\s+reserved", 0.6),
        ("copyleft", "copyleft", r"\bcopyleft\b", 0.4),
        ("copyright", "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:[0-9]{4})", 0.3),
        ("unknown", "licensed", r"licensed\s+under", 0.3),
    ):
        ways = needs(pattern)
        out.append(Rule(f"notice:{label}", label, _common(ways), keyword, pattern, len(out), weight, ways))
    return out


def _gate(known: list[Rule]) -> str:
    """A pattern that every text with a detection matches.

    For each way that a rule can match one literal is taken, those first that serve most ways. Ways without a longer literal
    put in their rule's pattern. Grants hold a name, so the rules for names speak for them.
    """
    ways = {w: r.pattern for r in known if not r.rule.startswith("grant:") for w in r.needs}
    patterns = sorted({p for w, p in ways.items() if max(map(len, w)) < 3})
    left, out = [w for w in ways if max(map(len, w)) >= 3], []
    while left:
        serves = {x: sum(any(x in y for y in w) for w in left) for x in sorted({x for w in left for x in w if len(x) >= 3})}
        out.append(max(serves, key=lambda x: (serves[x], len(x))))
        left = [w for w in left if not any(out[-1] in y for y in w)]
    return "(?i)" + "|".join([*map(re.escape, out), *patterns])


#: A text without a match of this has no detection.
GATE = _gate(rules())
SPAN = "struct<start:int,stop:int,priority:int,label:string,rule:string,weight:double>"


def _once(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


CHUNK = 256  # folds that lengthen an array copy it at each step, so they go over pieces of this size


def _pieces(items: Column) -> Column:
    """An array in pieces of at most ``CHUNK``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(starts, lambda k: F.slice(items, k * CHUNK + 1, CHUNK))).otherwise(F.array())


def _spans(text: Column, r: Column) -> Column:
    """Where a rule's pattern stands in a text: gaps and hits take turns, so the ends are running sums of their lengths."""
    ends = "struct<begin:int,end:int>"

    def within(piece: Column) -> Column:
        """Places counted from the start of a piece."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ends}>").alias("found"))

        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + x["g"]
            end = begin + x["h"]
            return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(begin.alias("begin"), end.alias("end")))).alias("found"))

        return F.aggregate(piece, start, step)

    def placed(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{ends}>>").alias("found"))

        def step(s: Column, p: Column) -> Column:
            moved = F.transform(p["found"], lambda x: F.struct((x["begin"] + s["at"]).alias("begin"), (x["end"] + s["at"]).alias("end")))
            return F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["found"], F.array(moved)).alias("found"))

        return F.flatten(F.aggregate(pieces, start, step, lambda s: s["found"]))

    def of(hits: Column) -> Column:
        gaps = F.transform(F.split(text, r["pattern"], -1), lambda g: F.length(g))
        both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), F.length(h).alias("h")))
        places = placed(_once(both, lambda b: F.transform(_pieces(b), within)))
        return F.transform(places, lambda x: F.struct(x["begin"].alias("start"), x["end"].alias("stop"), r["priority"].alias("priority"), r["label"].alias("label"), r["rule"].alias("rule"), r["weight"].alias("weight")))

    return _once(F.regexp_extract_all(text, r["pattern"], F.lit(0)), of)


def _resolve(spans: Column) -> Column:
    """By priority, then length, then place, each detection that overlaps none already kept; in order of place.

    Only detections that hang together by overlaps compete, so each such run is resolved apart, and a run ends where the next
    detection overlaps none before it.
    """
    none = F.array().cast(f"array<{SPAN}>")
    runs_type = f"array<array<{SPAN}>>"

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["reach"]
        return F.struct(
            F.greatest(s["reach"], x["stop"]).alias("reach"),
            F.when(apart & (F.size(s["run"]) > 0), F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]).alias("done"),
            F.when(apart, F.array(x)).otherwise(F.concat(s["run"], F.array(x))).alias("run"),
        )

    def over(s: Column, piece: Column) -> Column:
        """One piece: its finished runs are put behind those of the pieces before it, the open run is carried on."""
        begin = F.struct(s["reach"].alias("reach"), F.array().cast(runs_type).alias("done"), s["run"].alias("run"))
        return _once(F.aggregate(piece, begin, step), lambda e: F.struct(e["reach"].alias("reach"), F.concat(s["done"], F.array(e["done"])).alias("done"), e["run"].alias("run")))

    def best(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda x: F.struct(x["priority"].alias("p"), (x["start"] - x["stop"]).alias("l"), x["start"].alias("at"), x.alias("x"))))
        free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"]))
        return F.aggregate(ranked, none, lambda kept, r: F.when(free(kept, r["x"]), F.concat(kept, F.array(r["x"]))).otherwise(kept), lambda kept: F.array_sort(kept))

    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{runs_type}>").alias("done"), none.alias("run"))
    last = lambda s: F.concat(F.flatten(s["done"]), F.when(F.size(s["run"]) > 0, F.array(s["run"])).otherwise(F.array().cast(runs_type)))
    runs = F.aggregate(_once(F.array_sort(spans), _pieces), start, over, last)
    return F.flatten(F.transform(runs, lambda run: F.when(F.size(run) > 1, best(run)).otherwise(run)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def detections(text: Column, gated: bool = True) -> Column:
    """The detections of a text: start and stop (code points), priority, label, rule and weight, in order of place.

    Without the gates every rule runs on every text; the result is the same.
    """
    known = rules()
    literals = sorted({x for r in known for w in r.needs for x in w})
    table = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.label).alias("label"), F.array(*[F.array(*map(F.lit, w)).cast("array<string>") for w in r.needs]).alias("needs"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight")) for r in known])

    def run(t: Column) -> Column:
        met = lambda held: F.filter(table, lambda r: F.exists(r["needs"], lambda way: F.size(F.array_except(way, held)) == 0))
        held = F.filter(F.array(*map(F.lit, literals)), lambda x: F.contains(t, x))
        return _resolve(F.flatten(F.transform(_once(held, met) if gated else table, lambda r: _spans(t, r))))

    if not gated:
        return _once(_lower(text), run)
    return F.when(text.rlike(GATE), _once(_lower(text), run)).otherwise(F.array().cast(f"array<{SPAN}>"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EITHER_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def base_places(text: Column) -> Column:
    """Start (in words, from 0) and label of each place of a phrase of ``BASE``; all of them end with the word license."""

    def places(w: Column) -> Column:
        def at(k: Column) -> Column:
            one = lambda label, words: F.when(
                F.forall(F.array(*[F.coalesce(F.get(w, k - len(words) + 1 + j) == x, F.lit(False)) for j, x in enumerate(words)]), lambda y: y),
                F.struct((k - len(words) + 1).alias("k"), F.lit(label).alias("label")),
            )
            return F.array_compact(F.array(*[one(label, words) for label, words in BASE.items()]))

        ends = F.array_compact(F.transform(w, lambda x, k: F.when(x == "license", k)))
        return F.flatten(F.transform(ends, at))

    found = _once(F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0)), places)
    return F.when(text.rlike("(?i)license"), found).otherwise(F.array().cast("array<struct<k:int,label:string>>"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, base (array of places), detections (array of spans), labels (sorted, distinct) and score.

    A-Z count as a-z. ``labels`` are those of ``base`` and of ``detections``; ``score`` is the largest weight of a
    detection, at least 0.5 with a base phrase, else 0. A null text counts as empty. Columns already called
    so are replaced, all others stay. Rows are independent of each other.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.struct(F.regexp_count(whole, F.lit(EITHER_CASE)).cast("long").alias("n_words"), base_places(whole).alias("base"), detections(whole).alias("detections"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found.alias("s"))
    score = F.greatest(F.coalesce(F.array_max("s.detections.weight"), F.lit(0.0)), F.when(F.size("s.base") > 0, 0.5).otherwise(0.0))
    labels = F.array_sort(F.array_union("s.base.label", "s.detections.label"))
    made = rows.select("row", F.struct("s.*", labels.alias("labels"), score.alias("score")).alias("new"))
    gone = ("n_words", "base", "detections", "labels", "score")
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in gone], "new.*")
