"""Operator 2: license scans by ordered signature rules.

A text is lower-cased and reduced to its words. Signatures are regular expressions over that sequence of words; each has
keywords, one of which each match holds, and only signatures with a keyword that occurs are tried, after one test that most
texts don't pass. Detections that
overlap are resolved by priority and containment: one that lies within another of higher priority, or within a longer one
of the same priority, is suppressed. Base phrases are never suppressed. Only DataFrame functions are used, row by row, so
there is no shuffle.

Cases: a null or empty text has no words and no labels, score 0 and null places; long texts are scanned whole; detections of
equal extent and priority all stay; equal rows give equal results; extra columns pass through, those named like an output
are replaced; an empty table gives an empty table. Places are word numbers from 0, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.llm.common import quoted, table, without
from spendspark.llm.native import folded


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int


#: Fixed: the base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What a detection of each priority counts: base phrase, identifier, notice, license text, name.
SPDX, NOTICE, GRANT, NAME = 4, 3, 2, 1
CONFIDENCE = {5: 1.0, SPDX: 1.0, NOTICE: 0.9, GRANT: 0.8, NAME: 0.6}
_V = r"(?:version |v)?"

#: Words that say little about which license a text names.
_COMMON = {"license", "licen", "public", "software", "free", "general", "open", "source", "the", "version", "document"}

#: label: (identifier after "spdx license identifier", name as a regular expression), all over lower-case words.
LICENSES = {
    "0bsd": ("0bsd", "zero clause bsd license|bsd zero clause license|0 clause bsd license"),
    "afl-3": ("afl 3 0", f"academic free license {_V}3(?: 0)?"),
    "agpl-1": ("agpl 1 0(?: only| or later)?", f"affero general public license {_V}1(?: 0)?"),
    "agpl-3": ("agpl 3 0(?: only| or later)?", f"(?:gnu )?affero general public license(?: as published by the free software foundation either)? {_V}3(?: 0)?|gnu agpl ?v?3(?: 0)?"),
    "apache-1.1": ("apache 1 1", f"apache (?:software )?license {_V}1 1"),
    "apache-2": ("apache 2 0", f"apache (?:software )?license {_V}2(?: 0)?|apache 2 0 license|apache 2 license|asl 2 0"),
    "apsl-2": ("apsl 2 0", f"apple public source license {_V}2(?: 0)?"),
    "artistic-1": ("artistic 1 0(?: perl| cl8)?", f"artistic license {_V}1(?: 0)?"),
    "artistic-2": ("artistic 2 0", f"artistic license {_V}2(?: 0)?"),
    "blueoak-1": ("blueoak 1 0 0", "blue oak model license(?: 1 0 0)?"),
    "bsd-2-clause": ("bsd 2 clause(?: patent| views)?", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?"),
    "bsd-3-clause": ("bsd 3 clause(?: clear| lbnl| attribution)?", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    "bsd-4-clause": ("bsd 4 clause(?: uc)?", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: license)?"),
    "bsl-1": ("bsl 1 0", f"boost software license(?: {_V}1(?: 0)?)?"),
    "busl-1.1": ("busl 1 1", f"business source license(?: {_V}1 1)?"),
    "cc-by": ("cc by [1-4] [05]", f"creative commons attribution(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)? license|cc by [1-4] [05]"),
    "cc-by-sa": ("cc by sa [1-4] [05]", f"creative commons attribution share ?alike(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?|cc by sa(?: [1-4] [05])?"),
    "cc-by-nd": ("cc by nd [1-4] [05]", f"creative commons attribution no ?deriv(?:ative)?s?(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?|cc by nd(?: [1-4] [05])?"),
    "cc-by-nc": ("cc by nc [1-4] [05]", f"creative commons attribution non ?commercial(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)? license|cc by nc [1-4] [05]"),
    "cc-by-nc-sa": ("cc by nc sa [1-4] [05]", f"creative commons attribution non ?commercial share ?alike(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?|cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc-nd": ("cc by nc nd [1-4] [05]", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: {_V}[1-4] [05])?(?: (?:international|unported|generic))?(?: public)?(?: license)?|cc by nc nd(?: [1-4] [05])?"),
    "cc0": ("cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    "cddl-1": ("cddl 1 [01]", f"common development and distribution license(?: cddl)?(?: {_V}1(?: [01])?)?"),
    "cecill-2": ("cecill 2 [01]", f"cecill (?:free software )?license(?: {_V}2(?: [01])?)?"),
    "cpal-1": ("cpal 1 0", f"common public attribution license(?: {_V}1(?: 0)?)?"),
    "cpl-1": ("cpl 1 0", f"common public license(?: {_V}1(?: 0)?)?"),
    "ecl-2": ("ecl 2 0", f"educational community license(?: {_V}2(?: 0)?)?"),
    "elastic-2": ("elastic 2 0", f"elastic license(?: {_V}2(?: 0)?)?"),
    "epl-1": ("epl 1 0", f"eclipse public license {_V}1(?: 0)?"),
    "epl-2": ("epl 2 0", f"eclipse public license(?: {_V}2(?: 0)?)?"),
    "eupl-1.2": ("eupl 1 [12]", f"european union public licen[cs]e(?: {_V}1(?: [12])?)?"),
    "gfdl-1.3": ("gfdl 1 [123](?: only| or later)?", f"gnu free documentation license(?: {_V}1(?: [123])?)?"),
    "gpl-1": ("gpl 1 0(?: only| or later)?", f"gnu general public license {_V}1(?: 0)?|gpl ?v?1(?: 0)?"),
    "gpl-2": ("gpl 2 0(?: only| or later)?(?: with [a-z0-9 ]{1,40}exception)?", f"gnu general public license(?: as published by the free software foundation either)? {_V}2(?: 0)?|gnu gpl {_V}2(?: 0)?|gplv2|gpl 2(?: 0)?"),
    "gpl-3": ("gpl 3 0(?: only| or later)?(?: with [a-z0-9 ]{1,40}exception)?", f"gnu general public license(?: as published by the free software foundation either)? {_V}3(?: 0)?|gnu gpl {_V}3(?: 0)?|gplv3|gpl 3(?: 0)?"),
    "hpnd": ("hpnd", "historical permission notice and disclaimer"),
    "isc": ("isc", "isc license"),
    "lgpl-2": ("lgpl 2 0(?: only| or later)?", f"gnu library general public license(?: {_V}2(?: 0)?)?|lgpl 2 0"),
    "lgpl-2.1": ("lgpl 2 1(?: only| or later)?", f"gnu lesser general public license {_V}2 1|lgplv2 1|lgpl 2 1"),
    "lgpl-3": ("lgpl 3 0(?: only| or later)?", f"gnu lesser general public license {_V}3(?: 0)?|lgplv3|lgpl 3(?: 0)?"),
    "lppl-1.3": ("lppl 1 [0-3]c?", f"latex project public license(?: {_V}1(?: [0-3]c?)?)?"),
    "mit": ("mit", "mit licen[cs]e|mit x11 license|expat license"),
    "mit-0": ("mit 0", "mit no attribution(?: license)?|mit 0 license"),
    "mpl-1.1": ("mpl 1 [01]", f"mozilla public license {_V}1(?: [01])?|mpl 1 1"),
    "mpl-2": ("mpl 2 0(?: no copyleft exception)?", f"mozilla public license(?: {_V}2(?: 0)?)?|mpl ?v?2(?: 0)?"),
    "ms-pl": ("ms pl", "microsoft public license"),
    "ms-rl": ("ms rl", "microsoft reciprocal license"),
    "ncsa": ("ncsa", "university of illinois ncsa open source license|ncsa open source license"),
    "odbl-1": ("odbl 1 0", f"open (?:data commons open )?database license(?: {_V}1(?: 0)?)?"),
    "odc-by-1": ("odc by 1 0", "open data commons attribution license"),
    "ofl-1.1": ("ofl 1 [01]", f"sil open font license(?: {_V}1(?: [01])?)?"),
    "openssl": ("openssl", "openssl license"),
    "osl-3": ("osl 3 0", f"open software license(?: {_V}3(?: 0)?)?"),
    "php-3": ("php 3 01?", f"php license(?: {_V}3(?: 01?)?)?"),
    "postgresql": ("postgresql", "postgresql license"),
    "psf-2": ("psf 2 0|python 2 0", f"python software foundation license(?: {_V}2)?|psf license"),
    "ruby": ("ruby", "ruby license"),
    "sspl-1": ("sspl 1 0", f"server side public license(?: {_V}1)?"),
    "unlicense": ("unlicense", "the unlicense"),
    "upl-1": ("upl 1 0", f"universal permissive license(?: {_V}1(?: 0)?)?"),
    "vim": ("vim", "vim license"),
    "w3c": ("w3c(?: 20150513)?", "w3c (?:software|document)(?: notice and)?(?: license)?"),
    "wtfpl": ("wtfpl", "wtfpl|do what the [a-z]+ you want to public license"),
    "x11": ("x11", "x11 license"),
    "zlib": ("zlib", "zlib(?: libpng)? license"),
    "zpl-2": ("zpl 2 [01]", f"zope public license(?: {_V}2(?: [01])?)?"),
    "public-domain": ("public domain", "public domain"),
    "all-rights-reserved": ("licenseref all rights reserved", "all rights reserved"),
}
#: Passages of license texts: (label, regular expression).
GRANTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by-nc", "for non ?commercial purposes only under (?:a|the) creative commons"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("gfdl-1.3", "with no invariant sections no front cover texts and no back cover texts"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "when we speak of free software we are referring to freedom not price"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "you should have received a copy of the gnu affero general public license along with"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("upl-1", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1", "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("wtfpl", "you just do what the [a-z]+ you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("psf-2", "psf is making python available to licensee on an as is basis"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("ms-pl", "the software is licensed as is you bear the risk of using it"),
    ("sspl-1", "available to third parties as a service you must make the service source code available"),
    ("busl-1.1", "the licensed work is provided on an as is basis"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("eupl-1.2", "licensed under the eupl"),
]
_NOTICE = r"(?:licensed|released|distributed|available|provided|published|offered|covered|used|redistributed|made available) under (?:(?:the|a|an) )?(?:(?:terms|conditions) of (?:the )?)?(?:gnu )?"


#: The parts that signatures are written in: a group, what ends or parts it, a class of characters, how often, a character.
_SYNTAX = re.compile(r"\(\?:|[)|]|\[[^\]]+\]|[?*+]|\{(\d+),?\d*\}|.")


def keyword_of(pattern: str) -> str:
    """Words of which each match of ``pattern`` holds one, joined by "|": read off the expression, so no match is without."""
    tokens = [(m[0], m[1]) for m in _SYNTAX.finditer(pattern)]

    def worth(words: tuple[str, ...]) -> tuple[int, int]:
        return min((len(" ".join(w for w in k.split() if w not in _COMMON)) for k in words), default=0), min(map(len, words), default=0)

    def best(found: list[tuple[str, ...]]) -> tuple[str, ...]:
        return max(found, key=worth)

    def group(at: int, before: str = "") -> tuple[tuple[str, ...], int]:
        """What each match of a group, and the characters ``before`` it, holds, and where it ends: one choice for each branch, if
        all of them have one."""
        branches, found, run = [], [()], before
        while at < len(tokens) and tokens[at][0] != ")":
            token, at = tokens[at][0], at + 1
            if token == "|":
                branches.append(best([*found, (run,) if run else ()]))
                found, run = [()], before
                continue
            held = None
            if token == "(?:":
                held, at = group(at, run)
                at += 1
            many = tokens[at] if at < len(tokens) and (tokens[at][0] in ("?", "*", "+") or tokens[at][1] is not None) else None
            at += many is not None
            least = 1 if many is None or many[0] == "+" else int(many[1] or 0)
            if held is None and len(token) == 1 and many is None:
                run += token
                continue
            # A part that isn't one plain character ends the run of them; what it holds counts if it can't be left out.
            found.append((run,) if run else ())
            run = ""
            if held is None and len(token) == 1:
                held = (token,)
            if held and least:
                found.append(held)
        branches.append(best([*found, (run,) if run else ()]))
        return (tuple(k for one in branches for k in one) if all(branches) else ()), at

    return "|".join(dict.fromkeys(group(0)[0]))


def signatures() -> list[Signature]:
    """All rules, those of high priority first: identifiers, notices, passages of license texts and names."""
    out = []
    for label, (spdx, name) in LICENSES.items():
        key = keyword_of(name)
        out += [Signature(label, "spdx", f"spdx license identifier (?:{spdx})", SPDX), Signature(label, key, f"{_NOTICE}(?:{name})", NOTICE), Signature(label, key, f"(?:{name})", NAME)]
    out += [Signature(label, keyword_of(pattern), pattern, GRANT) for label, pattern in GRANTS]
    return sorted(out, key=lambda s: (-s.priority, s.label, s.keyword, s.pattern))


#: One test for all: a text that no part of this matches holds no signature's keyword next to what it needs.
_GATE = r"licen[cs]e|spdx|hereby|redistribut|unencumbered|misrepresented|invariant|rights|domain|commons|merchantability|gpl|lgpl|cc0|cc by|wtfpl|freebsd|bsd|asl 2|mpl|historical|endorse|compliance|agreed|organization|what the|w3c|mit |psf|permission notice|freedom not|advertising materials|disclaims|held liable|compiled binary|includes software|commercial purposes|third parties|consortium"


def _count_words(piece: Column, outer: int) -> Column:
    """Words of a part of the padded sequence: blanks, less one where blanks stand on both sides, plus one where on none."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))) + F.lit(outer)


def _spans(padded: Column, pattern: Column) -> Column:
    """(start, end) in words of each match of ``pattern``, which may be a different one for each row."""
    full = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    both = F.struct(F.call_function("split", padded, full).alias("pieces"), F.regexp_extract_all(padded, full, F.lit(0)).alias("matches"))
    sizes = lambda b: F.zip_with(F.slice(b["pieces"], 1, F.size(b["matches"])), b["matches"], lambda p, m: F.struct(_count_words(p, -1).alias("gap"), _count_words(m, 1).alias("size")))

    def step(acc: Column, out: Column, s: Column) -> tuple[dict[str, Column], Column]:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["size"]
        return {"at": end}, F.concat(out, F.array(F.struct(start.alias("start"), end.alias("end"))))

    spans = lambda sizes_: folded(sizes_, {"at": F.lit(0)}, "struct<start:int,end:int>", step)
    return F.get(F.transform(F.transform(F.array(both), sizes), spans), F.lit(0))


def _unsuppressed(hits: Column) -> Column:
    """Detections in order of start, longest first, kept unless one met before reaches as far and has a higher priority, or
    the same priority and a longer extent. One pass with the furthest end for each priority, and the last that was kept."""
    levels = [GRANT, NOTICE, SPDX, NAME]
    state = {**{f"m{p}": F.lit(-1) for p in levels}, **{n: F.lit(-1) for n in ("start", "end", "priority")}}

    def step(acc: Column, out: Column, h: Column) -> tuple[dict[str, Column], Column]:
        # ``hits`` are sorted by start, then by end and priority in falling order, so all that may contain h came before.
        hidden = F.lit(False)
        for p in levels:
            hidden = hidden | ((h["priority"] < p) & (acc[f"m{p}"] >= h["end"]))
        twin = (acc["start"] == h["start"]) & (acc["end"] == h["end"]) & (acc["priority"] == h["priority"])
        for p in levels:
            hidden = hidden | ((h["priority"] == p) & (acc[f"m{p}"] >= h["end"]) & ~twin)
        new = {f"m{p}": F.when(h["priority"] == p, F.greatest(acc[f"m{p}"], h["end"])).otherwise(acc[f"m{p}"]) for p in levels}
        new |= {n: F.when(hidden, acc[n]).otherwise(h[n]) for n in ("start", "end", "priority")}
        one = F.struct(h["start"].alias("start"), h["end"].alias("end"), h["priority"].alias("priority"), h["label"].alias("label"))
        return new, F.when(hidden, out).otherwise(F.concat(out, F.array(one)))

    return folded(hits, state, "struct<start:int,end:int,priority:int,label:string>", step)


def scan(df: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Adds n_words, base_places (start, end, label), detections (start, end, priority, label), base_labels, labels (arrays) and score."""
    rules = signatures() if rules is None else rules
    outputs = ["n_words", "base_places", "detections", "base_labels", "labels", "score"]
    kept = [F.col(quoted(c)) for c in without(df, outputs) if c != text]
    cut = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = F.split(F.lower(F.coalesce(F.col(quoted(text)), F.lit(""))), cut)
    one = df.select(*kept, F.filter(words, lambda w: w != "").alias("__words"))
    two = one.select(*kept, F.size("__words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")).alias("__padded"))
    two = two.withColumn("__gate", F.col("__padded").rlike(_GATE) if rules else F.lit(False))

    places = F.array().cast("array<struct<start:int,end:int,label:string>>")
    padded = F.col("__padded")
    for phrase, label in BASE.items():
        named = F.lit(label).alias("label")
        own = F.transform(_spans(padded, F.lit(phrase)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), named))  # noqa: B023
        places = F.concat(places, F.when(padded.contains(f" {phrase} "), own).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")))
    listed = F.array(*[F.struct(F.lit(r.label).alias("label"), F.array(*[F.lit(k) for k in r.keyword.split("|")]).alias("keywords"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority")) for r in rules] or [F.lit(None).cast("struct<label:string,keywords:array<string>,pattern:string,priority:int>")])
    # Keys that sort by start, then by end and priority in falling order.
    found = lambda r: F.transform(_spans(padded, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-r["priority"]).alias("low"), r["label"].alias("label")))
    hits = F.flatten(F.transform(F.filter(listed, lambda r: F.exists(r["keywords"], lambda k: F.contains(padded, k))), found))
    none = F.array().cast("array<struct<start:int,back:int,low:int,label:string>>")
    three = two.select(*kept, "n_words", places.alias("base_places"), F.when(F.col("__gate"), F.array_distinct(F.array_sort(hits))).otherwise(none).alias("__hits"))
    shaped = F.transform("__hits", lambda h: F.struct(h["start"].alias("start"), (-h["back"]).alias("end"), (-h["low"]).alias("priority"), h["label"].alias("label")))
    four = three.select(*kept, "n_words", "base_places", F.when(F.size("__hits") > 0, _unsuppressed(shaped)).otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")).alias("detections"))
    base = F.array_sort(F.array_distinct(F.transform("base_places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("base_places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))))
    strength = F.lit(0.0)
    for p in (NAME, GRANT, NOTICE, SPDX):
        strength = F.when(F.array_contains(F.transform("detections", lambda d: d["priority"]), p), F.lit(CONFIDENCE[p])).otherwise(strength)
    score = F.when(F.size("base_places") > 0, F.lit(CONFIDENCE[5])).otherwise(strength)
    whole = F.struct("n_words", "base_places", "detections", base.alias("base_labels"), both.alias("labels"), score.alias("score"))
    # A generated row keeps later filters from being pushed below, where each would scan again.
    return four.select(*kept, F.explode(F.array(whole)).alias("__s")).select(*kept, "__s.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """Licenses of every whole document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text")), "__text")
    starts = F.transform("base_places", lambda p: p["start"])
    return out.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
