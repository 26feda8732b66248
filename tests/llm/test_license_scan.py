import random
import re

import pytest

from spendspark.llm import license_scan as L
from spendspark.llm import native


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    words, out = words_of(text), []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in out]
    return len(words), len(out), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in out}))


def brute_detections(text):
    words = words_of(text)
    padded = f" {' '.join(words)} "
    hits = set()
    for r in L.signatures():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", padded):
            a = padded[: m.start()].count(" ") - 1
            hits.add((a, a + len(m[0].split()), r.priority, r.label))
    inside = lambda s, t: t[0] <= s[0] and s[1] <= t[1]
    return sorted(s for s in hits if not any(inside(s, t) and (t[2] > s[2] or t[2] == s[2] and t[1] - t[0] > s[1] - s[0]) for t in hits))


LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "CC BY-NC 4.0", "cc by nc",
    "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved.", "under the mit license under the mit license", "BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "made available under the terms of the Mozilla Public License 2.0", "this is free and unencumbered software released into the public domain", "gplv3", "mit", "the unlicense", "plain words only", "Émit license ÀPACHE", "CC BY-SA 3.0 unported", "ISC license, zlib license",
]
TEXTS = ["", None, " . ", *LINES, "\n".join(LINES), "Under the MIT license " * 3000, "x " * 50_000 + LINES[1]]


@pytest.mark.parametrize("part", [native.PART, 2])
def test_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(native, "PART", part)
    rng = random.Random(2)
    texts = TEXTS[:-2] + ["  ".join(rng.choices([*LINES, "a", "gnu", "license", "mit", "under the"], k=rng.randint(1, 12))) for _ in range(150)]
    out = L.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert sorted(tuple(d) for d in r.detections) == brute_detections(texts[r.i]), texts[r.i]
        base = {p.label for p in r.base_places}
        assert r.labels == sorted(base | {d.label for d in r.detections}) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_query_cases(spark, tmp_path):
    rows = [(i, t, "l") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "l"), (None, TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LABELS string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op2(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:6] == brute_base(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    by = {r.doc_id: r.labels for r in got}
    assert by[3] == "mit" and by[4] == "apache-2" and by[5] == "gpl-3" and by[8] == "gpl-2" and by[18] == ""
    assert L.scan(docs.limit(0)).count() == 0 and L.scan(docs).where("score > 2").count() == 0


def test_rules():
    assert 150 <= len(L.signatures()) <= 400 and [s.priority for s in L.signatures()] == sorted((s.priority for s in L.signatures()), reverse=True)
    for s in L.signatures():
        re.compile(s.pattern)


def examples(items):
    """Texts that a parsed expression matches: each branch, each optional part with and without."""
    out = [""]
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "SUBPATTERN":
            more = examples(value[3])
        elif name == "BRANCH":
            more = [e for branch in value[1] for e in examples(branch)]
        elif name == "MAX_REPEAT":
            more = ([""] if not value[0] else []) + examples(value[2])[:2]
        else:
            more = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        out = [a + b for a in out for b in more][:40]
    return out


def test_each_alternative_is_found_with_the_prefilter(spark):
    texts = ["licensed under cc by 4 0", "asl 2 0", "expat license", "gnu agpl v3", "psf license", "for non commercial purposes only under a creative commons"]
    for r in L.signatures():
        texts += [t for t in examples(re._parser.parse(r.pattern if r.priority != L.NOTICE else "licensed under " + r.pattern[len(L._NOTICE) :])) if t]
    texts = sorted(set(texts))
    for text in texts:
        assert re.search(L._GATE, f" {text} "), text
        for r in L.signatures():
            if re.search(f"(?<= )(?:{r.pattern})(?= )", f" {text} "):
                assert any(k in f" {text} " for k in r.keyword.split("|")), (text, r)
    out = L.scan(spark.createDataFrame(list(enumerate(texts[::40] + ["asl 2 0", "gnu agpl v3"])), "i int, text string")).collect()
    assert all(r.score > 0 and r.labels for r in out) and out[-2].labels == ["apache-2"] and "agpl-3" in out[-1].labels


def test_main_path_has_no_python(spark):
    plan = L.scan(spark.createDataFrame([(1, "mit license")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
