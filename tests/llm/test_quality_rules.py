import random
import re
from collections import Counter

import pytest

from spendspark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 150))]
        kind = rng.random()
        if kind < 0.1:
            words = [w + rng.choice(["***", "$$$", "&&&"]) for w in words]
        elif kind < 0.2:
            words = [w.upper() + "!!" for w in words]
        rows.append((seed * 10**6 + i, " ".join(words), int(kind >= 0.2)))
    return rows


TEXTS = [
    "", None, " \t\n", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x  y z \x85 é🙂|<>#*$%&", "l1 w\nl1 w\n\nl1 w\r\n \nl2", "the cat sat the cat sat the dog " * 40,
    "w " * 30_000, " ".join(f"u{i}" for i in range(20_000)), "p q r s p q r t q r s", "\x0b lead trail \x0c", "A\x00B c",
]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices(["a", "b", "c", " ", " ", "\n", "d e f", "#"], k=rng.randint(1, 60))) for _ in range(300)]
    out = Q.statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.i]), texts[r.i]
    assert len(out) == len(texts)


def test_hashes_that_meet_hide_no_repeats(spark, monkeypatch):
    # Only a few bits of each hash are left, so that many windows of each text meet under one.
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(3, 80))) for _ in range(200)] + ["w2512239 b c f1 f2 w3197895 b c f3 f4 w2512239 b c f5 f6"]
    for bits in (24, 60):
        monkeypatch.setattr(Q, "_place_bits", lambda words, bits=bits: Q.F.lit(bits))
        for r in Q.statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect():
            assert r.n_repeat_words == brute(texts[r.i])[4], (bits, texts[r.i])


def test_rules_on_held_out_documents(spark):
    train, held = spark.createDataFrame(corpus(1200, 1), "doc_id long, text string, quality int"), spark.createDataFrame(corpus(600, 2), "doc_id long, text string, quality int")
    rules = Q.learn(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    assert 1 <= len(rules) <= Q.MAX_RULES and all(str(r) for r in rules)
    out = Q.apply(held, rules).collect()
    assert sum(not r.kept for r in out if r.quality) <= 3 and sum(r.kept for r in out if not r.quality) <= 10


def test_query_cases(spark, tmp_path):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "k"), (None, TEXTS[8], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (12, 1), (12, 0)], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op1(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        b = brute(TEXTS[8 if r.doc_id is None else r.doc_id])
        assert tuple(r[1:6]) == b and r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [12]
    assert Q.apply(docs.limit(0), []).count() == 0 and Q.learn(docs, labels.limit(0)) == []


@pytest.mark.parametrize("rules", [[], [Q.Rule((Q.Term("words", True, 3.0),))]])
def test_main_path_has_no_python(spark, rules):
    df = Q.apply(spark.createDataFrame([(1, "a b c d")], "doc_id int, text string"), rules)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_conjunction_is_learned_where_one_term_is_not_enough(spark):
    """Bad are only documents with both symbols and capitals; with one of them they are good."""

    def both(n, seed):
        rng, rows = random.Random(seed), []
        for i in range(n):
            words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 150))]
            symbols, capitals = rng.random() < 0.5, rng.random() < 0.5
            words = [w + "***" if symbols and k % 3 == 0 else w for k, w in enumerate(words)]
            words = [w.upper() if capitals and k % 3 else w for k, w in enumerate(words)]
            rows.append((seed * 10**6 + i, " ".join(words), int(not (symbols and capitals))))
        return rows

    train, held = (spark.createDataFrame(both(n, s), "doc_id long, text string, quality int") for n, s in ((1200, 3), (600, 4)))
    rules = Q.learn(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    assert rules and max(len(r.terms) for r in rules) >= 2, list(map(str, rules))
    out = Q.apply(held, rules).collect()
    assert sum(not r.kept for r in out if r.quality) <= 6 and sum(r.kept for r in out if not r.quality) <= 12
