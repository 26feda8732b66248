import random

import numpy as np
from pyspark.sql import functions as F

from spendspark.llm import toxicity as X

BAD, PLAIN = ["grumble", "snarl", "sneer", "spite"], [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        words = rng.choices(PLAIN, k=rng.randint(20, 80)) + (rng.choices(BAD, k=rng.randint(1, 5)) if toxic else []) + (["zzz", "qqq"] if junk else [])
        rng.shuffle(words)
        rows.append((seed * 10**6 + i, " ".join(words).title() + ".", int(not junk), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    schema = "doc_id long, text string, quality int, toxic int"
    train, held = spark.createDataFrame(corpus(1500, 1), schema), spark.createDataFrame(corpus(1000, 2), schema)
    chain = X.fit(train.select("doc_id", "text"), train.select("doc_id", "quality", "toxic"), X.categories())
    out = X.predict(held, chain).collect()
    wrong = sum(r.rejected != bool(r.toxic) for r in out)
    assert wrong <= 10
    assert sum((r.p_toxic_junk >= 0.5) != bool(r.toxic and not r.quality) for r in out) <= 30


def test_out_of_fold_models_never_see_their_fold():
    rng = np.random.default_rng(0)
    x, y = (rng.random((200, 6)) < 0.4).astype(float), rng.random((200, 2)) < 0.3
    chain = X.fit_arrays(x, y, np.arange(200) % X.FOLDS, {str(i): i for i in range(6)}, ["a", "b"])
    # random labels: an honest out-of-fold probability says nothing, so the later model gives it little weight
    assert abs(chain.weights[1][-1]) < 2 and chain.weights[0].shape == (7,) and chain.weights[1].shape == (8,)


def test_words_of_a_fold_are_chosen_without_it(spark, monkeypatch):
    monkeypatch.setattr(X, "WORDS_EACH", 6)
    rng = random.Random(5)
    rows = [(i % X.FOLDS, sorted(set(rng.choices(PLAIN[:60], k=12))), int(rng.random() < 0.3), int(rng.random() < 0.2)) for i in range(300)]
    got = X.best_words(spark.createDataFrame(rows, "__fold int, __words array<string>, __a int, __b int"), ["a", "b"])
    for f in range(X.FOLDS + 1):
        inside, want = [r for r in rows if r[0] != f], set()
        for k in (2, 3):
            rate, rated = (sum(r[k] for r in inside) + 0.5) / (len(inside) + 1), []
            for w in PLAIN[:60]:
                df, hits = sum(w in r[1] for r in inside), sum(r[k] for r in inside if w in r[1])
                if df >= X.LEAST_DOCS:
                    rated.append((-round(abs(hits - df * rate) / (df * rate * (1 - rate)) ** 0.5, 9), w))
            want |= {w for _, w in sorted(rated)[:6]}
        assert {r.word for r in got if r.f == f} == want
    # models of a fold get no column that was chosen with it
    present, labels, folds = np.eye(10)[rng.choices(range(10), k=200)], np.array([[rng.random() < 0.5] for _ in range(200)]), np.arange(200) % X.FOLDS
    chain = X.fit_arrays(present, labels, folds, {"w": 0, "v": 1}, ["a"], [np.array([f]) for f in range(X.FOLDS)] + [np.array([0, 1])])
    assert chain.weights[0].shape == (3,)


def test_cases(spark, tmp_path):
    rows = [(i, t, "q") for i, t in enumerate(["", None, "wab " * 200_000, "Grumble!", "Grumble!", "wab wac"])] + [(None, "snarl", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, REJECTED string").union(spark.createDataFrame([(r[0], r[1], "t") for r in corpus(600, 3)], "doc_id long, text string, r string"))
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in corpus(600, 3)] + [(0, None, None), (None, 1, 1), (3_000_001, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = X.op10(spark, str(tmp_path)).collect()
    assert len(got) == 607 and all(0 <= r.p_toxic <= 1 and r.kept != r.toxic for r in got)
    by = {r.doc_id: r.toxic for r in got}
    assert by[3] and by[4] and by[None] and not by[0] and not by[1] and not by[2] and not by[5]
    kept = X.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 4)").count() == 0 and kept.where("doc_id in (0, 1, 2, 5)").count() == 4
    assert {r.rejected for r in X.predict(docs, X.fit(docs, labels.limit(0), X.categories())).collect()} == {False}
    assert X.predict(docs.limit(0), X.fit(docs.limit(0), labels, X.categories())).count() == 0
    assert X.labelled_sample(docs, labels, {"toxic": F.col("toxic") == 1}, "doc_id", "text", 50).count() < 120
