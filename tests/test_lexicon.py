import random

from spendspark.operators import lexicon


def best(text, patterns):
    held = [p for p in patterns if p and p in (text or "").lower()]
    return min(held, key=lambda p: (-len(p), p), default=None)


def test_longest_pattern_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdé", k=n))
    patterns = {word(rng.randint(1, 9)) for _ in range(400)} - {"a", "b", "c", "d", "é"} | {"x", "日本"}
    texts = [None, "", "a", "X", "日本語", "ABCD ÉABC", *[" ".join(word(rng.randint(1, 12)) for _ in range(rng.randint(1, 5))).upper() for _ in range(300)], "z" * 50_000 + "abcd" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame([(p, f"c{len(p)}") for p in patterns] + [(None, "c"), ("", "c"), ("日本", "b")], "pattern string, category string")
    want = {i: b for i, t in enumerate(texts) if (b := best(t, patterns))}
    for size in (8 << 20, 0):
        monkeypatch.setattr(lexicon, "SENT_BYTES", size)
        got = lexicon.longest(rows, "id", "text", table).collect()
        assert {r.id: r.pattern for r in got} == want and all(r.category == ("b" if r.pattern == "日本" else f"c{len(r.pattern)}") for r in got)
    assert lexicon.longest(rows, "id", "text", table.limit(0)).count() == 0


def test_each_pattern_has_one_gram(spark):
    table = spark.createDataFrame([(f"shop{i:04}", "c") for i in range(3000)], "pattern string, category string")
    filed = lexicon.index(table).groupBy("gram").count().collect()
    assert sum(r["count"] for r in filed) == 3000 and max(r["count"] for r in filed) <= 20


def test_lexicon_as_table_or_list(spark):
    from pyspark.sql import functions as F

    from spendspark.operators import classify

    # No two patterns of one length stand in one text, so that the order of equals decides nothing.
    words = [("mart", "Shopping"), ("green mart", "Groceries"), ("cab", "Transport"), ("taxis", "Transport"), ("hotel", "Travel")]
    rows = [(1, "green mart", "DEBIT", "x"), (2, "smart", "DEBIT", "a hotel bill"), (3, None, "DEBIT", "by taxis"), (4, "zz", "DEBIT", "one cab"), (5, "", "CREDIT", None)]
    df = spark.createDataFrame(rows, "id long, merchant_norm string, direction string, body string").withColumn("features", F.array(F.lit("m=x")))
    memory = spark.createDataFrame([], "merchant_norm string, category string")
    out = [{r.id: (r.category, r.category_source, r.needs_review) for r in classify.classified(df, memory, classify.LinearModel(), e, F.col("body")).collect()} for e in (words, spark.createDataFrame(words, "pattern string, category string"))]
    assert out[0] == out[1] and out[0][1][0] == "Groceries" and out[0][2][0] == "Shopping" and out[0][3][0] == "Transport" and out[0][4][:2] == ("Other", "NONE")
