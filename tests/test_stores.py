"""Stores that grow batch by batch: what a batch reads of them, how many files they keep, versions of what was learned."""

import random

from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.operators import classify, ingest, ledger
from spendspark.streaming import ingest as streams
from spendspark.streaming.parts import Parts, _children

IST, NOON = "Asia/Kolkata", 1_752_301_800_000


def test_parts_are_merged_and_bounded(spark, tmp_path):
    folder = str(tmp_path / "p")
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").cast("long").alias("n"))
    parts, want, seen = Parts(spark, folder, "k string, n long", total, merge=3), {}, {}
    for number in range(14):
        own = [(f"k{number % 2}", number), ("all", 1)]
        parts.put(spark.createDataFrame(own, "k string, n long").coalesce(1), number)
        for k, n in own:
            want[k] = want.get(k, 0) + n
        seen[number] = dict(want)
        assert {r.k: r.n for r in total(parts.read(number + 1)).collect()} == want
        assert len(_children(spark, f"{folder}/parts", "batch")) <= 7 and len(_children(spark, f"{folder}/totals", "upto")) <= 2
    # the last batch again, as after a failure: it sees what was before it, and is counted once
    assert {r.k: r.n for r in total(parts.read(13)).collect()} == seen[12]
    parts.put(spark.createDataFrame([("k1", 13), ("all", 1)], "k string, n long"), 13)
    assert {r.k: r.n for r in total(parts.read(14)).collect()} == want


def test_a_batch_reads_its_days_and_buckets(spark, tmp_path):
    folder = str(tmp_path / "s")
    day = lambda k: NOON + k * R.DAY_MS
    rows = [(i, f"f{i}", day(i)) for i in range(40)]
    raw = spark.createDataFrame(rows, "id long, fingerprint string, received_at long").withColumns({"stored_day": ingest.stored_day(F.col("received_at")), "batch": F.lit(0)})
    raw.write.partitionBy("stored_day", "batch").parquet(folder)
    stored = streams.stored(spark, folder, "id long, fingerprint string, received_at long", 1)
    some = ingest._of_days(stored, spark.createDataFrame([(day(3),), (day(9),)], "received_at long"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "stored_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.id for r in some.collect()) == [3, 9] and sorted(some.select(F.input_file_name()).distinct().count() for _ in [0]) == [2]
    assert streams.stored(spark, folder, "id long, fingerprint string, received_at long", 0).count() == 0
    refs = Parts(spark, str(tmp_path / "r"), streams._REFS, lambda r: r.distinct().repartition("ref_bucket"), by=["ref_bucket"], merge=2)
    for number in range(3):
        refs.put(spark.createDataFrame([(f"REF{i}",) for i in range(number * 50, number * 50 + 50)], "ref_no string").withColumn("ref_bucket", ingest.ref_bucket(F.col("ref_no"))), number)
    one = refs.read(3).where(F.col("ref_bucket").isin([5, 6]))
    assert "ref_bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert refs.read(3).count() == 150


def test_messages_meet_their_own_days(spark, tmp_path):
    """A message of last month still meets its day, near ones over midnight, and a reference of any day."""
    src, folder = tmp_path / "in", str(tmp_path / "ledger")
    body = lambda p, extra="": f"Rs {p} debited from A/c XX1111 to SHOP{extra}"
    midnight = 1_752_192_000_000
    schema = "source string, sender string, body string, received_at long"
    batches = [
        [("VM-HDFCBK", body(5), NOON), ("VM-HDFCBK", body(8), midnight - 30_000), ("VM-HDFCBK", body(6, ". Ref AB123456"), NOON)],
        [("VM-HDFCBK", body(9), NOON + 35 * R.DAY_MS)],
        [("AD-PAYTMB", body(5), NOON + 60_000), ("AD-PAYTMB", body(8), midnight + 40_000), ("AD-PAYTMB", body(6, " on UPI Ref AB123456"), NOON + 50 * R.DAY_MS), ("VM-HDFCBK", body(5), NOON), ("VM-HDFCBK", body(5), NOON + R.DAY_MS)],
    ]
    for rows in batches:
        spark.createDataFrame([("SMS", *r) for r in rows], schema).coalesce(1).write.mode("append").json(str(src))
        streams.live(spark.readStream.schema(schema).json(str(src)), folder, IST, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    txns = spark.read.parquet(f"{folder}/txns").collect()
    assert sorted((r.amount_paise, r.occurred_at) for r in txns) == [(500, NOON), (500, NOON + R.DAY_MS), (600, NOON), (800, midnight - 30_000), (900, NOON + 35 * R.DAY_MS)]
    assert spark.read.parquet(f"{folder}/raw").count() == 8


def told(spark):
    rows = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate([("green mart", "Groceries"), ("city cinema", "Entertainment"), (" ", "Cash")] * 8)], "id long, merchant_norm string, category string")
    return rows.select("id", "merchant_norm", "category", F.lit("USER").alias("category_source"), classify.features(F.col("merchant_norm"), F.lit(None).cast("string"), F.lit("UPI"), F.lit(5000).cast("bigint"), F.lit(0).cast("bigint"), IST).alias("features")).cache()


def test_memory_and_model_are_one_version(spark, tmp_path):
    folder, rows = str(tmp_path / "state"), told(spark)
    fixes = lambda *r: spark.createDataFrame(r, "id long, category string, at long")
    one, two = fixes((0, "Travel", 5), (3, "Groceries", 6), (1, "Health", 5), (2, "Cash", 5), (6, "No such", 9)), fixes((9, "Shopping", 7), (0, "Travel", 3))
    streams.learn(one, rows, folder, 0)
    first = {r.merchant_norm: (r.category, r.confirmations, r.updated_at) for r in streams.knowledge(spark, folder)[0].collect()}
    assert first == {"green mart": ("Groceries", 2, 6), "city cinema": ("Health", 1, 5)}
    steps = streams.knowledge(spark, folder)[1].steps
    for _ in range(2):  # once more, as after a failure
        streams.learn(two, rows, folder, 1)
        memory, model, number = streams.knowledge(spark, folder)
        assert {r.merchant_norm: (r.category, r.confirmations, r.updated_at) for r in memory.collect()} == {"green mart": ("Shopping", 4, 7), "city cinema": ("Health", 1, 5)}
        assert number == 1 and model.steps > steps
    # a version whose model was not written is not there: memory is that of the version before
    streams._memory(spark, folder).put(ledger.confirmations(spark.createDataFrame([(1, "city cinema", "Cash", 9)], "id long, merchant_norm string, category string, at long")), 2)
    assert {r.merchant_norm: r.confirmations for r in streams.knowledge(spark, folder)[0].collect()} == {"green mart": 4, "city cinema": 1}
    know = ingest.Knowledge(memory=streams.knowledge(spark, folder)[0], model=model)
    assert random and know.memory.count() == 2


def test_hash_is_of_utf16_code_units(spark):
    def fnv(text):
        h, raw = R.FNV_OFFSET, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ (raw[i] | raw[i + 1] << 8)) * R.FNV_PRIME & 0xFFFFFFFF
        return h

    texts = ["", "m=swiggy", "é", "日本", "m=🍕 hut", "a𝒳b🍕", "￿"]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {t: fnv(t) for t in texts}


def test_equal_times_of_decisions(spark):
    txns = spark.createDataFrame([(1, "a", "Other", "NONE", 0.0, True), (2, "a", "Other", "NONE", 0.0, True), (3, "a", "Other", "NONE", 0.0, True)], "id long, merchant_norm string, category string, category_source string, confidence double, needs_review boolean")
    fixes = spark.createDataFrame([(1, "Travel", True, 5), (2, "Cash", True, 5)], "id long, category string, everywhere boolean, at long")
    for df in (fixes, fixes.orderBy("id", ascending=False).repartition(2)):
        assert {r.id: r.category for r in ledger.confirmed(txns, df).collect()} == {1: "Travel", 2: "Cash", 3: "Cash"}
        assert [r.category for r in ledger.remembered(txns, df).collect()] == ["Cash"]
