"""The fold over rows of all kinds against one that looks at everything that was kept, and what cuts an amount's history."""

import random
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import dedupe, ingest

IST = "Asia/Kolkata"
ROWS = "id long, seq long, kind string, run long, amount_paise long, direction string, account_tail string, occurred_at long"


def day_of(ms):
    return datetime.fromtimestamp(ms / 1000, ZoneInfo(IST)).date()


def brute(rows):
    """id to (kept, occurrence)."""
    held, seen, out = [], {}, {}
    for i, _, kind, run, paise, way, tail, at in sorted(rows, key=lambda r: (r[1], r[0])):
        fits = [t for p, w, x, t in held if (p, w) == (paise, way) and (tail is None or x is None or x == tail)]
        stays, number = True, None
        if kind == dedupe.EXACT:
            stays = not any(abs(t - at) <= R.NEAR_MS for t in fits)
        elif kind == dedupe.DAILY:
            key = run, day_of(at), paise, way, tail
            number = seen[key] = seen.get(key, 0) + 1
            stays = sum(day_of(t) == day_of(at) for t in fits) < number
        if stays:
            held.append((paise, way, tail, at))
        out[i] = stays, number
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("day", X.local_day(F.col("occurred_at"), IST))
    return {r.id: (r.kept, r.occurrence) for r in dedupe.greedy(df).collect()}


def test_rows_of_all_kinds_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    midnight = 1_752_258_600_000  # of a day in IST
    for case in range(30):
        dense = case % 3
        for _ in range(40):
            day = rng.randrange(3)
            noon = midnight + day * R.DAY_MS + R.DAY_MS // 2
            near = midnight + day * R.DAY_MS + rng.choice([rng.randrange(0, R.DAY_MS, 60_000), rng.randrange(-400_000, 400_000, 20_000), R.DAY_MS // 2 + rng.randrange(-300_000, 300_000, 30_000)] if dense else [rng.randrange(0, R.DAY_MS, 1000)])
            kind = rng.choice([dedupe.PINNED, dedupe.EXACT, dedupe.EXACT, dedupe.DAILY] if case % 2 else [dedupe.PINNED, dedupe.EXACT, dedupe.EXACT])
            at = noon if kind == dedupe.DAILY else rng.choice([near, near, noon]) if kind == dedupe.PINNED else near
            rows.append((len(rows), rng.randrange(10**6), kind, rng.randrange(2), case, rng.choice(["DEBIT", "CREDIT"]) if case > 20 else "DEBIT", rng.choice([None, "1", "2"]), at))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_a_mere_day_does_not_hide_a_time(spark):
    """Of a day's row and a later one of 18:00 both stay; a time first, the day is known."""
    noon = 1_752_301_800_000
    evening = noon + 6 * 3_600_000
    assert run(spark, [(1, 1, dedupe.DAILY, 0, 5, "DEBIT", None, noon), (2, 2, dedupe.EXACT, 0, 5, "DEBIT", None, evening)]) == {1: (True, 1), 2: (True, None)}
    assert run(spark, [(1, 2, dedupe.DAILY, 0, 5, "DEBIT", None, noon), (2, 1, dedupe.EXACT, 0, 5, "DEBIT", None, evening)]) == {1: (False, 1), 2: (True, None)}
    fields = {"channel": "UPI", "balance_paise": None, "merchant_raw": "Shop", "merchant_norm": "shop", "vpa_handle": None, "ref_no": None, "account_tail": None}
    lines = [(1, "LEDGER_CSV", "f.csv", "a", False, 500, "DEBIT", noon), (2, "LEDGER_CSV", "f.csv", "b", True, 500, "DEBIT", evening), (3, "LEDGER_CSV", "f.csv", "c", True, 500, "DEBIT", evening + 60_000), (4, "LEDGER_CSV", "f.csv", "d", False, 500, "DEBIT", noon)]
    records = spark.createDataFrame(lines, "id long, source string, origin string, raw_line string, exact_time boolean, amount_paise long, direction string, occurred_at long")
    records = records.withColumns({k: F.lit(v).cast("long" if k == "balance_paise" else "string") for k, v in fields.items()})
    raw = spark.createDataFrame([], "id long, fingerprint string")
    store = spark.createDataFrame([], "id long, ref_no string, occurred_at long, amount_paise long, direction string, account_tail string")
    out = ingest.records_in(records, raw, store, IST)
    assert {r.id: r.outcome for r in out.outcomes.collect()} == {1: "inserted", 2: "inserted", 3: "duplicate transaction", 4: "duplicate transaction"}


def test_rows_that_equal_no_other(spark):
    rows = [(i, i, k, 0, p, w, None, at) for i, (k, p, w, at) in enumerate([(k, p, w, at) for k in (dedupe.EXACT, dedupe.DAILY) for p, w, at in ((None, "DEBIT", 5), (5, None, 5), (5, "DEBIT", None)) for _ in range(2)])]
    assert {i: kept for i, (kept, _) in run(spark, rows).items()} == {i: True for i in range(12)}


def test_a_frequent_amount_is_many_chains(spark):
    """40,000 rows of one amount in 30 days: one pass, and no chain beyond a small part of them."""
    rng = random.Random(5)
    rows = [(i, i, dedupe.EXACT, 0, 100, "DEBIT", rng.choice([None, "1", "2"]), rng.randrange(30 * R.DAY_MS)) for i in range(40_000)]
    df = spark.createDataFrame(rows, ROWS).withColumn("day", X.local_day(F.col("occurred_at"), IST))
    sizes = [r["count"] for r in dedupe.chains(df, R.NEAR_MS).groupBy("chain_day", "chain").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 400 and len(sizes) > 1000
    judged = dedupe.greedy(df)
    assert judged._jdf.queryExecution().toString().count("MapInArrow") and sum(r.kept for r in judged.collect()) == sum(k for k, _ in brute_sorted(rows).values())


def brute_sorted(rows):
    """As ``brute`` for exact rows of one amount, looking only at kept rows nearby."""
    held, out = {}, {}
    for i, _, _, _, _, _, tail, at in rows:
        near = [x for c in (-1, 0, 1) for x in held.get(at // R.NEAR_MS + c, [])]
        stays = not any(abs(t - at) <= R.NEAR_MS and (tail is None or x is None or x == tail) for t, x in near)
        if stays:
            held.setdefault(at // R.NEAR_MS, []).append((at, tail))
        out[i] = stays, None
    return out


def test_chains_over_many_midnights(spark):
    """An unbroken chain over five days is one chain; a gap makes two; a day's row joins its day."""
    base = 1_752_258_600_000
    unbroken = [(i, i, dedupe.PINNED, 0, 1, "DEBIT", None, base + i * 170_000) for i in range(5 * R.DAY_MS // 170_000)]
    broken = [(10**6 + i, i, dedupe.PINNED, 0, 2, "DEBIT", None, base + i * 170_000 + (100_000 if i > 1000 else 0)) for i in range(2000)]
    daily = [(2 * 10**6 + i, i, dedupe.DAILY, 0, 3, "DEBIT", None, base + i * R.DAY_MS + R.DAY_MS // 2) for i in range(9)]
    df = spark.createDataFrame(unbroken + broken + daily, ROWS).withColumn("day", X.local_day(F.col("occurred_at"), IST))
    n = {r.amount_paise: r.n for r in dedupe.chains(df, R.NEAR_MS).groupBy("amount_paise").agg(F.count_distinct("chain_day", "chain").alias("n")).collect()}
    assert n == {1: 1, 2: 2, 3: 9}


def test_streams_equal_the_fold(spark, tmp_path):
    """Rows in several micro-batches, times out of order within the watermark: the same rows are kept as in one batch."""
    from spendspark.streaming import ingest as streams

    rng, schema = random.Random(3), "id long, amount_paise long, direction string, account_tail string, occurred_at long, ref_no string"
    base = 1_752_301_800_000
    rows = [(i, rng.choice([100, 200]), rng.choice(["DEBIT", "CREDIT"]), rng.choice([None, "1", "2"]), base + i * 20_000 + rng.randrange(-600_000, 600_000), rng.choice([None, None, None, f"R{i}"])) for i in range(400)]
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(src)
        t = spark.readStream.schema(schema).parquet(src).withColumn("event_time", F.timestamp_millis("occurred_at")).withWatermark("event_time", "1 hour")
        q = streams.near_distinct(t).writeStream.format("parquet").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.id: r.kept for r in spark.read.parquet(str(tmp_path / "kept")).collect()}
    want = brute([(i, i, dedupe.EXACT if ref is None else dedupe.PINNED, 0, p, w, tail, at) for i, p, w, tail, at, ref in rows])
    assert got == {i: k for i, (k, _) in want.items()} and not all(got.values())
