"""Ledger tables: same-day rows against a brute-force fold, files in and out, corrections, batches and streams over a store."""

import random

import pytest
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import classify, dedupe, ingest, ledger, parse, spend
from spendspark.sources import ledger_csv
from spendspark.streaming import ingest as streams

IST, NOON = "Asia/Kolkata", 1_752_301_800_000


def same_day(file, store):
    """(id, day, paise, way, tail, ref) in file order against (day, paise, way, tail): what is kept, with its number."""
    stored, seen, out = [tuple(s) for s in store], {}, {}
    for i, day, paise, way, tail, ref in sorted(file):
        number = None
        if ref is None:
            number = seen[day, paise, way, tail] = seen.get((day, paise, way, tail), 0) + 1
            if sum(s[:3] == (day, paise, way) and (tail is None or s[3] is None or s[3] == tail) for s in stored) >= number:
                continue
        stored.append((day, paise, way, tail))
        out[i] = number
    return out


def test_same_day_rows_count_what_the_run_kept(spark):
    schema, key = "id long, day string, amount_paise long, direction string, account_tail string, ref_no string", ["day", "amount_paise", "direction", "account_tail"]
    cases = [([(1, "d", 5, "DEBIT", None, None), (2, "d", 5, "DEBIT", "1", None)], [], {1: 1})]
    cases += [([(i, "d", 5, "DEBIT", "1", None) for i in range(3)], [("d", 5, "DEBIT", "1")] * n, want) for n, want in ((0, {0: 1, 1: 2, 2: 3}), (3, {}), (2, {2: 3}))]
    rng = random.Random(3)
    for _ in range(12):
        file = [(i, rng.choice("de"), rng.choice([5, 6]), "DEBIT", rng.choice([None, "1", "2"]), rng.choice([None, None, None, "R"])) for i in range(60)]
        store = [(rng.choice("de"), rng.choice([5, 6]), "DEBIT", rng.choice([None, "1", "2"])) for _ in range(rng.randint(0, 25))]
        cases.append((file, store, same_day(file, store)))
    # Cases side by side, told apart by the day.
    files = [(1000 * k + i, f"{k}{day}", *rest) for k, (file, _, _) in enumerate(cases) for i, day, *rest in file]
    stores = [(f"{k}{day}", *rest) for k, (_, store, _) in enumerate(cases) for day, *rest in store]
    rows = spark.createDataFrame(files, schema)
    got = dedupe.same_day_new(rows, spark.createDataFrame(stores, "day string, amount_paise long, direction string, account_tail string"))
    assert got.columns == [*rows.columns, "occurrence"]
    assert {r.id: r.occurrence for r in got.collect()} == {1000 * k + i: n for k, (*_, want) in enumerate(cases) for i, n in want.items()} and key


def test_keys_and_fingerprints(spark):
    cases = {
        "Swiggy Limited India Bangalore": "swiggy", "Acme Ltd Inc India Chennai": "acme", "foo pvt ltd india": "foo", "foo pvt. ltd limited": "foo pvt.", "foo pvt. ltd co ltd": "foo", "foo pvt. ltd private limited": "foo",
        "Mr. Tailor": "mr. tailor", "MR": "mr", "india": "india", "limited india": "limited", "ltd 999": "ltd", "9876543210@ybl": "9876543210", "a  b": "a b",
    }
    out = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.merchant_key(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in out} == cases
    rows = [(None, "x", 5), ("x", None, 5), ("", "x", 5), (" X ", " ", 6), ("x", "", R.DAY_MS)]
    prints = [r.p for r in spark.createDataFrame(rows, "s string, b string, at long").select(parse.fingerprint(F.col("s"), F.col("b"), F.col("at")).alias("p")).collect()]
    assert prints[0] == prints[2] and prints[1] == prints[3] and len(set(prints)) == 3


@pytest.mark.parametrize(
    "function, cases",
    [
        (X.money, {0: "₹0", 149: "₹1", 150: "₹2", -150: "-₹1", 12_345_600: "₹1,23,456", 100_000_000_00: "₹10,00,00,000", -99: "-₹1", -49: "₹0"}),
        (X.exact_money, {5: "₹0.05", 12_345_678: "₹1,23,456.78", -100_050: "-₹1,000.50"}),
        (X.category_at, {0: "Food & Dining", 14: "Other", 15: "Other", -1: "Other"}),
        (lambda c: X.shown_time(c, IST), {NOON: "12 Jul, 12:00 PM"}),
    ],
)
def test_display(spark, function, cases):
    out = spark.createDataFrame([(k,) for k in cases], "v long").select("v", function(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in out} == cases


def test_summaries_and_places(spark):
    df = spark.createDataFrame([(None, 3, 1, 2, 6, "HIGH", 1.5), ("No data rows", 0, 0, 0, 0, "LOW", 1.5), (None, 0, 0, 0, 0, "HIGH", None)], "p string, a int, b int, c int, d int, conf string, lat double")
    c = F.col
    out = df.select(X.import_summary("statement", c("p"), c("a"), c("b"), c("c"), c("d")).alias("s"), X.backfill_summary(c("d"), c("a"), c("b"), c("c")).alias("b"), ledger.shown_place(c("conf"), c("lat"), c("lat")).alias("at")).collect()
    assert out[0].s == "Imported 3 · 1 already known · 2 skipped, from 6 rows" and out[1].s == "Couldn't read the statement: No data rows" and out[0].b == "Scanned 6 · imported 3 · 1 duplicates · 2 not transactions"
    assert [r["at"] is not None for r in out] == [True, False, False]


def test_ledger_files(spark, tmp_path):
    rows = [(i, NOON + 60_000 * (50 - i), 100 + i, "DEBIT", f"Shop {i}", "Travel") for i in range(50)]
    txns = spark.createDataFrame(rows, "id long, occurred_at long, amount_paise long, direction string, merchant_raw string, category string").withColumns({"merchant_norm": F.lower("merchant_raw"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    ledger_csv.export(txns.repartition(5), IST, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0] == ",".join(R.LEDGER_COLUMNS) and [x.split(",")[3] for x in text.splitlines()[1:]] == [f"Shop {i}" for i in range(49, -1, -1)]
    (tmp_path / "in").mkdir()
    for name, body in {"good.csv": text, "extra.csv": "note,Amount_INR,occurred_at\nx,-3.50,2026-05-08\ny,,2026-05-08\n", "one.csv": "occurred_at,amount_inr\n", "no_time.csv": "amount_inr,x\n1,2\n", "no_amount.csv": "occurred_at,x\n1,2\n", "none.csv": " \n\t"}.items():
        (tmp_path / "in" / name).write_text(body)
    read, reports = ledger_csv.read(spark, str(tmp_path / "in"), IST)
    by = {r.path.rsplit("/", 1)[1]: (r.n_rows, r.n_skipped, r.problem) for r in reports.collect()}
    assert by == {"good.csv": (50, 0, None), "extra.csv": (2, 1, None), "one.csv": (0, 0, "No data rows"), "no_time.csv": (0, 0, "Missing 'occurred_at' column"), "no_amount.csv": (0, 0, "Missing 'amount_inr' column"), "none.csv": (0, 0, "File is empty")}
    good = {r.merchant_raw: r for r in read.where("path LIKE '%good.csv'").collect()}
    assert all(good[f"Shop {i}"].occurred_at == r[1] and good[f"Shop {i}"].amount_paise == r[2] for i, r in enumerate(rows))


def empty(spark):
    raw = spark.createDataFrame([], "id long, source string, sender string, body string, received_at long, fingerprint string, parsed boolean, reject_reason string, parser_version int")
    return raw, spark.createDataFrame([], "id long, ref_no string, occurred_at long, amount_paise long, direction string, account_tail string")


def test_batches_over_a_store(spark):
    text = lambda p, tail="1111", extra="": f"Rs {p} debited from A/c XX{tail} to SHOP{extra}"
    came = [("VM-HDFCBK", text(5), 0), ("VM-HDFCBK", text(5), 1000), ("AD-PAYTMB", text(5), 60_000), ("VM-HDFCBK", text(5, "2222"), 61_000), ("VM-HDFCBK", text(6, extra=". Ref AB123456"), 0), ("AD-PAYTMB", text(6, extra=" on UPI Ref AB123456"), 9_000_000), ("9876543210", text(7), 0), ("VM-HDFCBK", "hello", 0), (None, text(8), 0)]
    messages = spark.createDataFrame([(i, "SMS", s, b, NOON + at) for i, (s, b, at) in enumerate(came)], "id long, source string, sender string, body string, received_at long")
    know = ingest.Knowledge(memory=spark.createDataFrame([("shop", "Travel")], "merchant_norm string, category string"), fixes=spark.createDataFrame([(NOON - 50_000, "home")], "recorded_at long, place string"))
    out = ingest.messages_in(messages, *empty(spark), IST, know)
    got = {r.id: (r.outcome, r.reason) for r in out.outcomes.collect()}
    assert got == {0: ("inserted", None), 1: ("duplicate message", None), 2: ("duplicate transaction", None), 3: ("inserted", None), 4: ("inserted", None), 5: ("duplicate transaction", None), 6: ("rejected", "personal sender"), 7: ("rejected", "no amount"), 8: ("inserted", None)}
    assert tuple(ingest.counted(out.outcomes).first()) == (9, 4, 3, 2)
    raw = {r.id: (r.parsed, r.reject_reason, r.parser_version) for r in out.raw.collect()}
    assert raw == {0: (True, None, 1), 2: (False, "duplicate txn", 1), 3: (True, None, 1), 4: (True, None, 1), 5: (False, "duplicate txn", 1), 7: (False, "no amount", 1), 8: (True, None, 1)}
    txns = out.txns.collect()
    assert {(r.category, r.category_source, r.place, r.loc_confidence) for r in txns} == {("Travel", "MEMORY", "home", "HIGH")} and {r.raw_id for r in txns} == {0, 3, 4, 8}
    # the same again adds nothing; rows of a file are told by their day, presets stay
    assert ingest.messages_in(messages.where("sender <> '9876543210'"), out.raw, out.txns, IST).txns.count() == 0
    lines = [(100, "a", 500, "1111", None, None), (101, "b", 500, "1111", None, None), (102, "c", 600, None, "AB123456", None), (103, "d", 900, None, None, "Health"), (103 + 1, "d", 900, None, None, "Health")]
    fields = {"direction": "DEBIT", "channel": "UPI", "balance_paise": None, "merchant_raw": "Shop", "merchant_norm": "shop", "vpa_handle": None}
    records = spark.createDataFrame([(i, "STATEMENT", "f.csv", line, False, paise, tail, ref, NOON, preset, "USER") for i, line, paise, tail, ref, preset in lines], "id long, source string, origin string, raw_line string, exact_time boolean, amount_paise long, account_tail string, ref_no string, occurred_at long, preset_category string, preset_source string")
    records = records.withColumns({k: F.lit(v).cast("long" if k == "balance_paise" else "string") for k, v in fields.items()})
    filed = ingest.records_in(records, out.raw, out.txns, IST, know)
    assert {r.id: r.outcome for r in filed.outcomes.collect()} == {100: "duplicate transaction", 101: "inserted", 102: "duplicate transaction", 103: "inserted", 104: "duplicate message"}
    assert {r.id: (r.category, r.category_source, r.confidence, r.loc_confidence) for r in filed.txns.collect()} == {101: ("Travel", "MEMORY", 1.0, "NONE"), 103: ("Health", "USER", 1.0, "NONE")}
    # rebuilt from messages alone, rows of files are gone
    all_raw, again = ingest.rebuilt(out.raw.unionByName(filed.raw), IST, know)
    assert {r.id for r in again.collect()} == {0, 3, 4, 8} and all_raw.where("source = 'STATEMENT'").count() == 0


def test_tables_as_new_versions(spark):
    txns = spark.createDataFrame([(1, "shop", "Other", "NONE", 0.0, True), (2, "shop", "Health", "USER", 1.0, False), (3, "shop", "Other", "SEED", 0.45, True), (4, None, "Other", "NONE", 0.0, True)], "id long, merchant_norm string, category string, category_source string, confidence double, needs_review boolean")
    fixes = spark.createDataFrame([(1, "Travel", True, 5), (4, "Cash", True, 6), (1, "Rent & Housing", False, 7)], "id long, category string, everywhere boolean, at long")
    assert {r.id: tuple(r)[2:] for r in ledger.confirmed(txns, fixes).collect()} == {1: ("Rent & Housing", "USER", 1.0, False), 2: ("Health", "USER", 1.0, False), 3: ("Travel", "MEMORY", 1.0, False), 4: ("Cash", "USER", 1.0, False)}
    memory = ledger.remembered(txns, fixes)
    assert [tuple(r) for r in memory.collect()] == [("shop", "Rent & Housing", 7)]
    assert ledger.forgotten(memory, txns).count() == 0 and ledger.forgotten(memory, txns.limit(0)).count() == 1
    ids = ledger.with_client_ids(txns).select("client_id").collect()
    assert len({r[0] for r in ids}) == 4 and all(len(r[0]) == 32 for r in ids)
    assert [r.id for r in ledger.ordered(txns.withColumn("occurred_at", -F.col("id")), "occurred_at").collect()] == [4, 3, 2, 1]
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.id == r.v + 1 for r in ledger.numbered(many, ["v"]).collect()) and ledger.numbered(many.limit(0), ["v"]).count() == 0
    assert classify.model_figures(classify.LinearModel()) == {"steps": 0, "trusted": False, "bytes": 983_040}


def test_places_over_days(spark):
    rng = random.Random(4)
    at = lambda: rng.randrange(0, 6 * R.DAY_MS, 3_600_000)
    txns, fixes = [(i, rng.randrange(3), at()) for i in range(80)], [(rng.randrange(2), at(), f"p{i}") for i in range(25)]
    out = spend.located(spark.createDataFrame(txns, "id long, user_id long, occurred_at long"), spark.createDataFrame(fixes, "user_id long, recorded_at long, place string"))
    for r in out.collect():
        _, user, t = txns[r.id]
        best = max(((f[1], f[2]) for f in fixes if f[0] == user and f[1] <= t), default=None)
        assert (r.age_ms, r.place) == ((t - best[0], best[1]) if best else (None, None))


def test_live_tables_meet_late_messages(spark, tmp_path):
    src, folder = tmp_path / "in", str(tmp_path / "ledger")
    body = lambda p: f"Rs {p} debited from A/c XX1111 to SHOP"
    schema = "source string, sender string, body string, received_at long"
    go = lambda: streams.live(spark.readStream.schema(schema).json(str(src)), folder, IST, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    for rows in ([("SMS", "VM-HDFCBK", body(5), NOON), ("SMS", "VM-HDFCBK", body(6), NOON + 40 * R.DAY_MS)], [("SMS", "AD-PAYTMB", body(5), NOON + 60_000), ("SMS", "AD-PAYTMB", body(7), NOON)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        go()
    txns = spark.read.parquet(f"{folder}/txns")
    assert sorted(r.amount_paise for r in txns.collect()) == [500, 600, 700] and spark.read.parquet(f"{folder}/raw").count() == 4


def test_partial_answers_and_learning(spark, tmp_path):
    src = str(tmp_path / "in")
    total = lambda rows: rows.groupBy("direction").agg(F.sum("amount_paise").alias("amount_paise"))
    for k in (1, 2):
        spark.createDataFrame([(k, "DEBIT", 100 * k)], "id long, direction string, amount_paise long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, direction string, amount_paise long").parquet(src)
        streams.recompute(stream, total, str(tmp_path / "store"), str(tmp_path / "answers"), str(tmp_path / "cp"), part=total).trigger(availableNow=True).start().awaitTermination(100)
    assert [tuple(r) for r in streams.latest(spark, str(tmp_path / "answers")).collect()] == [("DEBIT", 300)]
    rows = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate([("green mart", "Groceries"), ("city cinema", "Entertainment")] * 12)], "id long, m string, category string")
    rows = rows.select("id", "category", F.lit("USER").alias("category_source"), classify.features(F.col("m"), F.lit(None).cast("string"), F.lit("UPI"), F.lit(5000).cast("bigint"), F.lit(0).cast("bigint"), IST).alias("features")).cache()
    for k in (0, 1):
        spark.createDataFrame([(k, "Travel")], "id long, category string").coalesce(1).write.mode("append").parquet(str(tmp_path / "fix"))
        fixes = spark.readStream.schema("id long, category string").parquet(str(tmp_path / "fix"))
        streams.learning(fixes, lambda: rows, str(tmp_path / "model"), str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination(100)
    steps = [classify.LinearModel.from_bytes(bytes(r.blob)).steps for r in spark.read.parquet(str(tmp_path / "model")).orderBy("number").collect()]
    assert steps == [5 + 23, 2 * (5 + 23)]


def test_answers_are_rolled_up_without_new_rows(spark, tmp_path):
    import time

    spark.createDataFrame([(1, 0)], "id long, occurred_at long").write.parquet(str(tmp_path / "store" / "rows" / "batch=0"))
    ask = lambda rows, now: rows.agg(F.count("*").alias("n"), F.lit(now).alias("now"))
    q = streams.rolled_up(spark, ask, str(tmp_path / "store"), str(tmp_path / "answers"), str(tmp_path / "cp"), "1 second").start()
    deadline = time.time() + 60
    while time.time() < deadline and not list((tmp_path / "answers").glob("batch=*/_SUCCESS")):
        time.sleep(0.5)
    q.stop()
    last = streams.latest(spark, str(tmp_path / "answers")).first()
    assert last.n == 1 and abs(last.now - time.time() * 1000) < 120_000
