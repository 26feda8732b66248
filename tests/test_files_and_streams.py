import io
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import classify, dedupe
from spendspark.sources import ledger_csv
from spendspark.sources import statements as S
from spendspark.streaming import ingest

IST = "Asia/Kolkata"


def workbook(rows):
    out = io.BytesIO()
    cells = "".join(f"<row>{''.join(f'<c r="{chr(65 + i)}{n + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n + 1}"><v>{v}</v></c>' for i, v in enumerate(r) if v is not None)}</row>" for n, r in enumerate(rows))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_csv():
    assert S.csv_grid('a,"b ""q"" , c"\r\n1,\n\n" x\ny",2', ",") == [["a", 'b "q" , c'], ["1", ""], ["x\ny", "2"]]
    assert S.delimiter_of("a\tb\tc\n1\t2\t3") == "\t" and S.delimiter_of("") == "," and S.delimiter_of("x;y\n1;2,5") == ";"
    assert S.csv_grid("", ",") == [] and S.xlsx_grid(b"PK junk") is None


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Bank of X\nAccount 1234\n\nDate,Narration,Chq/Ref No,Withdrawal Amt,Deposit Amt,Closing Balance\n08/05/26,UPI/123456789012/Corner Shop/okbank,,250.00,,1000.50\n09/05/26,Salary,REF99887766,,\"1,000\",2000\nTotal,,,250,1000,\n")
    (tmp_path / "b.tsv").write_text("Txn Date\tTransaction Remarks\tAmount\tBalance\n8-May-2026\tNEFT-N12345678-Green Mart\t-99.5\t10\n")
    (tmp_path / "c.xlsx").write_bytes(workbook([["Date", "Particulars", "Amount"], [46150, "POS Book House", "75.00 Dr"], [None, "x", 5]]))
    (tmp_path / "e.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1"))
    (tmp_path / "f.csv").write_text("no,header\n1,2\n")
    rows = {(r.path.rsplit("/", 1)[1], r.row_no): r for r in S.imported(spark, str(tmp_path), IST).collect()}
    a, b, c = rows["a.csv", 0], rows["b.tsv", 0], rows["c.xlsx", 0]
    assert (a.amount_paise, a.direction, a.merchant_norm, a.ref_no, a.channel, a.balance_paise) == (25000, "DEBIT", "corner shop", "123456789012", "UPI", 100050)
    assert (rows["a.csv", 1].amount_paise, rows["a.csv", 1].direction, rows["a.csv", 1].ref_no) == (100000, "CREDIT", "REF99887766") and rows["a.csv", 2].skipped
    assert (b.amount_paise, b.direction, b.channel) == (9950, "DEBIT", "NEFT") and (c.amount_paise, c.direction, c.channel) == (7500, "DEBIT", "CARD")
    assert a.occurred_at == c.occurred_at == 1_778_221_800_000
    by = {r.path.rsplit("/", 1)[1]: r for r in S.reports(spark, str(tmp_path), IST).collect()}
    assert (by["a.csv"].n_rows, by["a.csv"].n_read, by["a.csv"].n_skipped) == (3, 2, 1) and by["c.xlsx"].n_skipped == 1
    kinds = spark.createDataFrame([(b"",), (b"PK\x03\x04",), (b"a,b",), (None,)], "c binary").select(S.kind_of(F.col("c")).alias("k")).collect()
    assert [r.k for r in kinds] == ["empty", "xlsx", "text", "empty"]
    assert "Old" in by["e.xls"].problem and "header" in by["f.csv"].problem and by["a.csv"].problem is None


def test_ledger_round_trip(spark):
    rows = [(1, 1_778_221_860_000, 12345, "DEBIT", 'Shop, "A"', "Travel", "USER", "UPI", "1234", "AB123456", None), (2, 1_778_000_000_000, 5, "CREDIT", None, "Other", "NONE", "CARD", None, None, 70000)]
    txns = spark.createDataFrame(rows, "id long, occurred_at long, amount_paise long, direction string, merchant_raw string, category string, category_source string, channel string, account_tail string, ref_no string, balance_paise long").withColumn("merchant_norm", F.col("merchant_raw"))
    text = ",".join(R.LEDGER_COLUMNS) + "\n" + "\n".join(r.line for r in ledger_csv.lines(txns, IST).orderBy("id").collect())
    grid = S.csv_grid(text, S.delimiter_of(text))
    cells = spark.createDataFrame([(grid[0], r) for r in grid[1:] + [["", "", "x"], ["2026-05-08", "", "-3.5", *[""] * 9]]], "header array<string>, cells array<string>")
    out = ledger_csv.imported(cells, IST).collect()
    for r, want in zip(out, rows):
        assert (r.occurred_at, r.amount_paise, r.direction, r.merchant_raw, r.category, r.channel, r.account_tail, r.ref_no, r.balance_paise) == (want[1] - want[1] % 60_000, *want[2:6], *want[7:11])
        assert r.exact_time and not r.skipped
    assert out[2].skipped and not out[3].exact_time and out[3].direction == "DEBIT" and out[3].amount_paise == 350


def greedy(rows):
    kept, out = [], {}
    for i, _, p, w, tail, at, ref in sorted(rows, key=lambda r: r[1]):
        drop = ref is None and any(p == q and w == v and abs(at - t) <= R.NEAR_MS and (tail is None or x is None or x == tail) for q, v, x, t in kept)
        if not drop:
            kept.append((p, w, tail, at))
        out[i] = not drop
    return out


def test_near_duplicates_equal_greedy(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(10**6), rng.choice([100, 200]), rng.choice(["DEBIT", "CREDIT"]), rng.choice([None, "1", "2"]), rng.randrange(0, 40_000_000, 7), rng.choice([None, None, None, "R"])) for i in range(600)]
    rows += [(1000, -3, 5, "DEBIT", "1", 0, None), (1001, -2, 5, "DEBIT", "1", 120_000, None), (1002, -1, 5, "DEBIT", None, 240_000, None)]
    # a chain without a gap, so that decisions go from slice to slice; and one that arrives the other way round
    rows += [(2000 + i, 10**7 + i, 7, "DEBIT", None, 170_000 * i, None) for i in range(40)] + [(3000 + i, 10**7 - i, 9, "DEBIT", "1", 170_000 * i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, seq long, amount_paise long, direction string, account_tail string, occurred_at long, ref_no string")
    got = {r.id: r.kept for r in dedupe.near_duplicates(df).collect()}
    assert got == greedy(rows) and got[1000] and not got[1001] and got[1002]


def test_streams(spark, tmp_path):
    came = 1_752_294_600_000
    src, msgs = str(tmp_path / "in"), [("VM-HDFCBK", f"Rs {p} debited from A/c XX1111 to SHOP", came + s) for p, s in ((5, 0), (5, 1000), (7, 2000))] + [("VM-HDFCBK", "Rs 5 debited from A/c XX1111 to SHOP", came)]
    spark.createDataFrame(msgs, "sender string, body string, received_at long").coalesce(1).write.json(src)
    stream = spark.readStream.schema("sender string, body string, received_at long").json(src)
    q = ingest.recompute(ingest.ledger_stream(stream, IST), lambda t: t.groupBy("direction").agg(F.sum("amount_paise").alias("total")), str(tmp_path / "store"), str(tmp_path / "answers"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert [tuple(r) for r in ingest.latest(spark, str(tmp_path / "answers")).collect()] == [("DEBIT", 1200)]
    rows = [(i, 100, "DEBIT", tail, came + at, ref) for i, tail, at, ref in ((1, None, 0, None), (2, "1", 120_000, None), (3, "1", 240_000, None), (4, "1", 241_000, "R"))]
    spark.createDataFrame(rows, "id long, amount_paise long, direction string, account_tail string, occurred_at long, ref_no string").coalesce(1).write.parquet(str(tmp_path / "tx"))
    t = spark.readStream.schema("id long, amount_paise long, direction string, account_tail string, occurred_at long, ref_no string").parquet(str(tmp_path / "tx"))
    t = t.withColumn("event_time", F.timestamp_millis("occurred_at")).withWatermark("event_time", "1 hour")
    q = ingest.near_distinct(t).writeStream.format("parquet").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert {r.id: r.kept for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {1: True, 2: False, 3: True, 4: True}
    parts = spark.createDataFrame([("a", 1, 2, "World", 5), ("a", 1, 1, "Hello ", 4), ("b", 1, 1, "x", 1)], "sender string, batch int, seq int, text string, received_at long")
    assert {r.sender: r.body for r in ingest.assembled(parts).collect()} == {"a": "Hello World", "b": "x"}


def test_model(spark):
    rows = spark.createDataFrame([(i, m, "UPI", 5000, 0, c) for i, (m, c) in enumerate([("green mart", "Groceries"), ("city cinema", "Entertainment")] * 12)], "id long, m string, channel string, p long, at long, category string")
    rows = rows.select("id", "category", F.col("m").alias("merchant_norm"), F.lit("DEBIT").alias("direction"), classify.features(F.col("m"), F.lit(None).cast("string"), F.col("channel"), F.col("p"), F.col("at"), IST).alias("features"))
    model = classify.retrained(rows)
    assert model.steps == 12 * 24 and classify.LinearModel.from_bytes(model.to_bytes()).steps == model.steps
    assert classify.LinearModel.from_bytes(b"x") is None and classify.LinearModel.from_bytes(None) is None and len(model.to_bytes()) == 983_124
    out = classify.scored(rows, model).collect()
    assert all(r.model_category == r.category and r.model_p > 0.5 for r in out)
    norm = classify.vectors(rows.where("id = 0"), "id").agg(F.sum(F.col("val") * F.col("val"))).first()[0]
    assert abs(norm - 1) < 1e-9
    fresh = rows.where("id = 1").withColumn("category", F.lit("Travel"))
    before = model.steps
    assert classify.learned(model, fresh, rows).steps == before + 5 + 23
    memory = spark.createDataFrame([("green mart", "Health")], "merchant_norm string, category string")
    got = classify.classified(rows.drop("category"), memory, classify.LinearModel(), [("cinema", "Entertainment")]).collect()
    assert {(r.merchant_norm, r.category, r.category_source) for r in got} == {("green mart", "Health", "MEMORY"), ("city cinema", "Entertainment", "SEED")}
    h = spark.range(1).select(classify.fnv1a(F.lit("m=swiggy")).alias("h")).first().h
    assert (h, h & 16383, h >> 17 & 1) == (1041537389, 6509, 0)
    empty = classify.LinearModel()
    empty.step(np.array([], dtype=int), np.array([]), 0, 0.1)
    assert empty.steps == 0 and X is not None
