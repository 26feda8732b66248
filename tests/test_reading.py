"""Files are read once, in batches of bounded size."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from spendspark.functions import text as X
from spendspark.operators import ingest, ledger
from spendspark.sources import ledger_csv, records
from spendspark.sources import statements as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grids_leave_in_small_batches():
    one = "\n".join(",".join(str(k) for k in range(10)) for _ in range(100)).encode()
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(200)], "content": [one] * 198 + [b"PK\x03\x04junk", None]})
    out = list(S._reader(["path"])(iter([batch])))
    cells = [len(b["grid"].flatten().flatten()) for b in out]
    assert len(out) == 10 and max(cells) <= S.CELLS_AT_ONCE + 1000 and sum(cells) == 198_000
    assert [p for b in out for p in b["path"].to_pylist()] == [str(i) for i in range(200)]
    grids = [g for b in out for g in b["grid"].to_pylist()]
    assert grids[0][99] == [str(k) for k in range(10)] and grids[198] is None and grids[199] == []


def test_lines_equal_tokens():
    rng, bits = random.Random(5), ['"', '""', ",", "a", " b ", "\n", "\r\n", "\r", "\0", " ", ";"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert S.csv_grid(text, ",") == S._scanned(text, ","), text


def test_statements_are_read_once(spark):
    head = "Date,Narration,Withdrawal Amt,Deposit Amt\n"
    files = {"a.csv": head + "08/05/26,UPI/123456789012/Corner Shop,250.00,\nTotal,,1,\n2026-05-09,x,0.00,\n", "b.csv": head, "c.csv": "no,header\n1,2\n", "d.csv": "", "e.xls": bytes.fromhex("D0CF11E0A1B11AE1"), "f.xlsx": b"PK\x03\x04junk", "g.csv": "\n \n"}
    read = spark.createDataFrame([(n, x if isinstance(x, bytes) else x.encode()) for n, x in files.items()], "path string, content binary")
    rows, reports = S.taken(read, "UTC")
    assert not any(s in plan(df) for df in (rows, reports) for s in ("MapInArrow", "ArrowEvalPython"))
    got = {r.path: tuple(r)[1:] for r in reports.collect()}
    assert got == {r.path: tuple(r)[1:] for r in S.reports_of(read, "UTC").collect()}
    assert {p: r[:3] for p, r in got.items()} == {n: (3, 1, 2) if n == "a.csv" else (0, 0, 0) for n in files} and got["b.csv"][3] is None
    assert [got[n][3].split()[0] for n in ("c.csv", "d.csv", "e.xls", "f.xlsx", "g.csv")] == ["Couldn't", "File", "Old", "Couldn't", "No"]
    lazy = S.rows_of(read, "UTC")
    assert lazy.columns == rows.columns and sorted(map(tuple, lazy.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and rows.count() == 3
    # A filter doesn't read files again.
    assert plan(lazy.where("NOT skipped")).count("MapInArrow") == 1


def test_ledger_files_are_read_once(spark):
    files = {"a.csv": "occurred_at,amount_inr\n2026-05-08,-3.50\nx,1\n", "b.csv": " \n", "c.csv": "occurred_at,amount_inr\n", "d.csv": "x,y\n1,2\n"}
    read = spark.createDataFrame([(n, x.encode()) for n, x in files.items()], "path string, content binary")
    rows, reports = ledger_csv.rows_of(read, "UTC", once=True)
    assert not any("MapInArrow" in plan(df) for df in (rows, reports)) and plan(ledger_csv.rows_of(read, "UTC")[0].where("NOT skipped")).count("MapInArrow") == 1
    assert {r.path: (r.n_rows, r.n_skipped, r.problem) for r in reports.collect()} == {"a.csv": (2, 1, None), "b.csv": (0, 0, "File is empty"), "c.csv": (0, 0, "No data rows"), "d.csv": (0, 0, "Missing 'occurred_at' column")}
    assert [(r.amount_paise, r.direction) for r in rows.where("NOT skipped").collect()] == [(350, "DEBIT")]


def test_numbers_and_batches_need_no_python(spark):
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("id")).repartition(7)
    got = ledger.numbered(many, ["v"], start=3)
    assert "Arrow" not in plan(got) and all(r.id == r.v + 3 for r in got.collect())
    raw = spark.createDataFrame([], "id long, source string, sender string, body string, received_at long, fingerprint string, parsed boolean, reject_reason string, parser_version int")
    store = spark.createDataFrame([], "id long, ref_no string, occurred_at long, amount_paise long, direction string, account_tail string")
    text = "Date,Narration,Withdrawal Amt,Deposit Amt\n08/05/26,Shop,2.00,\n08/05/26,Shop,2.00,\n08/05/26,Other Shop,2.00,\n"
    rows, _ = S.taken(spark.createDataFrame([("a/x.csv", text.encode()), ("b/x.csv", text.encode())], "path string, content binary"), "UTC")
    batch = ingest.records_in(records.of_statements(rows), raw, store, "UTC")
    assert sorted((r.id, r.outcome) for r in batch.outcomes.collect()) == [(1, "inserted"), (2, "duplicate message"), (3, "inserted"), *[(i, "duplicate message") for i in (4, 5, 6)]]
    assert sorted(r.id for r in batch.txns.collect()) == [1, 3] and {r.id: r.parsed for r in batch.raw.collect()} == {1: True, 3: True}


def test_money_that_is_none(spark):
    cases = {"UPI/77/Shop": None, "Rs. 1,234.50": 123450, "Rs 5": 500, "(Rs. 2.00)": -200, "3 DR": -300, "rupees 4": 400, "1e2": 10000, "12.345": 1235, "-0.5": -50, "Rs.7 cr": 700, "dr": None, "ATM 1": None}
    out = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.signed_paise(F.col("v")).alias("p")).collect()
    assert {r.v: r.p for r in out} == cases
