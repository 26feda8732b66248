"""Queries from files to the ledger: files rendered from the benchmark tables, read as grids, and taken in; with DuckDB SQL that
derives rows and outcomes from the tables' own columns, one record after another."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import ingest, lexicon, parse
from spendspark.plans import adapter as A
from spendspark.plans.ingest_queries import _empty, _know
from spendspark.plans.registry import query
from spendspark.sources import ledger_csv, records, rule_tables, statements

_SEPARATORS = [",", ";", "\t", "|"]
#: Every tenth customer has the same file in a second folder, every seventh a spreadsheet, every fifth a byte order mark.
_AGAIN, _SHEET, _MARK = 10, 7, 5


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


@F.pandas_udf(T.BinaryType())
def _workbook(grids: pd.Series) -> pd.Series:
    """A spreadsheet of one sheet for each grid: numbers as numbers, every second text shared, the rest inline, gaps left out."""

    def one(grid) -> bytes:
        shared: dict[str, int] = {}
        rows = []
        for r, row in enumerate(grid, 1):
            cells = []
            for c, value in enumerate(row):
                at = f"{chr(65 + c)}{r}"
                if not value:
                    continue
                if value.replace(".", "", 1).isdigit():
                    cells.append(f'<c r="{at}"><v>{value}</v></c>')
                elif (r + c) % 2:
                    cells.append(f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
                else:
                    cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            rows.append(f'<row r="{r}">{"".join(cells)}</row>')
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData>{"".join(rows)}</sheetData></worksheet>')
            z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}/>")
            z.writestr("xl/sharedStrings.xml", f'<sst {space}>{"".join(f"<si><t>{escape(s[:2])}</t><t>{escape(s[2:])}</t></si>" for s in shared)}</sst>')
        return buffer.getvalue()

    return grids.map(lambda grid: None if grid is None else one(grid))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a statement row for each order."""
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    paise = F.floor(F.col("o_totalprice") / 20_000).cast("bigint") * 10_000 + 150
    whole = F.call_function("div", paise, F.lit(100))
    money = F.when(k % 11 == 0, "0.00").otherwise(F.concat(F.lit("Rs. "), F.when(whole >= 1000, F.concat(F.call_function("div", whole, F.lit(1000)).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(".50")))
    out = F.col("o_orderstatus") == "O"
    date = F.date_trunc("month", "o_orderdate")
    day = F.when(k % 13 == 0, "n/a").when(k % 3 == 0, F.date_format(date, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(date, "dd-MMM-yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    told = F.lpad((k % 4000).cast("string"), 12, "7")
    narration = F.get(F.array(F.concat(F.lit("UPI/"), told, F.lit("/Shop Alpha Ltd")), F.lit("NEFT:Payment to Corner \"Best\" Shop"), F.lit("ATM WDL 123"), F.lit("POS Green Mart"), F.lit("ACH mandate Big Insurance")), (k % 5).cast("int"))
    ref = F.when(k % 5 == 1, F.concat(F.lit("ref-"), F.lpad(k.cast("string"), 9, "0"))).otherwise("-")
    signed = F.when(out, F.when(k % 2 == 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(F.concat(money, F.lit(" DR")))).otherwise(money)
    split = (F.col("o_custkey") % 2 == 0)
    cells = F.when(split, F.array(day, narration, ref, F.when(out, money).otherwise(""), F.when(out, "").otherwise(money), k.cast("string"))).otherwise(F.array(day, narration, ref, signed, k.cast("string")))
    return o.select(F.col("o_custkey").alias("customer"), k.alias("id"), cells.alias("cells"))


def statement_files(spark: SparkSession, d: str) -> DataFrame:
    """path and content: the statement of each customer."""
    c = F.col("customer")
    grouped = _orders(spark, d).groupBy("customer").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "cells"))), lambda x: x["cells"]).alias("rows"))
    header = F.when(c % 2 == 0, F.array(*map(F.lit, ["Txn Date", "Narration", "Chq/Ref No", "Withdrawal Amt", "Deposit Amt", "Balance"]))).otherwise(F.array(*map(F.lit, ["Date", "Description", "Reference No", "Amount", "Closing Balance"])))
    grids = grouped.select("customer", F.concat(F.array(F.array(F.lit("Statement of"), c.cast("string"))), F.array(header), F.col("rows")).alias("grid"))
    quoted = lambda x: F.when(x.rlike('[,;|"\t]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    separator = _pick(_SEPARATORS, c % 4)
    # array_join takes one delimiter for all rows, so the separator takes the place of a mark.
    text = F.replace(F.array_join(F.transform("grid", lambda r: F.array_join(F.transform(r, quoted), "\x01")), "\n"), F.lit("\x01"), separator)
    text = F.when(c % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    plain = F.encode(F.concat(F.when(c % _MARK == 0, "﻿").otherwise(""), text), "UTF-8")
    made = grids.select("customer", F.when(c % _SHEET == 0, _workbook(F.when(c % _SHEET == 0, F.col("grid")))).otherwise(plain).alias("content"))
    name = F.concat(F.lpad(c.cast("string"), 9, "0"), F.when(c % _SHEET == 0, ".xlsx").otherwise(".csv"))
    folders = F.when(c % _AGAIN == 1, F.array(F.lit("a/"), F.lit("b/"))).otherwise(F.array(F.lit("a/")))
    return made.select(F.explode(folders).alias("folder"), name.alias("name"), "content").select(F.concat("folder", "name").alias("path"), "content")


#: CTE ``rec``: the readable rows of all files, in order, with the path and number of each, and its fields.
_STATEMENTS = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice / 20000) AS BIGINT) * 10000 + 150 AS paise, o_orderstatus = 'O' AS out_, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders),
placed AS (SELECT o.*, f.folder || lpad(CAST(c AS VARCHAR), 9, '0') || CASE WHEN c % {_SHEET} = 0 THEN '.xlsx' ELSE '.csv' END AS path, f.folder, row_number() OVER (PARTITION BY f.folder, c ORDER BY k) - 1 AS row_no
  FROM o JOIN (SELECT unnest(['a/', 'b/']) AS folder) f ON f.folder = 'a/' OR c % {_AGAIN} = 1),
rec AS (SELECT path, CAST(row_no AS INTEGER) AS row_no, k, folder = 'b/' AS again, day, paise AS amount_paise, CASE WHEN out_ THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CASE k % 5 WHEN 0 THEN lpad(CAST(k % 4000 AS VARCHAR), 12, '7') WHEN 1 THEN 'REF' || lpad(CAST(k AS VARCHAR), 9, '0') END AS ref_no,
  CASE k % 5 WHEN 0 THEN 'shop alpha' WHEN 1 THEN 'corner best shop' WHEN 2 THEN 'atm wdl' WHEN 3 THEN 'pos green mart' ELSE 'ach mandate big insurance' END AS merchant_norm,
  CASE k % 5 WHEN 0 THEN 'UPI' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'ATM' WHEN 3 THEN 'CARD' ELSE 'AUTOPAY' END AS channel, row_number() OVER (ORDER BY path, row_no) AS ord FROM placed WHERE k % 11 <> 0 AND k % 13 <> 0)"""
#: CTEs ``judged``: each record's outcome, by recursion over the records of one day, amount and direction.
_STATEMENT_FOLD = f"""{_STATEMENTS}, fresh AS (SELECT *, CASE WHEN ref_no IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY ref_no ORDER BY ord) END AS ref_n FROM rec WHERE NOT again),
lined AS (SELECT *, row_number() OVER (PARTITION BY path, day, amount_paise, direction, ref_no IS NULL ORDER BY ord) AS n, row_number() OVER (PARTITION BY day, amount_paise, direction ORDER BY ord) AS i FROM fresh WHERE ref_n IS NULL OR ref_n = 1),
run AS (SELECT ord, day, amount_paise, direction, i, true AS kept, 1 AS held FROM lined WHERE i = 1
  UNION ALL SELECT l.ord, l.day, l.amount_paise, l.direction, l.i, l.ref_no IS NOT NULL OR r.held < l.n, r.held + CASE WHEN l.ref_no IS NOT NULL OR r.held < l.n THEN 1 ELSE 0 END
  FROM run r JOIN lined l ON l.day = r.day AND l.amount_paise = r.amount_paise AND l.direction = r.direction AND l.i = r.i + 1),
judged AS (SELECT rec.*, CASE WHEN again THEN 'duplicate message' WHEN run.kept THEN 'inserted' ELSE 'duplicate transaction' END AS outcome FROM rec LEFT JOIN run ON run.ord = rec.ord)"""


def _taken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, ingest.Batch]:
    rows, reports = statements.taken(statement_files(spark, d), A.ZONE)
    found = records.of_statements(rows)
    return reports, found, ingest.records_in(found, *_empty(spark), A.ZONE, _know(spark))


@query("q_statement_rows", f"WITH {_STATEMENTS} SELECT path, row_no, day, amount_paise, direction, ref_no, merchant_norm, channel, k * 100 AS balance_paise FROM rec")
def statement_rows(spark, d):
    """Rows of text files with four delimiters and of spreadsheets, below a header that has to be found."""
    rows = statements.rows_of(statement_files(spark, d), A.ZONE).where("NOT skipped")
    return rows.select("path", "row_no", X.local_day(F.col("occurred_at"), A.ZONE).alias("day"), "amount_paise", "direction", "ref_no", "merchant_norm", "channel", "balance_paise")


@query("q_statement_outcomes", f"WITH RECURSIVE {_STATEMENT_FOLD} SELECT path, row_no, outcome FROM judged")
def statement_outcomes(spark, d):
    """All customers' files as one batch: each counts its own occurrences, and meets what files before it added."""
    _, found, batch = _taken(spark, d)
    return found.select("id", "path", "row_no").join(batch.outcomes, "id").select("path", "row_no", "outcome")


@query("q_statement_transactions", f"WITH RECURSIVE {_STATEMENT_FOLD} SELECT amount_paise, direction, channel, ref_no, merchant_norm, day, k * 100 AS balance_paise FROM judged WHERE outcome = 'inserted'")
def statement_transactions(spark, d):
    """What statements add to the ledger."""
    _, _, batch = _taken(spark, d)
    return batch.txns.select("amount_paise", "direction", "channel", "ref_no", "merchant_norm", X.local_day(F.col("occurred_at"), A.ZONE).alias("day"), "balance_paise")


@query(
    "q_import_reports",
    f"""WITH RECURSIVE {_STATEMENT_FOLD}, files AS (SELECT path, count(*) AS n_rows, count(*) FILTER (k % 11 = 0 OR k % 13 = 0) AS n_skipped FROM placed GROUP BY path)
SELECT path, n_rows, (SELECT count(*) FROM judged j WHERE j.path = f.path AND outcome = 'inserted') AS n_imported, (SELECT count(*) FROM judged j WHERE j.path = f.path AND outcome <> 'inserted') AS n_duplicates, n_skipped, CAST(NULL AS VARCHAR) AS problem FROM files f""",
)
def import_reports(spark, d):
    """For each file: rows, new ones, known ones, unreadable ones."""
    reports, found, batch = _taken(spark, d)
    return records.reports(reports, found, batch.outcomes)


def ledger_files(spark: SparkSession, d: str) -> DataFrame:
    """path and content: a ledger file of each hundred events; every third row has a day only, some a reference."""
    e, i = A.table(spark, d, "events"), F.col("event_id")
    amount = F.floor(F.col("value") / 20).cast("bigint") + 1
    ts = F.date_trunc("minute", "ts")
    stamp = F.when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    cells = [stamp, F.when(i % 4 == 0, "").otherwise("debit"), F.concat(F.when(i % 4 == 0, "-").otherwise(""), amount.cast("string"), F.lit(".00")), F.concat(F.lit("Shop "), (i % 7).cast("string"), F.lit(", Pune")),
             F.when(i % 6 == 0, _pick(R.CATEGORIES, i % 15)).when(i % 6 == 1, "No such").otherwise(""), F.when(i % 6 == 0, "user").otherwise(""), F.lit("upi"), F.when(i % 5 == 0, "").otherwise(F.lpad((i % 2).cast("string"), 4, "0")), F.when(i % 9 == 0, F.concat(F.lit("AB"), F.lpad((i % 900).cast("string"), 6, "0"))).otherwise(""), (i + 1).cast("string")]
    line = F.array_join(F.array(*[X.csv_cell(c) for c in cells]), ",")
    header = ",".join([*R.LEDGER_COLUMNS[:10]])
    files = e.select(F.floor(i / 100).alias("file"), i.alias("id"), line.alias("line")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("rows"))
    body = F.concat(F.lit(header + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return files.select(F.concat(F.lit("ledger/"), F.lpad(F.col("file").cast("string"), 9, "0"), F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content"))


_LEDGER_ROWS = f"""src AS (SELECT event_id AS k, event_id // 100 AS file, (CAST(floor(value / 20) AS BIGINT) + 1) * 100 AS p, CASE WHEN event_id % 5 <> 0 THEN lpad(CAST(event_id % 2 AS VARCHAR), 4, '0') END AS tail, event_id % 3 <> 0 AS exact,
  epoch_ms(date_trunc('minute', ts)) AS clock, CAST(ts AS DATE) AS day, CASE WHEN event_id % 9 = 0 THEN 'AB' || lpad(CAST(event_id % 900 AS VARCHAR), 6, '0') END AS ref_no, 'Shop ' || CAST(event_id % 7 AS VARCHAR) || ', Pune' AS merchant FROM events),
r AS (SELECT *, CASE WHEN exact THEN clock ELSE epoch_ms(CAST(day AS TIMESTAMP)) + 43200000 END AS moment, CASE WHEN k % 6 = 0 THEN {A._case(R.CATEGORIES, '(k % 15)')} END AS preset FROM src)"""
#: CTE ``judged`` (k, kept, ...): one record after another against all kept before, of both kinds, by recursion.
_MIXED = f"""{_LEDGER_ROWS}, known AS (SELECT *, ref_no IS NOT NULL AND row_number() OVER (PARTITION BY ref_no ORDER BY k) > 1 AS known FROM r),
lined AS (SELECT *, row_number() OVER (PARTITION BY file, day, p, tail, exact OR ref_no IS NOT NULL ORDER BY k) AS n, row_number() OVER (PARTITION BY p ORDER BY k) AS i FROM known WHERE NOT known),
fold AS (SELECT p, i, k, true AS kept, [{{'t': moment, 'd': day, 'x': tail}}] AS held FROM lined WHERE i = 1
  UNION ALL SELECT p, i, k, kept, CASE WHEN kept THEN list_append(held, {{'t': moment, 'd': day, 'x': tail}}) ELSE held END FROM (SELECT l.*, f.held, CASE WHEN l.ref_no IS NOT NULL THEN true
    WHEN l.exact THEN len(list_filter(f.held, lambda h: abs(h.t - l.moment) <= {R.NEAR_MS} AND (h.x IS NULL OR l.tail IS NULL OR h.x = l.tail))) = 0
    ELSE len(list_filter(f.held, lambda h: h.d = l.day AND (h.x IS NULL OR l.tail IS NULL OR h.x = l.tail))) < l.n END AS kept FROM fold f JOIN lined l ON l.p = f.p AND l.i = f.i + 1)),
judged AS (SELECT r.*, coalesce(f.kept, false) AS kept FROM r LEFT JOIN fold f ON f.k = r.k)"""


def _ledger_taken(spark: SparkSession, d: str) -> tuple[DataFrame, ingest.Batch]:
    rows, _ = ledger_csv.rows_of(ledger_files(spark, d), A.ZONE, once=True)
    found = records.of_ledger_files(rows)
    return found, ingest.records_in(found, *_empty(spark), A.ZONE, _know(spark))


@query("q_ledger_file_rows", f"""WITH {_LEDGER_ROWS} SELECT k * 100 + 100 AS balance_paise, p AS amount_paise, 'DEBIT' AS direction, moment AS occurred_at, exact AS exact_time, tail AS account_tail, ref_no, 'shop ' || CAST(k % 7 AS VARCHAR) AS merchant_norm, 'UPI' AS channel, preset AS preset_category,
  CASE WHEN k % 6 = 0 THEN 'USER' END AS preset_source FROM r""")
def ledger_file_rows(spark, d):
    """Rows of ledger files: times, days, signs, labels outside the set."""
    rows, _ = ledger_csv.rows_of(ledger_files(spark, d), A.ZONE, once=True)
    return records.of_ledger_files(rows).select("balance_paise", "amount_paise", "direction", "occurred_at", "exact_time", "account_tail", "ref_no", "merchant_norm", "channel", "preset_category", "preset_source")


@query("q_ledger_file_outcomes", f"WITH RECURSIVE {_MIXED} SELECT k * 100 + 100 AS balance_paise, CASE WHEN kept THEN 'inserted' ELSE 'duplicate transaction' END AS outcome FROM judged")
def ledger_file_outcomes(spark, d):
    """Files that hold times, days and references side by side, through one fold."""
    found, batch = _ledger_taken(spark, d)
    return found.select("id", "balance_paise").join(batch.outcomes, "id").select("balance_paise", "outcome")


@query("q_ledger_file_learns", f"WITH RECURSIVE {_MIXED} SELECT 'shop ' || CAST(k % 7 AS VARCHAR) AS merchant_norm, preset AS category, count(*) AS n FROM judged WHERE kept AND preset IS NOT NULL GROUP BY ALL")
def ledger_file_learns(spark, d):
    """What a restored ledger gives back to memory and model."""
    _, batch = _ledger_taken(spark, d)
    return batch.to_learn().groupBy("merchant_norm", "category").agg(F.count("*").alias("n"))


@query("q_narrations", """SELECT o_orderkey AS id, CASE k WHEN 0 THEN 'Shop Alpha' WHEN 1 THEN 'Corner Shop' WHEN 2 THEN 'cash wdl at main road' WHEN 3 THEN 'Gas' WHEN 5 THEN 'Nine' WHEN 6 THEN 'RTGS to landlord' END AS merchant, CASE k WHEN 0 THEN 'UPI' WHEN 1 THEN 'IMPS' WHEN 2 THEN 'ATM' WHEN 3 THEN 'CARD' WHEN 4 THEN 'AUTOPAY' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'RTGS' ELSE 'NEFT' END AS channel
FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)""")
def narrations(spark, d):
    """Names and channels of statement lines."""
    k = F.col("o_orderkey")
    lines = ["UPI/77/{}/Shop Alpha/DR", "IMPS|{}|payment TO Corner Shop", "cash wdl at main road", "POS:{}:Gas:txn", "ACH/{}/12", "{}:Nine:Two", "RTGS to landlord", "NEFT/{}/ab"]
    text = F.replace(_pick(lines, k % 8), F.lit("{}"), k.cast("string"))
    return A.table(spark, d, "orders").select(k.alias("id"), X.narration_merchant(text).alias("merchant"), X.narration_channel(text).alias("channel"))


@query("q_cell_columns", "SELECT o_orderkey AS id, CAST(o_orderkey % 18278 AS INTEGER) AS number FROM orders")
def cell_columns(spark, d):
    """Column letters of cell references back to numbers."""
    k = F.col("o_orderkey") % 18_278
    letter = lambda n: F.char(F.lit(65) + n % 26)
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    letters = F.when(k < 26, letter(k)).when(k < 702, F.concat(letter(div(k - 26, 26)), letter(k - 26))).otherwise(F.concat(letter(div(k - 702, 676)), letter(div(k - 702, 26)), letter(k - 702)))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.column_number(F.concat(F.when(k % 2 == 0, F.lower(letters)).otherwise(letters), k.cast("string"))).alias("number"))


@query("q_file_kinds", f"SELECT 'a/' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, CASE WHEN o_custkey % {_SHEET} = 0 THEN 'xlsx' ELSE 'text' END AS kind, CASE WHEN o_custkey % {_SHEET} <> 0 THEN CASE o_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END END AS delimiter FROM (SELECT DISTINCT o_custkey FROM orders)")
def file_kinds(spark, d):
    """Containers and delimiters, told by content."""
    files = statement_files(spark, d).where("path LIKE 'a/%'").withColumn("kind", statements.kind_of(F.col("content")))
    return files.select(F.regexp_replace("path", "[.][a-z]+$", "").alias("name"), "kind", F.when(F.col("kind") == "text", statements.delimiter(F.decode("content", "UTF-8"))).alias("delimiter"))


_WORDS = "SELECT DISTINCT pattern, 'c' || CAST(length(pattern) % 7 AS VARCHAR) AS category FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS pattern FROM benchmark)"


@query("q_lexicon_table", f"""WITH p AS ({_WORDS}), met AS (SELECT doc_id, pattern, category, row_number() OVER (PARTITION BY doc_id ORDER BY length(pattern) DESC, pattern) AS k FROM documents, p WHERE contains(lower(text), pattern)) SELECT doc_id, pattern, category FROM met WHERE k = 1""")
def lexicon_table(spark, d):
    """The longest of all words of the benchmark table that each document holds, within words as well."""
    words = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("pattern"))
    patterns = words.select("pattern", F.concat(F.lit("c"), (F.length("pattern") % 7).cast("string")).alias("category"))
    return lexicon.longest(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", patterns)


@query("q_rule_table", f"""SELECT event_id AS id, CASE k WHEN 1 THEN 'PSP' WHEN 3 THEN 'PERSONAL' ELSE 'BANK' END AS sender_class, CASE WHEN event_id % 50 = 7 THEN 'personal sender' ELSE CASE event_id % 10 WHEN 3 THEN 'otp' WHEN 4 THEN 'promotional' WHEN 5 THEN 'not a completed txn' WHEN 6 THEN 'cash' WHEN 7 THEN 'informational' WHEN 8 THEN 'no amount' END END AS reject_reason
FROM (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 3 WHEN event_id % 10 = 9 THEN CASE WHEN event_id % 20 = 9 THEN 4 ELSE 0 END ELSE event_id % 3 END AS k FROM events)""")
def rule_table(spark, d):
    """The parser under a table of rules with one sender code and one gate more than the usual ones."""
    more = spark.createDataFrame([("bank_codes", 1000, None, "unknwn"), ("gates", 1000, "cash", "(?i)^cash withdrawal")], "kind string, place int, name string, value string")
    rules = rule_tables.read(rule_tables.table(spark).unionByName(more))
    read = parse.parsed(A.messages(spark, d), A.ZONE, rules=rules)
    return read.select("id", X.sender_class(F.col("sender"), rules).alias("sender_class"), "reject_reason")
