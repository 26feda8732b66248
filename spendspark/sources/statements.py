"""Statement files to transactions: CSV, TSV and spreadsheets.

A file becomes a grid of cells in Python, one file at a time, and grids leave it in batches of bounded size; everything after
that (finding the header, matching columns, reading days, money and names) is native columns over the grid, exploded into rows.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.store import written

#: Grids are handed on once they hold so many cells; a larger grid is a batch of its own.
CELLS_AT_ONCE = 20_000
DELIMITERS, SAMPLE_LINES, HEADER_DEPTH = ",\t;|", 20, 30
_LINE_END = re.compile(r"\r\n|\r|\n")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def kind_of(content: Column) -> Column:
    """empty, xls (the old format, not read), xlsx or text, by the first bytes."""
    head, size = F.hex(F.substring(content, 1, 4)), F.octet_length(content)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(head.startswith("D0CF11E0") & (size >= 8), "xls").when(head.startswith("504B") & (size >= 4), "xlsx").otherwise("text")


def delimiter_of(text: str) -> str:
    """Of the candidates the one that occurs often and evenly in the first lines; the first at a tie."""
    lines = [x for x in text.splitlines() if x.strip()][:SAMPLE_LINES]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = sorted(x.count(d) for x in lines)
        middle = counts[len(counts) // 2] if counts else 0
        value = middle * 100 - sum(c != middle for c in counts) if middle else 0
        if value > most:
            best, most = d, value
    return best


def delimiter(text: Column) -> Column:
    """As ``delimiter_of``, of a column."""
    lines = F.slice(F.filter(F.split(text, r"\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: X.trimmed(x) != ""), 1, SAMPLE_LINES)

    def rate(mark: str) -> Column:
        counts = F.array_sort(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))))
        middle = F.coalesce(F.get(counts, F.call_function("div", F.size(counts), F.lit(2)).cast("int")), F.lit(0))
        return X.bound(F.struct(counts.alias("c"), middle.alias("m")), lambda s: F.when(s["m"] > 0, s["m"] * 100 - F.size(F.filter(s["c"], lambda n: n != s["m"]))).otherwise(0))

    rated = F.array(*[F.struct(rate(m).alias("value"), F.lit(-i).alias("place"), F.lit(m).alias("mark")) for i, m in enumerate(DELIMITERS)])
    return F.array_max(rated)["mark"]


def csv_grid(text: str, delimiter: str) -> list[list[str]]:
    """Rows of trimmed fields; quotes open anywhere, a doubled quote is one, rows without any text are dropped."""
    lines = _LINE_END.split(text)
    if '"' in text and any(line.count('"') % 2 for line in lines):
        return _scanned(text, delimiter)  # some field goes on in the next line
    rows = []
    for line in lines:
        if '"' not in line:
            cells = line.split(delimiter)
        elif '""' in line or "\0" in line:
            rows += _scanned(line, delimiter)
            continue
        else:  # quoted stretches stand at odd places
            cells = "".join(s if i % 2 else s.replace(delimiter, "\0") for i, s in enumerate(line.split('"'))).split("\0")
        cells = [c.strip() for c in cells]
        if any(cells):
            rows.append(cells)
    return rows


def _scanned(text: str, delimiter: str) -> list[list[str]]:
    """As ``csv_grid``, token by token."""
    rows, row, quoted, at = [], [], False, 0
    field: list[str] = []
    token = re.compile(rf'[^"\r\n{re.escape(delimiter)}]+|""|"|\r\n|\r|\n|{re.escape(delimiter)}')

    def end_row() -> None:
        row.append("".join(field).strip())
        field.clear()
        if any(row):
            rows.append(row.copy())
        row.clear()

    for m in token.finditer(text):
        t = m[0]
        if t == '""' and quoted:
            field.append('"')
        elif t == '""':
            pass  # an empty quoted stretch
        elif t == '"':
            quoted = not quoted
        elif quoted or t not in ("\r\n", "\r", "\n", delimiter):
            field.append(t)
        elif t == delimiter:
            row.append("".join(field).strip())
            field.clear()
        else:
            end_row()
        at = m.end()
    if field or row or at == 0 and text:
        end_row()
    return rows


def xlsx_grid(content: bytes) -> list[list[str]] | None:
    """The first sheet by name; gaps filled from cell references, blank rows dropped; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            sheets = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))
            local = lambda e: e.tag.rsplit("}", 1)[-1]
            joined = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
            shared = [joined(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
            rows = []
            for r in ElementTree.fromstring(z.read(sheets[0])).iter():
                if local(r) != "row":
                    continue
                cells: list[str] = []
                for c in r:
                    letters = re.match(r"[A-Za-z]*", c.get("r") or "")[0].upper()
                    number = 0
                    for x in letters:
                        number = number * 26 + ord(x) - 64
                    cells += [""] * (max(number - 1, 0) - len(cells)) if letters else []
                    value = next((v.text or "" for v in c if local(v) == "v"), "")
                    cells.append((shared[int(value)] if c.get("t") == "s" and value else joined(c) if c.get("t") == "inlineStr" else value).strip())
                if any(cells):
                    rows.append(cells)
            return rows
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
        return None


def _nested(grids: list[list[list[str]] | None]) -> pa.Array:
    """Grids as an Arrow array of lists of lists."""
    known = [g or [] for g in grids]
    ends = lambda lists: pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32())
    rows = [r for g in known for r in g]
    cells = pa.ListArray.from_arrays(ends(rows), pa.array([c for r in rows for c in r], pa.string()))
    return pa.ListArray.from_arrays(ends(known), cells, mask=pa.array([g is None for g in grids], pa.bool_()))


def grids_of(read: DataFrame) -> DataFrame:
    """Column ``content`` of files as ``grid``, the cells of each; null for a spreadsheet that can't be read. A task holds the
    grids of some files at a time, however many it reads."""
    rest = [c for c in read.columns if c != "content"]
    schema = T.StructType([*[read.schema[c] for c in rest], T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType())))])
    return read.select(*rest, "content").mapInArrow(_reader(rest), schema)


def _reader(rest: list[str]):
    def one(raw: bytes | None) -> list[list[str]] | None:
        raw = raw or b""
        if raw[:2] == b"PK" and len(raw) >= 4:
            return xlsx_grid(raw)
        text = raw.decode("utf-8", "replace").removeprefix("﻿")
        return csv_grid(text, delimiter_of(text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, grids, cells = 0, [], 0
            for i, content in enumerate(batch["content"], 1):
                grids.append(one(content.as_py()))
                cells += sum(map(len, grids[-1] or []))
                if cells >= CELLS_AT_ONCE or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[batch[c].slice(start, len(grids)) for c in rest], _nested(grids)], names=[*rest, "grid"])
                    start, grids, cells = i, [], 0

    return work


def _any_key(cell: Column, keys: list[str]) -> Column:
    hit = F.lit(False)
    for k in [k for k in keys if not any(o in k for o in keys if o != k)]:  # what holds a longer key holds the shorter
        hit = hit | F.contains(cell, F.lit(k))
    return hit


def _column(header: Column, keys: list[str]) -> Column:
    """0-based column of the first key that a cell equals, else of the first that a cell holds; null without one."""
    exact = [F.nullif(F.array_position(header, k), F.lit(0)) for k in keys]
    inside = [F.nullif(F.array_position(F.transform(header, lambda c: F.contains(c, F.lit(k))), True), F.lit(0)) for k in keys]  # noqa: B023
    return (F.coalesce(*exact, *inside) - 1).cast("int")


def with_header(grids: DataFrame) -> DataFrame:
    """Adds header_at (0-based, null without a header), header (lower case) and problem to a column ``grid``."""
    everything = R.DATE_KEYS + R.NARRATION_KEYS + R.DEBIT_KEYS + R.CREDIT_KEYS + R.AMOUNT_KEYS + R.BALANCE_KEYS + R.REF_KEYS
    low = F.transform(F.slice("grid", 1, HEADER_DEPTH), lambda row: F.transform(row, F.lower))

    def rate(row: Column) -> Column:
        fits = F.exists(row, lambda c: _any_key(c, R.DATE_KEYS)) & F.exists(row, lambda c: _any_key(c, R.DEBIT_KEYS + R.CREDIT_KEYS + R.AMOUNT_KEYS))
        return F.when(fits, F.size(F.filter(row, lambda c: _any_key(c, everything)))).otherwise(0)

    # A generated row is worked out once; a filter on what it gives stays behind it.
    rated = grids.select("*", F.explode(F.array(F.transform(low, rate))).alias("__rates"))
    found = F.when(F.array_max("__rates") > 0, F.array_position("__rates", F.array_max("__rates")) - 1).cast("int")
    problem = F.when(F.col("grid").isNull(), "Couldn't read that spreadsheet").when(F.size("grid") == 0, "No rows found").when(F.col("header_at").isNull(), "Couldn't find a header row with a date and an amount column")
    out = rated.withColumn("header_at", found).withColumn("header", F.transform(F.get("grid", F.col("header_at")), lambda c: F.lower(X.trimmed(c))))
    return out.withColumn("problem", problem).drop("__rates")


def statement_rows(grids: DataFrame, zone: str) -> DataFrame:
    """One row for each row below a header: the transaction's fields, or ``skipped`` without a day or an amount."""
    return _told(all_rows(grids, zone))


def _told(every: DataFrame) -> DataFrame:
    return every.where("row_no IS NOT NULL").drop("problem")


def all_rows(grids: DataFrame, zone: str) -> DataFrame:
    """As ``statement_rows``, with ``problem`` of the file; a file without rows is one row that has no row_no."""
    named = with_header(grids)
    columns = {n: _column(F.col("header"), k) for n, k in (("day", R.DATE_KEYS), ("narration", R.NARRATION_KEYS), ("debit", R.DEBIT_KEYS), ("credit", R.CREDIT_KEYS), ("amount", R.AMOUNT_KEYS), ("balance", R.BALANCE_KEYS), ("ref", R.REF_KEYS))}
    placed = named.withColumns({f"__{n}": c for n, c in columns.items()})
    rest = [*[c for c in grids.columns if c != "grid"], "problem"]
    below = F.when(F.col("problem").isNull(), F.slice("grid", F.col("header_at") + 2, F.greatest(F.size("grid"), F.lit(1))))
    rows = placed.select(*rest, *[f"__{n}" for n in columns], F.posexplode_outer(below).alias("row_no", "cells"))
    cell = {n: F.get("cells", F.col(f"__{n}")) for n in columns}
    money = lambda n: X.bound(X.signed_paise(cell[n]), lambda p: F.when(p != 0, p))
    signed = F.coalesce(-F.abs(money("debit")), F.abs(money("credit")), money("amount"))
    narration = F.coalesce(cell["narration"], F.lit(""))
    own_ref = F.when(~F.coalesce(X.trimmed(cell["ref"]), F.lit("")).isin("", "-"), cell["ref"])
    name = X.narration_merchant(narration)
    out = rows.select(*rest, "row_no", X.file_day(cell["day"]).alias("day"), signed.alias("signed"), name.alias("merchant_raw"), X.ref_key(F.coalesce(own_ref, X.found(narration, R.NARRATION_REF))).alias("ref_no"), X.narration_channel(narration).alias("channel"), X.signed_paise(cell["balance"]).alias("balance_paise"), F.array_join("cells", " | ").alias("raw_line"))
    skipped = F.col("day").isNull() | F.col("signed").isNull()
    return out.select(
        *rest, "row_no", skipped.alias("skipped"), F.when(~skipped, F.abs("signed")).alias("amount_paise"), F.when(~skipped, F.when(F.col("signed") < 0, "DEBIT").otherwise("CREDIT")).alias("direction"),
        X.from_local_ms(X.day_ms(F.col("day")) + R.DAY_MS // 2, zone).alias("occurred_at"), "merchant_raw", F.nullif(X.merchant_key(F.col("merchant_raw")), F.lit("")).alias("merchant_norm"), "ref_no", "channel", "balance_paise", "raw_line",
    )


def imported(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Transactions of all statement files below a path."""
    return rows_of(files(spark, path), zone)


def reports(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Reports on all statement files below a path."""
    return reports_of(files(spark, path), zone)


def rows_of(read: DataFrame, zone: str) -> DataFrame:
    """Transactions of statement files (path, content)."""
    return _told(_read(read, zone)).drop("kind")


def _read(read: DataFrame, zone: str) -> DataFrame:
    """All rows of files (path, content), with the kind of each file; a file of another kind is not read."""
    kind = kind_of(F.col("content"))
    return all_rows(grids_of(read.select("path", kind.alias("kind"), F.when(kind.isin("text", "xlsx"), F.col("content")).alias("content"))), zone)


def reports_of(read: DataFrame, zone: str) -> DataFrame:
    """For each file (path, content): data rows, readable and skipped ones, and what is wrong with a file that has none."""
    return _counted(_read(read, zone))


def _counted(every: DataFrame) -> DataFrame:
    problem = F.when(F.col("kind") == "empty", "File is empty").when(F.col("kind") == "xls", "Old .xls format: save it as .xlsx or CSV").otherwise(F.col("problem"))
    files = every.groupBy("path").agg(F.count("row_no").alias("n_rows"), F.count_if(F.col("skipped") & F.col("row_no").isNotNull()).alias("n_skipped"), F.max(problem).alias("problem"))
    return files.select("path", "n_rows", (F.col("n_rows") - F.col("n_skipped")).alias("n_read"), "n_skipped", "problem")


def taken(read: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """Transactions and reports of statement files (path, content), both from one reading that is written to the shared folder."""
    every = written(_read(read, zone), "statements")
    return _told(every).drop("kind"), _counted(every)
