"""Rows of files as records that the ledger takes in, in a stated order: by path, then by row.

Each file is a run of its own, in which occurrences of a day are counted from 1. All files of a batch go through one fold, so
what an earlier file adds is known to a later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.functions import text as X
from spendspark.operators import ingest, ledger


def _named(rows: DataFrame, source: str, more: dict, start: int) -> DataFrame:
    """Readable rows with ids in order; fields that the kind of file lacks are null. Rows are sorted in ranges, so they are read
    twice: give written ones (``statements.taken``, ``ledger_csv.rows_of`` with ``once``)."""
    good = rows.where("NOT skipped").select("path", "row_no", *[c for c in rows.columns if c not in ("path", "row_no", "skipped")])
    none = {c: F.lit(None).cast("bigint" if c in ("amount_paise", "balance_paise", "occurred_at") else "string") for c in ingest.FIELDS if c not in rows.columns}
    # A file's origin is its name, wherever it lies.
    fixed = {"source": F.lit(source), "origin": F.regexp_extract("path", "([^/]*)$", 1), "run": F.col("path"), "vpa_handle": X.vpa_handle(F.col("merchant_raw"))}
    full = good.withColumns(none | fixed | more)
    columns = ["path", "row_no", "run", "source", "origin", "raw_line", "exact_time", *ingest.FIELDS, "preset_category", "preset_source"]
    return ledger.numbered(full.select(*columns), ["path", "row_no"], start=start)


def of_statements(rows: DataFrame, start: int = 1) -> DataFrame:
    """Of ``statements.statement_rows``: mere days, nothing preset."""
    return _named(rows, "STATEMENT", {"exact_time": F.lit(False), "preset_category": F.lit(None).cast("string"), "preset_source": F.lit(None).cast("string")}, start)


def of_ledger_files(rows: DataFrame, start: int = 1) -> DataFrame:
    """Of ``ledger_csv.rows_of``: times and days side by side, categories as the file has them."""
    return _named(rows.withColumnsRenamed({"category": "preset_category", "category_source": "preset_source"}), "LEDGER_CSV", {}, start)


def reports(files: DataFrame, records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each file what became of its rows. files: path, n_rows, n_skipped and problem."""
    one = lambda *names: F.count_if(F.col("outcome").isin(*names))
    met = records.select("id", "path").join(outcomes, "id").groupBy("path").agg(one("inserted").alias("i"), one("duplicate message", "duplicate transaction").alias("d"))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    return files.join(met, "path", "left").select("path", zero("n_rows", "n_rows"), zero("i", "n_imported"), zero("d", "n_duplicates"), zero("n_skipped", "n_skipped"), "problem")
