"""A ledger as CSV: twelve fixed columns, local minutes, plain rupees; written with a header, read by the header's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.sources import statements
from spendspark.store import written


def lines(txns: DataFrame, zone: str, with_time: bool = False) -> DataFrame:
    """id and line of each transaction; columns that the ledger lacks are empty. Order by occurred_at when writing."""
    have = lambda c: F.col(c) if c in txns.columns else F.lit(None).cast("string")
    ms = X.local_ms(F.col("occurred_at"), zone)
    minute = F.call_function("div", ms, F.lit(60_000)) % 1440
    day = X.local_day(F.col("occurred_at"), zone)
    stamp = F.concat(day.cast("string"), F.lit(" "), F.lpad(F.call_function("div", minute, F.lit(60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    money = lambda c: X.rupees(F.col(c).cast("bigint")) if c in txns.columns else F.lit(None).cast("string")
    cells = [stamp, have("direction"), money("amount_paise"), F.coalesce(have("merchant_raw"), have("merchant_norm")), have("category"), have("category_source"), have("channel"), have("account_tail"), have("ref_no"), money("balance_paise"), have("lat").cast("string"), have("lon").cast("string")]
    line = F.concat_ws(",", *[F.coalesce(X.csv_cell(c), F.lit("")) for c in cells]).alias("line")
    return txns.select("id", *([] if not with_time else ["occurred_at"]), line)


def export(txns: DataFrame, zone: str, path: str) -> None:
    """Writes the header and all lines in order of time; part files in order hold the ledger, the first begins with the header."""
    head = txns.sparkSession.createDataFrame([(None, None, ",".join(R.LEDGER_COLUMNS))], "id long, occurred_at long, line string")
    rows = head.unionByName(lines(txns, zone, with_time=True))
    rows.orderBy(F.col("occurred_at").asc_nulls_first(), F.col("id").asc_nulls_first()).select("line").write.option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, zone: str) -> tuple[DataFrame, DataFrame]:
    """Rows and reports of the ledger files below a path."""
    return rows_of(statements.files(spark, path), zone)


def rows_of(files: DataFrame, zone: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and reports of ledger files (path, content); with ``once`` both from one reading, written to the shared folder. A
    file is one cell until it is cut into rows, so it has to fit a task; files of no bytes are passed over by the source.

    Rows: path, row_no, raw_line and what ``imported`` adds. Reports: path, n_rows, n_skipped and what is wrong with a file.
    """
    grids = statements.grids_of(files.select("path", F.hex("content").rlike("^(?:EFBBBF)?(?:0[9A-D]|20)*+$").alias("blank"), "content"))
    header = F.transform(F.get("grid", F.lit(0)), lambda c: F.lower(X.trimmed(c)))
    named = grids.withColumn("header", header)
    lacks = lambda c: ~F.coalesce(F.array_contains("header", c), F.lit(False))
    problem = (
        F.when(F.col("blank"), "File is empty").when(F.coalesce(F.size("grid"), F.lit(0)) < 2, "No data rows")
        .when(lacks("occurred_at"), "Missing 'occurred_at' column").when(lacks("amount_inr"), "Missing 'amount_inr' column")
    )
    named = named.withColumn("problem", problem)
    # A file without rows is one row that has no row_no.
    below = F.when(F.col("problem").isNull(), F.slice("grid", 2, F.greatest(F.size("grid"), F.lit(1))))
    cells = named.select("path", "header", "problem", F.posexplode_outer(below).alias("row_no", "cells"))
    every = imported(cells.withColumn("raw_line", F.array_join("cells", " | ")), zone).drop("header", "cells")
    every = written(every, "ledger-rows") if once else every
    reports = every.groupBy("path").agg(F.count("row_no").alias("n_rows"), F.count_if(F.col("skipped") & F.col("row_no").isNotNull()).alias("n_skipped"), F.max("problem").alias("problem"))
    return every.where("row_no IS NOT NULL").drop("problem"), reports


def imported(rows: DataFrame, zone: str) -> DataFrame:
    """Transactions from read cells (array ``cells``, with the header's names in array ``header``), skipped rows marked.

    A direction that is missing comes from the sign; a category outside the label set is dropped; a stamp without a time
    counts as local noon and is not exact.
    """
    known = ["occurred_at", "amount_inr", "direction", "merchant", "category", "category_source", "channel", "account_tail", "reference", "balance_inr"]
    read = lambda name: F.nullif(X.trimmed(F.get("cells", (F.array_position("header", name) - 1).cast("int"))), F.lit(""))
    cut = rows.select("*", *[read(n).alias(f"__{n}") for n in known])
    cell = lambda name: F.col(f"__{name}")
    stamp, paise = cell("occurred_at"), X.signed_paise(cell("amount_inr"))
    exact = F.coalesce(*[F.try_to_timestamp(F.concat(F.regexp_replace(stamp, "T", " "), F.lit(tail))) for tail in (":00", "")])
    local = F.when(stamp.rlike(r"\d:\d"), F.unix_millis(F.coalesce(exact)))
    way = F.upper(cell("direction"))
    out = cut.select(
        *rows.columns, F.coalesce(X.from_local_ms(local, zone), X.from_local_ms(X.day_ms(X.file_day(stamp)) + R.DAY_MS // 2, zone)).alias("occurred_at"), local.isNotNull().alias("exact_time"),
        F.abs(paise).alias("amount_paise"), F.when(way.isin("DEBIT", "CREDIT"), way).otherwise(F.when(paise < 0, "DEBIT").otherwise("CREDIT")).alias("direction"),
        cell("merchant").alias("merchant_raw"), F.nullif(X.merchant_key(cell("merchant")), F.lit("")).alias("merchant_norm"), X.ref_key(cell("reference")).alias("ref_no"), cell("account_tail").alias("account_tail"),
        X.one_of(F.upper(cell("channel")), "channel").alias("channel"), X.signed_paise(cell("balance_inr")).alias("balance_paise"),
        F.when(cell("category").isin(R.CATEGORIES), cell("category")).alias("category"), F.when(F.upper(cell("category_source")).isin(R.CATEGORY_SOURCES), F.upper(cell("category_source"))).alias("category_source"),
    )
    return out.withColumn("skipped", F.col("occurred_at").isNull() | F.coalesce(F.col("amount_paise"), F.lit(0)).eqNullSafe(0))
