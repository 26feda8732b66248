"""Spending net of reimbursements, in whole paise.

What a counterparty paid back is set off against what was spent with it, up to the amount spent. A counterparty's offset is
shared over its categories in proportion, largest first, rounded down; the last takes what is left. Net per category is not
below 0. Debits without a counterparty are never set off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sides(txns: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Debits by (keys, merchant, category) and refunds by (keys, merchant); deliberate income is no refund."""
    debits = txns.where("direction = 'DEBIT'").groupBy(*keys, "merchant_norm", "category").agg(F.sum("amount_paise").alias("paise"))
    income = (F.col("category") == "Income") & F.col("category_source").isin("USER", "MEMORY")
    named = F.coalesce(F.col("merchant_norm"), F.lit("")) != ""
    credits = txns.where((F.col("direction") == "CREDIT") & ~income & named).groupBy(*keys, "merchant_norm").agg(F.sum("amount_paise").alias("credited"))
    return debits, credits


def set_off(debits: DataFrame, credits: DataFrame, keys: list[str]) -> DataFrame:
    """Debits with ``offset``: the part that each (merchant, category) row gets back."""
    by = Window.partitionBy(*keys, "merchant_norm")
    ordered = by.orderBy(F.col("paise").desc(), "category")
    both = debits.join(credits, [*keys, "merchant_norm"], "left")
    both = both.withColumns({"paid": F.sum("paise").over(by), "at": F.row_number().over(ordered), "n": F.count("*").over(by)})
    total = F.when((F.trim(F.coalesce("merchant_norm", F.lit(""))) != "") & F.col("credited").isNotNull(), F.greatest(F.least("paid", "credited"), F.lit(0))).otherwise(0).cast("bigint")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    share = F.when((F.col("total") > 0) & (F.col("at") < F.col("n")), F.call_function("div", wide("total") * wide("paise"), wide("paid"))).otherwise(0).cast("bigint")
    shared = both.withColumn("total", total).withColumn("share", share)
    offset = F.when((F.col("total") > 0) & (F.col("at") == F.col("n")), F.col("total") - F.sum("share").over(by)).otherwise(F.col("share"))
    return shared.select(*keys, "merchant_norm", "category", "paise", offset.cast("bigint").alias("offset"))


def by_category(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "category").agg(F.greatest(F.sum("paise") - F.sum("offset"), F.lit(0)).cast("bigint").alias("net"))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """gross, reimbursed and net."""
    out = rows.groupBy(*keys).agg(F.sum("paise").cast("bigint").alias("gross"), F.sum("offset").cast("bigint").alias("reimbursed"))
    return out.withColumn("net", F.col("gross") - F.col("reimbursed"))


def netted(txns: DataFrame, keys: list[str]) -> DataFrame:
    return set_off(*sides(txns, keys), keys)
