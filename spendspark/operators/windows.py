"""Calendar windows around an explicit ``now`` in an explicit zone; ranges are inclusive milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X


def windows(spark: SparkSession, now_ms: int, zone: str) -> DataFrame:
    """window, from_ms, to_ms for the five windows; always five rows."""
    now = F.lit(now_ms).cast("bigint")
    today = X.local_day(now, zone)
    at = lambda day: X.from_local_ms(X.day_ms(day), zone)
    monday, first = F.date_sub(today, F.weekday(today)), F.trunc(today, "month")
    rows = [
        ("LAST_24H", now - R.DAY_MS, now),
        ("THIS_WEEK", at(monday), now),
        ("LAST_WEEK", at(F.date_sub(monday, 7)), at(monday) - 1),
        ("THIS_MONTH", at(first), now),
        ("LAST_MONTH", at(F.add_months(first, -1).cast("date")), at(first) - 1),
    ]
    one = F.array(*[F.struct(F.lit(n).alias("window"), a.cast("bigint").alias("from_ms"), b.cast("bigint").alias("to_ms")) for n, a, b in rows])
    return spark.range(1).select(F.inline(one))


def in_windows(txns: DataFrame, spans: DataFrame) -> DataFrame:
    """Each transaction once for each window that holds it. ``spans`` is a handful of rows; their outer bounds prune the scan."""
    bounds = spans.agg(F.min("from_ms").alias("a"), F.max("to_ms").alias("b")).first()
    spans = F.broadcast(spans)  # five rows, whatever the data
    return txns.where(F.col("occurred_at").between(bounds.a, bounds.b)).join(spans, F.col("occurred_at").between(F.col("from_ms"), F.col("to_ms"))).drop("from_ms", "to_ms")


def daily_series(txns: DataFrame, now_ms: int, days: int, zone: str) -> DataFrame:
    """day and total of debits for the last ``days`` local days up to now, days without spending as 0."""
    today = X.local_day(F.lit(now_ms).cast("bigint"), zone)
    spark = txns.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    start = X.from_local_ms(X.day_ms(F.date_sub(today, days - 1)), zone)
    spent = txns.where((F.col("direction") == "DEBIT") & F.col("occurred_at").between(start, F.lit(now_ms))).groupBy(X.local_day(F.col("occurred_at"), zone).alias("day")).agg(F.sum("amount_paise").alias("total"))
    return calendar.join(F.broadcast(spent), "day", "left").select("day", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))  # one row for each of ``days``


def bucketed(series: DataFrame, buckets: int = 10) -> DataFrame:
    """bucket and total: runs of ceil(n / buckets) days summed, in order."""
    from pyspark.sql import Window

    numbered = series.select("total", (F.row_number().over(Window.orderBy("day")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    return numbered.groupBy(F.floor(F.col("i") / F.ceil(F.col("n") / buckets)).cast("int").alias("bucket")).agg(F.sum("total").cast("bigint").alias("total"))
