"""Questions about a ledger: sums, breakdowns, lists, reviews, updates. All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import netting
from spendspark.operators.windows import in_windows, windows


def between(txns: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return txns.where(F.col("occurred_at").between(from_ms, to_ms))


def _sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def sum_in(txns: DataFrame, from_ms: int, to_ms: int, direction: str, category: str | None = None) -> DataFrame:
    """One row, 0 for nothing."""
    rows = between(txns, from_ms, to_ms).where(F.col("direction") == direction)
    return (rows if category is None else rows.where(F.col("category") == category)).agg(_sum("amount_paise").alias("total"))


def counts(txns: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """All counts of a ledger in one pass."""
    one = lambda c: F.count_if(c)
    return txns.agg(
        F.count("*").alias("n_all"), one(F.col("occurred_at").between(from_ms, to_ms)).alias("n_in"), one(F.col("needs_review")).alias("n_review"),
        one(F.col("category_source") == "USER").alias("n_confirmed"),
    )


def top_categories(txns: DataFrame, from_ms: int, to_ms: int, direction: str, limit: int) -> DataFrame:
    rows = between(txns, from_ms, to_ms).where(F.col("direction") == direction)
    return rows.groupBy("category").agg(_sum("amount_paise").alias("total"), F.count("*").alias("n")).orderBy(F.col("total").desc(), "category").limit(limit)


def by_account(txns: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Spending per account (null kept), how often a card was used, and which of both it mostly is."""
    rows = between(txns, from_ms, to_ms).where("direction = 'DEBIT'").groupBy("account_tail")
    out = rows.agg(_sum("amount_paise").alias("total"), F.count("*").alias("n"), F.count_if(F.col("channel") == "CARD").alias("n_card"))
    return out.withColumn("kind", F.when(F.col("n_card") * 2 >= F.col("n"), "card").otherwise("account"))


def daily_totals(txns: DataFrame, from_ms: int, to_ms: int, zone: str) -> DataFrame:
    rows = between(txns, from_ms, to_ms).where("direction = 'DEBIT'")
    return rows.groupBy(X.local_day(F.col("occurred_at"), zone).alias("day")).agg(_sum("amount_paise").alias("total"))


def share_of_largest(rows: DataFrame) -> DataFrame:
    """Adds ``share``: total over the largest total, which counts as 1 at least. ``rows`` is one row for a category."""
    return rows.withColumn("share", F.col("total") / F.greatest(F.max("total").over(Window.partitionBy()), F.lit(1)))


def summaries(txns: DataFrame, now_ms: int, zone: str) -> DataFrame:
    """One row for each window: net, gross, reimbursed, received, income, number of debits and the largest net category.

    One scan meets the five windows; everything after the first aggregation is as small as merchants times categories.
    """
    spans = windows(txns.sparkSession, now_ms, zone)
    rows = in_windows(txns, spans)
    plain = rows.groupBy("window").agg(
        _sum(F.when(F.col("direction") == "CREDIT", F.col("amount_paise"))).alias("received"),
        _sum(F.when((F.col("direction") == "CREDIT") & (F.col("category") == "Income"), F.col("amount_paise"))).alias("income"),
        F.count_if(F.col("direction") == "DEBIT").alias("n_debits"),
    )
    net = netting.netted(rows, ["window"])
    best = netting.by_category(net, ["window"]).where("net > 0").groupBy("window").agg(F.min(F.struct((-F.col("net")).alias("k"), F.col("category").alias("c"))).alias("b"))
    out = spans.select("window").join(plain, "window", "left").join(netting.totals(net, ["window"]), "window", "left").join(best, "window", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("window", *[zero(c) for c in ("net", "gross", "reimbursed", "received", "income", "n_debits")], F.col("b.c").alias("top_category"))


def net_top_categories(txns: DataFrame, from_ms: int, to_ms: int, limit: int) -> DataFrame:
    """Largest net categories above 0 with their numbers of debits."""
    rows = between(txns, from_ms, to_ms)
    counted = rows.where("direction = 'DEBIT'").groupBy("category").agg(F.count("*").alias("n"))
    net = netting.by_category(netting.netted(rows, []), []).where("net > 0")
    return net.join(counted, "category", "left").select("category", "net", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.col("net").desc(), "category").limit(limit)


def month_figures(txns: DataFrame, now_ms: int, zone: str) -> DataFrame:
    """What this month saved, and net spending for each day of it so far (whole paise, one day at least)."""
    day = F.greatest(F.dayofmonth(X.local_day(F.lit(now_ms).cast("bigint"), zone)), F.lit(1))
    month = summaries(txns, now_ms, zone).where("window = 'THIS_MONTH'")
    return month.select((F.col("income") - F.col("net")).alias("saved"), F.call_function("div", F.col("net"), day).alias("per_day"))


def search(txns: DataFrame, raw: DataFrame, query: str, limit: int) -> DataFrame:
    """Newest first where merchant (key or raw) or category holds the text ('%' and '_' are wildcards); with the source of the message."""
    q = query.strip()
    hit = F.lit(q == "") | F.col("category").ilike(f"%{q}%")
    for name in ("merchant_norm", "merchant_raw"):
        if name in txns.columns:
            hit = hit | F.coalesce(F.col(name).ilike(f"%{q}%"), F.lit(False))
    top = txns.where(hit).orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(limit)
    return top.join(raw.select(F.col("id").alias("raw_id"), "source"), "raw_id", "left")


def recent(txns: DataFrame, limit: int) -> DataFrame:
    return txns.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(limit)


def review_queue(txns: DataFrame, limit: int) -> DataFrame:
    return recent(txns.where("needs_review"), limit)


def reject_breakdown(messages: DataFrame) -> DataFrame:
    return messages.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def relabelled(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Applies confirmed categories (merchant_norm, category) to all rows of a merchant that no user has set."""
    c = corrections.select("merchant_norm", F.col("category").alias("__new"))
    hit = F.col("__new").isNotNull() & (F.col("category_source") != "USER")
    return txns.join(c, "merchant_norm", "left").select(
        *[x for x in txns.columns if x not in ("category", "category_source", "needs_review")],
        F.when(hit, F.col("__new")).otherwise(F.col("category")).alias("category"),
        F.when(hit, "MEMORY").otherwise(F.col("category_source")).alias("category_source"),
        (F.col("needs_review") & ~hit).alias("needs_review"),
    )


def upserted(store: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the latest version for each key; at equal versions the new one."""
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in store.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merged_conflicts(versions: DataFrame) -> DataFrame:
    """One version for each client_id: a user's over a dashboard's unless that is later, over a remote one, over the rest; then the latest."""
    latest_user = F.max(F.when(F.col("source") == "USER", F.col("updated_at"))).over(Window.partitionBy("client_id"))
    rank = F.when(F.col("source") == "USER", 3).when(F.col("source") == "DASHBOARD", F.when(F.col("updated_at") > F.coalesce(latest_user, F.lit(-1)), 4).otherwise(2)).when(F.col("source") == "REMOTE", 1).otherwise(0)
    return versions.withColumn("rank", rank).groupBy("client_id").agg(F.max_by(F.struct("category", "source"), F.struct("rank", "updated_at", "category")).alias("r")).select("client_id", "r.category", "r.source")


def located(txns: DataFrame, fixes: DataFrame) -> DataFrame:
    """The last fix at or before each transaction, its age and confidence: a pass over both, sorted per user and day, behind
    the last fix of the days before. So a user with a long history is many groups.

    txns: id, user_id, occurred_at; fixes: user_id, recorded_at, place.
    """
    both = txns.select("user_id", F.col("occurred_at").alias("at"), F.lit(1).alias("side"), "id", F.lit(None).cast("string").alias("place")).unionByName(
        fixes.select("user_id", F.col("recorded_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("id"), "place")
    )
    both = both.withColumn("day", F.floor(F.col("at") / R.DAY_MS))
    own = F.when(F.col("side") == 0, F.struct("at", "place"))
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("user_id", "day").agg(F.max(own).alias("fix")).withColumn("carried", F.last("fix", ignorenulls=True).over(earlier)).drop("fix")
    before = Window.partitionBy("user_id", "day").orderBy("at", "side", "place").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("fix", F.last(own, ignorenulls=True).over(before)).where("side = 1").join(days, ["user_id", "day"]).withColumn("fix", F.coalesce("fix", "carried"))
    age = F.col("at") - F.col("fix.at")
    return out.select("id", F.col("fix.place").alias("place"), age.alias("age_ms"), X.location_confidence(age).alias("confidence"))
