"""Queries over the benchmark tables, one for each operator or tight group, with DuckDB SQL where it can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import classify, dedupe, netting, parse, spend
from spendspark.operators.windows import bucketed, daily_series, windows
from spendspark.plans import adapter as A
from spendspark.plans.registry import QUERIES, SQL
from spendspark.plans.registry import query as _query

__all__ = ["QUERIES", "SQL"]

NOW, LATER, ZONE = A.NOW_MS, A.LATER_MS, A.ZONE
FROM, TO = NOW - 10 * R.DAY_MS, NOW

_L, _IN = f"WITH {A.LIVE_SQL} ", f"occurred_at BETWEEN {FROM} AND {TO}"
_DAY = "CAST(make_timestamp(occurred_at * 1000) AS DATE)"


@_query("q_sum_in", _L + f"SELECT CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS total FROM live WHERE {_IN} AND direction = 'DEBIT'")
def sum_in(spark, d):
    return spend.sum_in(A.live_ledger(spark, d), FROM, TO, "DEBIT")


@_query("q_sum_category_in", _L + f"SELECT CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS total FROM live WHERE {_IN} AND direction = 'DEBIT' AND category = 'Groceries'")
def sum_category_in(spark, d):
    return spend.sum_in(A.live_ledger(spark, d), FROM, TO, "DEBIT", "Groceries")


@_query("q_counts", _L + f"SELECT count(*) AS n_all, count(*) FILTER ({_IN}) AS n_in, count(*) FILTER (needs_review) AS n_review, count(*) FILTER (category_source = 'USER') AS n_confirmed FROM live")
def counts(spark, d):
    return spend.counts(A.live_ledger(spark, d), FROM, TO)


@_query("q_top_categories", _L + f"SELECT category, CAST(sum(amount_paise) AS BIGINT) AS total, count(*) AS n FROM live WHERE {_IN} AND direction = 'DEBIT' GROUP BY category ORDER BY total DESC, category LIMIT 5")
def top_categories(spark, d):
    return spend.top_categories(A.live_ledger(spark, d), FROM, TO, "DEBIT", 5)


_ACCOUNT = f"SELECT account_tail, CAST(sum(amount_paise) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (channel = 'CARD') AS n_card FROM live WHERE {_IN} AND direction = 'DEBIT' GROUP BY account_tail"


@_query("q_spend_by_account", _L + f"SELECT *, CASE WHEN n_card * 2 >= n THEN 'card' ELSE 'account' END AS kind FROM ({_ACCOUNT})")
def by_account(spark, d):
    return spend.by_account(A.live_ledger(spark, d), FROM, TO)


@_query("q_daily_totals", _L + f"SELECT {_DAY} AS day, CAST(sum(amount_paise) AS BIGINT) AS total FROM live WHERE {_IN} AND direction = 'DEBIT' GROUP BY 1")
def daily_totals(spark, d):
    return spend.daily_totals(A.live_ledger(spark, d), FROM, TO, ZONE)


@_query("q_share_of_max", _L + f"SELECT category, total, total / greatest(max(total) OVER (), 1) AS share FROM (SELECT category, CAST(sum(amount_paise) AS BIGINT) AS total FROM live WHERE direction = 'DEBIT' GROUP BY category)")
def share_of_max(spark, d):
    rows = A.live_ledger(spark, d).where("direction = 'DEBIT'").groupBy("category").agg(F.sum("amount_paise").alias("total"))
    return spend.share_of_largest(rows)


@_query("q_debits_by_merchant", _L + f"SELECT merchant_norm, category, CAST(sum(amount_paise) AS BIGINT) AS paise FROM live WHERE {_IN} AND direction = 'DEBIT' GROUP BY ALL")
def debits_by_merchant(spark, d):
    return netting.sides(spend.between(A.live_ledger(spark, d), FROM, TO), [])[0]


_REFUNDS = "direction = 'CREDIT' AND NOT (category = 'Income' AND category_source IN ('USER', 'MEMORY')) AND coalesce(merchant_norm, '') <> ''"


@_query("q_refunds_by_merchant", _L + f"SELECT merchant_norm, CAST(sum(amount_paise) AS BIGINT) AS credited FROM live WHERE {_IN} AND {_REFUNDS} GROUP BY ALL")
def refunds_by_merchant(spark, d):
    return netting.sides(spend.between(A.live_ledger(spark, d), FROM, TO), [])[1]


def _windows_sql(now: int) -> str:
    t = f"(SELECT make_timestamp({now} * 1000) AS now)"
    ms = "epoch_ms"
    return f"""spans AS (SELECT unnest([
  {{'window': 'LAST_24H', 'from_ms': {now} - 86400000, 'to_ms': {now}}}, {{'window': 'THIS_WEEK', 'from_ms': {ms}(date_trunc('week', now)), 'to_ms': {now}}},
  {{'window': 'LAST_WEEK', 'from_ms': {ms}(date_trunc('week', now) - INTERVAL 7 DAY), 'to_ms': {ms}(date_trunc('week', now)) - 1}},
  {{'window': 'THIS_MONTH', 'from_ms': {ms}(date_trunc('month', now)), 'to_ms': {now}}},
  {{'window': 'LAST_MONTH', 'from_ms': {ms}(date_trunc('month', now) - INTERVAL 1 MONTH), 'to_ms': {ms}(date_trunc('month', now)) - 1}}], recursive := true) FROM {t})"""


@_query("q_window_ranges", f"WITH {_windows_sql(LATER)} SELECT \"window\", CAST(from_ms AS BIGINT) AS from_ms, CAST(to_ms AS BIGINT) AS to_ms FROM spans")
def window_ranges(spark, d):
    return windows(spark, LATER, ZONE)


def _netting_sql(rows: str, keys: str) -> str:
    """CTEs ``off`` (keys, merchant_norm, category, paise, offset) over a CTE ``rows``."""
    k = f"{keys}, " if keys else ""
    join = " AND ".join(f"p.{x} = c.{x}" for x in [*([keys] if keys else []), "merchant_norm"])
    return f"""deb AS (SELECT {k}merchant_norm, category, sum(amount_paise) AS paise FROM {rows} WHERE direction = 'DEBIT' GROUP BY ALL),
cred AS (SELECT {k}merchant_norm, sum(amount_paise) AS credited FROM {rows} WHERE {_REFUNDS} GROUP BY ALL),
paid AS (SELECT *, sum(paise) OVER w AS paid, count(*) OVER w AS n, row_number() OVER (PARTITION BY {k}merchant_norm ORDER BY paise DESC, category) AS pos FROM deb WINDOW w AS (PARTITION BY {k}merchant_norm)),
met AS (SELECT p.*, CASE WHEN credited IS NULL THEN 0 ELSE least(paid, credited) END AS total FROM paid p LEFT JOIN cred c ON {join}),
shares AS (SELECT *, CASE WHEN total > 0 AND pos < n THEN (total * paise) // paid ELSE 0 END AS share FROM met),
off AS (SELECT {k}merchant_norm, category, paise, CASE WHEN total > 0 AND pos = n THEN total - sum(share) OVER (PARTITION BY {k}merchant_norm) ELSE share END AS "offset" FROM shares)"""


_NET = _L + f", inn AS (SELECT * FROM live WHERE {_IN}), " + _netting_sql("inn", "")


@_query("q_netting_totals", _NET + ' SELECT CAST(sum(paise) AS BIGINT) AS gross, CAST(sum("offset") AS BIGINT) AS reimbursed, CAST(sum(paise) - sum("offset") AS BIGINT) AS net FROM off')
def netting_totals(spark, d):
    return netting.totals(netting.netted(spend.between(A.live_ledger(spark, d), FROM, TO), []), [])


_BYCAT = 'SELECT category, CAST(greatest(sum(paise) - sum("offset"), 0) AS BIGINT) AS net FROM off GROUP BY category'


@_query("q_netting_by_category", _NET + " " + _BYCAT)
def netting_by_category(spark, d):
    return netting.by_category(netting.netted(spend.between(A.live_ledger(spark, d), FROM, TO), []), [])


@_query("q_net_top_categories", _NET + f", cnt AS (SELECT category, count(*) AS n FROM inn WHERE direction = 'DEBIT' GROUP BY category) SELECT b.category, net, coalesce(n, 0) AS n FROM ({_BYCAT}) b LEFT JOIN cnt USING (category) WHERE net > 0 ORDER BY net DESC, b.category LIMIT 5")
def net_top_categories(spark, d):
    return spend.net_top_categories(A.live_ledger(spark, d), FROM, TO, 5)


def _summary_sql(now: int) -> str:
    return (
        _L + f", {_windows_sql(now)}, rows_ AS (SELECT live.*, \"window\" AS w FROM live JOIN spans ON occurred_at BETWEEN from_ms AND to_ms), " + _netting_sql("rows_", "w")
        + """, tot AS (SELECT w, sum(paise) AS gross, sum("offset") AS reimbursed FROM off GROUP BY w),
cat AS (SELECT w, category, greatest(sum(paise) - sum("offset"), 0) AS net FROM off GROUP BY w, category),
best AS (SELECT w, category AS top_category FROM cat WHERE net > 0 QUALIFY row_number() OVER (PARTITION BY w ORDER BY net DESC, category) = 1),
plain AS (SELECT w, sum(CASE WHEN direction = 'CREDIT' THEN amount_paise END) AS received, sum(CASE WHEN direction = 'CREDIT' AND category = 'Income' THEN amount_paise END) AS income, count(*) FILTER (direction = 'DEBIT') AS n_debits FROM rows_ GROUP BY w),
summary AS (SELECT "window", CAST(coalesce(gross - reimbursed, 0) AS BIGINT) AS net, CAST(coalesce(gross, 0) AS BIGINT) AS gross, CAST(coalesce(reimbursed, 0) AS BIGINT) AS reimbursed, CAST(coalesce(received, 0) AS BIGINT) AS received,
  CAST(coalesce(income, 0) AS BIGINT) AS income, coalesce(n_debits, 0) AS n_debits, top_category FROM spans LEFT JOIN plain p ON p.w = "window" LEFT JOIN tot t ON t.w = "window" LEFT JOIN best b ON b.w = "window")"""
    )


@_query("q_all_summaries", _summary_sql(NOW) + " SELECT * FROM summary")
def all_summaries(spark, d):
    return spend.summaries(A.live_ledger(spark, d), NOW, ZONE)


@_query("q_all_summaries_next_month", _summary_sql(LATER) + " SELECT * FROM summary")
def later_summaries(spark, d):
    return spend.summaries(A.live_ledger(spark, d), LATER, ZONE)


@_query("q_month_figures", _summary_sql(NOW) + f" SELECT income - net AS saved, CAST(trunc(net / greatest(day(make_timestamp({NOW} * 1000)), 1)) AS BIGINT) AS per_day FROM summary WHERE \"window\" = 'THIS_MONTH'")
def month_figures(spark, d):
    return spend.month_figures(A.live_ledger(spark, d), NOW, ZONE)


_SERIES = _L + f""", series AS (SELECT CAST(c.day AS DATE) AS day, CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS total
  FROM generate_series(date_trunc('day', make_timestamp({NOW} * 1000)) - INTERVAL 29 DAY, make_timestamp({NOW} * 1000), INTERVAL 1 DAY) c(day)
  LEFT JOIN live ON {_DAY} = CAST(c.day AS DATE) AND direction = 'DEBIT' AND occurred_at <= {NOW} GROUP BY 1)"""


@_query("q_daily_series", _SERIES + " SELECT * FROM series")
def series(spark, d):
    return daily_series(A.live_ledger(spark, d), NOW, 30, ZONE)


@_query("q_sparkline_buckets", _SERIES + " SELECT CAST(i // 3 AS INTEGER) AS bucket, CAST(sum(total) AS BIGINT) AS total FROM (SELECT total, row_number() OVER (ORDER BY day) - 1 AS i FROM series) GROUP BY 1")
def sparkline(spark, d):
    return bucketed(daily_series(A.live_ledger(spark, d), NOW, 30, ZONE))


_COLS = "id, occurred_at, amount_paise, merchant_norm, category"


@_query("q_search", _L + f"SELECT {_COLS}, CASE WHEN raw_id % 5 = 0 THEN NULL WHEN raw_id % 2 = 0 THEN 'SMS' ELSE 'STATEMENT' END AS source FROM (SELECT * FROM live WHERE coalesce(merchant_norm ILIKE '%user 1%', false) OR category ILIKE '%user 1%' OR 'PAY*USER ' || CAST(id % 30 AS VARCHAR) ILIKE '%user 1%' ORDER BY occurred_at DESC, id DESC LIMIT 500)")
def search(spark, d):
    raw = spark.range(997).where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, "SMS").otherwise("STATEMENT").alias("source"))
    txns = A.live_ledger(spark, d).withColumn("merchant_raw", F.concat(F.lit("PAY*USER "), (F.col("id") % 30).cast("string")))
    return spend.search(txns, raw, " USER 1 ", 500).select("id", "occurred_at", "amount_paise", "merchant_norm", "category", "source")


@_query("q_recent", _L + f"SELECT {_COLS} FROM live ORDER BY occurred_at DESC, id DESC LIMIT 100")
def recent(spark, d):
    return spend.recent(A.live_ledger(spark, d), 100).select(*_COLS.split(", "))


@_query("q_review_queue", _L + f"SELECT {_COLS} FROM live WHERE needs_review ORDER BY occurred_at DESC, id DESC LIMIT 200")
def review_queue(spark, d):
    return spend.review_queue(A.live_ledger(spark, d), 200).select(*_COLS.split(", "))


@_query("q_relabel_merchant", _L + """SELECT id, merchant_norm, CASE WHEN hit THEN 'Travel' ELSE category END AS category, CASE WHEN hit THEN 'MEMORY' ELSE category_source END AS category_source, needs_review AND NOT hit AS needs_review
  FROM (SELECT *, coalesce(merchant_norm IN ('user 3', 'user 7'), false) AND category_source <> 'USER' AS hit FROM live)""")
def relabel(spark, d):
    fixes = spark.createDataFrame([("user 3", "Travel"), ("user 7", "Travel")], "merchant_norm string, category string")
    return spend.relabelled(A.live_ledger(spark, d), fixes).select("id", "merchant_norm", "category", "category_source", "needs_review")


@_query("q_upsert_memory", _L + """SELECT merchant_norm, arg_max(category, occurred_at * 1000000 + id) AS category, max(occurred_at * 1000000 + id) AS updated_at FROM live WHERE merchant_norm IS NOT NULL GROUP BY merchant_norm""")
def upsert(spark, d):
    rows = A.live_ledger(spark, d).where("merchant_norm IS NOT NULL").select("merchant_norm", "category", (F.col("occurred_at") * 1_000_000 + F.col("id")).alias("updated_at"), "id")
    return spend.upserted(rows.where("id % 2 = 0").drop("id"), rows.where("id % 2 = 1").drop("id"), "merchant_norm", "updated_at")


_VERSIONS = "SELECT user_id AS client_id, CASE event_id % 4 WHEN 0 THEN 'USER' WHEN 1 THEN 'DASHBOARD' WHEN 2 THEN 'REMOTE' ELSE 'MODEL' END AS source, event_id AS updated_at, 'c' || CAST(event_id % 15 AS VARCHAR) AS category FROM events"


@_query("q_conflict_merge", f"""WITH v AS ({_VERSIONS}), r AS (SELECT *, CASE source WHEN 'USER' THEN 3 WHEN 'DASHBOARD' THEN CASE WHEN updated_at > coalesce(max(CASE WHEN source = 'USER' THEN updated_at END) OVER (PARTITION BY client_id), -1) THEN 4 ELSE 2 END WHEN 'REMOTE' THEN 1 ELSE 0 END AS rank FROM v)
SELECT client_id, category, source FROM r QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY rank DESC, updated_at DESC) = 1""")
def conflict_merge(spark, d):
    e, i = A.table(spark, d, "events"), F.col("event_id")
    v = e.select(F.col("user_id").alias("client_id"), F.get(F.array(*map(F.lit, ["USER", "DASHBOARD", "REMOTE", "MODEL"])), (i % 4).cast("int")).alias("source"), i.alias("updated_at"), F.concat(F.lit("c"), (i % 15).cast("string")).alias("category"))
    return spend.merged_conflicts(v)


@_query("q_location_asof", """WITH t AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS tm FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, epoch_us(ts) // 1000 AS tm, CAST(event_id AS VARCHAR) AS place FROM events WHERE event_type = 'view'),
 j AS (SELECT id, t.tm AS tm, arg_max(place, (f.tm, place)) AS place, max(f.tm) AS fixed FROM t LEFT JOIN f ON f.user_id = t.user_id AND f.tm <= t.tm GROUP BY id, t.tm)
 SELECT id, place, tm - fixed AS age_ms, CASE WHEN fixed IS NULL THEN 'NONE' WHEN tm - fixed <= 120000 THEN 'HIGH' WHEN tm - fixed <= 600000 THEN 'MEDIUM' WHEN tm - fixed <= 3600000 THEN 'LOW' ELSE 'NONE' END AS confidence FROM j""")
def location_asof(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", A.epoch_ms(F.col("ts")).alias("at"), "event_type")
    fixes = e.where("event_type = 'view'").select("user_id", F.col("at").alias("recorded_at"), F.col("id").cast("string").alias("place"))
    return spend.located(e.where("event_type = 'purchase'").withColumnRenamed("at", "occurred_at"), fixes)


_FIELDS = ["reject_reason", "amount_paise", "direction", "channel", "account_tail", "ref_no", "merchant_norm", "balance_paise", "vpa_handle", "occurred_at"]


@_query("q_parse_messages", f"WITH {A.expected_sql()} SELECT id, {', '.join(_FIELDS)} FROM expected")
def parse_messages(spark, d):
    return parse.parsed(A.messages(spark, d), ZONE).select("id", *_FIELDS)


@_query("q_reject_breakdown", f"WITH {A.expected_sql()} SELECT reject_reason, count(*) AS n FROM expected WHERE reject_reason IS NOT NULL GROUP BY ALL")
def reject_breakdown(spark, d):
    return spend.reject_breakdown(parse.parsed(A.messages(spark, d), ZONE))


@_query("q_fingerprint_dedupe", """SELECT sha256(lower(trim(CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END)) || '|' || CASE WHEN doc_id % 13 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END || '|' || CAST(doc_id % 3 AS VARCHAR)) AS fingerprint, min(doc_id) AS seq FROM documents GROUP BY 1""")
def fingerprints(spark, d):
    i = F.col("doc_id")
    came = (i % 3) * R.DAY_MS + (i * 7919) % R.DAY_MS
    docs = A.table(spark, d, "documents").select(parse.fingerprint(F.when(i % 11 != 0, F.col("source")), F.when(i % 13 != 0, F.col("text")), came).alias("fingerprint"), i.alias("seq"))
    return dedupe.first_of(docs, "fingerprint")


@_query("q_ref_dedupe", _L + "SELECT min(id) AS id, ref_no FROM live WHERE ref_no IS NOT NULL GROUP BY ref_no UNION ALL SELECT id, ref_no FROM live WHERE ref_no IS NULL")
def ref_dedupe(spark, d):
    return dedupe.first_of(A.live_ledger(spark, d).select("id", X.ref_key(F.col("ref_no")).alias("ref_no")), "ref_no", "id")


_NEAR = A.greedy_sql("n")


@_query("q_near_duplicate", f"WITH RECURSIVE {A.LIVE_SQL}, n AS (SELECT id, id AS ord, amount_paise // 1000 * 1000 AS p, direction AS w, account_tail AS tail, occurred_at AS moment, id % 8 = 0 AND ref_no IS NOT NULL AS pinned FROM live), {_NEAR} SELECT id, kept FROM greedy")
def near_duplicate(spark, d):
    rows = A.live_ledger(spark, d)
    return dedupe.near_duplicates(rows.select("id", F.col("id").alias("seq"), (F.floor(F.col("amount_paise") / 1000) * 1000).alias("amount_paise"), "direction", "account_tail", "occurred_at", F.when(F.col("id") % 8 == 0, F.col("ref_no")).alias("ref_no")))


_BYDAY = "PARTITION BY day, amount_paise, direction, coalesce(account_tail, '-') ORDER BY id"


@_query("q_occurrence_number", f"WITH {A.STATEMENT_SQL} SELECT *, CAST(row_number() OVER ({_BYDAY}) AS INTEGER) AS occurrence FROM stmt")
def occurrence(spark, d):
    return dedupe.occurrence_numbers(A.statement_ledger(spark, d))


@_query("q_same_day_occurrence", f"""WITH RECURSIVE {A.STATEMENT_SQL}, s AS (SELECT * FROM stmt WHERE id % 3 = 0),
f AS (SELECT *, CAST(row_number() OVER ({_BYDAY}) AS INTEGER) AS occurrence, row_number() OVER (PARTITION BY day, amount_paise, direction ORDER BY id) AS k,
  (SELECT count(*) FROM s WHERE s.day = stmt.day AND s.amount_paise = stmt.amount_paise AND s.direction = stmt.direction AND (stmt.account_tail IS NULL OR s.account_tail IS NULL OR s.account_tail = stmt.account_tail)) AS stored FROM stmt WHERE id % 3 <> 0),
run AS (SELECT id, day, amount_paise, direction, k, stored < occurrence AS kept, CASE WHEN stored < occurrence THEN [coalesce(account_tail, '-')] ELSE [] END AS held FROM f WHERE k = 1
  UNION ALL SELECT id, day, amount_paise, direction, k, kept, CASE WHEN kept THEN list_append(held, coalesce(account_tail, '-')) ELSE held END FROM (SELECT f.*, run.held,
    f.stored + len(list_filter(run.held, lambda t: f.account_tail IS NULL OR t = '-' OR t = f.account_tail)) < f.occurrence AS kept FROM run JOIN f ON f.day = run.day AND f.amount_paise = run.amount_paise AND f.direction = run.direction AND f.k = run.k + 1))
SELECT f.id, f.day, f.amount_paise, f.direction, f.account_tail, f.occurrence FROM f JOIN run ON run.id = f.id WHERE kept""")
def same_day(spark, d):
    rows = A.statement_ledger(spark, d)
    return dedupe.same_day_new(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"))


_C = "(SELECT c_custkey AS id, c_name, c_acctbal FROM customer)"


_TAILS = ["", " Pvt Ltd", " PRIVATE LIMITED INDIA", " Limited India Bangalore", " Ltd Inc India Chennai", " pvt. ltd", " pvt. ltd co", " LLP Mumbai 12345", " pvt. ltd limited", "*India", "-Corp", " Private Ltd Pune Delhi"]
#: What is left of each ending: digits behind a suffix shield it, and "ltd" goes before "pvt. ltd" where "limited" went first.
_LEFT = ["", "", "", "", "", "", "", " llp mumbai", " pvt.", "", "", ""]
_HEADS, _KEPT = ["", "Mr ", "MRS ", "Mr. ", " smt  "], ["", "", "", "mr. ", ""]


@_query("q_merchant_norm", f"""SELECT id, CASE WHEN id % 7 = 0 THEN 'green.mart' ELSE {A._case(_KEPT, '((id // 12) % 5)')} || 'corner shop' || {A._case(_LEFT, '(id % 12)')} END AS merchant_norm,
  CASE WHEN id % 7 = 0 THEN 'Green.mart' ELSE CASE WHEN (id // 12) % 5 = 3 THEN 'Mr. ' ELSE '' END || 'Corner Shop' || CASE id % 12 WHEN 7 THEN ' Llp Mumbai' WHEN 8 THEN ' Pvt.' ELSE '' END END AS display FROM {_C}""")
def merchant_norm(spark, d):
    i = F.col("c_custkey")
    spelled = F.concat(A._nth(_HEADS, F.floor(i / 12) % 5), F.lit("Corner_SHOP"), A._nth(_TAILS, i % 12))
    rows = A.table(spark, d, "customer").select(i.alias("id"), X.merchant_key(F.when(i % 7 == 0, F.lit("Green.Mart@okbank")).otherwise(spelled)).alias("merchant_norm"))
    return rows.select("id", "merchant_norm", X.display_name(F.col("merchant_norm")).alias("display"))


@_query("q_sender_class", """SELECT id, CASE k WHEN 0 THEN 'BANK' WHEN 1 THEN 'PSP' WHEN 2 THEN 'PERSONAL' ELSE 'UNKNOWN' END AS sender_class FROM (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer)""")
def sender_class(spark, d):
    i = F.col("c_custkey")
    sender = F.get(F.array(F.lit("VM-HDFCBK"), F.lit("ad_PayTM"), F.concat(F.lit("+91 9"), F.lpad((i % 1000000000).cast("string"), 9, "0")), F.lit("AX-ZZTOP")), (i % 4).cast("int"))
    return A.table(spark, d, "customer").select(i.alias("id"), X.sender_class(sender).alias("sender_class"))


@_query("q_rupees", f"SELECT id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS rupees, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS paise FROM {_C}")
def rupees(spark, d):
    paise = F.round(F.col("c_acctbal") * 100).cast("bigint")
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.rupees(paise).alias("rupees"))
    return rows.select("id", "rupees", X.signed_paise(F.concat(F.lit("Rs. "), F.col("rupees"))).alias("paise"))


@_query("q_money_compact", """SELECT o_orderkey AS id, CASE WHEN r >= 1e7 THEN '₹' || CAST(round(CAST(r / 1e7 AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) || 'Cr' WHEN r >= 1e5 THEN '₹' || CAST(round(CAST(r / 1e5 AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) || 'L' WHEN r >= 1e3 THEN '₹' || CAST(round(CAST(r / 1e3 AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) || 'k' ELSE '₹' || CAST(CAST(floor(r + 0.5) AS BIGINT) AS VARCHAR) END AS shown
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) * (o_orderkey % 7 + 1) AS BIGINT) * 100 / 100.0 AS r FROM orders)""")
def money_compact(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.compact_money((F.floor("o_totalprice") * (F.col("o_orderkey") % 7 + 1)).cast("bigint") * 100).alias("shown"))


@_query("q_date_parse", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_parse(spark, d):
    o = A.table(spark, d, "orders")
    formats = ["d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy", "ddMMMyyyy", "yyyy-M-d", "d.M.yyyy"]
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    text = F.get(F.array(*[F.date_format(day, f) for f in formats], serial), (F.col("o_orderkey") % (len(formats) + 1)).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), X.file_day(text).alias("day"))


_DECODED = "', '".join
_NAMES = [n for names, _ in R.ENUM_DEFAULTS.values() for n in names] + ["other", ""]


@_query("q_enum_decode", f"SELECT id, name, {', '.join(f"CASE WHEN name IN ('{_DECODED(names)}') THEN name ELSE '{default}' END AS {kind}" for kind, (names, default) in R.ENUM_DEFAULTS.items())} FROM (SELECT o_orderkey AS id, {A._case(_NAMES, f'(o_orderkey % {len(_NAMES) + 1})')} AS name FROM orders)")
def enum_decode(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A._nth(_NAMES, F.col("o_orderkey") % (len(_NAMES) + 1)).alias("name"))
    return rows.select("id", "name", *[X.one_of(F.col("name"), kind).alias(kind) for kind in R.ENUM_DEFAULTS])


_LEX = [(w, c) for c, ws in R.LEXICON.items() for w in ws.split()]


def _lexicon_sql(col: str, least: int) -> str:
    ordered = sorted([e for e in _LEX if len(e[0]) >= least], key=lambda e: -len(e[0]))
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{p}') THEN '{c}'" for p, c in ordered) + " END"


@_query("q_lexicon_body", f"SELECT doc_id AS id, {_lexicon_sql('text', 5)} AS category FROM documents")
def lexicon_body(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), classify.lexicon_hit(F.col("text"), _LEX, 5).alias("category"))


@_query("q_lexicon_merchant", f"SELECT p_partkey AS id, {_lexicon_sql('p_name', 0)} AS category FROM part")
def lexicon_merchant(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.lexicon_hit(F.col("p_name"), _LEX).alias("category"))


@_query("q_amount_band", "SELECT o_orderkey AS id, CASE WHEN r < 50 THEN 0 WHEN r < 150 THEN 1 WHEN r < 400 THEN 2 WHEN r < 1000 THEN 3 WHEN r < 3000 THEN 4 WHEN r < 10000 THEN 5 WHEN r < 30000 THEN 6 ELSE 7 END AS band FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 8) AS BIGINT) AS r FROM orders)")
def amount_band(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), classify.amount_band(F.floor(F.col("o_totalprice") / 8).cast("bigint") * 100).alias("band"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@_query("q_fnv_bucket", f"SELECT id, CAST(h & 16383 AS INTEGER) AS bucket, CASE WHEN (h >> 17) & 1 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT id, {_FNV} AS h FROM (SELECT p_partkey AS id, 'm=' || lower(p_name) AS t FROM part))")
def fnv_bucket(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.fnv1a(F.concat(F.lit("m="), F.lower("p_name"))).alias("h"))
    return rows.select("id", classify.bucket(F.col("h")).alias("bucket"), classify.sign(F.col("h")).alias("sign"))


def _featured(spark, d):
    rows = A.live_ledger(spark, d)
    return rows.withColumn("features", classify.features(F.col("merchant_norm"), F.lit(None).cast("string"), F.col("channel"), F.col("amount_paise"), F.col("occurred_at"), ZONE))


@_query("q_feature_count", _L + """SELECT id, 1 + CASE WHEN merchant_norm IS NULL THEN 0 ELSE greatest(len(merchant_norm), 0) + greatest(len(merchant_norm) - 1, 0) + greatest(len(merchant_norm) - 2, 0) + 2 END + 5 AS n,
  't=' || CAST((occurred_at // 14400000) % 6 AS VARCHAR) AS part_of_day FROM live""")
def feature_count(spark, d):
    return _featured(spark, d).select("id", F.size("features").cast("bigint").alias("n"), F.get("features", F.size("features") - 3).alias("part_of_day"))


def _grams_sql(n: int) -> str:
    return f"list_transform(range(1, len(m) + {4 - n}), lambda i: 'g{n}=' || substring('^' || m || '$', i, {n}))"


_BAND = "CASE " + " ".join(f"WHEN amount_paise / 100.0 < {b} THEN '{k}'" for k, b in enumerate(R.AMOUNT_BANDS)) + f" ELSE '{len(R.AMOUNT_BANDS)}' END"
#: CTE ``vec`` (id, idx, val) from the source columns alone.
_VECTOR = _L + f""", named AS (SELECT *, coalesce(merchant_norm, '') AS m FROM live),
words AS (SELECT id, unnest(list_concat(CASE WHEN m = '' THEN ['m=<none>'] ELSE list_concat(['m=' || m], {_grams_sql(3)}, {_grams_sql(4)}, {_grams_sql(5)}, list_transform(string_split(m, ' '), lambda w: 'w=' || w)) END,
  ['c=' || channel, 'a=' || {_BAND}, 't=' || CAST((occurred_at // 14400000) % 6 AS VARCHAR), 'd=' || CAST(isodow(make_timestamp(occurred_at * 1000)) AS VARCHAR), 'bias=1'])) AS t FROM named),
hashed AS (SELECT id, {_FNV} AS h FROM words), summed AS (SELECT id, CAST(h & 16383 AS INTEGER) AS idx, CAST(sum(CASE WHEN (h >> 17) & 1 = 1 THEN 1 ELSE -1 END) AS INTEGER) AS s FROM hashed GROUP BY 1, 2),
vec AS (SELECT id, idx, CASE WHEN n > 0 THEN s / sqrt(n) ELSE 0.0 END AS val FROM (SELECT *, CAST(sum(s * s) OVER (PARTITION BY id) AS DOUBLE) AS n FROM summed))"""


@_query("q_feature_vector", _VECTOR + " SELECT id, idx, val FROM vec")
def feature_vector(spark, d):
    return classify.vectors(_featured(spark, d), "id")


@_query("q_classify_model", _VECTOR + f""", labels_ AS (SELECT i AS label, {A._case(R.CATEGORIES, 'i')} AS name FROM range({len(R.CATEGORIES)}) r(i)),
z AS (SELECT id, label, name, sum(val * (((label * 31 + idx * 17) % 127 - 63) / 8.0)) + (label % 5 - 2) / 8.0 AS z FROM vec, labels_ GROUP BY id, label, name),
p AS (SELECT id, name, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p, row_number() OVER (PARTITION BY id ORDER BY z DESC, label) AS k FROM z WINDOW w AS (PARTITION BY id)),
met AS (SELECT live.id, direction, name, p, p >= {R.ACCEPT} AS sure, coalesce(merchant_norm IN ('user 3', 'user 7'), false) AS mem, {_lexicon_sql('merchant_norm', 0)} AS seed FROM live JOIN p USING (id) WHERE k = 1)
SELECT id, CASE WHEN mem THEN 'Travel' WHEN sure THEN name WHEN seed IS NOT NULL THEN seed WHEN direction = 'CREDIT' THEN 'Income' ELSE 'Other' END AS category,
  CASE WHEN mem THEN 'MEMORY' WHEN sure THEN 'MODEL' WHEN seed IS NOT NULL THEN 'SEED' ELSE 'NONE' END AS category_source,
  round(CASE WHEN mem THEN 1.0 WHEN sure THEN p WHEN seed IS NOT NULL THEN {R.SEED_CONFIDENCE} ELSE 0.0 END, 6) AS confidence, NOT mem AND NOT sure AND direction = 'DEBIT' AS needs_review FROM met""")
def classify_model(spark, d):
    """All four layers, with a model whose weights are a rule that SQL can follow."""
    label, idx = np.arange(len(R.CATEGORIES))[:, None], np.arange(R.BUCKETS)[None]
    model = classify.LinearModel((((label * 31 + idx * 17) % 127 - 63) / 8).astype(np.float32), ((label[:, 0] % 5 - 2) / 8).astype(np.float32), R.TRUST_STEPS)
    memory = spark.createDataFrame([("user 3", "Travel"), ("user 7", "Travel")], "merchant_norm string, category string")
    rows = _featured(spark, d).drop("category", "category_source", "needs_review")
    return classify.classified(rows, memory, model, _LEX).select("id", "category", "category_source", F.round("confidence", 6).alias("confidence"), "needs_review")


@_query("q_classify_layers", _L + f"""SELECT id, CASE WHEN mem THEN 'Travel' WHEN seed IS NOT NULL THEN seed WHEN direction = 'CREDIT' THEN 'Income' ELSE 'Other' END AS category, CASE WHEN mem THEN 'MEMORY' WHEN seed IS NOT NULL THEN 'SEED' ELSE 'NONE' END AS category_source,
  CAST(CASE WHEN mem THEN 1.0 WHEN seed IS NOT NULL THEN 0.45 ELSE 0.0 END AS DOUBLE) AS confidence, NOT mem AND direction = 'DEBIT' AS needs_review
  FROM (SELECT *, coalesce(merchant_norm IN ('user 3', 'user 7'), false) AS mem, {_lexicon_sql('merchant_norm', 0)} AS seed FROM live)""")
def classify_layers(spark, d):
    memory = spark.createDataFrame([("user 3", "Travel"), ("user 7", "Travel")], "merchant_norm string, category string")
    rows = _featured(spark, d).drop("category", "category_source", "needs_review")
    return classify.classified(rows, memory, classify.LinearModel(), _LEX).select("id", "category", "category_source", "confidence", "needs_review")


@_query("q_ledger_export", _L + """SELECT id, strftime(make_timestamp(occurred_at * 1000), '%Y-%m-%d %H:%M') || ',' || direction || ',' || CAST(CAST(amount_paise / 100.0 AS DECIMAL(18,2)) AS VARCHAR) || ',' || coalesce(merchant_norm, '') || ',' || category || ',' || category_source || ',' || channel || ',' || coalesce(account_tail, '') || ',' || coalesce(ref_no, '') || ',,,' AS line FROM live""")
def ledger_export(spark, d):
    from spendspark.sources import ledger_csv

    return ledger_csv.lines(A.live_ledger(spark, d), ZONE)
