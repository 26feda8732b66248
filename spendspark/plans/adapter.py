"""Ledgers and messages projected from the benchmark tables, so that each operator meets data of any size.

``*_SQL`` is the same projection in DuckDB's dialect; queries and their SQL start from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import rules as R

ZONE = "UTC"
#: 2024-01-24 12:00 and 2024-02-10 12:00 UTC.
NOW_MS, LATER_MS = 1_706_097_600_000, 1_707_566_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(names: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a wall-clock timestamp taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def live_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-time transactions from ``events``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    way = F.when(F.col("event_type").isin("signup", "error"), "CREDIT").otherwise("DEBIT")
    source = _nth(R.CATEGORY_SOURCES, F.floor(i / 15) % 5)
    return e.select(
        i.alias("id"),
        (i % 997).alias("raw_id"),
        epoch_ms(F.col("ts")).alias("occurred_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_paise"),
        way.alias("direction"),
        _nth(R.CHANNELS, i % 10).alias("channel"),
        F.when(i % 17 != 0, F.lpad(F.get_json_object("props", "$.k"), 4, "0")).alias("account_tail"),
        F.when(i % 23 != 0, F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string"))).alias("merchant_norm"),
        F.when(i % 4 == 0, F.concat(F.lit("REF"), F.lpad((i % 700).cast("string"), 6, "0"))).alias("ref_no"),
        _nth(R.CATEGORIES, i % 15).alias("category"),
        source.alias("category_source"),
        (source.isin("SEED", "NONE") & (way == "DEBIT")).alias("needs_review"),
    )


def _case(names: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


_WAY = "CASE WHEN event_type IN ('signup', 'error') THEN 'CREDIT' ELSE 'DEBIT' END"
_SOURCE = _case(R.CATEGORY_SOURCES, "((event_id // 15) % 5)")
LIVE_SQL = f"""live AS (SELECT event_id AS id, event_id % 997 AS raw_id, epoch_us(ts) // 1000 AS occurred_at, CAST(round(value * 100) AS BIGINT) AS amount_paise, {_WAY} AS direction,
  {_case(R.CHANNELS, '(event_id % 10)')} AS channel, CASE WHEN event_id % 17 <> 0 THEN lpad(props ->> '$.k', 4, '0') END AS account_tail,
  CASE WHEN event_id % 23 <> 0 THEN 'user ' || CAST(user_id % 40 AS VARCHAR) END AS merchant_norm,
  CASE WHEN event_id % 4 = 0 THEN 'REF' || lpad(CAST(event_id % 700 AS VARCHAR), 6, '0') END AS ref_no,
  {_case(R.CATEGORIES, '(event_id % 15)')} AS category, {_SOURCE} AS category_source,
  {_SOURCE} IN ('SEED', 'NONE') AND {_WAY} = 'DEBIT' AS needs_review FROM events)"""


def statement_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-only transactions from ``orders``; rows of one batch, each with its file row number."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("day"),
        (F.round(F.col("o_totalprice") / 5000).cast("bigint") * 100).alias("amount_paise"),
        F.when(F.col("o_orderstatus") == "O", "DEBIT").otherwise("CREDIT").alias("direction"),
        F.when(F.col("o_custkey") % 3 != 0, F.lpad((F.col("o_custkey") % 4).cast("string"), 4, "0")).alias("account_tail"),
    )


STATEMENT_SQL = """stmt AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice / 5000) AS BIGINT) * 100 AS amount_paise,
  CASE WHEN o_orderstatus = 'O' THEN 'DEBIT' ELSE 'CREDIT' END AS direction, CASE WHEN o_custkey % 3 <> 0 THEN lpad(CAST(o_custkey % 4 AS VARCHAR), 4, '0') END AS account_tail FROM orders)"""


def messages(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Bank messages rendered from ``events`` by ten templates; ``coarse`` rounds amounts, so that equal ones meet."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = (i % 10).cast("int")
    paise = (F.floor(F.col("value") / 5).cast("bigint") * 500 if coarse else F.round(F.col("value") * 100).cast("bigint")) + 100
    money = F.concat(F.call_function("div", paise, F.lit(100)).cast("string"), F.lit("."), F.lpad((paise % 100).cast("string"), 2, "0"))
    tail, shop, ref = F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"), F.concat(F.lit("shop"), _nth(["alpha", "beta", "gamma"], i % 3)), F.lpad((i % 1000000).cast("string"), 12, "4")
    # Every fourth message tells of a day that is past.
    day = F.date_format(F.date_sub(F.col("ts").cast("date"), F.when(i % 4 == 0, 3).otherwise(0)), "dd-MM-yy")
    payee = F.concat(shop, F.when(i % 3 == 0, "@okaxis").otherwise(""))
    bodies = [
        F.concat(F.lit("Rs."), money, F.lit(" debited from A/c XX"), tail, F.lit(" to "), shop, F.lit(" on "), day, F.lit(". UPI Ref "), ref),
        F.concat(F.lit("Your A/c XX"), tail, F.lit(" is credited by INR "), money, F.lit(" from "), shop, F.lit(" via NEFT. Ref no "), ref, F.lit(". Avl bal Rs. 99.50")),
        F.concat(F.lit("Rs "), money, F.lit(" spent on credit card XX"), tail, F.lit(" at "), shop, F.lit(". Avl limit: INR 5,000.00")),
        F.concat(F.lit("123456 is your OTP for a payment of Rs "), money),
        F.concat(F.lit("Pre-approved loan of Rs "), money, F.lit("! Apply now")),
        F.concat(F.lit("Rs "), money, F.lit(" will be debited from A/c XX"), tail, F.lit(" tomorrow")),
        F.concat(F.lit("Cash withdrawal of Rs "), money, F.lit(" at ATM, A/c XX"), tail, F.lit(" on "), day, F.lit(". Not you? call 1800")),
        F.concat(F.lit("Your mini statement for A/c XX"), tail, F.lit(" with Rs "), money),
        F.concat(F.lit("Dear customer, A/c XX"), tail, F.lit(" has been updated")),
        F.concat(F.lit("Rs "), money, F.lit(" paid to "), payee),
    ]
    sender = _nth(SENDERS, F.when(i % 50 == 7, 3).when(kind == 9, F.when(i % 20 == 9, 4).otherwise(0)).otherwise(i % 3))
    return e.select(i.alias("id"), sender.alias("sender"), F.get(F.array(*bodies), kind).alias("body"), epoch_ms(F.col("ts")).alias("received_at"))


SENDERS = ["VM-HDFCBK", "AD-PAYTMB", "JX-SBIUPI-S", "9876543210", "VK-UNKNWN"]
_BAD = "event_id % 50 = 7 OR event_id % 10 IN (3, 4, 5, 7, 8) OR event_id % 20 = 9"
_KIND = "(event_id % 10)"


def expected_sql(coarse: bool = False) -> str:
    """A CTE ``expected``: the messages, and what the parser has to find in each, from the source columns alone."""
    paise = "(CAST(floor(value / 5) AS BIGINT) * 500 + 100)" if coarse else "(CAST(round(value * 100) AS BIGINT) + 100)"
    money, tail = f"({paise} // 100 || '.' || lpad(CAST({paise} % 100 AS VARCHAR), 2, '0'))", "lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0')"
    shop = "('shop' || CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END)"
    ref, told = "lpad(CAST(event_id % 1000000 AS VARCHAR), 12, '4')", "(CAST(ts AS DATE) - CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END)"
    day, ms = f"strftime({told}, '%d-%m-%y')", "(epoch_us(ts) // 1000)"
    bodies = [
        f"'Rs.' || {money} || ' debited from A/c XX' || {tail} || ' to ' || {shop} || ' on ' || {day} || '. UPI Ref ' || {ref}",
        f"'Your A/c XX' || {tail} || ' is credited by INR ' || {money} || ' from ' || {shop} || ' via NEFT. Ref no ' || {ref} || '. Avl bal Rs. 99.50'",
        f"'Rs ' || {money} || ' spent on credit card XX' || {tail} || ' at ' || {shop} || '. Avl limit: INR 5,000.00'",
        f"'123456 is your OTP for a payment of Rs ' || {money}", f"'Pre-approved loan of Rs ' || {money} || '! Apply now'",
        f"'Rs ' || {money} || ' will be debited from A/c XX' || {tail} || ' tomorrow'",
        f"'Cash withdrawal of Rs ' || {money} || ' at ATM, A/c XX' || {tail} || ' on ' || {day} || '. Not you? call 1800'",
        f"'Your mini statement for A/c XX' || {tail} || ' with Rs ' || {money}", f"'Dear customer, A/c XX' || {tail} || ' has been updated'",
        f"'Rs ' || {money} || ' paid to ' || {shop} || CASE WHEN event_id % 3 = 0 THEN '@okaxis' ELSE '' END",
    ]
    sender = f"CASE WHEN event_id % 50 = 7 THEN 3 WHEN {_KIND} = 9 THEN CASE WHEN event_id % 20 = 9 THEN 4 ELSE 0 END ELSE event_id % 3 END"
    good = lambda sql, kinds="": f"CASE WHEN {_BAD}{f' OR {_KIND} NOT IN ({kinds})' if kinds else ''} THEN NULL ELSE {sql} END"
    return f"""expected AS (SELECT event_id AS id, {_case(SENDERS, f'({sender})')} AS sender, CASE {_KIND} {' '.join(f'WHEN {k} THEN {b}' for k, b in enumerate(bodies))} END AS body, {ms} AS received_at,
  CASE WHEN event_id % 50 = 7 THEN 'personal sender' WHEN event_id % 20 = 9 THEN 'unknown sender, weak signal' ELSE
    CASE {_KIND} WHEN 3 THEN 'otp' WHEN 4 THEN 'promotional' WHEN 5 THEN 'not a completed txn' WHEN 7 THEN 'informational' WHEN 8 THEN 'no amount' END END AS reject_reason,
  {good(paise)} AS amount_paise, {good(f"CASE WHEN {_KIND} = 1 THEN 'CREDIT' ELSE 'DEBIT' END")} AS direction,
  {good(f"CASE {_KIND} WHEN 0 THEN 'UPI' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'CARD' WHEN 6 THEN 'ATM' ELSE CASE WHEN event_id % 3 = 0 THEN 'UPI' ELSE 'UNKNOWN' END END")} AS channel,
  {good(tail, '0, 1, 2, 6')} AS account_tail, {good(ref, '0, 1')} AS ref_no, {good(f"CASE WHEN {_KIND} = 6 THEN 'atm' ELSE {shop} END")} AS merchant_norm,
  {good(f"CASE {_KIND} WHEN 1 THEN 9950 WHEN 2 THEN 500000 END")} AS balance_paise, {good("CASE WHEN event_id % 3 = 0 THEN 'okaxis' END", '9')} AS vpa_handle,
  {good(f"CASE WHEN {_KIND} IN (0, 6) AND event_id % 4 = 0 THEN epoch_ms(CAST({told} AS TIMESTAMP)) + 43200000 ELSE {ms} END")} AS occurred_at FROM events)"""


def greedy_sql(rows: str) -> str:
    """CTE ``greedy`` (id, kept) over a CTE with id, p (amount), w (direction), tail, moment, pinned and ord: one row after another
    against all kept before, by recursion."""
    return f"""lined AS (SELECT *, row_number() OVER (PARTITION BY p, w ORDER BY ord) AS k FROM {rows}),
greedy AS (SELECT p, w, k, id, true AS kept, [{{'t': moment, 'x': tail}}] AS held FROM lined WHERE k = 1
  UNION ALL SELECT p, w, k, id, kept, CASE WHEN kept THEN list_append(held, {{'t': moment, 'x': tail}}) ELSE held END FROM (SELECT l.*, g.held,
    l.pinned OR len(list_filter(g.held, lambda h: abs(h.t - l.moment) <= {R.NEAR_MS} AND (h.x IS NULL OR l.tail IS NULL OR h.x = l.tail))) = 0 AS kept
    FROM greedy g JOIN lined l ON l.p = g.p AND l.w = g.w AND l.k = g.k + 1))"""
