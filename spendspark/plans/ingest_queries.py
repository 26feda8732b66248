"""Queries that put observations into a ledger, correct it and look things up, with DuckDB SQL that folds them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import ingest, ledger
from spendspark.plans import adapter as A
from spendspark.plans.queries import _LEX, _lexicon_sql
from spendspark.plans.registry import query

#: Every seventh message comes once more, a minute later.
_REPEAT = 7


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """id (in order of arrival), source, sender, body, received_at."""
    m = A.messages(spark, d, coarse=True)
    again = m.where(F.col("id") % _REPEAT == 0).select((F.col("id") * 2 + 1).alias("id"), "sender", "body", (F.col("received_at") + 60_000).alias("received_at"))
    both = m.withColumn("id", F.col("id") * 2).unionByName(again)
    return both.withColumn("source", F.when(F.floor(F.col("id") / 2) % 5 == 4, "NOTIFICATION").otherwise("SMS"))


_CLASSED = f"""CASE WHEN merchant_norm = 'shopbeta' THEN 'Travel' WHEN seed IS NOT NULL THEN seed WHEN direction = 'CREDIT' THEN 'Income' ELSE 'Other' END AS category,
  CASE WHEN merchant_norm = 'shopbeta' THEN 'MEMORY' WHEN seed IS NOT NULL THEN 'SEED' ELSE 'NONE' END AS category_source"""
_SEED = f"coalesce({_lexicon_sql('merchant_norm', 0)}, {_lexicon_sql('body', 5)}) AS seed"
#: CTEs from the arrivals to ``judged``: each message that is not personal, with its outcome, in order of ``ord``.
_ARRIVED = f"""{A.expected_sql(coarse=True)},
arrived AS (SELECT * REPLACE (id * 2 AS id) FROM expected UNION ALL SELECT * REPLACE (id * 2 + 1 AS id, received_at + 60000 AS received_at, CASE WHEN occurred_at = received_at THEN occurred_at + 60000 ELSE occurred_at END AS occurred_at) FROM expected WHERE id % {_REPEAT} = 0),
unique_ AS (SELECT *, row_number() OVER (PARTITION BY lower(sender), body, received_at // 86400000 ORDER BY id) = 1 AS fresh FROM arrived WHERE sender <> '{A.SENDERS[3]}')"""


def _judged_sql(candidates: str, stored: str, order: str) -> str:
    """CTEs ``judged`` (of ``candidates``, with outcome) against ``stored`` transactions, in ``order``."""
    return f"""cand AS ({candidates}), stored AS ({stored}),
good AS (SELECT *, ref_no IS NOT NULL AND (row_number() OVER (PARTITION BY ref_no ORDER BY {order}, id) > 1 OR ref_no IN (SELECT ref_no FROM stored WHERE ref_no IS NOT NULL)) AS known FROM cand WHERE reject_reason IS NULL),
met AS (SELECT id, amount_paise AS p, direction AS w, account_tail AS tail, occurred_at AS moment, ref_no IS NOT NULL AS pinned, 1 AS batch, {order} AS o FROM good WHERE NOT known
  UNION ALL SELECT -1 - id, amount_paise, direction, account_tail, occurred_at, true, 0, 0 FROM stored),
ordered AS (SELECT *, row_number() OVER (ORDER BY batch, o, id) AS ord FROM met), {A.greedy_sql('ordered')},
judged AS (SELECT c.*, CASE WHEN c.reject_reason IS NOT NULL THEN 'rejected' WHEN g.kept THEN 'inserted' ELSE 'duplicate transaction' END AS outcome FROM cand c LEFT JOIN greedy g ON g.id = c.id)"""


_NOTHING = "SELECT * FROM arrived WHERE false"
_INGESTED = f"WITH RECURSIVE {_ARRIVED}, {_judged_sql('SELECT * FROM unique_ WHERE fresh', _NOTHING, 'id')}"


def _know(spark: SparkSession) -> ingest.Knowledge:
    return ingest.Knowledge(memory=spark.createDataFrame([("shopbeta", "Travel")], "merchant_norm string, category string"), entries=_LEX)


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    raw = spark.createDataFrame([], "id long, source string, sender string, body string, received_at long, fingerprint string, parsed boolean, reject_reason string, parser_version int")
    return raw, spark.createDataFrame([], "id long, ref_no string, occurred_at long, amount_paise long, direction string, account_tail string")


def _first(spark: SparkSession, d: str) -> ingest.Batch:
    return ingest.messages_in(_arrivals(spark, d), *_empty(spark), A.ZONE, _know(spark))


@query(
    "q_ingest_outcomes",
    f"""{_INGESTED} SELECT id, outcome, CASE WHEN outcome = 'rejected' THEN reject_reason END AS reason FROM judged
UNION ALL SELECT id, 'duplicate message', NULL FROM unique_ WHERE NOT fresh UNION ALL SELECT id, 'rejected', 'personal sender' FROM arrived WHERE sender = '{A.SENDERS[3]}'""",
)
def ingest_outcomes(spark, d):
    """Two batches, the second against what the first left, are like one."""
    all_ = _arrivals(spark, d)
    half = (all_.agg(F.max("id")).first()[0] or 0) // 2
    one = ingest.messages_in(all_.where(F.col("id") <= half), *_empty(spark), A.ZONE, _know(spark))
    two = ingest.messages_in(all_.where(F.col("id") > half), one.raw, one.txns, A.ZONE, _know(spark))
    return one.outcomes.unionByName(two.outcomes)


_TXN = "id, amount_paise, direction, channel, account_tail, ref_no, merchant_norm, vpa_handle, occurred_at"


@query("q_ingest_transactions", f"{_INGESTED} SELECT {_TXN}, {_CLASSED} FROM (SELECT *, {_SEED} FROM judged WHERE outcome = 'inserted')")
def ingest_transactions(spark, d):
    return _first(spark, d).txns.select(*_TXN.split(", "), "category", "category_source")


@query(
    "q_backfill_counts",
    f"""WITH RECURSIVE {_ARRIVED}, recent AS (SELECT * FROM arrived WHERE received_at >= {A.NOW_MS} - 10 * 86400000),
inbox AS (SELECT *, row_number() OVER (PARTITION BY lower(sender), body, received_at // 86400000 ORDER BY received_at, id) = 1 AS own FROM recent WHERE sender <> '{A.SENDERS[3]}'),
{_judged_sql('SELECT * FROM inbox WHERE own', _NOTHING, 'received_at')}
SELECT (SELECT count(*) FROM recent) AS scanned, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'duplicate transaction') + (SELECT count(*) FROM inbox WHERE NOT own) AS duplicates,
  count(*) FILTER (outcome = 'rejected') + (SELECT count(*) FROM recent WHERE sender = '{A.SENDERS[3]}') AS rejected FROM judged""",
)
def backfill_counts(spark, d):
    return ingest.counted(ingest.backfilled(_arrivals(spark, d), *_empty(spark), A.ZONE, A.NOW_MS, 10, _know(spark)).outcomes)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A store in which an older parser failed on every third message, and some rows came from a file."""
    all_ = _arrivals(spark, d)
    first = ingest.messages_in(all_.where("id % 3 <> 0"), *_empty(spark), A.ZONE, _know(spark))
    rows = all_.where((F.col("id") % 3 == 0) & (F.col("sender") != A.SENDERS[3]))
    # Fingerprints of messages that were rejected are as unique as all others.
    rows = rows.select("id", F.when(F.col("id") % 4 == 0, "STATEMENT").otherwise(F.col("source")).alias("source"), "sender", "body", "received_at", F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    failed = rows.withColumns({"parsed": F.lit(False), "reject_reason": F.lit("no amount"), "parser_version": F.lit(0)})
    return first.raw.unionByName(failed), first.txns


_STORE = f"""{_ARRIVED}, s_unique AS (SELECT *, row_number() OVER (PARTITION BY lower(sender), body, received_at // 86400000 ORDER BY id) = 1 AS own FROM unique_ WHERE id % 3 <> 0),
s_good AS (SELECT *, ref_no IS NOT NULL AND row_number() OVER (PARTITION BY ref_no ORDER BY id) > 1 AS known FROM s_unique WHERE own AND reject_reason IS NULL)"""


def _store_sql() -> str:
    """The transactions of the store, as CTEs of their own names: a fold of the messages that the older parser read."""
    fold = A.greedy_sql("s_met").replace("lined", "s_lined").replace("greedy", "s_greedy")
    return f"""{_STORE}, s_met AS (SELECT id, amount_paise AS p, direction AS w, account_tail AS tail, occurred_at AS moment, ref_no IS NOT NULL AS pinned, id AS ord FROM s_good WHERE NOT known), {fold},
s_txns AS (SELECT g.* FROM s_good g JOIN s_greedy f ON f.id = g.id AND f.kept)"""


@query(
    "q_reparse_rejected",
    f"""WITH RECURSIVE {_store_sql()}, {_judged_sql('SELECT * FROM unique_ WHERE id % 3 = 0 AND id % 4 <> 0', 'SELECT * EXCLUDE (own, known) FROM s_txns', 'received_at')}
SELECT id, outcome = 'inserted' AS parsed, CASE outcome WHEN 'rejected' THEN reject_reason WHEN 'inserted' THEN NULL ELSE 'duplicate txn' END AS reject_reason FROM judged""",
)
def reparse_rejected(spark, d):
    raw, txns = _stored(spark, d)
    out, _ = ingest.reparsed(raw, txns, A.ZONE, know=_know(spark))
    return out.where("id % 3 = 0 AND id % 4 <> 0").select("id", "parsed", "reject_reason")


@query("q_reparse_bookkeeping", f"WITH RECURSIVE {_store_sql()} SELECT parser_version, parsed, count(*) AS n FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS parser_version, false AS parsed FROM unique_ WHERE id % 3 = 0 AND id % 4 = 0 UNION ALL SELECT u.id, 1, t.id IS NOT NULL FROM s_unique u LEFT JOIN s_txns t ON t.id = u.id WHERE u.own) GROUP BY ALL")
def reparse_bookkeeping(spark, d):
    """Versions of all that was not read again: rows of files stay as they were, what was parsed counts as seen."""
    raw, txns = _stored(spark, d)
    out, _ = ingest.reparsed(raw, txns, A.ZONE, know=_know(spark))
    return out.where("NOT (id % 3 = 0 AND id % 4 <> 0)").groupBy("parser_version", "parsed").agg(F.count("*").alias("n"))


@query(
    "q_rebuild_ledger",
    f"""WITH RECURSIVE {_ARRIVED}, {_judged_sql("SELECT * FROM unique_ WHERE id % 4 <> 0 AND (id % 3 = 0 OR id IN (SELECT min(id) FROM unique_ WHERE id % 3 <> 0 GROUP BY lower(sender), body, received_at // 86400000)) OR (id % 3 <> 0 AND id IN (SELECT min(id) FROM unique_ WHERE id % 3 <> 0 GROUP BY lower(sender), body, received_at // 86400000))", _NOTHING, 'received_at')}
SELECT {_TXN}, {_CLASSED} FROM (SELECT *, {_SEED} FROM judged WHERE outcome = 'inserted')""",
)
def rebuild_ledger(spark, d):
    raw, _ = _stored(spark, d)
    _, txns = ingest.rebuilt(raw, A.ZONE, _know(spark))
    return txns.select(*_TXN.split(", "), "category", "category_source")


_LIVE = f"WITH {A.LIVE_SQL}"


@query("q_bulk_lookup", f"{_LIVE}, k AS (SELECT 'REF' || lpad(CAST(i * 3 AS VARCHAR), 6, '0') AS ref_no FROM range(400) r(i)) SELECT k.ref_no, min(id) AS id, arg_min(amount_paise, id) AS amount_paise FROM k LEFT JOIN live USING (ref_no) GROUP BY k.ref_no")
def bulk_lookup(spark, d):
    keys = spark.range(400).select(F.concat(F.lit("REF"), F.lpad((F.col("id") * 3).cast("string"), 6, "0")).alias("ref_no"))
    return ledger.looked_up(A.live_ledger(spark, d).select("id", "ref_no", "amount_paise"), keys, "ref_no")


@query(
    "q_confirm_categories",
    f"""{_LIVE}, fix AS (SELECT id, CASE id % 3 WHEN 0 THEN 'Health' WHEN 1 THEN 'Cash' ELSE 'Rent & Housing' END AS category, id % 2 = 0 AS everywhere, id AS moment, merchant_norm FROM live WHERE id % 101 = 0),
spread AS (SELECT merchant_norm, arg_max(category, moment) AS new FROM fix WHERE everywhere AND coalesce(merchant_norm, '') <> '' GROUP BY 1)
SELECT l.id, CASE WHEN f.id IS NOT NULL THEN f.category WHEN new IS NOT NULL AND l.category_source <> 'USER' THEN new ELSE l.category END AS category,
  CASE WHEN f.id IS NOT NULL THEN 'USER' WHEN new IS NOT NULL AND l.category_source <> 'USER' THEN 'MEMORY' ELSE l.category_source END AS category_source,
  CASE WHEN f.id IS NOT NULL OR (new IS NOT NULL AND l.category_source <> 'USER') THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN f.id IS NOT NULL OR (new IS NOT NULL AND l.category_source <> 'USER') THEN false ELSE l.needs_review END AS needs_review
FROM live l LEFT JOIN fix f ON f.id = l.id LEFT JOIN spread s ON s.merchant_norm = l.merchant_norm""",
)
def confirm_categories(spark, d):
    txns, i = A.live_ledger(spark, d).withColumn("confidence", F.lit(0.5)), F.col("id")
    picked = F.when(i % 3 == 0, "Health").when(i % 3 == 1, "Cash").otherwise("Rent & Housing")
    fixes = txns.where(i % 101 == 0).select("id", picked.alias("category"), (i % 2 == 0).alias("everywhere"), i.alias("at"))
    return ledger.confirmed(txns, fixes).select("id", "category", "category_source", "confidence", "needs_review")


@query("q_running_ids", f"{_LIVE} SELECT row_number() OVER (ORDER BY occurred_at, id) + 6 AS id, id AS event_id FROM live")
def running_ids(spark, d):
    rows = A.live_ledger(spark, d).select(F.col("id").alias("event_id"), "occurred_at")
    return ledger.numbered(rows, ["occurred_at", "event_id"], start=7).select("id", "event_id")


def _grouped_sql(n: str) -> str:
    """Digits of a number of 0 or more in Indian grouping."""
    pairs = f"regexp_replace(reverse(regexp_replace(reverse(CAST({n} // 1000 AS VARCHAR)), '(..)', '\\1,', 'g')), '^,', '')"
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) ELSE {pairs} || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') END"


@query("q_money_formats", f"""SELECT id, CASE WHEN whole < 0 THEN '-' ELSE '' END || '₹' || {_grouped_sql('abs(whole)')} AS shown, CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || {_grouped_sql('(abs(p) // 100)')} || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS exact
FROM (SELECT *, CAST(floor(p / 100.0 + 0.5) AS BIGINT) AS whole FROM (SELECT o_orderkey AS id, (CAST(floor(o_totalprice) AS BIGINT) * 137 + o_orderkey % 100) * CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1000 WHEN 2 THEN 0 ELSE 1 END + o_orderkey % 7 AS p FROM orders))""")
def money_formats(spark, d):
    i = F.col("o_orderkey")
    times = F.when(i % 6 == 0, -1).when(i % 6 == 1, 1000).when(i % 6 == 2, 0).otherwise(1)
    paise = (F.floor("o_totalprice").cast("bigint") * 137 + i % 100) * times + i % 7
    return A.table(spark, d, "orders").select(i.alias("id"), X.money(paise).alias("shown"), X.exact_money(paise).alias("exact"))


@query("q_shown_times", "SELECT event_id AS id, strftime(ts + INTERVAL 330 MINUTE, '%-d %b, %-I:%M ') || CASE WHEN hour(ts + INTERVAL 330 MINUTE) < 12 THEN 'AM' ELSE 'PM' END AS shown FROM events")
def shown_times(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), X.shown_time(A.epoch_ms(F.col("ts")), "Asia/Kolkata").alias("shown"))


_PLACE = f"list_position(['{"', '".join(R.CATEGORIES)}'], name)"


@query("q_category_index", f"{_LIVE} SELECT id, CAST(coalesce({_PLACE}, 0) - 1 AS INTEGER) AS place, coalesce({A._case(R.CATEGORIES, '(id % 20)')}, 'Other') AS label FROM (SELECT id, CASE WHEN id % 4 = 0 THEN lower(category) ELSE category END AS name FROM live)")
def category_index(spark, d):
    i = F.col("id")
    name = F.when(i % 4 == 0, F.lower("category")).otherwise(F.col("category"))
    return A.live_ledger(spark, d).select("id", X.category_index(name).alias("place"), X.category_at(i % 20).alias("label"))


@query("q_table_counts", f"{_LIVE} SELECT count(*) AS n_transactions, (SELECT count(*) FROM documents) AS n_messages, (SELECT count(DISTINCT merchant_norm) FROM live) AS n_merchants FROM live")
def table_counts(spark, d):
    """Counts of the three tables of a ledger."""
    txns = A.live_ledger(spark, d)
    memory = txns.where("merchant_norm IS NOT NULL").select("merchant_norm").distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(txns, "n_transactions").join(one(A.table(spark, d, "documents"), "n_messages")).join(one(memory, "n_merchants"))  # rows of one count each


@query("q_confirmed_by_key", f"{_LIVE} SELECT id, occurred_at, category FROM live WHERE category_source = 'USER'")
def confirmed_rows(spark, d):
    """What a user has decided, oldest first."""
    return ledger.ordered(A.live_ledger(spark, d).where("category_source = 'USER'"), "occurred_at").select("id", "occurred_at", "category")

