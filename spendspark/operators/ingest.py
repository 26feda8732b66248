"""Batches of observations into a ledger: dedupe, parse, dedupe again, place, classify, mark.

What comes back is what a batch adds to the two tables and what became of each observation. Nothing is collected; a batch meets
the store by keys, and of the stored transactions only those of the batch's time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import classify, dedupe, ledger, parse, spend
from spendspark.store import written

VERSION = 1
FIELDS = ["amount_paise", "direction", "channel", "account_tail", "ref_no", "balance_paise", "merchant_raw", "merchant_norm", "vpa_handle", "occurred_at"]


@dataclass
class Knowledge:
    """What classification and placing draw on. memory: merchant_norm, category; fixes: recorded_at, place; both optional.
    entries: a lexicon as a list of some words, or as a table (pattern, category) of any size."""

    memory: DataFrame | None = None
    model: classify.LinearModel = field(default_factory=classify.LinearModel)
    entries: list[tuple[str, str]] | DataFrame = field(default_factory=lambda: [(w, c) for c, ws in R.LEXICON.items() for w in ws.split()])
    fixes: DataFrame | None = None
    rules: R.Rules = R.DEFAULT


@dataclass
class Batch:
    """raw: new messages, marked; txns: new transactions; outcomes: id, outcome and reason of each observation."""

    raw: DataFrame
    txns: DataFrame
    outcomes: DataFrame

    def to_learn(self) -> DataFrame:
        """New transactions that carry a user's own decision (a ledger file that is restored): memory and model learn from them."""
        return self.txns.where("category_source = 'USER'")


def _placed(rows: DataFrame, fixes: DataFrame | None) -> DataFrame:
    """Adds place, loc_age_ms and loc_confidence from the last fix at or before ``came``, for rows of an exact time."""
    if fixes is None:
        return rows.withColumns({"place": F.lit(None).cast("string"), "loc_age_ms": F.lit(None).cast("bigint"), "loc_confidence": F.lit("NONE")})
    live = rows.where("exact_time").select("id", F.lit(0).alias("user_id"), F.col("came").alias("occurred_at"))
    near = spend.located(live, fixes.select(F.lit(0).alias("user_id"), "recorded_at", "place")).withColumnsRenamed({"age_ms": "loc_age_ms", "confidence": "loc_confidence"})
    return rows.join(near, "id", "left").withColumn("loc_confidence", F.coalesce("loc_confidence", F.lit("NONE")))


#: Parts of a stored table of references.
REF_BUCKETS = 256


def stored_day(ms: Column) -> Column:
    """The day by which a stored table is laid out, the same as in fingerprints."""
    return F.call_function("div", ms, F.lit(R.DAY_MS)).cast("int")


def ref_bucket(ref: Column) -> Column:
    return F.pmod(F.xxhash64(ref), F.lit(REF_BUCKETS)).cast("int")


def _of_days(store: DataFrame, ms: DataFrame, around: int = 0) -> DataFrame:
    """Of a table that is laid out by day only the days of ``ms`` (one column) and as many around them: filters on partitions, one
    number for each day. Any other table as it is."""
    if "stored_day" not in store.columns:
        return store
    days = {r[0] for r in ms.select(stored_day(F.col(ms.columns[0]))).distinct().collect() if r[0] is not None}
    return store.where(F.col("stored_day").isin(sorted({d + k for d in days for k in range(-around, around + 1)}))).drop("stored_day")


def persisted(rows: DataFrame, store: DataFrame, zone: str, know: Knowledge, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New transactions among parsed observations, their ids, and the ids of those that are known already.

    A reference decides alone: seen before, in the store or the batch, it is a duplicate; unseen, it is new. Without one, an
    exact time is compared within minutes, a mere day by its number of occurrences; both kinds of rows, which a file may hold,
    go through one fold in order of arrival.

    A store that is laid out by day (stored_day) is read for the days of the batch alone, and references from ``refs`` (ref_no,
    ref_bucket), of which only the batch's buckets are read; without it from the store.

    rows (read several times, so written before): id, seq (order of arrival), came, exact_time, body, FIELDS, and optionally
    preset_category, preset_source and run (the file of a row: occurrences are counted within it).
    """
    with_ref, bare = rows.where("ref_no IS NOT NULL"), rows.where("ref_no IS NULL")
    first = with_ref.groupBy("ref_no").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))
    if refs is None:
        seen = store.where("ref_no IS NOT NULL").select("ref_no").distinct()
    else:
        own = [r[0] for r in first.select(ref_bucket(F.col("ref_no"))).distinct().collect()]
        seen = refs.where(F.col("ref_bucket").isin(own)).select("ref_no")
    fresh = first.join(seen, "ref_no", "left_anti").select("id")
    by_ref = with_ref.join(fresh, "id", "left_semi")

    span = rows.agg(F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")).first()
    store = _of_days(store, rows.select("occurred_at"), 1)
    near = store.where(F.col("occurred_at").between((span.a or 0) - R.DAY_MS, (span.b or 0) + R.DAY_MS)) if span.a is not None else store.limit(0)
    run = F.col("run") if "run" in rows.columns else F.lit("batch")
    slim = lambda df, id_, seq, run_, kind: df.select(id_.alias("id"), seq.alias("seq"), run_.cast("string").alias("run"), "amount_paise", "direction", "account_tail", "occurred_at", kind.alias("kind"), X.local_day(F.col("occurred_at"), zone).alias("day"))
    own = lambda df, kind: slim(df, F.col("id"), F.col("seq"), run, kind)
    # The store comes before the batch; what a batch keeps counts for all that comes after it, live or from a file.
    met = slim(near, -1 - F.col("id"), F.lit(-(1 << 62)), F.lit("store"), F.lit(dedupe.PINNED)).unionByName(own(by_ref, F.lit(dedupe.PINNED))).unionByName(own(bare, F.when(F.col("exact_time"), dedupe.EXACT).otherwise(dedupe.DAILY)))
    kept = written(dedupe.greedy(met).where("kept AND id >= 0").select("id"), "kept")
    new = rows.join(kept, "id", "left_semi")
    features = classify.features(F.col("merchant_norm"), F.col("vpa_handle"), F.col("channel"), F.col("amount_paise"), F.col("occurred_at"), zone)
    memory = know.memory if know.memory is not None else rows.sparkSession.createDataFrame([], "merchant_norm string, category string")
    known = classify.classified(new.withColumn("features", features), memory, know.model, know.entries, F.col("body"))
    if "preset_category" in rows.columns:
        preset = F.col("preset_category").isNotNull()
        values = {"category": F.col("preset_category"), "category_source": F.coalesce("preset_source", F.lit("USER")), "confidence": F.lit(1.0), "needs_review": F.lit(False)}
        known = known.withColumns({n: F.when(preset, v).otherwise(F.col(n)) for n, v in values.items()})
    placed = _placed(known, know.fixes)
    txns = placed.select(
        "id", F.col("id").alias("raw_id"), *FIELDS, "category", "category_source", "confidence", "needs_review", "place", "loc_age_ms", "loc_confidence", F.lit(VERSION).alias("parser_version")
    )
    return txns, kept, rows.select("id").join(kept, "id", "left_anti")


def _replayed(messages: DataFrame, store: DataFrame, zone: str, know: Knowledge, seq: Column, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New transactions of stored messages, and marks (id, parsed, reject_reason, parser_version) of all of them."""
    read = written(parse.parsed(messages.select("id", seq.alias("seq"), "sender", "body", "received_at"), zone, rules=know.rules), "parsed")
    good = read.where("reject_reason IS NULL").select("id", "seq", F.col("received_at").alias("came"), F.lit(True).alias("exact_time"), "body", *FIELDS)
    txns, _, known = persisted(good, store, zone, know, refs)
    txns = written(txns, "transactions")
    mark = lambda df, parsed, reason: df.select("id", F.lit(parsed).alias("parsed"), reason.alias("reject_reason"), F.lit(VERSION).alias("parser_version"))
    marks = mark(read.where("reject_reason IS NOT NULL"), False, F.col("reject_reason")).unionByName(mark(known, False, F.lit("duplicate txn"))).unionByName(mark(txns, True, F.lit(None).cast("string")))
    return txns, written(marks, "marks")


def messages_in(messages: DataFrame, raw: DataFrame, store: DataFrame, zone: str, know: Knowledge | None = None, refs: DataFrame | None = None) -> Batch:
    """Live messages: id (in order of arrival, unseen), source, sender, body, received_at. Personal ones are never stored."""
    know = know or Knowledge()
    who = messages.withColumn("__who", X.sender_class(F.col("sender"), know.rules))
    personal = who.where("__who = 'PERSONAL'").select("id", F.lit("rejected").alias("outcome"), F.lit("personal sender").alias("reason"))
    rest = who.where("__who <> 'PERSONAL'").drop("__who").withColumn("fingerprint", parse.fingerprint(F.col("sender"), F.col("body"), F.col("received_at")))
    # A fingerprint holds its day, so stored ones of other days are none of the batch's.
    first = written(dedupe.new_only(dedupe.first_of(rest, "fingerprint", "id"), _of_days(raw, rest.select("received_at")), "fingerprint"), "messages")
    again = rest.select("id").join(first.select("id"), "id", "left_anti").select("id", F.lit("duplicate message").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    txns, marks = _replayed(first, store, zone, know, F.col("id"), refs)
    new_raw = ledger.marked(ledger.reset(first), marks)
    outcome = F.when(F.col("parsed"), "inserted").when(F.col("reject_reason") == "duplicate txn", "duplicate transaction").otherwise("rejected")
    judged = marks.select("id", outcome.alias("outcome"), F.when(outcome == "rejected", F.col("reject_reason")).alias("reason"))
    return Batch(new_raw, txns, personal.unionByName(again).unionByName(judged))


def records_in(records: DataFrame, raw: DataFrame, store: DataFrame, zone: str, know: Knowledge | None = None, refs: DataFrame | None = None) -> Batch:
    """Rows of files: id (in order of arrival, unseen), source, origin, raw_line, exact_time, FIELDS and presets, and ``run``, the
    file of a row: occurrences of a day are counted from 1 in each file. Without it all rows are of one file."""
    named = records.withColumn("fingerprint", parse.fingerprint(F.col("origin"), F.col("raw_line"), F.col("occurred_at")))
    # Fingerprints meet with ids alone; whole rows are only looked up.
    ids = named.groupBy("fingerprint").agg(F.min("id").alias("id"))
    new = dedupe.new_only(ids, _of_days(raw, named.select("occurred_at")), "fingerprint").select("id")
    first = written(named.join(new, "id", "left_semi"), "records")
    again = named.select("id").join(first.select("id"), "id", "left_anti").select("id", F.lit("duplicate message").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    presets = [c for c in ("preset_category", "preset_source", "run") if c in records.columns]
    txns, kept, known = persisted(first.select("id", F.col("id").alias("seq"), F.col("occurred_at").alias("came"), "exact_time", F.col("raw_line").alias("body"), *FIELDS, *presets), store, zone, know or Knowledge(), refs)
    mark = lambda df, parsed, reason: df.select("id", F.lit(parsed).alias("parsed"), F.lit(reason).cast("string").alias("reject_reason"), F.lit(VERSION).alias("parser_version"))
    marks = mark(known, False, "duplicate txn").unionByName(mark(kept, True, None))
    rows = first.select("id", "source", F.col("origin").alias("sender"), F.col("raw_line").alias("body"), F.col("occurred_at").alias("received_at"), "fingerprint")
    outcomes = marks.select("id", F.when(F.col("parsed"), "inserted").otherwise("duplicate transaction").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return Batch(ledger.marked(ledger.reset(rows), marks), txns, again.unionByName(outcomes))


def counted(outcomes: DataFrame) -> DataFrame:
    """scanned, inserted, duplicates and rejected; both kinds of duplicates are one figure."""
    one = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(F.count("*").alias("scanned"), one("inserted").alias("inserted"), one("duplicate message", "duplicate transaction").alias("duplicates"), one("rejected").alias("rejected"))


def backfilled(inbox: DataFrame, raw: DataFrame, store: DataFrame, zone: str, now_ms: int, days: int = 180, know: Knowledge | None = None) -> Batch:
    """The messages of an inbox of the last ``days``, oldest first; those without a sender or text are passed over.

    inbox: id, sender, body, received_at; the time bound reaches the scan.
    """
    since = inbox.where((F.col("received_at") >= now_ms - days * R.DAY_MS) & F.col("sender").isNotNull() & F.col("body").isNotNull())
    by_time = ledger.numbered(since.withColumn("source", F.lit("SMS")).withColumnRenamed("id", "inbox_id"), ["received_at", "inbox_id"])
    return messages_in(by_time, raw, store, zone, know)


def reparsed(raw: DataFrame, store: DataFrame, zone: str, version: int = VERSION, know: Knowledge | None = None) -> tuple[DataFrame, DataFrame]:
    """All messages after a newer parser read what an older one rejected, and the transactions that were recovered."""
    txns, marks = _replayed(ledger.to_reparse(raw, version), store, zone, know or Knowledge(), F.col("received_at"))
    return ledger.bumped(ledger.marked(raw, marks), version), txns


def rebuilt(raw: DataFrame, zone: str, know: Knowledge | None = None) -> tuple[DataFrame, DataFrame]:
    """All messages and transactions anew, from the stored messages in order of time. Rows of files are dropped, so that the
    files can be read again."""
    left = ledger.reset(ledger.without_files(raw))
    nothing = raw.sparkSession.createDataFrame([], "id long, ref_no string, occurred_at long, amount_paise long, direction string, account_tail string")
    txns, marks = _replayed(left, nothing, zone, know or Knowledge(), F.col("received_at"))
    return ledger.marked(left, marks), txns
