"""Messages as a stream: parsed in native columns, repeated messages and near-equal transactions dropped by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendspark import rules as R
from spendspark.operators import classify, dedupe, ledger, parse
from spendspark.operators import ingest as batches
from spendspark.streaming.parts import Parts, only_last


def assembled(parts: DataFrame) -> DataFrame:
    """Messages from parts (sender, batch, seq, text, received_at): texts of one sender in one batch, in order of arrival."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return parts.groupBy("sender", "batch").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("body"), F.max("received_at").alias("received_at"))


def distinct_messages(messages: DataFrame, late: str = "2 days") -> DataFrame:
    """Drops a message that came before with the same sender, body and day. State lives for ``late`` of event time: the
    fingerprint holds the day, so an equal message that is later than that has another one."""
    keyed = messages.withColumns({"fingerprint": parse.fingerprint(F.col("sender"), F.col("body"), F.col("received_at")), "event_time": F.timestamp_millis("received_at")})
    return keyed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["fingerprint"])


_KEPT = "id long, amount_paise long, direction string, account_tail string, occurred_at long, ref_no string, kept boolean"
_STATE = "who array<string>, place array<bigint>, first array<bigint>, last array<bigint>"


def near_distinct(txns: DataFrame, gap_ms: int = R.NEAR_MS) -> DataFrame:
    """Transactions with ``kept``, in append mode: a row without a reference is dropped near a kept one of its amount and
    direction. State holds the kept times of one amount and direction that the watermark can still reach, as first and last of
    each account and three minutes; a row is looked up in it, not compared with all.

    txns: id, amount_paise, direction, account_tail, occurred_at, ref_no, event_time (with a watermark).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        near = dedupe.Near(gap_ms, {(w, p): (a, b) for w, p, a, b in zip(*state.get)} if state.exists else {})
        for frame in frames:
            frame = frame.sort_values("id", kind="stable")
            flags = []
            for at, tail, ref in zip(frame["occurred_at"], frame["account_tail"], frame["ref_no"]):
                at, tail = int(at), None if pd.isna(tail) else tail
                stays = not (pd.isna(ref) and near.hides(at, tail))
                if stays:
                    near.keep(at, tail)
                flags.append(stays)
            yield frame.assign(kept=flags)[["id", "amount_paise", "direction", "account_tail", "occurred_at", "ref_no", "kept"]]
        low = state.getCurrentWatermarkMs() - gap_ms
        left = [(w, p, a, b) for (w, p), (a, b) in near.spans.items() if b >= low]
        state.update(tuple(list(c) for c in zip(*left)) if left else ([], [], [], []))
        state.setTimeoutTimestamp(max([*(b for *_, b in left), state.getCurrentWatermarkMs()]) + gap_ms + 1)

    return txns.groupBy("amount_paise", "direction").applyInPandasWithState(step, _KEPT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ledger_stream(messages: DataFrame, zone: str) -> DataFrame:
    """Parsed transactions of distinct messages."""
    return parse.parsed(distinct_messages(messages), zone).where("reject_reason IS NULL")


def _rows(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The table at a path, of batches before one; empty where nothing was written yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch long")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def latest(spark: SparkSession, answers: str) -> DataFrame:
    """The last answer that was published. Answers are new folders, complete once they are seen, so none is ever missing."""
    rows = spark.read.option("basePath", answers).parquet(answers)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def recompute(stream: DataFrame, ask: Callable[[DataFrame], DataFrame], store: str, answers: str, checkpoint: str, every: str = "60 seconds", part: Callable[[DataFrame], DataFrame] | None = None):
    """Appends each micro-batch to the ledger at ``store`` and publishes the answer of ``ask`` below ``answers``, of which the
    last two stay.

    With ``part`` the answer is asked of partial results (sums, counts): a running total and the parts of the newest batches, so
    no batch reads the ledger again. ``part`` of parts has to be a part of the same columns. A batch that is replayed after a
    failure overwrites its own folders, so it is not counted twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
        if part is not None:
            own = part(rows)
            parts = Parts(spark, f"{store}/partial", own.schema, part)
            parts.put(own, number)
            known = parts.read(number + 1)
        else:
            known = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows")
        ask(known).write.mode("overwrite").parquet(f"{answers}/batch={number}")
        only_last(spark, answers, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def rolled_up(spark: SparkSession, ask: Callable[[DataFrame, int], DataFrame], store: str, answers: str, checkpoint: str, every: str = "20 minutes"):
    """Publishes the answer of ``ask`` (ledger, now in ms) again and again, as windows that end now go stale without new rows."""

    def batch(ticks: DataFrame, number: int) -> None:
        now = ticks.agg(F.unix_millis(F.max("timestamp"))).first()[0]
        if now is not None:
            ask(spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows"), now).write.mode("overwrite").parquet(f"{answers}/batch={number}")

    return spark.readStream.format("rate").load().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


_RAW = "id long, source string, sender string, body string, received_at long, fingerprint string, parsed boolean, reject_reason string, parser_version int"
_TXN = (
    "id long, raw_id long, amount_paise long, direction string, channel string, account_tail string, ref_no string, balance_paise long, merchant_raw string, merchant_norm string, vpa_handle string, occurred_at long, "
    "category string, category_source string, confidence double, needs_review boolean, place string, loc_age_ms long, loc_confidence string, parser_version int"
)


_REFS = "ref_no string, ref_bucket int"


def live(messages: DataFrame, folder: str, zone: str, checkpoint: str, know: batches.Knowledge | Callable[[], batches.Knowledge] | None = None, every: str = "60 seconds"):
    """Messages (source, sender, body, received_at) into the tables raw and txns below ``folder``, batch by batch.

    Each batch meets the stored tables, not a state with a watermark, so a message that comes late, whatever the delay, is
    compared like any other. The tables are laid out by day: an equal message is of the same day and a near one of the next at
    most, so a batch reads the days that it speaks of. References, which have no day, are a table of their own, laid out by a
    hash, of which it reads the parts that its own fall into. ``know``, if it is a function, is asked for each batch. A replayed batch sees what was there before it and overwrites its
    own folders.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        raw, txns = (stored(spark, f"{folder}/{t}", s, number) for t, s in (("raw", _RAW), ("txns", _TXN)))
        refs = Parts(spark, f"{folder}/refs", _REFS, lambda r: r.distinct().repartition("ref_bucket"), by=["ref_bucket"])
        came = ledger.numbered(rows.select("source", "sender", "body", "received_at"), ["received_at", "sender", "body"], start=number << 33)
        out = batches.messages_in(came, raw, txns, zone, know() if callable(know) else know, refs.read(number))
        for name, new, at in (("raw", out.raw, "received_at"), ("txns", out.txns, "occurred_at")):
            dated = new.withColumns({"stored_day": batches.stored_day(F.col(at)), "batch": F.lit(number)})
            # A batch's days only: those that other batches wrote stay.
            dated.repartition("stored_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stored_day", "batch").parquet(f"{folder}/{name}")
        refs.put(out.txns.where("ref_no IS NOT NULL").select("ref_no", batches.ref_bucket(F.col("ref_no")).alias("ref_bucket")), number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """A table laid out by day, without what batches from number ``before`` on wrote; empty if there is none yet."""
    full = f"{schema}, stored_day int, batch long"
    try:
        return spark.read.schema(full).parquet(path).where(F.col("batch") < before).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], full).drop("batch")


def learning(corrections: DataFrame, rows: Callable[[], DataFrame], folder: str, checkpoint: str, every: str = "60 seconds"):
    """Corrections (id, category, and at, where there is one) as a stream: each batch adds them to the memory of merchants, and
    steps the model on them and on a sample of what was confirmed before.

    ``rows`` gives the ledger with id, features, category and category_source, and merchant_norm for the memory. Memory and model
    of a batch are one version: the model's row below ``folder`` is written last, and a version is there when that is. A replayed
    batch starts from the version before it and overwrites its own, so nothing is counted twice.
    """

    def batch(fixes: DataFrame, number: int) -> None:
        if fixes.isEmpty():
            return
        learn(fixes, rows(), folder, number)

    return corrections.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def _memory(spark: SparkSession, folder: str) -> Parts:
    return Parts(spark, f"{folder}/_memory", ledger.MEMORY, ledger.merged_memory)


def learn(fixes: DataFrame, told: DataFrame, folder: str, number: int) -> None:
    """One version of memory and model from the one before it."""
    spark = fixes.sparkSession
    _, model, _ = knowledge(spark, folder, number)
    at = F.col("at") if "at" in fixes.columns else F.lit(number)
    own = fixes.select("id", F.col("category").alias("__category"), at.alias("__at"))
    fresh = told.drop("category").join(own, "id").withColumnRenamed("__category", "category")
    if "merchant_norm" in told.columns:
        _memory(spark, folder).put(ledger.confirmations(fresh.select("id", "merchant_norm", "category", F.col("__at").alias("at"))), number)
    model = classify.learned(model, fresh, told.where("category_source = 'USER'"), seed=number)
    spark.createDataFrame([(number, model.to_bytes())], "number long, blob binary").write.mode("overwrite").parquet(f"{folder}/batch={number}")


def knowledge(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, classify.LinearModel, int | None]:
    """Memory, model and number of the newest version (before number ``before``)."""
    seen = _rows(spark, folder, "number long, blob binary", before).orderBy(F.col("number").desc()).first()
    model = (classify.LinearModel.from_bytes(bytes(seen.blob)) if seen else None) or classify.LinearModel()
    memory = ledger.merged_memory(_memory(spark, folder).read(seen.number + 1 if seen else 0))
    return memory, model, seen.number if seen else None
