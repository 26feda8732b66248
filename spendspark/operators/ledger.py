"""Tables of a ledger as new versions of themselves: marks, resets, corrections, lookups, numbering.

raw: id, source, sender, body, received_at, fingerprint, parsed, reject_reason, parser_version. txns: id, raw_id and the fields
of a transaction with category, category_source, confidence, needs_review. Each function returns the table as it is after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.store import written

#: Sources whose rows can't be read again: their text is a flattened row of a file.
FILES = ["STATEMENT", "LEDGER_CSV"]


def marked(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """Sets parsed, reject_reason and parser_version where ``marks`` (id and these) has a message."""
    new = marks.select("id", F.struct("parsed", "reject_reason", "parser_version").alias("__mark"))
    met = raw.join(new, "id", "left")
    own = lambda c: F.when(F.col("__mark").isNotNull(), F.col(f"__mark.{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*[own(c) if c in ("parsed", "reject_reason", "parser_version") else F.col(c) for c in raw.columns])


def bumped(raw: DataFrame, version: int) -> DataFrame:
    """Parsed messages count as seen by ``version``."""
    return raw.withColumn("parser_version", F.when(F.col("parsed") & (F.col("parser_version") < version), version).otherwise(F.col("parser_version")))


def reset(raw: DataFrame) -> DataFrame:
    """As before any parser saw it."""
    return raw.withColumns({"parsed": F.lit(False), "reject_reason": F.lit(None).cast("string"), "parser_version": F.lit(0)})


def without_files(raw: DataFrame) -> DataFrame:
    return raw.where(~F.col("source").isin(FILES))


def to_reparse(raw: DataFrame, version: int) -> DataFrame:
    """Messages that an older parser rejected and a newer one may read."""
    return without_files(raw).where(~F.col("parsed") & (F.col("parser_version") < version))


def looked_up(store: DataFrame, keys: DataFrame, key: str, order: str = "id") -> DataFrame:
    """For each of ``keys`` (column ``key``) the first row of the store that has it, null columns without one."""
    rest = [c for c in store.columns if c != key]
    wanted = keys.select(key).distinct()
    first = store.join(wanted, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return wanted.join(first, key, "left").select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def recategorised(txns: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets category, category_source, confidence and needs_review of single rows. changes: id and these, one row for an id."""
    new = changes.select("id", F.struct("category", "category_source", "confidence", "needs_review").alias("__new"))
    met = txns.join(new, "id", "left")
    return met.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in ("category", "category_source", "confidence", "needs_review") else F.col(c) for c in txns.columns])


def confirmed(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """A user's decisions, in order of ``at``: each sets its row for good; with ``everywhere`` also the rows of its merchant
    that no user has set, of which the last decision counts (of equal times the one on the larger id). corrections: id, category, everywhere, at."""
    last = corrections.groupBy("id").agg(F.max_by("category", F.struct("at", "category")).alias("category"))
    own = recategorised(txns, last.select("id", "category", F.lit("USER").alias("category_source"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review")))
    spread = corrections.where("everywhere").join(txns.select("id", "merchant_norm"), "id").where("coalesce(merchant_norm, '') <> ''")
    new = spread.groupBy("merchant_norm").agg(F.max_by("category", F.struct("at", "id", "category")).alias("__new"))
    hit = F.col("__new").isNotNull() & (F.col("category_source") != "USER")
    set_ = {"category": F.col("__new"), "category_source": F.lit("MEMORY"), "confidence": F.lit(1.0), "needs_review": F.lit(False)}
    return own.join(new, "merchant_norm", "left").select(*[F.when(hit, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in txns.columns])


def remembered(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Merchant memory that decisions leave: merchant_norm, category and updated_at of the last one."""
    met = corrections.join(txns.select("id", "merchant_norm"), "id").where("coalesce(merchant_norm, '') <> ''")
    return met.groupBy("merchant_norm").agg(F.max_by("category", F.struct("at", "id", "category")).alias("category"), F.max("at").alias("updated_at"))


MEMORY = "merchant_norm string, category string, confirmations long, updated_at long, last_id long"


def confirmations(decisions: DataFrame) -> DataFrame:
    """What decisions (id, merchant_norm, category, at) add to a memory: each of a known label counts once for its merchant, the
    last one (by time, then id) names the category."""
    valid = decisions.where("coalesce(trim(merchant_norm), '') <> ''").where(F.col("category").isin(R.CATEGORIES))
    return merged_memory(valid.select("merchant_norm", "category", F.lit(1).cast("long").alias("confirmations"), F.col("at").cast("long").alias("updated_at"), F.col("id").cast("long").alias("last_id")))


def merged_memory(rows: DataFrame) -> DataFrame:
    """Memories of several batches as one: counts are added, the last decision names the category."""
    last = F.struct("updated_at", "last_id", "category")
    return rows.groupBy("merchant_norm").agg(F.max(last).alias("last"), F.sum("confirmations").alias("confirmations")).select("merchant_norm", "last.category", "confirmations", "last.updated_at", "last.last_id")


def forgotten(memory: DataFrame, merchants: DataFrame) -> DataFrame:
    return memory.join(merchants.select("merchant_norm").distinct(), "merchant_norm", "left_anti")


def with_client_ids(txns: DataFrame) -> DataFrame:
    """Rows of before the column get a random id of 32 hex digits, those with one keep it; write the result once."""
    random = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return txns.withColumn("client_id", F.coalesce("client_id", random) if "client_id" in txns.columns else random)


def shown_place(confidence: Column, lat: Column, lon: Column) -> Column:
    """A place only where it is known well."""
    return F.when((confidence == "HIGH") & lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """All rows, oldest first: messages by received_at, transactions by occurred_at."""
    return rows.orderBy(by, "id")


def numbered(rows: DataFrame, order: list[str], start: int = 1, name: str = "id") -> DataFrame:
    """Running numbers in ``order``: sorted in ranges, counted in each, and the counts (one a range) added up before them."""
    kept = [c for c in rows.columns if c != name]
    # Written, so that ranges are drawn once. The id holds the range in its upper bits and the row within it in the lower 33.
    sorted_ = written(rows.select(*kept).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = sorted_.withColumns({"__range": F.shiftright("__at", 33).cast("int"), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    at, before = start, []
    for r in placed.groupBy("__range").count().orderBy("__range").collect():
        before.append((r["__range"], at))
        at += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "__range int, __before long")
    return placed.join(F.broadcast(offsets), "__range").select((F.col("__before") + F.col("__row")).alias(name), *kept)  # one row a range
