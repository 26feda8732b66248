"""Removing repeated observations: messages, references, near-equal times, same-day file rows.

Rows have an arrival order ``seq``. Near-equal times and same-day rows are greedy (what was kept decides), so they are folds
in that order. A fold streams over sorted rows and holds what was kept nearby or counted so far, never its whole group. An
amount's history is cut where nothing on one side can decide on the other, so that a frequent amount is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import rules as R
from spendspark.store import written

#: What decides on a row: it came before or has a reference (kept in any case), an exact time, or a mere day.
PINNED, EXACT, DAILY = "pinned", "exact", "daily"


def first_of(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first row for each key; rows without a key all stay."""
    keyed = rows.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return first.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns]).unionByName(rows.where(F.col(key).isNull()))


def new_only(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: rows whose key the store doesn't hold."""
    return rows.join(store.select(key).distinct(), key, "left_anti")


_KEY = ["amount_paise", "direction"]
_CHAIN = [*_KEY, "chain_day", "chain"]


def chains(rows: DataFrame, gap_ms: int) -> DataFrame:
    """Adds chain_day and chain: rows of one amount and direction can only decide on each other within a chain. A day with a
    DAILY row is in one chain; other rows are while their times are no further apart than the gap, over midnight as well.

    A frequent amount is cut at its days first and at its gaps within them; what is added up over days is one row for each.
    """
    within = Window.partitionBy(*_KEY, "day")
    by_time = within.orderBy("occurred_at", "id")
    at, point = F.col("occurred_at"), F.when(F.col("kind") != DAILY, F.col("occurred_at"))
    fresh = F.when(F.max((F.col("kind") == DAILY).cast("int")).over(within) == 1, 0).otherwise((at - F.lag(at).over(by_time) > gap_ms).cast("int"))
    cut = rows.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("part", F.sum("fresh").over(by_time)).drop("fresh")
    cut = written(cut, "parts")  # it meets its own days
    days = cut.groupBy(*_KEY, "day").agg(F.max("part").alias("last_part"), F.min(point).alias("first_at"), F.max(point).alias("last_at"))
    over = Window.partitionBy(*_KEY).orderBy("day")
    linked = F.coalesce(F.col("first_at") - F.lag("last_at").over(over) <= gap_ms, F.lit(False))
    # The chain that a day ends in: its own, if it has several or begins one, else that of the day before.
    ends = F.last(F.when((F.col("last_part") > 0) | ~F.col("linked"), F.struct("day", F.col("last_part").alias("part"))), ignorenulls=True)
    tied = days.withColumn("linked", linked).withColumn("ends", ends.over(over)).withColumn("before", F.lag("ends").over(over)).select(*_KEY, "day", "linked", "before")
    joined = cut.join(tied, [*_KEY, "day"])
    first = (F.col("part") == 0) & F.col("linked")
    return joined.select(*rows.columns, F.when(first, F.col("before.day")).otherwise(F.col("day")).alias("chain_day"), F.when(first, F.col("before.part")).otherwise(F.col("part")).alias("chain"))


class Near:
    """Times that were kept, as the first and last of each account and stretch as long as the gap: a look-up takes as long
    whatever their number. Accounts are named "=" and their digits, "-" is none, "" stands for all."""

    def __init__(self, gap_ms: int, spans: dict[tuple[str, int], tuple[int, int]] | None = None):
        self.gap, self.cell, self.spans = gap_ms, max(gap_ms, 1), {} if spans is None else spans

    @staticmethod
    def fitting(tail: str | None) -> tuple[str, ...]:
        """An account fits itself and rows without one; a row without one fits all."""
        return ("",) if tail is None else ("=" + tail, "-")

    @staticmethod
    def names(tail: str | None) -> tuple[str, str]:
        return "", "-" if tail is None else "=" + tail

    def hides(self, at: int, tail: str | None) -> bool:
        """Whether a fitting time within the gap was kept."""
        place = at // self.cell
        for who in self.fitting(tail):
            low, high = self.spans.get((who, place - 1)), self.spans.get((who, place + 1))
            if (who, place) in self.spans or (low and low[1] >= at - self.gap) or (high and high[0] <= at + self.gap):
                return True
        return False

    def keep(self, at: int, tail: str | None) -> None:
        for who in self.names(tail):
            first, last = self.spans.get((who, at // self.cell), (at, at))
            self.spans[who, at // self.cell] = min(first, at), max(last, at)


def _fold(gap_ms: int):
    """Judges rows sorted by chain and arrival. What it holds of a chain are times as ``Near`` has them, and counts for each day
    and account."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, near, counts, seen = None, Near(gap_ms), {}, {}
        for batch in batches:
            flags, numbers = [], []
            for *own, at, day, tail, kind, run in zip(*[batch[c].to_pylist() for c in (*_CHAIN, "occurred_at", "day", "account_tail", "kind", "run")]):
                if own != group:
                    group, near, counts, seen = own, Near(gap_ms), {}, {}
                stays, number = True, None
                if kind == EXACT:
                    stays = not near.hides(at, tail)
                elif kind == DAILY:
                    number = seen[run, day, tail] = seen.get((run, day, tail), 0) + 1
                    stays = sum(counts.get((day, who), 0) for who in Near.fitting(tail)) < number
                if stays:
                    near.keep(at, tail)
                    for who in Near.names(tail):
                        counts[day, who] = counts.get((day, who), 0) + 1
                flags.append(stays)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(flags, pa.bool_()), pa.array(numbers, pa.int32())], names=["id", "kept", "occurrence"])

    return work


def greedy(rows: DataFrame, gap_ms: int = R.NEAR_MS) -> DataFrame:
    """id, kept and occurrence of each row, in one pass over rows of all kinds: what was kept before a row decides on it.

    EXACT rows are dropped if a row of their amount, direction and account (or one has none) is kept within the gap. DAILY rows
    are numbered within their run, day, amount, direction and account; the n-th is dropped if n rows of its day whose account
    fits are kept already, whatever their kind. PINNED rows are kept, and count for all others.

    rows: id, seq (order of arrival, stored rows first), kind, run, day, amount_paise, direction, account_tail, occurred_at. Rows
    without an amount, a direction or a time equal no other and are kept.
    """
    whole = F.col("amount_paise").isNotNull() & F.col("direction").isNotNull() & F.col("day").isNotNull()
    needed = ["id", "seq", "kind", "run", "day", *_KEY, "account_tail", "occurred_at"]
    chained = chains(rows.where(whole).select(*needed), gap_ms)
    judged = chained.repartition(*_CHAIN).sortWithinPartitions(*_CHAIN, "seq", "id").mapInArrow(_fold(gap_ms), "id long, kept boolean, occurrence int")
    rest = rows.where(~whole).select("id", F.lit(True).alias("kept"), F.when(F.col("kind") == DAILY, 1).cast("int").alias("occurrence"))
    return judged.unionByName(rest)


def near_duplicates(txns: DataFrame, gap_ms: int = R.NEAR_MS) -> DataFrame:
    """id and kept. A row without a reference is dropped if a kept row that arrived before has its amount, direction and
    account (or one has none) and a time within the gap. Rows with a reference are kept, and count as kept for others.

    txns: id, seq, amount_paise, direction, account_tail, occurred_at, ref_no; id and seq are unique.
    """
    kind = F.when(F.col("ref_no").isNull(), EXACT).otherwise(PINNED)
    day = F.floor(F.col("occurred_at") / R.DAY_MS)
    return greedy(txns.select("*", kind.alias("kind"), F.lit(0).alias("run"), day.alias("day")), gap_ms).select("id", "kept")


def occurrence_numbers(rows: DataFrame) -> DataFrame:
    """Adds ``occurrence``: 1, 2, 3 ... among rows of one day, amount, direction and account, in file order."""
    by = Window.partitionBy("day", "amount_paise", "direction", F.coalesce("account_tail", F.lit("-"))).orderBy("id")
    return rows.withColumn("occurrence", F.row_number().over(by))


def same_day_new(rows: DataFrame, store: DataFrame) -> DataFrame:
    """File rows that the store lacks, with ``occurrence``: the n-th of a day, amount, direction and account is new if fewer
    than n rows of that day, amount and direction are stored whose account fits (none on a side fits any). Rows that are kept
    count as stored for those after them. Rows with a reference, where there is a column ``ref_no``, are kept and take no
    number, but count as stored.

    A day, amount and direction is folded in file order; all that is held is one count for each account.
    """
    key = ["day", "amount_paise", "direction"]
    has_ref = F.col("ref_no").isNotNull() if "ref_no" in rows.columns else F.lit(False)
    counted = store.groupBy(*key, "account_tail").agg(F.count("*").alias("__stored"))
    given = [f.name for f in rows.schema.fields]
    file = rows.select(*given, F.lit(None).cast("bigint").alias("__stored"), has_ref.alias("__ref"))
    both = file.unionByName(counted.withColumn("__ref", F.lit(False)), allowMissingColumns=True)
    # Stored counts come before the file's rows.
    dealt = both.repartition(*key).sortWithinPartitions(*key, F.col("__stored").isNull(), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stored, seen, total = None, {}, {}, 0
        for batch in batches:
            keep, numbers = [], []
            for *own, tail, n, ref in zip(*[batch[c].to_pylist() for c in (*key, "account_tail", "__stored", "__ref")]):
                if own != group:
                    group, stored, seen, total = own, {}, {}, 0
                number, new = None, n is None
                if new and not ref:
                    number = seen[tail] = seen.get(tail, 0) + 1
                    new = number > (total if tail is None else stored.get(tail, 0) + stored.get(None, 0))
                keep.append(new)
                numbers.append(number)
                more = n if n is not None else int(new)
                stored[tail] = stored.get(tail, 0) + more
                total += more
            mask = pa.array(keep, pa.bool_())
            out = pa.RecordBatch.from_arrays([*[batch[c] for c in given], pa.array(numbers, pa.int32())], names=[*given, "occurrence"])
            yield out.filter(mask)

    schema = T.StructType([*rows.schema.fields, T.StructField("occurrence", T.IntegerType())])
    return dealt.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
