"""A lexicon of any size: the longest pattern that a text holds, with patterns as a table.

Each pattern is filed under one of its grams, the one that fewest patterns have. A text is cut into its distinct grams, these
meet the index by a join, and only patterns that are filed under a gram of the text are looked for in it. So the work follows
the text's length, not the number of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark.functions import text as X
from spendspark.store import written

GRAM = 4
#: An index below so many bytes is sent to all tasks; a larger one is dealt by gram.
SENT_BYTES = 8 << 20


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters, in time linear in the text: single characters, and each with those after it."""
    return X.bound(F.filter(F.split(text, ""), lambda c: c != ""), lambda cs: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.array_join(F.slice(cs, i + 1, n), "")))) if n > 1 else F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>"))


def index(patterns: DataFrame) -> DataFrame:
    """gram, size (of the gram), pattern and category of each distinct pattern. patterns: pattern (lower case), category; of a
    pattern with several categories the first in order counts, empty ones are left out."""
    one = patterns.where("coalesce(pattern, '') <> ''").groupBy("pattern").agg(F.min("category").alias("category"))
    size = F.least(F.length("pattern"), F.lit(GRAM))
    sizes = F.when(F.length("pattern") >= GRAM, grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))
    each = one.select("pattern", "category", size.alias("size"), F.explode(sizes).alias("gram"))
    rare = each.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    return rare.groupBy("pattern", "category", "size").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def longest(rows: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """key, pattern and category of the longest pattern that each text (in lower case) holds, the first of equals; rows without
    any are left out. ``key`` is unique."""
    entries = written(index(patterns), "lexicon")
    n, chars, shortest = entries.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)), F.coalesce(F.min("size"), F.lit(GRAM))).first()
    low = rows.select(F.col(key), F.lower(F.col(text)).alias("low"))
    cut = F.concat(*[grams(F.col("low"), k) for k in range(shortest, GRAM + 1)])
    small = 4 * chars + 64 * n <= SENT_BYTES
    # The text travels with its grams only as far as a join within the task, where most of them end; a large index is dealt by
    # gram, and meets the key alone.
    each = low.select(key, *(["low"] if small else []), F.explode(cut).alias("gram"))
    met = each.join(F.broadcast(entries) if small else entries, "gram")
    met = (met if small else met.select(key, "pattern", "category").join(low, key)).where(F.contains("low", "pattern"))
    best = met.groupBy(key).agg(F.min_by(F.struct("pattern", "category"), F.struct(-F.length("pattern"), "pattern")).alias("b"))
    return best.select(key, "b.pattern", "b.category")
