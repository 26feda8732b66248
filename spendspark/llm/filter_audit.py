"""Operator 11: how filters overlap, and which order of them removes what.

Each document gets a mask with one bit for each filter that it fails, whichever runs first; all orders of the filters follow
from counts of masks. Four filters are columns. The fifth, copies, is found by sorting: documents are dealt in ranges of text
fingerprint and doc_id, sorted in each range by fingerprint, full text and doc_id, and compared with their predecessors. The
text itself is no range key, as the driver draws a sample of those. A run of equal texts that a range's border cuts (a hot
text spans many ranges) is mended by what each range says of its first and last runs. Masks are then counted for each part
and merged by adding, so all that is left for the orders is one row for each part and mask.

Cases: null text counts as empty, null part as the empty string; empty texts are copies of each other. A row without a doc_id
is a copy of nothing and nothing is a copy of it; rows of one doc_id and text (repeated rows) are no copies of each other, as
none has the smaller id. A document with several labels is good, or toxic, if any of them says so. Texts are read and compared
whole. Extra columns, whatever their names, are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.llm.common import quoted, small_enough, table, written

#: Fixed: what separates words.
_GAPS = r"[\x20\x09-\x0D]+"
COPY = "E"
_NEVER = (1 << 63) - 1
_JUDGED = "edge boolean, range int, run int, doc_id long, smallest long, part string, mask int, fingerprint long, text string"


def conditions(text: Column, words: Column, distinct: Column) -> dict[str, Column]:
    """The filters that look at one text: name and when it fails. ``words`` and ``distinct`` are counts."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": words < 200, "B": distinct * 100 < words * 50, "C": capitals * 100 > F.length(text) * 3, "D": text.rlike("[#$%&*|]")}


def masked(rows: DataFrame) -> DataFrame:
    """Adds mask (bit i: the i-th filter of ``conditions`` fails) to rows with a text."""
    two = rows.select("*", F.filter(F.split("text", _GAPS), lambda w: w != "").alias("words"))
    three = two.select(*rows.columns, F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("m"))
    fails = conditions(F.col("text"), F.col("n"), F.col("m"))
    return three.select(*rows.columns, sum((c.cast("int") * (1 << i) for i, c in enumerate(fails.values())), F.lit(0)).alias("mask"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal texts of a sorted range. Rows carry their run's smallest doc_id; after them come the runs of
    the first and of the last fingerprint, which other ranges may hold as well."""
    from pyspark import TaskContext

    place, schema = TaskContext.get().partitionId(), pa.schema([("edge", pa.bool_()), ("range", pa.int32()), ("run", pa.int32()), ("doc_id", pa.int64()), ("smallest", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("fingerprint", pa.int64()), ("text", pa.string())])
    run, smallest, last, first, heads, tails = -1, _NEVER, None, None, {}, {}
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        prints, texts = b["fingerprint"], b["text"]
        ids = pc.fill_null(b["doc_id"], _NEVER).to_numpy(zero_copy_only=False)
        marks = prints.to_numpy(zero_copy_only=False)
        starts = np.ones(n, bool)
        starts[1:] = ~pc.and_(pc.equal(prints.slice(1), prints.slice(0, n - 1)), pc.equal(texts.slice(1), texts.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        starts[0] = last is None or last[0] != marks[0] or last[1] != texts[0].as_py()
        runs = run + np.cumsum(starts)
        at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        least = np.where(at < 0, smallest, ids[np.maximum(at, 0)])
        if first is None:
            first = marks[0]
        if last is None or marks[-1] != last[0]:
            tails = {}
        for i in np.flatnonzero(starts & ((marks == first) | (marks == marks[-1]))):
            own = int(runs[i]), (int(marks[i]), texts[int(i)].as_py(), int(ids[i]))
            if marks[i] == first:
                heads[own[0]] = own[1]
            if marks[i] == marks[-1]:
                tails[own[0]] = own[1]
        run, smallest, last = int(runs[-1]), int(least[-1]), (marks[-1], texts[n - 1].as_py())
        nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(np.full(n, place, np.int32)), pa.array(runs.astype(np.int32)), b["doc_id"], pa.array(least), b["part"].cast(pa.string()), b["mask"], *nothing], schema=schema)
    edges = list((heads | tails).items())
    if edges:
        n = len(edges)
        columns = [[True] * n, [place] * n, [r for r, _ in edges], [None] * n, [e[2] for _, e in edges], [None] * n, [None] * n, [e[0] for _, e in edges], [e[1] for _, e in edges]]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def failing(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and the whole mask, copies as its last bit."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(quoted(part)), F.lit("")).alias("part"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    rows = whole.withColumn("fingerprint", F.xxhash64("text"))
    bit = 1 << len(conditions(F.lit(""), F.lit(0), F.lit(0)))
    # Equal texts without an id would go to one range; numbers spread them.
    dealt = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id()))).repartitionByRange("fingerprint", "doc_id", "spread").drop("spread")
    # Masks come after the ranges, which are drawn in a pass of their own over what they are drawn from.
    judged = written(masked(dealt.sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())).mapInArrow(_runs, _JUDGED), "filter-masks")
    # A run that several ranges hold is at the border of each of them: its smallest id is the smallest of what they say.
    edges = judged.where("edge").groupBy("fingerprint", "text").agg(F.min("smallest").alias("first"), F.collect_list(F.struct("range", "run")).alias("places"))
    edges = written(edges.select("first", F.explode("places").alias("p")).select("p.range", "p.run", "first"), "filter-edges")
    rows = judged.where("NOT edge").join(small_enough(edges, edges.count(), 32), ["range", "run"], "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("first", "smallest"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + copy.cast("int") * bit).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: how many documents of a part fail just these filters, and how many of them are so labelled."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = masks.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    bare = masks.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long").alias(c)
    return named.unionByName(bare).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from counts of masks alone."""
    bit = {f: 1 << i for i, f in enumerate(letters)}
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "own": bit[f], "before": sum(bit[g] for g in order[:i])}
        for order in permutations(letters) for i, f in enumerate(order)
    ]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c")).select("part", "c", F.explode(plan).alias("s")).select("part", "c", "s.*")
    own, before, none = F.col("own"), F.col("before"), F.lit(0).cast("long")
    total = lambda when, of: F.aggregate(F.filter("c", when), none, lambda a, x: a + of(x))
    fails, met = lambda x: x["mask"].bitwiseAND(own) != 0, lambda x: x["mask"].bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~met(x)
    # Of all orders, a share of one in as many as fail a document has this filter first.
    share = lambda x: x["n"] * (F.lit(factorial(len(letters))) / F.bit_count(x["mask"])).cast("long")
    return each.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~met(x), lambda x: x["n"]).alias("kept"), total(removed, lambda x: x["n"]).alias("removed"),
        total(lambda x: fails(x) & met(x), lambda x: x["n"]).alias("redundant"), total(lambda x: x["mask"] == own, lambda x: x["n"]).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"), total(removed, lambda x: x["toxic"]).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """All orders of all filters over all documents."""
    return orders(counters(failing(docs, text, part), labels), "".join(conditions(F.lit(""), F.lit(0), F.lit(0))) + COPY)


def op11(spark, sf_dir: str) -> DataFrame:
    """The five filters in all 120 orders, for each language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
  JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, n, good, toxic, fails, own, contains(fails, own) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '-]') AS met FROM c, s)
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN NOT hit AND NOT met THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT met THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN hit AND met THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN hit AND NOT met THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT met THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN hit THEN n * 120 // length(fails) ELSE 0 END)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""
