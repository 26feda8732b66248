"""Operator 4: near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text becomes a set of word shingles; texts with the same words are one class, whatever their number. A class gets a
   MinHash signature of BANDS * ROWS values.
2. Bands of the signatures deal classes into buckets. Inside a bucket signatures are compared in batches; after each batch a
   pair is pruned once the posterior probability that its similarity reaches the threshold falls below MISS.
3. Survivors are confirmed on full shingle sets. This runs twice, so that large families of copies are neither expanded into
   all pairs nor cut: first only the best earlier partner of each class in a bucket, from which components are made; then
   every surviving pair between different components. What is skipped can only lie within one component.

Buckets above BLOCK classes are split into blocks, and blocks are compared in pairs, so no task ever holds a whole hot bucket.
Steps are written to the shared folder, so a lost executor costs its tasks only. Signatures are of shingles' hashes; sets are
counted, and links confirmed, on the words themselves.

A pair of similarity s is missed with probability (1 - s**ROWS)**BANDS, 3e-6 at 0.8, plus MISS.

Cases: a null text, or one without words, has no shingles and is linked with nothing; a text with fewer words than a shingle
is one shingle; rows without an id are linked with nothing and kept; rows that repeat an id are judged by their own text;
ties go to the smallest id; extra columns are ignored by ``components`` and kept by ``first_of_each``; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from spendspark.llm.common import arrow_columns, numbered, quoted, small_enough, table, written

BANDS, ROWS, BATCH, MISS, BLOCK = 32, 5, 32, 1e-6, 2048
#: Shingles are told apart by so many bits in the test that precedes confirmation; it can only find too many in common.
BITS = 20
SIZE = BANDS * ROWS
_ODD, _U = 0x9E3779B97F4A7C15, np.uint64


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_229)
    return draw.integers(0, 1 << 31, SIZE, dtype=np.uint32) << 1 | 1, draw.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def normalised(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, joined by one blank."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _key(joined: bytes) -> bytes | None:
    """The class of a text's words; null without words."""
    return hashlib.md5(joined, usedforsecurity=False).digest() if joined else None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingle_set(words: bytes, size: int) -> tuple[np.ndarray, int]:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words (with fewer words, of all of them as one), and how many
    distinct shingles there are, counted on the words."""
    if not words:
        return np.zeros(0, dtype=_U), 0
    parts = words.split(b" ")
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in parts), dtype=np.int64, count=len(parts))
    each = np.fromiter(map(xxh3_64_intdigest, numbers), dtype=_U, count=len(numbers))[at]
    size = min(size, len(parts))
    n = len(parts) - size + 1
    hashes = _mixed(each[:n])
    for k in range(1, size):
        hashes = _mixed(hashes * _U(_ODD) + each[k : k + n])
    distinct = np.unique(hashes)
    if len(distinct) == n:
        return distinct, n
    first = np.searchsorted(hashes, distinct, sorter=(order := np.argsort(hashes, kind="stable")))
    stands_for = order[first][np.searchsorted(distinct, hashes)]
    if all((at[stands_for + k] == at[k : k + n]).all() for k in range(size)):
        return distinct, len(distinct)
    return distinct, len(np.unique(np.stack([at[k : k + n] for k in range(size)], axis=1), axis=0))


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of SIZE minima, little-endian: equal minima stay equal, others meet once in 65,536."""
    a, b = _multipliers()
    low = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
    folded = (shingles >> _U(32)).astype(np.uint32)
    for i in range(0, len(folded), 1024):
        np.minimum(low, ((folded[None, i : i + 1024] ^ b[:, None]) * a[:, None]).min(axis=1), out=low)
    return low.astype("<u2").tobytes()


def least_matches(percent: int) -> np.ndarray:
    """For n compared values, the fewest matches m for which P(similarity >= threshold | m of n) is still MISS.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial's lower tail.
    """
    t, out = percent / 100, np.zeros(SIZE + 1, dtype=np.int64)
    for n in range(1, SIZE + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                out[n] = m
                break
    return out


def surviving(one: np.ndarray, others: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the signatures in ``others`` that the sequential test against ``one`` leaves, and their matches."""
    left, matches = np.arange(len(others)), np.zeros(len(others), dtype=np.int64)
    for i in range(0, SIZE, BATCH):
        n = min(i + BATCH, SIZE)
        matches = matches + (others[left, i:n] == one[i:n]).sum(axis=1)
        stay = matches >= least[n]
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left, matches


def sketches(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (of the class of texts with the same words), n_shingles and signature of each row."""

    def run(texts):
        keys, sizes, signatures = [], [], []
        for t in texts:
            joined = normalised(t)
            own, n = shingle_set(joined, words)
            keys.append(_key(joined))
            sizes.append(n)
            signatures.append(signature(own) if joined else None)
        return [keys, sizes, signatures]

    fields = [T.StructField("key", T.BinaryType()), T.StructField("n_shingles", T.LongType(), False), T.StructField("signature", T.BinaryType())]
    return arrow_columns(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("__text")), "__text", fields, lambda: run, keep_source=False)


def band_rows(classes: DataFrame) -> DataFrame:
    """A row for each band of each class: bucket, band and node."""
    width = 4 * ROWS
    digits = F.hex("signature")
    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(digits, i * width + 1, F.lit(width))).alias("bucket")))
    return classes.select("node", F.explode(values).alias("b")).select("b.bucket", "b.band", "node")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, from sorted batches; holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _may_reach(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` may reach the threshold with ``one``, by the low bits of all their shingles."""
    if not others:
        return np.zeros(0, dtype=bool)
    there = np.zeros(1 << BITS, dtype=bool)
    there[one] = True
    sizes = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    common = np.add.reduceat(there[np.concatenate(others)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= percent * (len(one) + sizes - common)


def candidate_pairs(members: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (x, y) of a bucket that the sequential test leaves.

    members: bucket, band, part_a, part_b, part, node, component, signature. With ``best_only`` each class is paired with the
    earlier class that matches best; else with all classes of other components, each pair in its first common band only and
    if the low bits of their whole shingle sets (column ``low``) leave it possible.
    """
    least = least_matches(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches, 3):
            if run.num_rows < 2:
                continue
            a, b = run["part_a"][0].as_py(), run["part_b"][0].as_py()
            band = run["band"][0].as_py()
            node, component, part = (run[c].to_numpy() for c in ("node", "component", "part"))
            lows = None if best_only else [np.frombuffer(x, dtype="<u4") for x in run["low"].to_pylist()]
            values = np.frombuffer(b"".join(run["signature"].to_pylist()), dtype="<u2").reshape(-1, SIZE)
            order = np.argsort(node, kind="stable")
            node, component, part, values = node[order], component[order], part[order], values[order]
            lows = lows and [lows[k] for k in order]
            xs, ys = [], []
            for i in range(1, len(node)):
                allowed = np.flatnonzero((component[:i] != component[i]) & ((part[:i] != part[i]) | (a == b)))
                left, matches = surviving(values[i], values[allowed], least) if len(allowed) else (allowed, allowed)
                if best_only and len(left):
                    left = left[[matches.argmax()]]
                elif len(left):
                    same = (values[allowed[left], : band * ROWS] == values[i, : band * ROWS]).reshape(len(left), band, ROWS).all(axis=2).any(axis=1)
                    left = left[~same]
                    left = left[_may_reach(lows[i], [lows[k] for k in allowed[left]], percent)]
                xs.append(node[allowed[left]])
                ys.append(np.full(len(left), node[i]))
            if xs and sum(map(len, xs)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])

    dealt = members.repartition("bucket", "part_a", "part_b").sortWithinPartitions("bucket", "part_a", "part_b")
    return dealt.select("bucket", "part_a", "part_b", "part", "band", "node", "component", "signature", *([] if best_only else ["low"])).mapInArrow(work, "x long, y long")


def in_blocks(buckets: DataFrame) -> DataFrame:
    """Splits buckets of ``size`` over BLOCK into blocks, and gives each pair of blocks a group of its own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    rows = buckets.select("bucket", "band", "node", own.alias("part"), blocks.alias("blocks"))
    rows = rows.select("bucket", "band", "node", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("bucket", "band", "node", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))


def _shingles(words: Column, size: int) -> Column:
    """The shingles of an array of words as strings; with fewer words, all of them as one."""
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, whole).otherwise(F.array(F.array_join(words, " ")))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets of shingles, words compared as they are, are similar enough."""
    one, two = (texts.select(F.col("node").alias(k), F.col("joined").alias(f"joined_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "xy")
    both = pairs.join(one, "x").join(two, "y").where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    # The split texts are bound to a variable, as the condition below is moved to where they would be split for each shingle.
    split = F.array(F.struct(F.split("joined_x", " ").alias("x"), F.split("joined_y", " ").alias("y")))
    common = F.get(F.transform(split, lambda w: F.size(F.array_intersect(_shingles(w["x"], words), _shingles(w["y"], words)))), F.lit(0))
    return both.where((100 + percent) * common >= percent * (F.col("n_x") + F.col("n_y"))).select("x", "y")


def connected(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it is linked with over any way) for the nodes of ``links``.

    Large-star and small-star steps in turn, each a min per node and a join, until nothing changes.
    """
    edges, before = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), None
    edges = written(edges, "links")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
        edges = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "links")


def _texts(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """node, n_shingles, joined (the words) and low (bits of all shingles' hashes), for the classes in ``wanted`` (node, key, n_shingles)."""

    def run(texts):
        joined = [normalised(t) for t in texts]
        lows = [(shingle_set(j, words)[0] & _U((1 << BITS) - 1)).astype("<u4").tobytes() for j in joined]
        return [[_key(j) for j in joined], [j.decode("utf-8", "replace") for j in joined], lows]

    fields = [T.StructField("key", T.BinaryType()), T.StructField("joined", T.StringType(), False), T.StructField("low", T.BinaryType(), False)]
    texts = docs.select(F.col(quoted(doc_id)).alias("node"), F.col(quoted(text)).alias("__text"))
    few = small_enough(wanted.select("node").distinct(), wanted.count(), 16)
    found = arrow_columns(texts.join(few, "node", "left_semi"), "__text", fields, lambda: run, keep_source=False)
    # Repeated rows of one class are met once.
    return found.groupBy("node", "key").agg(F.first(F.struct("joined", "low")).alias("s")).select("node", "key", "s.*").join(wanted, ["node", "key"]).drop("key")


def components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id and kept for each row of ``docs``."""
    rows = written(sketches(docs, words, doc_id, text), "sketches")
    usable = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    heads = usable.join(classes.select(F.col("node").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
    heads = written(heads.groupBy(F.col("doc_id").alias("node"), "key").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "heads")

    bands = band_rows(heads)
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(in_blocks(bands.join(sizes, "bucket")), "buckets")
    wanted = members.select("node").distinct().join(heads.select("node", "key", "n_shingles"), "node")
    texts = written(_texts(docs, written(wanted, "wanted"), words, doc_id, text), "texts")
    signed = members.join(heads.select("node", "signature"), "node")

    first = candidate_pairs(signed.withColumn("component", F.col("node")), percent, best_only=True).distinct()
    links = written(confirmed(first, texts, words, percent), "pairs")
    joined = written(connected(links), "components")
    placed = signed.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Buckets that lie within one component have nothing left to compare.
    open_ = placed.groupBy("bucket", "part_a", "part_b").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").drop("c", "d")
    second = placed.join(open_, ["bucket", "part_a", "part_b"], "left_semi").join(texts.select("node", "low"), "node")
    second = candidate_pairs(second, percent, best_only=False).distinct()
    links = links.unionAll(written(confirmed(second, texts, words, percent), "pairs"))
    final = connected(links)

    named = rows.select("doc_id", "key", "n_shingles").join(classes.join(final, "node", "left").select("key", F.coalesce("component", "node").alias("c")), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return named.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of each component, with their own columns; a row that is repeated stays once."""
    judged = written(components(docs, words, percent), "judged")
    again = judged.where("kept AND doc_id IS NOT NULL AND key IS NOT NULL").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key")
    dropped = judged.where("NOT kept").select("doc_id", "key").unionAll(again).withColumnsRenamed({"doc_id": "__id", "key": "__k"}).distinct()
    # Hinted while they are few, so that whole documents aren't shuffled and sorted to find them.
    dropped = small_enough(dropped, dropped.count(), 64)
    inner, name = numbered(docs)
    keyed = arrow_columns(inner, name["text"], [T.StructField("__key", T.BinaryType())], lambda: lambda ts: [[_key(normalised(t)) for t in ts]])
    same = (F.col(name["doc_id"]) == F.col("__id")) & (F.col("__key") == F.col("__k"))
    kept = keyed.join(dropped, same, "left_anti").select(*inner.columns).toDF(*docs.columns)
    if again.isEmpty():
        return kept
    once = keyed.join(again.withColumnsRenamed({"doc_id": "__id", "key": "__k"}), same, "left_semi").dropDuplicates([name["doc_id"], "__key"])
    return kept.unionAll(once.select(*inner.columns).toDF(*docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a similarity of 0.8."""
    out = components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: The same rows by joining all shingles and following links from every class. Quadratic in a shingle's documents, so for small tables only.
SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
classes AS (SELECT ws, min(doc_id) AS node FROM words WHERE len(ws) > 0 AND doc_id IS NOT NULL GROUP BY ws),
sets AS (SELECT node, list_distinct(CASE WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingles FROM classes),
flat AS (SELECT node, len(shingles) AS n, hash(unnest(shingles)) AS h FROM sets),
links AS (SELECT a.node AS x, b.node AS y FROM flat a JOIN flat b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(node, other) AS (SELECT node, node FROM sets UNION SELECT r.node, l.other FROM reach r JOIN (SELECT x AS node, y AS other FROM links UNION ALL SELECT y, x FROM links) l ON l.node = r.other),
groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(len(s.shingles), 0) AS n_shingles, coalesce(g.component, w.doc_id) AS component_id, coalesce(g.component, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN classes c ON w.ws = c.ws LEFT JOIN sets s ON s.node = c.node LEFT JOIN groups g ON g.node = c.node"""
