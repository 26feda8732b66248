"""Categories of transactions: memory, then a hashed linear model, then a lexicon, then a default by direction.

Features are native columns: strings hashed by 32-bit FNV-1a into signed buckets. The model is trained by SGD, which depends
on order, on at most CONFIRMED_ROWS confirmed rows; scoring is distributed over all rows, in batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import lexicon as index


#: Confirmed rows that a model learns from at most.
CONFIRMED_ROWS = 20_000


def amount_band(paise: Column) -> Column:
    out = F.lit(len(R.AMOUNT_BANDS))
    for i in reversed(range(len(R.AMOUNT_BANDS))):
        out = F.when(paise / 100.0 < R.AMOUNT_BANDS[i], i).otherwise(out)
    return out


def fnv1a(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a over UTF-16 code units, as bigint: a code point above 0xFFFF is two of them."""
    high = lambda p: F.lit(0xD800).cast("bigint") + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00).cast("bigint") + (p - 0x10000).bitwiseAND(F.lit(0x3FF).cast("bigint"))
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    # Few texts hold such a code point; the rest are taken as they are.
    units = lambda ps: F.flatten(F.transform(ps, lambda p: F.when(p > 0xFFFF, F.array(high(p), low(p))).otherwise(F.array(p))))
    codes = F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), units(points)).otherwise(points)
    return F.aggregate(codes, F.lit(R.FNV_OFFSET).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(R.FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def bucket(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(R.BUCKETS - 1)).cast("int")


def sign(hash_: Column) -> Column:
    return F.when(F.shiftright(hash_, 17).bitwiseAND(F.lit(1).cast("bigint")) == 1, 1).otherwise(-1)


def grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(f"g{n}="), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def features(merchant: Column, handle: Column, channel: Column, paise: Column, occurred_at: Column, zone: str) -> Column:
    m = F.coalesce(merchant, F.lit(""))
    padded = F.concat(F.lit("^"), m, F.lit("$"))
    tokens = F.transform(F.filter(F.split(m, " "), lambda w: w != ""), lambda w: F.concat(F.lit("w="), w))
    named = F.concat(F.array(F.concat(F.lit("m="), m)), grams(padded, 3), grams(padded, 4), grams(padded, 5), tokens)
    hour = F.floor(X.local_ms(occurred_at, zone) / 3_600_000) % 24
    rest = [F.concat(F.lit("c="), channel), F.concat(F.lit("a="), amount_band(paise).cast("string")), F.concat(F.lit("t="), F.floor(hour / 4).cast("string")), F.concat(F.lit("d="), (F.weekday(X.local_day(occurred_at, zone)) + 1).cast("string")), F.lit("bias=1")]
    owner = F.when(handle.isNotNull(), F.array(F.concat(F.lit("h="), handle))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.when(m != "", named).otherwise(F.array(F.lit("m=<none>"))), owner, F.array(*rest))


def vector(names: Column) -> Column:
    """Array of idx and val, by idx: signs summed per bucket, scaled to length 1; buckets that cancel out stay with 0."""
    pairs = F.transform(names, lambda f: X.bound(fnv1a(f), lambda h: F.struct(bucket(h).alias("idx"), sign(h).alias("s"))))

    def summed(p: Column) -> Column:
        each = F.array_distinct(F.transform(p, lambda x: x["idx"]))
        total = lambda i: F.aggregate(F.filter(p, lambda x: x["idx"] == i), F.lit(0), lambda a, x: a + x["s"])
        return F.transform(F.array_sort(each), lambda i: F.struct(i.alias("idx"), total(i).alias("s")))

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0), lambda a, x: a + x["s"] * x["s"]))
        return X.bound(F.struct(v.alias("v"), norm.alias("n")), lambda b: F.transform(b["v"], lambda x: F.struct(x["idx"].alias("idx"), F.when(b["n"] > 0, x["s"] / b["n"]).otherwise(0.0).alias("val"))))

    return X.bound(X.bound(pairs, summed), scaled)


def vectors(rows: DataFrame, key: str, names: str = "features") -> DataFrame:
    """key, idx and val of each active bucket. Local to a row, so nothing is shuffled."""
    return rows.select(key, F.explode(vector(F.col(names))).alias("v")).select(key, "v.*")


def lexicon(spark: SparkSession, words: dict[str, str] | None = None) -> DataFrame:
    """pattern and category; by default the general words."""
    rows = [(w, c) for c, ws in (words or R.LEXICON).items() for w in ws.split()]
    return spark.createDataFrame(rows, "pattern string, category string")


def lexicon_hit(text: Column, entries: list[tuple[str, str]], least: int = 0) -> Column:
    """Category of the longest pattern that the text holds, the first of equals. ``entries``: a lexicon, which is small."""
    ordered = sorted([e for e in entries if len(e[0]) >= least], key=lambda e: -len(e[0]))
    if not ordered:
        return F.lit(None).cast("string")
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in ordered])
    low = F.lower(text)
    return F.get(F.filter(table, lambda e: F.contains(low, e["p"])), F.lit(0))["c"]


class LinearModel:
    """Softmax regression in float32: weights (label, bucket), a bias for each label, and a count of steps."""

    MAGIC, FORMAT, LABELS = 0x464D444C, 1, 1

    def __init__(self, weights: np.ndarray | None = None, bias: np.ndarray | None = None, steps: int = 0):
        n = len(R.CATEGORIES)
        self.weights = np.zeros((n, R.BUCKETS), np.float32) if weights is None else weights
        self.bias = np.zeros(n, np.float32) if bias is None else bias
        self.steps = steps

    def probabilities(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        z = self.weights[:, idx].astype(np.float64) @ val + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def step(self, idx: np.ndarray, val: np.ndarray, label: int, rate: float) -> None:
        """One gradient step on the active buckets; an empty vector changes nothing."""
        if not len(idx):
            return
        g = self.probabilities(idx, val)
        g[label] -= 1
        self.weights[:, idx] -= (rate * (np.outer(g, val) + R.DECAY * self.weights[:, idx])).astype(np.float32)
        self.bias -= (rate * g).astype(np.float32)
        self.steps += 1

    def to_bytes(self) -> bytes:
        head = struct.pack("<6i", self.MAGIC, self.FORMAT, self.LABELS, len(R.CATEGORIES), R.BUCKETS, self.steps)
        return head + self.weights.astype("<f4").tobytes() + self.bias.astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes | None) -> LinearModel | None:
        """None for anything but a blob of this format, label set and size."""
        n = len(R.CATEGORIES)
        if blob is None or len(blob) != 24 + 4 * n * (R.BUCKETS + 1):
            return None
        head = struct.unpack("<6i", blob[:24])
        if head[:5] != (cls.MAGIC, cls.FORMAT, cls.LABELS, n, R.BUCKETS):
            return None
        values = np.frombuffer(blob, "<f4", offset=24).astype(np.float32)
        return cls(values[: n * R.BUCKETS].reshape(n, R.BUCKETS).copy(), values[n * R.BUCKETS :].copy(), head[5])


def _examples(rows: DataFrame, key: str, bound: int = CONFIRMED_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Confirmed rows as vectors with labels, by key: the first ``bound`` in order of a hash of the key."""
    known = rows.where(F.col("category").isin(R.CATEGORIES)).orderBy(F.xxhash64(key), key).limit(bound)
    found = known.select(key, "category", vector(F.col("features")).alias("v")).collect()
    return [(np.array([x["idx"] for x in r.v], dtype=np.int64), np.array([x["val"] for x in r.v]), R.CATEGORIES.index(r.category)) for r in sorted(found, key=lambda r: r[key])]


def retrained(confirmed: DataFrame, key: str = "id", seed: int = 0, bound: int = CONFIRMED_ROWS) -> LinearModel:
    """EPOCHS shuffled passes over confirmed rows (key, features, category), of which it learns from ``bound`` at most."""
    model, examples, draw = LinearModel(), _examples(confirmed, key, bound), np.random.default_rng(seed)
    for _ in range(R.EPOCHS):
        for i in draw.permutation(len(examples)):
            model.step(*examples[i], R.EPOCH_RATE)
    return model


def model_figures(model: LinearModel) -> dict[str, object]:
    """Steps, whether the model is trusted yet, and bytes of its weights."""
    return {"steps": model.steps, "trusted": model.steps >= R.TRUST_STEPS, "bytes": model.weights.nbytes}


def learned(model: LinearModel, fresh: DataFrame, confirmed: DataFrame, key: str = "id", seed: int = 0) -> LinearModel:
    """A correction: FRESH_STEPS steps on it, then a replay of up to REPLAY_ROWS other confirmed rows, drawn at random."""
    for example in _examples(fresh, key):
        for _ in range(R.FRESH_STEPS):
            model.step(*example, R.FRESH_RATE)
    others = confirmed.join(fresh.select(key), key, "left_anti").orderBy(F.rand(seed), key).limit(R.REPLAY_ROWS)
    for example in _examples(others, key):
        model.step(*example, R.REPLAY_RATE)
    return model


def scored(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Adds ``model_category`` and ``model_p`` from the features of each row, in Arrow batches; nulls before the model is trusted."""
    if model.steps < R.TRUST_STEPS:
        return rows.withColumns({"model_category": F.lit(None).cast("string"), "model_p": F.lit(None).cast("double")})
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # a fixed megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sparse product for a batch: the weights of all active buckets, summed by row.
        weights, bias = shared.value
        for batch in batches:
            *own, vectors_ = batch.columns
            flat, sizes = vectors_.flatten(), pc.fill_null(pc.list_value_length(vectors_), 0).to_numpy(zero_copy_only=False)
            idx, val = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            z = np.tile(bias.astype(np.float64), (len(sizes), 1))
            full = np.flatnonzero(sizes)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                z[full] += np.add.reduceat(weights[:, idx].T * val[:, None], starts, axis=0)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            k = p.argmax(axis=1)
            found = [pa.array([R.CATEGORIES[i] for i in k], pa.string()), pa.array(p[np.arange(len(k)), k])]
            yield pa.RecordBatch.from_arrays([*own, *found], names=schema.names)

    inputs = rows.withColumn("__v", vector(F.col("features")))
    schema = T.StructType([*rows.schema.fields, T.StructField("model_category", T.StringType()), T.StructField("model_p", T.DoubleType())])
    return inputs.mapInArrow(work, schema)


def classified(rows: DataFrame, memory: DataFrame, model: LinearModel, entries: list[tuple[str, str]] | DataFrame, body: Column | None = None) -> DataFrame:
    """Adds category, category_source, confidence and needs_review by the first layer that knows.

    rows: merchant_norm, direction, features; memory: merchant_norm, category. ``entries``: a lexicon of some words as a list, or
    one of any size as a table (pattern, category); rows need a unique ``id`` then.
    """
    known = memory.select("merchant_norm", F.col("category").alias("__memory"))
    met = scored(rows, model).join(known, "merchant_norm", "left")
    if isinstance(entries, DataFrame):
        named = index.longest(rows.select("id", "merchant_norm"), "id", "merchant_norm", entries).select("id", F.col("category").alias("__named"))
        met = met.join(named, "id", "left")
        if body is not None:
            told = index.longest(rows.select("id", body.alias("__body")), "id", "__body", entries.where(F.length("pattern") >= 5))
            met = met.join(told.select("id", F.col("category").alias("__told")), "id", "left")
        met = met.withColumn("__seed", F.coalesce("__named", "__told") if body is not None else F.col("__named"))
    else:
        seed = F.coalesce(lexicon_hit(F.col("merchant_norm"), entries), lexicon_hit(body, entries, 5) if body is not None else F.lit(None).cast("string"))
        met = met.withColumn("__seed", seed)
    trusted = F.coalesce(F.col("model_p") >= R.ACCEPT, F.lit(False))
    pick = lambda a, b, c, d: F.when(F.col("__memory").isNotNull(), a).when(trusted, b).when(F.col("__seed").isNotNull(), c).otherwise(d)
    debit = F.col("direction") == "DEBIT"
    return met.select(
        *rows.columns,
        pick(F.col("__memory"), F.col("model_category"), F.col("__seed"), F.when(debit, "Other").otherwise("Income")).alias("category"),
        pick(F.lit("MEMORY"), F.lit("MODEL"), F.lit("SEED"), F.lit("NONE")).alias("category_source"),
        pick(F.lit(1.0), F.col("model_p"), F.lit(R.SEED_CONFIDENCE), F.lit(0.0)).alias("confidence"),
        pick(F.lit(False), F.lit(False), debit, debit).alias("needs_review"),
    )
