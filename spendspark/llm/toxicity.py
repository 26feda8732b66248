"""Operator 10: toxicity by classifier chains.

Categories are predicted in order. The linear model of a later category sees, beside the words, the probabilities of the
earlier ones; in training these are out-of-fold, so a later model learns from probabilities as they will be on new text.

The models are fitted on a bounded sample of labelled documents: about SAMPLE_DOCS, chosen by a hash of the id, so the bound
holds at any size. Which words matter is counted in Spark over that sample; the driver gets at most WORDS_EACH words for a
category and, for each sampled document, the numbers of those words that it holds. Prediction is per text and needs no
shuffle.

Cases: a null or empty text has no words and gets the probability of such a text; long texts are read whole; labels that are
null are not learned from, and of several labels for a document the largest counts; documents that occur twice are learned
twice but kept in one fold; without labels, or with labels all alike, nothing is rejected; equal rows get equal results;
a probability that equals a threshold reaches it; extra columns pass through, those named like an output are replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.common import arrow_columns, numbered, quoted, table

SAMPLE_DOCS, WORDS_EACH, LEAST_DOCS, FOLDS, RIDGE = 20_000, 64, 3, 5, 1.0
#: A threshold has to be right about so many of those that it rejects, out of fold; else the category rejects nothing.
LEAST_PRECISION = 0.95
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Chain:
    """For each category: its name, the weights of the words, of the earlier categories' log-odds, a bias and a threshold."""

    words: dict[str, int]
    names: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """present: one row for a text, one column for a word. Returns one column for a category."""
        x = np.hstack([present, np.ones((len(present), 1))])
        out = []
        for w in self.weights:
            p = _sigmoid(x @ w)
            out.append(p)
            x = np.hstack([x, _logit(p)[:, None]])
        return np.stack(out, axis=1) if out else np.zeros((len(present), 0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _ridge_logistic(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Newton's method for logistic regression with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * s[:, None]) + RIDGE * np.eye(len(w)), x.T @ (p - y) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint between out-of-fold probabilities that gives the highest F1 among those of LEAST_PRECISION; ties go to
    the one nearest to a half."""
    if not y.any() or y.all():
        return 2.0  # nothing was learned: nothing is rejected
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    cut = np.flatnonzero(np.append(p[:-1] > p[1:], True))
    cut = cut[hits[cut] >= LEAST_PRECISION * (cut + 1)]
    if not len(cut):
        return 2.0
    f1 = 2 * hits[cut] / (cut + 1 + y.sum())
    middle = (p[cut] + np.append(p[1:], 0.0)[cut]) / 2
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(middle[best][np.argmin(np.abs(middle[best] - 0.5))])


def fit_arrays(present: np.ndarray, labels: np.ndarray, folds: np.ndarray, words: dict[str, int], names: list[str], seen: list[np.ndarray] | None = None) -> Chain:
    """The chain from arrays of the bounded sample; models of one fold never see that fold.

    ``seen`` has the columns of ``present`` that each fold's model may use, chosen without the fold, and last those of the chain.
    """
    every = np.arange(present.shape[1])
    seen = seen or [every] * (FOLDS + 1)
    chain = Chain(words, names)
    earlier = np.zeros((len(present), 0))
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        with_ = lambda columns, rows, earlier=earlier: np.hstack([present[rows][:, columns], np.ones((rows.sum(), 1)), earlier[rows]])
        held_out, all_ = np.full(len(y), y.mean() if len(y) else 0.0), np.ones(len(y), dtype=bool)
        for f in range(FOLDS):
            here = folds == f
            if here.any() and not here.all():
                held_out[here] = _sigmoid(with_(seen[f], here) @ _ridge_logistic(with_(seen[f], ~here), y[~here]))
        x = with_(seen[FOLDS], all_)
        chain.weights.append(_ridge_logistic(x, y) if len(y) else np.zeros(x.shape[1]))
        chain.thresholds.append(_best_threshold(held_out, y))
        earlier = np.hstack([earlier, _logit(held_out)[:, None]])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str, text: str, bound: int = SAMPLE_DOCS) -> DataFrame:
    """``text`` and one 0/1 column for each category, for about ``bound`` labelled documents at most, chosen by a hash of the id."""
    named = labels.select(F.col(doc_id).alias("__id"), *[c.cast("int").alias(f"__{n}") for n, c in categories.items()])
    known = named.where(F.col("__id").isNotNull()).groupBy("__id").agg(*[F.max(f"__{n}").alias(f"__{n}") for n in categories]).dropna()
    total = known.count()
    share = int(min(1.0, bound / max(total, 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("__id", F.lit("labelled sample")), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).alias("__text"))
    return texts.join(F.broadcast(chosen), "__id")  # about ``bound`` rows of a few integers


def best_words(held: DataFrame, names: list[str]) -> list:
    """(f, word): for each fold the words that tell most about a category in the documents without it, and for FOLDS in all.

    held: __fold, __words and a 0/1 column for each category.
    """
    of = lambda value, f: F.coalesce(F.sum(F.when(F.col("__fold") != f, value)), F.lit(0))
    # Counts of documents without each fold, and without none: a fold's words are chosen as if it weren't there.
    parts = range(FOLDS + 1)
    sums = [c.alias(n) for f in parts for c, n in [(of(F.lit(1), f), f"n_{f}"), *[(of(F.col(f"__{k}"), f), f"{k}_{f}") for k in names]]]
    total = held.agg(*sums).first()
    counts = held.select("__fold", F.explode("__words").alias("word"), *[f"__{n}" for n in names]).groupBy("word").agg(*sums)

    def rated(k: str, f: int) -> Column:
        # How far a category's documents with the word exceed or fall short of chance, in standard deviations.
        rate, df = F.lit((total[f"{k}_{f}"] + 0.5) / (total[f"n_{f}"] + 1)), F.col(f"n_{f}")
        surprise = F.abs(F.col(f"{k}_{f}") - df * rate) / F.sqrt(df * rate * (1 - rate))
        return F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), F.when(df >= LEAST_DOCS, surprise).alias("surprise"))

    ranked = counts.select("word", F.explode(F.array(*[rated(k, f) for k in names for f in parts])).alias("r")).select("word", "r.*").where("surprise IS NOT NULL")
    best = Window.partitionBy("k", "f").orderBy(F.col("surprise").desc(), "word")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= WORDS_EACH).select("f", "word").distinct().collect()


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_DOCS) -> Chain:
    names = list(categories)
    sample = labelled_sample(docs, labels, categories, doc_id, text, bound).withColumn("__fold", F.pmod(F.xxhash64(F.lower("__text")), F.lit(FOLDS)))
    held = arrow_columns(sample, "__text", [T.StructField("__words", T.ArrayType(T.StringType()), False)], lambda: lambda ts: [[sorted(words_of(t)) for t in ts]], keep_source=False)
    held = held.select("__fold", "__words", *[f"__{n}" for n in names]).persist()
    try:
        chosen = best_words(held, names)
        words = {w: i for i, w in enumerate(sorted({r.word for r in chosen}))}
        listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        rows = held.select("__fold", F.array_intersect("__words", listed).alias("found"), *[f"__{n}" for n in names]).collect()
    finally:
        held.unpersist()
    present = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, r in enumerate(rows):
        present[i, [words[w] for w in r.found]] = 1
    marks = np.array([[r[f"__{n}"] for n in names] for r in rows]).reshape(len(rows), len(names))
    seen = [np.array(sorted(words[r.word] for r in chosen if r.f == f), dtype=np.int64) for f in range(FOLDS + 1)]
    own = sorted(r.word for r in chosen if r.f == FOLDS)
    return fit_arrays(present, marks, np.array([r["__fold"] for r in rows]), {w: i for i, w in enumerate(own)}, names, seen)


def predict(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds ``p_<category>`` for each category and ``rejected``: whether one reaches its threshold."""
    names = [f"p_{n}" for n in chain.names]

    def start():
        vocabulary = chain.words.keys()

        def run(texts):
            present = np.zeros((len(texts), len(vocabulary)))
            for i, t in enumerate(texts):
                for w in words_of(t) & vocabulary:
                    present[i, chain.words[w]] = 1
            p = chain.probabilities(present)
            rejected = (p >= np.array(chain.thresholds)).any(axis=1) if len(names) else np.zeros(len(texts), dtype=bool)
            return [*[np.round(p[:, k], 6) for k in range(len(names))], rejected]

        return run

    return arrow_columns(df, text, [*[T.StructField(n, T.DoubleType(), False) for n in names], T.StructField("rejected", T.BooleanType(), False)], start)


def categories() -> dict[str, Column]:
    """The categories of the label table, in the order of the chain: toxic, then toxic text of low quality."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return {"toxic": (toxic == 1), "toxic_junk": (toxic == 1) & (quality == 0)}


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain doesn't reject, with their own columns."""
    inner, name = numbered(docs)
    out = predict(inner, fit(docs, labels, categories()), name["text"])
    return out.where(~F.col("rejected")).select(*inner.columns).toDF(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """Probabilities of both categories for every whole document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    chain = fit(docs, table(spark, sf_dir, "labels"), categories(), text="__text")
    out = predict(docs, chain, "__text")
    return out.select("doc_id", "p_toxic", "p_toxic_junk", F.col("rejected").alias("toxic"), (~F.col("rejected")).alias("kept"))

