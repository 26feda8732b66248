"""Operator 1: quality rules as a learned decision list.

Statistics of each text are plain column expressions. Sequential covering grows conjunctions of thresholds on them from
labelled documents and prunes each on documents held back; the list is emitted as one ordered ``when`` expression, which
Spark evaluates with the scan. Only DataFrame functions are used. Rules are learned from a bounded sample of about
SAMPLE_DOCS labelled documents, chosen by a hash of the id; what reaches the driver is a histogram: one count for each
statistic, bin and label.

Cases: ties between conditions of equal worth go to the one that was met first in the order of statistics and bounds; a null or empty text has no words, fails the base rule and is dropped; long texts are measured whole; a statistic
that is not defined (a share of no words) is 0; labels that are null are not learned from, and of several labels for a
document the lowest quality counts; without labels there are no rules and the base rule decides alone; equal rows get equal
verdicts; extra columns pass through, those named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.llm.common import quoted, table, without, written

SAMPLE_DOCS, BINS, MAX_RULES, MAX_TERMS, LEAST_COVER, LEAST_PRECISION = 20_000, 24, 8, 3, 8, 0.95
_SPACE = r"\x20\x09-\x0D"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may speak of, as SQL over the base statistics and a few more.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "shout_share": "n_shouts / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "common_share": "n_short_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


@dataclass(frozen=True)
class Rule:
    """Rejects where all terms hold."""

    terms: tuple[Term, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.terms:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))


def _place_bits(words: Column) -> Column:
    """Bits that the places of a text's windows take."""
    return F.length(F.bin(F.size(words).cast("long")))


def _window_keys(words: Column, bits: Column) -> Column:
    """A sorted array with a key for each window of three words: its place in the low bits, above them those of a hash."""
    triples = F.zip_with(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda t, c: F.xxhash64(t["a"], t["b"], c))
    hashes = F.slice(triples, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    keys = F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
    return F.when(F.size(words) >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<long>"))


def _sorted_windows(words: Column) -> Column:
    """The windows themselves with their places, sorted: the way for a text in which hashes of different windows meet."""
    one = lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("place"))
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), one))


def _covered(places: Column) -> Column:
    """How many words windows of three at sorted ``places`` cover."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, empty, step, lambda acc: acc["n"])


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and those that FEATURES use; other columns but ``text`` pass through.

    Words repeated in windows: window hashes are sorted with their places in the low bits, neighbours with equal hashes and
    words are repeats, and the sorted places of repeats give the words that they cover. Where hashes of different windows
    meet, the windows themselves are sorted. Each step is linear or a sort.
    """
    kept = [F.col(quoted(c)) for c in without(df, [*BASE, "n_lines", "n_upper", "n_shouts", "n_digits", "n_distinct_words", "n_short_words"]) if c != text]
    given = F.coalesce(F.col(quoted(text)), F.lit(""))
    base = df.select(*kept, given.alias("__text"))
    trimmed = F.regexp_replace("__text", rf"^[{_SPACE}]+|[{_SPACE}]+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{_SPACE}]+"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(rf"[^{_SPACE}]"))
    base = base.select(*kept, "__text", words.alias("__words"), lines.alias("__lines"))
    base = base.select("*", _place_bits(F.col("__words")).alias("__bits"))
    measured = base.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", rf"[{_SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit(r"!!+")).cast("long").alias("n_shouts"),
        F.regexp_count("__text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct_words"),
        F.size(F.filter("__words", lambda w: F.length(w) <= 3)).cast("long").alias("n_short_words"),
        "__words",
        _window_keys(F.col("__words"), F.col("__bits")).alias("__keys"),
        "__bits",
    )
    keys, bits = F.col("__keys"), F.col("__bits")
    place = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    word = lambda k, i: F.get("__words", (place(k) + i).cast("int"))
    same = lambda a, b: (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))
    # Pairs against the array shifted by one, null past the end: of neighbours with one hash both repeat if their words agree
    # too. Other words under one hash (an empty pair) may stand between repeats, so that text is measured on its sorted windows.
    hashed = lambda a, b: F.when(F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits), F.when(same(a, b), F.array(place(a), place(b))).otherwise(F.array().cast("array<long>")))
    next_ = lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))
    marked = F.filter(F.zip_with(keys, next_(keys), hashed), lambda m: m.isNotNull())
    measured = measured.select("*", marked.alias("__marked"))
    met = F.exists("__marked", lambda m: F.size(m) == 0)
    measured = measured.select("*", F.when(met, _sorted_windows(F.col("__words"))).alias("__sorted"))
    windows = F.col("__sorted")
    exact = F.zip_with(windows, next_(windows), lambda a, b: F.when((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.array(a["place"].cast("long"), b["place"].cast("long"))))
    repeats = F.array_sort(F.array_distinct(F.flatten(F.when(windows.isNull(), F.col("__marked")).otherwise(F.filter(exact, lambda m: m.isNotNull())))))
    names = [*BASE[:-1], "n_lines", "n_upper", "n_shouts", "n_digits", "n_distinct_words", "n_short_words"]
    done = measured.select(*kept, *names, repeats.alias("__repeats"))
    whole = F.struct(*names, _covered(F.col("__repeats")).cast("long").alias("n_repeat_words"))
    # A generated row keeps later filters from being pushed below, where each would compute all statistics again, even
    # inside the lambdas above.
    return done.select(*kept, F.explode(F.array(whole)).alias("__s")).select(*kept, "__s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _featured(measured: DataFrame) -> DataFrame:
    return measured.withColumns({n: F.expr(sql).cast("double") for n, sql in FEATURES.items()})


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, bound: int) -> DataFrame:
    known = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.min("quality") == 0).alias("__bad"))
    share = int(min(1.0, bound / max(known.count(), 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("__id", F.lit("quality sample")), F.lit(1 << 30)) < share)
    return docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).alias("__text")).join(F.broadcast(chosen), "__id")  # about ``bound`` small rows


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_DOCS) -> list[Rule]:
    """Sequential covering: grow a conjunction for precision, prune it on held-back documents, take away what it covers.

    Documents that the base rule rejects are not learned from. A rule stays if it is right on LEAST_PRECISION of at least
    LEAST_COVER documents in both parts, so that clean documents are left alone.
    """
    sample = _sample(docs, labels, doc_id, text, bound).withColumn("__part", F.pmod(F.xxhash64("__text"), F.lit(3)) == 0)
    rows = written(_featured(statistics(sample, "__text")).where(~base_failed()).select("__bad", "__part", *FEATURES), "quality-sample")
    cuts = rows.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    bounds = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    found: list[Rule] = []
    left = F.lit(True)

    def histogram(part: bool, terms: tuple[Term, ...]) -> dict[str, list[tuple[int, int]]]:
        """For each feature, (good, bad) documents by bin among those that ``terms`` hold for and no rule has covered."""
        bins = [F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > b, 1).otherwise(0) for b in bounds[f]), F.lit(0)).alias("bin")) for f in FEATURES if bounds[f]]
        if not bins:
            return {}
        at = rows.where((F.col("__part") == part) & left & Rule(terms).column()).select("__bad", F.explode(F.array(*bins)).alias("b"))
        out = {f: [[0, 0] for _ in range(len(bounds[f]) + 1)] for f in FEATURES}
        for r in at.groupBy("b.f", "b.bin", "__bad").count().collect():
            out[r.f][r["bin"]][r["__bad"]] += r["count"]
        return out

    while len(found) < MAX_RULES:
        terms: tuple[Term, ...] = ()
        while len(terms) < MAX_TERMS:
            best = None
            for f, bins in histogram(False, terms).items():
                total = [sum(b[k] for b in bins) for k in (0, 1)]
                below = [0, 0]
                for bound_, b in zip(bounds[f], bins):
                    below = [below[0] + b[0], below[1] + b[1]]
                    for above, (good, bad) in ((False, below), (True, (total[0] - below[0], total[1] - below[1]))):
                        if bad >= LEAST_COVER:
                            # The m-estimate of precision prefers wide rules among equally clean ones.
                            key = ((bad + 1) / (good + bad + 4), bad)
                            if best is None or key > best[0]:
                                best = key, Term(f, above, bound_), good, bad
            if best is None:
                break
            terms = (*terms, best[1])
            if best[2] == 0:
                break
        terms = _pruned(rows, left, terms)
        if not terms:
            break
        found.append(Rule(terms))
        left = left & ~Rule(terms).column()
    return found


def _pruned(rows: DataFrame, left: Column, terms: tuple[Term, ...]) -> tuple[Term, ...]:
    """The prefix of ``terms`` that is best on the held-back part, if it is precise enough in both parts; else ()."""
    if not terms:
        return ()
    sums = []
    for n in range(1, len(terms) + 1):
        held = Rule(terms[:n]).column()
        for part in (False, True):
            for bad in (False, True):
                sums.append(F.coalesce(F.sum(F.when(held & (F.col("__part") == part) & (F.col("__bad") == bad), 1)), F.lit(0)).alias(f"c{n}{int(part)}{int(bad)}"))
    c = rows.where(left).agg(*sums).first()
    scored = []
    for n in range(1, len(terms) + 1):
        precise = all(c[f"c{n}{p}1"] >= (LEAST_COVER if not p else 1) and c[f"c{n}{p}1"] >= LEAST_PRECISION * (c[f"c{n}{p}0"] + c[f"c{n}{p}1"]) for p in (0, 1))
        if precise:
            scored.append(((c[f"c{n}11"] - c[f"c{n}10"]) / max(1, c[f"c{n}11"] + c[f"c{n}10"]), c[f"c{n}11"], -n, n))
    return terms[: max(scored)[-1]] if scored else ()


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered expression: number of the first rule that rejects, else null."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.column(), F.lit(i + 1)) if out is None else out.when(r.column(), F.lit(i + 1))
    return F.lit(None).cast("int") if out is None else out


def apply(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, ``base_failed``, ``quality_rule`` (number of the rule that rejects, else null) and ``kept``."""
    judged = _featured(statistics(df, text))
    plain = [c for c in judged.columns if c not in FEATURES]
    return judged.select(*[F.col(quoted(c)) for c in plain], base_failed().alias("base_failed"), verdict(rules).alias("quality_rule")).withColumn("kept", ~F.col("base_failed") & F.col("quality_rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rule nor the learned list rejects, with their own columns."""
    rules = learn(docs, labels)
    inner = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__doc"), F.col("text").alias("__text"))
    return apply(inner, rules, "__text").where("kept").select("__doc.*")


def op1(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all whole documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    rules = learn(docs, table(spark, sf_dir, "labels"), text="__text")
    return apply(docs, rules, "__text").select("doc_id", *BASE, "base_failed", "kept", "quality_rule")
