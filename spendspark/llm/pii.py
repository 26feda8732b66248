"""Operator 13: personal data, and the terms that give it away.

Four kinds of personal data are found by pattern and check digit. Each value of them is an entity to protect. From the corpus
itself follows how much a term says of an entity: of all documents that hold the term, in how many does it stand near the
entity? In bits, the pointwise mutual information of both against what the entity's own mention would tell:

    disclosure = log2(N * near / (holds entity * holds term)) / log2(N / holds entity)

1 means that whoever reads the term knows the entity; 0 that it tells nothing. Terms from REMOVE on are removed, those from
GENERALISE on are generalised to their class, wherever they stand in the corpus. A pair counts from MIN_TEXTS unlike texts on,
so copies of one text prove nothing.

All steps are columns and joins. Only pairs within REACH characters of an entity are formed, so work grows with the text;
terms are looked up where they may matter, after counting only what stood near an entity.

Cases: null text counts as empty and has no spans; of equal texts, with or without ids, all rows have the same spans; ties at
one start can't be within a kind, and kinds are in a fixed order; texts of any length are searched whole, patterns take time
in proportion to them; extra columns pass through, those named like an output are replaced; an empty table gives an empty
table. An entity that all documents hold has nothing to disclose. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.llm.common import quoted, small_enough, table, unused, without, written
from spendspark.llm.native import bound, places

#: The base patterns, written so that time is linear and nothing recurses: what they match is the same.
PATTERNS = {
    # A part before "@" starts where its run of characters does, or where the match before ended in it.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?(?![0-9\x20-]))",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What each text with a match holds.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BASE, TERMS = list(PATTERNS), ["general", "removed"]
TERM = r"\p{L}{3,}"
REACH, MIN_TEXTS = 64, 3
GENERALISE, REMOVE = 0.9, 0.97
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit counts twice, less 9 where that has two digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return bound(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, reach: int = 0) -> Column:
    """start, end and value of each span of a base kind, and what stands around it."""
    none = F.array().cast("array<" + _SPAN[:-1] + (",before:string,after:string>>" if reach else ">>"))
    gate = text.contains("@") if kind == "email" else text.rlike(GATES[kind])
    found = places(text, PATTERNS[kind], reach)
    return F.when(gate, found if kind == "email" else F.filter(found, lambda s: _valid(kind, s["value"]))).otherwise(none)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, print (of the text), entity and terms near it: one row for each mention of an entity."""
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(text)).alias("text")).where("text IS NOT NULL")
    held = whole.select("row", F.xxhash64("text").alias("print"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), base_spans(F.col("text"), k, REACH).alias("spans")) for k in BASE])).alias("k"))
    each = held.select("row", "print", "k.kind", F.explode("k.spans").alias("s"))
    same = F.when(F.col("kind") == "email", F.lower("s.value")).when(F.col("kind") == "ip", F.col("s.value")).otherwise(_digits(F.col("s.value")))
    # Words with a digit or "@" are, or may be, personal data of another kind.
    near = F.regexp_replace(F.concat_ws(" ", "s.before", "s.after"), r"\S*[0-9@]\S*", " ")
    return each.select("row", "print", F.concat_ws(":", "kind", same).alias("entity"), F.array_distinct(_terms(near)).alias("terms"))


def disclosures(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, entity that it reveals most, disclosure, from GENERALISE on. Counts are over all documents."""
    n = docs.count()
    met = written(mentions(docs, text), "mentions")
    holds = met.select("row", "print", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("print").alias("texts"))
    known = written(holds.where(F.col("texts") >= MIN_TEXTS).drop("texts"), "entities")
    pairs = met.join(small_enough(known.select("entity"), known.count(), 64), "entity", "left_semi").select("row", "print", "entity", F.explode("terms").alias("term")).distinct()
    near = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_near"), F.count_distinct("print").alias("texts")).where(F.col("texts") >= MIN_TEXTS)
    bits = lambda c: F.log2(F.col(c))
    own = F.lit(float(n)) / F.col("n_entity")
    told = lambda held: F.round((F.log2(F.lit(float(max(n, 1)))) + bits("n_near") - bits("n_entity") - bits(held)) / F.log2(own), 9)
    # At least so many documents hold a term as have it near any entity: terms that tell too little even so aren't looked up.
    least = met.select("row", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_least"))
    may = near.join(known, "entity").where(own > 1).join(least, "term").where(told("n_least") >= GENERALISE)
    may = written(may.select("entity", "term", "n_near", "n_entity"), "pairs")
    wanted = written(may.select("term").distinct(), "terms")
    words = docs.where(F.col(quoted(text)).isNotNull()).select(F.explode(F.array_distinct(_terms(F.col(quoted(text))))).alias("term"))
    held = words.join(small_enough(wanted, wanted.count(), 64), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    rated = may.join(held, "term").select("term", "entity", told("n_term").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.min_by("entity", F.struct(-F.col("disclosure"), "entity")).alias("entity"))


def scan(docs: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Adds email, ip, card, phone, general and removed: start, end and value of each span. ``terms`` as of ``disclosures``,
    which are those of ``docs`` itself if none are given."""
    told = written(disclosures(docs, text) if terms is None else terms, "disclosures")
    kept = without(docs, [*BASE, *TERMS])
    source, key, hits = unused(docs, "__text"), unused(docs, "__key"), unused(docs, "__hits")
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(*[F.col(quoted(c)) for c in kept], whole.alias(source), F.sha2(whole, 256).alias(key))
    # Which texts hold a telling term: of equal texts one row.
    words = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(_terms(F.col(source)))).alias("term"))
    found = words.join(small_enough(told.select("term", "disclosure"), told.count(), 96), "term").distinct()
    per_text = written(found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("hits")).withColumnsRenamed({"key": key, "hits": hits}), "telling-texts")
    size = per_text.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(hits)), F.lit(0)).alias("m")).first()
    marked = rows.join(small_enough(per_text, size.n + size.m, 96), key, "left")
    spans = [base_spans(F.col(source), k).alias(k) for k in BASE]
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,disclosure:double>>")
    tell = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(F.col(hits), F.lower(s["value"])).alias("disclosure"))
    telling = F.when(F.col(hits).isNotNull(), F.filter(F.transform(places(F.col(source), TERM), tell), lambda s: s["disclosure"].isNotNull())).otherwise(none)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["end"], s["value"]).cast(_SPAN))
    inner = unused(docs, "__telling")
    out = marked.select(*[quoted(c) for c in kept], *spans, telling.alias(inner))
    of = {"general": lambda s: s["disclosure"] < REMOVE, "removed": lambda s: s["disclosure"] >= REMOVE}
    return out.select(*[quoted(c) for c in kept], *BASE, *[plain(F.filter(inner, f)).alias(k) for k, f in of.items()])


def joined(kinds: list[str]) -> Column:
    """kind:start:end of the spans of ``kinds``, in that order, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def sanitised(docs: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Replaces ``text``: personal data by its kind, telling terms by their class (a name, if it has a capital, or a term) or by
    nothing. Null stays null."""
    # Packed, so that no column of the caller's meets those of the scan.
    found = scan(docs.select(F.struct("*").alias("row"), F.col(quoted(text)).alias("source")), "source", terms)

    def cuts_of(kind: str) -> Column:
        special = {"removed": lambda v: F.lit(""), "general": lambda v: F.when(v.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")}
        mark = special.get(kind, lambda v: F.lit(f"[{kind}]"))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), mark(s["value"]).alias("mark")))

    cuts = F.array_sort(F.concat(*[cuts_of(k) for k in [*BASE, *TERMS]]))
    whole = F.col("source")

    def step(acc: Column, c: Column) -> Column:
        inside = c["start"] < acc["at"]
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], -c["back"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, c["mark"]))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(cuts, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    value = F.when(whole.isNull(), F.lit(None)).otherwise(clean)
    return found.select(*[value.alias(c) if c.lower() == text.lower() else F.col("row." + quoted(c)) for c in docs.columns])


def op13(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole document, and the terms that tell of it."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text")), "__text")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"), joined([*BASE, *TERMS]).alias("spans"))
