"""Operator 5: URL filters. Host and path rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

The Bloom filter is a table: a block number and four 64-bit words. A listed URL sets PROBES bits in one block only, so a
page needs one equi-join on its block to be told apart. Possible hits, a few URLs, go on to a hash join with the list by
canonical URL, which removes false positives; all others never meet the list. What is found marks the pages in one pass more.
Only DataFrame functions are used.

Cases: of rules of one length that fit, the last listed decides; urls of any length are read whole; a null url, or one without '://', has an empty host and path, no rule, and is not listed (allowed); equal rows get
equal verdicts; a null or repeated listed URL counts once or not at all; an empty list allows whatever no rule decides;
extra columns pass through, those named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark.llm.common import BROADCAST_BYTES, quoted, small_enough, table, without, written

#: Bits of a block's four words, bits for a listed URL, and the bits that each URL sets.
BLOCK_BITS, BITS_EACH, PROBES = 256, 16, 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and a default port; path without ``.html`` and closing slashes. Null without a host."""
    short = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(path, r"(\.html|/+)$", "")))


def longest_rule(rules: list[Rule], host: Column, path: Column, pick) -> Column:
    """``pick`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(pick(r))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _masks(url: Column) -> list[Column]:
    """The bits that a URL sets in the four words of its block."""
    other = F.xxhash64(url, F.lit(1))
    places = [F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
    words = []
    for w in range(BLOCK_BITS // 64):
        mask = F.lit(0).cast("long")
        for p in places:
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit(p)).otherwise(F.lit(0).cast("long")))
        words.append(mask)
    return words


def bloom_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """Block number and words of a blocked Bloom filter over the column ``listed_url``; summed up before the shuffle."""
    masks = urls.select(_block(F.col("listed_url"), blocks).alias("bloom_block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("listed_url")))])
    return masks.groupBy("bloom_block").agg(*[F.bit_or(f"m{i}").alias(f"bloom_{i}") for i in range(BLOCK_BITS // 64)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule (of the longest rule that fits, else null), listed and verdict to ``pages``.

    ``listed`` has a column ``url``. A verdict is the rule's; without one, a listed URL is blocked and any other allowed.
    """
    given = F.col("url")
    names = written(listed.select(canonical(host_of(given), path_of(given)).alias("listed_url")).where("listed_url IS NOT NULL").distinct(), "listed")
    size = names.count()
    blocks = max(1, -(-size * BITS_EACH // BLOCK_BITS))
    bloom = bloom_filter(names, blocks)
    whole = min(size, blocks) * 64 <= BROADCAST_BYTES

    kept = without(pages, ["host", "path", "rule", "listed", "verdict"])
    raw = F.col(quoted(url))
    # The caller's columns travel as one, so that none of them clashes with a name used here.
    parts = pages.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), host_of(raw).alias("host"), path_of(raw).alias("path"))
    host, path = F.col("host"), F.col("path")
    parts = parts.select(
        "*",
        longest_rule(rules, host, path, lambda r: r.host + r.path).alias("rule"),
        longest_rule(rules, host, path, lambda r: r.verdict).alias("ruling"),
        canonical(host, path).alias("own"),
    )
    asked = parts.where("rule IS NULL AND own IS NOT NULL").select("own")
    # A filter too large to broadcast meets each URL once, whatever the number of its pages.
    asked = (asked if whole else asked.distinct()).withColumn("bloom_block", _block(F.col("own"), blocks))
    set_ = F.lit(True)
    for i, m in enumerate(_masks(F.col("own"))):
        set_ = set_ & (F.col(f"bloom_{i}").bitwiseAND(m) == m)
    hits = asked.join(F.broadcast(bloom) if whole else bloom, "bloom_block").where(set_).select("own").distinct()
    found = written(hits.join(names, F.col("own") == F.col("listed_url"), "left_semi").withColumnRenamed("own", "found"), "found")

    def judged(rows: DataFrame, there: Column) -> DataFrame:
        return rows.select("row.*", "host", "path", "rule", there.alias("listed"), F.coalesce("ruling", F.when(there, "block").otherwise("allow")).alias("verdict"))

    n = found.count()
    small, fits = small_enough(found, n, 256), F.col("rule").isNull() & (F.col("own") == F.col("found"))
    if n * 256 <= BROADCAST_BYTES:
        return judged(parts.join(small, fits, "left"), F.col("found").isNotNull())
    # In a shuffled join rows without a key would all meet in one task: they are told apart first.
    open_ = parts.where("rule IS NULL AND own IS NOT NULL").join(small, F.col("own") == F.col("found"), "left")
    return judged(parts.where("rule IS NOT NULL OR own IS NULL"), F.lit(False)).unionAll(judged(open_, F.col("found").isNotNull()))


#: Fixed: hosts of the list, below each of its domains, for each language; the numbers of the listed paths are a range.
LISTED_HOSTS, LISTED_DOMAINS, LISTED_LANGUAGES, LISTED_NUMBERS = ["casino-win", "cheap-pills", "spam-farm"], ["com", "net", "org"], ["de", "en", "es", "fr"], 10_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list of the query, built by rule: every numbered path of the listed hosts, as canonical URLs."""
    one = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
    i, h, d, g = F.col("id"), len(LISTED_HOSTS), len(LISTED_DOMAINS), len(LISTED_LANGUAGES)
    rows = spark.range(h * d * g * LISTED_NUMBERS)
    name, domain, lang = one(LISTED_HOSTS, i), one(LISTED_DOMAINS, F.floor(i / h)), one(LISTED_LANGUAGES, F.floor(i / (h * d)))
    return rows.select(F.concat(F.lit("http://"), name, F.lit(".example."), domain, F.lit("/"), lang, F.lit("/"), F.floor(i / (h * d * g)).cast("string")).alias("url"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def _sql() -> str:
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '%s', '%s')" % (_UPPER, _LOWER)
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    ordered = sorted(RULES, key=lambda r: -len(r.host + r.path))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{pick(r)}'" for r in ordered) + " END"
    listed = rf"^({'|'.join(LISTED_HOSTS)})\.example\.({'|'.join(LISTED_DOMAINS)})/({'|'.join(LISTED_LANGUAGES)})/(0|[1-9][0-9]{{0,{len(str(LISTED_NUMBERS)) - 2}}})$"
    return f"""
WITH parts AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
ruled AS (SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS ruling,
  regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\\.html|/+)$', '') AS url FROM parts),
judged AS (SELECT *, rule IS NULL AND host <> '' AND regexp_matches(url, '{listed}') AS listed FROM ruled)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged"""


SQL = _sql()
