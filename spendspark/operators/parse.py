"""Bank messages to transactions: a cascade of gates, then extraction, all in native columns.

The first gate that a message fails names the reason: personal sender, empty body, otp, promotional, not a completed txn,
informational, no amount, only balance amounts, no direction keyword, unknown sender. Null bodies count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X

_HIT = "array<struct<start:int,rank:int,paise:bigint>>"


def _hits(body: Column, pattern: str, rank: int, at_end: bool) -> Column:
    """Place (code points from 0) and value of the number in each match of an amount pattern."""
    parts = F.struct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("number"), F.transform(F.split(body, pattern, -1), F.length).alias("gaps"))

    def placed(p: Column) -> Column:
        # Ends of matches: running sums of gaps and matches. A message holds a handful, so sums over slices stay short.
        size = lambda i: F.length(F.get(p["whole"], i))
        upto = lambda i: F.aggregate(F.slice(p["whole"], 1, i + 1), F.aggregate(F.slice(p["gaps"], 1, i + 1), F.lit(0), lambda a, x: a + x), lambda a, x: a + F.length(x))
        return F.transform(p["number"], lambda n, i: F.struct((upto(i) - (F.length(n) if at_end else size(i))).alias("start"), F.lit(rank).alias("rank"), X.paise_of(n).alias("paise")))

    return F.when(body.rlike(pattern), X.bound(parts, placed)).otherwise(F.array().cast(_HIT))


def amounts(body: Column) -> Column:
    """Amounts by place: start, rank, paise, balance. Of patterns that meet at one place the first counts."""
    all_ = F.concat(_hits(body, R.AMOUNT_PREFIXED, 0, True), _hits(body, R.AMOUNT_SUFFIXED, 1, False), _hits(body, R.AMOUNT_BARE, 2, True))
    valid = F.array_sort(F.filter(all_, lambda h: h["paise"].isNotNull()))
    # Sorted by place and rank, the first of a place is the one that counts.
    first = X.bound(valid, lambda v: F.filter(v, lambda h, i: (i == 0) | (F.get(v, i - 1)["start"] != h["start"])))
    before = lambda h: F.substring(body, F.greatest(h["start"] - 31, F.lit(1)), F.least(h["start"], F.lit(32)))
    return F.transform(first, lambda h: F.struct(h["start"].alias("start"), h["paise"].alias("paise"), before(h).rlike(R.BALANCE_CONTEXT).alias("balance")))


def direction(body: Column, rules: R.Rules = R.DEFAULT) -> Column:
    """The earlier keyword decides, a debit's at a tie; card names and credit limits are masked."""
    masked = F.lower(F.regexp_replace(F.regexp_replace(body, R.CARD_PHRASE, "card"), R.CREDIT_LIMIT, "limit"))
    at = lambda words: F.array_min(F.filter(F.array(*[F.instr(masked, w) for w in words], F.lit(0)), lambda i: i > 0))
    debit, credit = at(rules.debit_words), at(rules.credit_words)
    return F.when(debit.isNull() & credit.isNull(), F.lit(None).cast("string")).when(credit.isNull() | (debit <= credit), "DEBIT").otherwise("CREDIT")


def account_tail(body: Column) -> Column:
    return F.substring(F.coalesce(X.found(body, R.ACCOUNT_LABELLED), X.found(body, R.ACCOUNT_MASKED)), -4, 4)


def reference(body: Column) -> Column:
    """The first candidate with at least four digits."""
    return F.upper(F.get(F.filter(F.regexp_extract_all(body, F.lit(R.REF), F.lit(1)), lambda r: F.regexp_count(r, F.lit("[0-9]")) >= 4), F.lit(0)))


def merchant(body: Column, direction_: Column, rules: R.Rules = R.DEFAULT) -> Column:
    """The first pattern whose first match is a plausible name; what follows a trailer is not read."""

    def candidate(head: Column, pattern: str) -> Column:
        c = F.regexp_replace(X.trimmed(F.regexp_extract(head, pattern, 1)), R.MERCHANT_LABEL, "")
        c = F.regexp_replace(X.trimmed(c), r"^[.,\- ]+|[.,\- ]+$", "")
        # A name of three letters never has an empty key.
        good = lambda c: (F.length(c) >= 3) & c.rlike("[A-Za-z]{3}") & ~c.rlike(R.CURRENCY_ONLY) & ~c.rlike(R.OWN_ACCOUNT)
        return F.when(head.rlike(pattern), X.bound(c, lambda c: F.when(good(c), c)))

    head = F.get(F.split(body, R.TRAILER, 2), F.lit(0))
    return X.bound(head, lambda h: F.coalesce(*[candidate(h, p) for p in rules.merchant_patterns], F.when(direction_ == "CREDIT", candidate(h, R.MERCHANT_FROM))))


def channel(body: Column) -> Column:
    b = F.lower(body)
    return (
        F.when(b.rlike(r"\batm\b"), "ATM").when(b.contains("upi") | b.rlike(R.VPA_ANY), "UPI")
        .when(b.contains("mandate") | b.contains("autopay") | b.contains("standing instruction"), "AUTOPAY").when(b.contains("card"), "CARD")
        .when(b.contains("imps"), "IMPS").when(b.contains("neft"), "NEFT").when(b.contains("rtgs"), "RTGS")
        .when(b.contains("net banking") | b.contains("netbanking"), "NETBANKING").when(b.contains("wallet"), "WALLET").otherwise("UNKNOWN")
    )


def occurred_at(body: Column, received_at: Column, zone: str) -> Column:
    """Local noon of a day in the text that is over a day in the past, else when the message came."""
    day, came = X.day_of(X.found(body, R.DATE_TOKEN), R.BODY_DATES), X.local_day(received_at, zone)
    return F.when(F.datediff(came, day) > 1, X.from_local_ms(X.day_ms(day) + R.DAY_MS // 2, zone)).otherwise(received_at)


def parsed(df: DataFrame, zone: str, sender: str = "sender", body: str = "body", received_at: str = "received_at", rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Adds reject_reason and, where that is null, the fields of a transaction."""
    text, who = F.coalesce(F.col(body), F.lit("")), X.sender_class(F.col(sender), rules)
    cheap = F.when(who == "PERSONAL", "personal sender").when(X.trimmed(text) == "", "empty body")
    for reason, pattern in rules.gates:
        cheap = cheap.when(text.rlike(pattern), reason)
    one = df.withColumns({"__who": who, "__cheap": cheap})
    # What a cheap gate rejects is not extracted from. A generated row keeps each step from being worked out where it is used.
    open_ = lambda c: F.when(F.col("__cheap").isNull(), c)
    steps = F.struct(open_(amounts(text)).alias("__amounts"), open_(direction(text, rules)).alias("__way"), open_(account_tail(text)).alias("__tail"), open_(reference(text)).alias("__ref"))
    two = one.select("*", F.explode(F.array(steps)).alias("__steps")).select(*one.columns, "__steps.*")
    pick = lambda balance: F.get(F.filter("__amounts", lambda a: a["balance"] == balance), F.lit(0))["paise"]
    late = (
        F.when(F.size("__amounts") == 0, "no amount").when(pick(False).isNull(), "only balance amounts").when(F.col("__way").isNull(), "no direction keyword")
        .when((F.col("__who") == "UNKNOWN") & F.col("__tail").isNull() & F.col("__ref").isNull(), "unknown sender, weak signal")
    )
    three = two.withColumn("reject_reason", F.coalesce("__cheap", late))
    ok = lambda c: F.when(F.col("reject_reason").isNull(), c)
    fields = {
        "amount_paise": pick(False), "direction": F.col("__way"), "channel": channel(text), "account_tail": F.col("__tail"), "ref_no": F.col("__ref"), "balance_paise": pick(True),
        "merchant_raw": merchant(text, F.col("__way"), rules), "occurred_at": occurred_at(text, F.col(received_at), zone),
    }
    whole = F.struct(*[ok(c).alias(n) for n, c in fields.items()])
    four = three.select(*df.columns, "reject_reason", F.explode(F.array(whole)).alias("__t")).select(*df.columns, "reject_reason", "__t.*")
    return four.withColumns({"merchant_norm": F.nullif(X.merchant_key(F.col("merchant_raw")), F.lit("")), "vpa_handle": X.vpa_handle(F.col("merchant_raw"))})


def fingerprint(sender: Column, body: Column, received_at: Column) -> Column:
    """Identity of a message: sender and body, and the UTC day in which it came."""
    text = lambda c: F.coalesce(X.trimmed(c), F.lit(""))
    return F.sha2(F.concat_ws("|", F.lower(text(sender)), text(body), F.call_function("div", received_at, F.lit(R.DAY_MS)).cast("string")), 256)
