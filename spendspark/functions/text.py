"""Text and money expressions, all native columns. Null in gives the stated default or null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendspark import rules as R


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_of(value: Column, kind: str) -> Column:
    """An enumeration's name, or its default."""
    names, default = R.ENUM_DEFAULTS[kind]
    return F.when(value.isin(names), value).otherwise(F.lit(default))


def normal_sender(sender: Column) -> Column:
    """Letters and digits of a sender, in lower case."""
    return F.regexp_replace(F.lower(sender), "[^a-z0-9]", "")


def sender_class(sender: Column, rules: R.Rules = R.DEFAULT) -> Column:
    """PERSONAL for a phone number, BANK or PSP by a code (exact in order of segments, else inside the longest), else UNKNOWN."""
    raw = F.lower(trimmed(F.coalesce(sender, F.lit(""))))
    whole = normal_sender(raw)
    parts = F.filter(F.concat(F.transform(F.split(raw, r"[-_.]"), normal_sender), F.array(whole)), lambda s: s != "")
    bank, psp = (F.array(*map(F.lit, codes)).cast("array<string>") for codes in (rules.bank_codes, rules.psp_codes))
    kind = F.get(F.filter(F.transform(parts, lambda s: F.when(F.array_contains(bank, s), "BANK").when(F.array_contains(psp, s), "PSP")), lambda k: k.isNotNull()), F.lit(0))
    longest = F.aggregate(parts, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    inside = lambda codes: F.exists(codes, lambda c: F.contains(longest, c))
    near = F.when(F.length(longest).between(6, 12), F.when(inside(bank), "BANK").when(inside(psp), "PSP"))
    return F.when(raw == "", "UNKNOWN").when(whole.rlike(r"^(?:91|0)?[6-9]\d{9}$"), "PERSONAL").otherwise(F.coalesce(kind, near, F.lit("UNKNOWN")))


def paise_of(digits: Column) -> Column:
    """Plain decimal text with commas to paise, half up; null unless above 0."""
    value = F.round(F.replace(digits, F.lit(","), F.lit("")).try_cast("decimal(30,6)") * 100, 0).try_cast("bigint")
    return F.when(value > 0, value)


def signed_paise(text: Column) -> Column:
    """Money in a file: parentheses or a closing DR make it negative; currency and Dr/Cr marks go; blank, '-' and '.' are null."""

    def number(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, r"(?i)\b[dc]r\b", ""), r"(?i)\brs\.?|\binr\b|\brupees\b|[₹$]", "")
        s = F.regexp_replace(F.regexp_replace(s, r"[,\s]", ""), r"^[.:]+", "")
        # Text with a letter but for an exponent's is no number; failing casts are dear.
        return bound(s, lambda n: paise(F.when(~n.isin("", "-", ".") & ~n.rlike("[A-DF-Za-df-z]"), n)))

    def paise(n: Column) -> Column:
        return F.round(n.try_cast("decimal(30,6)") * 100, 0).try_cast("bigint")

    def read(s: Column) -> Column:
        wrapped = s.startswith("(") & s.endswith(")")
        inner = F.struct(F.when(wrapped, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s).alias("s"), wrapped.alias("wrapped"))
        return bound(inner, lambda x: bound(number(x["s"]), lambda n: F.when(x["wrapped"] | F.upper(x["s"]).endswith("DR"), -F.abs(n)).otherwise(n)))

    # Each step is bound, so that it is worked out once, and the code of a row of many cells stays small. Plain numbers are cast
    # as they are; a letter that no mark and no exponent has is left in any case, so such text is no number.
    plain = lambda s: paise(F.regexp_replace(s, r"^Rs\. ?|,", ""))
    return bound(trimmed(text), lambda s: F.when(s.rlike(r"^(?:-|Rs\. ?)?[0-9][0-9,]*(?:\.[0-9]+)?$"), plain(s)).when(~s.rlike("(?i)[abf-hj-moqtv-z]"), read(s)))


def rupees(paise: Column) -> Column:
    whole = F.abs(paise)
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.call_function("div", whole, F.lit(100)).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def _grouped(whole: Column) -> Column:
    """Digits of a whole number, a comma before the last three and before each two in front of them."""
    return F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")


def money(paise: Column) -> Column:
    """Rupees in Indian grouping, rounded to whole ones, halves up."""
    up = paise + 50
    whole = F.call_function("div", up - F.pmod(up, F.lit(100)), F.lit(100))
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.lit("₹"), _grouped(F.abs(whole)))


def exact_money(paise: Column) -> Column:
    """Rupees and paise in Indian grouping."""
    whole = F.abs(paise)
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), _grouped(F.call_function("div", whole, F.lit(100))), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def compact_money(paise: Column) -> Column:
    r = paise / F.lit(100.0)
    m = F.abs(r)
    return (
        F.when(m >= 10_000_000, F.format_string("₹%.1fCr", r / 10_000_000))
        .when(m >= 100_000, F.format_string("₹%.1fL", r / 100_000))
        .when(m >= 1_000, F.format_string("₹%.1fk", r / 1_000))
        .otherwise(F.concat(F.lit("₹"), F.floor(r + 0.5).cast("string")))
    )


def shown_time(ms: Column, zone: str) -> Column:
    """Day, month and time of day on the wall clock: 8 May, 2:05 PM."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone).cast("timestamp_ntz"), "d MMM, h:mm a")


def category_index(category: Column) -> Column:
    """Place of a category in the label set, -1 for none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, R.CATEGORIES)), category) - 1, F.lit(-1)).cast("int")


def category_at(index: Column) -> Column:
    """The category at a place; the last one for a place outside the label set."""
    return F.coalesce(F.get(F.array(*map(F.lit, R.CATEGORIES)), index.cast("int")), F.lit(R.CATEGORIES[-1]))


def import_summary(label: str, problem: Column, imported: Column, duplicates: Column, skipped: Column, rows: Column) -> Column:
    """What an import of a file came to, in a sentence."""
    good = F.format_string("Imported %d · %d already known · %d skipped, from %d rows", imported, duplicates, skipped, rows)
    return F.when(problem.isNotNull(), F.concat(F.lit(f"Couldn't read the {label}: "), problem)).otherwise(good)


def backfill_summary(scanned: Column, inserted: Column, duplicates: Column, rejected: Column) -> Column:
    return F.format_string("Scanned %d · imported %d · %d duplicates · %d not transactions", scanned, inserted, duplicates, rejected)


def ref_key(ref: Column) -> Column:
    """Letters and digits in upper case; null unless 6 or longer with 4 digits."""
    key = F.upper(F.regexp_replace(ref, "[^A-Za-z0-9]", ""))
    return F.when((F.length(key) >= 6) & (F.regexp_count(key, F.lit("[0-9]")) >= 4), key)


def vpa_handle(raw: Column) -> Column:
    return found(F.lower(trimmed(raw)), r"^([a-z0-9._-]{2,})@([a-z]{2,})$", 2)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SUFFIX = rf"(?: (?:{'|'.join(s.replace('.', '[.]') for s in R.MERCHANT_SUFFIXES)}))+$"


def _without_suffixes(s: Column) -> Column:
    """Drops suffixes in turn, each once in a pass over their list, pass after pass while there are words."""
    suffixes = F.array(*[F.lit(" " + x) for x in R.MERCHANT_SUFFIXES])
    one_pass = lambda text: F.aggregate(suffixes, text, lambda a, x: F.when(a.endswith(x), F.substring(a, F.lit(1), F.length(a) - F.length(x))).otherwise(a))
    return F.aggregate(F.split(s, " "), s, lambda a, _: one_pass(a))


def merchant_key(raw: Column) -> Column:
    """The key that spellings of one merchant share; '' without a name. Suffixes are dropped until none is left."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    s = F.when(s.contains("@"), F.regexp_replace(trimmed(s), r"^([a-z0-9._-]{2,})@[a-z]{2,}$", "$1")).otherwise(s)
    s = F.trim(F.regexp_replace(s, "[^a-z0-9@.]+", " "))
    # The order of dropping matters only where "pvt. ltd" has suffixes behind it: "pvt." alone is none.
    s = bound(s, lambda x: F.when(x.contains(" pvt. ltd "), _without_suffixes(x)).otherwise(F.regexp_replace(x, _SUFFIX, "")))
    s = F.regexp_replace(s, rf"^(?:{'|'.join(R.MERCHANT_PREFIXES)}) (?=.)", "")
    return F.substring(F.regexp_replace(s, r"\s+\d{3,}$", ""), 1, 64)


def display_name(key: Column) -> Column:
    word = lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 64)))
    return F.when(key == "", "Unknown").otherwise(F.array_join(F.transform(F.split(key, " "), word), " "))


def day_of(text: Column, formats: list[str]) -> Column:
    """The day that one of ``formats`` reads off the text; impossible days are null.

    What a text looks like tells which formats may read it, so that each is read by one at most: failing ones are dear.
    """
    marks = lambda shape: "".join(sorted({"\\" + f[1 if f[0] == "d" else 4] for f in formats if re.fullmatch(shape, f)}))
    plain, named, turned = marks("d.M.y+"), marks("d.MMM.y+"), marks("yyyy.M.d")
    shapes = []
    for digits, year in ((2, "yy"), (4, "yyyy")):
        if plain:
            # A number above 99 is no day: of a day that the year leads, parsing would only fail.
            shapes.append((rf"^(0*\d{{1,2}})([{plain}])(\d+)\2(\d{{{digits}}})$", "$1-$3-$4", f"d-M-{year}"))
        if named:
            shapes.append((rf"^(\d+)([{named}])(\p{{L}}+)\2(\d{{{digits}}})$", "$1-$3-$4", f"d-MMM-{year}"))
        if f"ddMMM{year}" in formats:
            shapes.append((rf"^(\d\d)(\p{{L}}+)(\d{{{digits}}})$", "$1-$2-$3", f"d-MMM-{year}"))
    if turned:
        shapes.append((rf"^(\d{{4}})([{turned}])(\d+)\2(\d+)$", "$1-$3-$4", "yyyy-M-d"))
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(F.regexp_replace(text, shape, parts), form)) for shape, parts, form in shapes])


def file_day(token: Column) -> Column:
    """A day of a file: its first word, else the whole, in any format, else a spreadsheet's serial number."""

    def read(s: Column) -> Column:
        serial = F.when(s.rlike(r"^\d+(\.|$)"), F.regexp_extract(s, r"^(\d+)", 1).try_cast("int"))
        counted = bound(serial, lambda n: F.when(n.between(20_000, 80_000), F.date_add(F.lit("1899-12-30").cast("date"), n)))
        return F.coalesce(bound(F.substring_index(s, " ", 1), lambda w: day_of(w, R.FILE_DATES)), F.when(s.contains(" "), day_of(s, R.FILE_DATES)), counted)

    return bound(trimmed(token), read)


def location_confidence(age_ms: Column) -> Column:
    age = F.greatest(age_ms, F.lit(0).cast("bigint"))
    return F.when(age_ms.isNull(), "NONE").when(age <= 120_000, "HIGH").when(age <= 600_000, "MEDIUM").when(age <= 3_600_000, "LOW").otherwise("NONE")


def narration_channel(text: Column) -> Column:
    n = F.lower(text)
    has = lambda *words: F.coalesce(*[F.when(n.contains(w), True) for w in words], F.lit(False))
    return (
        F.when(has("upi"), "UPI").when(has("imps"), "IMPS").when(has("neft"), "NEFT").when(has("rtgs"), "RTGS")
        .when(has("atm", "cash wdl"), "ATM").when(has("pos", "card"), "CARD").when(has("ach", "mandate"), "AUTOPAY").otherwise("UNKNOWN")
    )


def narration_merchant(text: Column) -> Column:
    """The part with most letters that is no scheme word, without 'payment to'; the first of equals."""
    letters = lambda s: F.length(F.regexp_replace(s, r"\P{L}+", ""))
    parts = F.transform(F.split(text, r"[/|:]"), trimmed)
    rated = F.transform(parts, lambda s, i: F.struct(letters(s).alias("n"), (-i).alias("place"), s.alias("s")))
    best = F.coalesce(F.array_max(F.filter(rated, lambda p: (p["n"] >= 3) & ~F.lower(p["s"]).isin(R.SCHEME_WORDS)))["s"], F.lit(""))
    return F.nullif(F.substring(trimmed(F.regexp_replace(best, r"(?i)^payment (?:to|from)\s+", "")), 1, 60), F.lit(""))


def csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n\r]'), quoted).otherwise(F.coalesce(value, F.lit("")))


def column_number(ref: Column) -> Column:
    """0-based column of a cell reference; 0 without letters."""
    letters = F.filter(F.split(F.upper(F.coalesce(F.regexp_extract(ref, "^([A-Za-z]*)", 1), F.lit(""))), ""), lambda c: c != "")
    return F.greatest(F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1, F.lit(0))


def local_ms(ms: Column, zone: str) -> Column:
    """Milliseconds of the wall clock in ``zone``, whatever the session's zone."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def from_local_ms(ms: Column, zone: str) -> Column:
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), zone))


def local_day(ms: Column, zone: str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local_ms(ms, zone) / R.DAY_MS).cast("int"))


def day_ms(day: Column) -> Column:
    """Midnight of a day on the wall clock, in milliseconds."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * R.DAY_MS
