"""Operator 3: secret scans by assignment-aware lexing.

Three base kinds are found by pattern. Beside them, ``lex`` reads source and configuration syntax into pairs of a name and
a literal (quoted or bare, concatenated, or a constant that was assigned before), and ``score`` rates each literal by how
sensitive its target name is and how much the literal looks like a secret. Literals from LEAST on are added as kind
``literal``. Work is per text, so it needs no shuffle; texts are scanned whole, each part a bounded number of times, and a
literal of any length or a concatenation of any number is judged whole.

Cases: null text counts as empty and has no spans; a text without an assignment has base spans only; ties at one start are
ordered by kind as listed; equal rows give equal results; extra columns pass through, those named like an output are
replaced; an empty table gives an empty table. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.common import arrow_columns, numbered, table

#: Fixed: the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "literal"]
#: A keyword in lower case that each match of ASSIGN holds.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = 0.6
#: Sensitive words of names, or pairs of words that stand together, and what they count.
SENSITIVE = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "secret": 0.6, "token": 0.5, "apikey": 0.6, "api key": 0.6, "access key": 0.6,
    "private key": 0.6, "secret key": 0.6, "signing key": 0.6, "encryption key": 0.6, "client secret": 0.6, "auth": 0.4, "credential": 0.5,
    "credentials": 0.5, "bearer": 0.5, "connection string": 0.4, "dsn": 0.4,
}
#: Words that turn a sensitive name into one that holds no secret itself.
HARMLESS = {"name", "file", "path", "url", "uri", "type", "length", "size", "count", "ttl", "expiry", "field", "label", "hint", "policy", "hash", "id"}
_PLACEHOLDER = re.compile(r"^(?:<.*>|\$\{?.*|%.*%|\{\{.*|x+|\*+|\.+|(?:your|my|some|an?)[-_ ].*|change[-_]?me|example.*|dummy|test|none|null|nil|true|false|todo|redacted)$", re.I)
_TARGET = re.compile(r"""(?<![\w.\-])(["']?)([A-Za-z_][\w.\-]*+)\1[ \t]*+(?::=|=>|\+=|=(?!=)|:(?![:/]))[ \t]*+""", re.A)
_QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'""")
_NAME, _JOIN, _BARE = re.compile(r"[A-Za-z_][\w.]*+", re.A), re.compile(r"[ \t]*+(?:\+|\.\.?)[ \t]*+(?=[\"'A-Za-z_])"), re.compile(r"[^\s\"'#;,&|<>(){}\[\]]++")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Value:
    """What scoring needs of a literal, or of several joined, whatever the length: size, counts of characters, both ends."""

    __slots__ = ("n", "counts", "head", "tail")
    KEEP = 32

    def __init__(self, text: str):
        self.n, self.counts, self.head, self.tail = len(text), Counter(text), text[: 2 * self.KEEP], text[-self.KEEP :]

    def __add__(self, other: Value) -> Value:
        out = Value("")
        out.n, out.counts = self.n + other.n, self.counts + other.counts
        out.head, out.tail = (self.head + other.head)[: 2 * self.KEEP] if self.n <= 2 * self.KEEP else self.head, (self.tail + other.tail)[-self.KEEP :]
        return out

    def shown(self) -> str:
        """The text itself, or its ends around each of its characters: a placeholder's pattern fits both or neither."""
        return self.head if self.n <= 2 * self.KEEP else self.head[: self.KEEP] + "".join(sorted(self.counts)) + self.tail


def lex(text: str):
    """Assignments in order: name, value, and parts. A part is the place of a literal, or the number of the assignment whose
    constant stands there, so a constant that is used again and again is neither copied nor cut."""
    constants: dict[str, tuple[int, Value]] = {}
    number = 0
    for target in _TARGET.finditer(text):
        name, at, value = target[2], target.end(), None
        parts: list[tuple[int, int] | int] = []
        while True:
            if m := _QUOTED.match(text, at):
                inner = 1 if m[1] is not None else 2
                part, held, at = m.span(inner), Value(m[inner]), m.end()
            elif (m := _NAME.match(text, at)) and m[0] in constants:
                (part, held), at = constants[m[0]], m.end()
            elif not parts and (m := _BARE.match(text, at)):
                part, held, at = m.span(), Value(m[0]), m.end()
            else:
                break
            parts.append(part)
            value = held if value is None else value + held
            if not (m := _JOIN.match(text, at)):
                break
            at = m.end()
        if parts:
            constants[name] = number, value
            number += 1
            yield name, value, parts


def score(name: str, value: Value | str) -> float:
    """0 to 1: how sensitive the target name is, and whether the literal can be a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    terms = {*words, *map(" ".join, zip(words, words[1:])), "".join(words)}
    name_part = max((v for k, v in SENSITIVE.items() if k in terms), default=0.0)
    if not name_part or words[-1] in HARMLESS:
        return 0.0
    value = Value(value) if isinstance(value, str) else value
    n, counts = value.n, value.counts
    if n < 6 or _PLACEHOLDER.match(value.shown()):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return round(min(1.0, name_part + 0.1 * (n >= 12) + 0.1 * (kinds >= 2) + 0.1 * (kinds >= 3) + 0.1 * (entropy >= 3) - 0.3 * (" " in counts) - 0.3 * (entropy < 1.5)), 6)


def literals_of(text: str) -> dict[tuple[int, int], float]:
    """Places of the literals that stand, by themselves or through constants, in an assignment from LEAST on, and the score."""
    assigned, found = list(lex(text)), {}
    marks = [0.0] * len(assigned)
    # Constants come before their uses, so one way back marks all that a secret consists of.
    for i in range(len(assigned) - 1, -1, -1):
        name, value, parts = assigned[i]
        own = score(name, value)
        if mark := max(marks[i], own if own >= LEAST else 0.0):
            for part in parts:
                if isinstance(part, int):
                    marks[part] = max(marks[part], mark)
                else:
                    found[part] = mark
    return found


def spans_of(text: str | None) -> list[dict]:
    """All spans of a whole text by start, then kind as listed. ``hide`` is where the secret itself begins."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m.start(2), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), 1.0) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [(a, 3, b, a, s) for (a, b), s in literals_of(text).items() if b > a]
    return [{"kind": KINDS[k], "start": a, "end": b, "hide": h, "score": s} for a, k, b, h, s in sorted(found)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("hide", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: kind, start, end, hide and score of each span."""
    return arrow_columns(df, text, [T.StructField("secrets", SPANS, False)], lambda: lambda texts: [[spans_of(t) for t in texts]])


def redact_text(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each secret replaced by ``mark``; names and syntax around it stay. Null stays null."""
    out, at = [], 0
    for s in sorted(spans_of(text), key=lambda s: (s["hide"], -s["end"])):
        if s["end"] > at:
            if s["hide"] >= at:
                out += [text[at : s["hide"]], mark]
            at = s["end"]
    return text if not out else "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the secrets in column ``text``; the columns stay in order, and ``n_chars``, where there is one, is counted anew."""
    inner, name = numbered(df)
    done = arrow_columns(inner, name[text if text in name else text.lower()], [T.StructField("clean", T.StringType())], lambda: lambda texts: [[redact_text(t) for t in texts]], keep_source=False)

    def made(f: T.StructField):
        if f.name.lower() == text.lower():
            return F.col("clean").alias(f.name)
        if f.name.lower() == "n_chars":
            return F.when(F.col("clean").isNull(), F.col(name[f.name])).otherwise(F.length("clean")).cast(f.dataType).alias(f.name)
        return F.col(name[f.name]).alias(f.name)

    return done.select(*[made(f) for f in df.schema.fields])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text")), "__text")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
