"""The parser's rules as a table: kind, place (order within the kind), name (the reason of a gate) and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendspark import rules as R

_SCHEMA = "kind string, place int, name string, value string"
KINDS = ["bank_codes", "psp_codes", "gates", "debit_words", "credit_words", "merchant_patterns"]
#: Rules become expressions, so a table of them is small; a larger one is refused.
MOST = 5_000


def table(spark: SparkSession, rules: R.Rules = R.DEFAULT) -> DataFrame:
    rows = [(kind, i, *(v if kind == "gates" else (None, v))) for kind in KINDS for i, v in enumerate(getattr(rules, kind))]
    return spark.createDataFrame(rows, _SCHEMA)


def read(rows: DataFrame) -> R.Rules:
    """Rules of a table, each kind in order of place; codes and words in lower case. Kinds that the table lacks are empty."""
    found = rows.where(rows["value"].isNotNull()).select("kind", "place", "name", "value").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} rules")
    if unknown := {r.kind for r in found} - set(KINDS):
        raise ValueError(f"unknown kinds of rules: {sorted(map(str, unknown))}")
    of = {k: sorted((r for r in found if r.kind == k), key=lambda r: (r.place is None, r.place, r.value)) for k in KINDS}
    plain = {k: tuple(r.value if k == "merchant_patterns" else r.value.lower() for r in of[k]) for k in KINDS if k != "gates"}
    return R.Rules(**plain, gates=tuple((r.name or "rejected", r.value) for r in of["gates"]))
