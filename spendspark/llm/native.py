"""Folds and matches as column expressions, for operators that run without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["bound", "folded", "places"]

#: Items that one step of a fold holds: what it gathers is copied at each step, so long lists are folded in parts.
PART = 256


def folded(items: Column, state: dict[str, Column], kind: str, step) -> Column:
    """All that ``step`` gathers over ``items``, in order. ``step`` takes the state, what its part has gathered so far (arrays
    of ``kind``) and an item, and returns both anew. Parts are folded in turn, so copying stays small for any number of items."""
    none = F.array().cast(f"array<{kind}>")
    begin = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        new, out = step(acc, acc["out"], item)
        return F.struct(*[new[k].alias(k) for k in state], out.alias("out"))

    parts = lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(PART)), lambda i: F.slice(all_, i + 1, PART))
    outer = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("outs"))

    def part(acc: Column, items_: Column) -> Column:
        start = F.struct(*[acc[k].alias(k) for k in state], none.alias("out"))
        folded = F.array(F.aggregate(items_, start, one))
        # The part's result is bound to a variable, so that it is worked out once.
        return F.get(F.transform(folded, lambda r: F.struct(*[r[k].alias(k) for k in state], F.concat(acc["outs"], F.array(r["out"])).alias("outs"))), F.lit(0))

    whole = lambda all_: F.when(F.size(all_) <= PART, F.aggregate(all_, begin, one, lambda acc: acc["out"])).otherwise(F.aggregate(parts(all_), outer, part, lambda acc: F.flatten(acc["outs"])))
    return F.get(F.transform(F.array(items), whole), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(text: Column, pattern: str, reach: int = 0) -> Column:
    """start and end (code points) and value of each match of ``pattern``, leftmost first, none over another; with ``reach``
    also ``before`` and ``after``: as many characters around it as that, up to the next match, words that are cut left out.

    Matches are those that the text is split at, so places follow from lengths. ``pattern`` can't match an empty string.
    """
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    kind = "struct<start:bigint,end:bigint,value:string" + (",before:string,after:string>" if reach else ">")

    def around(piece: Column, left: bool) -> Column:
        cut = F.regexp_replace(F.right(piece, F.lit(reach)), r"^\p{L}+", "") if left else F.regexp_replace(F.left(piece, F.lit(reach)), r"\p{L}+$", "")
        return F.when(F.length(piece) > reach, cut).otherwise(piece)

    def item(b: Column, i: Column) -> Column:
        piece, value = F.get(b["pieces"], i), F.get(b["matches"], i)
        sizes = [F.length(piece).cast("long").alias("gap"), F.length(value).cast("long").alias("size"), value.alias("value")]
        return F.struct(*sizes, *([around(piece, True).alias("before"), around(F.get(b["pieces"], i + 1), False).alias("after")] if reach else []))

    def step(acc: Column, out: Column, s: Column) -> tuple[dict[str, Column], Column]:
        start = acc["at"] + s["gap"]
        own = F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["value"].alias("value"), *([s["before"].alias("before"), s["after"].alias("after")] if reach else []))
        return {"at": start + s["size"]}, F.concat(out, F.array(own))

    def all_(b: Column) -> Column:
        items = F.transform(F.sequence(F.lit(0), F.size(b["matches"]) - 1), lambda i: item(b, i))
        return F.when(F.size(b["matches"]) > 0, folded(items, {"at": F.lit(0).cast("long")}, kind, step)).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(both, all_)
