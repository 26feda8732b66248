"""Operator 12: a Merkle manifest: a digest of each row, of each group and of the whole table, and a proof for each row.

Rows are numbered in their group by one range sort. Then digests climb: each task holds the parents of which it has met a
child, by level and place, and emits a parent's digest as soon as all of its children are there; how many those are follows
from the group's size. What a task can't complete, the frontier, is a few nodes for each border between ranges; it is dealt
again by wider and wider stretches of the group until only roots are left. Roots of groups climb by the same steps to the
root of all. Proofs come down the same way: a task is given the siblings above its frontier and appends those of its own.

No task holds more than a range of digests, and nothing but counts comes to the driver.

Cases: null fields differ from empty ones. A null group is a group of its own, before all others; rows without an order key
come first. Equal keys (repeated rows, ties) are ordered by digest, so the result doesn't hang on chance. Texts are read whole.
Extra columns, whatever their names, are not looked at. An empty table gives an empty table; a table of one row has that row's
digest as root, and a proof without siblings.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark.llm.common import quoted, small_enough, table, written

ARITY = 2
#: Leaves of a range, and nodes that one task deals with, on average.
RANGE_ROWS = 1 << 17
#: A stretch of a frontier holds about so many borders of the step before.
WIDER = 1 << 10
_NODE = "tree string, size long, level int, place long, digest string, start long, done boolean, cell long"
_PATH = "tree string, cell long, level int, place long, lefts array<string>, rights array<string>, subroot string, root string"
_HANDED = [("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]


def digest(*fields: Column) -> Column:
    """Digest of a row: of each field ``-`` if null, else its bytes in UTF-8, ``:`` and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def together(digests: str) -> str:
    """Digest of digests, as hexadecimal text."""
    return hashlib.sha256(digests.encode()).hexdigest()


class Climb:
    """Partial parents of one tree of ``size`` leaves. ``full`` keeps the children of parents that were completed."""

    def __init__(self, size: int, arity: int):
        self.arity, self.widths, self.partial, self.full, self.root = arity, [size], {}, {}, None
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // arity))

    def add(self, level: int, place: int, own: str) -> None:
        """A node's digest is known: its parent, and the parent's, are emitted as far as they are complete."""
        while level + 1 < len(self.widths):
            above = level + 1, place // self.arity
            met = self.partial.setdefault(above, {})
            met[place] = own
            if len(met) < min(self.arity, self.widths[level] - above[1] * self.arity):
                return
            self.full[above] = [met[p] for p in sorted(self.partial.pop(above))]
            (level, place), own = above, together("".join(self.full[above]))
        self.root = own

    def frontier(self):
        """(level, place, digest, whether it is the root) of all that has no complete parent."""
        if self.root is not None:
            yield len(self.widths) - 1, 0, self.root, True
        for (level, _), met in self.partial.items():
            yield from ((level - 1, place, own, False) for place, own in sorted(met.items()))

    def way(self, level: int, place: int):
        """Siblings to the left and right, as text, up to a node of the frontier, and that node."""
        lefts, rights = [], []
        while kids := self.full.get((level + 1, place // self.arity)):
            at = place % self.arity
            lefts.append("".join(kids[:at]))
            rights.append("".join(kids[at + 1 :]))
            level, place = level + 1, place // self.arity
        return lefts, rights, level, place


def _climbs(nodes: pa.Table, arity: int) -> dict[str, Climb]:
    found: dict[str, Climb] = {}
    for tree, size, level, place, own in zip(*[nodes[c].to_pylist() for c in ("tree", "size", "level", "place", "digest")]):
        if tree not in found:
            found[tree] = Climb(size, arity)
        found[tree].add(level, place, own)
    return found


def _climbed(nodes: DataFrame, arity: int) -> DataFrame:
    """The frontier of each cell."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        found = _climbs(rows, arity)
        out = [(tree, c.widths[0], level, place, own, place * arity**level, done, key[0].as_py()) for tree, c in found.items() for level, place, own, done in c.frontier()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _NODE.split(", ")])

    return nodes.select("tree", "size", "level", "place", "digest", "cell").groupBy("cell").applyInArrow(work, _NODE)


def _descended(nodes: DataFrame, above: DataFrame, arity: int, carried: list[tuple[str, str, pa.DataType]], ends: bool) -> DataFrame:
    """Gives each node the siblings on its way to the root: its own up to the frontier of its cell, and those handed down.

    ``carried`` columns (name, Spark and Arrow type) pass through. With ``ends`` siblings are folded instead: proof and root that follow from ``claimed``.
    """
    outputs = [("proof_sha256", pa.string()), ("folded_root", pa.string()), *_HANDED[2:]] if ends else _HANDED

    def work(own: pa.Table, handed: pa.Table) -> pa.Table:
        found = _climbs(own, arity)
        upper = {(t, level, place): rest for t, level, place, *rest in zip(*[handed[c].to_pylist() for c in ("tree", "level", "place", "lefts", "rights", "subroot", "root")])}
        results = []
        claims = own["claimed"].to_pylist() if ends else [None] * own.num_rows
        for tree, level, place, claim in zip(own["tree"].to_pylist(), own["level"].to_pylist(), own["place"].to_pylist(), claims):
            lefts, rights, *top = found[tree].way(level, place)
            more, others, subroot, root = upper[(tree, *top)]
            lefts, rights = lefts + more, rights + others
            if ends:
                for a, b in zip(lefts, rights):
                    claim = together(a + claim + b)
                lefts, rights = together("".join(a + b for a, b in zip(lefts, rights))), claim
            results.append((lefts, rights, subroot, root))
        made = [pa.array([r[i] for r in results], type=k) for i, (_, k) in enumerate(outputs)]
        return pa.Table.from_arrays([*[own[n].cast(k) for n, _, k in carried], *made], names=[*[n for n, _, _ in carried], *[n for n, _ in outputs]])

    kind = {"lefts": "array<string>", "rights": "array<string>"}
    schema = ", ".join([*[f"{n} {k}" for n, k, _ in carried], *[f"{n} {kind.get(n, 'string')}" for n, _ in outputs]])
    needed = list(dict.fromkeys(["tree", "size", "level", "place", "digest", "cell", *[n for n, _, _ in carried], *(["claimed"] if ends else [])]))
    paths = above.select("tree", "cell", "level", "place", "lefts", "rights", "subroot", "root")
    return nodes.select(*needed).groupBy("cell").cogroup(paths.groupBy("cell")).applyInArrow(work, schema)


class Manifest:
    """A tree for each value of ``tree`` over leaves in order of ``key``. leaves: tree, key, digest, and others that pass through.

    ``rounds`` are pairs of nodes that a step was given and the frontier that it left, leaves first.
    """

    def __init__(self, leaves: DataFrame, arity: int = ARITY, range_rows: int | None = None):
        self.arity = arity
        spark, per_range = leaves.sparkSession, range_rows or RANGE_ROWS
        # Repeated rows would go to one range; numbers spread them, and as their digests are equal any order of them is right.
        kept = written(leaves, "leaves")
        total = kept.count()
        parts = max(-(-total // per_range), min(spark.sparkContext.defaultParallelism, -(-total // 1024)), 1)
        dealt = kept.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, "tree", "key", "digest", "spread").drop("spread")
        numbers = {"cell": F.spark_partition_id().cast("long"), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
        ranged = written(dealt.sortWithinPartitions("tree", "key", "digest").withColumns(numbers), "ranges")
        # One row for each range and group in it.
        runs = ranged.groupBy("tree", "cell").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        before = Window.partitionBy("tree").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = written(runs.select("tree", "cell", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size")), "offsets")
        placed = ranged.join(small_enough(offsets, offsets.count(), 64), ["tree", "cell"])
        nodes = placed.select(*ranged.columns, "size", F.lit(0).alias("level"), (F.col("row") + F.col("shift")).alias("place"))
        self.rounds, width = [], max(1, total // parts) * WIDER
        while True:
            left = written(_climbed(nodes, arity), "frontier")
            self.rounds.append((nodes, left))
            rest = left.where("NOT done")
            n = rest.count()
            if not n:
                return
            # Neighbours meet: stretches of the group that hold some thousand borders, spread over cells by a hash.
            cells = max(64, -(-n // per_range))
            stretch = F.pmod(F.xxhash64("tree", F.expr(f"start div {min(width, 1 << 62)}L")), F.lit(cells)).cast("long")
            nodes, width = written(rest.withColumnRenamed("cell", "lower").withColumn("cell", stretch).drop("done", "start"), "stretches"), width * WIDER

    def roots(self) -> DataFrame:
        """tree, size and digest of each root."""
        found = [left.where("done").select("tree", "size", "digest") for _, left in self.rounds]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def ways(self, above: DataFrame, carried: list[tuple[str, str, pa.DataType]], ends: bool) -> DataFrame:
        """The carried columns of each leaf with the siblings from it to the root of all, or what follows from them.
        above: tree, lefts, rights, subroot, root: what lies above each tree's root."""
        lower = None
        for i in range(len(self.rounds) - 1, -1, -1):
            nodes, left = self.rounds[i]
            tops = left.where("done").select("tree", "cell", "level", "place").join(above, "tree")
            paths = tops if lower is None else tops.unionByName(lower)
            if i:
                steps = [("tree", "string", pa.string()), ("lower", "long", pa.int64()), ("level", "int", pa.int32()), ("place", "long", pa.int64())]
                lower = written(_descended(nodes, paths, self.arity, steps, False).withColumnRenamed("lower", "cell"), "ways")
        return _descended(nodes, paths, self.arity, carried, ends)


def leaves(df: DataFrame, fields: dict[str, Column], group: str, order: str, claimed: Column | None = None) -> DataFrame:
    """tree, key, digest of each row's ``fields`` (a name and its column), and ``claimed``: the digest to check, else the same."""
    # Ordered as asked: null before the empty string, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(quoted(group)).cast("string")), F.lit(""))
    own = digest(*fields.values())
    return df.select(tree.alias("tree"), F.col(quoted(order)).cast("long").alias("key"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed"))


def proved(rows: DataFrame, arity: int = ARITY, range_rows: int | None = None, siblings: bool = False) -> DataFrame:
    """rows: tree, key, digest, claimed. Returns key, leaf, subroot, root, proof_sha256, folded_root (what follows from
    ``claimed`` and the siblings) and verified; with ``siblings`` lefts and rights instead of the last three: for each level the
    digests, joined, that stand to the left and right."""
    groups = Manifest(rows, arity, range_rows)
    roots = written(groups.roots(), "subroots")
    # The group's name is the order key of the upper tree.
    whole = Manifest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), arity, range_rows)
    none = F.array().cast("array<string>")
    top = whole.roots().select("tree", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"), F.lit("").alias("subroot"))
    upper = whole.ways(top, [("key", "string", pa.string())], False).withColumnRenamed("key", "tree").drop("subroot")
    above = written(upper.join(roots.select("tree", F.col("digest").alias("subroot")), "tree"), "upper")
    out = groups.ways(above, [("key", "long", pa.int64()), ("digest", "string", pa.string())], not siblings).withColumnRenamed("digest", "leaf")
    if siblings:
        return out.select("key", "leaf", "subroot", "root", "lefts", "rights")
    return out.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Fixed: the fields of a leaf, and every which id is tampered with.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
EVERY = 7


def manifest(docs: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Leaves of all documents by language, and the check of their proofs against rows of which some were tampered with."""
    fields = {f: F.col(f) for f in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % EVERY == 0, F.lit(False))
    claimed = digest(*(fields | {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).values())
    return proved(leaves(docs, fields, "lang", "doc_id", claimed), range_rows=range_rows).withColumnRenamed("key", "doc_id")


def op12(spark, sf_dir: str) -> DataFrame:
    """Manifest of all documents."""
    return manifest(table(spark, sf_dir, "documents"))


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), list_transform(range(8), lambda i: 0::BIGINT)), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"


def _sql_digest(n_chars: str) -> str:
    values = [f"{n_chars}::VARCHAR" if f == "n_chars" else f"{f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


SQL = f"""
WITH RECURSIVE docs AS (SELECT *, coalesce({_CRC} % {EVERY} = 0, false) AS hit FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_digest("n_chars")} AS leaf, {_sql_digest("CASE WHEN hit THEN n_chars + 1 ELSE n_chars END")} AS claimed FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
low AS (SELECT tree, 0 AS level, place, size, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE size > 1 GROUP BY tree, level, place // 2, size),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (SELECT 0 AS level, place, size, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE size > 1 GROUP BY level, place // 2, size),
ways AS (SELECT p.doc_id, p.leaf, p.tree, p.place AS row_place, 0 AS part, 0 AS level, p.place, p.size, '' AS siblings, p.claimed AS folded FROM placed p
  UNION ALL SELECT w.doc_id, w.leaf, w.tree, w.row_place, w.part, w.level + 1, w.place // 2, (w.size + 1) // 2, w.siblings || coalesce(n.digest, ''),
    sha256(CASE WHEN w.place % 2 = 1 THEN n.digest || w.folded ELSE w.folded || coalesce(n.digest, '') END)
  FROM ways w LEFT JOIN low n ON n.tree = w.tree AND n.level = w.level AND n.place = xor(w.place, 1) WHERE w.size > 1),
tops AS (SELECT w.doc_id, w.leaf, w.tree, w.row_place, s.subroot, 0 AS level, s.place, s.size, w.siblings, w.folded FROM ways w JOIN subroots s ON s.tree = w.tree WHERE w.size = 1
  UNION ALL SELECT t.doc_id, t.leaf, t.tree, t.row_place, t.subroot, t.level + 1, t.place // 2, (t.size + 1) // 2, t.siblings || coalesce(n.digest, ''),
    sha256(CASE WHEN t.place % 2 = 1 THEN n.digest || t.folded ELSE t.folded || coalesce(n.digest, '') END)
  FROM tops t LEFT JOIN high n ON n.level = t.level AND n.place = xor(t.place, 1) WHERE t.size > 1)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM tops t, (SELECT digest FROM high WHERE size = 1) r WHERE t.size = 1
"""
