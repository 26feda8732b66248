import hashlib
import random
import zlib

from pyspark.sql import functions as F

from spendspark.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, key int, cell string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(digests, k=2):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + k])) for i in range(0, len(out[-1]), k)])
    return out


def way(tree, place, k=2):
    for level in tree[:-1]:
        first = place // k * k
        yield "".join(level[first:place]), "".join(level[place + 1 : first + k])
        place //= k


def brute(docs, k=2):
    groups = {}
    for r in docs:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], k) for g in names}
    whole = levels([trees[g][-1][0] for g in names], k)
    out = []
    for n, g in enumerate(names):
        for place, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            siblings = [*way(trees[g], place, k), *way(whole, n, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(*r[:3], None if r[3] is None else r[3] + 1, r[4]) if hit else own
            for a, b in siblings:
                folded = h(a + folded + b)
            out.append((r[0], own, trees[g][-1][0], whole[-1][0], h("".join(a + b for a, b in siblings)), folded, folded == whole[-1][0]))
    return out


def corpus(n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["s", None, ""]), rng.choice(["en"] * 5 + ["de", None, "", "日本", "é"]), rng.choice([None, 5, -1]), rng.choice(["x", None, "", "ü" * 900, f"text {i}"]), "t", 1, "c") for i in range(n)]
    rows += rows[:2] * 3 + [(None, "s", "en", 1, "no id", None, None, None), (None, None, "en", None, None, "t", 1, "c"), (7, "s", "lone", 1, "one", "t", 1, "c")] if n > 2 else []
    rng.shuffle(rows)
    return rows


def key(row):
    return str(row)


def test_equals_brute_force(spark):
    for n, range_rows in ((300, 16), (1, 4), (70, 1), (600, None)):
        docs = corpus(n)
        got = M.manifest(spark.createDataFrame(docs, SCHEMA).repartition(3), range_rows)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs), key=key)


def test_frontiers_climb_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "WIDER", 3)
    docs = corpus(400)
    rows = M.leaves(spark.createDataFrame(docs, SCHEMA), {f: F.col(f) for f in M.FIELDS}, "lang", "doc_id")
    built = M.Manifest(rows, range_rows=20)
    assert len(built.rounds) >= 4 and built.roots().count() == 7
    for _, left in built.rounds[1:]:
        assert left.count() < 200  # a frontier is a few nodes a border
    got = M.proved(rows, range_rows=20).select("key", "subroot", "root", "proof_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], r[2], r[3], r[4]) for r in brute(docs)], key=key)


def test_wider_trees_and_siblings(spark):
    docs = corpus(200)
    rows = M.leaves(spark.createDataFrame(docs, SCHEMA), {f: F.col(f) for f in M.FIELDS}, "lang", "doc_id")
    for r in M.proved(rows, arity=5, range_rows=16, siblings=True).collect():
        own = r.leaf
        for a, b in zip(r.lefts, r.rights):
            own = h(a + own + b)
        assert own == r.root
    got = M.proved(rows, arity=5, range_rows=16).select("key", "leaf", "root", "proof_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], r[1], r[3], r[4]) for r in brute(docs, 5)], key=key)


def test_events_in_any_order():
    """Parents are emitted when their last child comes, whatever the order."""
    for n in (1, 2, 3, 7, 16, 33):
        digests = [h(str(i)) for i in range(n)]
        order = list(range(n))
        random.Random(n).shuffle(order)
        c = M.Climb(n, 3)
        for i in order:
            c.add(0, i, digests[i])
        assert c.root == levels(digests, 3)[-1][0] and not c.partial


def test_empty_table(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
