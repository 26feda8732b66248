import random
import re
from itertools import permutations

from spendspark.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, mask int, run string, first int"


def brute(docs, labels):
    """Each filter order applied to each part, document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    texts = [(i, t or "", p or "") for i, t, p, *_ in docs]
    fails = []
    for i, t, _ in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        })
    out, by_order = {}, {}
    for part in {p for _, _, p in texts}:
        rows = [(i, f) for (i, _, p), f in zip(texts, fails) if p == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, gone_ids = [r for r in left if r[1][f]], [r[0] for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(i in good for i in gone_ids), sum(i in toxic for i in gone_ids)]
                by_order[part, f] = by_order.get((part, f), 0) + len(gone)
    return sorted((part, order, step, *v, by_order[part, order[step - 1]]) for (part, order, step), v in out.items())


def corpus(n=240):
    rng, rows = random.Random(3), []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.choice([20, 250]))]
        if i % 5 == 0:
            words = words[:5] * 50
        if i % 7 == 0:
            words = [w.capitalize() for w in words]
        if i % 11 == 0:
            words[3] = "a|b"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "de", None, ""]), 1, "x", 2))
    rows += [(1000 + i, rows[1][1], "en", 0, None, None) for i in range(90)]  # a third of all rows
    rows += [(5, rows[1][1], "fr", 1, "x", 2), (rows[1][0], rows[1][1], "de", 1, "x", 2), (None, rows[1][1], "en", 1, "x", 2), (None, rows[2][1], "en", 1, "x", 2), (None, None, None, 1, "x", 2)]
    rows += [(2000, None, "en", 1, "x", 2), (2001, "", "en", 1, "x", 2), (2002, "\x1c \x85", None, 1, "x", 2), (2003, "word " * 60000, "en", 1, "x", 2), ((1 << 63) - 1, rows[3][1], "es", 1, "x", 2)]
    rng.shuffle(rows)
    return rows


LABELS = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (1003, 1, 1), (None, 1, 1), (2000, None, 1)]


def test_equals_brute_force(spark):
    docs = corpus()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, A.audit(spark.createDataFrame(docs, SCHEMA).repartition(7), labels).collect()))
    assert got == brute(docs, LABELS) and len(got) == 5 * 600


def test_runs_over_range_borders(spark):
    """Texts whose copies fill several ranges, with the smallest id in any of them."""
    rows = [(i, "same" if i % 3 else f"own {i}", "en") for i in range(4000)] + [(None, "same", "en")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        masks = A.failing(df)
        copies = {r.doc_id for r in masks.where(masks["mask"].bitwiseAND(16) != 0).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert copies == {i for i in range(4000) if i % 3} - {1}


def test_unlike_texts_of_one_fingerprint(spark):
    """The fold compares texts, not fingerprints."""
    import pyarrow as pa

    from unittest import mock

    batch = pa.RecordBatch.from_pydict({"fingerprint": pa.array([1, 1, 1, 1], pa.int64()), "text": ["a", "a", "b", "b"], "doc_id": pa.array([3, 9, 1, 7], pa.int64()), "part": ["p"] * 4, "mask": pa.array([0] * 4, pa.int32())})
    with mock.patch("pyspark.TaskContext.get") as task:
        task.return_value.partitionId.return_value = 0
        rows = pa.Table.from_batches(list(A._runs([batch.slice(0, 1), batch.slice(1, 2), batch.slice(3)]))).to_pylist()
    assert [r["smallest"] for r in rows if not r["edge"]] == [3, 3, 1, 1]
    assert [(r["run"], r["text"], r["smallest"]) for r in rows if r["edge"]] == [(0, "a", 3), (1, "b", 1)]


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
