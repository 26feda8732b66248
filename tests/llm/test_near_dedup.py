import random
import re

import pytest

from spendspark.llm import near_dedup as N


def brute(rows, words=4):
    """rows: (doc_id, text). Component and set size by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for k, i in enumerate(usable):
        for j in usable[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i in usable:
        lowest[find(i)] = min(lowest.get(find(i), rows[i][0]), rows[i][0])
    return [(d, len(s), None if d is None else lowest[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(rng, n, size, edits):
    base = [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(size)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("ABCDEF") * 2
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


def corpus():
    rng = random.Random(11)
    texts = family(rng, 40, 90, 9) + family(rng, 40, 60, 6) + [t for _ in range(40) for t in family(rng, 1, 50, 0)] + ["One two three", "one TWO  three", "", None, "  ", "Éa b c d", "éa b c d", "a b", "z " * 5000]
    texts += [texts[3]] * 30
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(None, texts[3]), (None, None)]


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus()
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, N.op4(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(d, n, c, d == c) for d, n, c in brute(rows)], key=str)
    assert 40 < len({c for _, _, c, _ in got}) < 115  # both linked and lone documents


def test_one_of_each_stays(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (None, "a b c d e f g"), (7, "other text here"), (7, "other text here"), (8, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, Key string")
    kept = N.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [3, 9, None, 7, 8]))
    assert N.first_of_each(docs.limit(0)).count() == 0 and N.components(docs.limit(0)).count() == 0


def test_bounds():
    least = N.least_matches(80)
    assert least[32] < 0.8 * 32 and 0.55 * 160 < least[160] < 0.72 * 160
    s, n = N.shingle_set(N.normalised("a b c d e " * 3), 4)
    assert len(s) == n == 5 and len(N.signature(s)) == 2 * N.SIZE


def test_sets_are_counted_and_confirmed_on_words(spark, monkeypatch):
    # strings that sums of powers modulo 2**64 cannot tell apart
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, other), (3, f"x y z {thue} x y z {other}"), (4, "one two three four five six seven eight"), (5, "nine ten eleven twelve thirteen fourteen fifteen"), (6, "One two three four five six seven eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((d, n, c) for d, n, c in brute(rows))
    shape = lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.components(docs, words=4).collect())
    assert shape() == want == [(1, 1, 1), (2, 1, 2), (3, 5, 3), (4, 5, 4), (5, 4, 5), (6, 5, 4)]
    # hashes that meet: all that is counted and linked stays as it is
    monkeypatch.setattr(N, "_mixed", lambda x: x & N._U(1))
    s, n = N.shingle_set(b"a b c d a b c d a", 4)
    assert n == 4 and len(s) <= 2
    pairs = spark.createDataFrame([(4, 6), (4, 5), (1, 2)], "x long, y long")
    texts = spark.createDataFrame([(d, t.lower(), n) for (d, t), (_, n, _) in zip(rows, brute(rows))], "node long, joined string, n_shingles long")
    assert [tuple(r) for r in N.confirmed(pairs, texts, 4, 80).collect()] == [(4, 6)]
