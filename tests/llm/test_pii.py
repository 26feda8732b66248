import hashlib
import math
import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from spendspark.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    digits = regex.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end(), m[0]) for m in regex.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


def card(rng, n=16):
    d = "".join(rng.choices("0123456789", k=n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def odd_texts():
    rng, out = random.Random(4), [None, "", "a@b.c_x@d.e", "a@b.c..d@e.f", "a@b..c", "x@y.z.", "@b.c a@b", "a@b-.c-", "1.2.3.4.5 256.1.1.1 0001.02.3.255", "1.2.3", "1.2.3.4444"]
    out += ["+1 (499) 555-6503. +12 +1234567 +1-2-3-4-5-6-7-8 ++49 30 1234567", "+123456789012345678", "+1 2 3 4 5 6 7 8 \n+44 20 7946 0000)"]
    for n in (15, 16, 17, 19, 20):
        c = card(rng, n)
        out += [c, " ".join(c), "-".join(c[i : i + 4] for i in range(0, n, 4)), "x" + c + "y", c[:8] + "  " + c[8:], c + "-", c + " 1", c[:-1] + str((int(c[-1]) + 1) % 10)]
    alphabet = "ab1.@-+_ ()9É𝒳\n%"
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rng.choices("0123456789 -.", k=rng.randint(15, 40))) for _ in range(500)]
    out += ["a" * 200_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "1 " * 100_000, "9" * 200_000 + ".1.1.1", "+1" + "2" * 100_000, "a@b.c " * 3000, "1.2.3.4 " * 1000 + card(rng)]
    return out


def test_base_spans_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nothing = spark.createDataFrame([], "term string, entity string, disclosure double")
    got = {r.doc_id: r for r in P.scan(df, terms=nothing).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        for k in BASE:
            assert [tuple(s) for s in got[i][k]] == want[k], (k, (t or "")[:80])


def corpus():
    """Entities with a name that stands only near them, and words that stand everywhere."""
    rng, rows = random.Random(9), []
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    for i in range(400):
        rows.append((i, say(60)))
    for i in range(20):
        rows.append((1000 + i, f"{say(20)} Zorblatt{' ' if i else chr(10)}zorb.latt{'@'}acme.example writes {say(20)}"))
        rows.append((2000 + i, f"{say(20)} Quendolin of {say(4)}" + (f" +49 30 12345678 {say(5)}" if i < 18 else "")))
    rows += [(3000, f"{say(30)} ZORBLATT was here"), (3001, f"{say(30)} Quendolin was here"), (3002, None), (3003, "")]
    rows += [(4000 + i, "Copied words near copy@cat.example only") for i in range(30)] + [(None, f"{say(5)} zorblatt")] * 2
    return rows


def rated(rows):
    n, holds, has_term, near, texts_e, texts_p = len(rows), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for row, (_, t) in enumerate(rows):
        for w in regex.findall(r"\p{L}{3,}", t or ""):
            has_term[w.lower()].add(row)
        for k, spans in base(t).items():
            every = [(m.start(), m.end()) for m in regex.finditer(BASE[k], t or "")]
            for a, b, v in spans:
                at = every.index((a, b))
                lo, hi = every[at - 1][1] if at else 0, every[at + 1][0] if at + 1 < len(every) else len(t)
                before, after = t[lo:a], t[b:hi]
                before = regex.sub(r"^\p{L}+", "", before[-P.REACH :]) if len(before) > P.REACH else before
                after = regex.sub(r"\p{L}+$", "", after[: P.REACH]) if len(after) > P.REACH else after
                e = f"{k}:" + (v.lower() if k == "email" else v if k == "ip" else regex.sub("[^0-9]", "", v))
                holds[e].add(row)
                texts_e[e].add(t)
                for w in regex.findall(r"\p{L}{3,}", regex.sub(r"[^ \t\n\x0b\f\r]*[0-9@][^ \t\n\x0b\f\r]*", " ", before + " " + after)):
                    near[e, w.lower()].add(row)
                    texts_p[e, w.lower()].add(t)
    best = {}
    for (e, w), r in near.items():
        if len(texts_e[e]) >= P.MIN_TEXTS and len(texts_p[e, w]) >= P.MIN_TEXTS and len(holds[e]) < n:
            d = round(math.log2(n * len(r) / (len(holds[e]) * len(has_term[w]))) / math.log2(n / len(holds[e])), 9)
            if d >= P.GENERALISE:
                best[w] = max(best.get(w, 0), d)
    return best


def test_disclosures_and_spans_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, email string, general int, `__key` string").repartition(5)
    told = rated(rows)
    got = {r.term: r.disclosure for r in P.disclosures(df).collect()}
    assert got.keys() == told.keys() and all(abs(got[w] - told[w]) < 1e-6 for w in got)
    assert "zorblatt" in told and "quendolin" in told and not {"copied", "near"} & set(told)
    out = P.scan(df)
    assert set(out.columns) == {"doc_id", "text", "__key", *P.BASE, *P.TERMS} and out.count() == len(rows)
    for r in out.collect():
        words = [(m.start(), m.end(), m[0], told.get(m[0].lower())) for m in regex.finditer(r"\p{L}{3,}", r.text or "")]
        assert [tuple(s) for s in r.general] == [w[:3] for w in words if w[3] is not None and w[3] < P.REMOVE]
        assert [tuple(s) for s in r.removed] == [w[:3] for w in words if w[3] is not None and w[3] >= P.REMOVE]
        assert {k: [tuple(s) for s in r[k]] for k in P.BASE} == base(r.text)


def test_sanitised(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("email", F.lit("mine"))
    out = P.sanitised(df)
    assert out.columns == df.columns and out.where("email = 'mine'").count() == df.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert "ZORBLATT" not in text[3000] and text[3000].endswith(" was here") and "[email]  " in text[1003] and "writes" not in text[1003] and "orblatt" not in text[1003]
    assert text[3002] is None and text[3003] == "" and text[4000] == "Copied words near [email] only"


def test_query(spark, tmp_path):
    rows = corpus() + list(enumerate(odd_texts(), 10_000))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op13(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = dict(r for r in rows if r[0] is not None)
    for r in got:
        if r.doc_id is not None:
            want = base(text[r.doc_id])
            joined = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b, _ in want[k])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in BASE]
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a@b.c", "x")], "doc_id long, text string, extra string")
    for made in (P.scan(df), P.sanitised(df), P.disclosures(df), P.mentions(df)):
        plan = made._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapPartitions"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.scan(empty).count() == 0 and P.sanitised(empty).count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_places_of_many_matches(spark, n):
    text = "ü" + "ab, " * n
    assert [tuple(s) for s in spark.createDataFrame([(text,)], "t string").select(P.places(F.col("t"), "ab").alias("p")).first().p] == [(1 + 4 * i, 3 + 4 * i, "ab") for i in range(n)]
