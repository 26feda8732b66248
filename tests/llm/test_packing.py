import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from spendspark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    """Sequences are gapless from 0 and fit; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_and_cases(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, "word " * 6000, "a b c", "a b c", "<|endoftext|>", "!" * 9000] + [" ".join(rng.choices(["alpha", "beta", "gamma", "thing"], k=rng.randint(1, 900))) for _ in range(120)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "no id", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, bin int").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op8(spark, str(tmp_path)).collect()
    library, want, tokens = Tokenizer.from_file(PATH), [], 0
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((i, k, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want)
    assert check_layout(got, 2048) <= -(-tokens // 2048) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int")
    assert P.packed(docs.limit(0), PATH).count() == 0


def test_levels_merge_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 3)
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice([3, 30, 47, 61, 100]), i) for i in range(700)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(pieces, capacity=100, nearly_full=99, pieces_each=30).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    n, least = check_layout(got, 100), sum(len(b) > 0 for b in P.best_fit(sorted((r[3] for r in rows), reverse=True), 100))
    assert n <= 1.08 * least + 1


def test_bins_that_never_merge_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 2)
    levels, real = [], P._level
    monkeypatch.setattr(P, "_level", lambda rows, last, *a: levels.append(last) or real(rows, last, *a))
    pieces = spark.createDataFrame([(i, 0, 0, 51 + i % 40, i) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(pieces, capacity=100, nearly_full=99, pieces_each=20).collect()
    assert check_layout(got, 100) == len(got) == 600 and levels == [False, False]


def test_best_fit():
    assert P.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert P.best_fit([], 10) == []
