import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(coder, text):
    raw = coder.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


TEXTS = ["", " ", "Hello, WORLD's 123", "a\x1cb\x1d c\x85d\xa0e f", "ΑΣ ΣΑΣ ς", "İstanbul ẞ ﬀ", "x<|endoftext|>y <|startoftext|>", "é ́a", "日本語 テスト 🙂🙂", "don't we'll I'd", "a" * 3000, "!?" * 700, "ab" * 130, "힣 ½ ² ⅷ", "tab\tnew\nline\r\n", "'S'T'RE"]


def test_equals_the_library(library):
    coder = bpe.Encoder(PATH)
    for t in TEXTS:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(coder, t) == want, t[:40]
        assert coder.decode(coder.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    coder = bpe.Encoder(PATH)
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(f"a{chr(c)}b {chr(c)} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    bad = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ids(coder, t) != e.ids]
    assert not bad, [hex(ord(c)) for t in bad[:3] for c in t if ord(c) > 127][:80]


def test_long_words_merge_in_the_same_order():
    v = bpe.vocabulary(PATH)
    for word in ("thethethe" * 20, "aaaabbbaab" * 15):
        parts = [v.inner[b] for b in word.encode()]
        assert bpe.merge_short(parts[:], v) == bpe.merge_long(parts[:], v)


def test_random_words_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdethinoresABé.,'!", k=rng.randint(1, 40))) for _ in range(30)) for _ in range(60)]
    coder = bpe.Encoder(PATH)
    for group in (texts[:20], texts[10:], texts):
        assert [list(memoryview(x).cast("I")) for x in coder.encode_many(group)] == [e.ids for e in library.encode_batch(group, add_special_tokens=False)]


def test_query_cases(spark, tmp_path, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, None, None), (99, None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, IDS string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9(spark, str(tmp_path)).collect()}
    want = set()
    for i, t, _ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.op9(spark, str(tmp_path)).count() == len(rows)
    out = bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string, IDS string").limit(0), PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and out.count() == 0
    assert bpe.decode(bpe.encode(spark.createDataFrame(rows[:3], "doc_id long, text string, IDS string"), PATH), PATH).where("doc_id = 2").first().decoded == library.decode(library.encode(TEXTS[2], add_special_tokens=False).ids)
