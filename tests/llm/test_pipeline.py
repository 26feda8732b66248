import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from spendspark.llm import near_dedup, packing, quality_rules, secrets, toxicity


def test_stages_and_run(spark, tmp_path):
    rng, rows, labels = random.Random(8), [], []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]
    for i in range(400):
        text = rng.choices(words, k=rng.randint(80, 160))
        toxic, junk = i % 7 == 0, i % 11 == 0
        if toxic:
            text[3:3] = ["snarl", "sneer"]
        if junk:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000 + i, rows[1][1], "en", "s") for i in range(20)]  # copies
    rows += [(1100, rows[2][1] + " extra", "en", "s"), (1200, rows[3][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + " ".join(words[:90]), None, None)]
    rows += [(2000, None, "en", None), (None, rows[4][1][::-1], None, "s"), (2001, "", "", ""), (5, rows[5][1], "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, now, kept = str(tmp_path), docs, [{r[0] for r in rows}]
    for name, stage in C.STAGES[:4]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/stage-{name}")
        now = spark.read.parquet(f"{sf}/stage-{name}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    toxic, junk = {i for i in range(400) if i % 7 == 0}, {i for i in range(400) if i % 11 == 0}
    assert len(kept[1] & toxic) <= 2 and len((kept[0] - kept[1]) - toxic) <= 2
    assert len(kept[2] & junk) <= 2 and len((kept[1] - kept[2]) - junk - {2000, 2001}) <= 2
    assert kept[2] - kept[3] == {*range(1000, 1020), 1100} and kept[3] == kept[4]
    text = {r.doc_id: r.text for r in now.collect()}
    assert "24be64" not in text[1200] and 'token = "[secret]"' in text[1200] and now.where("doc_id = 5").count() == 1
    assert all(r.n_chars == len(r.text) for r in now.collect())
    packed = C.run(spark, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in text.values())
    assert {r.doc_id for r in packed} == kept[4] and sum(r.length for r in packed) == total
    assert len({r.sequence_id for r in packed}) <= 1.05 * total / 2048 + 1  # documents are about a sixth of a sequence each


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in C.STAGES[:4]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert C.run(spark, str(tmp_path)).count() == 0
    assert toxicity and quality_rules and secrets


def test_columns_that_clash(spark, tmp_path):
    """Columns named like those that stages work with come through as they are."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = [(i, " ".join(word() for _ in range(80)), "en", "s", 0, i, f"t{i}", f"d{i}", f"k{i}", f"r{i}") for i in range(12)]
    rows += [(50 + i, rows[0][1], "en", "s", 0, 50 + i, "t", "d", "k", "r") for i in range(3)]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept int, text_ string, __doc string, __key string, __raw string"
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in C.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    got = {r.doc_id: (r.kept, r.text_, r["__doc"], r["__key"], r["__raw"]) for r in now.collect()}
    assert got == {i: (i, f"t{i}", f"d{i}", f"k{i}", f"r{i}") for i in range(12)}
    assert C.STAGES[4][1](spark, now, str(tmp_path)).count() == 12


def test_a_text_is_sent_once(spark, monkeypatch):
    """Python gets each text once, not beside copies of itself, and a few dropped ids don't shuffle whole documents."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=90)), i) for i in range(12)]
    docs = spark.createDataFrame([*rows, (50, rows[0][1], 0)], "doc_id long, Text string, n int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    strings, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: strings.append(self.schema.simpleString().count("string")) or real(self, *a, **k))
    with monkeypatch.context() as m:
        m.setattr(toxicity, "best_words", lambda *a: [])
        steps = [toxicity.clean(docs, labels), near_dedup.first_of_each(docs), secrets.redact(docs), packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))]
    assert max(strings) == 1 and strings.count(1) >= 6
    assert steps[1].columns == steps[2].columns == docs.columns and {r.doc_id for r in steps[1].collect()} == set(range(12))
    assert near_dedup.sketches(docs, 4, "doc_id", "text").columns == ["doc_id", "key", "n_shingles", "signature"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dedup.first_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
