"""The pipeline over a small table: each stage's decisions take effect, clean documents stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    letters = {"en": "etaoinshr", "de": "enirüßäö"}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(letters))
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    copies = [(1000 + i, rows[i][1], "en", "src0", 1) for i in range(40)]
    none = [(2000, "12345 67", "en", "src0", 1), (2001, None, "en", "src0", 1), (2002, "", None, None, 1)]
    private = [(3000, rows[0][1][::-1] + " bosbt.42@mail8.example.com", "en", "src1", 1)]
    spark.createDataFrame(rows + copies + none + private, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "encoding" or docs.columns == columns
    assert {r.doc_id for r in seen["language_id"]} == {r[0] for r in rows + copies + private}
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(r[0] for r in rows + private)
    assert [r.text for r in seen["pii"] if r.doc_id == 3000][0] != private[0][1]
    assert {r.doc_id: r.text for r in seen["pii"] if r.doc_id < 3000} == {r[0]: r[1] for r in rows}
    assert 150 < len(seen["mixing"]) < 600 and len(seen["encoding"]) == len(seen["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in seen["encoding"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
