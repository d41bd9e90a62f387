"""Operator 1: held-out accuracy and edge cases."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm import langid
from stagelight.llm.langid import BUCKETS, DOCS_PER_LANGUAGE, NGRAM_VALUES, SEGMENTS, fit, held_out, identify, training_sample

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éàçœabcd"}


def rows(n):
    rng = random.Random(1)
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        yield i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 60))), lang, "keep", 0.5


def test_held_out_accuracy_and_edges(spark):
    more = [(1000, None, "aa", "", 0.0), (1001, "", "bb", "", 0.0), (1002, "123 $$ 45", "bb", "", 0.0), (1003, "abc" * 50_000, "aa", "", 0.0), (None, "hij jkl ggg", "bb", "", 0.0), (5, "hij", None, "", 0.0)]
    docs = spark.createDataFrame([*rows(600), *more], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = identify(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(got) == 606
    away = [r for r in got if r.held_out and r.doc_id < 600 and r.doc_id != 5]
    assert len(away) > 100 and sum(r.lang == r.lang_pred for r in away) > 0.97 * len(away)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in away) <= 0.02 * len(away)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in identify(docs, F.lit(True)).collect()} == {(1, "und", 0.0, True), (2, "und", 0.0, True)}
    assert identify(docs.limit(0), F.lit(True)).count() == 0


def plain_probabilities(model, text):
    """Softmax of the mean of a text's n-gram rows, in plain Python."""
    letter = lambda c: c.isalpha() or c.isalnum() and not c.isdigit()
    s = " " + "".join(c if letter(c) else " " for c in text.lower()) + " "
    rows = []
    for n in (1, 2, 3, 4):
        for i in range(len(s) - n + 1):
            gram = s[i : i + n]
            if (n == 1 and gram != " ") or (n == 2 and gram != "  ") or (n > 2 and " " not in gram[1:-1]):
                h = (n + sum(ord(c) * int(v) for c, v in zip(gram, NGRAM_VALUES))) % (1 << 64)
                rows.append(int(B.mix(B.np.array([h], dtype=B.U64))[0]) % BUCKETS)
    z = [(sum(float(model.table[r, k]) for r in rows) / len(rows) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_against_plain_softmax(spark):
    data = list(rows(200))
    model = fit([r[1] for r in data], [r[2] for r in data])
    texts = ["hij klm abc", "é à ç", "Abc123 def-gh", "a", *(r[1] for r in data[:20])]
    got = model.probabilities(texts)
    for p, t in zip(got, texts):
        assert max(abs(x - y) for x, y in zip(p, plain_probabilities(model, t))) < 1e-6
    ids = spark.createDataFrame([(i,) for i in [*range(50), -3, 10**12]], "doc_id long")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in ids.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect())


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 50)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    same = [(7, "abc def", "aa")] * 3000 + [(None, f"hij {i}", "bb") for i in range(2000)] + [(i, "x", f"l{i}") for i in range(300)]
    got = training_sample(spark.createDataFrame(same, "doc_id long, text string, lang string"), F.lit(True)).groupBy("lang").count().collect()
    assert {r.lang for r in got} <= {"aa", "bb"} and all(r["count"] <= 50 * SEGMENTS for r in got) and DOCS_PER_LANGUAGE >= 50
    assert {r.lang: r["count"] for r in got}["bb"] > 20 * SEGMENTS


def test_long_texts_in_pieces():
    """The mean over pieces is that over the whole text, wherever the cuts fall."""
    rng = np.random.default_rng(2)
    table = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(("a", "b", "c"), table, np.zeros(3), 1.0, 0.0)
    text = "".join(rng.choice(list("abcdé ñ.日İΣ"), 3 * langid.LONG + 17))
    idx, bounds = langid.subwords([text])
    assert np.allclose(model._long_mean(text), langid._means(table, idx, bounds), atol=1e-9)
    assert np.allclose(model.probabilities([text]), langid.softmax(langid._means(table, idx, bounds)), atol=1e-9)
    assert model._long_mean("1" * (langid.LONG + 1)).tolist() == [[0.0] * 3]
