"""Operator 12 against SQL and brute force."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from stagelight.llm import decontaminate as D
from stagelight.llm.decontaminate import ORACLE_SQL, decontaminate, op12_decontamination, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - k + 1, 1) if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (of := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    ids |= {x for x in of if x is not None}
        out.append((i, len(w), len(hit), tuple(sorted(map(str, ids)))))
    return Counter(out)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "É", "ÉÉ", "x1", "Zz", "日本", "İx"])
    text = lambda n: "".join(word() + rng.choice([" ", "-", "\n", "_ ", ", "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25, 40]) if i > 8 else 30)) for i in range(25)] + [(None, text(14)), (3, text(12)), (77, None), (78, "?!")]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(len(w) - 12, 0))
            parts += [" ".join(w[a : a + rng.randint(8, 30)]).upper(), text(rng.randint(0, 6))]
        docs.append((i, " ; ".join(parts)))
    return docs + [(None, docs[3][1]), (5, docs[5][1]), (900, None), (901, ""), (902, " \n"), (903, "é" * 5000 + " a")], items


def write(spark, tmp_path, docs, items):
    spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, row string, token int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string").write.parquet(str(tmp_path / "benchmark.parquet"))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql_and_brute_force(spark, tmp_path, seed):
    docs, items = fixture(seed)
    write(spark, tmp_path, docs, items)
    got = decontaminate(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute(docs, items)
    assert any(r.n_items > 2 for r in got) and any(not r.contaminated and r.n_words for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    con.execute("CREATE OR REPLACE VIEW benchmark AS SELECT * FROM read_parquet('" + str(tmp_path) + "/benchmark.parquet/*.parquet') WHERE item_id IS NOT NULL")
    want = con.execute(ORACLE_SQL["op12_decontamination"]).fetchall()
    write(spark, tmp_path / "known", docs, [x for x in items if x[0] is not None])
    assert Counter(map(tuple, op12_decontamination(spark, str(tmp_path / "known")).collect())) == Counter(want)


def test_pieces_of_long_texts(spark, tmp_path, monkeypatch):
    """A text cut in pieces has the same words, and the same hits across the cuts."""
    monkeypatch.setattr(D, "PIECE", 64)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "c", "dé", "x" * 90]) for _ in range(n)) for n in (0, 1, 30, 400)]
    for margin in (1, 10):
        for t in texts:
            found = [(int(n), bytes(w.data[s:e]).decode()) for w in words_of(pa.array([t]), margin) for n, s, e, own in zip(w.number, w.start, w.end, w.own) if own]
            assert found == list(enumerate(words(t)))
    monkeypatch.setattr(D.B, "BLOCK_BYTES", 64)
    docs, items = fixture(6)
    docs = [(i, t) for i, t in docs if t and len(t) > 100][:30]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name, t in zip("di", tables):
        t.coalesce(1).write.parquet(str(tmp_path / name))
    columns = [pa.array([t for _, t in docs])]
    assert sum(int(w.own.sum()) for w in words_of(columns[0], 10)) == sum(len(words(t)) for _, t in docs)


def test_empty_tables(spark, tmp_path):
    docs, items = fixture(1)
    for name, d, i in (("a", [], items), ("b", docs, []), ("c", [], [])):
        write(spark, tmp_path / name, d, i)
        got = op12_decontamination(spark, str(tmp_path / name)).collect()
        assert len(got) == len(d) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
