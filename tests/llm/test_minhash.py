"""Operator 8 and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stagelight.llm import minhash
from stagelight.llm.minhash import drop_near_duplicates, near_duplicates
from stagelight.llm.common import Scratch
from stagelight.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = []
    for r in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(parent, i)] = find(parent, j)
    low = {}
    for i, r in enumerate(rows):
        root = find(parent, i)
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    out = Counter()
    for i, r in enumerate(rows):
        c = low.get(find(parent, i))
        out[(r[0], len(sets[i]), c, r[0] == c)] += 1
    return out


def near_texts(seed, groups=25):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = ["".join(rng.choice("abcdE") for _ in range(4)) for _ in range(rng.choice([3, 4, 5, 40, 80]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["Xx", "yy", "z"])
            rows.append((1000 - i, " ".join(words), "s", 1))
            i += 1
    return rows


@pytest.mark.parametrize("bucket", [1024, 3])
def test_against_brute_force(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "BLOCK", min(bucket, 2048))
    rows = near_texts(bucket)
    rows += [(rows[0][0], rows[0][1], "t", 1), (None, rows[5][1], "t", 1), (None, "alone and without number here", "t", 1), (5, None, "t", 1), (6, "", "t", 1), (7, " \n", "t", 1), (8, "Word", "t", 1), (9, "wORD", "t", 1), (10, "word " * 3000, "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, cls string, low long").repartition(3).write.parquet(str(tmp_path / "d"))
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_one_row_of_each_component_stays(spark, tmp_path):
    rows = near_texts(9) + [(50, "a b c d e f g", "x", 1), (50, "a b c d e f g", "y", 1), (51, None, "z", 1), (51, None, "z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, low long").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in out.collect())
    want = {r[0] for r in brute(rows) if r[3]}
    assert set(kept) == want and kept.pop(51) == 2 and set(kept.values()) == {1}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for common in (300, 375, 450):
        est = []
        for _ in range(40):
            pool = rng.integers(1, 1 << 62, 1000 - common, dtype=np.uint64)
            own = (1000 - 2 * common) // 2
            a, b = np.sort(pool[: common + own]), np.sort(np.concatenate([pool[:common], pool[common + own :]]))
            truth = common / len(pool)
            sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))[1]
            est.append(float(minhash.estimate(sig[0], sig[1])))
        assert abs(np.mean(est) - truth) < 0.02 and np.std(est) < 0.06


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (200, 201), (201, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    left, right = np.arange(0, 50), np.arange(30, 80)
    want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left])
    assert (minhash.common_counts(sets, left, right) == want).all()


def test_long_words_that_differ(spark, tmp_path):
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba")))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "tm"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.read.parquet(str(tmp_path / "tm"))).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True)}


def test_columns_stay_whatever_their_names(spark, tmp_path):
    rows = [(1, "a b c d e f", 7, "x", 0), (2, "a b c d e f", 8, "y", 0), (3, None, 9, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, _row int, cls string, __row int").coalesce(1).write.parquet(str(tmp_path / "c"))
    out = drop_near_duplicates(spark.read.parquet(str(tmp_path / "c")))
    assert out.columns == ["doc_id", "text", "_row", "cls", "__row"]
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]
