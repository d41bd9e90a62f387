"""Operator 4 against brute force."""

import numpy as np
import pytest

from stagelight.llm import embeddings
from stagelight.llm.embeddings import bucket_keys, near_vectors, parameters


def data(seed, n=700, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 10, d))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.2, 0.35], size=(n, 1))
    x[5:60] = base[0] + 0.05 * rng.normal(size=(55, d))  # a dense group
    x[60:90] = x[3]  # copies
    x[90:95] = 7 * x[4]
    rows = [(i, [float(np.float32(v)) for v in r], i % 3) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1)]
    rows += [(2000 + i, v, 0) for i, v in enumerate(bad)] + [(2000 + i, v, 0) for i, v in enumerate(bad[1:3])]
    rows += [(7, rows[8][1], 1), (None, rows[9][1], 1), (3000, [1.0, 2.0], 1), (3001, [2.0, 4.0], 1), (None, [5.0, -1.0, 2.0], 1)]
    return rows


def truth(rows):
    ok = [v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v) for _, v, _ in rows]
    links = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, v, _) in enumerate(rows):
        for j, (_, w, _) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                links[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    rows = data(seed)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "v"))
    got = near_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()
    assert len(got) == len(rows)
    links = truth(rows)
    want = dict()
    for i, r in enumerate(rows):
        want.setdefault(r[0], []).append(int(links[i].sum()))
    have = dict()
    for r in got:
        have.setdefault(r.vec_id, []).append(r.n_links)
    exact = sum(sorted(have[k]) == sorted(v) for k, v in want.items())
    assert sum(map(sum, have.values())) >= 0.99 * links.sum() and exact > 0.97 * len(want)
    assert all(sum(have[k]) <= sum(v) for k, v in want.items())
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[label[i]] = min(low.get(label[i], r[0]), r[0])
    unique = [i for i, r in enumerate(rows) if len(want[r[0]]) == 1]
    comp = {r.vec_id: (r.component_id, r.kept) for r in got}
    assert sum(comp[rows[i][0]] == (low[label[i]], rows[i][0] == low[label[i]]) for i in unique) > 0.97 * len(unique)
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is not None and 2000 <= r.vec_id < 2006)


def test_blocks(spark, tmp_path, monkeypatch):
    """A bucket cut into many blocks counts each link once."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(100, 16))
    spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    got = near_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_recall_of_the_index():
    rng = np.random.default_rng(4)
    n, d = 3000, 64
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=(n, d))
    o -= (o * a).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(0.19) * o / np.linalg.norm(o, axis=1)[:, None]
    for rows in (2_000, 100_000, 10_000_000):
        k, t = parameters(rows, d)
        x, y = bucket_keys(a, k, t), bucket_keys(b, k, t)
        found = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
        assert found > 0.985, (rows, k, t, found)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert near_vectors(spark.read.parquet(str(tmp_path / "v"))).count() == 0
