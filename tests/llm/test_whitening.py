"""Operator 13 against dense linear algebra."""

import numpy as np
import pytest

from stagelight.llm.whitening import jacobi, op13_embedding_whitening, whiten


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 33):
        a = rng.normal(size=(d, 2 * d))
        scale = 10.0 ** np.linspace(0, -7, d)
        a = scale[:, None] * (a @ a.T) * scale
        e, v = jacobi(a)
        assert (np.diff(e) <= 0).all() and np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(v * e @ v.T, a, rtol=0, atol=1e-13 * e[0])
        inverse = np.sort(1 / np.linalg.eigvalsh(np.linalg.inv(a / np.outer(scale, scale))))  # well scaled, as a yardstick of positivity
        assert (inverse > 0).all() and abs(np.log(e).sum() - np.linalg.slogdet(a / np.outer(scale, scale))[1] - 2 * np.log(scale).sum()) < 1e-9
    for a in (np.zeros((4, 4)), np.ones((5, 5)), np.diag([3.0, 3.0, 1.0]), np.empty((0, 0))):
        e, v = jacobi(a)
        assert np.allclose(v * e @ v.T, a, atol=1e-12)


def contract(rows):
    ok = [(i, v) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in ok], n, [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], y @ v / np.sqrt(e), e / e.sum()


@pytest.mark.parametrize("d", [5, 40])
def test_query_against_eigh(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(400, d)) @ (np.diag(np.linspace(3, 0.4, d)) + 0.1 * rng.normal(size=(d, d)))
    x[10:40] = x[9]
    rows = [(i if i != 7 else 6, [float(v) for v in r], "s") for i, r in enumerate(x)] + [(None, [float(v) for v in x[3]], None)]
    bad = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("-inf")] + [0.0] * (d - 1)]
    rows += [(1000 + i, v, "s") for i, v in enumerate(bad)] + [(2000, [1.0, 2.0], "s")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op13_embedding_whitening(spark, str(tmp_path)).collect()
    ids, n, deviation, white, explained = contract(rows[:-1])
    k = min(d, 32)
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert sorted((r.vec_id or -1, r.deviation) for r in got if r.component == 1) == sorted((i or -1, s) for i, s in zip(ids, deviation))
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        theirs = np.array([white[j, c - 1] for j, i in enumerate(ids) if i != 6 and i is not None])
        ours = np.array([by[i, c].whitened for i in ids if i != 6 and i is not None])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7
        assert by[0, c].explained == pytest.approx(explained[c - 1], rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_edges(spark, tmp_path):
    """Empty table, a single vector, constant and dependent dimensions, other columns of clashing names."""
    schema = "vec_id long, embedding array<float>, part int, i string, x string"
    for name, rows, components in (("none", [], 0), ("one", [(1, [1.0, 2.0], 1, "a", "b")], 0), ("flat", [(i, [float(i), 2.0, 2.0 * i], 1, "a", None) for i in range(50)], 1)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = op13_embedding_whitening(spark, str(tmp_path / name)).collect()
        assert len(got) == components * len(rows)
        assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in got)
        white, fitted, error = whiten(spark.read.parquet(str(tmp_path / name / "embeddings.parquet")), "embedding", to="x")
        assert white.count() == len(rows) and white.columns == ["vec_id", "embedding", "part", "i", "x"] and error < 1e-9
        assert all(len(r.x) == components for r in white.collect())


def test_real_entries_with_a_large_offset(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = 1e7 + rng.normal(size=(300, 4)) * [1, 0.1, 0.01, 0.001]
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "e"))
    _, fitted, error = whiten(spark.read.parquet(str(tmp_path / "e")), "embedding", 4)
    y = x - 1e7
    y = y - y.mean(axis=0)
    assert np.allclose(fitted.values, np.linalg.eigvalsh(y.T @ y / len(y))[::-1], rtol=1e-6) and error < 1e-9
