"""Operator 11 against brute force, and its tree against plain inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stagelight.llm import negatives
from stagelight.llm.negatives import NONE, ORACLE_SQL, BallTree, mine_hard_negatives, op11_hard_negatives


@pytest.mark.parametrize("size", [3, 60, 2000])
def test_tree_against_all_rows(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-40, 40, (size, 6)).astype(np.int32)
    x[size // 2 :: 3] = x[0]  # ties
    row, key, label = np.arange(size) + 5, rng.permutation(size) // 2, rng.integers(0, 4, size)
    tree = BallTree(row, key, label, x)
    asked = rng.integers(0, size, 50)
    low = rng.integers(-4000, 1000, 50)
    high = low + rng.integers(0, 4000, 50)
    order = np.lexsort((row, key))
    for same in (True, False):
        score, rank = tree.search(row[asked], label[asked], x[asked], low, high, 3, same)
        for q, a in enumerate(asked):
            all_scores = x.astype(np.int64) @ x[a]
            fits = [(-int(all_scores[i]), r) for r, i in enumerate(order) if (label[i] == label[a]) == same and i != a and low[q] <= all_scores[i] <= high[q]]
            want = sorted(fits)[:3]
            assert [(-int(s), int(r)) for s, r in zip(score[q], rank[q]) if s != NONE] == want


def test_pruning_skips_nodes(monkeypatch):
    """On clustered rows most leaves stay shut."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 8)) * 200
    x = (middle[np.repeat(np.arange(40), 200)] + rng.normal(size=(8000, 8)) * 4).astype(np.int32)
    tree = BallTree(np.arange(8000), np.arange(8000), np.zeros(8000, dtype=np.int64), x)
    seen = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at.stop - at.start)
            return np.asarray(super().__getitem__(at))

    tree.x = tree.x.view(Spy)
    tree.search(np.arange(20), np.zeros(20, dtype=np.int64), x[:20], np.full(20, NONE + 1), np.full(20, -NONE), 5, True)
    assert 0 < sum(seen) < 2000


def rows_of(seed, n=420, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(15, d))
    x = base[rng.integers(0, 15, n)] + 0.4 * rng.normal(size=(n, d))
    x[100:180] = x[100]  # a hot vector
    label = rng.integers(0, 10, n)
    label[200:330] = 3
    rows = [(int(i), [float(np.float32(v)) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))]
    bad = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    return rows + [(1000 + 50 * i, v, 1) for i, v in enumerate(bad)] + [(2000, [0.5] * d, None), (2050, [0.0] * d, 2), (None, [0.3] * d, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_sql(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(negatives, "TREE_ROWS", 50)
    monkeypatch.setattr(negatives, "LEAF", 8)
    path = tmp_path / "embeddings.parquet"
    spark.createDataFrame(rows_of(seed), "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(path))
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op11_hard_negatives"]).fetchall())
    assert len(got) > 60 and got == want


def test_edges(spark, tmp_path):
    """Repeated and null ids, other lengths, negative scores, clashing columns, no rows, exact scores of large entries."""
    big = 1 << 24
    rows = [(50, 1, [3, 4], 0), (50, 1, [3, 4], 1), (1, 1, [1, 1], 2), (None, 2, [2, 2], 3), (2, 2, [2, 2], 4), (100, 1, [5], 5), (101, 1, [7], 6), (102, 2, [3], 7), (150, 8, [-1, 0, 0], 8), (151, 8, [1, 0, 0], 9), (152, 9, [1, 0, 0], 10)]
    rows += [(200, 5, [big, 1, 0, 1], 11), (201, 5, [big, 1, 0, 1], 12), (202, 6, [big - (big >> 3), 1, 1, 1], 13)]
    spark.createDataFrame([(i, y, x, n, n, "k") for i, y, x, n in rows], "vec_id long, label int, x array<int>, row int, tree int, kind string").coalesce(1).write.parquet(str(tmp_path / "v"))
    got = sorted((tuple(r) for r in mine_hard_negatives(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0).collect()), key=str)
    want = [(50, 50, 1, 2, 25, 14), (50, 50, 2, None, 25, 14)] * 2 + [(200, 201, 1, 202, big * big + 2, big * (big - (big >> 3)) + 2)]
    assert got == sorted(want, key=str)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11_hard_negatives(spark, str(tmp_path)).count() == 0

