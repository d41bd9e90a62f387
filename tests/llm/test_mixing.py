"""Operator 9 against its SQL, and the rates it reaches."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stagelight.llm.mixing import inverse_poisson, mix_sources, mixing_sql, poisson_count


def test_inverse_is_the_quantile_function(spark):
    import math

    rows = [(u / 97, mean) for u in range(1, 97, 5) for mean in (0.0, 0.3, 1.0, 7.5, 120.0)]
    got = spark.createDataFrame(rows, "u double, mean double").withColumn("k", inverse_poisson(F.col("u"), F.col("mean"))).collect()
    for r in got:
        k, p, c = 0, math.exp(-r.mean), math.exp(-r.mean)
        while r.u > c:
            k += 1
            p *= r.mean / k
            c += p
        assert r.k == k


def test_against_sql_with_edges(spark, tmp_path):
    rows = [(i, "x" * (i % 50), ["a", "b", None, "c"][i % 4], i) for i in range(2000)]
    rows += [(7, "x" * 7, "c", 1), (None, None, "d", 2), (None, "", "a", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _copy long").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    weights = {"a": 4.0, "c": 0.0, "d": 0.001}
    got = Counter((r.doc_id, r.text, r.source, r.copy_no) for r in mix_sources(docs, weights, epochs=1.5, seed=4).collect())
    con = duckdb.connect()
    sql = mixing_sql(f"'{tmp_path}/d/*.parquet'", weights, 4).replace("SELECT source, total * weight", "SELECT source, 1.5 * total * weight")
    assert got == Counter(con.sql(f"SELECT doc_id, text, source, copy_no FROM ({sql})").fetchall())
    chars = Counter()
    for (_, text, source, _), n in got.items():
        chars[source] += n * len(text or "")
    assert chars["c"] == 0 and 3.4 < chars["a"] / chars["b"] < 4.6
    assert mix_sources(docs, weights, copy_column=None).columns == docs.columns
    assert mix_sources(docs.limit(0), weights).count() == 0


def test_large_means_and_bad_weights(spark):
    got = spark.range(300).select(poisson_count(1, F.col("id"), F.lit(2000.0)).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(got[0] - 2000) < 12 and 36 < got[1] < 54
    with pytest.raises(ValueError):
        mix_sources(spark.range(1), {"a": -1.0})


def test_order_is_spread(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("hot").alias("source")).write.parquet(str(tmp_path / "d"))
    out = mix_sources(spark.read.parquet(str(tmp_path / "d")), {}).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    ids = [r.doc_id for r in out]
    up = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 0.4 < up / len(ids) < 0.6


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "abc", "s", 5, "r", 1.5, 2, 3) for i in range(20)], "doc_id long, text string, source string, _mix_times int, _mix_source string, _mix_rate double, _mix_copy int, _mix_place long")
    out = mix_sources(docs, {"s": 2.0}, epochs=2.0, seed=3)
    assert out.columns == [*docs.columns, "copy_no"]
    rows = out.collect()
    assert rows and {(r._mix_times, r._mix_source, r._mix_rate, r._mix_copy, r._mix_place) for r in rows} == {(5, "r", 1.5, 2, 3)}
    assert mix_sources(docs.limit(0), {"s": 2.0}, seed=3).count() == 0
