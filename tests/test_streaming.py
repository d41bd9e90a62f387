"""Versions of tables, and runs that come in several micro-batches."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stagelight.operators.versions import Versions
from stagelight.schema import NORMALISED
from stagelight.streaming.incremental import resolve_batches
from tests.test_resolve import listing, tables

NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)


def test_a_failed_write_leaves_no_trace(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    assert store.versions() == [] and store.read() == {}
    one = spark.range(3).withColumn("x", F.lit("a"))
    store.write({"a": one, "b": spark.createDataFrame([], "k string, at timestamp")}, 1)
    old = store.read()
    assert old["b"].count() == 0 and old["b"].dtypes == [("k", "string"), ("at", "timestamp")]
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"), F.lit("z").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.write({"a": spark.range(9).withColumn("x", F.lit("b")), "b": broken}, 2)
    assert store.versions() == [1] and store.read()["a"].count() == 3
    store.write({"a": spark.range(5).withColumn("x", F.lit("c"))}, 2)
    assert old["a"].count() == 3 and store.read()["a"].count() == 5 and store.read(before=2)["a"].count() == 3 and set(store.read()) == {"a"}
    store.write({"a": spark.range(7).withColumn("x", F.lit("d"))}, 2)  # again
    store.forget(keep=1)
    assert store.versions() == [2] and store.read()["a"].count() == 7 and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_pruning_waits_for_the_end_of_a_run(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    store = Versions(spark, str(tmp_path / "t"))
    store.write(tables(spark), 0)
    work = resolve_batches(store, lambda: NOW)
    schema = NORMALISED + ", ordinal int, run_id string, run_ended boolean"
    end = lambda source, run: (source, *[None] * 15, None, run, True)
    rows = lambda run, *items: spark.createDataFrame([(*x, i, run, None) if len(x) == 16 else x for i, x in enumerate(items)], schema)
    titles = lambda: sorted(r.title for r in store.read()["gigs"].collect())
    work(rows("r1", listing("lo", "One", "1"), listing("nobody", "Stray", "9")), 0)
    work(rows("r1", listing("lo", "Two", "2"), end("lo", "r1")), 1)
    assert titles() == ["One", "Two"] and store.read()["run_listings"].count() == 0
    assert [(r.source_slug, r.title, r.batch_id, r.error) for r in store.read()["rejected_listings"].collect()] == [("nobody", "Stray", 0, "unknown source")]
    work(rows("r2", listing("lo", "Two", "2")), 2)
    assert titles() == ["One", "Two"]
    work(rows("r2", listing("lo", "Three", "3")), 3)
    work(rows("r2", end("lo", "r2")), 4)
    assert titles() == ["Three", "Two"] and store.read()["run_listings"].count() == 0
    work(rows("r2", end("lo", "r2")), 4)  # a batch run again
    assert titles() == ["Three", "Two"] and store.versions() == [0, 1, 2, 3, 4, 5]
