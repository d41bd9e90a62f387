"""How rows are dealt over tasks, and where the optimiser stops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of a core, when rows that take long are dealt.
TASKS_PER_CORE = 8
#: Rows that a written table may have to be broadcast.
FEW_ROWS = 20_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by a hash of keys over all cores: a file of a few megabytes is one task otherwise, however many rows it
    has and however long a row takes."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def apart(rows: DataFrame) -> DataFrame:
    """rows, with a border that expressions don't cross: the optimiser would copy long chains of them into each other."""
    return rows.mapInArrow(lambda batches: batches, rows.schema)


def shared(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys, the same exchange in all branches that read them: no branch's columns get beneath the border, so
    Spark reuses it and works the rows out once."""
    return apart(spread(rows, *keys))


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the folder that all executors share: steps that read it plan and work by themselves, and know its size."""
    spark = rows.sparkSession
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (made.get() if made.isDefined() else None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='stagelight-')}"
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """rows for a join that deals both sides by its keys at every size: Spark goes by the size of files, of which repeated
    values are a small part of what they take in memory, and would broadcast rows that the driver can't hold."""
    return rows.hint("merge")


def beside(table: DataFrame) -> DataFrame:
    """A written table for the smaller side of a join: broadcast as long as its rows, which are counted, are few."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else dealt(table)
