"""Helpers shared by the training-data operators: shared scratch tables, row keys, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its rows take at most this many bytes in memory; beyond it the join shuffles.
BROADCAST_BYTES = 6 << 20
#: Bytes that a row takes in a broadcast relation besides its texts: its own fields, its key and its pointers.
ROW_BYTES = 80
#: A key is heavy if it may fill more than one in MOST_HEAVY rows, and LEAST_HEAVY rows at least.
MOST_HEAVY, LEAST_HEAVY = 1000, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='stagelight-')}"  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Written intermediate tables in the shared folder; they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def _fs(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def size(self, table: str) -> int:
        """Bytes of a written table."""
        fs, path = self._fs(table)
        return fs.getContentSummary(path).getLength()

    def drop(self, table: str) -> None:
        fs, path = self._fs(table)
        fs.delete(path, True)

    def keep_only(self, *tables: str) -> None:
        """Drops all other written tables; to be called once nothing lazy reads them."""
        fs, root = self._fs("")
        for status in fs.listStatus(root):
            if status.getPath().getName() not in tables:
                fs.delete(status.getPath(), True)

    def small(self, df: DataFrame, table: str) -> DataFrame:
        """df with a broadcast hint if its written table takes at most BROADCAST_BYTES in memory, as counted over its
        rows and the lengths of its texts, else df for a shuffled join."""
        if self.size(table) > BROADCAST_BYTES:
            return df
        rows = self.spark.read.parquet(self.path(table))
        texts = [F.sum(F.length(name)) for name, kind in rows.dtypes if kind in ("string", "binary")]
        n, *lengths = rows.agg(F.count("*"), *texts).first()
        return F.broadcast(df) if ROW_BYTES * n + sum(x or 0 for x in lengths) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row, equal each time the same scan is run: ids of input rows may repeat or be null.

    df has to be a scan or a written table, whose partitions hold the same rows in the same order each time.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def heavy_keys(rows: DataFrame, column: str) -> list[int]:
    """Values of a column of longs that may each fill more than one in MOST_HEAVY rows, so MOST_HEAVY values at most.

    A mergeable sketch of frequent items finds them; it misses none above its error, a third of that share. Callers
    treat heavy keys another way, with the same result for any key, so an estimate is good enough.
    """
    n, top = rows.agg(F.count("*"), F.expr(f"approx_top_k({column}, {MOST_HEAVY}, {10 * MOST_HEAVY})")).first()
    return [x[0] for x in top or [] if x[0] is not None and x[1] > max(n / MOST_HEAVY, LEAST_HEAVY)]


def split_semi_join(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is in `wanted` (distinct keys). Rows of heavy keys are joined by broadcast of these keys alone,
    so no task gets them all. on[0]: a long that tells keys apart, such as a hash."""
    heavy = heavy_keys(rows, on[0])
    if not heavy:
        return rows.join(wanted, on, "left_semi")
    is_heavy = F.col(on[0]).isin(heavy)
    return rows.where(is_heavy).join(F.broadcast(wanted.where(is_heavy)), on, "left_semi").unionByName(rows.where(~is_heavy).join(wanted.where(~is_heavy), on, "left_semi"))
