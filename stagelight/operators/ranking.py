"""Top rows, keepers, ordered lists, counts: the relational shapes that the rest is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; `order` should be total, so that reruns agree. Skew is bounded by the window's
    group limit, which cuts each partition to one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_by_max(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """As best_row by the largest rank, as an aggregate with map-side combining."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*rank)).alias("_best"))
    return picked.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in columns))


def ordered_list(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(*keys).agg(F.transform(items, lambda x: x[value]).alias(out))


def renumber(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def unique_or_null(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value of each key; null where a key has two different ones."""
    return rows.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias(value))


def last_per_key(rows: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str]) -> DataFrame:
    return best_by_max(rows, keys, [F.col(ordinal)], columns)


def first_position_last_value(rows: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(ordinal).alias(ordinal), F.max_by(F.struct(*columns), ordinal).alias("_last")).select(*keys, ordinal, *(F.col(f"_last.{c}").alias(c) for c in columns))


def union_by_precedence(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of all parts, for each key those of the earliest part, best first."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p)
    return best_row(every, keys, [F.col("_part"), *order]).drop("_part")


def examples(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, n: int, out: str = "examples") -> DataFrame:
    """Count and first n examples of each key, cut before the shuffle's end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rows.withColumn("_value", value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    listed = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_value"))), lambda x: x["_value"]).alias(out))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(listed, list(keys), "left")


def neighbours(days: DataFrame, key: str) -> DataFrame:
    """Previous and next day of each distinct day. Days are few, so one window over all of them is meant."""
    w = Window.orderBy(key)
    return days.select(key).distinct().withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def islands(days: DataFrame, key: str, loaded: Column, by: Sequence[str] = ()) -> DataFrame:
    """Runs of loaded days that follow each other among all days, of each group `by`: (by, island, first, last, n)."""
    order = Window.partitionBy(*by).orderBy(key)
    all_days = days.withColumn("_rn", F.row_number().over(order))
    own = all_days.where(loaded).withColumn("_i", F.col("_rn") - F.row_number().over(order))
    return own.groupBy(*by, F.col("_i").alias("island")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def distinct_urls_per_day(rows: DataFrame, day: str, order: Sequence[str], url: str, n: int) -> DataFrame:
    """The first n URLs of each day; a URL of an earlier day doesn't count again."""
    firsts = best_row(rows.where(F.col(url).isNotNull()), [url], [F.col(day), *(F.col(o) for o in order)])
    w = Window.partitionBy(day).orderBy(*order)
    return firsts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(day, "position", url)
