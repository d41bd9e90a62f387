"""Snapshot merges: tables are new versions of old ones, as Parquet has no update."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each key with `change`: insert, update, unchanged or absent (not in new)."""
    o = old.select(*keys, F.struct(*columns).alias("_old"))
    n = new.select(*keys, F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "absent").when(F.equal_null("_old", "_new"), "unchanged").otherwise("update")
    return o.join(n, list(keys), "full").select(*keys, "_old", "_new", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Column] | None = None, now: Column | None = None) -> DataFrame:
    """old with new's rows put in by key. A rule gives a column from `old.*` and `new.*`; other columns of new
    overwrite, also with null; columns that new lacks stay. With `now`, updated_at changes where something else did."""
    rules = dict(rules or {})
    o, n = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    has_new, has_old = F.col("new._in").isNotNull(), F.col("old._in").isNotNull()
    o, n = old.withColumn("_in", F.lit(1)).alias("old"), new.withColumn("_in", F.lit(1)).alias("new")
    out, changed = [], ~has_old
    for c in old.columns:
        if c == "updated_at" and now is not None:
            continue
        incoming = rules.get(c, F.col(f"new.{c}") if c in new.columns else None)
        value = F.col(f"old.{c}") if incoming is None else F.when(has_new, incoming).otherwise(F.col(f"old.{c}"))
        if c in keys:
            value = F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}"))
        out.append(value.alias(c))
        if incoming is not None and c not in keys:
            changed = changed | (has_new & ~F.equal_null(incoming, F.col(f"old.{c}")))
    if "updated_at" in old.columns and now is not None:
        out.append(F.when(changed, now).otherwise(F.col("old.updated_at")).alias("updated_at"))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return o.join(n, condition, "full").select(*out)


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the groups that new has, and new's rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old, list(keys), "left_anti"))


def repoint(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with `column` moved along mapping (from_id, to_id)."""
    m = mapping.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def delete_unreferenced(rows: DataFrame, key: str, candidates: DataFrame, references: DataFrame, column: str) -> DataFrame:
    """rows without the candidates that no reference names."""
    loose = candidates.select(F.col(candidates.columns[0]).alias(key)).join(references.select(F.col(column).alias(key)), key, "left_anti")
    return rows.join(loose, key, "left_anti")


def publish(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its path; readers switch when they are told it."""
    import uuid

    version = f"{path.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.parquet(version)
    return version
