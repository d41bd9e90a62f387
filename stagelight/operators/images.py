"""Mirrored images: what is expired, orphaned or protected, and what a clean-up leaves."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.functions.dates import literal
from stagelight.operators.ranking import union_by_precedence

RETENTION_DAYS = 14


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of stored objects; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"))


def cutoff(now: datetime, days: int = RETENTION_DAYS) -> datetime:
    return now - timedelta(days=days)


def referenced_paths(source_gigs: DataFrame, gigs: DataFrame) -> DataFrame:
    """(path, last): the latest start of the gigs that use a path."""
    g = gigs.select(F.col("id").alias("gig_id"), "starts_at")
    rows = source_gigs.where("mirrored_image_path is not null").join(g, "gig_id")
    return rows.groupBy(F.col("mirrored_image_path").alias("path")).agg(F.max("starts_at").alias("last"))


def cleanup_candidates(objects: DataFrame, source_gigs: DataFrame, gigs: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """(path, bytes, kind): expired (all users started before the cutoff) or orphaned (no user); expired goes first.
    A path that any newer gig uses is protected."""
    used = referenced_paths(source_gigs, gigs)
    old = used.where(F.col("last") < literal(cutoff(now, days))).join(objects, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit("expired").alias("kind"))
    loose = objects.join(source_gigs.select(F.col("mirrored_image_path").alias("path")), "path", "left_anti").select("path", "bytes", F.lit("orphaned").alias("kind"))
    return union_by_precedence([old, loose], ["path"], [F.col("path")]).orderBy("path")


def cleanup_summary(candidates: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row of counts and bytes. Without `deleted` (path), it is a dry run: all are skipped."""
    done = candidates.withColumn("ok", F.lit(False)) if deleted is None else candidates.join(deleted.select("path").distinct().withColumn("ok", F.lit(True)), "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    of = lambda cond, name: [F.count_if(cond).alias(f"{name}_objects"), F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0)).alias(f"{name}_bytes")]
    failed = F.lit(deleted is not None) & ~F.col("ok")
    return done.agg(*of(F.col("kind") == "expired", "expired"), *of(F.col("kind") == "orphaned", "orphaned"), *of(F.lit(True), "selected"), *of(F.col("ok"), "deleted"), F.count_if(failed).alias("failed_objects"), F.lit(deleted is None).alias("dry_run"))


def clear_references(source_gigs: DataFrame, candidates: DataFrame, deleted: DataFrame) -> DataFrame:
    """source_gigs whose deleted, expired images are taken out."""
    gone = candidates.where("kind = 'expired'").join(deleted.select("path"), "path", "left_semi").select(F.col("path").alias("mirrored_image_path")).withColumn("_gone", F.lit(True))
    cleared = {"mirrored_image_path": "string", "mirrored_image_width": "int", "mirrored_image_height": "int", "image_mirrored_at": "timestamp"}
    # Rows without an image are dealt by their id: the null of all of them would be one key.
    deal = F.when(F.col("mirrored_image_path").isNull(), F.xxhash64("id"))
    rows = source_gigs.withColumn("_key", F.coalesce("mirrored_image_path", F.concat(F.lit("\0"), deal.cast("string")))).join(gone.withColumnRenamed("mirrored_image_path", "_key"), "_key", "left")
    out: list[Column] = []
    for c in source_gigs.columns:
        if c in cleared:
            out.append(F.when(F.col("_gone").isNull(), F.col(c)).alias(c))
        elif c == "image_mirror_status":
            out.append(F.when(F.col("_gone"), "missing").otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def apply_mirror_results(source_gigs: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """results: id, ok, path, width, height. Ready or failed; a failed row keeps the path it has."""
    r = results.select("id", "ok", F.col("path").alias("_p"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    new = {"mirrored_image_path": "_p", "mirrored_image_width": "_w", "mirrored_image_height": "_h"}
    out = [F.when(F.col("ok"), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.when(F.col("ok"), "ready").when(~F.col("ok"), "failed").otherwise(F.col(c)).alias(c) if c == "image_mirror_status" else F.when(F.col("ok"), literal(now)).otherwise(F.col(c)).alias(c) if c == "image_mirrored_at" else F.col(c) for c in source_gigs.columns]
    return source_gigs.join(r, "id", "left").select(*out)


def request_metrics(requests: DataFrame) -> DataFrame:
    """host, requests, errors, mean milliseconds to the header, and a map of status classes. requests: host, status, header_ms."""
    by_class = requests.groupBy("host", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("class")).agg(F.count("*").alias("n"), F.sum("header_ms").alias("ms"), F.count_if(F.col("status").isNull() | (F.col("status") >= 400)).alias("errors"))
    return by_class.groupBy("host").agg(F.sum("n").alias("requests"), F.sum("errors").alias("errors"), (F.sum("ms") / F.sum("n")).alias("header_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("class", F.lit("none")), "n")))).alias("classes"))
