"""Run logs, audit history, stored payloads, and helpers of pages that follow a day or a filter."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.functions.dates import literal
from stagelight.functions.text import let
from stagelight.plans.audit import verdict

RECENT = 5
RESULTS = ("pass", "warning", "fail")


def start_run(spark: SparkSession, source_id: str, now: datetime) -> DataFrame:
    """A running row of scrape_runs; its id is a digest of source and start."""
    row = spark.range(1).select(F.lit(source_id).alias("source_id"), literal(now).alias("started_at"))
    return row.select(F.sha2(F.concat_ws("|", "source_id", F.col("started_at").cast("string")), 256).alias("id"), "source_id", F.lit("running").alias("status"), "started_at")


def finish_runs(runs: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """runs with their counts, status and end. outcomes: source_id, discovered, inserted, updated, failed, error."""
    o = outcomes.select("source_id", *(F.col(c).alias(f"{c}_count") for c in ("discovered", "inserted", "updated", "failed")), F.col("error").alias("error_message"))
    failed, some = F.col("failed_count") > 0, (F.col("inserted_count") + F.col("updated_count")) > 0
    status = F.when(F.col("discovered_count").isNull(), F.col("status")).when(F.col("error_message").isNotNull() | (failed & ~some), "failed").when(failed, "partial").otherwise("success")
    return runs.join(o, "source_id", "left").withColumn("status", status).withColumn("finished_at", F.when(F.col("discovered_count").isNotNull(), literal(now)))


def audit_row(found: DataFrame, cards: DataFrame, now: datetime, limit: int = 20, strict: bool = False) -> DataFrame:
    """One row of audit_runs: verdict, counts by rule, cards by source, and the first examples, as JSON."""
    checks = found.groupBy("rule").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("checks"))
    owners = cards.groupBy(F.coalesce("source_name", F.lit("(none)")).alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("sources"), F.sum("n").alias("gigs"))
    few = found.where("level = 'error'").orderBy("rule", "gig_id", "detail").limit(limit).agg(F.collect_list(F.struct("rule", "gig_id", "detail")).alias("examples"))
    one = lambda rows: rows.withColumn("_one", F.lit(1))
    row = one(verdict(found, strict)).join(one(checks), "_one").join(one(owners), "_one").join(one(few), "_one")
    body = F.to_json(F.struct("errors", "warnings", "gigs", "checks", "sources", F.array_sort("examples").alias("examples")))
    return row.select(F.sha2(body, 256).alias("id"), "result", body.alias("summary"), literal(now).alias("created_at"))


def recent_results(history: DataFrame, n: int = RECENT) -> DataFrame:
    """How often each result is among the last n audits; none counts 0."""
    last = history.orderBy(F.desc("created_at"), "id").limit(n)
    return last.agg(*(F.count_if(F.col("result") == r).alias(r) for r in RESULTS))


def repair_artists(source_gigs: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, artist_names, artist_extraction_kind) of rows whose line-up, taken anew from the stored payload, differs.

    extract: from id and raw_payload to id, artists and kind.
    """
    new = extract(source_gigs.select("id", "raw_payload")).select("id", "artists", "kind")
    joined = source_gigs.select("id", "artist_names", F.col("artist_extraction_kind").alias("_kind")).join(new, "id")
    return joined.where(~F.equal_null("artist_names", "artists") | ~F.equal_null("_kind", "kind")).select("id", F.col("artists").alias("artist_names"), F.col("kind").alias("artist_extraction_kind"))


def rename_artists(artists: DataFrame, plan: DataFrame, prefer: Callable) -> DataFrame:
    """artists with the name that a fold over the planned spellings (slug, n, name) leaves."""
    folded = plan.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("names"))
    pick = F.aggregate("names", F.col("name"), lambda acc, x: let(F.struct(acc.alias("a"), x["name"].alias("b")), lambda p: prefer(p["a"], p["b"])))
    return artists.join(folded, "slug", "left").withColumn("name", F.when(F.col("names").isNull(), F.col("name")).otherwise(pick)).drop("names")


def prefetch_filters(selected: Sequence[str], limit: int = 4) -> list[list[str]]:
    """Venue filters that a reader may go to next: none, and each without one, if there are `limit` at most."""
    slugs = list(dict.fromkeys(s for s in selected if s))
    if not slugs:
        return []
    return [[]] + [rest for s in slugs if (rest := [x for x in slugs if x != s])] if len(slugs) <= limit else [[]]


def day_transition(days: DataFrame, active: str, requested: str) -> DataFrame:
    """(direction, from_day, to_day) between two different days of `days`, else no row."""
    both = days.agg(F.max(F.when(F.col("date_key") == active, F.col("date_key"))).alias("from_day"), F.max(F.when(F.col("date_key") == requested, F.col("date_key"))).alias("to_day"))
    return both.where("from_day is not null and to_day is not null and from_day != to_day").select(F.when(F.col("to_day") > F.col("from_day"), "next").otherwise("previous").alias("direction"), "from_day", "to_day")


def output_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of all rows, whatever their order, for comparing two runs: the sum of the rows' digests."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 14), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(digest), F.lit(0)).cast("string")), 256).alias("digest"))
