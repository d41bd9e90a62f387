"""Landed listings as a stream: each micro-batch is resolved into the tables, and a source is pruned once a run of it has
ended, over all batches that the run came in."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.operators.resolve import prune, resolve_source, sync_artists
from stagelight.operators.versions import Versions

#: What open runs have listed so far, and listings that no source owns; both are versioned with the other tables.
SEEN = "source_id string, run_id string, identity_key string, source_gig_id string, outcome string"
REJECTED = "source_slug string, run_id string, external_id string, title string, batch_id long, error string"


def resolve_batches(store: Versions, now: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over normalised listings with run_id and run_ended.

    Listings are resolved batch by batch; what a run has listed is kept in the table `run_listings`. A row with
    run_ended is no listing but the end of its source's run: only then are rows pruned that the source's whole run did
    not list, unless a listing of it failed. Listings of a slug that `sources` lacks are kept in `rejected_listings`. Batch n is worked into the newest version below n + 1 and written as version n + 1, so
    that a batch that is run again gives the same version.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, now()
        tables = store.read(before=batch_id + 1)
        tables.setdefault("run_listings", spark.createDataFrame([], SEEN))
        tables.setdefault("rejected_listings", spark.createDataFrame([], REJECTED))
        batch = batch.persist()
        ended = F.coalesce("run_ended", F.lit(False))
        known = tables["sources"].orderBy("ordinal").select("id", "slug").collect()
        slugs = [s.slug for s in known]
        stray = batch.where(~ended & ~F.coalesce(F.col("source_slug").isin(slugs), F.lit(False))).select("source_slug", "run_id", "external_id", "title", F.lit(batch_id).alias("batch_id"), F.lit("unknown source").alias("error"))
        tables["rejected_listings"] = tables["rejected_listings"].unionByName(stray)
        present = {(r.source_slug, r.run_id): r.over for r in batch.groupBy("source_slug", "run_id").agg(F.max(ended).alias("over")).collect()}  # a few runs
        for s in known:
            for (slug, run_id), over in sorted(present.items(), key=lambda x: str(x[0])):
                if slug == s.slug:
                    listings = batch.where((F.col("source_slug") == slug) & F.col("run_id").eqNullSafe(run_id) & ~ended).drop("run_id", "run_ended")
                    tables = _step(tables, s.id, run_id, listings, over, at)
        store.write(tables, batch_id + 1)
        batch.unpersist()

    return run


def _step(tables: dict[str, DataFrame], source_id: str, run_id: str | None, listings: DataFrame, over: bool, at: datetime) -> dict[str, DataFrame]:
    state = tables["run_listings"]
    own = (F.col("source_id") == source_id) & F.col("run_id").eqNullSafe(run_id)
    new = dict(tables)
    if not listings.isEmpty():
        new, outcomes = resolve_source(tables, source_id, listings, at)
        key = (F.lit(source_id).alias("source_id"), F.lit(run_id).cast("string").alias("run_id"))
        none = F.lit(None).cast("string")
        listed = listings.select(*key, F.coalesce("external_id", "checksum").alias("identity_key"), none.alias("source_gig_id"), F.lit("listed").alias("outcome"))
        state = state.unionByName(listed).unionByName(outcomes.select(*key, none.alias("identity_key"), "source_gig_id", "outcome")).checkpoint()
    if over:
        whole = state.where(own)
        listed = whole.where("outcome = 'listed'").select(F.col("identity_key").alias("external_id"), F.lit(None).cast("string").alias("checksum"))
        new = prune(new, new, source_id, listed, whole.where("outcome != 'listed'").select("outcome", "source_gig_id"), at)
        state = state.where(~own)
    return dict(sync_artists(new)[0]) | {"run_listings": state}
