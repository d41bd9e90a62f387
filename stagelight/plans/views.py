"""The public views: cards, availability and sitemap rows. `t` maps table names to DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.functions.dates import version_token

Tables = Mapping[str, DataFrame]


def lineage(t: Tables) -> DataFrame:
    """Source rows with their source's name, priority and visibility; the sources dimension is small and Spark
    broadcasts it by its size."""
    s = t["sources"].select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "priority", "is_public_listing_source")
    return t["source_gigs"].join(s, "source_id")


def public_gig_ids(t: Tables) -> DataFrame:
    return lineage(t).where("is_public_listing_source").select(F.col("gig_id").alias("id")).distinct()


def artist_lists(t: Tables) -> DataFrame:
    """gig_id, artist_names by sort order, then name."""
    named = t["gig_artists"].join(t["artists"].select(F.col("id").alias("artist_id"), "name"), "artist_id")
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("sort_order", F.lit(2**31 - 1)).alias("o"), "name")))
    return named.groupBy("gig_id").agg(F.transform(items, lambda x: x["name"]).alias("artist_names"))


def _venues(t: Tables) -> DataFrame:
    return t["venues"].select(F.col("id").alias("venue_id"), F.col("slug").alias("venue_slug"), F.col("name").alias("venue_name"), F.col("suburb").alias("venue_suburb"), F.col("address").alias("venue_address"), F.col("website_url").alias("venue_website_url"))


def gig_cards(t: Tables) -> DataFrame:
    """One card for each gig that a public source lists.

    Text comes from the public source of highest priority, newest first. The image may come from a hidden source: one
    that is mirrored goes first. Both choices are one aggregate over lineage, keyed by gig.
    """
    rank = (F.col("priority"), F.col("last_seen_at"), F.col("created_at"), F.col("id"))
    ready = ((F.col("image_mirror_status") == "ready") & F.col("mirrored_image_path").isNotNull()).cast("int")
    has_image = F.col("source_image_url").isNotNull() | F.col("mirrored_image_path").isNotNull()
    text = F.struct("source_url", "source_name")
    image = F.struct(F.col("mirrored_image_path").alias("image_path"), "source_image_url", F.col("mirrored_image_width").alias("image_width"), F.col("mirrored_image_height").alias("image_height"), version_token(F.col("image_mirrored_at"), F.col("last_seen_at"), F.col("created_at")).alias("image_version"))
    public = F.coalesce(F.col("is_public_listing_source"), F.lit(False))
    chosen = lineage(t).groupBy(F.col("gig_id").alias("id")).agg(
        F.max_by(F.when(public, text), F.when(public, F.struct(*rank))).alias("_text"),
        F.max_by(F.when(has_image, image), F.when(has_image, F.struct(F.coalesce(ready, F.lit(0)).alias("ready"), *rank))).alias("_image"),
        F.max(public).alias("_public"),
    )
    # Venues come first, so that whole cards, which are wide, are never dealt by venue and back by id.
    gigs = t["gigs"].withColumnRenamed("source_url", "_own_url").join(_venues(t), "venue_id").join(chosen.where("_public"), "id").join(artist_lists(t).withColumnRenamed("gig_id", "id"), "id", "left")
    return gigs.select(
        "id", "slug", "title", "description", "starts_at", "ends_at", "ticket_url", F.coalesce("_text.source_url", "_own_url").alias("source_url"), F.col("_text.source_name").alias("source_name"),
        *(F.col(f"_image.{c}").alias(c) for c in ("image_path", "source_image_url", "image_width", "image_height", "image_version")),
        "venue_slug", "venue_name", "venue_suburb", "venue_address", "venue_website_url", F.coalesce("artist_names", F.array().cast("array<string>")).alias("artist_names"), "status", "tixel_url",
    )


def gig_dates(t: Tables) -> DataFrame:
    """What availability needs of public gigs."""
    names = artist_lists(t).withColumnRenamed("gig_id", "id")
    rows = t["gigs"].join(public_gig_ids(t), "id", "left_semi").join(_venues(t), "venue_id").join(names, "id", "left")
    return rows.select("id", "title", "starts_at", "venue_slug", "venue_name", "venue_suburb", F.coalesce("artist_names", F.array().cast("array<string>")).alias("artist_names"), "status")


def sitemap_gigs(t: Tables) -> DataFrame:
    return t["gigs"].join(public_gig_ids(t), "id", "left_semi").select("slug", "starts_at", "status", F.col("updated_at").alias("last_modified"))


#: Columns that readers of the public tables see.
PUBLIC_COLUMNS = {
    "sources": ("id", "slug", "name", "base_url"),
    "venues": ("id", "slug", "name", "suburb", "address", "website_url"),
    "gigs": ("id", "slug", "venue_id", "title", "description", "status", "starts_at", "ends_at", "ticket_url", "source_url", "tixel_url", "updated_at"),
    "gig_artists": ("gig_id", "artist_id", "sort_order"),
    "artists": ("id", "slug", "name"),
    "source_gigs": ("id", "gig_id", "source_id", "source_url", "last_seen_at"),
}


def public_table(t: Tables, name: str) -> DataFrame:
    """A table's rows and columns that readers may see: those of gigs that a public source lists."""
    ids, rows = public_gig_ids(t), t[name]
    if name == "sources":
        rows = rows.where("is_public_listing_source")
    elif name == "gigs":
        rows = rows.join(ids, "id", "left_semi")
    elif name in ("gig_artists", "source_gigs"):
        rows = rows.join(ids.withColumnRenamed("id", "gig_id"), "gig_id", "left_semi")
        if name == "source_gigs":
            rows = rows.join(t["sources"].where("is_public_listing_source").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    elif name == "venues":
        rows = rows.join(t["gigs"].join(ids, "id", "left_semi").select(F.col("venue_id").alias("id")), "id", "left_semi")
    elif name == "artists":
        linked = t["gig_artists"].join(ids.withColumnRenamed("id", "gig_id"), "gig_id", "left_semi")
        rows = rows.join(linked.select(F.col("artist_id").alias("id")), "id", "left_semi")
    return rows.select(*PUBLIC_COLUMNS[name])
