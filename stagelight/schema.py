"""Schemas of the core tables, enums and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Business time zone: no daylight saving, so a local day is a half-open UTC interval of 24 hours.
ZONE = "Australia/Perth"

TABLES = {
    "sources": "id string, slug string, name string, base_url string, priority int, is_public_listing_source boolean, is_active boolean, ordinal int",
    "venues": "id string, slug string, name string, suburb string, address string, website_url string, updated_at timestamp",
    "artists": "id string, slug string, name string",
    "gigs": "id string, slug string, venue_id string, title string, description string, status string, starts_at timestamp, ends_at timestamp, ticket_url string, source_url string, tixel_url string, created_at timestamp, updated_at timestamp",
    "gig_artists": "gig_id string, artist_id string, sort_order int",
    "source_gigs": "id string, gig_id string, source_id string, external_id string, checksum string, identity_key string, source_url string, starts_at_precision string, artist_names array<string>, artist_extraction_kind string, raw_payload string, source_image_url string, mirrored_image_path string, mirrored_image_width int, mirrored_image_height int, image_mirror_status string, image_mirrored_at timestamp, last_seen_at timestamp, created_at timestamp",
    "scrape_runs": "id string, source_id string, status string, discovered_count int, inserted_count int, updated_count int, failed_count int, error_message string, started_at timestamp, finished_at timestamp",
    "audit_runs": "id string, result string, summary string, created_at timestamp",
}

NORMALISED = (
    "source_slug string, external_id string, source_url string, image_url string, title string, description string, status string, starts_at timestamp, "
    "starts_at_precision string, ends_at timestamp, ticket_url string, venue struct<name:string,slug:string,suburb:string,address:string,website_url:string>, "
    "artists array<string>, artist_extraction_kind string, raw_payload string, checksum string"
)

#: Fixed values of the stored enums.
ENUMS = {
    "status": ("active", "cancelled", "postponed"),
    "starts_at_precision": ("exact", "date"),
    "artist_extraction_kind": ("structured", "explicit_lineup", "parsed_text", "unknown"),
    "image_mirror_status": ("missing", "pending", "ready", "failed"),
    "run_status": ("running", "success", "partial", "failed"),
    "audit_result": ("pass", "warning", "fail"),
}


def blank(value: Column) -> Column:
    """Null or empty: both count as missing."""
    return F.coalesce(value, F.lit("")) == ""


def filled(value: Column) -> Column:
    return F.when(~blank(value), value)


def identity_key() -> Column:
    return F.coalesce("external_id", "checksum")


def split_valid(rows: DataFrame, enums: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `_error`): enum columns hold a member, required columns are not blank."""
    error = F.lit(None).cast("string")
    for name, members in enums.items():
        error = F.coalesce(error, F.when(~F.coalesce(F.col(name).isin(*members), F.lit(False)), F.lit(f"{name} is not one of {', '.join(members)}")))
    for name in required:
        error = F.coalesce(error, F.when(blank(F.col(name).cast("string")), F.lit(f"{name} is missing")))
    marked = rows.withColumn("_error", error)
    return marked.where("_error is null").drop("_error"), marked.where("_error is not null")
