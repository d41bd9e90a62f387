"""Status rules and the choice between stored and incoming fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.schema import blank


def listing_status(title: Column, cancelled: Column, postponed: Column, affected_by: Column, rescheduled_titles: bool) -> Column:
    """From flags, title prefixes and a remark. rescheduled_titles: whether titles and remarks of rescheduling count,
    which differs between sources."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(affected_by, F.lit("")))
    yes = lambda flag: F.coalesce(flag, F.lit(False))
    moved = t.startswith("postponed -") | a.contains("postpon")
    if rescheduled_titles:
        moved = moved | t.startswith("rescheduled -") | a.contains("resched")
    return F.when(yes(cancelled) | t.startswith("cancelled -") | a.contains("cancel"), "cancelled").when(yes(postponed) | moved, "postponed").otherwise("active")


def chosen_text(existing: Column, incoming: Column, may_replace: Column) -> Column:
    """Blank counts as missing; one who may not replace only fills blanks."""
    return F.when(blank(existing), incoming).when(blank(incoming), existing).otherwise(F.when(may_replace, incoming).otherwise(existing))


def chosen_time(existing: Column, incoming: Column, may_replace: Column) -> Column:
    return F.when(existing.isNull(), incoming).when(incoming.isNull(), existing).otherwise(F.when(may_replace, incoming).otherwise(existing))


def may_replace(owner_source: Column, owner_priority: Column, source: Column, priority: Column) -> Column:
    """No owner, the owner itself, or strictly higher priority."""
    return owner_source.isNull() | (owner_source == source) | (priority > owner_priority)


def chosen_start(existing: Column, incoming: Column, incoming_precision: Column, owner_precision: Column, any_exact: Column, replace: Column) -> Column:
    """An exact time replaces a date alone whoever owns it; a date alone never replaces an exact time."""
    owner = F.coalesce(owner_precision, F.lit("exact"))
    upgrade = (incoming_precision == "exact") & (owner == "date") & (existing != incoming)
    keep = (incoming_precision == "date") & ((owner == "exact") | any_exact)
    return F.when(upgrade | (replace & ~keep), incoming).otherwise(existing)


def image_state(incoming_url: Column, stored_url: Column, stored_status: Column, stored_path: Column) -> Column:
    """After an upsert: no image, the one mirrored already, or one to mirror."""
    return F.when(blank(incoming_url), "missing").when((incoming_url == stored_url) & (stored_status == "ready") & stored_path.isNotNull(), "ready").otherwise("pending")


def wants_mirror(status: Column, path: Column, width: Column, height: Column, starts_at: Column, now: Column, force: bool = False) -> Column:
    """Upcoming rows whose image is pending, failed, or ready without path or dimensions."""
    incomplete = path.isNull() | width.isNull() | height.isNull()
    return (starts_at >= now) & (status != "missing") & (F.lit(force) | status.isin("pending", "failed") | incomplete)
