"""The sources in their processing order, and which of them a run takes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """slug, priority and visibility become a row of `sources`; read turns a landed folder into raw rows, normalise
    those into normalised listings with `_error` for rows that can't be read, repair takes line-ups (id, artists, kind)
    anew from stored payloads (id, raw_payload), for `history.repair_artists`."""

    slug: str
    name: str
    priority: int
    is_public: bool = True
    read: Callable[[SparkSession, str], DataFrame] | None = None
    normalise: Callable[[DataFrame], DataFrame] | None = None
    repair: Callable[[DataFrame], DataFrame] | None = None


#: Slugs, names and priorities, in processing order.
ORDER = (
    ("humanitix-perth-music", "Humanitix", 10),
    ("milk-bar", "Milk Bar", 100),
    ("rosemount-hotel", "Rosemount Hotel", 100),
    ("the-ellington", "The Ellington", 100),
    ("the-bird", "The Bird", 50),
    ("oztix-wa", "Oztix", 10),
    ("moshtix-wa", "Moshtix", 10),
    ("ticketek-wa", "Ticketek", 10),
    ("ticketmaster-au", "Ticketmaster", 10),
    ("eventbrite-perth-music", "Eventbrite", 5),
)


def registry() -> list[Source]:
    from datetime import datetime, timezone

    from stagelight.sources import city_feed, feeds, json_hits, json_ld, moshtix, pages

    own = {
        "oztix-wa": (json_hits.read_hits, json_hits.normalise_oztix),
        "milk-bar": (json_hits.read_hits, json_hits.normalise_milk_bar),
        "rosemount-hotel": (json_hits.read_hits, json_hits.normalise_rosemount),
        "ticketmaster-au": (city_feed.read_events, city_feed.normalise_events),
        "humanitix-perth-music": (json_ld.read_pages, json_ld.normaliser("humanitix-perth-music")),
        "moshtix-wa": (json_ld.read_pages, moshtix.normalise_moshtix, moshtix.repaired_names),
        "eventbrite-perth-music": (json_ld.read_pages, json_ld.normaliser("eventbrite-perth-music")),
        "the-bird": (feeds.read_bird, lambda rows: feeds.normalise_bird(rows, datetime.now(timezone.utc))),
        "the-ellington": (feeds.read_ellington_with_details, feeds.normalise_ellington_rows, feeds.repaired_club_names),
        "ticketek-wa": (lambda spark, path: pages.result_rows(json_ld.read_pages(spark, path)), feeds.normalise_ticketek),
    }
    return [Source(slug, name, priority, True, *own.get(slug, ())) for slug, name, priority in ORDER]


def parse_slugs(value: str | None) -> list[str]:
    return [x.strip().lower() for x in (value or "").split(",") if x.strip()]


def select_sources(sources: list[Source], include: list[str] = (), exclude: list[str] = ()) -> list[Source]:
    """In registry order; an unknown slug or an empty choice is an error."""
    known = {s.slug for s in sources}
    if unknown := [x for x in [*include, *exclude] if x not in known]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    chosen = [s for s in sources if (not include or s.slug in include) and s.slug not in exclude]
    if not chosen:
        raise ValueError("no source is left to run")
    return chosen


def source_rows(spark: SparkSession, sources: list[Source]) -> DataFrame:
    from stagelight.schema import TABLES

    rows = [(s.slug, s.slug, s.name, None, s.priority, s.is_public, True, i) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, TABLES["sources"])
