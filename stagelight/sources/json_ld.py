"""Event pages with JSON-LD: landed HTML to structured events to listings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.functions import text as T
from stagelight.functions.artists import extraction, normalise_names
from stagelight.functions.dates import parse_local, parse_start
from stagelight.functions.humanitix_lineups import humanitix_names
from stagelight.functions.lineups import names_as_in_title
from stagelight.functions.urls import clean_url, trailing_id
from stagelight.sources.json_hits import _venue, with_ordinals
from stagelight.sources.pages import page_parts

#: The source whose pages name artists in sections and wording too.
COMMUNITY = "humanitix-perth-music"

SCRIPT = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)
EVENT_FIELDS = "page_id long, page_url string, i int, name string, url string, description string, image string, start_date string, end_date string, status string, mode string, place string, street string, locality string, region string, postcode string, performers array<string>, notes array<string>, offer_url string, raw string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of landed pages."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def flatten(value) -> list[dict]:
    """All objects of a JSON-LD value, through lists and @graph."""
    if isinstance(value, list):
        return [x for v in value for x in flatten(v)]
    if not isinstance(value, dict):
        return []
    return [value, *flatten(value.get("@graph"))]


def _first(value, key: str = "url") -> str | None:
    """The first text of a value that may be a text, an object or a list of them."""
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            v = _first(v.get(key)) if v.get(key) is not value else None
        if isinstance(v, str) and v.strip():
            return v.strip()
    return None


def _event(x: dict) -> dict:
    place = x.get("location")
    place = next((p for p in place if isinstance(p, dict)), {}) if isinstance(place, list) else place if isinstance(place, dict) else {"name": place}
    address = place.get("address")
    address = address if isinstance(address, dict) else {"streetAddress": address}
    people = x.get("performer") or x.get("performers") or []
    named = [(p, None) if isinstance(p, str) else (p.get("name"), p.get("description")) for p in (people if isinstance(people, list) else [people]) if isinstance(p, (str, dict))]
    named = [(n, d if isinstance(d, str) else None) for n, d in named if isinstance(n, str)]
    text = lambda v: v if isinstance(v, str) else None
    return {
        "name": text(x.get("name")), "url": _first(x.get("url")), "description": text(x.get("description")), "image": _first(x.get("image")), "start_date": text(x.get("startDate")), "end_date": text(x.get("endDate")),
        "status": text(x.get("eventStatus")), "mode": _first(x.get("eventAttendanceMode")), "place": text(place.get("name")), "street": text(address.get("streetAddress")), "locality": text(address.get("addressLocality")),
        "region": text(address.get("addressRegion")), "postcode": text(address.get("postalCode")), "performers": [n for n, _ in named], "notes": [d for _, d in named], "offer_url": _first(x.get("offers")), "raw": json.dumps(x, sort_keys=True),
    }


def is_event(x: dict) -> bool:
    kinds = x.get("@type")
    return any(isinstance(k, str) and (k.endswith("Event") or k == "Festival") for k in (kinds if isinstance(kinds, list) else [kinds]))


def list_items(html: Column) -> Column:
    """URLs of all item lists of a page's JSON-LD, in order: texts, items, or items of items."""

    def urls(page: str | None) -> list[str]:
        out = []
        for body in SCRIPT.findall(page or ""):
            try:
                found = flatten(json.loads(body))
            except ValueError:
                continue
            for x in found:
                kinds = x.get("@type")
                if any(isinstance(k, str) and k.lower().split("/")[-1] == "itemlist" for k in (kinds if isinstance(kinds, list) else [kinds])):
                    items = x.get("itemListElement")
                    for i in items if isinstance(items, list) else []:
                        item = i.get("item", i) if isinstance(i, dict) else i
                        url = item.get("url") if isinstance(item, dict) else item
                        out += [url] if isinstance(url, str) else []
        return out

    return F.pandas_udf(lambda pages: pages.map(urls), "array<string>")(F.when(html.contains("ld+json"), html))


def events_of(pages: DataFrame) -> DataFrame:
    """A row for each event of each page, in order; script bodies that aren't JSON give none."""
    names = [f.strip().split()[0] for f in EVENT_FIELDS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.page_id, batch.url, batch.html):
                i = 0
                for body in SCRIPT.findall(html or ""):
                    try:
                        found = flatten(json.loads(body))
                    except ValueError:
                        continue
                    for x in filter(is_event, found):
                        rows.append({"page_id": page, "page_url": url, "i": i} | _event(x))
                        i += 1
            yield pd.DataFrame(rows, columns=names)

    # pages without the marker don't reach Python
    return pages.where(F.col("html").contains("ld+json")).select("page_id", "url", "html").mapInPandas(run, EVENT_FIELDS)


def is_offline() -> Column:
    """Neither an online mode nor an online place."""
    return ~F.coalesce(F.lower("mode").contains("online"), F.lit(False)) & ~F.coalesce(F.lower("place").rlike("\\b(?:online|zoom|virtual|webinar|livestream)\\b"), F.lit(False))


def is_western() -> Column:
    region = F.lower(F.trim(F.coalesce("region", F.lit(""))))
    return region.isin("", "wa", "western australia")


def normaliser(slug: str) -> Callable[[DataFrame], DataFrame]:
    """Listings of a source's pages: offline events of the state. Several events of a page have their start in their id."""

    def run(pages: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        rows = events_of(pages).where(is_offline() & is_western())
        url = F.coalesce(clean_url(F.col("url")), clean_url(F.col("page_url")))
        start = parse_start(F.col("start_date"))
        rows = rows.withColumn("_url", url).withColumn("_start", start).withColumn("_title", T.normalise_space(F.coalesce("name", F.lit("")))).withColumn("_n", F.count("*").over(Window.partitionBy("page_id")))
        base = F.coalesce(trailing_id(F.col("_url")), F.regexp_extract("_url", "([^/?#]+)/?(?:[?#].*)?$", 1))
        ext = F.when(F.col("_n") > 1, F.concat(base, F.lit(":"), T.instant(F.col("_start.starts_at")))).otherwise(base)
        place = F.coalesce("place", F.lit("Unknown venue"))
        address = T.join_filled(", ", F.coalesce("street", F.lit("")), F.coalesce("locality", F.lit("")), F.coalesce(F.concat_ws(" ", "region", "postcode"), F.lit("")))
        rows = rows.withColumn("_venue", _venue(place, T.venue_suburb(place, F.col("locality")), T.venue_address(place, address), F.lit(None).cast("string")))
        state = F.lower(F.concat_ws(" ", "status", "_title"))
        status = F.when(state.contains("cancel"), "cancelled").when(state.contains("postpon") | state.contains("resched"), "postponed").otherwise("active")
        text = T.normalise_space(F.array_join(T.html_lines(F.col("description")), " "))
        if slug == COMMUNITY:
            parts = pages.select("page_id", page_parts(F.col("html")).alias("_parts")).dropDuplicates(["page_id"])
            rows = rows.join(parts, "page_id", "left").withColumn("_lineup", humanitix_names(F.col("_title"), text, F.col("_parts.lineup"), F.col("_parts.texts"), F.col("performers"), F.col("notes")))
            names = normalise_names(F.col("_lineup.names"))
            artists = F.struct(names.alias("artists"), F.when(F.size(names) == 0, "unknown").otherwise(F.col("_lineup.kind")).alias("kind"))
        else:
            own = extraction(F.col("performers"), "structured")
            artists = F.struct(names_as_in_title(own["artists"], F.col("_title")).alias("artists"), own["kind"].alias("kind"))
        out = rows.select(
            F.lit(slug).alias("source_slug"), ext.alias("external_id"), F.col("_url").alias("source_url"), clean_url(F.col("image")).alias("image_url"), F.col("_title").alias("title"), F.nullif(text, F.lit("")).alias("description"), status.alias("status"),
            F.col("_start.starts_at").alias("starts_at"), F.col("_start.precision").alias("starts_at_precision"), parse_local(F.col("end_date")).alias("ends_at"), F.coalesce(clean_url(F.col("offer_url")), F.col("_url")).alias("ticket_url"), F.col("_venue").alias("venue"),
            artists["artists"].alias("artists"), artists["kind"].alias("artist_extraction_kind"), F.col("raw").alias("raw_payload"), T.gig_checksum(F.lit(slug), F.col("_start.starts_at"), F.col("_title"), F.col("_venue.slug"), F.col("_url")).alias("checksum"),
            F.struct("page_id", "i").alias("_place"), F.when((F.col("_title") == "") | F.col("_start").isNull(), "no title or start").alias("_error"),
        )
        return with_ordinals(out)

    return run
