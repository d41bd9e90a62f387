"""A ticket site read in two steps: search pages give listings, each listing's event page gives the gig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions import text as T
from stagelight.functions.artists import normalise_names
from stagelight.functions.dates import parse_start
from stagelight.functions.moshtix_lineups import moshtix_names
from stagelight.functions.urls import clean_url, path_of, resolved
from stagelight.operators.dealing import apart, dealt, spread
from stagelight.sources import gates, pages
from stagelight.sources import nodes as N
from stagelight.sources.feeds import _listing

SLUG = "moshtix-wa"
#: Selectors of an event page, and the number of the live music category.
EVENT_NODES = {
    "data": "#event-structured-data-section script[type='application/ld+json']", "description": "#event-details-section .fr-view", "status": "#status-linked-section", "summary": "#event-summary-block", "thumb": "#event-summary-thumbnail img", "button": "a.button_orange",
}
LIVE_MUSIC = 2


def is_search(url: Column) -> Column:
    return path_of(url).rlike("/v2/search/?$")


def listings(search: DataFrame) -> DataFrame:
    """Listings worth a look at their page: whole ones, by their id once (first page and place), without those that
    their title or teaser already rules out."""
    rows = pages.search_rows(search).where("i IS NOT NULL AND _error IS NULL").where(~gates.skip_before_detail(F.col("title"), F.coalesce("teaser", F.lit(""))))
    first = rows.groupBy("external_id").agg(F.min_by(F.struct("title", "url", "starts_at", "image_url", "teaser", "raw"), F.struct("page_id", "i")).alias("listing"))
    return first.select("external_id", "listing")


def _locality(value: Column) -> Column:
    text = F.lower(T.collapse(F.coalesce(value, F.lit(""))))
    return F.nullif(F.when(text == "east freemantle", "East Fremantle").otherwise(F.initcap(text)), F.lit(""))


def event_pages(details: DataFrame) -> DataFrame:
    """page_id, url and the page's parts: event data and structured event (variants), description, status text, links."""
    marked = details.select("page_id", "url", F.try_parse_json(pages.event_data(F.col("html"))).alias("data"), N.mark(F.col("html"), EVENT_NODES, inner=("description",)).alias("_n"))
    n = F.col("_n")
    return marked.select(
        "page_id", "url", "data", pages.structured_event(N.first(n, "data")["text"]).alias("event"), N.first(n, "description")["html"].alias("description_html"), F.nullif(T.collapse(N.first(n, "description")["text"]), F.lit("")).alias("description"),
        T.collapse(N.all_text(n, "status")).alias("status_text"), N.first_attr(n, "summary", "data-event-link").alias("link"), N.first_attr(n, "thumb", "src").alias("thumb"), N.first_attr(n, "button", "href").alias("button"),
    )


def normalise_moshtix(landed: DataFrame) -> DataFrame:
    """Listings of landed pages (page_id, url, html) of both kinds, told apart by their URL.

    An event page belongs to the listing of its id; one without a listing counts as well. Events outside the live music
    category, clearly not music, or not near the city are left out; those without title or start are listed with an error.
    """
    rows = event_pages(landed.where(~is_search(F.col("url")))).withColumn("external_id", F.regexp_extract("url", "/([0-9]+)(?:[/?#]|$)", 1))
    rows = spread(rows, "external_id").join(dealt(listings(landed.where(is_search(F.col("url"))))), "external_id", "left")
    data = lambda path, kind="string": F.try_variant_get("data", path, kind)
    event = lambda path, kind="string": F.try_variant_get("event", path, kind)
    listing = lambda name: F.col("listing")[name]
    given = lambda v: F.nullif(T.collapse(v), F.lit(""))
    texts = lambda *urls: F.filter(F.transform(F.filter(F.concat(*urls), lambda u: u.isNotNull()), lambda u: clean_url(resolved(u, pages.SEARCH_SITE))), lambda u: u.isNotNull() & ~path_of(u).rlike("^/uploads/*$"))
    source = event("$.location.address.addressLocality")
    rows = apart(rows).withColumn("_title", T.normalise_space(F.coalesce(data("$.name"), event("$.name"), listing("title"), F.lit("")))).withColumn("_start", F.coalesce(parse_start(F.coalesce(data("$.startDate"), event("$.startDate")))["starts_at"], listing("starts_at")))
    rows = rows.withColumn("_text", F.coalesce("description", listing("teaser"))).withColumn("_suburb", _locality(source))
    name = F.coalesce(given(F.coalesce(event("$.location.name"), data("$.venue.name"))), F.lit("Moshtix Venue"))
    tail = lambda text, place: F.when(place.isNotNull() & F.lower(text).endswith(F.concat(F.lit(", "), F.lower(place))), F.left(text, F.length(text) - F.length(place) - 2)).otherwise(text)
    rows = rows.withColumn("_name", T.venue_name(tail(tail(name, given(source)), F.col("_suburb"))))
    line = F.concat_ws(" ", given(source), given(event("$.location.address.addressRegion")), given(event("$.location.address.postalCode")))
    address = F.concat_ws(", ", given(event("$.location.address.streetAddress")), F.nullif(line, F.lit("")))
    rows = rows.withColumn("_venue", F.struct(F.col("_name").alias("name"), T.venue_slug(F.col("_name")).alias("slug"), T.venue_suburb(F.col("_name"), F.col("_suburb")).alias("suburb"), T.venue_address(F.col("_name"), address).alias("address"), T.venue_website(F.col("_name"), clean_url(event("$.location.sameAs"))).alias("website_url")))
    wanted = F.coalesce(data("$.category.id", "int") == LIVE_MUSIC, F.lit(True)) & ~gates.clearly_not_music(F.col("_title"), F.coalesce("_text", F.lit("")))
    place = gates.metro_reject_reason(F.col("_title"), F.concat_ws(" ", "_venue.name", event("$.location.name"), data("$.venue.name")), F.col("_venue.address"), F.coalesce("_venue.suburb", source), F.coalesce(event("$.location.address.addressRegion"), data("$.venue.state")))
    rows = apart(rows.where(wanted & place.isNull()))
    performers = F.transform(F.coalesce(event("$.performers", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda p: p["name"])
    structured = F.concat(F.coalesce(data("$.artists", "array<string>"), F.array().cast("array<string>")), performers)
    rows = rows.withColumn("_lineup", moshtix_names(F.col("_title"), F.col("description_html"), structured, F.array(F.col("_venue.name"), data("$.venue.name"), data("$.client.name"), event("$.location.name"))))
    state = F.lower(F.concat_ws(" ", "_title", data("$.status"), event("$.eventStatus"), "status_text"))
    images = texts(F.array(data("$.customImage"), data("$.highResImage")), F.coalesce(event("$.image", "array<string>"), F.array(event("$.image"))), F.array("thumb", listing("image_url")))
    page = F.coalesce(listing("url"), F.col("url"))
    offers = F.coalesce(event("$.offers", "array<struct<url:string>>"), F.array(F.struct(event("$.offers.url").alias("url"))))
    return _listing(
        rows, SLUG, F.col("_venue"), external_id=F.nullif(F.col("external_id"), F.lit("")), source_url=clean_url(resolved(F.coalesce(event("$.url"), "link", page), pages.SEARCH_SITE)), image_url=F.get(images, 0), title=F.col("_title"), description=F.col("_text"),
        status=F.when(state.contains("cancel"), "cancelled").when(state.contains("postpon") | state.contains("resched"), "postponed").otherwise("active"), starts_at=F.col("_start"), ends_at=parse_start(F.coalesce(data("$.endDate"), event("$.endDate")))["starts_at"],
        ticket_url=clean_url(resolved(F.coalesce(F.get(F.filter(offers, lambda o: F.coalesce(o["url"], F.lit("")) != ""), 0)["url"], "button", page), pages.SEARCH_SITE)), artists=normalise_names(F.col("_lineup.names")), kind=F.col("_lineup.kind"),
        raw_payload=F.to_json(F.struct(listing("raw").alias("listing"), F.to_json("data").alias("eventData"), F.to_json("event").alias("structuredEvent"), F.col("description_html").alias("descriptionHtml"))), checksum_url=page, place=F.struct(F.lit("page").alias("f"), F.col("page_id").alias("n")),
    )



def repaired_names(stored: DataFrame) -> DataFrame:
    """(id, artists, kind) taken anew from stored payloads (id, raw_payload); rows without a title are left out."""
    body = F.from_json("raw_payload", "eventData string, structuredEvent string, descriptionHtml string")
    rows = stored.select("id", body.alias("p")).select("id", F.try_parse_json("p.eventData").alias("data"), F.try_parse_json("p.structuredEvent").alias("event"), "p.descriptionHtml")
    data = lambda path, kind="string": F.try_variant_get("data", path, kind)
    event = lambda path, kind="string": F.try_variant_get("event", path, kind)
    performers = F.transform(F.coalesce(event("$.performers", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda p: p["name"])
    structured = F.concat(F.coalesce(data("$.artists", "array<string>"), F.array().cast("array<string>")), performers)
    found = moshtix_names(F.coalesce(data("$.name"), event("$.name")), F.col("descriptionHtml"), structured, F.array(data("$.venue.name"), data("$.client.name"), event("$.location.name")))
    return repaired(rows.where(F.coalesce(data("$.name"), event("$.name")).isNotNull()).select("id", found.alias("x")))


def repaired(found: DataFrame) -> DataFrame:
    """(id, artists, kind) of line-ups `x` (names, kind)."""
    names = normalise_names(F.col("x.names"))
    return found.select("id", names.alias("artists"), F.when(F.size(names) == 0, "unknown").otherwise(F.col("x.kind")).alias("kind"))
