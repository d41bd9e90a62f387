"""URLs and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.functions.text import collapse, let

EARTH_KM = 6371.0
#: Sellers by host.
SELLERS = {"oztix.com.au": "Oztix", "moshtix.com.au": "Moshtix", "ticketek.com.au": "Ticketek", "ticketmaster.com.au": "Ticketmaster", "eventbrite.com.au": "Eventbrite", "eventbrite.com": "Eventbrite", "humanitix.com": "Humanitix", "tixel.com": "Tixel"}
DIRECT_EVENT = "^https://tixel[.]com/au/[a-z0-9-]+-tickets/[0-9]{4}/[0-9]{2}/[0-9]{2}/[a-z0-9-]+$"
CONTENT_PATH = "^sha256/([0-9a-f]{2})/([0-9a-f]{64})[.](?:jpg|jpeg|png|webp|avif|gif)$"


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def within_km(lat: Column, lng: Column, centre: tuple[float, float], km: float) -> Column:
    """False where a coordinate is missing or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    near = distance_km(lat, lng, F.lit(centre[0]), F.lit(centre[1])) <= km
    return F.when(finite(lat) & finite(lng), near).otherwise(False)


def absolute_http(value: Column) -> Column:
    """An absolute http(s) URL without credentials, with a lower-case scheme and host, no default port, and at least
    the path `/`; else null."""
    return let(F.trim(value), _absolute)


def _absolute(text: Column) -> Column:
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(text, "^[A-Za-z]+://([^/?#]*)", 1)
    rest = F.regexp_extract(text, "^[A-Za-z]+://[^/?#]*(.*)$", 1)
    host = F.regexp_replace(F.lower(authority), F.when(scheme == "http", ":80$").otherwise(":443$"), "")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    ok = scheme.isin("http", "https") & ~authority.contains("@") & host.rlike("^[^\\s:]+(:[0-9]{1,5})?$")
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.replace(path, F.lit(" "), F.lit("%20"))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:www[.])?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    return F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1)


def drop_params(url: Column, pattern: str) -> Column:
    """url without the query parameters whose names match."""
    return let(url, lambda u: _without_params(u, pattern))


def _without_params(url: Column, pattern: str) -> Column:
    base, fragment = F.regexp_extract(url, "^[^?#]*", 0), F.regexp_extract(url, "#.*$", 0)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{pattern})(?:=|$)")), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)


def clean_url(value: Column) -> Column:
    """With a scheme, without utm parameters; null if blank."""
    return let(collapse(value), _clean)


def _clean(text: Column) -> Column:
    full = F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(F.coalesce(text, F.lit("")) != "", absolute_http(drop_params(full, "utm_[A-Za-z_]*")))


def resolved(value: Column, origin: str) -> Column:
    """A page's link as an absolute URL: relative ones belong to the origin; null if blank."""
    text = F.trim(value)
    full = F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).when(text.startswith("/"), F.concat(F.lit(origin), text)).otherwise(F.concat(F.lit(f"{origin}/"), text))
    return F.when(F.coalesce(text, F.lit("")) != "", full)


def drop_image_size(url: Column) -> Column:
    return drop_params(url, "width|height")


def image_area(url: Column) -> Column:
    """Width times height from a URL's parameters."""
    return query_value(url, "width").try_cast("long") * query_value(url, "height").try_cast("long")


def ticket_identity(url: Column) -> Column:
    """Without query, fragment and a last slash; null if blank."""
    text = F.trim(url)
    return F.when(text != "", F.regexp_replace(F.regexp_replace(text, "[?#].*$", ""), "/$", ""))


def seller(url: Column) -> Column:
    h, out = host(url), F.lit(None).cast("string")
    for domain, name in SELLERS.items():
        out = F.coalesce(out, F.when((h == domain) | h.endswith(f".{domain}"), name))
    return out


def direct_event(url: Column) -> Column:
    """A direct secondary-market event URL whose date exists, without query and fragment; else null."""
    base = F.regexp_replace(F.trim(url), "[?#].*$", "")
    day = F.replace(F.regexp_extract(base, "/([0-9]{4}/[0-9]{2}/[0-9]{2})/", 1), F.lit("/"), F.lit("-"))
    return F.when(base.rlike(DIRECT_EVENT) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), base)


def trailing_id(url: Column) -> Column:
    """The digits that end a path, as event pages have them."""
    return F.nullif(F.regexp_extract(F.regexp_replace(path_of(url), "/$", ""), "([0-9]{6,})$", 1), F.lit(""))


def content_path(digest: Column, extension: Column) -> Column:
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("."), extension)


def is_content_path(path: Column) -> Column:
    return F.coalesce(path.rlike(CONTENT_PATH) & (F.regexp_extract(path, CONTENT_PATH, 1) == F.substring(F.regexp_extract(path, CONTENT_PATH, 2), 1, 2)), F.lit(False))


def image_url(path: Column, source_url: Column, version: Column, base: str) -> Column:
    """The mirrored image, with its version unless its path names its content; else the source's own."""
    url = F.concat(F.lit(base.rstrip("/") + "/"), path)
    return F.when(path.isNull(), source_url).when(is_content_path(path) | version.isNull(), url).otherwise(F.concat(url, F.lit("?v="), F.url_encode(version)))


def renderable_image(url: Column, width: Column, height: Column) -> Column:
    """(url, width, height) if there is a URL with positive dimensions, else null."""
    return F.when(url.isNotNull() & (width > 0) & (height > 0), F.struct(url.alias("url"), width.alias("width"), height.alias("height")))


def actions(ticket: Column, secondary: Column, website: Column) -> Column:
    """The links that a listing offers, in order, each URL once."""
    one = lambda kind, url: F.when(absolute_http(url).isNotNull(), F.struct(F.lit(kind).alias("kind"), absolute_http(url).alias("url"), seller(url).alias("seller")))
    return F.array_compact(F.array(one("tickets", ticket), one("secondary", secondary), F.when(~F.coalesce(F.equal_null(website, ticket), F.lit(False)), one("venue", website))))
