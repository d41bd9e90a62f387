"""Row feeds: a venue's two spreadsheets, a venue's REST list with cached details, and result rows of ticket sites."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.functions import dates as D
from stagelight.functions import text as T
from stagelight.functions.artists import normalise_names
from stagelight.functions.ellington_lineups import ellington_names
from stagelight.functions.lineups import bird_names, ticketek_names
from stagelight.functions.merging import listing_status
from stagelight.functions.urls import clean_url, host, path_of, query_value
from stagelight.operators.dealing import apart, spread
from stagelight.operators.matching import title_tokens
from stagelight.sources import gates
from stagelight.sources import nodes as N
from stagelight.sources.json_hits import with_ordinals

#: The venue of the two spreadsheets and that of the REST list.
BIRD, BIRD_PLACE = "the-bird", ("The Bird", "the-bird", "Northbridge", "181 William Street, Northbridge WA 6003", "https://www.williamstreetbird.com/")
BIRD_PAGES = {"comingup": "https://www.williamstreetbird.com/comingup", "whatson": "https://www.williamstreetbird.com/whatson"}
ELLINGTON, ELLINGTON_PLACE = "the-ellington", ("The Ellington Jazz Club", "the-ellington-jazz-club", "Perth", None, None)
FEED_ROW = "`Date` string, `Day` string, `Time` string, `Event Title` string, `Title` string, `Info` string, `Vibe` string, `Featuring` string, `Description` string, `Ticket Link` string"
REST_EVENT = "id long, link string, modified_gmt string, title struct<rendered:string>, content struct<rendered:string>, _embedded struct<`wp:term`:array<array<struct<name:string,taxonomy:string>>>>"


def _place(values: tuple) -> Column:
    return F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("name", "slug", "suburb", "address", "website_url"), values)))


def _listing(rows: DataFrame, slug: str, venue: Column, **fields: Column) -> DataFrame:
    """Normalised listings with an error where title or start is missing. fields: the record's own columns."""
    none = F.lit(None).cast("string")
    get = lambda name, other=none: fields.get(name, other)
    error = F.coalesce(get("error"), F.when((F.coalesce(fields["title"], F.lit("")) == "") | fields["starts_at"].isNull(), "no title or start"))
    out = rows.select(
        F.lit(slug).alias("source_slug"), fields["external_id"].alias("external_id"), fields["source_url"].alias("source_url"), get("image_url").alias("image_url"), fields["title"].alias("title"), get("description").alias("description"), get("status", F.lit("active")).alias("status"),
        fields["starts_at"].alias("starts_at"), get("precision", F.lit("exact")).alias("starts_at_precision"), get("ends_at", F.lit(None).cast("timestamp")).alias("ends_at"), get("ticket_url").alias("ticket_url"), venue.alias("venue"), fields["artists"].alias("artists"),
        F.when(F.size(fields["artists"]) == 0, "unknown").otherwise(get("kind", F.lit("explicit_lineup"))).alias("artist_extraction_kind"), get("raw_payload").alias("raw_payload"),
        T.gig_checksum(F.lit(slug), fields["starts_at"], fields["title"], venue["slug"], get("checksum_url", fields["source_url"])).alias("checksum"), fields["place"].alias("_place"), error.alias("_error"),
    )
    return with_ordinals(out)


# --- two spreadsheets of one venue -------------------------------------------------------------------------------


def read_bird(spark: SparkSession, path: str) -> DataFrame:
    """Rows of both landed feeds (files named by their page), with their order."""
    rows = spark.read.schema(FEED_ROW).option("multiLine", True).json(path).withColumn("_f", F.col("_metadata.file_path")).withColumn("_n", F.monotonically_increasing_id())
    return rows.withColumn("feed", F.when(F.col("_f").contains("whatson"), "whatson").otherwise("comingup"))


def normalise_bird(rows: DataFrame, now: datetime) -> DataFrame:
    """Coming rows of both feeds that aren't blank or placeholders; weekly rows that are music; merged to one listing each.

    A row of the second feed folds into the first listing of the first one with its id, or of its UTC date with a
    compatible title. Rows of the second feed don't meet each other.
    """
    title = T.normalise_space(F.coalesce(F.when(F.col("feed") == "whatson", F.col("Title")).otherwise(F.col("Event Title")), F.lit("")))
    rows = rows.where(~gates.is_blank_row(*(F.col(c) for c in ("Date", "Event Title", "Title", "Info", "Featuring", "Description")))).withColumn("_title", title).where(~gates.is_placeholder_title(F.col("_title")))
    rows = rows.withColumn("_day", D.parse_numeric_day(F.col("Date"))).where(F.col("_day").isNull() | ~gates.is_past_day(F.col("_day"), now))
    rows = rows.withColumn("_names", bird_names(F.col("Featuring"), F.col("Info"), F.col("_title")))
    music = gates.weekly_music(F.col("_title"), F.col("Vibe"), F.col("Description"), F.col("Featuring"), F.col("_names"))
    rows = rows.where((F.col("feed") == "comingup") | music)
    clock = D.parse_clock(F.coalesce("Time", "Info"))
    rows = rows.withColumn("_clock", clock).withColumn("_start", F.when(F.col("_clock").isNotNull(), D.at_clock(F.col("_day"), F.col("_clock"))).otherwise(D.local_noon(F.col("_day"))))
    identity = F.concat(F.date_format("_day", "yyyy-MM-dd"), F.lit("-"), T.slugify(F.col("_title")))
    rows = rows.withColumn("_id", identity).withColumn("_text", F.nullif(T.normalise_space(F.coalesce("Info", "Description", F.lit(""))), F.lit("")))
    page = T.lookup(BIRD_PAGES, F.col("feed"))
    out = _listing(
        rows, BIRD, _place(BIRD_PLACE), external_id=F.col("_id"), source_url=F.concat(page, F.lit("#"), "_id"), title=F.col("_title"), description=F.col("_text"), starts_at=F.col("_start"), precision=F.when(F.col("_clock").isNotNull(), "exact").otherwise("date"),
        ticket_url=clean_url(F.col("Ticket Link")), artists=F.col("_names"), raw_payload=F.to_json(F.struct(*[c for c in rows.columns if c[0] != "_" and c != "feed"])), place=F.struct("_f", "_n"), status=listing_status(F.col("_title"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), False),
    )
    weekly = F.col("source_url").contains("/whatson#")
    return merge_feeds(out.where(~weekly), out.where(weekly))


def merge_feeds(primary: DataFrame, candidate: DataFrame) -> DataFrame:
    """primary with candidate's listings folded in (`merge_listings`); those without a partner are put behind.

    A partner has the candidate's external id, or its UTC date and a compatible title; the first in primary's order is
    taken. Pairs meet by id, and by day and title token (`title_tokens`), so no product of the feeds is made, nor of the
    rows of a day. Both feeds are read once (`apart`) for all that follows.
    """
    primary, candidate = apart(primary), apart(candidate)
    p = primary.select(F.struct(*primary.columns).alias("p"), F.col("external_id").alias("id"), F.date_format("starts_at", "yyyy-MM-dd").alias("day"), T.canonical_title(F.col("title")).alias("p_title"), F.col("ordinal").alias("p_at"))
    c = candidate.select(F.struct(*candidate.columns).alias("c"), F.col("external_id").alias("id"), F.date_format("starts_at", "yyyy-MM-dd").alias("day"), T.canonical_title(F.col("title")).alias("c_title"), F.col("ordinal").alias("c_at"))
    by_id = c.join(p.select("id", "p_at"), "id").select("c_at", "p_at")
    held = apart(p.select("day", "p_title", "p_at", F.transform(title_tokens(F.col("p_title")), lambda t: F.xxhash64(t)).alias("tokens"))).withColumn("token", F.explode("tokens"))
    asked = apart(c.select("day", "c_title", "c_at", F.transform(title_tokens(F.col("c_title")), lambda t: F.xxhash64(t)).alias("tokens"))).withColumn("token", F.explode("tokens"))
    by_day = asked.join(held, ["day", "token"]).where(T.compatible_keys(F.col("p_title"), F.col("c_title"))).select("c_at", "p_at")
    partner = by_id.unionByName(by_day).groupBy("c_at").agg(F.min("p_at").alias("p_at"))
    paired = c.join(partner, "c_at", "left")
    folded = paired.where("p_at is not null").groupBy("p_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_at", "c"))), lambda x: x["c"]).alias("cs"))
    merged = p.join(folded, "p_at", "left").select(F.aggregate(F.coalesce("cs", F.array().cast(dict(folded.dtypes)["cs"])), F.col("p"), merge_listings).alias("x")).select("x.*")
    alone = paired.where("p_at is null").select("c.*")
    both = merged.withColumn("_part", F.lit(0)).unionByName(alone.withColumn("_part", F.lit(1)))
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_slug").orderBy("_part", "ordinal")) - 1).drop("_part")


def merge_listings(current: Column, candidate: Column) -> Column:
    """Field by field: an exact time replaces a date alone, the longer text, known artists where there were none, blanks
    filled, the payload of both; id, title and URL stay."""
    exact = (current["starts_at_precision"] != "exact") & (candidate["starts_at_precision"] == "exact")
    known = (F.size(current["artists"]) > 0) | (F.size(candidate["artists"]) == 0)
    start = F.when(exact, candidate["starts_at"]).otherwise(current["starts_at"])
    payload = F.concat(F.regexp_replace(F.coalesce(current["raw_payload"], F.lit("{}")), "\\}$", ""), F.when(F.coalesce(current["raw_payload"], F.lit("{}")) == "{}", "").otherwise(","), F.lit('"mergedWeeklyFeed":'), F.coalesce(candidate["raw_payload"], F.lit("{}")), F.lit("}"))
    new = {
        "description": T.longer_text(current["description"], candidate["description"]), "starts_at": start, "starts_at_precision": F.when(exact, candidate["starts_at_precision"]).otherwise(current["starts_at_precision"]),
        "ticket_url": F.coalesce(current["ticket_url"], candidate["ticket_url"]), "image_url": F.coalesce(current["image_url"], candidate["image_url"]), "artists": F.when(known, current["artists"]).otherwise(candidate["artists"]),
        "artist_extraction_kind": F.when(known, current["artist_extraction_kind"]).otherwise(candidate["artist_extraction_kind"]), "raw_payload": payload,
    }
    out = current
    for name, value in new.items():
        out = out.withField(name, value)
    return out


# --- a REST list whose details are cached by version ---------------------------------------------------------------


def read_ellington(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REST_EVENT).option("multiLine", True).json(path)


#: Where an event's page has its times and images.
CLUB_NODES = {
    "field": ".jet-listing-dynamic-field__content", "range": ".tc_event_date_title_front", "body": "body", "secure": 'meta[property="og:image:secure_url"]', "og": 'meta[property="og:image"]', "twitter": 'meta[name="twitter:image"]', "preload": 'link[rel="preload"][as="image"]',
    "featured": ".elementor-widget-theme-post-featured-image img",
}
CLUB_START = "(?i)Event Start Date\\s*&\\s*Time:\\s*([A-Za-z]+\\s+[0-9]{1,2},\\s*[0-9]{4}\\s+[0-9]{1,2}:[0-9]{2}(?:\\s*(?:am|pm))?)"
CLUB_RANGE = "(?i)^([0-9]{1,2} [A-Za-z]+ [0-9]{4}) ([0-9]{1,2}(?::[0-9]{2})? ?(?:am|pm)) ?- ?([0-9]{1,2}(?::[0-9]{2})? ?(?:am|pm))$"


def ellington_details(pages: DataFrame) -> DataFrame:
    """link, starts_at, ends_at, image_url, start_text, range_text and _error of landed event pages (page_id, url, html).

    The start is that of the first field that names it, or else of the range; an end before it is on the next day. The
    image is the first of the head's, then of the featured one's sources.
    """
    rows = pages.select("page_id", clean_url(F.col("url")).alias("link"), N.mark(F.col("html"), CLUB_NODES).alias("_n"))
    n = F.col("_n")
    texts = F.transform(F.concat(N.labelled(n, "field"), N.labelled(n, "body")), lambda x: T.collapse(x["text"]))
    starts = F.filter(F.transform(texts, lambda t: F.regexp_extract(t, CLUB_START, 1)), lambda t: t != "")
    within = T.collapse(N.first(n, "range")["text"])
    rows = rows.withColumn("start_text", F.get(starts, 0)).withColumn("range_text", F.nullif(within, F.lit("")))
    at = lambda i: D.parse_club_time(F.concat_ws(" ", F.regexp_extract("range_text", CLUB_RANGE, 1), F.regexp_extract("range_text", CLUB_RANGE, i)))
    rows = rows.withColumn("_from", at(2)).withColumn("ends_at", D.end_after(F.col("_from"), at(3)))
    head = F.array(*(N.first_attr(n, k, "content") for k in ("secure", "og", "twitter")), N.first_attr(n, "preload", "href"))
    lazy = lambda x: F.array(*(F.element_at(x["attrs"], k) for k in ("src", "data-src")), *(first_srcset_url(F.element_at(x["attrs"], k)) for k in ("srcset", "data-srcset")))
    images = F.filter(F.concat(head, F.flatten(F.transform(N.labelled(n, "featured"), lazy))), lambda u: F.trim(u).rlike("^https?://[^/\\s]+"))
    start = F.when(F.col("start_text").isNotNull(), D.parse_club_time(F.col("start_text"))).otherwise(F.col("_from"))
    out = rows.select("page_id", "link", start.alias("starts_at"), "ends_at", F.trim(F.get(images, 0)).alias("image_url"), F.coalesce("start_text", "range_text").alias("start_text"), "range_text")
    return out.withColumn("_error", F.when(F.col("starts_at").isNull(), "no start time"))


def read_ellington_with_details(spark: SparkSession, path: str) -> DataFrame:
    """The landed list (`list`, JSON) with the times and images of its landed event pages (`pages`, Parquet: page_id, url,
    html), by the event's link; of several pages of a link the last one counts."""
    found = ellington_details(spark.read.parquet(f"{path}/pages"))
    last = found.groupBy("link").agg(F.max_by(F.struct("starts_at", "ends_at", "image_url"), "page_id").alias("d"))
    events = read_ellington(spark, f"{path}/list")
    return events.join(last.select(F.col("link").alias("_link"), "d.*"), clean_url(F.col("link")) == F.col("_link"), "left").drop("_link")


#: Where a linked event's page has its image.
IMAGE_NODES = {"og": "meta[property='og:image']", "twitter": "meta[name='twitter:image']", "data": "script[type='application/ld+json']"}


def linked_event_url(ticket_url: Column) -> Column:
    """The event page behind a community ticket link, without query and the way to its tickets; null for other hosts."""
    url = F.regexp_replace(clean_url(ticket_url), "[?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(url, "/tickets$", ""), "(?<=[^/])/$", "")
    return F.when((host(url) == "humanitix.com") | host(url).endswith(".humanitix.com"), bare)


def linked_images(pages: DataFrame) -> DataFrame:
    """(url, image_url) of landed linked pages: the head's image, else the first URL under an image key of the JSON-LD."""
    rows = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"), N.mark(F.col("html"), IMAGE_NODES).alias("_n"))
    n = F.col("_n")
    data = F.filter(F.transform(N.labelled(n, "data"), lambda x: F.regexp_extract(x["text"], '"(?:image|thumbnailUrl)"\\s*:\\s*(?:\\[\\s*)?(?:\\{[^{}]*?"url"\\s*:\\s*)?"(https?:[^"]+)"', 1)), lambda u: u != "")
    image = F.coalesce(clean_url(N.first_attr(n, "og", "content")), clean_url(N.first_attr(n, "twitter", "content")), clean_url(F.replace(F.get(data, 0), F.lit("\\/"), F.lit("/"))))
    return rows.select("url", image.alias("image_url")).where("image_url IS NOT NULL").groupBy("url").agg(F.min("image_url").alias("image_url"))


def with_linked_images(listings: DataFrame, images: DataFrame) -> DataFrame:
    """listings whose image is missing with that of the page that their ticket link leads to, which the payload names."""
    side = images.select(F.col("url").alias("_page"), F.col("image_url").alias("_image"))
    rows = listings.withColumn("_wanted", F.when(F.col("image_url").isNull(), linked_event_url(F.col("ticket_url")))).join(side, F.col("_wanted") == F.col("_page"), "left")
    more = F.to_json(F.struct(F.col("_image").alias("derivedLinkedImageUrl"), F.col("_page").alias("derivedLinkedImageSourceUrl")))
    body = F.coalesce("raw_payload", F.lit("{}"))
    merged = F.when(F.trim(body) == "{}", more).otherwise(F.concat(F.regexp_replace(body, "\\}\\s*$", ","), F.substring(more, F.lit(2), F.length(more))))
    rows = rows.withColumn("raw_payload", F.when(F.col("_image").isNotNull(), merged).otherwise(F.col("raw_payload"))).withColumn("image_url", F.coalesce("image_url", "_image"))
    return rows.drop("_wanted", "_page", "_image")


def normalise_ellington_rows(rows: DataFrame) -> DataFrame:
    own = ("starts_at", "ends_at", "image_url")
    return normalise_ellington(rows.drop(*own), rows.select("id", *own))


def ellington_title(value: Column) -> Column:
    """Breaks become ` - `, once."""
    lines = F.regexp_replace(F.coalesce(value, F.lit("")), "(?i)\\[br\\]|<br\\s*/?>", "\n")
    joined = F.regexp_replace(T.normalise_space(F.regexp_replace(F.regexp_replace(lines, "<[^>]+>", ""), "\\s*\\n+\\s*", " - ")), "(?:\\s+-\\s+)+", " - ")
    return F.regexp_replace(joined, "^[\\s-]+|[\\s-]+$", "")


def categories(terms: Column) -> Column:
    """Distinct names of the event's category terms, whatever their case; the last spelling wins, in the first one's place."""
    names = F.filter(F.transform(F.filter(F.flatten(terms), lambda t: F.coalesce(t["taxonomy"], F.lit("event_category")) == "event_category"), lambda t: T.collapse(t["name"])), lambda n: F.coalesce(n, F.lit("")) != "")
    keys = F.array_distinct(F.transform(names, F.lower))
    return F.transform(keys, lambda k: F.element_at(F.filter(names, lambda n: F.lower(n) == k), -1))


def first_srcset_url(value: Column) -> Column:
    """The first absolute URL of a srcset."""
    urls = F.transform(F.split(value, ","), lambda part: F.regexp_extract(F.trim(part), "^(\\S+)", 1))
    return F.get(F.filter(urls, lambda u: u.rlike("^https?://[^/\\s]+")), 0)


def cached_details(events: DataFrame, cached: DataFrame) -> DataFrame:
    """events with `detail`, the stored one if it is of the event's version and whole, else null: read the page then.

    events: id, detail_version. cached: external_id, raw_payload (JSON with detailVersion, startsAt, endsAt,
    eventStartText, eventDateRangeText, imageUrl).
    """
    body = "detailVersion string, startsAt string, endsAt string, eventStartText string, eventDateRangeText string, imageUrl string"
    parsed = cached.select(F.col("external_id").alias("_ext"), F.from_json("raw_payload", body).alias("d"))
    ok = F.try_to_timestamp("d.startsAt").isNotNull() & (F.col("d.endsAt").isNull() | F.try_to_timestamp("d.endsAt").isNotNull()) & (F.trim(F.coalesce("d.eventStartText", F.lit(""))) != "") & (F.col("d.imageUrl").isNull() | F.col("d.imageUrl").rlike("^https?://"))
    usable = parsed.where(F.coalesce(ok, F.lit(False))).groupBy("_ext", F.col("d.detailVersion").alias("_version")).agg(F.max("d").alias("detail"))
    return events.join(usable, (F.col("id").cast("string") == F.col("_ext")) & (F.col("detail_version") == F.col("_version")), "left").drop("_ext", "_version")


def normalise_ellington(events: DataFrame, details: DataFrame) -> DataFrame:
    """Listings of the list with their details: id, starts_at, ends_at, image_url of cached or read pages.

    The checksum holds the detail's version, so that a new version counts as a change.
    """
    rows = events.join(details.select("id", "starts_at", "ends_at", "image_url"), "id", "left")
    rows = rows.withColumn("_title", ellington_title(F.col("title.rendered"))).withColumn("_url", clean_url(F.col("link"))).withColumn("_lines", T.html_lines(F.col("content.rendered")))
    text = F.nullif(F.array_join("_lines", " "), F.lit(""))
    state = F.concat_ws(" ", "_title", text)
    status = F.when(state.rlike("(?i)\\bcancell?ed\\b"), "cancelled").when(state.rlike("(?i)\\bpostponed\\b|\\brescheduled\\b"), "postponed").otherwise("active")
    versioned = F.when(F.col("modified_gmt").isNotNull(), F.concat("_url", F.lit("#detail-version="), F.url_encode("modified_gmt"))).otherwise(F.col("_url"))
    rows = rows.withColumn("_lineup", ellington_names(F.col("_title"), F.col("content.rendered")))
    return _listing(
        rows, ELLINGTON, _place(ELLINGTON_PLACE), external_id=F.col("id").cast("string"), source_url=F.col("_url"), title=F.col("_title"), description=text, status=status, starts_at=F.col("starts_at"), ends_at=F.col("ends_at"), image_url=F.col("image_url"), ticket_url=F.col("_url"),
        artists=normalise_names(F.col("_lineup.names")), kind=F.col("_lineup.kind"), raw_payload=F.to_json(F.struct("id", "link", "modified_gmt", "title", "content")), checksum_url=versioned, place=F.struct(F.lit("rest").alias("f"), F.col("id").alias("n")),
    )


def repaired_club_names(stored: DataFrame) -> DataFrame:
    """(id, artists, kind) taken anew from stored payloads (id, raw_payload); rows without a title are left out."""
    body = F.from_json("raw_payload", "title struct<rendered:string>, content struct<rendered:string>")
    rows = stored.select("id", body.alias("p")).where("p.title.rendered IS NOT NULL").select("id", ellington_names(ellington_title(F.col("p.title.rendered")), F.col("p.content.rendered")).alias("x"))
    names = normalise_names(F.col("x.names"))
    return rows.select("id", names.alias("artists"), F.when(F.size(names) == 0, "unknown").otherwise(F.col("x.kind")).alias("kind"))


# --- rows of ticket sites ---------------------------------------------------------------------------------------


def show_url(url: Column) -> Column:
    """(url, external_id) of a result row's link: the show page with its show code and, if there is one, venue variant."""
    show, variant = query_value(url, "sh"), query_value(url, "v")
    more = F.when(variant != "", F.concat(F.lit("&v="), variant)).otherwise("")
    full = F.concat(F.lit("https://"), F.regexp_extract(url, "^(?:https?:)?//([^/?#]+)", 1), F.lit("/Shows/Show.aspx?sh="), show, more)
    return F.when(show != "", F.struct(full.alias("url"), F.when(variant != "", F.concat_ws(":", show, variant)).otherwise(show).alias("external_id")))


def owned_event(url: Column) -> Column:
    """(url, external_id) of an event page of the ticket site's own hosts, without query and fragment; else null."""
    h, path = host(url), path_of(url)
    own = F.exists(F.array(*map(F.lit, ("eventbrite.com.au", "eventbrite.com", "eventbrite.co"))), lambda s: (h == s) | h.endswith(F.concat(F.lit("."), s)))
    number = F.regexp_extract(path, "-([0-9]+)/?$", 1)
    return F.when(url.startswith("https://") & own & path.startswith("/e/") & (number != ""), F.struct(F.regexp_replace(url, "[?#].*$", "").alias("url"), number.alias("external_id")))


def place_of_location(location: Column) -> Column:
    """(name, suburb) of `Hall, Suburb, WA`."""
    parts = F.filter(F.transform(F.split(T.collapse(location), ","), lambda x: F.trim(x)), lambda p: p != "")
    parts = F.when(F.lower(F.element_at(parts, -1)).isin("wa", "western australia"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return T.let(parts, lambda p: F.struct(F.when(F.size(p) >= 2, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ", ")).otherwise(T.collapse(location)).alias("name"), F.when(F.size(p) >= 2, F.element_at(p, -1)).alias("suburb")))


def joined_description(title: Column, *pieces: Column) -> Column:
    """Pieces that aren't blank nor the title, joined by a dash; null if none is left."""
    clean = [T.collapse(F.coalesce(p, F.lit(""))) for p in pieces]
    return F.nullif(F.concat_ws(" — ", *(F.when((c != "") & (F.lower(c) != F.lower(title)), c) for c in clean)), F.lit(""))


def normalise_ticketek(rows: DataFrame) -> DataFrame:
    """Listings of result rows: url, title, subtitle, summary, location, date_text, n (order), by gates and dates.

    Rows near the city whose class isn't non-music; each show code once. Unknown ones stay with `music_class` unknown
    for `gates.verify_listings`. Rows whose link has no show code, or without a date, are listed with an error.
    """
    if "image_url" not in rows.columns:
        rows = rows.withColumn("image_url", F.lit(None).cast("string"))
    rows = apart(rows.withColumn("_link", show_url(F.col("url")))).where(gates.near_perth_text(F.col("location"))).withColumn("music_class", gates.ticketek_class(F.col("title"), F.col("subtitle"), F.col("summary"), F.col("location")))
    rows = rows.where("music_class != 'non-music'").withColumn("_title", T.normalise_space(F.col("title"))).withColumn("_start", D.parse_day_text(F.col("date_text")))
    rows = spread(rows.withColumn("_key", F.coalesce(F.col("_link.external_id"), F.to_json("n"))), "_key")  # what follows takes long for a row
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("n"))).where("_rn = 1")
    place = first.withColumn("_p", place_of_location(F.col("location")))
    name = T.venue_name(F.col("_p.name"))
    venue = F.struct(name.alias("name"), T.venue_slug(name).alias("slug"), T.venue_suburb(name, F.col("_p.suburb")).alias("suburb"), T.venue_address(name, F.lit("")).alias("address"), F.lit(None).cast("string").alias("website_url"))
    place = apart(place.withColumn("_venue", venue))
    return _listing(
        place, "ticketek-wa", F.col("_venue"), external_id=F.col("_link.external_id"), source_url=F.coalesce(F.col("_link.url"), F.col("url")), image_url=F.col("image_url"), title=F.col("_title"), description=joined_description(F.col("_title"), F.col("subtitle"), F.col("summary")), starts_at=F.col("_start"), precision=F.lit("date"), ticket_url=F.col("_link.url"),
        artists=ticketek_names(F.col("_title"), F.col("subtitle"), F.col("summary")), kind=F.lit("parsed_text"), raw_payload=F.to_json(F.struct("url", "title", "subtitle", "summary", "location", "date_text", "music_class")), place=F.struct(F.lit("row").alias("f"), F.col("n").alias("n")), error=F.when(F.col("_link").isNull(), "no show code"),
    )


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many keys (id, url) both lists have alike, and what each has that the other lacks or has otherwise."""
    a, b = left.select("id", F.col("url").alias("a_url")).distinct(), right.select("id", F.col("url").alias("b_url")).distinct()
    both = a.join(b, "id", "full")
    same = F.col("a_url") == F.col("b_url")
    return both.agg(F.count_if(same).alias("agreed"), F.count_if(F.col("b_url").isNull()).alias("only_left"), F.count_if(F.col("a_url").isNull()).alias("only_right"), F.count_if(F.col("a_url") != F.col("b_url")).alias("differing"))
