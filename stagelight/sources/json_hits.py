"""Search-index hits (one schema, three sources): filters, music gate, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.functions import text as T
from stagelight.functions.artists import extraction
from stagelight.functions.dates import day_key, parse_utc
from stagelight.functions.lineups import guests, milk_bar_names, with_oztix_names
from stagelight.functions.merging import listing_status
from stagelight.functions.urls import clean_url, drop_image_size, image_area, within_km
from stagelight.operators.dealing import apart

HIT = (
    "EventGuid string, EventName string, SpecialGuests string, EventDescription string, HomepageImage string, EventImage1 string, DateStart string, DateEnd string, EventUrl string, "
    "Categories array<string>, _geoloc struct<lat:double,lng:double>, Venue struct<Name:string,Address:string,Locality:string,State:string,WebsiteUrl:string,Timezone:string>, "
    "Bands array<string>, Performances array<struct<Name:string>>, TourName string, IsCancelled boolean, IsPostponed boolean, IsRescheduled boolean, AffectedBy string, HasEventDatePassed boolean"
)
CENTRE, RADIUS_KM = (-31.9523, 115.8613), 32
#: Words of categories and texts.
MUSIC = ("music", "pop", "dance", "electronic", "hip hop", "house", "tech house", "techno", "indie", "alternative", "rock", "metal", "punk", "hardcore", "emo", "folk", "country", "blues", "jazz", "soul", "funk", "disco", "reggae", "dj")
NOT_MUSIC = ("comedy", "theatre", "theater", "arts", "attractions", "cabaret", "burlesque", "class", "classes", "membership", "memberships", "sports", "sport", "podcast")
NOT_A_GIG = "(?i)\\b(?:class(?:es)?|workshops?|masterclass(?:es)?|introduction to|hands-on|panelists?|professional development|cheesemaking|materials?\\s+(?:and|&)\\s+ingredients\\s+provided|take home everything you make)\\b"
A_GIG = "(?i)\\b(?:djs?|bands?|tribute|concert|tour|festival|rave|launch|orchestra|choir|songbook|album|rock|metal|punk|jazz|hip hop|house|techno|emo|indie|folk|blues|country|pop)\\b"
ROSEMOUNT_VENUES = ("rosemount-hotel", "four5nine-bar-rosemount", "the-rosemount-hotel")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses (`results[].hits[]`), with their order. The order is that of files and places in them."""
    raw = spark.read.schema(f"results array<struct<hits:array<struct<{_fields(HIT)}>>>>").option("multiLine", True).json(path)
    hits = raw.select(F.col("_metadata.file_path").alias("f"), F.posexplode("results").alias("r", "result")).select("f", "r", F.posexplode("result.hits").alias("i", "hit"))
    return hits.select("hit.*", F.struct("f", "r", "i").alias("_place"))


def _fields(ddl: str) -> str:
    depth, out, parts = 0, "", []
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(out.strip())
            out = ""
        else:
            out += c
    return ",".join(f"`{p.split(' ', 1)[0]}`:{p.split(' ', 1)[1]}" for p in [*parts, out.strip()])


def structured_artists() -> Column:
    bands = F.coalesce("Bands", F.array().cast("array<string>"))
    return F.concat(bands, F.transform(F.coalesce("Performances", F.array().cast("array<struct<Name:string>>")), lambda p: p["Name"]))


def guest_artists() -> Column:
    """Guests of a line such as `with A, B and C`."""
    return guests(T.normalise_space(F.regexp_replace(F.coalesce("SpecialGuests", F.lit("")), "<[^>]+>", " ")))


def description() -> Column:
    text = F.concat_ws(" ", F.array_join(T.html_lines(F.col("SpecialGuests")), " "), F.array_join(T.html_lines(F.col("EventDescription")), " "))
    clean = T.normalise_space(text)
    return F.when(clean != "", clean)


def is_music(description_text: Column) -> Column:
    """No class or workshop without artists; then music categories; other categories need artists and a music word;
    then named artists."""
    names = F.size(F.filter(structured_artists(), lambda a: F.coalesce(F.trim(a), F.lit("")) != ""))
    categories = F.transform(F.coalesce("Categories", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))
    has = lambda words: F.exists(categories, lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w)))
    text = F.concat_ws(" \n ", "EventName", description_text)
    return F.when(text.rlike(NOT_A_GIG) & (names == 0), False).when(has(MUSIC), True).when(has(NOT_MUSIC), (names > 0) & text.rlike(A_GIG)).otherwise((names > 0) | (F.size(guest_artists()) > 0))


def preferred_image() -> Column:
    """The larger of two by the area in their URLs; one without an area comes second."""
    one = lambda c, i: F.struct(F.coalesce(-image_area(clean_url(F.col(c))), F.lit(1)).alias("rank"), F.lit(i).alias("i"), drop_image_size(clean_url(F.col(c))).alias("url"))
    listed = F.array_sort(F.filter(F.array(one("EventImage1", 0), one("HomepageImage", 1)), lambda x: x["url"].isNotNull()))
    return F.get(listed, 0)["url"]


def _records(hits: DataFrame, slug: str, title: Column, source_url: Column, image: Column, venue: Column, rescheduled: bool, artists: Column | None = None) -> DataFrame:
    start = parse_utc(F.col("DateStart"))
    named = hits.withColumn("_title", title).withColumn("_start", start).withColumn("_url", source_url).withColumn("_venue", venue)
    own, guests = extraction(structured_artists(), "structured"), extraction(guest_artists(), "explicit_lineup")
    chosen = F.when(F.size(own["artists"]) > 0, own).otherwise(guests) if artists is None else artists
    status = listing_status(F.col("_title"), F.col("IsCancelled"), F.coalesce("IsPostponed", F.lit(False)) | F.coalesce("IsRescheduled", F.lit(False)), F.col("AffectedBy"), rescheduled)
    out = named.select(
        F.lit(slug).alias("source_slug"), F.nullif(F.trim("EventGuid"), F.lit("")).alias("external_id"), F.col("_url").alias("source_url"), image.alias("image_url"), F.col("_title").alias("title"),
        F.col("_description").alias("description"), status.alias("status"), F.col("_start").alias("starts_at"), F.lit("exact").alias("starts_at_precision"), parse_utc(F.col("DateEnd")).alias("ends_at"),
        F.col("_url").alias("ticket_url"), F.col("_venue").alias("venue"), chosen["artists"].alias("artists"), chosen["kind"].alias("artist_extraction_kind"), F.to_json(F.struct(*[c for c in hits.columns if c[0] != "_"])).alias("raw_payload"),
        T.gig_checksum(F.lit(slug), F.col("_start"), F.col("_title"), F.col("_venue.slug"), F.col("_url")).alias("checksum"), "_place",
        F.when((F.coalesce("_title", F.lit("")) == "") | F.col("_start").isNull(), "no title or start").alias("_error"),
    )
    return with_ordinals(out)


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Listings in order of start and title, the failed ones last; one source's listings fit one sorted task."""
    w = Window.partitionBy("source_slug").orderBy(F.col("_error").isNotNull(), "starts_at", "title", "_place")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).drop("_place")


def _venue(name: Column, suburb: Column, address: Column, website: Column) -> Column:
    n = T.venue_name(name)
    return F.struct(n.alias("name"), T.venue_slug(n).alias("slug"), suburb.alias("suburb"), address.alias("address"), T.venue_website(n, website).alias("website_url"))


def normalise_oztix(hits: DataFrame) -> DataFrame:
    """Coming hits of the metro area that are music."""
    near = within_km(F.col("_geoloc.lat"), F.col("_geoloc.lng"), CENTRE, RADIUS_KM)
    rows = hits.where(~F.coalesce("HasEventDatePassed", F.lit(False)) & near).withColumn("_description", description())
    rows = rows.where(is_music(F.col("_description")))
    name = F.coalesce(F.col("Venue.Name"), F.lit("Oztix Venue"))
    venue = _venue(name, T.venue_suburb(name, F.col("Venue.Locality")), T.venue_address(name, F.col("Venue.Address")), clean_url(F.col("Venue.WebsiteUrl")))
    url = F.coalesce(clean_url(F.col("EventUrl")), F.lit("https://www.oztix.com.au/search?states%5B0%5D=WA&q="))
    rows = rows.withColumn("_structured", structured_artists()).withColumn("_guests", T.normalise_space(F.regexp_replace(F.coalesce("SpecialGuests", F.lit("")), "<[^>]+>", " "))).withColumn("_lines", T.html_lines(F.col("EventDescription"))).withColumn("_name", T.question_mark_title(F.col("EventName")))
    named = apart(with_oztix_names(apart(rows), "_name", "_structured", "_guests", "_lines")).withColumnsRenamed({"artists": "_artists", "artist_kind": "_kind"})
    return _records(named, "oztix-wa", F.col("_name"), url, preferred_image(), venue, True, F.struct(F.col("_artists").alias("artists"), F.col("_kind").alias("kind")))


def normalise_rosemount(hits: DataFrame) -> DataFrame:
    """Hits at the hotel's venues."""
    name = F.coalesce(F.col("Venue.Name"), F.lit("Rosemount Hotel"))
    rows = hits.where(~F.coalesce("HasEventDatePassed", F.lit(False))).where(T.venue_slug(F.col("Venue.Name")).isin(*ROSEMOUNT_VENUES)).withColumn("_description", description())
    clean = lambda c: F.nullif(T.normalise_space(c), F.lit(""))
    venue = _venue(name, F.coalesce(clean(F.col("Venue.Locality")), F.lit("North Perth")), clean(F.col("Venue.Address")), F.coalesce(clean_url(F.col("Venue.WebsiteUrl")), F.lit("https://rosemounthotel.com.au/")))
    url = F.coalesce(clean_url(F.col("EventUrl")), F.lit("https://www.rosemounthotel.com.au/"))
    return _records(rows, "rosemount-hotel", T.question_mark_title(F.col("EventName")), url, preferred_image(), venue, True)


STATUS_SUFFIX = "(?i)\\s*[-–—:]?\\s*\\b(?:sold\\s*out|waitlist(?:ed)?|selling\\s*fast)\\b[!.]?\\s*$"


def normalise_milk_bar(hits: DataFrame) -> DataFrame:
    """All hits; of titles that differ by a ticket status, the better one."""
    rows = hits.withColumn("_description", description())
    name = F.coalesce(F.col("Venue.Name"), F.lit("Milk Bar"))
    venue = _venue(name, T.venue_suburb(name, F.col("Venue.Locality")), T.venue_address(name, F.col("Venue.Address")), clean_url(F.col("Venue.WebsiteUrl")))
    url = F.coalesce(F.nullif(F.trim("EventUrl"), F.lit("")), F.lit("https://www.milkbarperth.com.au/"))
    rows = rows.withColumn("_lines", T.html_lines(F.col("EventDescription")))
    found = milk_bar_names(F.col("_lines"), structured_artists(), F.col("SpecialGuests"), F.coalesce("EventName", F.lit("")))
    return without_status_variants(_records(rows, "milk-bar", T.normalise_space(F.col("EventName")), url, F.lit(None).cast("string"), venue, False, found))


def without_status_variants(rows: DataFrame) -> DataFrame:
    """Of listings of one venue, day and canonical title of which some have a status suffix and some have not, the
    one without the suffix, with more artists, with the shorter title; other groups stay whole."""
    keys = [F.col("venue.slug"), day_key(F.col("starts_at")), T.canonical_title(F.col("title"))]
    suffix = F.col("title").rlike(STATUS_SUFFIX)
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_suffix", suffix).withColumn("_some", F.max(suffix.cast("int")).over(w)).withColumn("_rn", F.row_number().over(w.orderBy("_suffix", F.desc(F.size("artists")), F.length("title"), "ordinal")))
    return marked.where(F.col("_error").isNotNull() | (F.col("_some") == 0) | (F.col("_rn") == 1)).drop("_suffix", "_some", "_rn")
