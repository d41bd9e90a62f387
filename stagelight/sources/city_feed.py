"""A city feed of events with a side list of popular ones that have images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.functions import text as T
from stagelight.functions.artists import distinct_by, extraction
from stagelight.functions.dates import parse_local, parse_start
from stagelight.functions.urls import clean_url, host, path_of
from stagelight.operators.ranking import best_row, last_per_key
from stagelight.sources.json_hits import _venue, with_ordinals

PAGE = (
    "total int, events array<struct<title:string,id:string,discoveryId:string,dates:struct<startDate:string,endDate:string,spanMultipleDays:boolean>,url:string,partnerEvent:boolean,isPartner:boolean,"
    "venue:struct<city:string,name:string,state:string,url:string,imageUrl:string,addressLineOne:string,code:string>,timeZone:string,cancelled:boolean,postponed:boolean,rescheduled:boolean,tba:boolean,soldOut:boolean,virtual:boolean,"
    "artists:array<struct<name:string,url:string,imageUrls:struct<ARTIST_PAGE_3_2:string,RETINA_PORTRAIT_16_9:string>>>>>, "
    "popularEvents array<struct<name:string,venue:string,imageUrl:string,url:string,localDate:string,localTime:string>>"
)
#: Localities of the metro area.
METRO = (
    "perth", "east perth", "west perth", "north perth", "northbridge", "burswood", "subiaco", "claremont", "mt claremont", "mount claremont", "nedlands", "leederville", "mount lawley", "inglewood",
    "maylands", "highgate", "victoria park", "como", "south perth", "fremantle", "north fremantle", "scarborough", "joondalup", "cannington", "guildford", "midland", "lathlain",
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of landed pages with the image of the popular event of their URL, the last one listed."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("_f", F.col("_metadata.file_path"))
    popular = pages.select("_f", F.posexplode("popularEvents").alias("i", "p")).select(clean_url(F.col("p.url")).alias("_event_url"), clean_url(F.col("p.imageUrl")).alias("popular_image"), F.struct("_f", "i").alias("n")).where("_event_url is not null and popular_image is not null")
    images = last_per_key(popular, ["_event_url"], "n", ["popular_image"])
    events = pages.select("_f", F.posexplode("events").alias("i", "e")).select("e.*", F.struct("_f", "i").alias("_place")).withColumn("_event_url", clean_url(F.col("url")))
    return events.join(images, "_event_url", "left")


def normalise_events(events: DataFrame) -> DataFrame:
    """Direct events of the metro area (a missing locality passes), the first of each id."""
    url = F.col("_event_url")
    direct = host(url).endswith("ticketmaster.com.au") & path_of(url).rlike("(?i)/event/[^/?#]+")
    norm = lambda c: F.lower(T.normalise_space(F.coalesce(c, F.lit(""))))
    city, state = norm(F.col("venue.city")), norm(F.col("venue.state"))
    own = ~(F.coalesce("isPartner", F.lit(False)) | F.coalesce("partnerEvent", F.lit(False)))
    rows = events.where(own & direct & state.isin("", "wa") & (city.isin(*METRO) | (city == "")))
    ext = F.coalesce(F.nullif(F.regexp_extract(url, "(?i)/event/([^/?#]+)", 1), F.lit("")), F.nullif(F.trim("id"), F.lit("")))
    rows = rows.withColumn("external_id", ext).withColumn("_title", T.normalise_space(F.coalesce("title", F.lit("")))).withColumn("_start", parse_start(F.col("dates.startDate")))
    place = F.coalesce(F.col("venue.name"), F.lit("Ticketmaster Venue"))
    rows = rows.withColumn("_venue", _venue(place, T.venue_suburb(place, T.title_case(F.col("venue.city"))), T.venue_address(place, F.col("venue.addressLineOne")), clean_url(F.col("venue.url"))))
    rows = best_row(rows, ["external_id"], [F.col("_place")])
    names = distinct_by(F.filter(F.transform(F.coalesce("artists", F.array().cast(dict(events.dtypes)["artists"])), lambda a: F.trim(a["name"])), lambda n: F.coalesce(n, F.lit("")) != ""), F.lower)
    picks = F.transform("artists", lambda a: F.coalesce(a["imageUrls"]["RETINA_PORTRAIT_16_9"], a["imageUrls"]["ARTIST_PAGE_3_2"]))
    image = F.coalesce("popular_image", clean_url(F.get(F.filter(picks, lambda x: F.coalesce(x, F.lit("")) != ""), 0)))
    status = F.when(F.coalesce("cancelled", F.lit(False)), "cancelled").when(F.coalesce("postponed", F.lit(False)) | F.coalesce("rescheduled", F.lit(False)), "postponed").otherwise("active")
    artists = extraction(names, "structured")
    slug = "ticketmaster-au"
    out = rows.select(
        F.lit(slug).alias("source_slug"), "external_id", F.col("_event_url").alias("source_url"), image.alias("image_url"), F.col("_title").alias("title"), F.lit(None).cast("string").alias("description"), status.alias("status"),
        F.col("_start.starts_at").alias("starts_at"), F.col("_start.precision").alias("starts_at_precision"), parse_local(F.col("dates.endDate")).alias("ends_at"), F.col("_event_url").alias("ticket_url"), F.col("_venue").alias("venue"),
        artists["artists"].alias("artists"), artists["kind"].alias("artist_extraction_kind"), F.to_json(F.struct(*[c for c in events.columns if c[0] != "_"])).alias("raw_payload"),
        T.gig_checksum(F.lit(slug), F.col("_start.starts_at"), F.col("_title"), F.col("_venue.slug"), F.col("_event_url")).alias("checksum"), "_place", F.when((F.col("_title") == "") | F.col("_start").isNull(), "no title or start").alias("_error"),
    )
    return with_ordinals(out)
