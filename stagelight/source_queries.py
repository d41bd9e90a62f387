"""Queries of sources: landed hits, feeds and pages made of the driver's tables, through gates and line-ups to listings,
with the DuckDB SQL of what must come out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stagelight.functions import lineups as L
from stagelight.operators import history as H
from stagelight.operators.dealing import apart, dealt, shared, spread
from stagelight.sources import city_feed, feeds, gates, json_hits, json_ld, pages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(1998, 3, 10, 4, 0, tzinfo=timezone.utc)


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = text
        return f

    return add


def part(spark, d, **columns):
    return spread(spark.read.parquet(f"{d}/part.parquet"), "p_partkey").selectExpr("*", *(f"{e} AS {c}" for c, e in columns.items()))


def joined(names):
    return F.array_join(names, "|")


@query(
    """SELECT p_partkey, CASE WHEN n IN (0, 1, 6) THEN 'non-music' WHEN n IN (2, 3) THEN 'music' ELSE 'unknown' END AS class, p_size % 3 = 0 AS near, CASE WHEN n IN (0, 4) THEN 'non-music' WHEN n = 2 THEN 'music' ELSE 'unknown' END AS category,
  CASE WHEN n = 0 THEN 'regional title' WHEN n = 1 THEN 'placeholder venue' WHEN n = 2 THEN 'other state' WHEN n = 3 THEN 'other locality' WHEN n = 4 THEN 'no metro locality' END AS reason, n NOT IN (0, 2) AS offline, n IN (0, 1, 5) AS skip, n IN (1, 3) AS veto, n = 5 AS placeholder, n = 1 AS interstitial,
  CASE n WHEN 0 THEN 'structured_event' WHEN 1 THEN 'url' WHEN 2 THEN 'date' WHEN 3 THEN 'missing_data' ELSE 'other' END AS failure, n = 3 OR n > 4 AS in_metro, greatest(1, p_size) AS pages FROM (SELECT *, p_size % 7 AS n FROM part)"""
)
def s01_gates(spark, d):
    """P6, P7, P9, P12, P14, P15, P19, P20, P22, H11, H12, H23."""
    p = part(spark, d, n="p_size % 7")
    n = F.col("n")
    pick = lambda *v: F.get(F.array(*(F.lit(x) for x in v)), n)
    title = pick("Red Ring - Albany", "Comedy gala", "Ring in Concert", "The Band", "Red Ring", "Red Ring", "Gift Voucher")
    ticket = gates.ticketek_class(pick("A Play", "Comedy gala", "Ring Concert", "x", "x", "x", "Gift voucher"), F.lit(None).cast("string"), F.lit(""), pick("", "", "", "Jazz Club, Perth, WA", "", "", ""))
    kinds = pick("Sport > Golf", "x", "Contemporary Music > Rock", "Other", "Contemporary Music > Comedy", "", "x")
    place = gates.metro_reject_reason(title, pick("Hall", "Various Venues", "Hall", "Hall", "Hall", "Hall", "Perth Hall"), F.lit(None).cast("string"), pick("Perth", "Perth", "Perth", "Albany", "", "Perth", ""), pick("", "", "NSW", "WA", "", "WA", ""))
    offline = gates.offline_by_name(pick("https://schema.org/OnlineEventAttendanceMode", "Offline", "x", "", "", "", ""), pick("Hall", "Hall", "Virtual stage", "Hall", "Hall", "Hall", "Hall"))
    metro = gates.near_perth_venue(pick("", "Albany", "", "Perth", "", "", ""), pick("Hall", "Hall, Albany WA", "Hall", "Hall", "Perth Road", "Hall, East Perth WA", "Claremont, W A, Como WA"))
    html = pick("ok", "Ticketek Australia. Just one device. Security flags", "just one device", "", "", "", "")
    links = F.array(F.concat(F.lit("/s?a=1&page="), F.col("p_size").cast("string"), F.lit("#x")), F.lit("/s?page=x"), F.lit("/s?mypage=900"))
    return p.select(
        "p_partkey", ticket.alias("class"), gates.near_perth_text(F.when(F.col("p_size") % 3 == 0, "Hall, North Perth, WA").otherwise("Hall, Perth")).alias("near"), gates.category_class(F.array(kinds)).alias("category"), place.alias("reason"), offline.alias("offline"),
        gates.skip_before_detail(title, pick("", "", "", "", "", "a Flea Market", "")).alias("skip"), gates.clearly_not_music(pick("", "Comedy gala", "", "Red", "", "", ""), pick("", "", "", "first-class", "", "", "")).alias("veto"), gates.is_placeholder_title(pick("", "", "", "", "", " Past  Event", "x")).alias("placeholder"),
        gates.is_interstitial(html).alias("interstitial"), gates.failure_bucket(pick("did not resolve uniquely", "was redirected: date", "bad date", "missing data", "x", "", "y")).alias("failure"), metro.alias("in_metro"), gates.max_page(links).alias("pages"),
    )


@query(
    """SELECT p_partkey, n NOT IN (0, 1, 5) AND n <> 4 AS strict, n IN (2, 3, 6) AS accepted, n IN (1, 3, 4) AS weekly, n IN (0, 1, 2) AS past, n < 3 AS blank FROM (SELECT p_partkey, p_size % 7 AS n FROM part)"""
)
def s02_music_gates(spark, d):
    """P16, P17, P18, P21, H20, H21."""
    p = part(spark, d, n="p_size % 7")
    n = F.col("n")
    pick = lambda *v: F.get(F.array(*(F.lit(x) for x in v)), n)
    no, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    strict = gates.strict_music(pick("Sound Healing Band", "x", "Live at Home", "x", "x", "Big class tour", "x"), pick("", "Meet new people and a band", "", "a band and a choir", "only disco", "", ""), F.when(n == 6, F.array(F.lit("A"))).otherwise(no), F.when(n == 1, F.array(F.lit("Lineup"))).otherwise(no), no)
    tag = lambda prefix, name: F.struct(F.lit(prefix).alias("prefix"), none.alias("tag"), name.alias("display_name"))
    tags = F.array(tag("EventbriteCategory", F.when(n == 0, "Food").otherwise("Music")), tag("EventbriteFormat", pick("Festival or Fair", "Screening", "Concert or Performance", "Party or Social Gathering", "Party or Social Gathering", "Concert or Performance", "Other")), tag("EventbriteSubCategory", F.when(n == 3, "Techno").otherwise("x")))
    accepted = gates.format_aware_music(tags, F.when(n == 5, "Silent Disco").otherwise("Night"), none, F.when(n == 6, F.array(F.lit("A"))).otherwise(no), F.array(F.lit("https://schema.org/OfflineEventAttendanceMode")), F.lit(True))
    weekly = gates.weekly_music(pick("Trivia and jazz", "Jazz", "Dinner", "Dinner", "Dinner", "", ""), F.when(n == 4, "dnb").otherwise(none), none, none, F.when(n == 3, F.array(F.lit("A"), F.lit("B"))).otherwise(no))
    day = F.date_add(F.lit(datetime(1998, 3, 7).date()), n)
    return p.select("p_partkey", strict.alias("strict"), accepted.alias("accepted"), weekly.alias("weekly"), gates.is_past_day(day, NOW).alias("past"), gates.is_blank_row(F.when(n >= 3, "x"), F.lit(" ")).alias("blank"))


_HITS = "(SELECT p_partkey, p_size, p_size % 6 AS n, p_name, p_brand FROM part)"


@query(
    f"""SELECT 'oztix-wa' AS source, 'e' || p_partkey AS external_id, CASE WHEN n = 1 THEN p_name || ' presents: Ada + Bo' ELSE p_name || ' x' END AS title, CASE WHEN n = 1 THEN 'Ada|Bo|Cy|Di' WHEN n = 5 THEN 'Ada|Bo' ELSE p_name || '|Cy|Di' END AS artists, CASE WHEN n IN (1, 5) THEN 'parsed_text' ELSE 'structured' END AS kind,
  CASE WHEN n = 3 THEN 'cancelled' WHEN n = 2 THEN 'postponed' ELSE 'active' END AS status, CASE WHEN n = 2 THEN 'https://i.example.com/a?x=1' ELSE 'https://i.example.com/b' END AS image, CASE WHEN n = 4 THEN 'the-court' ELSE 'hall-' || p_size END AS venue FROM {_HITS} WHERE n <> 0 AND p_size > 4
UNION ALL SELECT 'rosemount-hotel', 'e' || p_partkey, CASE WHEN n = 1 THEN p_name || ' presents: Ada + Bo' ELSE p_name || ' x' END, CASE WHEN n IN (0, 1, 5) THEN CASE WHEN n = 5 THEN 'Ada|Bo' ELSE 'Cy|Di' END ELSE p_name END, CASE WHEN n IN (0, 1, 5) THEN 'explicit_lineup' ELSE 'structured' END,
  CASE WHEN n = 3 THEN 'cancelled' WHEN n = 2 THEN 'postponed' ELSE 'active' END, CASE WHEN n = 2 THEN 'https://i.example.com/a?x=1' ELSE 'https://i.example.com/b' END, 'rosemount-hotel' FROM {_HITS}"""
)
def s03_hits(spark, d):
    """S3, S4, S6, P5, P13, W19, F-T1 to F-T3, F-T17: search-index hits to listings, by place, music and line-up."""
    p = part(spark, d, n="p_size % 6")
    n, name = F.col("n"), F.col("p_name")
    none = F.lit(None)
    place = F.struct(F.lit("Rosemount Hotel").alias("Name"), none.cast("string").alias("Address"), F.lit("Perth").alias("Locality"), F.lit("WA").alias("State"), none.cast("string").alias("WebsiteUrl"), none.cast("string").alias("Timezone"))
    fields = lambda where: [
        F.concat(F.lit("e"), "p_partkey").alias("EventGuid"), F.when(n == 1, F.concat(name, F.lit(" presents: Ada + Bo"))).otherwise(F.concat(name, F.lit("  x"))).alias("EventName"), F.when(n == 5, "with special guests Ada & Bo").otherwise("with Cy & Di").alias("SpecialGuests"), F.lit("<p>A night.</p>").alias("EventDescription"),
        F.lit("https://i.example.com/b?width=20&height=20").alias("HomepageImage"), F.when(n == 2, "https://i.example.com/a?width=30&height=20&x=1").otherwise("https://i.example.com/c?width=3&height=2").alias("EventImage1"), F.lit("1998-03-20T10:00:00").alias("DateStart"), none.cast("string").alias("DateEnd"), F.concat(F.lit("https://t.example.com/"), "p_partkey").alias("EventUrl"),
        F.when(n == 0, F.array(F.lit("Comedy"))).otherwise(F.array(F.lit("Live Music"))).alias("Categories"), F.struct(F.when(F.col("p_size") > 4, -31.9).otherwise(-33.0).alias("lat"), F.lit(115.86).alias("lng")).alias("_geoloc"), where.alias("Venue"), F.when(n.isin(1, 5, 0), F.array().cast("array<string>")).otherwise(F.array(name)).alias("Bands"),
        F.array().cast("array<struct<Name:string>>").alias("Performances"), none.cast("string").alias("TourName"), (n == 3).alias("IsCancelled"), (n == 2).alias("IsPostponed"), none.cast("boolean").alias("IsRescheduled"), none.cast("string").alias("AffectedBy"), none.cast("boolean").alias("HasEventDatePassed"), F.struct(F.lit("f").alias("f"), F.lit(0).alias("r"), F.col("p_partkey").alias("i")).alias("_place"),
    ]
    hall = F.struct(F.when(n == 4, "The Court Hotel").otherwise(F.concat(F.lit("Hall "), F.col("p_size"))).alias("Name"), *(place[c].alias(c) for c in ("Address", "Locality", "State", "WebsiteUrl", "Timezone")))
    both = json_hits.normalise_oztix(p.where("n != 0").select(*fields(hall))).unionByName(json_hits.normalise_rosemount(p.select(*fields(place))))
    return both.select(F.col("source_slug").alias("source"), "external_id", "title", joined("artists").alias("artists"), F.col("artist_extraction_kind").alias("kind"), "status", F.col("image_url").alias("image"), F.col("venue.slug").alias("venue"))


@query(
    """SELECT 'x' || p_partkey AS external_id, 'https://www.ticketmaster.com.au/e/event/x' || p_partkey AS source_url, p_name || ' &' AS title, p_name || '|' || p_brand AS artists, CASE p_size % 4 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'postponed' ELSE 'active' END AS status,
  CASE WHEN p_size % 5 = 0 THEN 'https://i.example.com/pop' ELSE 'https://i.example.com/r' END AS image, 'date' AS precision FROM part WHERE p_size % 3 <> 0"""
)
def s04_city_feed(spark, d):
    """S9, P8, J9, F-T14: events of the metro area with the image of the popular list; partners and other cities go."""
    p = part(spark, d)
    n, none = F.col("p_size"), F.lit(None).cast("string")
    url = F.concat(F.lit("https://www.ticketmaster.com.au/e/event/x"), "p_partkey", F.lit("?utm_source=a"))
    artist = lambda x: F.struct(x.alias("name"), none.alias("url"), F.struct(F.lit("https://i.example.com/a").alias("ARTIST_PAGE_3_2"), F.lit("https://i.example.com/r").alias("RETINA_PORTRAIT_16_9")).alias("imageUrls"))
    events = p.select(
        F.concat("p_name", F.lit(" &amp; ")).alias("title"), none.alias("id"), none.alias("discoveryId"), F.struct(F.lit("1998-03-20").alias("startDate"), none.alias("endDate"), F.lit(False).alias("spanMultipleDays")).alias("dates"), url.alias("url"), F.lit(False).alias("partnerEvent"), (n % 6 == 0).alias("isPartner"),
        F.struct(F.when(n % 6 == 3, "Sydney").when(n % 2 == 0, "").otherwise("Northbridge").alias("city"), F.lit("Hall").alias("name"), F.lit("WA").alias("state"), none.alias("url"), none.alias("imageUrl"), none.alias("addressLineOne"), none.alias("code")).alias("venue"), none.alias("timeZone"), (n % 4 == 1).alias("cancelled"), (n % 4 == 2).alias("postponed"),
        F.lit(False).alias("rescheduled"), F.lit(False).alias("tba"), F.lit(False).alias("soldOut"), F.lit(False).alias("virtual"), F.array(artist(F.col("p_name")), artist(F.upper("p_name")), artist(F.col("p_brand"))).alias("artists"), F.struct(F.lit("f").alias("_f"), F.col("p_partkey").alias("i")).alias("_place"),
        F.concat(F.lit("https://www.ticketmaster.com.au/e/event/x"), "p_partkey").alias("_event_url"), F.when(n % 5 == 0, "https://i.example.com/pop").alias("popular_image"),
    )
    out = city_feed.normalise_events(events)
    return out.select("external_id", "source_url", "title", joined("artists").alias("artists"), "status", F.col("image_url").alias("image"), F.col("starts_at_precision").alias("precision"))


@query(
    """SELECT CAST(p_partkey + 1000000 AS VARCHAR) AS external_id, p_name || ' & co' AS title, 'Ada|' || p_brand AS artists, CASE p_size % 4 WHEN 1 THEN 'cancelled' ELSE 'active' END AS status, 'https://i.example.com/' || p_partkey AS image, 'hall-' || p_size AS venue, '1998-03-20 11:30:00' AS starts FROM part WHERE p_size % 5 NOT IN (0, 1)"""
)
def s05_pages(spark, d):
    """S10, S11, F-J1, F-J2, F-J4, F-S36, H1 to H3, P10, P11: structured events of pages; online ones and other states go."""
    p = part(spark, d)
    n = F.col("p_size")
    place = F.struct(F.lit("Place").alias("@type"), F.concat(F.lit("Hall "), n).alias("name"), F.struct(F.lit("1 Road").alias("streetAddress"), F.lit("Perth").alias("addressLocality"), F.when(n % 5 == 1, "NSW").otherwise("WA").alias("addressRegion")).alias("address"))
    event = F.struct(
        F.array(F.lit("Thing"), F.lit("MusicEvent")).alias("@type"), F.concat("p_name", F.lit(" &amp; co")).alias("name"), F.concat(F.lit("https://t.example.com/e/"), F.col("p_partkey") + 1000000, F.lit("?utm_x=1")).alias("url"), F.lit("1998-03-20T19:30:00").alias("startDate"),
        F.when(n % 5 == 0, "https://schema.org/OnlineEventAttendanceMode").alias("eventAttendanceMode"), F.when(n % 4 == 1, "https://schema.org/EventCancelled").alias("eventStatus"), F.struct(F.array(F.concat(F.lit("https://i.example.com/"), "p_partkey")).alias("url")).alias("image"), place.alias("location"), F.array(F.lit("Ada"), F.col("p_brand")).alias("performers"),
    )
    body = F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, '), F.to_json(event), F.lit("]}"))
    html = F.concat(F.lit("<html><script>var x = 1;</script><script type=\"application/ld+json\">{bad</script><script type='application/ld+json'>"), body, F.lit("</script>"))
    rows = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://t.example.com/page").alias("url"), html.alias("html"))
    out = json_ld.normaliser("humanitix-perth-music")(rows)
    return out.select("external_id", "title", joined("artists").alias("artists"), "status", F.col("image_url").alias("image"), F.col("venue.slug").alias("venue"), F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts"))


@query(
    """SELECT strftime(DATE '2024-03-10' + CAST(p_size AS INT), '%Y-%m-%d') || '-' || replace(p_name, ' ', '-') || '-' || p_partkey AS external_id, CASE WHEN p_size % 3 = 0 THEN 'exact' ELSE 'date' END AS precision, 'Ada|Bo' AS artists, CASE WHEN p_size % 3 = 0 THEN 'a much longer text of the night' ELSE 'short' END AS description,
  CASE WHEN p_size % 3 = 0 THEN 'https://t.example.com/w' END AS ticket, p_size % 3 = 0 AS merged FROM part WHERE p_size % 4 <> 0
UNION ALL SELECT strftime(DATE '2024-03-10' + CAST(p_size AS INT), '%Y-%m-%d') || '-jazz-' || p_partkey, 'date', '', NULL, 'https://t.example.com/w', false FROM part WHERE p_size % 4 = 0"""
)
def s06_two_feeds(spark, d):
    """S12, J10, H4, H7, F-T16, P18, P21, P22: a venue's two spreadsheets, one listing of each night."""
    p = part(spark, d)
    n, none = F.col("p_size"), F.lit(None).cast("string")
    day = F.date_format(F.date_add(F.lit(datetime(2024, 3, 10).date()), n), "dd/MM/yy")
    name = F.concat_ws(" ", "p_name", "p_partkey")
    columns = lambda **c: [c.get(x.replace(" ", "_"), none).alias(x) for x in ("Date", "Day", "Time", "Event Title", "Title", "Info", "Vibe", "Featuring", "Description", "Ticket Link")]
    place = lambda feed: [F.lit(feed).alias("_f"), F.col("p_partkey").alias("_n"), F.lit("whatson" if "w" in feed else "comingup").alias("feed")]
    first = p.where("p_size % 4 != 0").select(*columns(Date=day, Event_Title=name, Info=F.lit("short"), Featuring=F.concat_ws(",", F.lit("Ada"), F.lit("Bo"), name)), *place("c"))
    second = p.where("p_size % 3 = 0 AND p_size % 4 != 0").select(*columns(Date=day, Title=name, Time=F.lit("7.30pm"), Vibe=F.lit("jazz"), Description=F.lit("a much longer text of the night"), Ticket_Link=F.lit("t.example.com/w?utm_a=1")), *place("w"))
    third = p.where("p_size % 4 = 0").select(*columns(Date=day, Title=F.concat(F.lit("Jazz "), "p_partkey"), Ticket_Link=F.lit("https://t.example.com/w")), *place("w"))
    other = p.select(*columns(Date=F.lit("01/03/24"), Event_Title=F.lit("too late")), *place("c")).unionByName(p.select(*columns(Date=day, Title=F.lit("Pub Quiz rock")), *place("w"))).unionByName(p.select(*columns(Date=day, Event_Title=F.lit("Tomorrow")), *place("c"))).unionByName(p.select(*columns(Day=F.lit("Mon")), *place("c")))
    out = feeds.normalise_bird(first.unionByName(second).unionByName(third).unionByName(other), datetime(2024, 3, 10, 4, 0, tzinfo=timezone.utc))
    return out.select("external_id", F.col("starts_at_precision").alias("precision"), joined("artists").alias("artists"), "description", F.col("ticket_url").alias("ticket"), F.col("raw_payload").contains("mergedWeeklyFeed").alias("merged"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name || ' - ' || p_brand AS title, CASE WHEN p_size % 3 = 0 THEN 'cancelled' WHEN p_size % 3 = 1 THEN 'postponed' ELSE 'active' END AS status, p_size % 2 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AS from_cache, 'JAZZ|' || p_type AS categories, CASE WHEN p_size % 2 = 0 THEN 'https://i.example.com/a.jpg' END AS image FROM part"""
)
def s07_rest_list(spark, d):
    """S13, J11, H5, H6, H9, H10, F-S15: a REST list; details come from the cache where version and shape agree."""
    p = part(spark, d)
    n = F.col("p_size")
    term = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).cast("string").alias("taxonomy"))
    events = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("https://e.example.com/"), "p_partkey").alias("link"), F.concat(F.lit("v"), n).alias("modified_gmt"), F.struct(F.concat("p_name", F.lit("<br/>[br]"), "p_brand", F.lit("<br>")).alias("rendered")).alias("title"),
        F.struct(F.when(n % 3 == 0, "<p>Cancelled</p>").when(n % 3 == 1, "<p>now rescheduled</p>").otherwise("<p>x</p>").alias("rendered")).alias("content"),
        F.struct(F.array(F.array(term(F.lit("Jazz"), "event_category"), term(F.col("p_type"), None)), F.array(term(F.lit("JAZZ"), "event_category"), term(F.lit("tag"), "post_tag"))).alias("wp:term")).alias("_embedded"), F.when(n % 2 == 0, "x, https://i.example.com/a.jpg 300w, https://i.example.com/b.jpg").alias("srcset"),
    )
    payload = F.to_json(F.struct(F.concat(F.lit("v"), F.when(n % 5 == 0, 0).otherwise(n)).alias("detailVersion"), F.when(n % 7 == 0, "soon").otherwise("1998-03-20T11:30:00Z").alias("startsAt"), F.lit("Fri 7pm").alias("eventStartText")))
    cached = p.where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("external_id"), payload.alias("raw_payload"))
    looked = feeds.cached_details(events.withColumn("detail_version", F.col("modified_gmt")), cached)
    details = looked.select("id", F.coalesce(F.try_to_timestamp("detail.startsAt"), F.lit(datetime(1998, 3, 21))).alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), feeds.first_srcset_url(F.col("srcset")).alias("image_url"))
    out = feeds.normalise_ellington(events, details)
    more = looked.select(F.col("id").cast("string").alias("external_id"), F.col("detail").isNotNull().alias("from_cache"), joined(feeds.categories(F.col("_embedded.`wp:term`"))).alias("categories"))
    return out.select("external_id", "title", "status", F.col("image_url").alias("image")).join(more, "external_id")


@query(
    """SELECT 'C' || p_partkey || m || CASE WHEN p_size % 2 = 0 THEN ':V1' ELSE '' END AS external_id, 'https://t.example.com/Shows/Show.aspx?sh=C' || p_partkey || m || CASE WHEN p_size % 2 = 0 THEN '&v=V1' ELSE '' END AS url, 'https://i.example.com/a.jpg' AS image, 3 AS page_count, 1 AS broken, p_name || ' Concert' AS title, 'hall-' || p_size AS venue, 'Perth' AS suburb, CASE WHEN p_size % 3 = 1 THEN 'Ada|Bo' ELSE '' END AS artists,
  CASE WHEN p_size % 3 = 1 THEN 'featuring Ada and Bo — ' ELSE '' END || 'see it' AS description, '1998-03-20 04:00:00' AS starts, CASE WHEN m = 'm' OR p_size % 5 = 0 THEN 'ambiguous' WHEN p_size % 7 = 0 THEN 'rejected' WHEN p_size % 11 = 0 THEN 'ambiguous' ELSE 'accepted' END AS verified FROM part, (VALUES (''), ('m')) v(m) WHERE p_size % 4 <> 0"""
)
def s08_result_rows(spark, d):
    """S8, S15, F-S34, F-S38, F-U6, F-T12, P9, P14, P23, A17, H13, H14: result pages to listings, and their verification."""
    p = part(spark, d)
    n = F.col("p_size")
    button = lambda sh: F.concat(F.lit("<div class='resultBuyNow'><a class=b href='//t.example.com/x.aspx?"), F.when(n % 2 == 0, "v=V1&amp;").otherwise(""), F.lit("sh="), sh, F.lit("&amp;q=1'>Buy</a></div>"))
    row = lambda link: F.concat(F.lit("<div class='contentEventAndDate clearfix'><div class='contentLocation'>Hall <div>"), n, F.lit("</div>, Perth,\n WA</div><div class='contentDate'>Fri 20 Mar 1998</div><p class='contentResultSummary'>see <b>it</b></p>"), link, F.lit("</div>"))
    code = F.concat(F.lit("C"), "p_partkey")
    title = F.when(n % 4 == 0, "Comedy gala").otherwise(F.concat("p_name", F.lit(" <b>Concert</b>")))
    module = lambda inner: F.concat(F.lit("<div class='multi resultModule'><div class='resultContainer'><div class='contentImage'><a href='/x'><img src='//i.example.com/a.jpg'></a></div><div class='contentEvent'><h6>"), title, F.lit("</h6><p class='sub-title'>"), F.when(n % 3 == 1, "featuring Ada and Bo").otherwise(""), F.lit("</p></div>"), inner, F.lit("</div></div>"))
    none = F.lit("")
    html = F.concat(F.lit("<ul><li><a href='/search/SearchResults.aspx?k=x&amp;page=3'>3</a></ul>"), module(F.concat(row(button(code)), row(button(code)), row(F.concat(F.lit("<div class='resultBuyNow'><a href='/nothing?k="), "p_partkey", F.lit("'>x</a></div>"))), row(none))), module(F.concat(row(none), button(F.concat(code, F.lit("m"))))), F.lit("<div class='resultModule'><h6>no event</h6></div>"))
    rows = shared(pages.result_rows(p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))), "n")
    listed = shared(feeds.normalise_ticketek(rows).drop("ordinal"), "external_id")
    key = F.regexp_extract("external_id", "^C([0-9]+)", 1)
    asked = listed.select("external_id", F.col("external_id").alias("listing_id"), key.alias("title_key"), F.regexp_extract("external_id", "^([^:]+)", 1).alias("show_code"), F.date_format("starts_at", "yyyy-MM-dd").alias("date_key"), F.col("venue.slug").alias("venue_slug"))
    answers = p.select(F.col("p_partkey").cast("string").alias("title_key"), F.col("p_partkey").cast("string").alias("event_title_key"), F.when(n % 5 == 0, "OTHER").otherwise(F.lower(code)).alias("show_code"), F.lit("1998-03-20").alias("date_key"), F.concat(F.lit("hall-"), n).alias("venue_slug"), F.lit("wa").alias("state"))
    kinds = gates.positive_facets(F.create_map(F.when(n % 7 == 0, "Sport > Golf").when(n % 11 == 0, "Other").otherwise("Contemporary Music > Rock"), F.lit(2), F.lit("Theatre"), F.lit(0)))
    responses = p.select(F.col("p_partkey").cast("string").alias("title_key"), kinds.alias("facets"), F.lit(False).alias("has_more"))
    verified = gates.verify_listings(asked, answers, responses).select(F.col("listing_id").alias("external_id"), F.col("status").alias("verified"))
    broken = listed.where("_error IS NOT NULL").groupBy(F.regexp_extract("source_url", "k=([0-9]+)$", 1).alias("title_key")).agg(F.count("*").cast("int").alias("broken"))
    counts = rows.groupBy(F.col("n.page_id").cast("string").alias("title_key")).agg(F.max("page_count").alias("page_count")).join(dealt(broken), "title_key")
    out = listed.join(dealt(counts), counts["title_key"] == key).select("external_id", F.col("source_url").alias("url"), F.col("image_url").alias("image"), "page_count", "broken", "title", F.col("venue.slug").alias("venue"), F.col("venue.suburb").alias("suburb"), joined("artists").alias("artists"), "description", F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts"))
    return out.join(dealt(verified), "external_id")


@query(
    """SELECT p_partkey, 'https://events.humanitix.com/a' || p_partkey || '|https://events.humanitix.com/b' AS events, '/p?page=2' AS next, 1 AS failed, 'https://tixel.com/au/red-tickets/1998/03/20/red-' || p_partkey || '|1998-03-20|Red & Co|Hall' AS card, p_size AS pages, '{"a": {"b": "}' || p_size || '"}}' AS embedded, 'i' || p_partkey AS decoded, '{"id": ' || p_size || '}' AS event_data,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS owned, p_partkey || '|' || p_name || '|https://www.moshtix.com.au/v2/event/red/' || p_partkey || '?x=1|' || CASE WHEN p_size % 5 = 0 THEN '-' ELSE '1998-03-20 11:30' END || '|https://i.example.com/a.jpg|' || CASE WHEN p_size % 2 = 0 THEN 't & u' ELSE '-' END || CASE WHEN p_size % 5 = 0 THEN '|no date' ELSE '|ok' END AS row,
  p_size + 1 AS page_count, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS broken FROM part"""
)
def s09_discovery(spark, d):
    """S14, S16, S17, S18, F-U4, F-U5, F-S40, F-J5 to F-J7: links, cards and data of search and discovery pages."""
    p = part(spark, d)
    n, key = F.col("p_size"), F.col("p_partkey")
    crawl = pages.discovery(F.concat(F.lit("<a class=x href='https://events.humanitix.com/a"), key, F.lit("?c=1'>a</a><a href='https://events.humanitix.com/b/'>b</a><a href='https://events.humanitix.com/b'>b</a><a href='https://events.humanitix.com/x/y'>c</a><a rel='next' href='/p?page=2'>n</a>")))
    card_of = lambda href, inner: F.concat(F.lit("<div data-e2e='music/:event'><a class='c' href='"), href, F.lit("'><div><div><img src=x></div></div>"), F.lit(inner), F.lit("</a></div>"))
    url_of = lambda name: F.concat(F.lit(f"/au/{name}-tickets/1998/03/20/{name}-"), key)
    market = pages.secondary_cards(F.concat(
        *[card_of(url_of("red"), "<div><p class=t><span><strong>Red &amp; <i>Co</i></strong></span> now<p>Hall<p>Perth</div>")] * 2, card_of(F.lit("/au/red-tickets/1998/02/30/red-1"), "<p><strong>No day</strong></p><p>Hall</p>"), card_of(F.concat(url_of("red"), F.lit("?ref=t")), "<p><strong>Tracked</strong></p><p>Hall</p>"),
        card_of(url_of("blue"), "<p><strong>No venue</strong></p><div><p>Hall</p></div>"), F.lit("<a href='"), url_of("green"), F.lit("'><p><strong>No card</strong></p><p>Hall</p></a><a href='https://tixel.com/au/discover/Perth/music-tickets?page="), n, F.lit("'>l</a><a href='https://evil.example.com/au/discover/Perth/music-tickets?page=99'>l</a>"),
    ))
    data = pages.embedded_json(F.concat(F.lit("<script>window.__SERVER_DATA__ = {\"a\":{\"b\":\"}"), n, F.lit("\"}}; x = {};</script>")))
    encoded = F.base64(F.concat(F.lit('{"itemId":"i'), key, F.lit('"}')).cast("binary"))
    owned = feeds.owned_event(F.when(n % 2 == 0, F.concat(F.lit("https://www.eventbrite.com.au/e/red-ring-tickets-"), key, F.lit("?aff=x"))).otherwise(F.concat(F.lit("https://evil.example.com/e/red-"), key)))
    data_of = F.concat(F.lit("<script type='application/ld+json'>[{\"@type\":\"MusicEvent\",\"name\":\""), F.col("p_name"), F.lit("\",\"url\":\"https://x.example.com/v2/event/other/1\",\"startDate\":\""), F.when(n % 5 == 0, "soon").otherwise("1998-03-20T19:30:00"), F.lit("\",\"image\":[\"https://www.moshtix.com.au/uploads/\",\"//i.example.com/a.jpg\"]}]</script>"))
    block = lambda attrs, inner: F.concat(F.lit(f"<div class='searchresult  clearfix' {attrs}><div><div>"), *inner, F.lit("</div></div></div>"))
    main = F.concat(F.lit("<h2 class='main-event-header'><a href='/v2/event/red/"), key, F.lit("?x=1'><span>Heading</span></a></h2><h2>Tue</h2>"))
    search = shared(pages.search_rows(p.select(key.alias("page_id"), F.concat(
        block("data-event-id=' '", (main, F.when(n % 2 == 0, "<p><span> t &amp; <b>u</b></span> <a href=x>more</a></p>").otherwise("<p>t</p>"), data_of)), block("data-event-id='b'", (F.lit("<h2 class='main-event-header'></h2>"),)), F.lit("<div class='searchresult'><h2>no block</h2></div><a href='?Page="), n + 1, F.lit("'>p</a>")
    ).alias("html"))), "page_id")
    row = F.concat_ws("|", "external_id", "title", "url", F.coalesce(F.date_format("starts_at", "yyyy-MM-dd HH:mm"), F.lit("-")), "image_url", F.coalesce("teaser", F.lit("-")), F.coalesce("_error", F.lit("ok")))
    found = search.groupBy(F.col("page_id").alias("p_partkey")).agg(F.max("page_count").alias("page_count"), F.max(F.when(F.col("i") == 0, row)).alias("row"), F.count("_error").alias("broken")).where(F.col("row").isNotNull())
    parts = apart(p.select("p_partkey", "p_size", crawl.alias("crawl"), market.alias("market")))  # each read once
    crawl, market = F.col("crawl"), F.col("market")
    card = F.get(market["cards"], 0)
    out = parts.select(
        "p_partkey", joined(crawl["event_urls"]).alias("events"), joined(crawl["next_urls"]).alias("next"), crawl["failed"].alias("failed"), F.when(F.size(market["cards"]) == 1, F.concat_ws("|", card["url"], card["date_key"], card["title"], card["venue_name"])).alias("card"), market["max_page"].alias("pages"), data.alias("embedded"), pages.base64_id(encoded).alias("decoded"),
        pages.event_data(F.concat(F.lit("x; var moshtixEventData = {\"id\": "), n, F.lit("}; var y = {};"))).alias("event_data"), owned["external_id"].alias("owned"),
    )
    return out.join(dealt(found), "p_partkey")


@query(
    """SELECT p_partkey, 'Ada|Bo' AS section, 'Head|Ada|Bo|Tail|End' AS texts, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'T' END AS title, CASE WHEN p_size % 3 = 0 THEN 'https://c.example.com/' ELSE 'https://o.example.com/' END AS canonical, CASE p_size % 3 WHEN 0 THEN 'own text' WHEN 1 THEN 'Ada' || chr(10) || chr(10) || 'Bo' ELSE 'meta' END AS description, p_size % 2 = 0 AS fallback, p_size % 5 = 0 AS secondary FROM part"""
)
def s10_page_parts(spark, d):
    """H15 to H18, H31, F-S39: sections, visible texts and heads of pages, and events made of them."""
    p = part(spark, d)
    n = F.col("p_size")
    lines = F.array(*map(F.lit, ("Head", "Lineup", "Ada", "Bo", "Ada", "Find events", "Tail", "End")))
    section = pages.section_text(F.array(*map(F.lit, ("x", "Lineup", "Ada", "Bo", "Ada", "Tail", "End"))), F.array(F.lit("Lineup"), F.lit("Tail")), "(?i)line.?up")
    meta = pages.page_meta(F.concat(F.lit("<title>T</title>"), F.when(n % 2 == 0, F.concat(F.lit("<meta content='"), "p_name", F.lit("' property='og:title'>"))).otherwise(""), F.when(n % 3 == 0, "<link rel='canonical' href='https://c.example.com/'>").otherwise(""), F.lit("<meta property='og:url' content='https://o.example.com/'>")))
    told = pages.preferred_description(F.when(n % 3 == 0, "own  text").when(n % 3 == 1, "Get tickets on Humanitix to x"), F.when(n % 3 == 1, F.array(F.lit("Ada"), F.lit("Bo"))).otherwise(F.array().cast("array<string>")), F.lit("meta"))
    made = pages.fallback_event(meta, F.when(n % 2 == 0, "1998-03-20"))
    url = F.lit("https://tixel.com/au/red-tickets/1998/03/20/red-1")
    valid = pages.valid_secondary_event(F.when(n % 5 == 0, "au").otherwise("NZ"), url, url, F.lit(datetime(1998, 3, 19, 20, 0)))
    texts = F.filter(pages.page_text(lines), lambda x: x != "Lineup")
    return p.select("p_partkey", joined(section).alias("section"), joined(texts).alias("texts"), meta["title"].alias("title"), meta["canonical"].alias("canonical"), told.alias("description"), made.isNotNull().alias("fallback"), valid.alias("secondary"))


@query(
    """SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 > 0) AS agreed, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)) AS only_left, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)) AS only_right, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS differing"""
)
def s11_reconcile(spark, d):
    """Two lists of one page, and what either lacks."""
    left = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), "c_custkey").alias("url"))
    right = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise("u"), "s_suppkey").alias("url"))
    return feeds.reconcile(left, right)


@query(
    """SELECT source_id, status, failed FROM (SELECT 's' || n_nationkey AS source_id, CASE WHEN n_nationkey = 24 THEN 'running' WHEN n_nationkey % 5 = 0 THEN 'failed' WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'failed' WHEN n_nationkey % 3 = 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS failed FROM nation)
UNION ALL SELECT 'recent', concat_ws(',', pass, warning, fail), NULL FROM (SELECT count(*) FILTER (o_orderstatus = 'O') AS pass, count(*) FILTER (o_orderstatus = 'P') AS warning, count(*) FILTER (o_orderstatus = 'F') AS fail FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 5))"""
)
def s12_run_log(spark, d):
    """Runs with their outcome, and results of the last audits."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("n"))
    one = H.start_run(spark, "s0", NOW)
    runs = nation.select(F.concat(F.lit("s"), "n").alias("source_id"), F.lit("running").alias("status"))
    assert one.columns == ["id", "source_id", "status", "started_at"]
    third = F.col("n") % 3 == 0
    outcomes = nation.where("n != 24").select(F.concat(F.lit("s"), "n").alias("source_id"), F.lit(5).alias("discovered"), F.when(third & (F.col("n") % 2 == 0), 0).otherwise(3).alias("inserted"), F.lit(0).alias("updated"), F.when(third, 2).otherwise(0).alias("failed"), F.when(F.col("n") % 5 == 0, "boom").alias("error"))
    done = H.finish_runs(runs, outcomes, NOW).select("source_id", "status", F.col("failed_count").alias("failed"))
    result = F.when(F.col("o_orderstatus") == "O", "pass").when(F.col("o_orderstatus") == "P", "warning").otherwise("fail")
    history = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), result.alias("result"))
    recent = H.recent_results(history).select(F.lit("recent").alias("source_id"), F.concat_ws(",", F.col("pass").cast("string"), F.col("warning").cast("string"), F.col("fail").cast("string")).alias("status"), F.lit(None).cast("int").alias("failed"))
    return done.unionByName(recent)


@query(
    """SELECT concat('sg', p_partkey) AS id, 'Ada|' || p_name AS names, 'structured' AS kind FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_nationkey ELSE 'NATION NEW' END, 'name' FROM nation UNION ALL SELECT 'next', '1998-03-10>1998-03-12', 'day' UNION ALL SELECT 'fail', '2,1,3', 'audit'"""
)
def s13_repairs(spark, d):
    """X11, H24, K6, H33, H35, H40, F-J11: stored line-ups read again, preferred spellings, day moves, audit rows."""
    from stagelight.functions.artists import clean_plain, preferred_name

    p, n = part(spark, d), F.col("p_size")
    stored = p.select(F.concat(F.lit("sg"), "p_partkey").alias("id"), F.to_json(F.struct(F.concat(F.lit("with Ada & "), "p_name").alias("line"))).alias("raw_payload"), F.when(n % 3 == 0, F.array(F.lit("Ada"), "p_name")).otherwise(F.array("p_name")).alias("artist_names"), F.lit("structured").alias("artist_extraction_kind"))
    again = lambda rows: rows.select("id", L.guests(F.get_json_object("raw_payload", "$.line")).alias("artists"), F.lit("structured").alias("kind"))
    fixed = H.repair_artists(stored, again).select("id", joined("artist_names").alias("names"), F.col("artist_extraction_kind").alias("kind"))
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("n"), "n_nationkey").alias("slug"))
    artists = nation.select("slug", F.when(F.col("n") % 2 == 0, F.concat(F.lit("Nation "), "n")).otherwise("NATION OLD").alias("name"))
    plan = nation.select("slug", F.lit(1).alias("n"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("NATION "), "n")).otherwise("NATION NEW").alias("name"))
    names = H.rename_artists(artists, plan, lambda a, b: preferred_name(a, b, clean_plain)).select(F.col("slug").alias("id"), F.col("name").alias("names"), F.lit("name").alias("kind"))
    days = spark.createDataFrame([(f"1998-03-{i}",) for i in (10, 11, 12)], "date_key string")
    move = H.day_transition(days, "1998-03-10", "1998-03-12").select(F.col("direction").alias("id"), F.concat_ws(">", "from_day", "to_day").alias("names"), F.lit("day").alias("kind"))
    assert H.prefetch_filters(["a", "b", "a"]) == [[], ["b"], ["a"]] and H.prefetch_filters([]) == [] and H.prefetch_filters(list("abcde")) == [[]]
    found = spark.createDataFrame([("r1", "error", "g1", "x"), ("r1", "error", "g2", "x"), ("r2", "warning", "g1", "x")], "rule string, level string, gig_id string, detail string")
    cards = spark.createDataFrame([("a",), ("a",), (None,)], "source_name string")
    row = H.audit_row(found, cards, NOW)
    brief = row.select(F.col("result").alias("id"), F.concat_ws(",", F.get_json_object("summary", "$.errors"), F.get_json_object("summary", "$.warnings"), F.get_json_object("summary", "$.gigs")).alias("names"), F.lit("audit").alias("kind"))
    assert H.output_hash(found).columns == ["digest"]
    return fixed.unionByName(names).unionByName(move).unionByName(brief)
