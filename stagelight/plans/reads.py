"""Reads over cards: days, months, venues, search, suggestions, calendar, sitemap. `now` is an aware datetime."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions import dates as D
from stagelight.functions.artists import artist_line
from stagelight.functions.text import match_score, matches_query, safe_json, search_text

SUGGESTIONS, UPCOMING = 7, 120


def clean_slugs(values: Sequence[str] | str | None) -> list[str]:
    """Trimmed, each once, in order; commas separate."""
    parts = values.split(",") if isinstance(values, str) else list(values or [])
    return list(dict.fromkeys(p.strip().lower() for p in parts if p and p.strip()))


def between(rows: DataFrame, start: datetime | None, end: datetime | None = None) -> DataFrame:
    """starts_at in [start, end)."""
    if start is not None:
        rows = rows.where(F.col("starts_at") >= D.literal(start))
    return rows if end is None else rows.where(F.col("starts_at") < D.literal(end))


def facets(rows: DataFrame, query: str = "", venue_slugs: Sequence[str] = ()) -> DataFrame:
    """Rows that match every query word, at any of the venues; no filter where none is given."""
    if venue_slugs:
        rows = rows.where(F.col("venue_slug").isin(*venue_slugs))
    return rows.where(matches_query(query, F.col("title"), F.col("venue_name"), F.col("venue_suburb"), arrays=(F.col("artist_names"),))) if query.strip() else rows


def upcoming(cards: DataFrame, now: datetime, query: str = "", venue_slugs: Sequence[str] = ()) -> DataFrame:
    """Active cards from local midnight on, in order of start."""
    rows = between(cards.where("status = 'active'"), D.bounds_of(D.today(now))[0])
    return facets(rows, query, venue_slugs).orderBy("starts_at", "id")


def available_days(rows: DataFrame, now: datetime, query: str = "", venue_slugs: Sequence[str] = ()) -> DataFrame:
    active = between(rows.where("status = 'active'"), D.bounds_of(D.today(now))[0])
    return facets(active, query, venue_slugs).select(D.day_key(F.col("starts_at")).alias("date_key")).distinct().orderBy("date_key")


def gigs_for_day(cards: DataFrame, key: str, now: datetime, query: str = "", venue_slugs: Sequence[str] = ()) -> DataFrame | None:
    """Active cards of a local day; none of a past one, None for what isn't a date."""
    bounds = D.bounds_of_key(key)
    if bounds is None:
        return None
    start = max(bounds[0], D.bounds_of(D.today(now))[0])
    return facets(between(cards.where("status = 'active'"), start, bounds[1]), query, venue_slugs).orderBy("starts_at", "id")


def gig_by_slug(cards: DataFrame, slug: str, now: datetime) -> DataFrame:
    """In the archive window, whatever the status."""
    return between(cards.where(F.col("slug") == slug), D.archive_bound(now))


def gigs_for_month(cards: DataFrame, year: int, month: int, now: datetime) -> DataFrame | None:
    bounds = D.month_bounds(year, month)
    return None if bounds is None else between(cards, max(bounds[0], D.archive_bound(now)), bounds[1]).orderBy("starts_at", "id")


def gigs_for_days(cards: DataFrame, keys: Sequence[str], now: datetime) -> DataFrame:
    """Active cards of some days, from now on and not from midnight."""
    bounds = [b for b in map(D.bounds_of_key, keys) if b]
    if not bounds:
        return cards.limit(0)
    rows = between(cards.where("status = 'active'"), max(D.utc(now), min(b[0] for b in bounds)), max(b[1] for b in bounds))
    return rows.where(D.day_key(F.col("starts_at")).isin(*keys)).orderBy("starts_at", "id")


def tonight(cards: DataFrame, now: datetime) -> DataFrame:
    return gigs_for_days(cards, [D.today(now).isoformat()], now)


def this_weekend(cards: DataFrame, now: datetime) -> DataFrame:
    return gigs_for_days(cards, D.weekend_keys(now), now)


def gigs_for_venue(cards: DataFrame, slug: str, now: datetime) -> DataFrame:
    return between(cards.where((F.col("status") == "active") & (F.col("venue_slug") == slug)), now).orderBy("starts_at", "id")


def day_groups(cards: DataFrame, now: datetime) -> DataFrame:
    """A row for each local day with its heading and its cards in order of start, with state and artist line."""
    card = F.struct("starts_at", "id", "title", "venue_name", D.display_state(F.col("status"), F.col("starts_at"), F.col("ends_at"), D.literal(now)).alias("state"), artist_line(F.col("title"), F.col("artist_names")).alias("artist_line"))
    days = cards.groupBy(D.day_key(F.col("starts_at")).alias("date_key")).agg(F.array_sort(F.collect_list(card)).alias("items"))
    return days.select("date_key", D.heading(F.col("date_key")).alias("heading"), "items")


def venues_with_gigs(venues: DataFrame, cards: DataFrame, now: datetime) -> DataFrame:
    future = between(cards.where("status = 'active'"), now).select(F.col("venue_slug").alias("slug"))
    return venues.join(future, "slug", "left_semi")


def venue_suggestions(venues: DataFrame, cards: DataFrame, query: str, now: datetime, excluded: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Venues with coming gigs whose name or suburb holds the query: name prefix, name, suburb prefix, suburb."""
    q = " ".join(query.lower().split())
    name, suburb = search_text(F.col("name")), search_text(F.coalesce("suburb", F.lit("")))
    rank = F.when(name.startswith(q), 0).when(name.contains(q), 1).when(suburb.startswith(q), 2).when(suburb.contains(q), 3)
    rows = venues_with_gigs(venues, cards, now).where(~F.col("slug").isin(*excluded) if excluded else F.lit(True)).withColumn("rank", rank).where("rank is not null")
    rows = rows.orderBy("rank", F.collate("name", "UNICODE"), "slug")
    return rows.limit(n) if n else rows


def selected_venues(venues: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """In the order of the arguments."""
    order = F.array_position(F.array(*map(F.lit, slugs)), F.col("slug")) if slugs else F.lit(0)
    return venues.where(F.col("slug").isin(*slugs) if slugs else F.lit(False)).orderBy(order)


def suggestions(cards: DataFrame, venues: DataFrame, query: str, now: datetime, venue_slugs: Sequence[str] = ()) -> DataFrame:
    """The 7 best of gigs, artists and venues: score, type, label.

    Gigs and artists are those of the first 120 upcoming cards (the feature's own limit; ties by id), at the selected
    venues if there are any; venues are suggested without the selected ones.
    """
    q = F.lit(query)
    first = between(cards.where("status = 'active'"), D.bounds_of(D.today(now))[0])
    first = facets(first, "", venue_slugs).orderBy("starts_at", "id").limit(UPCOMING)
    first = first.withColumn("n", F.row_number().over(Window.orderBy("starts_at", "id")))
    place = F.concat_ws(" · ", "venue_name", F.when(F.col("venue_suburb") != "", F.col("venue_suburb")))
    gigs = first.select("n", match_score(F.col("title"), q).alias("score"), F.col("title").alias("label"), place.alias("subtext")).where("score is not null")
    gigs = gigs.groupBy(search_text(F.col("label")).alias("key")).agg(F.min_by(F.struct("score", "label", "subtext"), "n").alias("s")).select(F.lit(0).alias("kind"), "s.*", F.lit(None).cast("string").alias("slug"))
    names = first.select("n", place.alias("subtext"), F.posexplode("artist_names").alias("pos", "label")).withColumn("score", match_score(F.col("label"), q)).where("score is not null")
    artists = names.groupBy(search_text(F.col("label")).alias("key")).agg(F.min_by(F.struct("score", "label", "subtext"), F.struct("score", "n", "pos")).alias("s")).select(F.lit(1).alias("kind"), "s.*", F.lit(None).cast("string").alias("slug"))
    found = venue_suggestions(venues, cards, query, now, venue_slugs)
    score = F.least(match_score(F.col("name"), q), match_score(F.col("suburb"), q))
    places = found.select(F.lit(2).alias("kind"), score.alias("score"), F.col("name").alias("label"), F.col("suburb").alias("subtext"), "slug").where("score is not null")
    every = gigs.unionByName(artists).unionByName(places).orderBy("score", "kind", F.collate("label", "UNICODE"), "slug").limit(SUGGESTIONS)
    return every.select(F.element_at(F.array(F.lit("gig"), F.lit("artist"), F.lit("venue")), F.col("kind") + 1).alias("type"), "label", "subtext", "slug", "score") if query.strip() else every.limit(0).select(F.lit("").alias("type"), "label", "subtext", "slug", "score")


def calendar_month(days: DataFrame, month: date, active: str | None, now: datetime) -> DataFrame:
    """The weeks, Monday first, that show a month: date_key, week, weekday, in_month, enabled, is_today, is_active.

    days: date_key of days with gigs. Enabled days are those of the month.
    """
    first = month.replace(day=1)
    start = first - timedelta(days=first.weekday())
    last = D.shift_months(first, 1) - timedelta(days=1)
    end = last + timedelta(days=6 - last.weekday())
    spark = days.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("date_key"), F.floor(F.datediff("day", F.lit(start)) / 7).cast("int").alias("week"), F.weekday("day").alias("weekday"), F.col("day").between(first, last).alias("in_month"))
    has = days.select("date_key").distinct().withColumn("has", F.lit(True))
    grid = grid.join(has, "date_key", "left")
    return grid.select("date_key", "week", "weekday", "in_month", (F.coalesce("has", F.lit(False)) & F.col("in_month")).alias("enabled"), (F.col("date_key") == D.today(now).isoformat()).alias("is_today"), F.coalesce(F.col("date_key") == active, F.lit(False)).alias("is_active"))


def calendar_months(days: DataFrame) -> DataFrame:
    """Months with gigs, with the one before and after."""
    w = Window.orderBy("month")
    return days.select(F.substring("date_key", 1, 7).alias("month")).distinct().select("month", F.lag("month").over(w).alias("previous"), F.lead("month").over(w).alias("next"))


def resolved_day(days: DataFrame, requested: str | None, now: datetime) -> DataFrame:
    """One row: the requested day if it has gigs, else today's or the next day with gigs, else the last one."""
    today = D.today(now).isoformat()
    wanted = F.max(F.when(F.col("date_key") == requested, F.col("date_key"))) if requested else F.lit(None).cast("string")
    return days.agg(F.coalesce(wanted, F.min(F.when(F.col("date_key") >= today, F.col("date_key"))), F.max("date_key")).alias("date_key"))


def shortcut_day(days: DataFrame, shortcut: str, now: datetime) -> DataFrame:
    """The day that `today` or `weekend` leads to, null if there is none."""
    today = D.today(now).isoformat()
    ok = F.col("date_key").isin(*D.weekend_keys(now)) if shortcut == "weekend" else F.col("date_key") >= today
    return days.agg(F.min(F.when(ok, F.col("date_key"))).alias("date_key"))


def today_label(days: DataFrame, now: datetime) -> DataFrame:
    """Today, Tomorrow or Nearest, for the first day with gigs from today on."""
    today = D.today(now)
    first = F.min(F.when(F.col("date_key") >= today.isoformat(), F.col("date_key")))
    return days.agg(first.alias("date_key")).withColumn("label", F.when(F.col("date_key") == today.isoformat(), "Today").when(F.col("date_key") == (today + timedelta(days=1)).isoformat(), "Tomorrow").when(F.col("date_key").isNotNull(), "Nearest"))


def hydrated_days(days: DataFrame, active: str, now: datetime) -> DataFrame:
    """The active day with its neighbours, today's shortcut and the weekend's days, where they have gigs."""
    w = Window.orderBy("date_key")
    near = days.select("date_key", F.lag("date_key").over(w).alias("p"), F.lead("date_key").over(w).alias("n")).where(F.col("date_key") == active)
    keys = near.select(F.explode(F.array("p", "date_key", "n")).alias("date_key")).unionByName(shortcut_day(days, "today", now))
    return days.join(keys, "date_key", "left_semi").unionByName(days.where(F.col("date_key").isin(*D.weekend_keys(now)))).distinct().orderBy("date_key")


def merge_day_cache(loaded: DataFrame, fresh: DataFrame, days: DataFrame) -> DataFrame:
    """Days' items, fresh ones instead of loaded ones, of available days in order."""
    every = fresh.unionByName(loaded.join(fresh.select("date_key"), "date_key", "left_anti"))
    return every.join(days, "date_key", "left_semi").orderBy("date_key")


def sitemap(rows: DataFrame, now: datetime, site: str) -> DataFrame:
    """(url, last_modified, kind) of pages, months, venues and gigs.

    rows: slug, venue_slug, starts_at, status, last_modified. Rows without keys or times, or before the archive bound,
    have no pages. Months, venues and gigs come from one pass with grouping sets.
    """
    own = rows.where((F.coalesce("slug", F.lit("")) != "") & (F.coalesce("venue_slug", F.lit("")) != "") & F.col("last_modified").isNotNull())
    own = between(own, D.archive_bound(now)).withColumn("month", D.month_key(F.col("starts_at"))).withColumn("day", D.day_key(F.col("starts_at")))
    keys = [F.col("month"), F.col("venue_slug"), F.col("slug")]
    sets = own.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.max("last_modified").alias("last_modified"))
    path = F.when(F.col("month").isNotNull(), D.month_path(F.col("month"))).when(F.col("venue_slug").isNotNull(), F.concat(F.lit("/venues/"), F.url_encode("venue_slug"))).when(F.col("slug").isNotNull(), F.concat(F.lit("/gigs/"), F.url_encode("slug"))).otherwise("/venues")
    kind = F.when(F.col("month").isNotNull(), "month").when(F.col("venue_slug").isNotNull(), "venue").when(F.col("slug").isNotNull(), "gig").otherwise("site")
    pages = sets.where("last_modified is not null").select(F.concat(F.lit(site), path).alias("url"), "last_modified", kind.alias("kind"))
    live = between(own.where("status = 'active'"), now)
    some = lambda cond, *paths: live.where(cond).agg(F.max("last_modified").alias("last_modified"), F.count("*").alias("n")).select(F.explode(F.array(*(F.lit(site + p) for p in paths))).alias("url"), "last_modified", F.lit("site").alias("kind"), "n")
    always = some(F.lit(True), "/", "/gigs").unionByName(some(F.lit(False), "/about")).drop("n")
    now_pages = some(F.col("day") == D.today(now).isoformat(), "/tonight").unionByName(some(F.col("day").isin(*D.weekend_keys(now)), "/this-weekend")).where("n > 0").drop("n")
    return pages.unionByName(always).unionByName(now_pages)


def sitemap_rows(sitemap_gigs: DataFrame, dates: DataFrame, gigs: DataFrame) -> DataFrame:
    """Sitemap rows with their venue; rows without one are left out."""
    venue = gigs.select("id", "slug").join(dates.select("id", "venue_slug"), "id").select("slug", "venue_slug")
    return sitemap_gigs.join(venue, "slug")


def event_json(cards: DataFrame, now: datetime, site: str) -> DataFrame:
    """Structured data of each card as JSON without nulls, with `<` escaped."""
    state = D.display_state(F.col("status"), F.col("starts_at"), F.col("ends_at"), D.literal(now))
    status = F.when(state == "cancelled", "https://schema.org/EventCancelled").when(state == "postponed", "https://schema.org/EventPostponed").otherwise("https://schema.org/EventScheduled")
    place = F.struct(F.lit("MusicVenue").alias("@type"), F.col("venue_name").alias("name"), F.col("venue_address").alias("address"))
    performers = F.when(F.size("artist_names") > 0, F.transform("artist_names", lambda n: F.struct(F.lit("MusicGroup").alias("@type"), n.alias("name"))))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("MusicEvent").alias("@type"), F.col("title").alias("name"), D.iso_local(F.col("starts_at")).alias("startDate"), D.iso_local(F.col("ends_at")).alias("endDate"), status.alias("eventStatus"), F.concat(F.lit(f"{site}/gigs/"), "slug").alias("url"), place.alias("location"), performers.alias("performer"))
    return cards.select("id", safe_json(body).alias("json"))


def fact_summary(now: datetime) -> Column:
    """One sentence of facts about a card."""
    artists = F.when(F.size("artist_names") > 0, F.concat(F.lit("featuring "), F.array_join("artist_names", ", ")))
    at = F.concat(F.lit("on "), F.date_format(D.local(F.col("starts_at")), "EEEE d MMMM yyyy"))
    state = D.display_state(F.col("status"), F.col("starts_at"), F.col("ends_at"), D.literal(now))
    lead = F.when(state == "cancelled", "Cancelled:").when(state == "postponed", "Postponed:").when(state == "past", "Past event:")
    return F.concat(F.concat_ws(" ", lead, "title", artists, F.concat(F.lit("at "), "venue_name"), at), F.lit("."))


def breadcrumbs(items: Column, site: str) -> Column:
    """A breadcrumb list, positions from 1; items: array of (name, path)."""
    return F.transform(items, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), F.concat(F.lit(site), x["path"]).alias("item")))
