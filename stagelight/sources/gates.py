"""What counts as live music near the city, for each source: gates as Columns over listings' fields."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions import dates as D
from stagelight.functions.text import collapse, keyword_count, keyword_text, let, normalise_space
from stagelight.operators.dealing import dealt
from stagelight.sources.city_feed import METRO

#: Words and patterns of the gates.
TICKETEK_EXCLUDED = ("waitlist", "gift voucher", "gift card", "parking", "membership", "fan to fan")
TICKETEK_NOT_MUSIC = (
    "comedy", "theatre", "theater", "musical", "play", "opera", "ballet", "wrestling", "boxing", "fight night", "fight", "ufc", "sport", "sports", "racing", "family", "expo", "exhibition", "talk", "conversation",
    "speaking", "seminar", "workshop", "kids", "ice", "disney on ice",
)
TICKETEK_MUSIC = ("in concert", "band", "dj", "orchestra", "symphony", "tribute", "festival", "concert", "rock", "metal", "punk", "jazz", "blues", "folk", "country", "hip hop", "pop", "choir", "acoustic")
TICKETEK_METRO = (
    "perth, wa", "east perth, wa", "west perth, wa", "north perth, wa", "northbridge, wa", "burswood, wa", "subiaco, wa", "claremont, wa", "nedlands, wa", "leederville, wa", "mount lawley, wa", "inglewood, wa", "maylands, wa",
    "highgate, wa", "victoria park, wa", "como, wa", "south perth, wa", "fremantle, wa", "north fremantle, wa", "scarborough, wa", "joondalup, wa", "cannington, wa", "guildford, wa", "midland, wa", "perth hills, wa",
)
MUSIC_ROOTS, NOT_MUSIC_ROOTS = ("classical music", "contemporary music"), ("children/family events", "dance", "musical theatre", "sport", "theatre")
HUMANITIX_TITLE = ("cocktail night", "ecstatic dance", "termly catch music", "catch music", "pitter patter", "launch party", "bridgerton ball", "birthday bash", "sound healing", "workshop", "class", "networking")
HUMANITIX_TEXT = (
    "nervous-system reset", "dance journey", "all ages, abilities, and backgrounds", "weekly music sessions", "casual attendance", "first session is free", "carers are welcome", "meet new people", "food served + mingle",
    "support groups", "regular programs include",
)
HUMANITIX_MUSIC = (
    "live music", "live songs", "live in", "live at", "full band", "band", "bands", "concert", "festival", "recital", "orchestra", "quartet", "trio", "duo", "choir", "tribute", "tour", "album launch", "single launch", "acoustic",
    "musicians", "dj set", "on the decks", "singer-songwriter", "singer songwriter", "punk", "metal", "rock", "jazz", "blues", "folk", "indie", "alternative", "hip hop", "hip-hop", "electronic", "techno", "house", "disco", "show",
)
HUMANITIX_METRO = (
    "perth", "east perth", "west perth", "north perth", "south perth", "northbridge", "subiaco", "claremont", "mt claremont", "mount claremont", "nedlands", "crawley", "churchlands", "leederville", "west leederville", "mount lawley",
    "highgate", "inglewood", "maylands", "victoria park", "east victoria park", "lathlain", "burswood", "como", "applecross", "bull creek", "mosman park", "fremantle", "east fremantle", "north fremantle", "hilton", "beaconsfield",
    "scarborough", "joondalup", "guildford", "midland", "cannington", "alkimos", "henley brook",
)
MOSHTIX_NOT_MUSIC = ("trivia", "quiz", "pub quiz", "market", "markets", "flea market", "comedy", "workshop", "class", "classes", "karaoke", "bingo")
MOSHTIX_PLACEHOLDERS = ("various venues", "touring nationally", "touring australia", "touring australia and new zealand", "touring au and nz")
MOSHTIX_REGIONAL = "(?i)\\s[-–]\\s(?:albany|busselton|rockingham)\\b"
MOSHTIX_EARLY = "(?i)\\b(?:trivia|quiz|karaoke|bingo|comedy|workshops?|flea market|markets?)\\b"
EVENTBRITE_REJECT = "(?i)\\b(?:bingo|karaoke|trivia|workshops?|clinics?|(?:class|course|lesson|seminar)s?|(?:album\\s+)?listening\\s+part(?:y|ies)|silent\\s+disco|sound\\s+healing)\\b"
EVENTBRITE_REJECTED_FORMATS, EVENTBRITE_MUSIC_FORMATS, EVENTBRITE_PARTY = (
    ("class training or workshop", "game or competition", "conference", "seminar or talk", "screening"), ("concert or performance", "festival or fair"), "party or social gathering",
)
EVENTBRITE_SIGNAL = "(?i)\\b(?:dj|rave|live|bands?|concert|festival|tour|techno|house|disco|rock|metal|punk|emo|indie|jazz|blues|folk|hip[ -]?hop|r\\s*(?:&|and|n)\\s*b|electronic|drum\\s+(?:and|&)\\s+bass|soul|funk)\\b"
BIRD_NOT_MUSIC = "(?i)\\b(?:improv|dnd|comedy|trivia|quiz)\\b"
BIRD_MUSIC = "(?i)\\b(?:live music|single launch|ep launch|album launch|jazz|noise|ambient|electronic|techno|dance|funk|soul|indie|alt|rock|metal|party|dj|drum(?: and| &) bass|dnb|courtyard|carpark)\\b"
BIRD_PLACEHOLDERS = ("past event", "tomorrow")
INTERSTITIAL = (("ticketek australia", "just one device", "security flags"), ("something doesn't feel quite right",), ("temporarily keeping you from accessing our site",), ("powered and protected by privacy",))
#: Failures by what their message holds, in order.
FAILURES = (("resolve uniquely", "structured_event"), ("redirected", "url"), ("event URL", "url"), ("date", "date"), ("missing", "missing_data"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Some word occurs as a substring, which may be part of a longer word."""
    return let(text, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w)))  # else the text is worked out for each word


def _text(*parts: Column) -> Column:
    return F.lower(collapse(F.concat_ws(" ", *parts)))


def ticketek_class(title: Column, subtitle: Column, summary: Column, location: Column) -> Column:
    """music, non-music or unknown: vetoes go by the event's text, music words also by the place's."""
    event, every = _text(title, subtitle, summary), _text(title, subtitle, summary, location)
    return F.when(contains_any(event, TICKETEK_EXCLUDED + TICKETEK_NOT_MUSIC), "non-music").when(contains_any(every, TICKETEK_MUSIC), "music").otherwise("unknown")


def category_class(facets: Column) -> Column:
    """The same from category paths such as `Contemporary Music > Rock`: by their roots, and comedy anywhere."""
    paths = F.transform(facets, lambda f: F.transform(F.split(F.lower(collapse(f)), ">"), lambda x: F.trim(x)))
    veto = F.exists(paths, lambda p: F.coalesce(F.get(p, 0).isin(*NOT_MUSIC_ROOTS), F.lit(False)) | F.exists(p, lambda s: s.contains("comedy")))
    return F.when(veto, "non-music").when(F.exists(paths, lambda p: F.get(p, 0).isin(*MUSIC_ROOTS)), "music").otherwise("unknown")


def positive_facets(counts: Column) -> Column:
    """Labels of a map from label to count that are not blank and count something."""
    return F.transform(F.map_keys(F.map_filter(counts, lambda k, v: (F.trim(k) != "") & (v > 0))), collapse)


def near_perth_text(location: Column) -> Column:
    return contains_any(F.lower(location), TICKETEK_METRO)


def near_perth_venue(suburb: Column, *texts: Column) -> Column:
    """The suburb is of the metro area, or a text names one of its suburbs with the state."""
    words = F.regexp_replace(F.lower(F.concat_ws(" ", *texts, suburb)), "[^a-z0-9]+", " ")
    return F.coalesce(F.lower(suburb).isin(*HUMANITIX_METRO), F.lit(False)) | contains_any(words, [f"{s} wa" for s in HUMANITIX_METRO])


def metro_reject_reason(title: Column, venue: Column, address: Column, suburb: Column, region: Column) -> Column:
    """Why a listing isn't near the city: the first of region in the title, placeholder venue, state, and locality, which
    is looked for in the venue's text where there is none; null for a listing to keep."""
    text, place, state = F.lower(collapse(F.concat_ws(" ", venue, address))), F.lower(F.trim(F.coalesce(suburb, F.lit("")))), F.lower(F.trim(F.coalesce(region, F.lit(""))))
    metro = METRO + ("east fremantle",)
    return (
        F.when(title.rlike(MOSHTIX_REGIONAL), "regional title").when(contains_any(text, MOSHTIX_PLACEHOLDERS), "placeholder venue").when((state != "") & (state != "wa"), "other state")
        .when((place != "") & ~place.isin(*metro), "other locality").when((place == "") & ~contains_any(text, metro), "no metro locality")
    )


def offline_by_name(mode: Column, place: Column) -> Column:
    """No online mode, and no online word in the place's name."""
    return ~F.coalesce(F.lower(mode).contains("onlineeventattendancemode"), F.lit(False)) & ~contains_any(F.lower(F.coalesce(place, F.lit(""))), ("online", "virtual", "livestream"))


def offline_by_mode(modes: Column) -> Column:
    """Some mode is offline and none online."""
    low = F.transform(F.coalesce(modes, F.array().cast("array<string>")), F.lower)
    return F.exists(low, lambda m: m.contains("offlineeventattendancemode")) & ~F.exists(low, lambda m: m.contains("onlineeventattendancemode"))


def strict_music(title: Column, description: Column, artists: Column, headings: Column, page_text: Column) -> Column:
    """Hard rejects by title and text; then a line-up, an artist, a music word in the title, or two anywhere."""
    every = F.concat_ws(" ", title, description, F.array_join(page_text, " "), F.array_join(artists, " "))
    lineup = F.exists(headings, lambda h: F.lower(h) == "lineup")
    # keywords are looked for as the words that their text is made of
    words = lambda keys: [" ".join("".join(c if c.isalnum() else " " for c in k).split()) for k in keys]
    count = lambda text, keys: keyword_count(text, words(keys))
    return F.when((count(title, HUMANITIX_TITLE) > 0) | (count(every, HUMANITIX_TEXT) > 0), False).otherwise(lineup | (F.size(artists) > 0) | (count(title, HUMANITIX_MUSIC) >= 1) | (count(every, HUMANITIX_MUSIC) >= 2))


def tag_values(tags: Column, prefix: str) -> Column:
    """Values of the tags (prefix, tag, display_name) of one prefix."""
    own = F.filter(tags, lambda t: F.lower(collapse(t["prefix"])) == prefix.lower())
    return F.filter(F.flatten(F.transform(own, lambda t: F.array(collapse(t["tag"]), collapse(t["display_name"])))), lambda v: F.coalesce(v, F.lit("")) != "")


def is_music_category(tags: Column) -> Column:
    return F.exists(tag_values(tags, "EventbriteCategory"), lambda v: F.lower(v).isin("music", "103"))


def format_aware_music(tags: Column, title: Column, summary: Column, artists: Column, modes: Column, in_state: Column) -> Column:
    """Music category, offline, in the state; no rejected format or word; then artists or a music format, or a party with
    a music word in its text, sub-category or organizer."""
    form = F.coalesce(keyword_text(F.get(tag_values(tags, "EventbriteFormat"), 0)), F.lit(""))
    rejected = form.isin(*EVENTBRITE_REJECTED_FORMATS) | F.concat_ws(" ", title, summary, form).rlike(EVENTBRITE_REJECT)
    party = F.concat_ws(" ", title, summary, F.array_join(tag_values(tags, "EventbriteSubCategory"), " "), F.array_join(tag_values(tags, "EventbriteOrganizer"), " ")).rlike(EVENTBRITE_SIGNAL)
    return is_music_category(tags) & offline_by_mode(modes) & in_state & ~rejected & ((F.size(artists) > 0) | form.isin(*EVENTBRITE_MUSIC_FORMATS) | ((form == EVENTBRITE_PARTY) & party))


def weekly_music(title: Column, vibe: Column, description: Column, featuring: Column, artists: Column) -> Column:
    text = collapse(F.concat_ws(" ", title, vibe, description, featuring))
    return F.when((text == "") | text.rlike(BIRD_NOT_MUSIC), False).otherwise(text.rlike(BIRD_MUSIC) | (F.size(artists) >= 2))


def skip_before_detail(title: Column, teaser: Column) -> Column:
    """A predicate to stand before the step that reads detail pages."""
    return title.rlike(MOSHTIX_REGIONAL) | F.concat_ws(" ", title, teaser).rlike(MOSHTIX_EARLY)


def clearly_not_music(title: Column, description: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", title, description)), MOSHTIX_NOT_MUSIC)


def is_past_day(day: Column, now: datetime) -> Column:
    """A local date before today's."""
    return F.date_format(day, "yyyy-MM-dd") < D.today(now).isoformat()


def is_blank_row(*fields: Column) -> Column:
    blank = F.lit(True)
    for f in fields:
        blank = blank & (F.trim(F.coalesce(f, F.lit(""))) == "")
    return blank


def is_placeholder_title(title: Column) -> Column:
    return F.lower(normalise_space(F.coalesce(title, F.lit("")))).isin(*BIRD_PLACEHOLDERS)


def is_interstitial(html: Column) -> Column:
    """A page that stands in for the one asked for."""
    low, out = F.lower(html), F.lit(False)
    for words in INTERSTITIAL:
        every = F.lit(True)
        for w in words:
            every = every & low.contains(w)
        out = out | every
    return out


def failure_bucket(message: Column) -> Column:
    out = F.lit(None).cast("string")
    for needle, name in FAILURES:
        out = F.coalesce(out, F.when(message.contains(needle), name))
    return F.coalesce(out, F.lit("other"))


def max_page(links: Column, name: str = "page") -> Column:
    """The largest page number among links' parameters of that name, 1 at least."""
    pages = F.transform(links, lambda u: F.regexp_extract(u, f"[?&]{name}=([0-9]{{1,9}})(?:[&#]|$)", 1).try_cast("int"))
    return F.greatest(F.coalesce(F.array_max(pages), F.lit(1)), F.lit(1))


def verify_listings(listings: DataFrame, events: DataFrame, responses: DataFrame) -> DataFrame:
    """(listing_id, status): accepted, rejected or ambiguous by a structured search for each title.

    listings: listing_id, title_key, show_code, date_key, venue_slug. events: title_key (the search it answers),
    event_title_key, show_code, date_key, venue_slug, state. responses: title_key, facets, has_more. A listing is
    ambiguous unless the answer is whole, all its events have the listing's show code, one of them agrees in title,
    day, venue and state, and its categories tell; aggregates and equi-joins alone.
    """
    code = F.upper(collapse(F.coalesce("show_code", F.lit(""))))
    e = events.withColumn("code", code)
    by_title = e.groupBy("title_key").agg(F.max(F.col("code") == "").alias("incomplete"), F.min("code").alias("low"), F.max("code").alias("high"))
    hits = e.where((F.col("event_title_key") == F.col("title_key")) & (F.upper("state") == "WA")).select("title_key", "code", "date_key", "venue_slug").distinct().withColumn("hit", F.lit(True))
    rows = listings.withColumn("code", code).join(dealt(by_title), "title_key", "left").join(dealt(responses.select("title_key", "has_more", category_class(F.col("facets")).alias("kind"))), "title_key", "left").join(dealt(hits), ["title_key", "code", "date_key", "venue_slug"], "left")
    sure = (F.col("code") != "") & ~F.coalesce("has_more", F.lit(False)) & ~F.col("incomplete") & (F.col("low") == F.col("code")) & (F.col("high") == F.col("code")) & F.col("hit")
    status = F.when(~F.coalesce(sure, F.lit(False)), "ambiguous").when(F.col("kind") == "non-music", "rejected").when(F.col("kind") == "music", "accepted").otherwise("ambiguous")
    return rows.select("listing_id", status.alias("status"))


def verification_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))
