"""Queries over the core tables made of the driver's tables: views, reads, audit, matching, merges and images, by the
library's own functions, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stagelight.functions import dates as D
from stagelight.functions.text import slugify
from stagelight.gig_model import sql, tables
from stagelight.operators import images as I
from stagelight.operators import matching as X
from stagelight.operators import merging as M
from stagelight.operators import ranking as R
from stagelight.operators.dealing import apart, written
from stagelight.plans import audit, reads, views

#: 2000-03-07 is a Tuesday; its local day begins at 16:00 UTC of the day before.
NOW = datetime(2000, 3, 7, 4, 0, tzinfo=timezone.utc)
SITE = "https://gigs.example.com"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str, *more: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(text, *more)
        return f

    return add


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_NOW, _MIDNIGHT = "TIMESTAMP '2000-03-07 04:00:00'", "TIMESTAMP '2000-03-06 16:00:00'"
_ARCHIVE = "TIMESTAMP '1999-12-06 16:00:00'"
_DAY = "strftime({} + INTERVAL 8 HOUR, '%Y-%m-%d')"
LIN = "lin AS (SELECT g.*, s.name AS source_name, s.priority, s.is_public_listing_source AS pub FROM source_gigs g JOIN sources s ON s.id = g.source_id)"
NAMES = "names AS (SELECT gig_id, string_agg(name, '|' ORDER BY coalesce(sort_order, 2147483647), name) AS artist_names FROM gig_artists ga JOIN artists a ON a.id = ga.artist_id GROUP BY 1)"
CARDS = (
    LIN, NAMES,
    "txt AS (SELECT gig_id, source_url, source_name FROM (SELECT *, row_number() OVER (PARTITION BY gig_id ORDER BY priority DESC, last_seen_at DESC, created_at DESC, id DESC) AS rn FROM lin WHERE pub) WHERE rn = 1)",
    "img AS (SELECT gig_id, mirrored_image_path AS image_path, source_image_url, mirrored_image_width AS image_width, mirrored_image_height AS image_height, strftime(coalesce(image_mirrored_at, last_seen_at, created_at), '%Y%m%d%H%M%S.') || '000' AS image_version FROM"
    " (SELECT *, row_number() OVER (PARTITION BY gig_id ORDER BY CASE WHEN image_mirror_status = 'ready' AND mirrored_image_path IS NOT NULL THEN 0 ELSE 1 END, priority DESC, last_seen_at DESC, created_at DESC, id DESC) AS rn FROM lin WHERE source_image_url IS NOT NULL OR mirrored_image_path IS NOT NULL) WHERE rn = 1)",
    "cards AS (SELECT g.id, g.slug, g.title, g.description, g.starts_at, g.ends_at, g.ticket_url, coalesce(t.source_url, g.source_url) AS source_url, t.source_name, i.* EXCLUDE (gig_id), v.slug AS venue_slug, v.name AS venue_name, v.suburb AS venue_suburb, v.address AS venue_address,"
    " coalesce(n.artist_names, '') AS artist_names, g.status, g.tixel_url FROM gigs g JOIN txt t ON t.gig_id = g.id JOIN venues v ON v.id = g.venue_id LEFT JOIN img i ON i.gig_id = g.id LEFT JOIN names n ON n.gig_id = g.id)",
)
_HAY = "lower(concat_ws(' ', title, venue_name, venue_suburb, replace(artist_names, '|', ' ')))"


def cards(spark, d):
    return views.gig_cards(tables(spark, d))


def _brief(rows):
    return rows.select("id", stamp("starts_at").alias("starts_at"))


@query("SELECT id, slug, title, source_name, source_url, image_path, source_image_url, image_width, image_version, venue_slug, venue_suburb, artist_names, status FROM cards", *CARDS)
def g01_cards(spark, d):
    """One card a gig, from the sources' rows by one aggregate."""
    return cards(spark, d).select("id", "slug", "title", "source_name", "source_url", "image_path", "source_image_url", "image_width", "image_version", "venue_slug", "venue_suburb", F.array_join("artist_names", "|").alias("artist_names"), "status")


@query("SELECT g.id, title, v.slug AS venue_slug, coalesce(artist_names, '') AS artist_names, status FROM gigs g JOIN venues v ON v.id = venue_id LEFT JOIN names n ON n.gig_id = g.id WHERE g.id IN (SELECT gig_id FROM lin WHERE pub)", LIN, NAMES)
def g02_dates(spark, d):
    """Q2, H28."""
    return views.gig_dates(tables(spark, d)).select("id", "title", "venue_slug", F.array_join("artist_names", "|").alias("artist_names"), "status")


@query(
    """SELECT 'sources' AS t, id FROM sources WHERE is_public_listing_source UNION ALL SELECT 'gigs', id FROM gigs WHERE id IN (FROM ids) UNION ALL SELECT 'venues', id FROM venues WHERE id IN (SELECT venue_id FROM gigs WHERE id IN (FROM ids))
UNION ALL SELECT 'artists', id FROM artists WHERE id IN (SELECT artist_id FROM gig_artists WHERE gig_id IN (FROM ids)) UNION ALL SELECT 'gig_artists', concat(gig_id, '/', artist_id) FROM gig_artists WHERE gig_id IN (FROM ids)
UNION ALL SELECT 'source_gigs', id FROM lin WHERE pub""",
    LIN, "ids AS (SELECT gig_id FROM lin WHERE pub)",
)
def g03_public_rows(spark, d):
    """The rows of each table that the public may read."""
    t, out = tables(spark, d), None
    for name in ("sources", "gigs", "venues", "artists", "gig_artists", "source_gigs"):
        full = {**t, "sources": t["sources"].withColumn("base_url", F.lit(None).cast("string"))}
        key = F.concat_ws("/", "gig_id", "artist_id") if name == "gig_artists" else F.col("id")
        rows = views.public_table(full, name).select(F.lit(name).alias("t"), key.alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT id, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at FROM cards WHERE status = 'active' AND starts_at >= {_MIDNIGHT} AND venue_slug IN ('venue-3', 'venue-7', 'venue-12') AND contains({_HAY}, 'blue') AND contains({_HAY}, 'live')", *CARDS)
def g04_upcoming(spark, d):
    """Q4, Q8, P2, P4, P28, T6, F-D4: facets and words over coming cards."""
    return _brief(reads.upcoming(cards(spark, d), NOW, " Blue  LIVE", reads.clean_slugs("venue-3, VENUE-7,venue-12 ,venue-3")))


@query(f"SELECT DISTINCT {_DAY.format('starts_at')} AS date_key FROM cards WHERE status = 'active' AND starts_at >= {_MIDNIGHT} AND contains({_HAY}, 'ring')", *CARDS)
def g05_available_days(spark, d):
    """Q5, A4."""
    return reads.available_days(cards(spark, d), NOW, "ring")


@query(f"SELECT id, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at FROM cards WHERE status = 'active' AND starts_at >= {_MIDNIGHT} AND starts_at < TIMESTAMP '2000-03-07 16:00:00' UNION ALL SELECT id, strftime(starts_at, '%Y-%m-%d %H:%M:%S') FROM cards WHERE status = 'active' AND starts_at >= TIMESTAMP '2000-03-09 16:00:00' AND starts_at < TIMESTAMP '2000-03-10 16:00:00'", *CARDS)
def g06_days(spark, d):
    """Q6, F-D2: today and a later day; a past one has none."""
    c = cards(spark, d)
    parts = [reads.gigs_for_day(c, key, NOW) for key in ("2000-03-07", "2000-03-10", "2000-03-01")]
    assert reads.gigs_for_day(c, "2000-3-1", NOW) is None
    return _brief(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"SELECT id, status FROM cards WHERE slug IN ('gig-500', 'gig-501', 'gig-502', 'gig-503') AND starts_at >= {_ARCHIVE}", *CARDS)
def g07_by_slug(spark, d):
    """Q7, F-D7: whatever the status, in the archive window."""
    c, out = cards(spark, d), None
    for slug in ("gig-500", "gig-501", "gig-502", "gig-503"):
        one = reads.gig_by_slug(c, slug, NOW).select("id", "status")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT id, status FROM cards WHERE starts_at >= TIMESTAMP '2000-01-31 16:00:00' AND starts_at < TIMESTAMP '2000-02-29 16:00:00' UNION ALL SELECT id, status FROM cards WHERE starts_at >= TIMESTAMP '2000-03-19 16:00:00' AND starts_at < TIMESTAMP '2000-03-31 16:00:00'", *CARDS)
def g08_months(spark, d):
    """Q9, F-D8: a month, and one that the archive bound cuts."""
    c = cards(spark, d)
    later = datetime(2000, 6, 20, 4, 0, tzinfo=timezone.utc)
    assert reads.gigs_for_month(c, 2000, 13, NOW) is None
    return reads.gigs_for_month(c, 2000, 2, NOW).unionByName(reads.gigs_for_month(c, 2000, 3, later)).select("id", "status")


@query(
    f"""SELECT 'tonight' AS page, id FROM cards WHERE status = 'active' AND starts_at >= {_NOW} AND starts_at < TIMESTAMP '2000-03-07 16:00:00'
UNION ALL SELECT 'weekend', id FROM cards WHERE status = 'active' AND starts_at >= TIMESTAMP '2000-03-09 16:00:00' AND starts_at < TIMESTAMP '2000-03-12 16:00:00'
UNION ALL SELECT 'venue', id FROM cards WHERE status = 'active' AND starts_at >= {_NOW} AND venue_slug = 'venue-9'""",
    *CARDS,
)
def g09_pages(spark, d):
    """Q10, Q11, F-D5."""
    c = cards(spark, d)
    parts = {"tonight": reads.tonight(c, NOW), "weekend": reads.this_weekend(c, NOW), "venue": reads.gigs_for_venue(c, "venue-9", NOW)}
    out = None
    for page, rows in parts.items():
        rows = rows.select(F.lit(page).alias("page"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""SELECT {_DAY.format('starts_at')} AS date_key, strftime(starts_at + INTERVAL 8 HOUR, '%a, %b ') || CAST(day(starts_at + INTERVAL 8 HOUR) AS VARCHAR) ||
  CASE WHEN day(starts_at + INTERVAL 8 HOUR) IN (11, 12, 13) THEN 'th' WHEN day(starts_at + INTERVAL 8 HOUR) % 10 = 1 THEN 'st' WHEN day(starts_at + INTERVAL 8 HOUR) % 10 = 2 THEN 'nd' WHEN day(starts_at + INTERVAL 8 HOUR) % 10 = 3 THEN 'rd' ELSE 'th' END AS heading,
  string_agg(concat(id, ':', CASE WHEN status <> 'active' THEN status WHEN coalesce(ends_at, starts_at) <= {_NOW} THEN 'past' ELSE 'active' END, ':', n_line), ',' ORDER BY starts_at, id) AS items
FROM (SELECT *, len(list_distinct(list_filter(list_transform(string_split(lower(artist_names), '|'), lambda y: trim(y)), lambda x: x <> '' AND x <> lower(title)))) AS n_line FROM cards WHERE starts_at >= TIMESTAMP '2000-02-29 16:00:00' AND starts_at < TIMESTAMP '2000-03-31 16:00:00') GROUP BY 1, 2""",
    *CARDS,
)
def g10_day_groups(spark, d):
    """Q16, A3, H29, F-D6, F-D9, F-S27: days with their headings and cards in order."""
    month = reads.gigs_for_month(cards(spark, d), 2000, 3, NOW)
    size = lambda x: F.when(x["artist_line"].isNull(), 0).otherwise(F.size(F.split(x["artist_line"], " \\| ")))
    # names of the model may hold the line's separator
    plain = month.withColumn("artist_names", F.flatten(F.transform("artist_names", lambda n: F.split(n, " ?\\| ?"))))
    days = reads.day_groups(plain, NOW)
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["id"], x["state"], size(x).cast("string"))), ",")
    return days.select("date_key", "heading", items.alias("items"))


@query(
    f"""SELECT concat('{SITE}', CASE WHEN month IS NOT NULL THEN '/gigs/' || replace(month, '-', '/') WHEN venue_slug IS NOT NULL THEN '/venues/' || venue_slug WHEN slug IS NOT NULL THEN '/gigs/' || slug ELSE '/venues' END) AS url, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_modified,
  CASE WHEN month IS NOT NULL THEN 'month' WHEN venue_slug IS NOT NULL THEN 'venue' WHEN slug IS NOT NULL THEN 'gig' ELSE 'site' END AS kind FROM own GROUP BY GROUPING SETS ((month), (venue_slug), (slug), ())
UNION ALL SELECT unnest(['{SITE}/', '{SITE}/gigs']), strftime(max(updated_at), '%Y-%m-%d %H:%M:%S'), 'site' FROM live UNION ALL SELECT '{SITE}/about', NULL, 'site'
UNION ALL SELECT '{SITE}/tonight', strftime(max(updated_at), '%Y-%m-%d %H:%M:%S'), 'site' FROM live WHERE day = '2000-03-07' HAVING count(*) > 0
UNION ALL SELECT '{SITE}/this-weekend', strftime(max(updated_at), '%Y-%m-%d %H:%M:%S'), 'site' FROM live WHERE day IN ('2000-03-10', '2000-03-11', '2000-03-12') HAVING count(*) > 0""",
    LIN,
    f"own AS (SELECT g.slug, v.slug AS venue_slug, starts_at, status, updated_at, strftime(starts_at + INTERVAL 8 HOUR, '%Y-%m') AS month, {_DAY.format('starts_at')} AS day FROM gigs g JOIN venues v ON v.id = venue_id WHERE g.id IN (SELECT gig_id FROM lin WHERE pub) AND starts_at >= {_ARCHIVE})",
    f"live AS (SELECT * FROM own WHERE status = 'active' AND starts_at >= {_NOW})",
)
def g11_sitemap(spark, d):
    """Pages, months, venues and gigs from one pass."""
    t = tables(spark, d)
    rows = reads.sitemap_rows(views.sitemap_gigs(t), views.gig_dates(t), t["gigs"])
    return reads.sitemap(rows, NOW, SITE).select("url", stamp("last_modified").alias("last_modified"), "kind")


@query(
    f"""SELECT slug, CASE WHEN starts_with(lower(name), '01') THEN 0 WHEN contains(lower(name), '01') THEN 1 WHEN starts_with(suburb, '01') THEN 2 ELSE 3 END AS rank, false AS picked FROM venues
WHERE slug IN (SELECT venue_slug FROM cards WHERE status = 'active' AND starts_at >= {_NOW}) AND slug <> 'venue-1' AND (contains(lower(name), '01') OR contains(coalesce(suburb, ''), '01'))
UNION ALL SELECT slug, 0, true FROM venues WHERE slug IN ('venue-5', 'venue-2')""",
    *CARDS,
)
def g12_venues(spark, d):
    """Q13, Q14, J22, J23."""
    t = tables(spark, d)
    found = reads.venue_suggestions(t["venues"], cards(spark, d), " 01 ", NOW, ["venue-1"]).select("slug", "rank", F.lit(False).alias("picked"))
    return found.unionByName(reads.selected_venues(t["venues"], ["venue-5", "venue-2"]).select("slug", F.lit(0).alias("rank"), F.lit(True).alias("picked")))


_MATCH = "CASE WHEN starts_with(lower({0}), 'r') THEN 0 WHEN contains(lower({0}), ' r') THEN 1 WHEN contains(lower({0}), 'r') THEN 2 END"


@query(
    f"""SELECT type, label, score FROM (
SELECT 'gig' AS type, 0 AS kind, label, score FROM (SELECT min_by(label, n) AS label, min_by(score, n) AS score FROM (SELECT n, title AS label, {_MATCH.format('title')} AS score FROM first) WHERE score IS NOT NULL GROUP BY lower(label))
UNION ALL SELECT 'artist', 1, label, score FROM (SELECT min_by(label, (score, n, pos)) AS label, min(score) AS score FROM (SELECT n, pos, label, {_MATCH.format('label')} AS score FROM (SELECT n, unnest(string_split(artist_names, '|')) AS label, generate_subscripts(string_split(artist_names, '|'), 1) AS pos FROM first WHERE artist_names <> '')) WHERE score IS NOT NULL GROUP BY lower(label))
UNION ALL SELECT 'venue', 2, name, least({_MATCH.format('name')}, {_MATCH.format("coalesce(suburb, '')")}) FROM venues WHERE slug IN (SELECT venue_slug FROM cards WHERE status = 'active' AND starts_at >= {_NOW}) AND (contains(lower(name), 'r') OR contains(coalesce(suburb, ''), 'r')))
WHERE score IS NOT NULL ORDER BY score, kind, lower(label) LIMIT 7""",
    *CARDS, f"first AS (SELECT *, row_number() OVER (ORDER BY starts_at, id) AS n FROM cards WHERE status = 'active' AND starts_at >= {_MIDNIGHT} ORDER BY starts_at, id LIMIT 120)",
)
def g13_suggestions(spark, d):
    """Q15, W8, W9, W10, F-S26: the 7 best of gigs, artists and venues, of the first 120 cards."""
    t = tables(spark, d)
    # names of the model may hold the SQL's separator
    plain = cards(spark, d).withColumn("artist_names", F.flatten(F.transform("artist_names", lambda n: F.split(n, "\\|"))))
    return reads.suggestions(plain, t["venues"], "R", NOW).select("type", "label", "score")


@query(
    f"""SELECT 'requested' AS what, max(CASE WHEN k = '2000-03-20' THEN k END) AS date_key FROM d UNION ALL SELECT 'missing', min(CASE WHEN k >= '2000-03-07' THEN k END) FROM d UNION ALL SELECT 'today', min(CASE WHEN k >= '2000-03-07' THEN k END) FROM d
UNION ALL SELECT 'weekend', min(CASE WHEN k IN ('2000-03-10', '2000-03-11', '2000-03-12') THEN k END) FROM d UNION ALL SELECT CASE min(CASE WHEN k >= '2000-03-07' THEN k END) WHEN '2000-03-07' THEN 'Today' WHEN '2000-03-08' THEN 'Tomorrow' ELSE 'Nearest' END, min(CASE WHEN k >= '2000-03-07' THEN k END) FROM d
UNION ALL SELECT 'hydrated', k FROM d WHERE k IN ('2000-03-10', '2000-03-11', '2000-03-12') OR k = (SELECT min(k) FROM d WHERE k >= '2000-03-07') OR k = '2000-03-20' OR k = (SELECT max(k) FROM d WHERE k < '2000-03-20') OR k = (SELECT min(k) FROM d WHERE k > '2000-03-20')
UNION ALL SELECT concat('month ', coalesce(lag(m) OVER (ORDER BY m), '-'), ' ', coalesce(lead(m) OVER (ORDER BY m), '-')), m FROM (SELECT DISTINCT substr(k, 1, 7) AS m FROM d)""",
    f"d AS (SELECT DISTINCT {_DAY.format('starts_at')} AS k FROM gigs WHERE status = 'active' AND venue_id IN ('v3', 'v4', 'v5', 'v6', 'v7', 'v8', 'v9', 'v10', 'v11', 'v12', 'v13') OR {_DAY.format('starts_at')} = '2000-03-20')",
)
def g14_day_choices(spark, d):
    """F-D24, F-D25, F-D26, H34, H36, W11, W12: days that requests lead to."""
    g = tables(spark, d)["gigs"].withColumn("date_key", D.day_key(F.col("starts_at")))
    days = g.where((F.col("status") == "active") & F.col("venue_id").isin(*(f"v{i}" for i in range(3, 14))) | (F.col("date_key") == "2000-03-20")).select("date_key").distinct()
    what = lambda rows, name: rows.select(F.lit(name).alias("what"), "date_key")
    months = reads.calendar_months(days)
    parts = [
        what(reads.resolved_day(days, "2000-03-20", NOW), "requested"), what(reads.resolved_day(days, "2050-01-01", NOW), "missing"), what(reads.shortcut_day(days, "today", NOW), "today"), what(reads.shortcut_day(days, "weekend", NOW), "weekend"),
        reads.today_label(days, NOW).select(F.col("label").alias("what"), "date_key"), what(reads.hydrated_days(days, "2000-03-20", NOW), "hydrated"),
        months.select(F.concat_ws(" ", F.lit("month"), F.coalesce("previous", F.lit("-")), F.coalesce("next", F.lit("-"))).alias("what"), F.col("month").alias("date_key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- audit ------------------------------------------------------------------------------------------------------

_NOISE = audit.duplicate_key.__globals__["DUPLICATE_NOISE"]
_WORDS = f"regexp_replace(regexp_replace(replace(lower(coalesce({{0}}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b({_NOISE})\\b', ' ', 'g')"
_KEY = f"array_to_string(list_filter(regexp_split_to_array(trim({_WORDS}), ' +'), lambda x: length(x) > 1), ' ')"
AUDITED = (
    *CARDS,
    f"keyed AS (SELECT *, {_KEY.format('title')} AS dup_key, {_DAY.format('starts_at')} AS day FROM cards WHERE starts_at >= TIMESTAMP '1999-12-31 16:00:00')",
    "pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.day, a.venue_slug, a.dup_key AS lk, b.dup_key AS rk, CASE WHEN a.dup_key = '' OR b.dup_key = '' THEN 0 ELSE len(list_intersect(list_distinct(string_split(a.dup_key, ' ')), list_distinct(string_split(b.dup_key, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(a.dup_key, ' '), string_split(b.dup_key, ' ')))) END AS score FROM keyed a JOIN keyed b ON a.day = b.day AND a.venue_slug = b.venue_slug AND a.id < b.id)",
    f"fuzzy AS (SELECT * FROM pairs WHERE score >= {audit.LEAST_JACCARD} OR (lk <> '' AND rk <> '' AND (contains(lk, rk) OR contains(rk, lk))))",
    "art AS (SELECT k.id, a.name AS artist FROM keyed k JOIN gig_artists ga ON ga.gig_id = k.id JOIN artists a ON a.id = ga.artist_id)",
)


def _audited(spark, d):
    return cards(spark, d).where(F.col("starts_at") >= D.literal(D.bounds_of_key("2000-01-01")[0]))


@query("SELECT day, venue_slug, left_id, right_id, round(score, 2) AS score FROM fuzzy", *AUDITED)
def g15_fuzzy_pairs(spark, d):
    """N2, J26, T4, F-S24, F-S25: alike titles of a venue's day."""
    return audit.fuzzy_pairs(_audited(spark, d))


_T, _P = "coalesce(title, '')", "concat_ws(' ', title, description, venue_name, venue_suburb)"
_IMG = "CASE WHEN (image_path IS NOT NULL OR source_image_url IS NOT NULL) AND coalesce(image_width > 0 AND image_height > 0, false) THEN 'renderable' WHEN image_path IS NOT NULL OR source_image_url IS NOT NULL THEN 'invalid' WHEN coalesce(source_name, '') = 'The Bird' THEN 'expected_none' ELSE 'none' END"
_VARIANT = "trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(artist), '\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b(the|tribute|show|set|act|band|dj|mc)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_HIT = lambda column, pattern: f"regexp_matches({column}, {sql_text(pattern)})"
FOUND = f"""found AS (
SELECT 'exact_duplicate' AS rule, 'error' AS level, k.id FROM keyed k JOIN (SELECT venue_slug, starts_at, dup_key FROM keyed GROUP BY 1, 2, 3 HAVING count(*) > 1) x ON k.venue_slug = x.venue_slug AND k.starts_at = x.starts_at AND k.dup_key = x.dup_key
UNION ALL SELECT 'fuzzy_duplicate', 'error', left_id FROM fuzzy UNION ALL SELECT 'artist_placeholder', 'error', id FROM art WHERE {_HIT('artist', audit.PLACEHOLDER)}
UNION ALL SELECT 'invalid_image_metadata', 'error', id FROM keyed WHERE {_IMG} = 'invalid' UNION ALL SELECT 'no_image', 'warning', id FROM keyed WHERE {_IMG} = 'none'
UNION ALL SELECT 'missing_artist_candidate', 'warning', id FROM keyed WHERE artist_names = '' AND NOT {_HIT("concat_ws(' ', title, description)", audit.THEME_PARTY)} AND ({_HIT("concat_ws(' ', title, description)", audit.EXPLICIT_LINEUP)} OR {_HIT("concat_ws(' ', title, description)", audit.NAMES_WITH_PLUS)})
UNION ALL SELECT 'public_text_encoding', 'warning', id FROM keyed k WHERE {_HIT(_T, audit.ENTITY_LEAK)} OR {_HIT(_T, audit.QUESTION_MARKS)} OR id IN (SELECT id FROM art WHERE {_HIT('artist', audit.ENTITY_LEAK)})
UNION ALL SELECT 'artist_delimiter', 'warning', id FROM art WHERE {_HIT('artist', audit.DELIMITER)} UNION ALL SELECT 'artist_sentence_fragment', 'warning', id FROM art WHERE {_HIT('artist', audit.FRAGMENT)} UNION ALL SELECT 'generic_artist_token', 'warning', id FROM art WHERE {_HIT('artist', audit.GENERIC)}
UNION ALL SELECT 'duplicate_artist_variant', 'warning', id FROM (SELECT id, {_VARIANT} AS v FROM art GROUP BY 1, 2 HAVING v <> '' AND count(DISTINCT artist) > 1)
UNION ALL SELECT 'empty_artist_title_lineup', 'warning', id FROM keyed WHERE artist_names = '' AND {_HIT(_T, audit.LINEUP_TITLE)} AND NOT {_HIT(_T, audit.NOT_A_LINEUP)}
UNION ALL SELECT 'non_music_candidate', 'warning', id FROM keyed WHERE regexp_matches(coalesce(source_name, ''), 'NATION_1') AND {_HIT(_P, audit.NON_MUSIC)}
UNION ALL SELECT 'notable', 'note', id FROM keyed WHERE regexp_matches({_T}, '(?i)widget|bolt'))"""


def _renamed(spark, d):
    """The audited cards; sources with a 1 are vetted ones, under a name that the rule knows."""
    name = F.col("source_name")
    return _audited(spark, d).withColumn("source_name", F.when(name.contains("NATION_1"), F.concat(F.lit("Humanitix "), name)).otherwise(name))


@query("SELECT rule, level, count(*) AS n, count(DISTINCT id) AS n_gigs, min(id) AS first_gig FROM found GROUP BY 1, 2", *AUDITED, FOUND)
def g16_findings(spark, d):
    """All rules as one union."""
    found = audit.findings(_renamed(spark, d), ["widget|bolt"])
    return found.groupBy("rule", "level").agg(F.count("*").alias("n"), F.count_distinct("gig_id").alias("n_gigs"), F.min("gig_id").alias("first_gig"))


@query(
    """SELECT strict, CASE WHEN e > 0 OR (strict AND w > 0) THEN 'fail' WHEN w > 0 THEN 'warning' ELSE 'pass' END AS result, e AS errors, w AS warnings FROM (SELECT count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w FROM found), (VALUES (true), (false)) s(strict)
UNION ALL SELECT strict, CASE WHEN strict AND w > 0 THEN 'fail' WHEN w > 0 THEN 'warning' ELSE 'pass' END, 0, w FROM (SELECT count(*) FILTER (level = 'warning') AS w FROM found), (VALUES (true), (false)) s(strict)""",
    *AUDITED, FOUND,
)
def g17_verdict(spark, d):
    """Pass, warning or fail."""
    found = apart(audit.findings(_renamed(spark, d), ["widget|bolt"]).groupBy("level").agg(F.count("*").alias("n")))  # one exchange for all four
    mild = found.where("level != 'error'")
    out = None
    for rows in (found, mild):
        for strict in (True, False):
            one = audit.verdict(rows, strict).select(F.lit(strict).alias("strict"), "result", "errors", "warnings")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""SELECT l.source_name, count(*) AS total, count(*) FILTER (g.status = 'active') AS active, count(*) FILTER (g.status = 'active' AND c.id IS NULL) AS without_card, count(*) FILTER (g.status = 'active' AND c.id IS NOT NULL AND coalesce(c.source_name, '(none)') <> l.source_name) AS owned_elsewhere,
  array_to_string(list_slice(list_sort(list_distinct(list(g.title) FILTER (g.status = 'active' AND c.id IS NOT NULL AND coalesce(c.source_name, '(none)') <> l.source_name))), 1, 5), ';') AS examples
FROM lin l JOIN gigs g ON g.id = l.gig_id LEFT JOIN cards c ON c.id = g.id WHERE l.pub AND g.starts_at >= {_NOW} GROUP BY 1""",
    *CARDS,
)
def g18_reconciliation(spark, d):
    """What each source lists, and what became of it."""
    out = audit.reconciliation(tables(spark, d), cards(spark, d), NOW)
    return out.select("source_name", "total", "active", "without_card", "owned_elsewhere", F.array_join("owned_elsewhere_examples", ";").alias("examples"))


@query(
    f"""SELECT 'handoff' AS what, concat(l.source_name, '>', c.source_name) AS k, count(*) AS n FROM lin l JOIN gigs g ON g.id = l.gig_id JOIN cards c ON c.id = g.id WHERE l.pub AND g.starts_at >= {_NOW} AND g.status = 'active' AND c.source_name <> l.source_name GROUP BY 2
UNION ALL SELECT 'owner', source_name, count(*) FROM cards GROUP BY 2""",
    *CARDS,
)
def g19_handoffs(spark, d):
    """Cards by owner, and rows whose card another source owns."""
    c = cards(spark, d)
    moved = audit.handoffs(tables(spark, d), c, NOW).select(F.lit("handoff").alias("what"), F.concat_ws(">", "from_source", "to_source").alias("k"), "n")
    return moved.unionByName(audit.source_counts(c).select(F.lit("owner").alias("what"), F.col("source_name").alias("k"), "n"))


# --- matching ---------------------------------------------------------------------------------------------------

_PLAIN = "regexp_replace(regexp_replace(regexp_replace(replace({0}, '&amp;', '&'), '(?i)\\b([0-9]+)(st|nd|rd|th)\\b', '\\1', 'g'), '(?i)\\b(album launch|birthday|in concert|live|tour|20[0-9]{{2}})\\b', ' ', 'g'), '(?i)\\bfestival(\\s+20[0-9]{{2}})?\\b$', ' ', 'g')"
_SLUG = "coalesce(nullif(trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
_CANON = _SLUG.format(_PLAIN)
_STOPS = "['a','an','and','at','by','for','from','in','of','on','the','to','with']"


def _compatible(a: str, b: str) -> str:
    w = lambda x: f"list_distinct(string_split({x}, '-'))"
    p = lambda x: f"list_filter({w(x)}, lambda y: NOT list_contains({_STOPS}, y))"
    common = f"len(list_intersect({p(a)}, {p(b)}))"
    small, large = (f"{f}(len({p(a)}), len({p(b)}))" for f in ("least", "greatest"))
    return f"({a} = {b} OR (len({w(a)}) >= 2 AND len({w(a)}) = len({w(b)}) AND len(list_intersect({w(a)}, {w(b)})) = len({w(a)})) OR ({common} = {small} AND {common} >= 3 AND {large} - {small} <= 2))"


LISTED = (
    f"listed AS (SELECT concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS listing_id, 'v' || (1 + l_suppkey % 40) AS venue_id, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS starts_at, CASE l_linenumber WHEN 1 THEN 'Red Ring 1' WHEN 2 THEN 'Red Ring Tour 2' WHEN 3 THEN 'Friends of the Blue Bolt' WHEN 4 THEN 'Blue Bolt and Friends' WHEN 5 THEN 'Small Gear with Yoga Class Band' ELSE 'Hot Widget w/ Cold Nut' END AS title, CASE WHEN l_partkey % 2 = 0 THEN 'g' || l_orderkey END AS own_gig_id FROM lineitem)",
    f"l1 AS (SELECT DISTINCT *, {_DAY.format('starts_at')} AS day, {_SLUG.format('title')} AS slug, {_CANON.format('title')} AS canonical FROM listed)",
    f"g1 AS (SELECT id AS gig_id, venue_id, starts_at AS g_at, {_DAY.format('starts_at')} AS day, {_SLUG.format('replace(title, ' + chr(39) + '&amp;' + chr(39) + ', ' + chr(39) + '&' + chr(39) + ')')} AS g_slug, {_CANON.format('title')} AS g_canonical FROM gigs)",
)


def _listings(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    case = "CASE l_linenumber WHEN 1 THEN 'Red Ring 1' WHEN 2 THEN 'Red Ring Tour 2' WHEN 3 THEN 'Friends of the Blue Bolt' WHEN 4 THEN 'Blue Bolt and Friends' WHEN 5 THEN 'Small Gear with Yoga Class Band' ELSE 'Hot Widget w/ Cold Nut' END"
    start = "CAST(l_shipdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(l_orderkey % 24 AS INT))"
    return written(rows.selectExpr("concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS listing_id", "concat('v', 1 + l_suppkey % 40) AS venue_id", f"{start} AS starts_at", f"{case} AS title", "CASE WHEN l_partkey % 2 = 0 THEN concat('g', l_orderkey) END AS own_gig_id").distinct(), "listings")  # read for titles and for themselves


@query(
    f"""SELECT l1.listing_id, CASE WHEN t1 IS NOT NULL THEN t1 WHEN n2 = 1 THEN t2 WHEN n2 = 0 AND n3 = 1 THEN t3 END AS gig_id, CASE WHEN t1 IS NOT NULL THEN 1 WHEN n2 = 1 THEN 2 WHEN n2 = 0 AND n3 = 1 THEN 3 END AS tier
FROM l1 LEFT JOIN (SELECT listing_id, min(gig_id) FILTER (exact) AS t1, count(*) FILTER (same) AS n2, min(gig_id) FILTER (same) AS t2, count(*) FILTER (fuzzy) AS n3, min(gig_id) FILTER (fuzzy) AS t3
  FROM (SELECT listing_id, gig_id, starts_at = g_at AND slug = g_slug AS exact, canonical = g_canonical AS same, {_compatible('canonical', 'g_canonical')} AS fuzzy FROM l1 JOIN g1 USING (venue_id, day) WHERE own_gig_id IS NULL OR own_gig_id <> gig_id) GROUP BY 1) f ON f.listing_id = l1.listing_id""",
    *LISTED,
)
def g20_match_tiers(spark, d):
    """J14 to J16, F-S4 to F-S6, F-S11: three tiers in one blocked join."""
    g = tables(spark, d)["gigs"].select(F.col("id").alias("gig_id"), "venue_id", "starts_at", "title")
    return X.match_tiers(_listings(spark, d), g)


@query(
    """SELECT listing_id, min(id) AS source_gig_id FROM (SELECT l.listing_id, s.id FROM asked l JOIN source_gigs s ON s.source_id = l.source_id AND s.external_id = l.external_id UNION ALL SELECT l.listing_id, s.id FROM asked l JOIN source_gigs s ON s.source_id = l.source_id AND s.checksum = l.checksum WHERE l.external_id IS NULL) GROUP BY 1""",
    "asked AS (SELECT concat('p', p_partkey) AS listing_id, concat('s', p_size % 25) AS source_id, CASE WHEN p_brand <> 'Brand#1' THEN concat('x', p_partkey) END AS external_id, concat('c', p_partkey) AS checksum FROM part)",
)
def g21_identity(spark, d):
    """By external id, else by checksum."""
    part = spark.read.parquet(f"{d}/part.parquet")
    asked = part.selectExpr("concat('p', p_partkey) AS listing_id", "concat('s', p_size % 25) AS source_id", "CASE WHEN p_brand <> 'Brand#1' THEN concat('x', p_partkey) END AS external_id", "concat('c', p_partkey) AS checksum")
    return X.identity_match(asked, tables(spark, d)["source_gigs"])


@query(
    """SELECT gig_id, source_id AS owner_source_id, priority AS owner_priority, starts_at_precision AS owner_precision, any_exact FROM (
SELECT l.*, max(starts_at_precision = 'exact') OVER (PARTITION BY gig_id) AS any_exact, row_number() OVER (PARTITION BY gig_id ORDER BY CASE WHEN l.source_url = g.source_url THEN 0 ELSE 1 END, priority DESC, l.id DESC) AS rn FROM lin l JOIN gigs g ON g.id = l.gig_id) WHERE rn = 1""",
    LIN,
)
def g22_owner(spark, d):
    """The source whose URL the gig has, else the one of highest priority."""
    t = tables(spark, d)
    return X.owner_of(t["gigs"].select("id", "source_url"), views.lineage(t).select("gig_id", "source_id", "source_url", "priority", "starts_at_precision", "id"))


@query(
    """SELECT gig_id, source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY gig_id, source_id ORDER BY CASE WHEN identity_key = 'x7' THEN 0 ELSE 1 END, CASE WHEN image_mirror_status = 'ready' AND mirrored_image_path IS NOT NULL THEN 0 ELSE 1 END, last_seen_at DESC, created_at DESC, id) AS rn FROM source_gigs) WHERE rn = 1"""
)
def g23_keeper(spark, d):
    """The row of a source that stays on a gig."""
    return R.best_row(tables(spark, d)["source_gigs"], ["gig_id", "source_id"], X.keeper_order(F.lit("x7"))).select("gig_id", "source_id", "id")


_EVENTS = (
    "e0 AS (SELECT concat('https://links.example.com/', l_orderkey) AS url, min(l_shipdate) AS day_of, min(l_suppkey) AS sk, min(l_linenumber) AS ln FROM lineitem GROUP BY l_orderkey)",
    f"ev AS (SELECT url, {_DAY.format('day_of + INTERVAL 12 HOUR')} AS date_key, day_of + INTERVAL 12 HOUR AS e_at, CASE ln WHEN 1 THEN 'Red Ring Tour 1' WHEN 2 THEN 'small ring' WHEN 3 THEN 'Blue Bolt & Friends' ELSE 'Hot Widget w/ Cold Nut' END AS title, concat('Customer#', lpad(CAST(1 + sk % 40 AS VARCHAR), 9, '0')) AS venue_name FROM e0)",
    f"e1 AS (SELECT *, {_SLUG.format('title')} AS e_slug, {_CANON.format('title')} AS e_canonical, {_SLUG.format('venue_name')} AS e_venue FROM ev)",
    f"gg AS (SELECT g.id AS gig_id, starts_at AS g_at, {_DAY.format('starts_at')} AS date_key, {_SLUG.format('replace(title, ' + chr(39) + '&amp;' + chr(39) + ', ' + chr(39) + '&' + chr(39) + ')')} AS slug, {_CANON.format('title')} AS canonical, {_SLUG.format('v.name')} AS venue, v.slug AS venue_slug, tixel_url FROM gigs g JOIN venues v ON v.id = venue_id)",
    "perf AS (SELECT DISTINCT gig_id, " + _SLUG.format("replace(name, '&amp;', '&')") + " AS k FROM gig_artists ga JOIN artists a ON a.id = ga.artist_id)",
    f"pairs AS (SELECT gig_id, url, slug = e_slug AS exact, {_compatible('canonical', 'e_canonical')} AS alike, (gig_id, e_slug) IN (FROM perf) AS performer, e_venue IN (venue, venue_slug) AS at_venue, abs(epoch_us(g_at) - epoch_us(e_at)) <= 900000000 AS at_time FROM gg JOIN e1 USING (date_key))",
    "scores AS (SELECT gig_id, url, CASE WHEN exact AND at_venue AND at_time THEN 3 WHEN (exact AND at_time) OR ((alike OR performer) AND at_venue AND at_time) THEN 2 WHEN exact AND at_venue THEN 1 ELSE 0 END AS confidence FROM pairs)",
)


def _links(spark, d):
    """(gigs, events, performers) as link matching takes them."""
    t = tables(spark, d)
    v = t["venues"].select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), F.col("slug").alias("venue_slug"))
    gigs = t["gigs"].select(F.col("id").alias("gig_id"), "venue_id", "title", "starts_at", "tixel_url").join(v, "venue_id")
    keys = apart(t["artists"].where(F.trim("name") != "").select(F.col("id").alias("artist_id"), slugify(F.col("name")).alias("key")))
    performers = t["gig_artists"].select("gig_id", "artist_id").join(keys, "artist_id").select("gig_id", "key")
    line = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("timestamp")).alias("at"), F.min("l_suppkey").alias("sk"), F.min("l_linenumber").alias("ln"))
    title = F.when(F.col("ln") == 1, "Red Ring Tour 1").when(F.col("ln") == 2, "small ring").when(F.col("ln") == 3, "Blue Bolt & Friends").otherwise("Hot Widget w/ Cold Nut")
    at = F.col("at") + F.expr("interval 12 hours")
    events = line.select(F.concat(F.lit("https://links.example.com/"), "l_orderkey").alias("url"), D.day_key(at).alias("date_key"), title.alias("title"), at.alias("starts_at"), F.concat(F.lit("Customer#"), F.lpad((1 + F.col("sk") % 40).cast("string"), 9, "0")).alias("venue_name"))
    return gigs, events, performers


@query("SELECT gig_id, url, confidence FROM scores WHERE confidence > 0", *_EVENTS)
def g24_link_scores(spark, d):
    """J18, F-S28, F-S29: secondary links scored by title, performer, venue and time."""
    return X.link_scores(*_links(spark, d))


_ASSIGNED = (
    "kept AS (SELECT s.gig_id, s.url FROM scores s JOIN gg g ON g.gig_id = s.gig_id AND g.tixel_url = s.url WHERE confidence > 0)",
    "free AS (SELECT * FROM scores WHERE confidence > 0 AND gig_id NOT IN (SELECT gig_id FROM kept) AND url NOT IN (SELECT url FROM kept))",
    "best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY url ORDER BY confidence DESC) AS rk FROM free) WHERE rk = 1)",
    "counted AS (SELECT *, count(*) OVER (PARTITION BY url) AS pu, count(*) OVER (PARTITION BY gig_id) AS pg FROM best)",
    "assigned AS (SELECT url, gig_id, 'reserved' AS outcome FROM kept UNION ALL SELECT url, max(CASE WHEN pu = 1 AND pg = 1 THEN gig_id END) AS g, CASE WHEN g IS NULL THEN 'ambiguous' ELSE 'matched' END FROM counted GROUP BY url)",
)


@query("SELECT url, gig_id, outcome FROM assigned", *_EVENTS, *_ASSIGNED)
def g25_assign_links(spark, d):
    """One to one; ambiguity gives none."""
    return X.assign_links(*_links(spark, d))


@query("SELECT g.gig_id, g.tixel_url AS from_url, a.url AS to_url, CASE WHEN g.tixel_url IS NOT DISTINCT FROM a.url THEN 'unchanged' WHEN a.url IS NULL THEN 'clear' ELSE 'set' END AS change FROM gg g LEFT JOIN assigned a ON a.gig_id = g.gig_id AND a.outcome <> 'ambiguous' WHERE date_key IN (SELECT date_key FROM ev)", *_EVENTS, *_ASSIGNED)
def g26_link_changes(spark, d):
    """Set, clear or unchanged, on the days that were searched."""
    gigs, events, performers = _links(spark, d)
    return X.link_changes(gigs, X.assign_links(gigs, events, performers), events)


@query("SELECT DISTINCT url FROM pairs WHERE exact OR alike", *_EVENTS)
def g27_plausible_cards(spark, d):
    """Discovery cards that some gig of the day could be. Cards have no time, so titles decide."""
    gigs, events, _ = _links(spark, d)
    return X.plausible_cards(events.drop("starts_at"), gigs).select("url")


# --- merges -----------------------------------------------------------------------------------------------------


@query(
    """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN coalesce(n.name, o.name) ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.suburb ELSE o.suburb END AS suburb, o.address,
CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND (coalesce(n.name, o.name) IS DISTINCT FROM o.name OR n.suburb IS DISTINCT FROM o.suburb)) THEN '2000-03-07' ELSE '1990-01-01' END AS updated
FROM (SELECT * FROM venues WHERE website_url IS NOT NULL) o FULL JOIN (SELECT id, CASE WHEN suburb = 'building' THEN NULL ELSE name END AS name, CASE WHEN suburb = 'machinery' THEN 'new' ELSE suburb END AS suburb FROM venues WHERE suburb IS NOT NULL) n ON o.id = n.id""",
)
def g28_upsert(spark, d):
    """Rules for columns, kept columns, and updated_at where something changed."""
    v = tables(spark, d)["venues"]
    old = v.where("website_url is not null").select("id", "name", "suburb", "address", F.lit("1990-01-01").alias("updated_at"))
    new = v.where("suburb is not null").select("id", F.when(F.col("suburb") == "building", None).otherwise(F.col("name")).alias("name"), F.when(F.col("suburb") == "machinery", "new").otherwise(F.col("suburb")).alias("suburb"))
    out = M.upsert(old, new, ["id"], {"name": F.coalesce("new.name", "old.name")}, F.lit("2000-03-07"))
    return out.withColumnRenamed("updated_at", "updated")


@query(
    """SELECT 'replaced' AS what, gig_id AS a, artist_id AS b FROM gig_artists WHERE gig_id NOT IN (SELECT gig_id FROM gig_artists WHERE artist_id = 'a5') UNION ALL SELECT 'replaced', gig_id, 'new' FROM gig_artists WHERE artist_id = 'a5'
UNION ALL SELECT 'absent', id, name FROM venues WHERE suburb IS NOT NULL UNION ALL SELECT 'absent', id, address FROM venues WHERE suburb IS NULL
UNION ALL SELECT 'moved', id, CASE WHEN venue_id IN ('v1', 'v2') THEN 'v3' ELSE venue_id END FROM gigs
UNION ALL SELECT 'kept', id, slug FROM venues WHERE NOT (coalesce(suburb, '') = 'building' AND id NOT IN (SELECT venue_id FROM gigs))"""
)
def g29_table_edits(spark, d):
    """Groups replaced, absent rows put in, references moved, unreferenced rows taken out."""
    t = tables(spark, d)
    ga, v = t["gig_artists"].select("gig_id", "artist_id"), t["venues"]
    part = lambda rows, what, a, b: rows.select(F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))
    replaced = M.replace_groups(ga, ga.where("artist_id = 'a5'").withColumn("artist_id", F.lit("new")), "gig_id")
    absent = M.insert_absent(v.where("suburb is not null").select("id", "name"), v.select("id", F.col("address").alias("name")), ["id"])
    mapping = spark.createDataFrame([("v1", "v3"), ("v2", "v3")], "from_id string, to_id string")
    kept = M.delete_unreferenced(v.select("id", "slug"), "id", v.where("suburb = 'building'").select("id"), t["gigs"], "venue_id")
    return part(replaced, "replaced", "gig_id", "artist_id").unionByName(part(absent, "absent", "id", "name")).unionByName(part(M.repoint(t["gigs"].select("id", "venue_id"), mapping, "venue_id"), "moved", "id", "venue_id")).unionByName(part(kept, "kept", "id", "slug"))


# --- images -----------------------------------------------------------------------------------------------------

_OBJECTS = ("objects AS (SELECT concat('sha256/ab/', p_partkey) AS path, CAST(p_size AS BIGINT) AS bytes FROM part WHERE p_size > 3)",
            "used AS (SELECT mirrored_image_path AS path, max(g.starts_at) AS last FROM source_gigs s JOIN gigs g ON g.id = s.gig_id WHERE mirrored_image_path IS NOT NULL GROUP BY 1)",
            "cand AS (SELECT path, coalesce(bytes, 0) AS bytes, 'expired' AS kind FROM used LEFT JOIN objects USING (path) WHERE last < TIMESTAMP '2001-07-02 04:00:00' UNION ALL SELECT path, bytes, 'orphaned' FROM objects WHERE path NOT IN (SELECT mirrored_image_path FROM source_gigs WHERE mirrored_image_path IS NOT NULL))")
LATE = datetime(2001, 7, 16, 4, 0, tzinfo=timezone.utc)


def _images(spark, d):
    t = tables(spark, d)
    objects = spark.read.parquet(f"{d}/part.parquet").where("p_size > 3").select(F.concat(F.lit("sha256/ab/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("bytes"))
    return t, I.cleanup_candidates(objects, t["source_gigs"], t["gigs"], LATE)


@query("SELECT path, bytes, kind FROM cand", *_OBJECTS)
def g30_cleanup_candidates(spark, d):
    """J24, J25, T2, F-D27, X9: expired before orphaned; a path in use by a newer gig is protected."""
    return _images(spark, d)[1]


@query(
    """SELECT dry_run, count(*) FILTER (kind = 'expired') AS expired_objects, coalesce(sum(bytes) FILTER (kind = 'expired'), 0)::BIGINT AS expired_bytes, count(*) FILTER (kind = 'orphaned') AS orphaned_objects, coalesce(sum(bytes) FILTER (kind = 'orphaned'), 0)::BIGINT AS orphaned_bytes, count(*) AS selected_objects, coalesce(sum(bytes), 0)::BIGINT AS selected_bytes,
  count(*) FILTER (ok AND NOT dry_run) AS deleted_objects, coalesce(sum(bytes) FILTER (ok AND NOT dry_run), 0)::BIGINT AS deleted_bytes, count(*) FILTER (NOT ok AND NOT dry_run) AS failed_objects FROM (SELECT *, bytes % 2 = 0 AS ok FROM cand), (VALUES (true), (false)) m(dry_run) GROUP BY 1""",
    *_OBJECTS,
)
def g31_cleanup_summary(spark, d):
    """A dry run, and one in which some objects could not be deleted."""
    _, found = _images(spark, d)
    return I.cleanup_summary(found).unionByName(I.cleanup_summary(found, found.where("bytes % 2 = 0").select("path")))


@query(
    """SELECT id, CASE WHEN gone THEN NULL ELSE mirrored_image_path END AS path, CASE WHEN gone THEN NULL ELSE mirrored_image_width END AS width, CASE WHEN gone THEN 'missing' ELSE image_mirror_status END AS status FROM (SELECT *, coalesce(mirrored_image_path IN (SELECT path FROM cand WHERE kind = 'expired' AND bytes % 2 = 0), false) AS gone FROM source_gigs)""",
    *_OBJECTS,
)
def g32_clear_references(spark, d):
    """Rows whose image is gone."""
    t, found = _images(spark, d)
    out = I.clear_references(t["source_gigs"], found, found.where("bytes % 2 = 0").select("path"))
    return out.select("id", F.col("mirrored_image_path").alias("path"), F.col("mirrored_image_width").alias("width"), F.col("image_mirror_status").alias("status"))


@query(
    """SELECT s.id, CASE WHEN ok THEN r.path ELSE mirrored_image_path END AS path, CASE WHEN ok THEN 9 ELSE mirrored_image_width END AS width, CASE WHEN ok THEN 'ready' WHEN NOT ok THEN 'failed' ELSE image_mirror_status END AS status, strftime(CASE WHEN ok THEN TIMESTAMP '2000-03-07 04:00:00' ELSE image_mirrored_at END, '%Y-%m-%d %H:%M:%S') AS at
FROM (SELECT DISTINCT ON (id) * FROM source_gigs) s LEFT JOIN (SELECT DISTINCT id, identity_key LIKE 'x%' AS ok, 'new/' || id AS path FROM source_gigs WHERE image_mirror_status = 'pending' AND source_id = 's3') r ON r.id = s.id"""
)
def g33_mirror_results(spark, d):
    """Pending rows become ready or failed; a failed one keeps its path."""
    rows = tables(spark, d)["source_gigs"].dropDuplicates(["id"])
    results = rows.where("image_mirror_status = 'pending' AND source_id = 's3'").select("id", F.col("identity_key").startswith("x").alias("ok"), F.concat(F.lit("new/"), "id").alias("path"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    out = I.apply_mirror_results(rows, results, NOW)
    return out.select("id", F.col("mirrored_image_path").alias("path"), F.col("mirrored_image_width").alias("width"), F.col("image_mirror_status").alias("status"), stamp("image_mirrored_at").alias("at"))


@query(
    """SELECT event_type AS host, count(*) AS requests, count(*) FILTER (status IS NULL OR status >= 400) AS errors, round(avg(value), 6) AS header_ms, string_agg(DISTINCT coalesce(CAST(floor(status / 100) AS INT) || 'xx', 'none'), ',' ORDER BY coalesce(CAST(floor(status / 100) AS INT) || 'xx', 'none')) AS classes
FROM (SELECT event_type, value, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 503 WHEN user_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM events) GROUP BY 1"""
)
def g34_request_metrics(spark, d):
    """A14, F-M3: requests of a host."""
    e = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("user_id") % 10 == 0, None).when(F.col("user_id") % 7 == 0, 503).when(F.col("user_id") % 5 == 0, 404).otherwise(200)
    out = I.request_metrics(e.select(F.col("event_type").alias("host"), status.alias("status"), F.col("value").alias("header_ms")))
    return out.select("host", "requests", "errors", F.round("header_ms", 6).alias("header_ms"), F.array_join(F.sort_array(F.map_keys("classes")), ",").alias("classes"))


# --- shapes of rows ---------------------------------------------------------------------------------------------


@query(
    f"""SELECT venue_id, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT venue_id, k, loaded, rn - row_number() OVER (PARTITION BY venue_id, loaded ORDER BY k) AS i FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY k) AS rn FROM (SELECT venue_id, {_DAY.format('starts_at')} AS k, max(status = 'active') AS loaded FROM gigs GROUP BY 1, 2))) WHERE loaded GROUP BY venue_id, i"""
)
def g35_islands(spark, d):
    """Runs of loaded days of each venue."""
    g = tables(spark, d)["gigs"].groupBy("venue_id", D.day_key(F.col("starts_at")).alias("k")).agg(F.max(F.col("status") == "active").alias("loaded"))
    return R.islands(g, "k", F.col("loaded"), ["venue_id"]).select("venue_id", "first", "last", "n")


@query(
    f"""SELECT day, position, url FROM (SELECT day, url, row_number() OVER (PARTITION BY day ORDER BY seen, id) AS position FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day, seen, id) AS rn FROM (SELECT id, source_image_url AS url, last_seen_at AS seen, {_DAY.format('last_seen_at')} AS day FROM source_gigs WHERE source_image_url IS NOT NULL)) WHERE rn = 1)) WHERE position <= 3"""
)
def g36_urls_per_day(spark, d):
    """The first three URLs of each day, none twice."""
    rows = tables(spark, d)["source_gigs"].select("id", F.col("source_image_url").alias("url"), F.col("last_seen_at").alias("at"), D.day_key(F.col("last_seen_at")).alias("day"))
    return R.distinct_urls_per_day(rows, "day", ["at", "id"], "url", 3).select("day", F.col("position").cast("long").alias("position"), "url")


@query("SELECT status, n, ex AS examples FROM (SELECT status, count(*) AS n, array_to_string(list_slice(list(id || '!' ORDER BY starts_at, id), 1, 4), ',') AS ex FROM gigs GROUP BY 1)")
def g37_examples(spark, d):
    """Counts with a few examples."""
    out = R.examples(tables(spark, d)["gigs"], ["status"], ["starts_at", "id"], F.concat("id", F.lit("!")), 4)
    return out.select("status", "n", F.array_join("examples", ",").alias("examples"))


@query(
    """SELECT checksum, 'last' AS what, arg_max(id, (last_seen_at, id)) AS id, NULL AS "at" FROM source_gigs GROUP BY 1 UNION ALL SELECT checksum, 'both', arg_max(id, concat(strftime(last_seen_at, '%Y-%m-%d'), id)), min(concat(strftime(last_seen_at, '%Y-%m-%d'), id)) FROM source_gigs GROUP BY 1"""
)
def g38_last_values(spark, d):
    """The last value of a key, and the first place with the last value."""
    rows = tables(spark, d)["source_gigs"].select("checksum", "id", F.struct("last_seen_at", "id").alias("o"), F.concat(F.date_format("last_seen_at", "yyyy-MM-dd"), "id").alias("at"))
    last = R.last_per_key(rows, ["checksum"], "o", ["id"]).select("checksum", F.lit("last").alias("what"), "id", F.lit(None).cast("string").alias("at"))
    return last.unionByName(R.first_position_last_value(rows, ["checksum"], "at", ["id"]).select("checksum", F.lit("both").alias("what"), "id", "at"))
