"""Audit rules over public cards. Each gives findings (rule, level, gig_id, detail); all of them are one union."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions.dates import day_key, literal
from stagelight.functions.text import duplicate_key, jaccard, let, session_of, variant_identity
from stagelight.functions.urls import ticket_identity
from stagelight.operators.dealing import shared

LEAST_JACCARD = 0.72
#: The patterns of the rules.
PLACEHOLDER = "(?i)\\b(?:special guest(?:s)?(?: to be announced)?|guest(?:s)?\\s*(?:tba|tbc|to be announced)|support(?:s| acts?)?\\s*(?:tba|tbc|to be announced)|more\\s*(?:tba|tbc|to be announced)|to be announced|tba|tbc|homepage gallery|lineup announced soon|secret guest)\\b"
ENTITY_LEAK = "(?i)&(?:amp|apos|gt|lt|nbsp|quot|#\\d+|#x[0-9a-f]+);"
QUESTION_MARKS = "\\?{3,}"
DELIMITER = "[•;]|(?:\\s[|+]\\s)|(?:··)"
FRAGMENT = "(?i)^(?:and\\s+|ft\\.?\\s+|performed\\s+by\\s+|at\\s+local\\b|style$|shows?$|making\\b|listen\\b|tune\\b|her\\s+music\\b|his\\s+music\\b|their\\s+music\\b|music\\s+by\\b|support\\s+set\\b|past$|present\\s+members?$)"
GENERIC = "(?i)^(?:dj|band|live\\s+abba\\s+tribute\\s+act|.+\\btribute\\s+set)$"
LINEUP_TITLE = "(?i)(?:,|\\sw[/.]\\s|\\s\\+\\s)"
NOT_A_LINEUP = "(?i)\\b(?:vs|party|appreciation|karaoke|tickets?|conference|concert|calypso|euphoric|worship|pre-party|long weekend|top 100|after party|brunch|rave|tribute|show|experience|anthems|session|sessions)\\b|man from snowy river"
NON_MUSIC = "(?i)\\b(?:cocktail|ecstatic|wellness|workshop|networking|seminar|class|classes|social|catch up|market|markets|comedy|wrestling|boxing|expo|conference|meditation|breathwork|yoga|sound healing|bridgerton|ball)\\b"
FUNDRAISER = "(?i)\\bfundraiser\\b"
MUSIC_SIGNAL = "(?i)\\b(?:band|bands|dj|live music|gig|concert|festival|supported by|support from|with support|featuring|feat\\.?|ft\\.?|lineup|album|single|launch|punk|metal|rock|jazz|folk|hip hop|electronic|techno|house|disco)\\b"
EXPLICIT_LINEUP = "(?i)\\b(?:feat\\.?|ft\\.?|featuring|with special guest|with support|support from|supported by|lineup|presents)\\b"
NAMES_WITH_PLUS = "\\b[A-Za-z][A-Za-z0-9'’&./-]*(?:\\s+[A-Za-z][A-Za-z0-9'’&./-]*){0,5}\\s+\\+\\s+[A-Za-z][A-Za-z0-9'’&./-]*(?:\\s+[A-Za-z][A-Za-z0-9'’&./-]*){0,5}\\b"
THEME_PARTY = "(?i)\\b(?:worship party|after party|djs?\\s+playing\\s+the\\s+best\\s+of|vs\\b.+\\bparty)\\b"
NO_IMAGE_EXPECTED = ("The Bird",)
VETTED_SOURCES = "Humanitix|Ticketek"


def duplicates(cards: DataFrame) -> DataFrame:
    """(id, title_key) of cards of one venue, start and title key of which there are several; no group is gathered."""
    keyed = cards.select("id", "venue_slug", "starts_at", duplicate_key(F.col("title")).alias("title_key"))
    again = keyed.groupBy("venue_slug", "starts_at", "title_key").agg(F.count("*").alias("n")).where("n > 1")
    same = F.equal_null(keyed["venue_slug"], again["venue_slug"]) & F.equal_null(keyed["starts_at"], again["starts_at"]) & F.equal_null(keyed["title_key"], again["title_key"])
    return keyed.join(again, same, "left_semi").select("id", "title_key")


def duplicate_groups(cards: DataFrame) -> DataFrame:
    """venue_slug, starts_at, title_key, n, ids of groups of two or more."""
    return cards.groupBy("venue_slug", "starts_at", duplicate_key(F.col("title")).alias("title_key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")


def fuzzy_pairs(cards: DataFrame, least: float = LEAST_JACCARD) -> DataFrame:
    """left_id < right_id of one venue and local day whose keys are alike (Jaccard) or one within the other, with the
    score; an early and a late show with different starts and tickets are two events. Distinct keys of a venue's day are
    compared, and cards meet by the pairs of keys that pass."""
    side = lambda p: cards.select(day_key(F.col("starts_at")).alias("day"), "venue_slug", *(c.alias(f"{p}_{n}") for n, c in (("id", F.col("id")), ("key", duplicate_key(F.col("title"))), ("session", session_of(F.col("title"))), ("at", F.col("starts_at")), ("ticket", ticket_identity(F.col("ticket_url"))))))
    left, right = shared(side("left"), "day", "venue_slug"), shared(side("right"), "day", "venue_slug")
    keys = left.select("day", "venue_slug", "left_key").distinct().join(right.select("day", "venue_slug", "right_key").distinct(), ["day", "venue_slug"])
    score = jaccard(F.col("left_key"), F.col("right_key"))
    within = (F.col("left_key") != "") & (F.col("right_key") != "") & (F.col("left_key").contains(F.col("right_key")) | F.col("right_key").contains(F.col("left_key")))
    sessions = (F.col("left_session.base") == F.col("right_session.base")) & (F.col("left_session.session") != F.col("right_session.session")) & (F.col("left_at") != F.col("right_at")) & (F.col("left_ticket") != F.col("right_ticket"))
    alike = keys.withColumn("score", score).where((F.col("score") >= least) | within)
    pairs = left.join(alike, ["day", "venue_slug", "left_key"]).join(right, ["day", "venue_slug", "right_key"]).where("left_id < right_id")
    return pairs.where(~F.coalesce(sessions, F.lit(False))).select("day", "venue_slug", "left_id", "right_id", F.round("score", 2).alias("score"))


def image_class() -> Column:
    url = F.col("image_path").isNotNull() | F.col("source_image_url").isNotNull()
    size = F.coalesce((F.col("image_width") > 0) & (F.col("image_height") > 0), F.lit(False))
    return F.when(url & size, "renderable").when(url, "invalid").when(F.coalesce("source_name", F.lit("")).isin(*NO_IMAGE_EXPECTED), "expected_none").otherwise("none")


def findings(cards: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """(rule, level, gig_id, detail): level error, warning or note.

    All rules on a card's own fields are one array, worked out in one pass over the cards; the two on duplicates read
    them again, by venue and start and by venue and day.
    """
    keep = lambda rule, level, cond, detail: F.when(cond, F.array(F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), detail.cast("string").alias("detail")))).otherwise(none)
    none = F.array().cast("array<struct<rule:string,level:string,detail:string>>")
    names = F.coalesce("artist_names", F.array().cast("array<string>"))
    each = lambda rule, level, pattern: F.transform(F.filter(names, lambda a: a.rlike(pattern)), lambda a: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), a.alias("detail")))
    title, text = F.coalesce("title", F.lit("")), F.concat_ws(" ", "title", "description")
    place_text = F.concat_ws(" ", "title", "description", "venue_name", "venue_suburb")
    empty = F.size("artist_names") == 0
    leaks = F.concat(
        F.array_compact(F.array(F.when(title.rlike(ENTITY_LEAK), "title"), F.when(F.coalesce("venue_name", F.lit("")).rlike(ENTITY_LEAK), "venue"))),
        F.filter(F.transform(names, lambda a, i: F.when(a.rlike(ENTITY_LEAK), F.concat(F.lit("artist_names["), i, F.lit("]")))), lambda x: x.isNotNull()),
        F.array_compact(F.array(F.when(title.rlike(QUESTION_MARKS), "title_question_marks"))),
    )
    keyed = F.filter(F.transform(names, lambda a: F.struct(variant_identity(a).alias("key"), a.alias("artist"))), lambda x: x["key"] != "")
    spellings = lambda k, x: F.array_sort(F.array_distinct(F.transform(F.filter(x, lambda y: y["key"] == k), lambda y: y["artist"])))
    twice = let(keyed, lambda x: F.filter(F.transform(F.array_distinct(F.transform(x, lambda y: y["key"])), lambda k: spellings(k, x)), lambda s: F.size(s) > 1))
    variants = F.transform(twice, lambda s: F.struct(F.lit("duplicate_artist_variant").alias("rule"), F.lit("warning").alias("level"), F.array_join(s, " / ").alias("detail")))
    vetted = F.coalesce("source_name", F.lit("")).rlike(VETTED_SOURCES)
    fund = place_text.rlike(FUNDRAISER) & empty & ~place_text.rlike(MUSIC_SIGNAL)
    of_row = F.concat(
        each("artist_placeholder", "error", PLACEHOLDER), keep("invalid_image_metadata", "error", image_class() == "invalid", F.coalesce("image_path", "source_image_url")), keep("no_image", "warning", image_class() == "none", title),
        keep("non_music_candidate", "warning", vetted & (place_text.rlike(NON_MUSIC) | fund), title), keep("missing_artist_candidate", "warning", empty & ~text.rlike(THEME_PARTY) & (text.rlike(EXPLICIT_LINEUP) | text.rlike(NAMES_WITH_PLUS)), title),
        keep("public_text_encoding", "warning", F.size(leaks) > 0, F.array_join(leaks, ",")), each("artist_delimiter", "warning", DELIMITER), each("artist_sentence_fragment", "warning", FRAGMENT), each("generic_artist_token", "warning", GENERIC), variants,
        keep("empty_artist_title_lineup", "warning", empty & title.rlike(LINEUP_TITLE) & ~title.rlike(NOT_A_LINEUP), title), *(keep("notable", "note", title.rlike(f"(?i){p}"), F.lit(p)) for p in patterns),
    )
    row = lambda rows, rule, detail: rows.select(F.lit(rule).alias("rule"), F.lit("error").alias("level"), F.col("id").alias("gig_id"), detail.cast("string").alias("detail"))
    alone = cards.select(F.col("id").alias("gig_id"), F.explode(of_row).alias("x")).select("x.rule", "x.level", "gig_id", "x.detail")
    exact = row(duplicates(cards), "exact_duplicate", F.col("title_key"))
    fuzzy = row(fuzzy_pairs(cards).select(F.col("left_id").alias("id"), "right_id"), "fuzzy_duplicate", F.col("right_id"))
    return alone.unionByName(exact).unionByName(fuzzy)


def verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: result, errors, warnings. found may have its rows counted (`n`)."""
    weight = F.col("n") if "n" in found.columns else F.lit(1)
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, weight)), F.lit(0))
    n = found.agg(of("error").alias("errors"), of("warning").alias("warnings"))
    fail = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return n.select(F.when(fail, "fail").when(F.col("warnings") > 0, "warning").otherwise("pass").alias("result"), "errors", "warnings")


def source_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy(F.coalesce("source_name", F.lit("(none)")).alias("source_name")).agg(F.count("*").alias("n"))


def reconciliation(tables: dict, cards: DataFrame, now: datetime, n: int = 5) -> DataFrame:
    """For each public source: its upcoming rows, the active ones, those without a card, and those whose card another
    source owns, with up to n examples."""
    s = tables["sources"].where("is_public_listing_source").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    g = tables["gigs"].where(F.col("starts_at") >= literal(now)).select(F.col("id").alias("gig_id"), "status", "title")
    card = cards.select(F.col("id").alias("gig_id"), F.coalesce("source_name", F.lit("(none)")).alias("owner"))
    rows = tables["source_gigs"].select("source_id", "gig_id").join(s, "source_id").join(g, "gig_id").join(card, "gig_id", "left")
    active = F.col("status") == "active"
    lost, moved = active & F.col("owner").isNull(), active & (F.col("owner") != F.col("source_name"))
    none = F.array().cast("array<string>")

    def few(cond: Column, name: str) -> DataFrame:  # the first n distinct titles of each source, cut before they are gathered
        titles = rows.where(cond & F.col("title").isNotNull()).groupBy("source_name", "title").agg(F.lit(1).alias("_"))
        first = titles.withColumn("rn", F.row_number().over(Window.partitionBy("source_name").orderBy("title"))).where(F.col("rn") <= n)
        return first.groupBy("source_name").agg(F.array_sort(F.collect_list("title")).alias(name))

    counts = rows.groupBy("source_name").agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(lost).alias("without_card"), F.count_if(moved).alias("owned_elsewhere"))
    both = counts.join(few(lost, "without_card_examples"), "source_name", "left").join(few(moved, "owned_elsewhere_examples"), "source_name", "left")
    return both.select(*counts.columns, *(F.coalesce(c, none).alias(c) for c in ("without_card_examples", "owned_elsewhere_examples")))


def handoffs(tables: dict, cards: DataFrame, now: datetime) -> DataFrame:
    """(from_source, to_source, n): active rows of one source whose card another source owns."""
    s = tables["sources"].where("is_public_listing_source").select(F.col("id").alias("source_id"), F.col("name").alias("from_source"))
    g = tables["gigs"].where((F.col("starts_at") >= literal(now)) & (F.col("status") == "active")).select(F.col("id").alias("gig_id"))
    card = cards.select(F.col("id").alias("gig_id"), F.coalesce("source_name", F.lit("(none)")).alias("to_source"))
    rows = tables["source_gigs"].select("source_id", "gig_id").join(s, "source_id").join(g, "gig_id").join(card, "gig_id")
    return rows.where("from_source != to_source").groupBy("from_source", "to_source").agg(F.count("*").alias("n"))
