"""Views, reads, audit and matching on a small store."""

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from stagelight.operators import images, matching
from stagelight.operators.merging import upsert
from stagelight.plans import audit, reads, views
from stagelight.schema import TABLES

NOW = datetime(2026, 4, 10, 4, tzinfo=timezone.utc)


def store(spark):
    at = datetime(2026, 4, 10, 11)
    t = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    t["sources"] = spark.createDataFrame([("a", "a", "Oztix", "u", 10, True, True, 0), ("h", "h", "Hidden", "u", 500, False, True, 1), ("b", "b", "Humanitix", "u", 100, True, True, 2)], TABLES["sources"])
    t["venues"] = spark.createDataFrame([("v1", "the-bird", "The Bird", "Northbridge", None, None, at), ("v2", "hall", "Hall", None, None, None, at)], TABLES["venues"])
    gig = lambda i, title, start, status="active", venue="v1", url=None: (i, f"slug-{i}", venue, title, None, status, start, None, url, "own", None, at, at)
    t["gigs"] = spark.createDataFrame([gig("1", "Sexton", at, url="https://t/1"), gig("2", "Sexton Live At The Bird", datetime(2026, 4, 10, 12), url="https://t/2"), gig("3", "Past", datetime(2026, 3, 1)), gig("4", "Workshop & Show", datetime(2026, 4, 12, 5), venue="v2"), gig("5", "Hidden only", at)], TABLES["gigs"])
    row = lambda i, g, s, image=None, state="missing", path=None: (i, g, s, i, i, i, f"u{i}", "exact", [], "unknown", "{}", image, path, 10 if path else None, 10 if path else None, state, at if path else None, at, at)
    t["source_gigs"] = spark.createDataFrame([row("r1", "1", "a", "img-a", "pending"), row("r2", "1", "b"), row("r3", "1", "h", "img-h", "ready", "sha256/x"), row("r4", "2", "a"), row("r5", "3", "a"), row("r6", "4", "b"), row("r7", "5", "h")], TABLES["source_gigs"])
    t["artists"] = spark.createDataFrame([("x", "x", "Xylo"), ("y", "y", "Yarn TBA")], TABLES["artists"])
    t["gig_artists"] = spark.createDataFrame([("1", "y", 1), ("1", "x", 0)], TABLES["gig_artists"])
    return t


def test_cards_and_reads(spark):
    t = store(spark)
    cards = views.gig_cards(t).cache()
    by = {c.id: c for c in cards.collect()}
    assert set(by) == {"1", "2", "3", "4"} and by["1"].source_name == "Humanitix" and by["1"].source_url == "ur2"
    assert by["1"].image_path == "sha256/x" and by["1"].artist_names == ["Xylo", "Yarn TBA"] and by["2"].artist_names == []
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(reads.upcoming(cards, NOW)) == ["1", "2", "4"] and ids(reads.upcoming(cards, NOW, "bird sexton")) == ["1", "2"]
    assert ids(reads.gigs_for_day(cards, "2026-04-10", NOW)) == ["1", "2"] and reads.gigs_for_day(cards, "2026-13-10", NOW) is None and ids(reads.gigs_for_day(cards, "2026-04-01", NOW)) == []
    assert ids(reads.gigs_for_month(cards, 2026, 3, NOW)) == ["3"] and ids(reads.tonight(cards, NOW)) == ["1", "2"] and ids(reads.this_weekend(cards, NOW)) == ["1", "2", "4"]
    assert [r.date_key for r in reads.available_days(views.gig_dates(t), NOW).collect()] == ["2026-04-10", "2026-04-12"]
    assert [(r.date_key, len(r["items"])) for r in reads.day_groups(reads.upcoming(cards, NOW), NOW).orderBy("date_key").collect()] == [("2026-04-10", 2), ("2026-04-12", 1)]
    got = [(r.type, r.label) for r in reads.suggestions(cards, t["venues"], "s", NOW).collect()]
    assert got[:2] == [("gig", "Sexton"), ("gig", "Sexton Live At The Bird")]
    assert [(r.type, r.label) for r in reads.suggestions(cards, t["venues"], "bird", NOW, ["the-bird"]).collect()] == [("gig", "Sexton Live At The Bird")]
    assert [r.slug for r in reads.venue_suggestions(t["venues"], cards, "north", NOW).collect()] == ["the-bird"]
    days = reads.available_days(views.gig_dates(t), NOW)
    assert reads.resolved_day(days, "2026-04-11", NOW).first().date_key == "2026-04-10" and reads.today_label(days, NOW).first().label == "Today"
    grid = reads.calendar_month(days, date(2026, 4, 1), "2026-04-12", NOW).collect()
    assert len(grid) == 35 and [g.date_key for g in grid if g.enabled] == ["2026-04-10", "2026-04-12"] and sum(g.is_today for g in grid) == 1
    site = reads.sitemap(reads.sitemap_rows(views.sitemap_gigs(t), views.gig_dates(t), t["gigs"]), NOW, "https://x").collect()
    urls = {r.url for r in site}
    assert {"https://x/", "https://x/tonight", "https://x/this-weekend", "https://x/venues", "https://x/venues/hall", "https://x/gigs/2026/04", "https://x/gigs/slug-1"} <= urls and len(urls) == len(site)
    assert {views.public_table(t, n).count() for n in ("sources", "gigs")} == {2, 4} and views.public_table(t, "venues").count() == 2


def test_audit(spark):
    t = store(spark)
    cards = views.gig_cards(t)
    found = {(r.rule, r.gig_id) for r in audit.findings(cards, ["past"]).collect()}
    assert {("fuzzy_duplicate", "1"), ("artist_placeholder", "1"), ("non_music_candidate", "4"), ("no_image", "2"), ("notable", "3")} <= found
    pair = audit.fuzzy_pairs(cards).first()
    assert (pair.left_id, pair.right_id, pair.score) == ("1", "2", 0.5)
    assert audit.verdict(audit.findings(cards)).first().result == "fail"
    rec = {r.source_name: r for r in audit.reconciliation(t, cards, NOW).collect()}
    assert (rec["Oztix"].total, rec["Oztix"].active, rec["Oztix"].owned_elsewhere) == (2, 2, 1)
    shows = spark.createDataFrame([("1", "Big Birthday Concert! (Early Show)", datetime(2026, 9, 26, 9), "https://t/a"), ("2", "Big Birthday Concert! (Late show)", datetime(2026, 9, 26, 12), "https://t/b")], "id string, title string, starts_at timestamp, ticket_url string").withColumn("venue_slug", F.lit("v"))
    assert audit.fuzzy_pairs(shows).count() == 0


def test_links(spark):
    at = datetime(2026, 4, 10, 11)
    gigs = spark.createDataFrame([("1", "The Band", at, ["The Band"], "The Bird", "the-bird", None), ("2", "Twice", at, [], "Hall", "hall", None), ("3", "Twice", at, [], "Hall", "hall", None), ("4", "Kept", at, [], "Hall", "hall", "k"), ("5", "Gone", at, [], "Hall", "hall", "old")], "gig_id string, title string, starts_at timestamp, artist_names array<string>, venue_name string, venue_slug string, tixel_url string")
    events = spark.createDataFrame([("u1", "2026-04-10", "The Band", at, "Bird"), ("u2", "2026-04-10", "Twice", at, "Hall"), ("k", "2026-04-10", "Kept", at, "Hall")], "url string, date_key string, title string, starts_at timestamp, venue_name string")
    got = {(r.url, r.gig_id, r.outcome) for r in matching.assign_links(gigs, events).collect()}
    assert got == {("u1", "1", "matched"), ("u2", None, "ambiguous"), ("k", "4", "reserved")}
    assert {r.url for r in matching.plausible_cards(events, gigs).collect()} == {"u1", "u2", "k"}
    days = spark.createDataFrame([("2026-04-10",)], "date_key string")
    change = {r.gig_id: r.change for r in matching.link_changes(gigs, matching.assign_links(gigs, events), days).collect()}
    assert change == {"1": "set", "2": "unchanged", "3": "unchanged", "4": "unchanged", "5": "clear"}


def test_images_and_upsert(spark):
    t = store(spark)
    objects = spark.createDataFrame([("sha256/x", 5), ("loose", 7)], "path string, bytes long")
    later = datetime(2026, 6, 1, tzinfo=timezone.utc)
    now = images.cleanup_candidates(objects, t["source_gigs"], t["gigs"], NOW)
    assert [(r.path, r.kind) for r in now.collect()] == [("loose", "orphaned")]
    then = images.cleanup_candidates(objects, t["source_gigs"], t["gigs"], later)
    assert [(r.path, r.kind) for r in then.collect()] == [("loose", "orphaned"), ("sha256/x", "expired")]
    deleted = spark.createDataFrame([("sha256/x",)], "path string")
    s = images.cleanup_summary(then, deleted).first()
    assert (s.deleted_objects, s.deleted_bytes, s.failed_objects, s.dry_run) == (1, 5, 1, False)
    assert images.clear_references(t["source_gigs"], then, deleted).where("mirrored_image_path is not null").count() == 0
    new = spark.createDataFrame([("hall", "Hall 2"), ("new", "New")], "slug string, name string")
    out = {r.slug: r for r in upsert(t["venues"], new, ["slug"], None, F.lit(datetime(2027, 1, 1))).collect()}
    assert out["hall"].name == "Hall 2" and out["hall"].updated_at == datetime(2027, 1, 1) and out["the-bird"].updated_at == datetime(2026, 4, 10, 11) and out["new"].id is None
