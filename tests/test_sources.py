"""Adapters on landed payloads."""

import json
from datetime import datetime

import pytest

from stagelight.sources import city_feed, json_hits, json_ld
from stagelight.sources.registry import parse_slugs, registry, select_sources, source_rows


def hit(guid, name, **more):
    return {"EventGuid": guid, "EventName": name, "DateStart": "2026-04-10T11:30:00", "EventUrl": f"tickets.oztix.com.au/{guid}?utm_source=x", "Categories": ["Live Music"], "_geoloc": {"lat": -31.95, "lng": 115.86}, "Venue": {"Name": "Rosemount Hotel", "Locality": "North Perth"}, "Bands": ["The Band"]} | more


def land(tmp_path, name, value):
    (tmp_path / name).mkdir()
    (tmp_path / name / "page.json").write_text(json.dumps(value))
    return str(tmp_path / name)


def test_hits(spark, tmp_path):
    hits = [
        hit("1", "Good ??? Show", EventImage1="https://i/a?width=10&height=10", HomepageImage="https://i/b?width=20&height=20"), hit("2", "Far", _geoloc={"lat": -33.0, "lng": 115.86}), hit("3", "No place", _geoloc=None), hit("4", "Comedy", Categories=["Comedy"], Bands=[]),
        hit("5", "Workshop night", Bands=[]), hit("6", None), hit("7", "Cancelled - Off"), hit("8", "Guests", Categories=[], Bands=None, SpecialGuests="<p>with Ann &amp; Bob, Cy</p>"),
    ]
    raw = json_hits.read_hits(spark, land(tmp_path, "hits", {"results": [{"hits": hits}]}))
    got = {r.external_id: r for r in json_hits.normalise_oztix(raw).collect()}
    assert set(got) == {"1", "6", "7", "8"} and got["6"]._error and not got["1"]._error
    assert got["1"].title == "Good Show" and got["1"].image_url == "https://i/b" and got["1"].source_url == "https://tickets.oztix.com.au/1" and got["1"].venue.slug == "rosemount-hotel"
    assert got["7"].status == "cancelled" and got["8"].artists == ["Ann", "Bob", "Cy"] and got["8"].artist_extraction_kind == "parsed_text"
    assert {r.external_id for r in json_hits.normalise_rosemount(raw).collect()} == {str(i) for i in range(1, 9)}
    variants = [hit("1", "Band Night SOLD OUT"), hit("2", "Band Night"), hit("3", "Alone SOLD OUT")]
    raw = json_hits.read_hits(spark, land(tmp_path, "milk", {"results": [{"hits": variants}]}))
    assert {r.external_id for r in json_hits.normalise_milk_bar(raw).collect()} == {"2", "3"}


def test_city_feed(spark, tmp_path):
    event = lambda i, **m: {"title": f"T{i}", "id": str(i), "url": f"https://www.ticketmaster.com.au/t/event/{i}", "dates": {"startDate": "2026-04-10"}, "venue": {"city": "Perth", "name": "Arena", "state": "WA"}, "artists": [{"name": "A"}, {"name": "a"}]} | m
    page = {"total": 9, "events": [event(1), event(1), event(2, venue={"city": "Sydney", "state": "NSW"}), event(3, venue={"city": "Broome", "state": "WA"}), event(4, venue={"name": "No city"}), event(5, isPartner=True), event(6, url="https://other.com/event/6"), event(7, title=None)], "popularEvents": [{"url": "https://www.ticketmaster.com.au/t/event/1", "imageUrl": "https://i/old"}, {"url": "https://www.ticketmaster.com.au/t/event/1", "imageUrl": "https://i/new"}]}
    got = {r.external_id: r for r in city_feed.normalise_events(city_feed.read_events(spark, land(tmp_path, "city", page))).collect()}
    assert set(got) == {"1", "4", "7"} and got["1"].image_url == "https://i/new" and got["1"].artists == ["A"]
    assert (got["1"].starts_at, got["1"].starts_at_precision) == (datetime(2026, 4, 10, 4), "date") and got["7"]._error


def test_json_ld(spark):
    event = {"@type": ["MusicEvent"], "name": "Night &amp; Day", "startDate": "2026-04-10T19:30:00", "url": "https://h.com/e/night-1234567", "location": {"name": "Hall", "address": {"addressLocality": "Perth", "addressRegion": "WA"}}, "performer": [{"name": "Ann"}, "Bob"], "image": [{"url": "https://i/x"}]}
    page = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    pages = spark.createDataFrame([(1, "https://h.com/1", page({"@graph": [event, {"@type": "Thing"}]})), (2, "u", page([event | {"eventAttendanceMode": "https://schema.org/OnlineEventAttendanceMode"}])), (3, "u", page(event | {"location": {"name": "X", "address": {"addressRegion": "NSW"}}})), (4, "u", '<script type="application/ld+json">{broken</script>'), (5, "u", None), (6, "https://h.com/6", page([event, event | {"startDate": "2026-04-11"}]))], "page_id long, url string, html string")
    rows = json_ld.normaliser("humanitix-perth-music")(pages).collect()
    assert sorted(r.external_id for r in rows) == ["1234567", "1234567:2026-04-10T11:30:00.000Z", "1234567:2026-04-11T04:00:00.000Z"]
    r = rows[0]
    assert r.title == "Night & Day" and r.artists == ["Ann", "Bob"] and r.image_url == "https://i/x" and r.starts_at == datetime(2026, 4, 10, 11, 30) and r.venue.suburb == "Perth"


def test_registry(spark):
    slugs = [s.slug for s in registry()]
    assert slugs[:2] == ["humanitix-perth-music", "milk-bar"] and len(slugs) == 10
    assert [s.slug for s in select_sources(registry(), ["oztix-wa", "milk-bar"])] == ["milk-bar", "oztix-wa"]
    with pytest.raises(ValueError):
        select_sources(registry(), ["nope"])
    with pytest.raises(ValueError):
        select_sources(registry(), ["milk-bar"], ["milk-bar"])
    assert parse_slugs(" A, ,b") == ["a", "b"] and source_rows(spark, registry()).count() == 10
