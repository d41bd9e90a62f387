"""Details, images, lists and frontiers that are read from landed pages."""

import json

from pyspark.sql import functions as F

from stagelight.functions import dates as D
from stagelight.operators.history import repair_artists
from stagelight.sources import crawl, feeds, json_ld, pages
from stagelight.sources.registry import registry


def rows(spark, *html):
    return spark.createDataFrame([(i, f"https://club.example.com/e/{i}/", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_club_times(spark):
    texts = ["April 10, 2026 7:30 pm", "10 April 2026 19:30", "10  april 2026 8PM", "April 31, 2026 7:30", "April 10, 2026 13:30 pm", "April 10, 2026 24:00", "10 April 2026", "x", None, "10 April 2026 12am"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(D.parse_club_time(F.col("t")).cast("string")).collect()]
    assert got == ["2026-04-10 11:30:00", "2026-04-10 11:30:00", "2026-04-10 12:00:00", None, None, None, None, None, None, "2026-04-09 16:00:00"]
    meta = ["Friday 10th April 2026", "on sunday 1 march 2026, 7pm", "Friday 10th Foo 2026", "10 April 2026", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(meta)], "i int, t string").orderBy("i").select(D.parse_meta_date(F.col("t"))).collect()]
    assert got == ["2026-04-10", "2026-03-01", None, None, None]


def test_club_pages(spark, tmp_path):
    field = '<div class="jet-listing-dynamic-field__content">{}</div>'.format
    span = '<span class="tc_event_date_title_front">{}</span>'.format
    html = [
        '<head><meta property="og:image" content="https://i.example.com/og.jpg"><meta property="og:image:secure_url" content=" https://i.example.com/s.jpg"></head><body>' + field("Doors 6pm") + field("Event Start Date &amp; Time:\n April 10, 2026 7:30 pm") + span("10 April 2026 7:30 pm - 1:00 am") + "</body>",
        '<body><div class="elementor-widget-theme-post-featured-image"><img src="data:x" srcset="x 1x, https://i.example.com/set.jpg 300w"></div>' + span("11 April 2026 8pm - 10pm") + "</body>",
        "<body>Event Start Date & TIme: April 12, 2026 19:00</body>", "<body>soon</body>",
    ]
    got = feeds.ellington_details(rows(spark, *html)).orderBy("page_id").collect()
    assert [str(r.starts_at) for r in got] == ["2026-04-10 11:30:00", "2026-04-11 12:00:00", "2026-04-12 11:00:00", "None"] and [str(r.ends_at) for r in got[:2]] == ["2026-04-10 17:00:00", "2026-04-11 14:00:00"]
    assert [r.image_url for r in got] == ["https://i.example.com/s.jpg", "https://i.example.com/set.jpg", None, None] and [r._error for r in got] == [None, None, None, "no start time"]
    (tmp_path / "list").mkdir()
    event = {"id": 7, "link": "https://club.example.com/e/0/", "title": {"rendered": "REDFOX"}, "content": {"rendered": "<p><strong>Ann Lee</strong> – Guitar</p><p>Bob Ray – Drums</p>"}, "modified_gmt": "v"}
    (tmp_path / "list" / "a.json").write_text(json.dumps([event, event | {"id": 8, "link": "https://club.example.com/e/none/"}]))
    rows(spark, *html).write.parquet(str(tmp_path / "pages"))
    got = {r.external_id: r for r in feeds.normalise_ellington_rows(feeds.read_ellington_with_details(spark, str(tmp_path))).collect()}
    assert got["7"].artists == ["REDFOX", "Ann Lee", "Bob Ray"] and str(got["7"].starts_at) == "2026-04-10 11:30:00" and got["7"].image_url == "https://i.example.com/s.jpg" and got["8"]._error


def test_linked_images(spark):
    landed = spark.createDataFrame([("https://events.humanitix.com/a", '<meta property="og:image" content="https://i.example.com/a.jpg">'), ("https://events.humanitix.com/b?x=1", '<script type="application/ld+json">{"x": {"image": ["https:\\/\\/i.example.com/b.jpg"]}}</script>'), ("https://events.humanitix.com/c", "<p>none</p>")], "url string, html string")
    listed = spark.createDataFrame([(1, None, "https://events.humanitix.com/a/tickets?ref=1", "{}"), (2, None, "https://events.humanitix.com/b/", '{"k": 1}'), (3, "own", "https://events.humanitix.com/a", "{}"), (4, None, "https://other.example.com/a", None), (5, None, None, None), (6, None, "https://events.humanitix.com/c", "{}")], "id int, image_url string, ticket_url string, raw_payload string")
    got = {r.id: r for r in feeds.with_linked_images(listed, feeds.linked_images(landed)).collect()}
    assert [got[i].image_url for i in range(1, 7)] == ["https://i.example.com/a.jpg", "https://i.example.com/b.jpg", "own", None, None, None]
    assert json.loads(got[2].raw_payload) == {"k": 1, "derivedLinkedImageUrl": "https://i.example.com/b.jpg", "derivedLinkedImageSourceUrl": "https://events.humanitix.com/b"} and got[3].raw_payload == "{}" and got[4].raw_payload is None


def test_discovery_lists(spark):
    url = "https://www.eventbrite.com.au/e/red-tickets-{}".format
    event = lambda i, **more: {"id": str(i), "url": url(i) + "?aff=x", "name": f"n{i}"} | more
    data = lambda *events, **p: "<script>window.__SERVER_DATA__ = " + json.dumps({"search_data": {"events": {"results": events, "pagination": {"page_number": 1, "page_count": 2} | p}}}) + ";</script>"
    items = lambda *u: '<script type="application/ld+json">' + json.dumps({"@graph": [{"@type": "ItemList", "itemListElement": list(u)}]}) + "</script>"
    html = data(event(1), event(2), event(2), event(3), event("x"), event(9, eventbrite_event_id="4", url=url(4))) + items(url(1), {"item": {"url": url(2)}}, {"item": url(4)}, {"url": url(5)}, {"name": "?"})
    got = pages.discovery_rows(rows(spark, html, "<p>no</p>")).orderBy("page_id").collect()
    assert [(x.external_id, x.name) for x in got[0].listings] == [("1", "n1"), ("2", "n2"), ("4", "n9")] and (got[0].page_number, got[0].page_count, got[0].failed) == (1, 2, 4)
    assert got[1].listings == [] and got[1].failed == 2


def test_homepage_and_configuration(spark):
    payload = {"days": [{"dateKey": "2026-04-10", "items": [{"id": "g1", "title": 'A "quoted" {x}', "source_name": "S", "artist_names": ["Ann"]}, {"id": "g2", "title": "B"}]}]}
    text = f'1:["$",{json.dumps(payload, separators=(",", ":"))}],x'
    html = "".join(f"<script>self.__next_f.push({json.dumps([1, part])})</script>" for part in (text[:30], text[30:])) + "<script>self.__next_f.push([0])</script>"
    got = rows(spark, html, "<p>").select("page_id", pages.payload_gigs(pages.homepage_payload(F.col("html"))).alias("g")).orderBy("page_id").collect()
    assert [(g.date_key, g.id, g.title, g.artist_names) for g in got[0].g] == [("2026-04-10", "g1", 'A "quoted" {x}', ["Ann"]), ("2026-04-10", "g2", "B", [])] and not got[1].g
    script = "<script>var venueId = \"Milk Bar\";</script><script>indexName: 'prod', c = algoliasearch('APP', 'KEY')</script>"
    got = rows(spark, script, script.replace("prod", "")).select("page_id", pages.search_config(F.col("html")).alias("c")).orderBy("page_id").collect()
    assert tuple(got[0].c) == ("Milk Bar", "prod", "APP", "KEY") and got[1].c is None


def test_frontier(spark):
    page = lambda events, nexts: "".join(f"<a href='https://events.humanitix.com/{e}'>x</a>" for e in events) + "".join(f"<a rel='next' href='{n}'>n</a>" for n in nexts)
    site = "https://humanitix.com"
    landed = {f"{site}/p1": page("ab", ["/p3", "/p2", "/p1"]), f"{site}/p2": page("cb", ["/p4"]), f"{site}/p3": page("bd", ["/p2", "/p5"]), f"{site}/p4": page("e", ["/p6"]), f"{site}/p6": page("f", [])}
    links = crawl.page_links(spark.createDataFrame(list(landed.items()), "url string, html string"), site)
    visited = crawl.reached(links, [f"{site}/p1"])
    assert [(r.url[-2:], r.n, r.landed) for r in visited.orderBy("n").collect()] == [("p1", 0, True), ("p3", 1, True), ("p2", 2, True), ("p5", 3, False), ("p4", 4, True), ("p6", 5, True)]
    assert [(r.event_url[-1], r.page_url[-2:]) for r in crawl.events_seen(links, visited).orderBy("n").collect()] == [("a", "p1"), ("b", "p1"), ("d", "p3"), ("c", "p2"), ("e", "p4"), ("f", "p6")]
    few = crawl.reached(links, [f"{site}/p1", f"{site}/p2"], most=3)
    assert [r.url[-2:] for r in few.orderBy("n").collect()] == ["p1", "p2", "p3"] and crawl.failures(links, visited).first().failed == 1


def test_community_page(spark):
    event = {"@type": "Event", "name": "Night", "startDate": "2026-04-10T19:30:00", "location": {"name": "Hall", "address": {"addressRegion": "WA"}}}
    html = f'<script type="application/ld+json">{json.dumps(event)}</script><main><h2>Lineup</h2><ul><li>Ann Lee</li><li>Bob Ray</li></ul><div><p>Special guests: Cy Coe</p></div><h3>Location</h3><p>Not Me</p><p>Facebook</p></main><p>Featuring Outside.</p>'
    got = rows(spark, html).select(pages.page_parts(F.col("html")).alias("x")).first().x
    assert got.headings == ["Lineup", "Location"] and got.lineup == ["Ann Lee", "Bob Ray", "Special guests: Cy Coe"] and got.texts == ["Lineup", "Ann Lee", "Bob Ray", "Special guests: Cy Coe", "Not Me"]
    r = json_ld.normaliser("humanitix-perth-music")(rows(spark, html)).first()
    assert r.artists == ["Ann Lee", "Bob Ray", "Cy Coe"] and r.artist_extraction_kind == "parsed_text"


def test_lineups_from_stored_payloads(spark):
    """Rows whose line-up, taken anew from the payload that their listing stored, differs."""
    page = 'var moshtixEventData = {"name":"Red Fox w/ Blue Owl + more","startDate":"2026-04-10T19:30:00","venue":{"name":"Hall"}};<section id="event-details-section"><div class="fr-view"><p>w/ Elk</p></div></section>'
    ld = '<div id="event-structured-data-section"><script type="application/ld+json">{"location":{"name":"Hall","address":{"addressLocality":"Perth","addressRegion":"WA"}}}</script></div>'
    moshtix = {s.slug: s for s in registry()}["moshtix-wa"]
    listed = moshtix.normalise(spark.createDataFrame([(1, "https://www.moshtix.com.au/v2/event/e/1", page + ld)], "page_id long, url string, html string"))
    stored = listed.select(F.lit("a").alias("id"), "raw_payload", F.col("artists").alias("artist_names"), "artist_extraction_kind")
    stale = stored.withColumn("id", F.lit("b")).withColumn("artist_names", F.array(F.lit("Old")))
    nothing = stored.withColumn("id", F.lit("c")).withColumn("raw_payload", F.lit("{}"))
    got = repair_artists(stored.unionByName(stale).unionByName(nothing), moshtix.repair).collect()
    assert [(r.id, r.artist_names, r.artist_extraction_kind) for r in got] == [("b", ["Red Fox", "Blue Owl", "Elk"], "parsed_text")]
    club = {s.slug: s for s in registry()}["the-ellington"]
    body = json.dumps({"title": {"rendered": "REDFOX"}, "content": {"rendered": "<p><strong>Ann Lee</strong> – Guitar</p><p>Bob Ray – Drums</p>"}})
    got = club.repair(spark.createDataFrame([("x", body), ("y", None), ("z", "{")], "id string, raw_payload string")).collect()
    assert [(r.id, r.artists, r.kind) for r in got] == [("x", ["REDFOX", "Ann Lee", "Bob Ray"], "explicit_lineup")]
