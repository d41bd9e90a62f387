"""Nodes of pages, and the parsers of search, result and discovery pages on the sites' own markup."""

import pytest
from pyspark.sql import functions as F

from stagelight.sources import feeds, pages
from stagelight.sources import nodes as N


def table(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


PAGE = """<!doctype html><body class="a b"><ul><li>one<li class=x>two <b>2</b><ul><li>in</li></ul></ul>
<p id=p1>first<p>second<div>d</div></p><img src="i.png"><br>
<script>if (a < b) { "<p>no</p>" }</script><table><tr><td>1<td>2<tr><th>3</table>
<div data-k="m/:event"><a href='/e?a=1&amp;b=2'><div><div><strong>T &amp; U</strong></div></div></a></div></span></body>"""


@pytest.mark.parametrize(
    "selector,texts",
    [
        ("li", ["one", "two 2in", "in"]), ("ul > li", ["one", "two 2in", "in"]), ("li li", ["in"]), ("li.x b", ["2"]), ("body.b.a > p", ["first", "second"]), ("#p1", ["first"]), ("td, th", ["1", "2", "3"]), ("tr", ["12", "3"]), ("script", ['if (a < b) { "<p>no</p>" }']),
        ("[data-k$='/:event'] > a[href] strong", ["T & U"]), ("[data-k$='/:event'] > strong", []), ("a[href*='b=2']", ["T & U"]), ("a[href^='/e']", ["T & U"]), ("img[src]", [""]),
    ],
)
def test_selectors(selector, texts):
    read = N._Reader(PAGE, {"s": N.compile_selector(selector)})
    assert [read.text(x) for x in read.marked] == texts


def test_ranges_and_inner_html(spark):
    rows = table(spark, PAGE, None, "", "<div><p>open", "</div>" * 3 + "<b>x</b>").select("page_id", N.mark(F.col("html"), {"a": "a", "d": "div", "b": "b"}, inner=("a",)).alias("n"))
    got = {r.page_id: r.n for r in rows.collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1 and [x.text for x in got[4]] == ["x"]
    link = next(x for x in got[0] if x.label == "a")
    assert link.html == "<div><div><strong>T &amp; U</strong></div></div>" and link.attrs == {"href": "/e?a=1&b=2"}
    assert [x.node > link.node and x.node < link.until for x in got[0] if x.label == "d"] == [False, False, True, True]


def module(title, rows, more="", image="//cdn.example.com/a.jpg"):
    cells = "".join(f'<div class="contentEventAndDate clearfix"><div class="contentLocation">{place}</div><div class="contentDate">{day}</div>{button}</div>' for place, day, button in rows)
    return f'<div class="resultModule multi-venue"><div class="resultContainer"><div class="contentImage"><a href="/x"><img src="{image}"/></a></div><div class="contentEvent"><h6>{title}</h6></div>{cells}{more}</div></div>'


def buy(href):
    return f'<div class="resultBuyNow"><a class="yellowGradientButton" href="{href}">Find tickets</a></div>'


def test_result_pages(spark):
    day = "Fri 10 Apr 2026"
    good = module("Rock Night Concert", [("HBF Park,\n Perth, WA", day, buy("//premier.ticketek.com.au/shows/show.aspx?sh=ROCK26&amp;v=HBF")), ("Hall, Perth, WA", "Sat 11 Apr 2026", buy("/shows/show.aspx?sh=ROCK27"))])
    shared = module("Solo Concert", [("Hall, Perth, WA", day, "")], buy("https://premier.ticketek.com.au/shows/show.aspx?sh=SOLO"))
    bad = module("No Code Concert", [("Hall, Perth, WA", day, buy("/shows/x.aspx")), ("Hall, Sydney, NSW", day, buy("/shows/show.aspx?sh=SYD")), ("", day, buy("/shows/show.aspx?sh=E"))]) + module("", [("Hall, Perth, WA", day, buy("/s?sh=U"))]) + '<div class="resultModule"><h6>x</h6></div>'
    links = '<ul class="searchResultPagination"><a href="/search/SearchResults.aspx?k=c&amp;page=2">2</a><a href="/search/SearchResults.aspx?k=c&amp;page=3">3</a><a href="/other?page=9">9</a></ul>'
    rows = pages.result_rows(table(spark, f"<html><body>{links}{good}{shared}{bad}</body></html>", "<html></html>", None))
    assert {(r.title, r.location, r.page_count) for r in rows.collect()} >= {("Rock Night Concert", "HBF Park, Perth, WA", 3), ("Solo Concert", "Hall, Perth, WA", 3)}
    got = {r.external_id: r for r in feeds.normalise_ticketek(rows).collect()}
    assert set(got) == {"ROCK26:HBF", "ROCK27", "SOLO", None} and got[None]._error == "no show code" and got[None].title == "No Code Concert"
    assert got["ROCK26:HBF"].source_url == "https://premier.ticketek.com.au/Shows/Show.aspx?sh=ROCK26&v=HBF" and got["SOLO"].image_url == "https://cdn.example.com/a.jpg"


def test_search_pages(spark):
    event = '[{"@type":"MusicEvent","name":"Doctor Jazz","image":"https://static.example.com/uploads/j","url":"https://www.moshtix.com.au/v2/event/doctor-jazz/193078","startDate":"2026-04-07T19:30:00"}]'
    block = (
        '<div class="searchresult clearfix" data-event-id="{}"><div class="searchresult_image"><a href="u"><img src="//s.example.com/i.jpg"/></a></div><div class="searchresult_content"><h2 class="main-event-header"><a href="/v2/event/doctor-jazz/193078"><span>Doctor</span></a></h2>'
        '<h2 class="main-artist-event-header">Tue | <a href="/v2/venues/e/1"><span>V</span></a></h2><p><span>Late-night set</span> <a href="u">more</a></p><section><script type="application/ld+json">\n{}\n</script></section></div></div>'
    )
    html = block.format("193078", event) + '<div class="searchresult clearfix" data-event-id="broken"><h2 class="main-event-header"></h2></div>' + block.format("", "{not json").replace("193078", "7") + "<a href='/v2/search?query=&amp;Page=2'>2</a>"
    got = pages.search_rows(table(spark, html, "<p>none</p>")).orderBy("page_id", "i").collect()
    assert [(r.page_id, r.i, r.external_id, r.title, r.page_count, r._error) for r in got] == [(0, 0, "193078", "Doctor Jazz", 2, None), (0, 1, "broken", "", 2, "no id, link or title"), (0, 2, "7", "Doctor", 2, None), (1, None, None, None, 1, None)]
    assert str(got[0].starts_at) == "2026-04-07 11:30:00" and got[0].teaser == "Late-night set" and got[0].image_url == "https://static.example.com/uploads/j" and got[2].image_url == "https://s.example.com/i.jpg"
    assert got[0].url == "https://www.moshtix.com.au/v2/event/doctor-jazz/193078" and '"startDate"' in got[0].raw


def test_market_pages(spark):
    url = "/au/music-tickets/2026/07/18/ninajirachi"
    card = lambda href, inner, kind="music/:event": f'<div data-e2e="{kind}"><a href="{href}">{inner}</a></div>'
    html = card(url, "<div><p><strong>Ninajirachi</strong></p><p>The Rechabite</p></div>") * 2 + card(url + "-2", "<p><strong>No card</strong></p><p>V</p>", "music/other") + card("https://example.com" + url, "<p><strong>Wrong host</strong></p><p>V</p>") + card(url + "?ref=t", "<p><strong>T</strong></p><p>V</p>")
    html += card("/au/music-tickets/2026/02/30/show", "<p><strong>Bad date</strong></p><p>V</p>") + card(url + "-3", "<p><strong>No venue</strong></p><div>V</div>") + card(url + "-4", "<p><em><strong>Deep</strong></em></p><p>Hall <b>1</b></p>")
    got = table(spark, html + '<a href="/au/discover/Perth/music-tickets?page=2">2</a><a href="/au/discover/Perth/music-tickets?page=10">10</a><a href="/au/discover/Sydney/music-tickets?page=90">90</a>').select(pages.secondary_cards(F.col("html")).alias("x")).first().x
    assert [(c.title, c.venue_name, c.date_key) for c in got.cards] == [("Ninajirachi", "The Rechabite", "2026-07-18"), ("Deep", "Hall 1", "2026-07-18")] and got.max_page == 10
