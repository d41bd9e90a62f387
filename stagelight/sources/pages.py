"""Search and discovery pages: links, cards, embedded data. Patterns over the page's text; no page leaves its task."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stagelight.functions import text as T
from stagelight.functions.dates import parse_start
from stagelight.functions.urls import clean_url, direct_event, host, path_of, resolved
from stagelight.sources import gates
from stagelight.sources import nodes as N

#: Sites of relative links, and selectors of the pages' parts.
MARKET, SEARCH_SITE, RESULT_SITE = "https://tixel.com", "https://www.moshtix.com.au", "https://premier.ticketek.com.au"
MARKET_NODES = {"card": "[data-e2e$='/:event'] > a[href]", "title": "strong", "paragraph": "p", "link": "a[href]"}
SEARCH_NODES = {
    "block": "div.searchresult.clearfix", "data": "script[type='application/ld+json']", "main_link": "h2.main-event-header a", "title": "h2.main-event-header", "event_link": "a[href*='/v2/event/']", "image": ".searchresult_image img", "teaser": "p > span", "page": "a[href*='Page=']",
}
RESULT_NODES = {
    "module": ".resultModule", "title": ".contentEvent h6", "subtitle": ".contentEvent .sub-title", "image": ".contentImage img", "button": ".resultContainer > .resultBuyNow a", "row": ".contentEventAndDate", "row_button": ".resultBuyNow a",
    "location": ".contentLocation", "date": ".contentDate", "summary": ".contentResultSummary", "page": "a[href*='/search/SearchResults.aspx']",
}
#: Markers of embedded data, and headings and texts that aren't content.
SERVER_DATA, EVENT_DATA = "window.__SERVER_DATA__", "(?s)var moshtixEventData = (\\{.*?\\});"
UI_NOISE = "(?i)^(?:how does it work\\?|find events|host events|get in touch|footer information|location|refund policy|host ?information|more events from this host|description|get tickets|select an option.*)$"
GENERIC_DESCRIPTION = "Get tickets on Humanitix"


def links(html: Column) -> Column:
    """The href of each link, in order, with entities decoded."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<(?:a|link)\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def discovery(html: Column) -> Column:
    """(event_urls, next_urls, failed): distinct event pages, next pages, and links to the events' host that are no event."""
    event = lambda u: (host(u) == "events.humanitix.com") & path_of(u).rlike("^/[a-z0-9-]+/?$")
    every = links(html)
    clean = lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/$", "")
    events = F.array_distinct(F.transform(F.filter(every, event), clean))
    failed = F.size(F.filter(every, lambda u: (host(u) == "events.humanitix.com") & ~event(u)))
    after = F.regexp_extract_all(html, F.lit("(?is)<(?:a|link)\\b(?=[^>]*(?:rel=[\"']next[\"']|aria-label=[\"']next[\"']))[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.struct(events.alias("event_urls"), F.array_distinct(after).alias("next_urls"), failed.alias("failed"))


def secondary_cards(html: Column) -> Column:
    """(cards, max_page) of a secondary market's discovery page: url, date_key, title, venue_name of each event once.

    A card's title is the first strong text within its link, at any depth; the venue is the paragraph behind the one
    that holds the title.
    """
    return T.let(N.mark(html, MARKET_NODES), _secondary_cards)


def _secondary_cards(nodes: Column) -> Column:
    def card(x: Column) -> Column:
        return T.let(F.get(N.inside(nodes, x, "title"), 0), lambda strong: around(x, strong))

    def around(x: Column, strong: Column) -> Column:
        holds = F.try_element_at(F.filter(N.labelled(nodes, "paragraph"), lambda p: (p["node"] < strong["node"]) & (strong["node"] < p["until"])), F.lit(-1))  # the innermost
        return T.let(holds, lambda p: fields(x, strong, F.get(F.filter(nodes, lambda q: (q["label"] == "paragraph") & (q["parent"] == p["parent"]) & (q["nth"] == p["nth"] + 1)), 0)))

    def fields(x: Column, strong: Column, venue: Column) -> Column:
        raw = resolved(F.element_at(x["attrs"], "href"), MARKET)
        url = F.when(~raw.rlike("[?#]"), direct_event(raw))
        day = F.replace(F.regexp_extract(url, "/([0-9]{4}/[0-9]{2}/[0-9]{2})/", 1), F.lit("/"), F.lit("-"))
        return F.struct(url.alias("url"), day.alias("date_key"), T.collapse(strong["text"]).alias("title"), T.collapse(venue["text"]).alias("venue_name"))

    cards = F.filter(F.transform(N.labelled(nodes, "card"), card), lambda c: c["url"].isNotNull() & (c["title"] != "") & (c["venue_name"] != ""))
    pages = F.transform(N.labelled(nodes, "link"), lambda x: resolved(F.element_at(x["attrs"], "href"), MARKET))
    pages = F.filter(pages, lambda u: (host(u) == "tixel.com") & (path_of(u) == "/au/discover/Perth/music-tickets"))
    return F.struct(T.let(cards, lambda c: F.filter(c, lambda x, i: F.array_position(F.transform(c, lambda y: y["url"]), x["url"]) == i + 1)).alias("cards"), gates.max_page(pages).alias("max_page"))


@F.pandas_udf(StringType())
def _json_behind(pages: pd.Series, markers: pd.Series) -> pd.Series:
    decode = json.JSONDecoder().raw_decode

    def one(page: str | None, marker: str) -> str | None:
        at = -1 if page is None else page.find(marker)
        start = -1 if at < 0 else page.find("{", at)
        if start < 0:
            return None
        try:
            return json.dumps(decode(page, start)[0], sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(p, m) for p, m in zip(pages, markers)], dtype=object)


def embedded_json(html: Column, marker: str = SERVER_DATA) -> Column:
    """The JSON object behind a marker, wherever it ends; null if there is none or it isn't whole."""
    return _json_behind(F.when(html.contains(marker), html), F.lit(marker))


def event_data(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, EVENT_DATA, 1), F.lit(""))


def base64_id(value: Column) -> Column:
    """itemId of a base64 JSON text."""
    return F.get_json_object(F.try_to_binary(value, F.lit("base64")).cast("string"), "$.itemId")


def search_rows(pages: DataFrame) -> DataFrame:
    """page_id, page_count and `blocks`, in order, of search pages: external_id, title, url, starts_at, image_url,
    teaser, raw (the block's structured event) and _error for blocks without id, link or title or with a bad date.

    The block's JSON-LD comes before its headings; its link, before a structured one, is that of the main heading.
    """
    rows = pages.select("page_id", N.mark(F.col("html"), SEARCH_NODES).alias("_nodes"))
    nodes = F.col("_nodes")
    counted = F.transform(N.labelled(nodes, "page"), lambda x: F.element_at(x["attrs"], "href"))
    blocks = rows.select("page_id", gates.max_page(counted, "Page").alias("page_count"), F.posexplode_outer(F.transform(N.labelled(nodes, "block"), lambda b: F.struct(b.alias("block"), N.inside(nodes, b).alias("within")))).alias("i", "b"))
    within = F.col("b.within")
    blocks = blocks.withColumn("_event", structured_event(N.first(within, "data")["text"]))
    of = lambda path: F.try_variant_get("_event", path, "string")
    heading = lambda name: N.all_text(within, name)
    image = F.coalesce(F.try_variant_get("_event", "$.image", "array<string>"), F.array(of("$.image")))
    url = resolved(F.coalesce(N.first_attr(within, "main_link", "href"), of("$.url"), N.first_attr(within, "event_link", "href")), SEARCH_SITE)
    ids = F.coalesce(F.nullif(T.collapse(F.element_at("b.block.attrs", "data-event-id")), F.lit("")), F.nullif(F.regexp_extract(url, "/([0-9]+)(?:[/?#]|$)", 1), F.lit("")))
    start = F.nullif(F.trim(of("$.startDate")), F.lit(""))
    images = F.transform(F.filter(F.concat(image, F.array(N.first_attr(within, "image", "src"))), lambda u: F.coalesce(F.trim(u), F.lit("")) != ""), lambda u: clean_url(resolved(u, SEARCH_SITE)))
    out = blocks.select(
        "page_id", "page_count", "i", ids.alias("external_id"), T.collapse(F.coalesce(of("$.name"), heading("title"))).alias("title"), url.alias("url"), start.alias("start_text"), parse_start(start).alias("_start"),
        F.get(F.filter(images, lambda u: u.isNotNull() & ~path_of(u).rlike("^/uploads/*$")), 0).alias("image_url"), F.nullif(T.collapse(heading("teaser")), F.lit("")).alias("teaser"), F.to_json("_event").alias("raw"),
    )
    whole = F.col("external_id").isNotNull() & F.col("url").isNotNull() & (F.col("title") != "")
    error = F.when(F.col("i").isNotNull() & ~F.coalesce(whole, F.lit(False)), "no id, link or title").when(F.col("start_text").isNotNull() & F.col("_start").isNull(), "no date")
    return out.select("page_id", "page_count", "i", "external_id", "title", "url", F.col("_start.starts_at").alias("starts_at"), "image_url", "teaser", "raw", error.alias("_error"))


def structured_event(body: Column) -> Column:
    """The object of a JSON-LD body, or the first one of a list, as a variant; null where it isn't JSON."""
    value = F.try_parse_json(body)
    return F.when(body.rlike("^\\s*\\["), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)


def result_rows(pages: DataFrame) -> DataFrame:
    """url, title, subtitle, summary, image_url, location, date_text, page_count and n of the rows of result pages.

    A module has a title and one row for each event; a row's link is its own button, or else the module's. Modules
    without a title and rows without link, place and date are left out, as the site lists them without an event.
    """
    rows = pages.where(~gates.is_interstitial(F.col("html"))).select("page_id", N.mark(F.col("html"), RESULT_NODES).alias("_nodes"))
    nodes = F.col("_nodes")
    counted = F.transform(N.labelled(nodes, "page"), lambda x: F.element_at(x["attrs"], "href"))
    modules = rows.select("page_id", gates.max_page(counted).alias("page_count"), F.posexplode(F.transform(N.labelled(nodes, "module"), lambda m: N.inside(nodes, m))).alias("m", "_module"))
    module = F.col("_module")
    text = lambda within, label: T.collapse(N.all_text(within, label))
    head = modules.select(
        "page_id", "page_count", "m", text(module, "title").alias("title"), F.nullif(text(module, "subtitle"), F.lit("")).alias("subtitle"), resolved(N.first_attr(module, "image", "src"), RESULT_SITE).alias("image_url"), N.first_attr(module, "button", "href").alias("_button"),
        F.posexplode(F.transform(N.labelled(module, "row"), lambda r: N.inside(module, r))).alias("r", "_row"),
    )
    row = F.col("_row")
    out = head.where("title != ''").select(
        F.struct("page_id", "m", "r").alias("n"), resolved(F.coalesce(N.first_attr(row, "row_button", "href"), F.col("_button")), RESULT_SITE).alias("url"), "title", "subtitle", F.nullif(text(row, "summary"), F.lit("")).alias("summary"), "image_url",
        text(row, "location").alias("location"), text(row, "date").alias("date_text"), "page_count",
    )
    return out.where("url IS NOT NULL AND location != '' AND date_text != ''")


def section_text(lines: Column, headings: Column, wanted: str) -> Column:
    """The lines behind each heading that matches, up to the next heading, each once."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        heading = F.array_contains(headings, x)
        return F.struct(F.when(heading, x.rlike(wanted)).otherwise(acc["on"]).alias("on"), F.when(acc["on"] & ~heading, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    return F.array_distinct(F.aggregate(lines, start, step, lambda acc: acc["out"]))


def page_text(lines: Column) -> Column:
    """Visible lines, each once, without those of the page's own controls."""
    return F.filter(F.array_distinct(lines), lambda x: ~x.rlike(UI_NOISE))


PAGE_NODES = {"heading": "main h2, main h3, main h4", "text": "main h2, main h3, main h4, main p, main li", "beside": "main h2, main h3, main h4, main ul, main ol, main p, main div, main section", "item": "main p, main li", "list": "main ul, main ol"}
LINEUP_HEADINGS = ("lineup", "artists", "performers", "featuring")
PAGE_NOISE = "^[A-Z][a-z]{2},?\\s+[0-9]{1,2}\\s+[A-Z][a-z]{2}|^(?:Facebook|Linkedin|X|Copy link|iCal|Google|Office 365|Outlook)|^Tickets for good, not greed|^(?i:Refunds? )|^\\$[0-9]+"


def page_parts(html: Column) -> Column:
    """(headings, texts, lineup) of a page's main part: its headings, its visible texts once each without those of the
    page's own controls, and what stands under a line-up heading up to the next heading beside it."""
    return T.let(N.mark(html, PAGE_NODES), _page_parts)


def _page_parts(nodes: Column) -> Column:
    texts = F.filter(F.transform(N.labelled(nodes, "text"), lambda x: T.collapse(x["text"])), lambda t: (t != "") & ~t.rlike(UI_NOISE) & ~t.rlike(PAGE_NOISE))

    def under(h: Column) -> Column:
        beside = F.filter(nodes, lambda x: (x["label"] == "beside") & (x["parent"] == h["parent"]) & (x["nth"] > h["nth"]))
        stop = F.coalesce(F.array_min(F.transform(F.filter(beside, lambda x: x["tag"].isin("h2", "h3", "h4")), lambda x: x["nth"])), F.lit(1 << 30))

        def texts_of(x: Column) -> Column:
            items = N.inside(nodes, x, "item")
            items = F.when(x["tag"].isin("ul", "ol"), F.filter(items, lambda i: i["tag"] == "li")).otherwise(items)
            return F.when((F.size(items) > 0) | x["tag"].isin("ul", "ol"), F.transform(items, lambda i: i["text"])).otherwise(F.array(x["text"]))

        return F.flatten(F.transform(F.filter(beside, lambda x: x["nth"] < stop), texts_of))

    wanted = F.filter(N.labelled(nodes, "heading"), lambda h: F.lower(T.collapse(h["text"])).isin(*LINEUP_HEADINGS))
    lineup = F.filter(F.transform(F.flatten(F.transform(wanted, under)), T.collapse), lambda t: (t != "") & ~t.rlike(UI_NOISE))
    return F.struct(F.transform(N.labelled(nodes, "heading"), lambda h: T.collapse(h["text"])).alias("headings"), F.array_distinct(texts).alias("texts"), F.array_distinct(lineup).alias("lineup"))


def homepage_payload(html: Column) -> Column:
    """The JSON object of days that a rendered homepage carries in the chunks of its script calls; null without one."""
    chunks = F.transform(F.regexp_extract_all(html, F.lit("(?s)self\\.__next_f\\.push\\((.*?)\\)</script>"), F.lit(1)), lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$[1]", "string"), F.lit("")))
    return _json_behind(F.array_join(chunks, ""), F.lit('{"days":['))


def payload_gigs(payload: Column) -> Column:
    """(date_key, id, slug, title, source_name, artist_names) of the payload's days, in order."""
    item = "id:string,slug:string,title:string,source_name:string,artist_names:array<string>"
    days = F.from_json(payload, f"days array<struct<dateKey:string,items:array<struct<{item}>>>>")["days"]
    fields = ("id", "slug", "title", "source_name")
    one = lambda d: lambda g: F.struct(d["dateKey"].alias("date_key"), *(g[f].alias(f) for f in fields), F.coalesce(g["artist_names"], F.array().cast("array<string>")).alias("artist_names"))
    return F.flatten(F.transform(days, lambda d: F.transform(d["items"], one(d))))


def search_config(html: Column) -> Column:
    """(venue_name, index_name, app_id, api_key) that a venue's page gives to its search; null if one is missing."""
    scripts = F.array_join(F.transform(N.mark(html, {"script": "script"}), lambda x: x["text"]), "\n")

    def found(text: Column) -> Column:
        part = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
        client = "algoliasearch\\('([^']+)', '([^']+)'\\)"
        out = F.struct(part('var venueId = "([^"]+)"').alias("venue_name"), part("indexName:\\s*'([^']+)'").alias("index_name"), part(client).alias("app_id"), part(client, 2).alias("api_key"))
        return F.when(out["venue_name"].isNotNull() & out["index_name"].isNotNull() & out["app_id"].isNotNull(), out)

    return T.let(scripts, found)


def discovery_rows(pages: DataFrame) -> DataFrame:
    """(page_id, listings, page_number, page_count, failed) of discovery pages (page_id, html): events of the server data
    that the page's item list has under the same id and URL, each id once; what either has alone counts as failed."""
    from stagelight.sources.feeds import owned_event
    from stagelight.sources.json_ld import list_items

    event = "struct<id:string,eventbrite_event_id:string,url:string,name:string>"
    body = F.from_json(embedded_json(F.col("html")), f"search_data struct<events:struct<results:array<{event}>,pagination:struct<page_number:int,page_count:int>>>")["search_data"]["events"]
    rows = pages.select("page_id", body.alias("d"), list_items(F.col("html")).alias("urls"))
    listed = F.transform("urls", owned_event)
    rows = rows.withColumn("_list", F.filter(listed, lambda x: x.isNotNull()))
    entry = lambda e: F.struct(F.coalesce(F.nullif(F.trim(e["eventbrite_event_id"]), F.lit("")), F.trim(e["id"])).alias("id"), owned_event(e["url"]).alias("at"), e["name"].alias("name"))
    rows = rows.withColumn("_events", F.transform(F.coalesce("d.results", F.array().cast(f"array<{event}>")), entry)).withColumn("_keys", F.transform("_events", lambda e: e["id"]))
    last = lambda k: F.try_element_at(F.filter("_list", lambda x: x["external_id"] == k), F.lit(-1))["url"]  # noqa: E731  a list names an id's last URL
    good = F.filter("_events", lambda e, i: F.coalesce(e["id"].rlike("^[0-9]+$") & (e["at"]["external_id"] == e["id"]) & (last(e["id"]) == e["at"]["url"]) & (F.array_position("_keys", e["id"]) == i + 1), F.lit(False)))
    rows = rows.withColumn("_good", good)
    ids, have = F.array_distinct(F.transform("_list", lambda x: x["external_id"])), F.transform("_good", lambda e: e["id"])
    failed = F.size("_events") - F.size("_good") + F.size(F.array_except(ids, have)) + F.when(F.size(ids) == 0, 1).otherwise(0) + F.when(F.col("d.pagination.page_count").isNull(), 1).otherwise(0)
    return rows.select("page_id", F.transform("_good", lambda e: F.struct(e["id"].alias("external_id"), e["at"]["url"].alias("url"), e["name"].alias("name"))).alias("listings"), F.col("d.pagination.page_number").alias("page_number"), F.col("d.pagination.page_count").alias("page_count"), failed.alias("failed"))


def page_meta(html: Column) -> Column:
    """(title, description, canonical, image) of a page's head; the canonical link, or else og:url."""
    of = lambda key: F.nullif(T.collapse(F.regexp_extract(html, f"(?is)<meta\\b(?=[^>]*(?:name|property)=[\"']{key}[\"'])[^>]*\\bcontent=[\"']([^\"']*)[\"']", 1)), F.lit(""))
    link = F.nullif(F.regexp_extract(html, "(?is)<link\\b(?=[^>]*rel=[\"']canonical[\"'])[^>]*\\bhref=[\"']([^\"']*)[\"']", 1), F.lit(""))
    title = F.nullif(T.collapse(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.struct(F.coalesce(of("og:title"), title).alias("title"), F.coalesce(of("og:description"), of("description")).alias("description"), F.coalesce(link, of("og:url")).alias("canonical"), of("og:image").alias("image"))


def preferred_description(structured: Column, text: Column, meta: Column) -> Column:
    """The structured description unless it is blank or generic; then the first six texts of the page; then the head's."""
    generic = lambda v: F.coalesce((T.collapse(v) == "") | T.collapse(v).startswith(GENERIC_DESCRIPTION), F.lit(True))
    joined = F.array_join(F.slice(text, 1, 6), "\n\n")
    return F.when(~generic(structured), T.collapse(structured)).when(joined != "", joined).when(~generic(meta), meta)


def fallback_event(meta: Column, start: Column) -> Column:
    """(name, description, url, image, start_date) from the head alone, if it has title and start."""
    return F.when(meta["title"].isNotNull() & start.isNotNull(), F.struct(meta["title"].alias("name"), meta["description"].alias("description"), meta["canonical"].alias("url"), meta["image"].alias("image"), start.alias("start_date")))


def unique_event(events: DataFrame, wanted: str) -> DataFrame:
    """(page_id, event, _error): the one event of a page that `wanted` (a boolean column) picks, or an error."""
    picked = events.groupBy("page_id").agg(F.count_if(F.col(wanted)).alias("n"), F.max(F.when(F.col(wanted), F.struct("i", "name", "url", "start_date"))).alias("event"))
    return picked.select("page_id", F.when(F.col("n") == 1, F.col("event")).alias("event"), F.when(F.col("n") != 1, "did not resolve uniquely").alias("_error"))


def valid_secondary_event(country: Column, url: Column, expected_url: Column, start: Column) -> Column:
    """A structured event of the country, at the URL that was asked for, on the day that the URL names."""
    day = F.replace(F.regexp_extract(expected_url, "/([0-9]{4}/[0-9]{2}/[0-9]{2})/", 1), F.lit("/"), F.lit("-"))
    return F.coalesce((F.upper(country).isin("AU", "AUSTRALIA")) & (direct_event(url) == direct_event(expected_url)) & (F.date_format(F.from_utc_timestamp(start, "Australia/Perth"), "yyyy-MM-dd") == day), F.lit(False))
