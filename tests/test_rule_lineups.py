"""Line-ups by rule tables, a case for each rule, and the event pages that they are read from."""

import json

import pytest

from stagelight.functions import moshtix_lineups as M
from stagelight.functions.rules import Rule, Rules, as_in_title, slug
from stagelight.sources.moshtix import normalise_moshtix
from stagelight.sources.nodes import fragment_lines


def test_rules_stop_and_guard():
    rules = Rules((Rule(r"^a (.+)$", unless="!"), Rule(r"b (\w+) (\w+)", groups=(2, 1), only="^x", of=1, ends=True), Rule(r"(z+)", least=2)), {"many": lambda t: t.split(",")})
    assert rules.names("a 1,2") == ["1", "2"] and rules.names("a 1!") == [] and rules.names("b x1 y,z zz") == ["y", "x1"] and rules.names("b q1 y zz") == [] and rules.names("zz") == []


def test_names_as_titles_have_them():
    assert as_in_title(["wolf", "Owl", "BAT", "Fox Ray", "cat"], "The Owl and Wolf, bat w/ Fox  Ray Quartet") == ["Wolf", "The Owl", "BAT", "Fox Ray Quartet", "cat"] and slug("Ünder & Ōver!") == "under-and-over"


def test_lines_of_fragments():
    assert fragment_lines("<p>a<br/>b &amp; c</p>loose<ul><li>x<li>y</ul>") == ("ab & clooosexy".replace("ooo", "oo"), ["ab & c", "xy"], ["a", "b & c", "x", "y"]) and fragment_lines(None) == ("", [], [])


P = "<p>{}</p>".format


@pytest.mark.parametrize(
    "title,html,structured,want",
    [
        ("Red Fox 'Slow Burn' 10th Anniversary Australian Tour", "", [], ["Red Fox"]),
        ("An Evening presented by Ann Lee and Bob Ray", "", [], ["Ann Lee", "Bob Ray"]),
        ("Late Set with the Trio: Ann Lee, Bob Ray + Cy Coe", "", [], ["Ann Lee", "Bob Ray", "Cy Coe"]),
        ("Abbey Songs played by The Cats. All night", "", [], ["The Cats"]),
        ("Red Fox w/ Blue Owl + special guests", "", [], ["Red Fox", "Blue Owl"]),
        ("Red Fox with Blue Owl and more!", "", [], ["Red Fox", "Blue Owl"]),
        ("Dinner with Friends", "", [], []),
        ("Jazz Night ft. Ann Lee with The Quartet", "", [], ["Ann Lee", "The Quartet"]),
        ("Feat. Ann Lee, Bob Ray", "", [], ["Ann Lee", "Bob Ray"]),
        ("Red Fox + Blue Owl", "", [], ["Red Fox", "Blue Owl"]),
        ("Red Fox: The Slow Burn Tour", "", [], ["Red Fox"]),
        ("Red Fox, Blue Owl - Perth", "", [], ["Red Fox", "Blue Owl"]),
        ("Red Fox (UK)", "", [], ["Red Fox"]),
        ("Jane Doe presents Gold: The Best of Abbey", "", ["Jane Doe", "Gold", "Abbey"], ["Jane Doe"]),
        ("Coast Events presents Red Fox", "", [], []),
        ("Night", P("w/ Ann Lee, Bob Ray") + P("w' Cy Coe"), [], ["Ann Lee", "Bob Ray", "Cy Coe"]),
        ("Night", P("She is joined by special guests Ann Lee and Bob Ray, the best in town.") + P("He was joined by special guests No One."), [], ["Ann Lee", "Bob Ray"]),
        ("Night", P("A full band performance featuring the added talents of drummer Ann Lee, lead vocalist Bob Ray and bassist Cy Coe as they play"), [], ["Ann Lee", "Bob Ray", "Cy Coe"]),
        ("Night", P("A full band performance featuring the added talents of drummer Ann Lee and friends as they play"), [], []),
        ("Night", P("Red Fox | 9.15pm") + P("Doors | 7pm"), [], ["Red Fox"]),
        ("Night", P("DJs: Zed: 8pm - 9pm 🖤 Yan : 9pm-close • TBA"), [], ["Zed", "Yan"]),
        ("Night", P("Headlined by Red Fox with light. Then"), [], ["Red Fox"]),
        ("Night", P("Made up of Perth based musicians Ann Lee and Bob Ray.") + P("made up of three."), [], ["Ann Lee", "Bob Ray"]),
        ("Night", P("DJ Zed launches a record"), [], ["DJ Zed"]),
        ("Night", P("Tickets") + P("w/ After Stop"), [], []),
        ("Night", P("LINE UP:") + P("Ann Lee<br>Bob Ray • Cy Coe<br>Doors 8pm<br>Not Me"), [], ["Ann Lee", "Bob Ray", "Cy Coe"]),
        ("Night", P("★ Presented by") + P("Ann Lee") + P("Not Me"), [], ["Ann Lee"]),
        ("Red Fox Band", P("Red Fox Band") + P("with support from:") + P("Blue Owl"), [], ["Red Fox Band", "Blue Owl"]),
        ("Night", P("Ann Lee - lead vocals, keys<br>Bob Ray – double bass & drums.<br>Great night - come along"), [], ["Ann Lee", "Bob Ray"]),
        ("Red Fox", "", ["Red Fox", "MojosBar", "Mojos Bar WA", "Sunday Session", "Homepage Gallery x"], ["Red Fox"]),
        ("Red Fox w/ Blue Owl + more", "", ["Blue Owl"], ["Red Fox", "Blue Owl"]),
        ("Night", P("w/ Red Fox, Blue Owl"), ["Red Fox (tribute)", "Blue Owl"], ["Red Fox", "Blue Owl"]),
        ("Night", P("w/ Blue Owl, Red Fox, Elk"), ["Red Fox", "Blue Owl", "Elk"], ["Blue Owl", "Red Fox", "Elk"]),
        ("Fox &amp; Owl", "", ["fox & owl", "Fox and Owl"], ["Fox & Owl"]),
        (None, None, None, []),
    ],
)
def test_moshtix_rules(title, html, structured, want):
    names, kind = M.names(title, html, structured, ["Mojos Bar", None])
    assert names == want and kind == ("structured" if structured else "parsed_text")


def event_page(data, structured, description, more=""):
    return f"""<html><script>var moshtixEventData = {json.dumps(data)}; var x = {{}};</script><div id="event-summary-block" data-event-link="https://www.moshtix.com.au/v2/event/l/1"><div id="event-summary-thumbnail"><img src="//i.example.com/t.jpg"></div></div>
<section id="event-details-section"><div class="fr-view">{description}</div></section>{more}<a class="button_orange" href="/buy/1">Buy</a>
<section id="event-structured-data-section"><script type="application/ld+json">{json.dumps(structured)}</script></section></html>"""


def test_event_pages(spark):
    place = lambda **a: {"name": "Mojos Bar, North Fremantle", "sameAs": "https://mojos.example.com", "address": {"streetAddress": "237 Queen Victoria St", "addressLocality": "NORTH FREMANTLE", "addressRegion": "WA", "postalCode": "6159"} | a}
    block = '<div class="searchresult clearfix" data-event-id="{0}"><h2 class="main-event-header"><a href="/v2/event/e/{0}">T{0}</a></h2><p><span>{1}</span></p></div>'
    search = block.format(1, "teaser one") + block.format(1, "again") + block.format(2, "a trivia night")
    good = event_page({"name": "Red Fox w/ Blue Owl", "startDate": "2026-04-07T19:30:00", "endDate": "2026-04-07T22:30:00", "category": {"id": 2}, "artists": ["Red Fox", "Mojos Bar"], "highResImage": "https://i.example.com/h.jpg", "venue": {"name": "Mojos Bar", "state": "WA"}, "status": "Available"},
                      [{"url": "https://www.moshtix.com.au/v2/event/e/1?utm_source=x", "location": place(), "offers": [{"url": ""}, {"url": "https://t.example.com/1"}], "image": ["https://www.moshtix.com.au/uploads/"]}], "<p>Hello <b>all</b></p><p>Made up of Ann Lee and Bob Ray.</p>", '<div id="status-linked-section"> Postponed! </div>')
    bare = event_page({"startDate": "2026-04-08T20:00:00"}, {"name": "No Listing", "performers": [{"name": "Elk"}], "location": place(addressRegion="", addressLocality="Perth")}, "")
    other = event_page({"name": "Talk", "startDate": "2026-04-08T20:00:00", "category": {"id": 5}}, {"location": place()}, "")
    far = event_page({"name": "Far", "startDate": "2026-04-08T20:00:00"}, {"location": place(addressRegion="VIC")}, "")
    base = "https://www.moshtix.com.au/v2/"
    rows = [(0, f"{base}search?x=1", search), (1, f"{base}event/e/1", good), (3, f"{base}event/e/3", bare), (4, f"{base}event/e/4", other), (5, f"{base}event/e/5", far), (6, f"{base}event/e/6", event_page({}, {"location": place(), "name": "No start"}, ""))]
    got = {r.external_id: r for r in normalise_moshtix(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {"1", "3", "6"} and got["6"]._error and not got["1"]._error
    r = got["1"]
    assert (r.title, r.status, str(r.starts_at), str(r.ends_at)) == ("Red Fox w/ Blue Owl", "postponed", "2026-04-07 11:30:00", "2026-04-07 14:30:00")
    assert r.artists == ["Red Fox", "Blue Owl", "Ann Lee", "Bob Ray"] and r.artist_extraction_kind == "structured"
    assert r.image_url == "https://i.example.com/h.jpg" and r.ticket_url == "https://t.example.com/1" and r.source_url == f"{base}event/e/1" and r.description == "Hello allMade up of Ann Lee and Bob Ray."
    assert r.venue.slug == "mojos-bar" and r.venue.suburb == "North Fremantle" and json.loads(r.raw_payload)["eventData"]
    assert got["3"].title == "No Listing" and got["3"].artists == ["Elk"] and got["3"].image_url == "https://i.example.com/t.jpg" and got["3"].ticket_url == f"{'https://www.moshtix.com.au'}/buy/1"


@pytest.mark.parametrize(
    "title,html,want",
    [
        ("Music from the Night", "<p>Join jazz musicians <strong>Ann Lee (piano), Bob Ray (alto saxophone) and Cy Coe (drums)</strong></p>", ["Ann Lee", "Bob Ray", "Cy Coe"]),
        ("REDFOX", "<p><strong>Ann Lee</strong> – Guitar</p><p>Bob Ray – Drums, Percussion (late)</p>", ["REDFOX", "Ann Lee", "Bob Ray"]),
        ("Big Sound", "<p>Piano – Ann Lee<br>Trumpet and Synth- Bob Ray<br>On bass: Cy Coe<br>Sax-Powered Hour</p>", ["Big Sound", "Ann Lee", "Bob Ray", "Cy Coe"]),
        ("Late Session", "<p>Ft. special guests Ann Lee - vocals - Bob Ray</p>", ["Ann Lee", "Bob Ray"]),
        ("The Max Gold Songbook", "<p><strong>Max Gold</strong> is a legend.</p><p>This night will be performed by <strong>Ann Lee</strong> and band.</p>", ["Ann Lee"]),
        ("Showcase", "<p>With <strong>Ann Lee</strong> at the piano, influenced by <strong>No One</strong></p><p>“Fine” <strong>Some Critic, Some Paper</strong></p>", []),
        ("Showcase", "<p>Starring <strong>Ann and Bob Ray</strong></p>", ["Ann Ray", "Bob Ray"]),
        ("Album Launch - Ann Lee & Bob Ray - Live", "<p>After the passing of <strong>Bob Ray</strong> " + "so much time went by " * 8 + "until <strong>Ann Lee</strong> launched it.</p><p>Ann Lee is back.</p>", ["Ann Lee"]),
        ("The Music of Gold", "<p><strong>The Gold Experience</strong> was formed in 2006 by Ann Lee and Bob Ray and since then plays.</p>", ["The Gold Experience", "Ann Lee", "Bob Ray"]),
        ("ANN LEE QUARTET", "<p><strong>ANN LEE QUARTET</strong> returns for two nights.</p>", ["ANN LEE QUARTET", "ANN LEE"]),
        ("Red Story - Presented by Fox Combo", "<p>The <strong>Fox Combo</strong> plays.</p><p><strong>Ann Lee</strong> – guitar</p>", ["Fox Combo", "Ann Lee"]),
        ("Coast College - Jazz Night", "<p>Students will perform.</p>", []),
        ("Night", "", []), (None, None, []),
    ],
)
def test_club_rules(title, html, want):
    from stagelight.functions.ellington_lineups import names

    got = list(dict.fromkeys(n.strip(" .") for n in names(title, html)[0]))
    assert got == want


@pytest.mark.parametrize(
    "title,description,section,texts,structured,notes,want,kind",
    [
        ("Red Fox + Blue Owl", None, [], [], [], [], ["Red Fox", "Blue Owl"], "parsed_text"),
        ("Red Fox Album Launch with support from Ann Lee, Bob Ray and Cy Coe", None, [], [], [], [], ["Red Fox", "Ann Lee", "Bob Ray", "Cy Coe"], "parsed_text"),
        ("Party w/ Ann Lee, Bob Ray & more @ the hall", None, [], [], [], [], ["Ann Lee", "Bob Ray"], "parsed_text"),
        ("Sunday session: Ann Lee", None, [], [], [], [], ["Ann Lee"], "parsed_text"),
        ("Night", "Hear the hit single Gold featuring Nobody Here.", [], ["Headlined by Elk // late"], [], [], ["Elk"], "parsed_text"),
        ("Night", "Stream Gold supported by Nobody. A night supported by Ann Lee.", [], [], [], [], [], "parsed_text"),
        ("Night", None, ["Ann Lee", "Bob Ray"], [], [], [], ["Ann Lee", "Bob Ray"], "parsed_text"),
        ("Night", None, ["Ann Lee"], [], [], [], [], "parsed_text"),
        ("Night", None, ["Special guests: Ann Lee", "Doors at 8, tickets online"], [], [], [], ["Ann Lee"], "parsed_text"),
        ("Night", "featuring world premieres by Kay Moe and Jo Bo.", [], [], ["Ann Lee", "Artists including:"], [None, "Una, Duo\nTres"], ["Ann Lee", "Una", "Duo", "Tres", "Kay Moe", "Jo Bo"], "structured"),
        ("Night", "Featuring Ann Lee & Bob Ray.", [], [], ["Ann Lee", "Bob Ray"], None, ["Ann Lee", "Bob Ray"], "structured"),
        ("Night", None, None, None, None, None, [], "parsed_text"),
    ],
)
def test_community_rules(title, description, section, texts, structured, notes, want, kind):
    from stagelight.functions.humanitix_lineups import names

    got, found = names(title, description, section, texts, structured, notes)
    assert list(dict.fromkeys(got)) == want and found == kind
