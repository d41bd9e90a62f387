"""Line-ups of community event pages: structured performers, titles, line-up sections and explicit wording."""

from __future__ import annotations

import re

from pyspark.sql import Column

from stagelight.functions.rules import FLAGS, Rule, Rules, compiled, distinct, edited, lineup, plain, slug

# --- fixed values: the pages' patterns and words ---------------------------------------------------------------------

LABEL = r"^(?:special guests?|featuring|feat\.?|ft\.?|with support from|support from|supported by|lineup|artists?)\s*[:\-]?\s*"
TAIL = r"\s+(?:and more!?|plus more!?|more to be announced|tba|tbc)$|\s*[-–—]\s*full\s+band$"
SONG_CREDIT = r"\b(?:catalogue|catalog)\b.{0,140}$|\b(?:hits?|songs?|singles?|tracks?)\b.{0,90}\bincluding\b|\b(?:hit|song|single|track)\b.{0,100}$|\b(?:stream|listen\s+to)\b.{0,100}$"
GENERIC = ("plus", "band", "bands", "music", "live", "alternative", "keywords", "lineup", "artists", "description", "event", "events", "performance", "play", "shows", "sound", "style", "tickets", "venue")
NO_NAME = (
    r"\b(?:ft|feat|featuring)$", r"[.?!,]|https?://|@", r"\b(?:instagram|website|spotify|facebook|tiktok|ticket|tickets)\b",
    r"^(?:at|she|he|they|it|who|whose|her|his|their|making|listen|tune|style|shows?|music\s+by|performed\s+by|carried\s+by|values\s+)\b",
    r"\b(?:annual tribute festivals|music blends|gentle guitars|warm harmonies|vivid lyricism|songs explore|heartbreak|healing|popular choice|voice that|town of|city of|wine|coffee|dinner service|bakery|wearables|puzzles|lunch|culture ireland|small projects|liquid architecture|audio foundation|frontrunner av|sponsor|soundwalk|pre-gathering|gathering|playlists|late night set|whimsy|spiralling|bar|community musicians|jazz and theatre settings)\b",
    r"\b(is|are|from|with|and carried|writing|performs|presents?|present|hosts?|launch(?:ed|es)?|supported|building|offering|reflects|creating|co-creates|beyond the stage|crowned|journey|grounded|audiences|acclaimed|contemporary|orchestra presents|wide-ranging|repertoire|spanning|classical)\b",
)
STOP = r"(?:\s+\/\/|[.!?]|$)"
PREMIERE = r"^(?:world\s+)?premieres?\s+by\s+(.+)$"
TOKEN = compiled(LABEL, r"^(?:and|&)\s+", r"\s*\/\/\s*[^,;+•]+$", TAIL, "^[-–•]+|[-–•]+$")

EXPLICIT = tuple(
    Rule(p, cut="explicit", not_after=SONG_CREDIT)
    for p in (
        r"^special guests?\s*[:\-]\s*(.+)$", rf"\b(?:featuring|feat\.?|ft\.?)\s+(.+?){STOP}", rf"\bwith support from\s+(.+?){STOP}", rf"\bsupport from\s+(.+?){STOP}", rf"\bsupported by\s+(.+?){STOP}", rf"\bheadlined by\s+(.+?){STOP}",
        r"\bbringing together\s+(.+?)\s+in\s+(?:a|an)\s+(?:celebration|concert|performance)\b", r"^lineup\s*[:\-]\s*(.+)$", r"^artists?\s*[:\-]\s*(.+)$",
    )
)
TITLE = (
    Rule(r"^(.+?\s+\+\s+.+)$", cut="plus"),
    Rule(r"^(.+?)\s+(?:single|ep|album)\s+launch\b", cut="one"),
    Rule(r"^(.+?)\s+(?:with|w\/)\s+support\s+from\s+(.+)$", groups=(1, 2)),
    Rule(r"\bw[/.]\s+(.+)$", drop=r"(?i)\s+@\s+.+$|\s+&\s+more\b.*$"),
    Rule(r"\b(?:session|showcase):\s*(.+)$", cut="one"),
    *EXPLICIT,
)


def token(text: str) -> str:
    return edited(text, TOKEN)


def likely(text: str) -> bool:
    name = plain(text)
    return bool(name) and name.lower() not in GENERIC and len(name) <= 80 and len(name.split()) <= 8 and not any(re.search(p, name, FLAGS) for p in NO_NAME)


def many(text: str) -> list[str]:
    """Names of a list; the last `and` separates too where other separators do."""
    t = token(text)
    t = re.sub(r"\s+\band\b\s+(?=[^,;•+]+$)", ", ", t, count=1, flags=FLAGS) if re.search("[,;•+]", t) else t
    return [n for n in map(token, re.split(r"\s*(?:,|•|\+|;)\s*", t)) if likely(n)]


def explicit(text: str) -> list[str]:
    m = re.search(PREMIERE, text, FLAGS)
    return [n for part in re.split(r"\s+(?:and|&)\s+", m[1], flags=FLAGS) for n in many(part)] if m else many(text)


CUTS = {"many": many, "explicit": explicit, "plus": lambda t: many(re.sub(r"\s+\+\s+", ", ", t, count=1)), "one": lambda t: [n for n in [token(t)] if likely(n)]}
BY_TITLE, BY_TEXT = Rules(TITLE, CUTS), Rules(EXPLICIT, CUTS)


def performers(names: list[str], notes: list[str | None]) -> list[str]:
    """Structured names; one that ends in `including` stands for the names in its note."""
    out: list[str] = []
    for raw, note in zip(map(plain, names), notes):
        listed = re.search(r"\bincluding:?\s*$", raw, FLAGS)
        if not listed:
            out += [token(raw)] if likely(token(raw)) else []
        else:
            sentence = re.search(r"[.?!]", note or "") or re.search(r"\b(is|are|from|with|presents)\b", note or "", FLAGS)
            out += [n for n in map(plain, re.split(r"[\n•]+" if sentence else r"[\n,•]+", (note or "").strip())) if likely(n)]
    return out


def section_names(lines: list[str]) -> list[str]:
    """Names of a line-up section: labelled lines, lists of two or more, and plain names if there are two."""
    out, sure = [], False
    for x in filter(None, map(plain, lines)):
        labelled, listed = re.search(LABEL, x, FLAGS), re.search("[:,;+]", x)
        found = many(x) if labelled or listed else [x] if likely(x) else []
        if listed and not labelled and len(found) < 2:
            continue
        sure |= bool(labelled or listed)
        out += found
    out = distinct(out, slug)
    return out if sure or len(out) >= 2 else []


def names(title: str | None, description: str | None, section: list[str] | None, texts: list[str] | None, structured: list[str] | None, notes: list[str | None] | None) -> tuple[list[str], str]:
    """(names, kind): structured performers, then what title, line-up section and wording add; no name twice over as
    `A & B` of two structured ones."""
    own = performers(structured or [], notes or [None] * len(structured or []))
    first = BY_TITLE.names(plain(title)) + section_names(section or [])
    told = [n for t in [description, *(texts or [])] for n in BY_TEXT.names(plain(t))]
    spelt = {slug(n): n for n in told}
    parsed = [spelt.get(slug(n), n) for n in first] + [n for n in told if slug(n) not in set(map(slug, first))]
    known = set(map(slug, own))
    parts = lambda n: [p for p in (plain(re.sub(r"\s*\([^)]*\)\s*$", "", x)) for x in re.split(r"\s+(?:and|&)\s+", n, flags=FLAGS)) if p]
    parsed = [n for n in parsed if not (len(parts(n)) > 1 and all(slug(p) in known for p in parts(n)))]
    return own + parsed, "structured" if own else "parsed_text"


def humanitix_names(title: Column, description: Column, section: Column, texts: Column, structured: Column, notes: Column) -> Column:
    """(names, kind) of an event and its page's line-up section and visible texts; names may repeat."""
    return lineup(names, title, description, section, texts, structured, notes)
