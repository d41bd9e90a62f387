"""Line-ups of a jazz club's events: performer credits, marked names and the title, each where the text bears it out."""

from __future__ import annotations

import re

from pyspark.sql import Column

from stagelight.functions.rules import FLAGS, Rule, Rules, compiled, lineup, plain, slug
from stagelight.sources.nodes import fragment_lines, runs_around

# --- fixed values: the club's patterns and spellings ----------------------------------------------------------------

ROLE = r"(?:(?:acoustic|alto|backing|baritone|electric|lead|rhythm|soprano|tenor)\s+)?(?:vocals?|voice|piano|keys?|keyboards?|guitars?|bass(?:\s+guitar)?|double\s+bass|drums?|drum\s+kit|percussion|sax(?:es|ophone)?|trumpet|trombone|violin|viola|cello|flute|clarinet|organ|hammond\s+organ|accordi[oa]n|synth(?:esizer)?|modular\s+synth|mandolin|banjo|harp|didgeridoo|tabla|e?sarod|ewi|rhodes|bongos?|cajon|congas?|timbales|tambourine|riq\s+tambourine|maracas|g[üu]iro|clave|bell|horns?|charts?|mc|sound\s+engineer|composer|compositions?|arranger|band\s+leader)(?:\s+\d+)?"
ROLE = rf"(?:{ROLE})"
ROLES, SOME_ROLES = rf"{ROLE}(?:\s*(?:,|\/|&|\band\b|[-–—])\s*{ROLE})*", rf"{ROLE}(?:\s*(?:,|\/|&|\band\b)\s*{ROLE})*"
PERFORMANCE = r"\b(?:accompanied by|at the helm is|at the (?:keys?|piano)|band includes?|cabaret artists?|comprised of|directed by|direction of|featuring|fronted by|ft\.? special guests?|joined by|joined on stage by|led by|line[ -]?up|performed by|show features?|starring|unleash(?:e[sd]?|ing)?|with a band of|with .*?\bon\b)\b"
REPERTOIRE = r"\b(?:album by|artists? such as|influenced by|inspired by|made famous by|music by|music of|review|songs? by|tribute to)\b"
NO_NAME = r"^(?:about .+|album launch|australian jazz|band|bandcamp|bio|creative team|facebook|featuring|friends|instagram|linkedin|magazine 6000|more about .+|rhythms|seating for .+|the australian|the guardian|the music|tickets?|trumpet|website|x|youtube)$"
NO_NAME_PHRASE = r"\b(?:accessed by stairs|capacity is limited|entry is first|event is proudly|pre-purchased records|runs for \d+ minutes|sold separately|tickets? (?:are|include)|world['’]s greatest)\b"
PLACE = r"\s*\((?:ACT|AUS|AU|DK|GER|MEL|NSW|NZ|PARIS|QLD|SA|SWE(?:DEN)?|UK|USA|VIC|WA)\)\s*$"
CONCEPT = r"(?:^(?:Hammer Head|Mismatched|NOIR|This is Jazz)!?$|\b(?:album launch|appreciation|bastille day|bringing back|concert|festival|jam|jazz night|juke joint|meets|music from|music of|prize|recital|riot|session|showcase|songbook|sounds? of|story|tribute|women (?:in|of))\b)"
ENSEMBLE = r"(?:\bjazzband\b|\b(?:band|collective|combo|ensemble|orchestra|project|quartet|quintet|sextet|trio)\b)"
PRESENTERS = r"\b(?:colleges?|events?|productions?|promotions?|records?|schools?|venue|wok)\b"
SPELLINGS = {
    "alfred-bangez": "Alfred Bangezhano", "antonio-celeberti": "Antonio Celiberti", "gina-williams": "Gina Williams-Ghouse", "glen-walsh": "Glen Walsh", "jackson-van-ballegooyen": "Jackson van Ballegooyen", "james-morrison": "James Morrison",
    "james-morrison-quartet": "James Morrison Quartet", "karl-florrison": "Karl Florisson", "mckale-barret": "McKale Barrett", "shameem-taheri-lee": "Shameem", "sylvia-cornes": "Sylvia Cornes (Sylvie)", "sylvie-cornes": "Sylvia Cornes (Sylvie)",
    "the-beaufort-street-blues-band": "Beaufort Street Blues Band", "the-glen-walsh-quartet": "Glen Walsh Quartet", "the-harry-mitchell-trio": "Harry Mitchell Trio", "nic-jaksa": "Nicky J", "tara-tiba": "Tara Tiba", "vini-prates": "Vinicius Prates",
}
NAME_EDITS = compiled(
    r"^(?:and|&|featuring|ft\.?)\s+", r"^(?:join jazz musicians|joined by|the extraordinary backing of|the line-?up features?|the lineup features?)\s+", r"^(?:Dr|Professor|Sir|Earl|Viscount|Duke|Lord|Count)\.?\s+", r"^Baron\s+von\s+", r"^direction of\s+",
    r"^directed by\s+", r"\s+band\s+leader$", r"^WA Youth Jazz Orchestra['’]s\s+\(WAYJO\)\s+", r"\s+\(WAYJO NC\)$", PLACE, r"\s+featuring\s+.+$", "^[“”\"']+|[“”\"'.:]+$",
)
DASH, DASH_OR_COLON = r"\s+[-–—]\s+", r"\s+[-–—]\s+|:\s+"

# --- names ------------------------------------------------------------------------------------------------------------


def has(pattern: str, text: str) -> bool:
    return bool(re.search(pattern, text, FLAGS))


def identity(name: str) -> str:
    return slug(re.sub(PLACE, "", re.sub(r"\baward[- ]winning\b", "", re.sub(r"\band\b", "&", plain(name), flags=FLAGS), flags=FLAGS), flags=FLAGS))


def spelt(text: str) -> str:
    name = plain(text)
    for pattern, new in NAME_EDITS:
        name = pattern.sub(new, name)
    return SPELLINGS.get(identity(name), name.strip())


def likely(text: str) -> bool:
    """Short, no role, no label, no sentence."""
    name = spelt(text)
    no = not name or len(name) > 90 or len(name.split()) > 8 or has(NO_NAME, name) or has(NO_NAME_PHRASE, name) or has(rf"^{ROLES}\.?$", name) or has(rf"^{ROLE}\s*\(", name)
    return not (no or has(r"^the\s+\d{4}\b", name) or re.search(r"https?:|@|★|⭐", name) or re.search(r"[.!?].+\s", name))


def many(text: str) -> list[str]:
    """Names of a list by commas, then of a pair, whose first may borrow the second's surname."""
    text = re.sub(r"^starring\s+", "", re.sub(r"^(?:this show\s+)?features?\s+", "", plain(text), flags=FLAGS), flags=FLAGS)
    parts = [n for n in map(spelt, re.split(r"\s*,\s*", text)) if n]
    if len(parts) > 1:
        return [n for p in parts for n in many(p)]
    pair = re.search(r"^(.+?)\s+(?:&|and)\s+(.+)$", text, FLAGS)
    if not pair or has(r"^the\s+", pair[2]):
        return [spelt(text)] if likely(text) else []
    left, right = spelt(pair[1]), spelt(pair[2])
    if len(left.split()) == 1 and len(right.split()) > 1:
        left = f"{left} {right.split()[-1]}"
    return [n for n in (left, right) if likely(n)]


# --- rules: the first that matches is the text's only one ---------------------------------------------------------------

CREDITS = Rules(
    (
        Rule(rf"^ft\.?\s+special\s+guests?\s+(.+?)\s+[-–—]\s+{SOME_ROLES}\s+[-–—]\s+(.+)$", groups=(1, 2), ends=True),
        Rule(rf"^(.+?)\s+[-–—]\s+({ROLES})(?:\s*\([^)]*\))?\.?$", ends=True),
        Rule(rf"^(?:(?:and\s+joining\s+us.+?,\s*)?(?:on\s+)?)({ROLES})\s*:\s*(.+?)\.?$", groups=(2,), ends=True),
        Rule(rf"^({ROLES})\s+[-–—]\s+(.+?)\.?$", groups=(2,), ends=True),
        Rule(rf"^({ROLES})\s*[-–—]\s*(.+?)\.?$", groups=(2,), only=" ", of=1, ends=True),
    ),
    {"many": many},
)


def _presented_by(title: str) -> list[str]:
    who = re.search(r"\bpresented by\s+(.+?)$", title, FLAGS)[1]
    return many(spelt(re.split(rf":\s+|{DASH}", title)[0])) + ([] if has(PRESENTERS, who) else many(who))


def _presents(title: str) -> list[str]:
    m = re.search(r"^(.+?)\s+presents?:?\s+(.+)$", title, FLAGS)
    presenter, presented = spelt(m[1]), spelt(re.split(DASH, m[2])[0])
    return many(presented) + ([] if has(r"^WAYJO$", presenter) else many(presenter))


def _feature(rest: str) -> list[str]:
    return [n for part in re.split(r"\s+[-–—]\s+with\s+", rest, flags=FLAGS) for n in many(part)]


def _segments(title: str) -> list[str]:
    """Behind a concept's name the next segment that isn't quoted; else what stands before the first dash, colon or comma."""
    head, *later = re.split(DASH, title)
    later = [x for x in (re.split(r":\s+", s)[0] for s in later) if not re.search("^[“”‘’\"']|[“”‘’\"']$", x.strip())]
    if later and later[0] and has(CONCEPT, head) and not has(r"^This is Jazz!?$", head):
        return many(later[0])
    comma = re.search(r"^([^,]{2,40}),\s+.+$", title)
    return many(spelt(comma[1] if comma else re.split(DASH_OR_COLON, title)[0]))


TITLES = Rules(
    (
        Rule(r"^(.+?)\s+album launch\b", ends=True),
        Rule(r"^(.+?)\s+\((?:MEL|NL|NSW|PARIS|QLD|USA)\)(?:\s+.+)?$", ends=True),
        Rule(r"^(.+?)\s+presents?\s+[“\"](.+?)[”\"](?:\s+-\s+.+)?$", groups=(2, 1), ends=True),
        Rule(r"^(.*\bpresented by\s+.+)$", cut="presented by", ends=True),
        Rule(r"^(.+?\s+presents?:?\s+.+)$", cut="presents", ends=True),
        Rule(r"^(.+?)(?:\s+[-–—])?\s+(?:feat\.?|ft\.?)\s+(.+)$", groups=(1, 2), cut="feature", ends=True),
        Rule(r"^(.+?)\s+with\s+(.+)$", groups=(2,), only=CONCEPT, of=1, ends=True),
        Rule(r"^(.*)$", cut="segments"),
    ),
    {"many": many, "presented by": _presented_by, "presents": _presents, "feature": _feature, "segments": _segments},
)


def bare_title(title: str) -> str:
    """`[ A B ] x (WA)` as `AB x`."""
    joined = re.sub(r"^\[\s*((?:[A-Z]\s+)+[A-Z])\s*\]", lambda m: re.sub(r"\s+", "", m[1]), plain(title))
    return re.sub(r"^\[\s*|\s*\]$", "", re.sub(PLACE, "", joined, flags=FLAGS))


# --- what a description says about a name -------------------------------------------------------------------------------


class Told:
    def __init__(self, html: str):
        self.text, _, self.lines = fragment_lines(html, ("br",))
        self.marked = runs_around(html, "strong")
        self.keys = [identity(x) for x in self.lines if not has(r"^(?:doors?|show|artist talk)\b", x)]

    def subject(self, name: str) -> bool:
        """A line begins with the name, or says what it is or does."""
        k = identity(name)
        return bool(k) and any(x.startswith(f"{k}-") or any(p in x for p in (f"-{k}-are-", f"-{k}-is-", f"-{k}-returns-", f"-energy-of-{k}-", f"-band-{k}-featuring-")) for x in self.keys)

    def memorial(self, name: str) -> bool:
        n = re.escape(name)
        return has(rf"\b(?:late|memory of|tribute to)\s+(?:the\s+)?{n}\b", self.text) or has(rf"\bpassing\b.{{0,120}}\b{n}\b|\b{n}\b.{{0,120}}\bpassing\b|\blegacy of\s+(?:the\s+)?{n}\b|\b{n}(?:['’]s)?\s+legacy\b", self.text)

    def names(self, name: str) -> bool:
        return has(rf"\b{re.escape(name)}\b", self.text)


def credits(text: str) -> list[str]:
    return CREDITS.names(plain(text))


def in_parentheses(text: str) -> list[str]:
    found = re.finditer(rf"([^,;]+?)\s*\(({SOME_ROLES})\)", text, FLAGS)
    return [n for m in found if not re.search("[-–—]", m[1]) for n in many(m[1])]


def marked_names(title: str, told: Told) -> list[str]:
    """Of each marked text its credits with what stands beside it; else names that title, performance or text bear out."""
    titled = [identity(n) for n in TITLES.names(bare_title(title))]
    low, out = plain(title).lower(), []
    for text, parent, before, after in told.marked:
        compact = many(text) if has(rf"^{SOME_ROLES}\s*-$", before) else []
        if found := credits(f"{text} {after}") + credits(f"{before} {text}") + compact + in_parentheses(f"{text} {after}"):
            out += found
            continue
        names = many(text)
        plays = has(PERFORMANCE, parent) and (has(r"\bstarring\b", parent) or not has(REPERTOIRE, parent))
        for n in names:
            k, words = identity(n), n.lower()
            related = k in titled or (len(n.split()) <= 3 and any(k.startswith(f"{t}-") for t in titled))
            borne = related or plays or (len(names) == 1 and told.subject(n))
            honoured = any(p in low for p in (f"music of {words}", f"{words} songbook", f"{words} tribute", f"tribute to {words}")) or told.memorial(n)
            one_word = n.isalpha() and n[0].isupper() and n[1:].islower() and len(n) > 1
            if borne and not honoured and not one_word and not has(CONCEPT, n):
                out.append(n)
    return out


def names(title: str | None, html: str | None) -> tuple[list[str], str]:
    """(names, kind): credited and borne-out names of the title, an ensemble's leader, credits of lines, marked names,
    founders."""
    title = plain(title)
    if not html:
        return [], "explicit_lineup"
    told = Told(html)
    marked, lines = marked_names(title, told), [n for x in told.lines for n in credits(x)]
    credited = marked + lines
    known, of_title = set(map(identity, credited)), TITLES.names(bare_title(title))
    billed = [s.lower() for s in re.split(rf"\s+(?:with|feat\.?|ft\.?)\s+|\bpresented by\s+|{DASH}", title, flags=FLAGS)[1:]]
    lead = identity(spelt(re.split(DASH_OR_COLON, bare_title(title))[0]))
    longer = lambda n, keys: any(k.startswith(f"{identity(n)}-") for k in keys)
    plain_title = not has(r"\b(?:feat\.?|ft\.?|presented by|presents?|with)\b", title)
    fit = [n for n in of_title if n and not has(CONCEPT, n) and likely(n) and not told.memorial(n)]
    alone = lambda n: plain_title and "/" not in n and not has(PRESENTERS, n) and identity(n) == lead and not longer(n, known)
    with_credits = [n for n in fit if len(credited) >= 2 and (has(ENSEMBLE, n) or alone(n))]
    own = set(map(identity, marked))
    borne = [n for n in fit if not longer(n, own) and (identity(n) in own or told.subject(n) or any(n.lower() in s for s in billed))]
    m = re.search(r"^(.+?)\s+(?:band|combo|quartet|quintet|sextet|trio)\b", re.sub(r"^THE\s+", "", re.sub(PLACE, "", title, flags=FLAGS), flags=FLAGS), FLAGS)
    leader = spelt(m[1]) if m and not has(CONCEPT, title) else ""
    leaders = [leader] if len(leader.split()) == 2 and likely(leader) and identity(leader) not in known and told.names(leader) else []
    formed = re.search(r"\bwas formed\b.{0,120}?\bby\s+(.+?)\s+and since\b", told.text, FLAGS)
    return with_credits + borne + leaders + lines + marked + (many(formed[1]) if formed else []), "explicit_lineup"


def ellington_names(title: Column, html: Column) -> Column:
    """(names, kind) of a title and its description's HTML; names may repeat."""
    return lineup(names, title, html)
