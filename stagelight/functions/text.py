"""Text: white space, entities, slugs, titles, venues, search and match keys."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as browsers see it: with no-break and other Unicode spaces, which Java's \s leaves out.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z][a-z0-9]+);", re.IGNORECASE | re.ASCII)
#: The named entities that are decoded; all others stay.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
STOP_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with")

#: Venues with more than one name, by slug without apostrophes.
VENUE_NAMES = {
    "clancys-fish-pub-freemantle": "Clancy's Fish Pub",
    "clancys-fish-pub-fremantle": "Clancy's Fish Pub",
    "four5nine-bar": "Four5Nine Bar @ Rosemount",
    "hackett-hall-wa-museum-boola-bardip": "Hackett Hall, WA Museum Boola Bardip",
    "stan-perron-wa-treasures-hackett-hall-wa-museum-boola-bardip": "Hackett Hall, WA Museum Boola Bardip",
    "music-on-murray-st": "Music on Murray St",
    "north-freo-bowlo-hilton-park-bowling-club": "North Freo Bowlo",
    "old-habits": "Old Habits Neighbourhood Bar",
    "seasonal-brewing-co": "The Seasonal Brewing Co",
    "the-court-hotel": "The Court",
    "the-seasonal-brewing-co": "The Seasonal Brewing Co",
}
VENUE_WEBSITES = {
    "the-court": "https://thecourt.com.au/",
    "the-seasonal-brewing-co": "https://www.seasonalbrewing.beer/",
    "four5nine-bar-rosemount": "https://www.rosemounthotel.com.au/",
    "rosemount-hotel": "https://www.rosemounthotel.com.au/",
}
VENUE_SUBURBS = {"north-freo-bowlo": "North Fremantle", "the-bird": "Northbridge", "the-duke-of-george": "East Fremantle", "the-rechabite": "Northbridge"}
VENUE_ADDRESSES = {
    "north-freo-bowlo": "8 Thompson Road, North Fremantle WA 6159",
    "the-court": "50 Beaufort Street, Perth WA 6000",
    "the-duke-of-george": "135 Duke St, East Fremantle WA 6158",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _decode(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1].lower()
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if code <= 0x10FFFF else m[0]

    return ENTITY.sub(one, text)


def _slug(text: str) -> str:
    plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", " ".join(_decode(text).split()))).lower()
    return re.sub("[^a-z0-9]+", "-", plain.replace("&", " and ")).strip("-") or "item"


def _map_distinct(values: pd.Series, f) -> pd.Series:
    """f of each value, worked out once for equal ones of a batch."""
    return values.map({v: f(v) for v in values.dropna().unique()})


@F.pandas_udf(StringType())
def _decode_udf(values: pd.Series) -> pd.Series:
    return values.map(_decode, na_action="ignore")


@F.pandas_udf(StringType())
def _slug_udf(values: pd.Series) -> pd.Series:
    return values.map(_slug, na_action="ignore")


def decode_entities(value: Column) -> Column:
    """Named, decimal and hexadecimal entities, in one pass; unknown ones stay. Texts without `&` don't reach Python's work."""
    return F.when(value.contains("&"), _decode_udf(F.when(value.contains("&"), value))).otherwise(value)


def let(value: Column, f) -> Column:
    """f(value) with value worked out once: expressions that name it often, one inside another, would repeat it each time.
    f has no Python function in it; value may."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(value: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(value, f"{SPACE}+", " "))


def normalise_space(value: Column) -> Column:
    return collapse(decode_entities(value))


def ascii_slug(value: Column) -> Column:
    """The slug of ASCII text without entities."""
    words = F.regexp_replace(F.lower(collapse(value)), "&", " and ")
    slug = F.regexp_replace(F.regexp_replace(words, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "item").otherwise(slug)


def slugify(value: Column) -> Column:
    """Entities decoded, accents folded (NFKD), lower case, `&` as and, the rest as dashes; `item` if nothing is left.

    Spark has no Unicode normalisation, so texts with other than ASCII letters or an entity go through a pandas UDF.
    """
    plain = value.rlike("^[\\x00-\\x7F]*$") & ~value.rlike("(?i)&(#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]+);")
    return F.when(value.isNull(), None).when(plain, ascii_slug(value)).otherwise(_slug_udf(F.when(~plain, value)))


title_key = slugify

#: Word borders of ASCII regular expressions; Java's \b takes accented letters as word characters.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def canonical_text(value: Column) -> Column:
    """A title without status words, ordinal endings and noise words, before slugging."""
    t = normalise_space(value)
    t = F.regexp_replace(t, "(?i)^(cancelled|postponed)\\s*[-:]\\s*", "")
    t = F.regexp_replace(t, f"(?i)\\s*[-–—:]?\\s*{_B}(?:sold\\s*out|waitlist(?:ed)?|selling\\s*fast){_E}[!.]?\\s*$", "")
    t = F.regexp_replace(t, f"(?i){_B}([0-9]+)(st|nd|rd|th){_E}", "$1")
    for noise in ("album launch", "birthday", "festival(?:\\s+20[0-9]{2})?", "in concert", "live", "tour", "20[0-9]{2}"):
        t = F.regexp_replace(t, f"(?i){_B}{noise}{_E}" + ("$" if noise.startswith("festival") else ""), " ")
    return t


def canonical_title(value: Column) -> Column:
    return slugify(canonical_text(value))


def compatible_keys(left: Column, right: Column) -> Column:
    """Fuzzy agreement of two canonical titles: equal; equal word sets of two or more; or, without stop words, one
    set within the other, three or more in common, and at most two words apart."""
    a, b = (F.array_distinct(F.filter(F.split(x, "-"), lambda w: w != "")) for x in (left, right))
    stop = F.array(*map(F.lit, STOP_WORDS))
    p, q = F.array_except(a, stop), F.array_except(b, stop)
    common, small, large = F.size(F.array_intersect(p, q)), F.least(F.size(p), F.size(q)), F.greatest(F.size(p), F.size(q))
    same_words = (F.size(F.array_intersect(a, b)) == F.size(a)) & (F.size(a) == F.size(b)) & (F.size(a) >= 2)
    return (left != "") & (right != "") & ((left == right) | same_words | ((common == small) & (common >= 3) & (large - small <= 2)))


def _venue(text: str) -> str:
    clean = " ".join(_decode(text).split())
    return VENUE_NAMES.get(_slug(re.sub("['’]", "", clean)), clean)


@F.pandas_udf(StringType())
def _venue_name_udf(values: pd.Series) -> pd.Series:
    return values.map(_venue, na_action="ignore")


@F.pandas_udf(StringType())
def _venue_slug_udf(values: pd.Series) -> pd.Series:
    return _map_distinct(values, lambda x: _slug(re.sub("['’]", "", _venue(x))))


def venue_name(value: Column) -> Column:
    """The clean name, or the one name of a venue with several. A pandas UDF, as its key is a folded slug."""
    return _venue_name_udf(value)


def venue_slug(value: Column) -> Column:
    return _venue_slug_udf(value)


def venue_suburb(venue: Column, suburb: Column) -> Column:
    clean = normalise_space(suburb)
    return F.coalesce(lookup(VENUE_SUBURBS, venue_slug(venue)), F.when(clean != "", clean))


def venue_address(venue: Column, address: Column) -> Column:
    clean = normalise_space(address)
    return F.coalesce(lookup(VENUE_ADDRESSES, venue_slug(venue)), F.when(clean != "", clean))


def venue_website(venue: Column, url: Column) -> Column:
    """The given site wins over the fixed one: the other way round than suburb and address."""
    return F.when(F.coalesce(url, F.lit("")) != "", normalise_space(url)).otherwise(lookup(VENUE_WEBSITES, venue_slug(venue)))


def venue_match_key(value: Column) -> Column:
    return F.regexp_replace(venue_slug(value), "^the-", "")


def gig_slug(venue: Column, starts_at: Column, title: Column) -> Column:
    """Uses the UTC date of the start, unlike all other day keys."""
    return slugify(F.concat(venue, F.lit("-"), F.date_format(starts_at, "yyyy-MM-dd"), F.lit("-"), title))


def instant(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gig_checksum(source: Column, starts_at: Column, title: Column, venue: Column, url: Column) -> Column:
    fields = F.struct(source.alias("sourceSlug"), instant(starts_at).alias("startsAt"), slugify(title).alias("title"), venue.alias("venueSlug"), url.alias("sourceUrl"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def search_text(value: Column) -> Column:
    """Trimmed, lower case, single spaces; entities stay."""
    return F.lower(collapse(value))


def matches_query(query: str, *fields: Column, arrays: tuple[Column, ...] = ()) -> Column:
    """Every word of the query occurs somewhere in the fields; an empty query matches all."""
    words = [w for w in " ".join((query or "").lower().split()).split(" ") if w]
    haystack = search_text(F.concat_ws(" ", *fields, *arrays))
    found = F.lit(True)
    for w in words:
        found = found & haystack.contains(w)
    return found


def match_score(text: Column, query: Column) -> Column:
    """0 prefix, 1 prefix of a word, 2 substring, 3 all words; null: no match."""
    t, q = search_text(F.coalesce(text, F.lit(""))), search_text(query)
    return (
        F.when((t == "") | (q == ""), None)
        .when(t.startswith(q), 0)
        .when(F.exists(F.split(t, " "), lambda w: w.startswith(q)), 1)
        .when(t.contains(q), 2)
        .when(F.forall(F.split(q, " "), lambda w: t.contains(w)), 3)
        .cast("int")
    )


def question_mark_title(value: Column) -> Column:
    """A title without the runs of three or more question marks that broken emoji leave."""
    return collapse(F.regexp_replace(normalise_space(value), "\\?{3,}", " "))


#: Words that duplicate checks ignore.
DUPLICATE_NOISE = "the|and|with|special|guests?|guest|support|supports?|from|live|at|present|presents|tour|perth|wa|australian|australia|2026"


def duplicate_key(value: Column) -> Column:
    """Title words of two or more characters without noise words."""
    t = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "&", " and ")
    t = F.regexp_replace(t, "[^a-z0-9]+", " ")
    t = F.regexp_replace(t, f"\\b({DUPLICATE_NOISE})\\b", " ")
    return F.array_join(F.filter(F.split(F.trim(t), " +"), lambda w: F.length(w) > 1), " ")


def jaccard(left: Column, right: Column) -> Column:
    """Of the words of two keys; 0 if one has none."""
    a, b = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (left, right))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def session_of(title: Column) -> Column:
    """(base title, early or late) of `… (Early Show)`, else null."""
    pattern = "(?i)^(.*?)\\s*\\(\\s*(early|late)\\s+show\\s*\\)\\s*$"
    base = duplicate_key(F.regexp_extract(F.trim(title), pattern, 1))
    word = F.lower(F.regexp_extract(F.trim(title), pattern, 2))
    return F.when((word != "") & (base != ""), F.struct(base.alias("base"), word.alias("session")))


def leet_identity(value: Column) -> Column:
    """An artist's key with digits read as letters."""
    return F.trim(F.regexp_replace(F.translate(F.lower(normalise_space(value)), "013457", "oieast"), "[^a-z]+", " "))


def artist_identity(value: Column) -> Column:
    """An artist's key without brackets, `&` and a leading the."""
    t = F.regexp_replace(F.lower(normalise_space(value)), "\\([^)]*\\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), "[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(t), "^the ", "")


def identity_variants(value: Column) -> Column:
    """The key, the key without a trailing wa, and both without spaces."""
    key = artist_identity(value)
    short = F.regexp_replace(key, " wa$", "")
    return F.array_distinct(F.array(key, short, F.regexp_replace(key, " ", ""), F.regexp_replace(short, " ", "")))


def variant_identity(value: Column) -> Column:
    """The key by which audits find two spellings of an artist."""
    t = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "\\([^)]*\\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), "[^a-z0-9]+", " ")
    t = F.regexp_replace(t, "\\b(the|tribute|show|set|act|band|dj|mc)\\b", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def keyword_text(value: Column) -> Column:
    """Lower case ASCII words separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def keyword_count(value: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur as whole words."""
    text = F.concat(F.lit(" "), keyword_text(value), F.lit(" "))
    return sum((F.when(text.contains(f" {w} "), 1).otherwise(0) for w in keywords), F.lit(0))


def title_case(value: Column) -> Column:
    return F.initcap(F.lower(normalise_space(value)))


def split_venue(name: Column, suburb: Column) -> Column:
    """(name, suburb) of `Venue, Suburb`: a given suburb is cut from the name's end, else the last part is taken."""
    clean = normalise_space(name)
    cut = F.when(F.lower(clean).endswith(F.concat(F.lit(", "), F.lower(suburb))), F.substring(clean, F.lit(1), F.length(clean) - F.length(suburb) - 2))
    part = F.trim(F.element_at(F.split(clean, ","), -1))
    head = F.regexp_replace(clean, ",[^,]*$", "")
    return F.when(F.coalesce(suburb, F.lit("")) != "", F.struct(F.coalesce(cut, clean).alias("name"), suburb.alias("suburb"))).otherwise(
        F.struct(F.when(clean.contains(","), F.trim(head)).otherwise(clean).alias("name"), F.when(clean.contains(","), part).alias("suburb"))
    )


def join_filled(separator: str, *parts: Column) -> Column:
    """The parts that aren't blank, cleaned and joined; null if none is left."""
    clean = [normalise_space(p) for p in parts]
    out = F.concat_ws(separator, *(F.when(c != "", c) for c in clean))
    return F.when(out != "", out)


def longer_text(left: Column, right: Column) -> Column:
    return F.when(F.coalesce(F.length(right), F.lit(0)) > F.coalesce(F.length(left), F.lit(0)), right).otherwise(left)


def encode_path(path: Column) -> Column:
    """Each segment percent-encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.url_encode(s), "\\+", "%20")), "/")


def safe_json(value: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


@F.pandas_udf(ArrayType(StringType()))
def html_lines(values: pd.Series) -> pd.Series:
    """Visible lines of a page: block elements and breaks end a line, scripts and styles are left out."""
    skip = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
    block = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|section|article|header|footer|nav|main|table|tr|td|th|blockquote|pre|hr|form|dl|dt|dd)\b[^>]*>", re.I)

    def lines(page: str) -> list[str]:
        text = re.sub(r"<[^>]+>", "", block.sub("\n", skip.sub(" ", page)))
        return [x for x in (" ".join(html.unescape(line).split()) for line in text.split("\n")) if x]

    return values.map(lines, na_action="ignore")


def html_text(value: Column) -> Column:
    return F.array_join(html_lines(value), " ")
