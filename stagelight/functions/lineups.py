"""Line-ups from titles, guest lines and descriptions: array expressions over a listing's texts.

Each source has its own separators, patterns and vetoes; names stay in the order in which they are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions.artists import distinct_by, normalise_names
from stagelight.functions.text import collapse, let

#: The patterns of line-ups.
GUEST_PREFIX = "(?i)^(?:(?:with|plus)?\\s*specials? guests?[:,]?\\s*|(?:with|plus)\\s+guests?[:,]?\\s*|w[/.]\\s*|(?:with|plus)\\s+|starring\\s+|featuring\\s+|feat\\.?\\s+|ft\\.?\\s+)"
GUEST_LEAD = "(?i)^.+?\\b(?:tour|single|album|ep|launch|show)\\b\\s+with\\s+specials? guests?[:,]?\\s+"
GENERIC_GUEST = "(?i)^(?:(?:(?:a|an)\\s+)?(?:specials?\\s+)?guests?\\s*(?:to be announced|tba|tbc)?|(?:(?:local|more|additional|specials?)\\s+)*(?:support|supports|support acts?)\\s*(?:to be announced|tba|tbc)?|(?:(?:top\\s+)?secret|mystery)\\s+(?:act|artist|guest|set)s?|more(?:\\s+(?:acts?|artists?|guests?))?|tba|tbc|to be announced|more\\s+(?:tba|tbc|to be announced)|more to be announced|past|present(?:\\s+members?)?)[!.]?$"
SEPARATOR = "\\s*(?:,|\\+|\\^|\\||[•·]|\\s-\\s)\\s*"
NOISY = "(?i)^(?:djs?\\s+playing\\s+the\\s+best\\s+of\\b.*|support\\s+set\\s+of\\b.*|the\\s+greatest\\s+emo|metalcore|alternative\\s+tracks\\s+of\\s+all\\s+time\\b.*|hlh/dod\\s+after\\s+party!?|friday\\s+fright\\s+night|past|present(?:\\s+members?)?|.+\\btour\\b\\s*[‘’'\"\\d].*)$"
GENERIC_TOKEN = "(?i)^(?:djs?|band|live\\s+abba\\s+tribute\\s+act|.+\\btribute\\s+set)$"
ALL_NIGHT = "(?i)\\ball\\.?\\s+night\\.?\\s+long\\b"
DESCRIPTOR = "(?i)\\s*\\((?:(?:solo|performing|tribute|acoustic|dj\\s*set|support|debut(?:\\s+show)?)\\b[^)]*|[^)]{1,50}\\btribute)\\)\\s*"
MUSIC_OF = "(?i)\\s+(?:&|and)\\s+the\\s+music\\s+of\\b.*$"
LOCATION = "(?i)\\s*\\((?:wa|nsw|vic|qld|sa|tas|nt|act|australia|aus|nz|usa|uk|eng|swe|ger|deu|jpn|can|ire|irl|sco|fra|ita|esp|nl|nld)\\)\\s*$"
QUOTED = "(?:\"[^\"]+\"|'[^']+'|“[^”]+”|‘[^’]+’)"
TITLE_FEATURED, TITLE_PRESENTED = "(?i)\\b(?:ft\\.?|feat\\.?|featuring)\\s+(.+)$", "(?i)^.{1,80}?\\bpresents:\\s+(.+)$"
TITLE_HEADLINERS = ("(?i)^(.+?)\\s+[-–—]\\s+.+?\\b(?:single|album|ep|cd)\\s+launch$", f"(?i)^(.+?)\\s+{QUOTED}\\s+(?:(?:single|album|ep|cd)\\s+)?launch$", f"^(.+?)\\s+{QUOTED}$")
TITLE_TRAILING_WITH = f"(?i)^.+?\\s+{QUOTED}\\s+with\\s+(.+)$"
TITLE_NOISE = "(?i)\\b(?:party|night|brunch|rave|session|sessions|tribute|show|festival|all-?dayer|experience|appreciation|karaoke|worship|launch|single|album|tour|tickets?|pres\\.?|presented|presents?|vs)\\b"
HEADLINER_SEPARATOR = "\\s[-–—:]\\s|[,+]"
TRIBUTES = ("(?i)^(.+?)\\s+the\\s+australian\\s+tribute\\b", "(?i)\\b(?:a\\s+)?tribute\\s+to\\s+(.+?)(?:\\s+(?:ft\\.?|feat\\.?|featuring|with)\\b|$)", "(?i)^([^/]+/.*?)\\s+tribute(?:\\s+(?:night|show))?\\b")
#: Pattern of a description's line and the least number of commas in what it finds.
DESCRIPTION_LINES = (
    ("(?i)\\ball shows will be supported by\\s+(.+?)(?:,\\s+with\\s+new zealand\\b|[.!]|$)", 0), ("(?i)\\bfeaturing live performances? from\\s+(.+?)(?:,\\s+this\\b|[.!]|$)", 0), ("(?i)\\bjoin\\s+(.+?)\\s+as they\\b", 2),
    ("(?i)\\bsupported by (?:incredible local bands?|the wonderful)\\s+(.+?)(?:,\\s+(?:this|troubadour)\\b|[.!]|$)", 0), ("(?i)(?:^|[.!?]\\s+)with special guests?\\s+(.+?)(?:[.!]|$)", 0), ("(?i)^[^\\p{L}\\p{N}]{0,8}live:\\s*(.+)$", 0),
)
LINEUP_HEADING = "(?i)^(?!.*\\bcurrent\\s+line\\s*up\\b)(?:[\\p{L}\\p{N}][\\p{L}\\p{N} '&-]{0,60}\\s+)?line\\s*up\\s*:?$"
LINEUP_STOP = "(?i)[.!?]$|\\b(?:about these|more about|current line\\s*up|doors?|presented by|set times?|tickets?|venue)\\b|\\s+[-–—]\\s+(?:bass|drums?|guitars?|keys?|keyboards?|vocals?)\\b"
THEME_PARTY = "(?i)^(?=.*\\bparty\\b)(?=.*\\b(?:vs|playing the best of|worship|after party)\\b)"
ENSEMBLES = "Jazz Band|Band|Quartet|Quintet|Trio|Orchestra|Ensemble|Collective|Choir"
TICKETEK_PROMOTER = "(?i)^(?:live nation|ticketek|frontier touring|destroy all lines|secret sounds|triple j|presented by .+)$"
TICKETEK_TAIL = "(?i)\\s+(?:and more!?|plus more!?|more to be announced|tba|tbc)$"
MILK_BAR_LINES = (
    ("(?i)^[^\\p{L}\\p{N}]{0,8}(.{2,60}?)\\s+[–—-]\\s+(?:bringing|delivering|recreating)\\b", 1), ("(?i)\\bstarring\\s+(?:the\\s+\\p{L}+\\s+)?(.+?)\\s+and\\s+(?:the\\s+\\p{L}+\\s+)?(.+?)[!.](?:\\s|$)", 2),
    ("(?i)\\bfeaturing\\s+(?:(?:internationally|nationally)\\s+renowned\\s+)?(?:lead\\s+)?vocalist\\s+([^,.!]{2,80})", 1), ("(?i)\\bbattle\\s+between\\s+(?:two\\s+[^,]{1,80},\\s*)?([^,.]{2,60}?)\\s+vs\\.?\\s+([^,.]{2,60})(?:[,!?.]|$)", 2),
    ("(?i)\\bas\\s+([^,.]{2,60}?)\\s+takes\\s+on\\s+([^,.]{2,60})(?:[,!?.]|$)", 2),
)

_NONE = "array<string>"


def none() -> Column:
    return F.array().cast(_NONE)


def identity(name: Column) -> Column:
    """The key of a name in line-ups: without place, digits read as letters, words alone."""
    bare = F.lower(F.regexp_replace(collapse(name), LOCATION, ""))
    return F.trim(F.regexp_replace(F.translate(bare, "013457", "oieast"), "[^a-z0-9]+", " "))


def _bare(name: Column) -> Column:
    """Without guest prefixes (two at most stand together), descriptors and quotes."""
    for _ in range(2):
        name = F.regexp_replace(collapse(name), GUEST_PREFIX, "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, MUSIC_OF, ""), DESCRIPTOR, ""), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return collapse(F.regexp_replace(name, "(?i)^performed\\s+by\\s+(.+?)(?:\\s*/\\s*.+)?$", "$1"))


def _ampersands(token: Column, listed: Column, force: bool) -> Column:
    """`A & B` in two where it is all capitals, part of a list or of a guest line; `A & The B` is one band."""
    parts = F.filter(F.transform(F.split(token, "\\s+&\\s+"), lambda x: F.trim(x)), lambda p: p != "")
    capitals, band = token.rlike("^[A-Z0-9 '&./-]+$"), F.element_at(parts, -1).rlike("(?i)^the\\s+")
    acronyms = F.exists(parts, lambda p: p.rlike("^[A-Z0-9]{2,}$")) & F.forall(parts, lambda p: p.rlike("^[A-Z0-9]"))
    return F.when(~token.rlike("\\s&\\s") | (F.size(parts) < 2), F.array(token)).when(capitals | (~band & (F.lit(force) | listed | acronyms)), parts).otherwise(F.array(token))


def split_list(value: Column, force: bool = False, words: bool = True) -> Column:
    """Names of a list text. words: `and` separates too; force: `&` separates even without another separator."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(collapse(value), DESCRIPTOR, " "), "(?i)\\s+(?:plus\\s+the\\s+electric\\s+energy\\s+of|with\\s+percussion\\s+by)\\s+", ", "), "(?i)\\s+with\\s+(?=[A-Z0-9])", ", ")
    text = F.regexp_replace(text, "(?i)\\s+and\\s+", ", ") if words else text

    def names(t: Column) -> Column:
        listed = t.rlike("[,+^|•·]|\\s-\\s")
        token = lambda x: F.when(listed, F.regexp_replace(collapse(x), "(?i)^(?:&|and)\\s+", "")).otherwise(collapse(x))
        tokens = F.flatten(F.transform(F.split(t, SEPARATOR), lambda x: let(token(x), lambda y: _ampersands(y, listed, force))))
        return F.filter(F.transform(tokens, _bare), lambda n: (n != "") & (F.length(n) <= 90) & ~n.rlike(NOISY) & ~n.rlike(GENERIC_TOKEN) & ~n.rlike(ALL_NIGHT) & ~n.rlike(GENERIC_GUEST))

    return F.when(F.coalesce(value, F.lit("")) == "", none()).otherwise(let(text, names))


def guests(value: Column) -> Column:
    """Names of a guest line; after a prefix such as `with special guests`, `&` separates."""
    text = F.regexp_replace(collapse(F.coalesce(value, F.lit(""))), GUEST_LEAD, "")
    text = F.when(F.size(F.regexp_extract_all(text, F.lit("\\.\\s+(?=[\\p{L}\\d])"), F.lit(0))) >= 2, F.regexp_replace(text, "\\.\\s+(?=[\\p{L}\\d])", ", ")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, "\\s*;\\s*", ", "), "(?i)(?:\\s*\\.\\s*)?\\b(?:with\\s+)?supports?\\s+from\\s+", ", ")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)\\s+-\\s+(?:a\\s+)?tribute\\s+to\\s+[^,&+|]+?\\s+(?:&|and)\\s+", ", "), "(?i)\\s+-\\s+(?:a\\s+)?tribute\\s+to\\s+[^,&+|]+$", "")
    explicit = value.rlike(GUEST_PREFIX) | value.rlike(GUEST_LEAD)
    return normalise_names(F.when(F.coalesce(explicit, F.lit(False)), split_list(text, True)).otherwise(split_list(text)))


def _found(title: Column, pattern: str) -> Column:
    return F.regexp_extract(title, pattern, 1)


def title_featured(title: Column) -> Column:
    return normalise_names(split_list(_found(title, TITLE_FEATURED)))


def title_presented(title: Column) -> Column:
    return normalise_names(split_list(_found(title, TITLE_PRESENTED)))


def title_trailing_with(title: Column) -> Column:
    return normalise_names(F.transform(split_list(_found(title, TITLE_TRAILING_WITH), True), lambda n: collapse(F.regexp_replace(n, LOCATION, ""))))


def title_headliner(title: Column) -> Column:
    """Who stands before a quoted name or a release's launch."""
    name = F.coalesce(*(F.nullif(collapse(_found(title, p)), F.lit("")) for p in TITLE_HEADLINERS))
    return F.when(name.isNull() | name.rlike(HEADLINER_SEPARATOR), none()).otherwise(normalise_names(F.array(name)))


def title_lineup(title: Column) -> Column:
    """A title that is a list of two names or more, without words of other titles."""
    ok = (F.length(title) <= 120) & title.contains(",") & ~title.rlike(TITLE_NOISE)
    names = split_list(title)
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(names) >= 2), normalise_names(names)).otherwise(none())


def tribute_subjects(title: Column) -> Column:
    """Whom a tribute honours: they don't play."""
    one, two, three = (_found(title, p) for p in TRIBUTES)
    names = F.concat(F.array(one), F.split(two, "(?i)\\s*(?:/|,|\\+|&|\\band\\b)\\s*"), F.split(three, "\\s*/\\s*"))
    return F.filter(F.transform(names, collapse), lambda n: n != "")


def lineup_block(lines: Column) -> Column:
    """The lines behind a line-up heading up to the first that is no name, if they are two or more; 30 at most."""
    ok = lambda x: let(_bare(F.regexp_replace(x, LOCATION, "")), lambda n: (n != "") & (F.length(n) <= 80) & (F.size(F.split(n, " ")) <= 10) & ~n.rlike(LINEUP_STOP) & ~n.rlike(GENERIC_GUEST) & ~n.rlike(NOISY) & ~n.rlike(GENERIC_TOKEN) & ~n.rlike(ALL_NIGHT)) & ~x.rlike(LINEUP_STOP)
    start = F.struct(F.lit(0).alias("left"), none().alias("block"), none().alias("out"))

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["block"]) >= 2, F.concat(acc["out"], acc["block"])).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        name = collapse(_bare(F.regexp_replace(x, LOCATION, "")))
        opened = F.struct(F.lit(30).alias("left"), none().alias("block"), close(acc).alias("out"))
        more = F.struct((acc["left"] - 1).alias("left"), F.concat(acc["block"], F.array(name)).alias("block"), acc["out"].alias("out"))
        shut = F.struct(F.lit(0).alias("left"), none().alias("block"), close(acc).alias("out"))
        return F.when(x.rlike(LINEUP_HEADING), opened).when((acc["left"] > 0) & ok(x), more).otherwise(shut)

    return F.aggregate(F.coalesce(lines, none()), start, step, close)


def description_names(lines: Column) -> Column:
    """Line-up blocks, then what the line patterns find."""

    def of_line(x: Column) -> Column:
        parts = []
        for i, (pattern, commas) in enumerate(DESCRIPTION_LINES):
            found = F.regexp_extract(x, pattern, 1)
            ok = F.size(F.split(found, ",")) > commas
            names = F.when(found.rlike("[,;+]"), split_list(found, True)).otherwise(split_list(found, i == 4, False))
            parts.append(F.when((found != "") & ok, names).otherwise(none()))
        return F.concat(*parts)

    return normalise_names(F.concat(lineup_block(lines), F.flatten(F.transform(F.coalesce(lines, none()), of_line))))


def not_known(names: Column, known: Column) -> Column:
    """Names that are neither known nor made of known names by `and` or `&`."""
    keys = F.transform(known, identity)
    parts = lambda n: F.transform(F.split(n, "(?i)\\s+(?:&|and)\\s+"), identity)
    return F.filter(names, lambda n: (identity(n) != "") & ~F.array_contains(keys, identity(n)) & ~((F.size(parts(n)) > 1) & F.forall(parts(n), lambda p: F.array_contains(keys, p))))


def coalesce_band_names(names: Column, title: Column) -> Column:
    """Where the title says `A and the B` and both are names, one name of both in the first one's place."""
    bands = F.filter(F.transform(F.split(title, "\\s+\\+\\s+"), collapse), lambda s: s.rlike("(?i)^.+?\\s+and\\s+the\\s+.+$"))
    start = names

    def step(acc: Column, band: Column) -> Column:
        left, right = identity(F.regexp_extract(band, "(?i)^(.+?)\\s+and\\s+the\\s+(.+)$", 1)), identity(F.regexp_extract(band, "(?i)^(.+?)\\s+and\\s+the\\s+(.+)$", 2))
        keys = F.transform(acc, identity)
        a, b = F.array_position(keys, left), F.array_position(keys, right)
        first = F.least(a, b)
        merged = F.filter(F.transform(acc, lambda n, i: F.when(i + 1 == first, band).when((i + 1 == a) | (i + 1 == b), F.lit(None)).otherwise(n)), lambda n: n.isNotNull())
        return F.when((a > 0) & (b > 0) & (a != b), merged).otherwise(acc)

    return F.aggregate(bands, start, step)


def without_title_aliases(names: Column, title: Column) -> Column:
    """Without a name of which another, that the title holds, is the longer form (`and the …`, `the …`, `band`)."""
    whole = identity(title)
    longer = lambda n, m: (m != n) & (m.startswith(F.concat(n, F.lit(" and the "))) | m.startswith(F.concat(n, F.lit(" the "))) | (m == F.concat(n, F.lit(" band")))) & whole.contains(m)
    keys = F.transform(names, identity)
    return F.filter(names, lambda n: ~F.exists(keys, lambda m: longer(identity(n), m)))


def names_as_in_title(names: Column, title: Column) -> Column:
    """Names with a leading The or the ensemble that the title has; a name all in lower case as the title spells it."""

    def one(name: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
        found = F.call_function("regexp_extract", title, F.concat(F.lit("(?i)(?:^|[^\\p{L}\\p{N}])((?:The\\s+)?"), quoted, F.lit(f"(?:\\s+(?:{ENSEMBLES}))?)(?=$|[^\\p{{L}}\\p{{N}}])")), F.lit(1))
        same, head, ensemble = F.lower(found) == F.lower(name), found.rlike("^The ") & (F.lower(found) == F.concat(F.lit("the "), F.lower(name))), F.lower(found).startswith(F.concat(F.lower(name), F.lit(" ")))
        return F.when(found == "", name).when(same, F.when(name == F.lower(name), found).otherwise(name)).when(head | ensemble, found).otherwise(name)

    return F.when(F.coalesce(title, F.lit("")) == "", names).otherwise(F.transform(names, one))


def ordered_by(names: Column, order: Column) -> Column:
    """names in the order of `order` if that is a permutation of them by identity, else as they are."""
    keys, wanted = F.transform(names, identity), F.transform(order, identity)
    at = F.transform(wanted, lambda k: F.array_position(keys, k).cast("int"))
    full = (F.size(names) == F.size(order)) & (F.size(F.array_distinct(F.filter(at, lambda i: i > 0))) == F.size(names)) & (F.size(names) > 1)
    return F.when(full, F.transform(at, lambda i: F.get(names, i - 1))).otherwise(names)


def ordered_by_covering(names: Column, order: Column) -> Column:
    """names in the order in which they stand in `order`, which may hold more, if it holds all of them."""
    wanted = F.transform(order, identity)
    placed = F.transform(names, lambda n, i: F.struct(F.array_position(wanted, identity(n)).alias("at"), i.alias("i"), n.alias("n")))
    return F.when((F.size(names) > 1) & F.forall(placed, lambda p: p["at"] > 0), F.transform(F.array_sort(placed), lambda p: p["n"])).otherwise(names)


def first_by_title(names: Column, title: Column) -> Column:
    """Names that the title's `A + B` lists first, in its order, if all its parts are names."""
    parts = F.filter(F.transform(F.split(title, "\\s+\\+\\s+"), lambda s: identity(F.regexp_replace(s, "(?i)\\s+(?:(?:australian|world|national)\\s+)?tour\\b.*$", ""))), lambda s: s != "")
    keys = F.transform(names, identity)
    at = F.transform(parts, lambda k: F.array_position(keys, k).cast("int"))
    ok = (F.size(parts) > 1) & F.forall(at, lambda i: i > 0) & (F.size(F.array_distinct(at)) == F.size(at))
    rest = F.filter(names, lambda n: ~F.array_contains(parts, identity(n)))
    return F.when(ok, F.concat(F.transform(at, lambda i: F.get(names, i - 1)), rest)).otherwise(names)


def with_oztix_names(rows: DataFrame, title: str, structured: str, guest_line: str, description_lines: str) -> DataFrame:
    """rows of search-index hits with artists and artist_kind: structured names, names of the title, guests and the
    description, without tribute subjects and theme parties' bands, each identity once, spelt and ordered as the title
    and the text have it. The steps are columns, so that each is worked out once."""
    t = F.coalesce(F.col(title), F.lit(""))
    plays = lambda n: ~F.array_contains("_subjects", identity(n)) & ~(t.rlike(THEME_PARTY) & (identity(n) != "") & F.col("_whole").contains(identity(n)))
    out = rows.withColumn("_subjects", F.transform(tribute_subjects(t), identity)).withColumn("_whole", identity(t))
    out = out.withColumn("_own", F.filter(F.flatten(F.transform(F.coalesce(structured, none()), lambda s: split_list(s, False, False))), plays))
    out = out.withColumn("_guest", guests(F.col(guest_line))).withColumn("_told", description_names(F.col(description_lines)))
    lead = F.when(F.size("_own") > 0, none()).otherwise(F.concat(title_headliner(t), F.when(F.size("_guest") == 0, title_lineup(t)).otherwise(none())))
    out = out.withColumn("_lead", F.concat("_own", lead, title_presented(t), title_featured(t), title_trailing_with(t)))
    out = out.withColumn("_new", not_known(F.col("_guest"), F.col("_lead"))).withColumn("_more", not_known(F.col("_told"), F.concat("_lead", "_guest")))
    out = out.withColumn("_every", distinct_by(F.filter(F.concat("_lead", "_new", "_more"), plays), identity))
    out = out.withColumn("_bands", coalesce_band_names(F.col("_every"), t)).withColumn("_spelt", names_as_in_title(F.col("_bands"), t))
    out = out.withColumn("_shown", distinct_by(without_title_aliases(F.col("_spelt"), t), identity)).withColumn("_placed", ordered_by(F.col("_shown"), F.col("_told")))
    out = out.withColumn("artists", normalise_names(first_by_title(F.col("_placed"), t)))
    kind = F.when(F.size("artists") == 0, "unknown").when(F.size("_own") > 0, "structured").otherwise("parsed_text")
    return out.withColumn("artist_kind", kind).drop("_subjects", "_whole", "_own", "_guest", "_told", "_lead", "_new", "_more", "_every", "_bands", "_spelt", "_shown", "_placed")


def ticketek_names(title: Column, subtitle: Column, summary: Column) -> Column:
    """Who presents, and who is featured in title, subtitle or summary."""
    clean = lambda v: collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "(?i)^(?:featuring|feat\\.?|ft\\.?)\\s+", ""), TICKETEK_TAIL, ""), "^[-–•]+|[-–•]+$", ""))

    def names(v: Column) -> Column:
        listed = F.split(F.regexp_replace(clean(v), "(?i)\\s+and\\s+(?=[^,;+]+$)", ", "), "\\s*[,+;]\\s*")
        return F.filter(F.transform(listed, clean), lambda n: (n != "") & ~n.rlike(TICKETEK_PROMOTER) & (F.length(n) <= 80) & ~n.rlike("[.?!]|(?i)https?://") & (F.size(F.split(n, "\\s+")) <= 8))

    found = [names(F.regexp_extract(collapse(title), "(?i)^(.+?)\\s+presents?\\s+(.+)$", 1)), *(names(F.regexp_extract(collapse(F.coalesce(t, F.lit(""))), "(?i)\\b(?:featuring|feat\\.?|ft\\.?)\\s+(.+)$", 1)) for t in (title, subtitle, summary))]
    return normalise_names(F.concat(*found))


def bird_names(featuring: Column, info: Column, title: Column) -> Column:
    """A comma list that isn't a presenter's line, and the block behind `featuring:` of a text; the title isn't a name."""
    listed = F.when(F.coalesce(featuring, F.lit("")).rlike("(?i)^\\s*presented by\\b"), none()).otherwise(F.split(F.coalesce(featuring, F.lit("")), ","))
    block = F.split(F.regexp_extract(F.coalesce(info, F.lit("")), "(?is)\\bfeaturing\\s*:\\s*(.+)$", 1), "\\n+")
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(collapse(x), "^&\\s*", ""), "(?i),?\\s+on the 1s and 2s\\b.*$", ""), "(?i),\\s+bringing\\b.*$", ""), ",+$", ""))
    alias = F.regexp_extract(F.coalesce(info, F.lit("")), "(?i)\\bheadlined by\\s+[^,.\\n]{1,100}?\\baka\\s+([^,.\\n]{2,80})", 1)
    told = F.filter(F.concat(F.array(collapse(alias)), F.transform(block, line)), lambda n: (n != "") & (n != "&") & (F.length(n) <= 80) & ~n.rlike("[.!?]$"))
    every = F.filter(F.transform(F.concat(listed, F.flatten(F.transform(told, lambda n: F.split(n, ",")))), collapse), lambda n: (n != "") & (identity(n) != identity(title)))
    return normalise_names(every)


def milk_bar_names(lines: Column, structured: Column, guest_line: Column, title: Column) -> Column:
    """(artists, kind): what a description's lines name beats structured names and guests."""

    def of_line(x: Column) -> Column:
        return F.filter(F.flatten(F.array(*(F.array(*(collapse(F.regexp_extract(x, p, i + 1)) for i in range(n))) for p, n in MILK_BAR_LINES))), lambda v: v != "")

    told = normalise_names(F.flatten(F.transform(F.coalesce(lines, none()), of_line)))
    own = F.flatten(F.transform(structured, lambda s: split_list(s, False, False)))
    explicit = F.coalesce(guest_line.rlike(GUEST_PREFIX) | guest_line.rlike("[,;+•]"), F.lit(False))
    joined = normalise_names(names_as_in_title(F.concat(own, F.when((F.size(own) == 0) | explicit, guests(guest_line)).otherwise(none())), title))
    kind = F.when(F.size(told) > 0, "explicit_lineup").when(F.size(joined) == 0, "unknown").when(F.size(own) > 0, "structured").otherwise("explicit_lineup")
    return F.struct(F.when(F.size(told) > 0, told).otherwise(joined).alias("artists"), kind.alias("kind"))


def shared_surname(left: Column, right: Column) -> Column:
    """`Ann`, `Bob Lee` are Ann Lee and Bob Lee."""
    short = ~left.contains(" ") & right.contains(" ")
    return F.array(F.when(short, F.concat(left, F.lit(" "), F.element_at(F.split(right, "\\s+"), -1))).otherwise(left), right)
