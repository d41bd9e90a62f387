"""Artist lists: cleaning, placeholders, ranks, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.functions.text import SPACE, normalise_space, search_text, slugify

#: Characters that decorate names, and texts that stand for no artist.
DECORATION = "`\"'“”‘’•·●▪▫◆◇★☆*~_=|:;,./\\\\\\-"
PLACEHOLDER = (
    "(?i)^(?:competition\\s+winners?\\s*(?:tba|tbc|to be announced)?"
    "|(?:(?:local|more|additional|specials?)\\s+)*(?:guests?|supports?|support acts?|acts?|artists?)\\s*(?:to be announced|tba|tbc)?"
    "|(?:secret|mystery)\\s+(?:act|artist|guest|set)s?|(?:more|more\\s+(?:acts?|artists?|guests?))"
    "|(?:tba|tbc|to be announced|more\\s+(?:tba|tbc|to be announced)|more to be announced))[!.]?$"
)
KIND_RANK = {"structured": 3, "explicit_lineup": 2, "parsed_text": 1, "unknown": 0}


def clean_name(name: Column) -> Column:
    """Without decoration at the ends; a name of decoration alone stays."""
    text = normalise_space(name)
    edge = f"[{DECORATION}{SPACE[1:-1]}]+"
    bare = F.regexp_replace(F.regexp_replace(text, f"^{edge}", ""), f"{edge}$", "")
    return F.when(bare == "", text).otherwise(bare)


def distinct_by(items: Column, key) -> Column:
    """Texts whose key none before has, in order."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("keys"), none.alias("items"))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(F.concat(acc["keys"], F.array(key(x))).alias("keys"), F.concat(acc["items"], F.array(x)).alias("items"))
        return F.when(F.array_contains(acc["keys"], key(x)), acc).otherwise(new)

    return F.aggregate(items, start, step, lambda acc: acc["items"])


def normalise_names(names: Column) -> Column:
    """Cleaned, without placeholders, the first of each slug.

    Slugs of names with other than ASCII letters differ by accents from their plain form here, as a pandas UDF can't
    stand inside a higher-order function; `normalise_exploded` in operators.artists folds them too.
    """
    cleaned = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), clean_plain), lambda n: (n != "") & ~n.rlike(PLACEHOLDER))
    return distinct_by(cleaned, lambda n: F.regexp_replace(F.lower(F.regexp_replace(n, "&", " and ")), "[^\\p{L}\\p{N}]+", "-"))


def clean_plain(name: Column) -> Column:
    text = F.trim(F.regexp_replace(name, f"{SPACE}+", " "))
    edge = f"[{DECORATION}{SPACE[1:-1]}]+"
    bare = F.regexp_replace(F.regexp_replace(text, f"^{edge}", ""), f"{edge}$", "")
    return F.when(bare == "", text).otherwise(bare)


def extraction(names: Column, kind: str) -> Column:
    """(artists, kind); no artist means kind unknown."""
    artists = normalise_names(names)
    return F.struct(artists.alias("artists"), F.when(F.size(artists) == 0, "unknown").otherwise(kind).alias("kind"))


def kind_rank(kind: Column) -> Column:
    rank = F.lit(0)
    for name, value in KIND_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def preferred_name(existing: Column, incoming: Column, clean=clean_name) -> Column:
    """The incoming spelling, unless it is all capitals and the existing one is mixed case. clean: `clean_plain` inside
    higher-order functions, for names without entities."""
    old, new = clean(F.coalesce(existing, F.lit(""))), clean(incoming)
    mixed = (old != F.upper(old)) & (old != F.lower(old))
    capitals = (new == F.upper(new)) & (new != F.lower(new))
    return F.when((old != "") & mixed & capitals, old).otherwise(new)


def artist_line(title: Column, names: Column) -> Column:
    """Names other than the title, each once, joined by ` | `; null if none is left."""
    own = F.filter(names, lambda n: (search_text(n) != search_text(title)) & (search_text(n) != ""))
    line = F.array_join(distinct_by(own, search_text), " | ")
    return F.when(line != "", line)


def without_composites(names: Column) -> Column:
    """Without `A & B` or `A and B` where A and B are names of the list themselves."""
    low = F.transform(names, F.lower)
    return F.filter(names, lambda n: ~((F.size(_parts(n)) > 1) & F.forall(_parts(n), lambda p: F.array_contains(low, p))))


def _parts(name: Column) -> Column:
    return F.split(F.lower(name), "\\s+(?:&|and|\\+|x)\\s+")


def merge_lists(primary: Column, extra: Column) -> Column:
    """primary, then those of extra that it has not."""
    low = F.transform(primary, search_text)
    return F.concat(primary, F.filter(extra, lambda n: ~F.array_contains(low, search_text(n))))


def by_title_position(names: Column, title: Column) -> Column:
    """In the order in which the title names them; those it doesn't name come last, in their order."""
    low = F.lower(title)
    placed = F.transform(names, lambda n, i: F.struct(F.when(F.instr(low, F.lower(n)) > 0, F.instr(low, F.lower(n))).otherwise(1 << 30).alias("at"), i.alias("i"), n.alias("n")))
    return F.transform(F.array_sort(placed), lambda x: x["n"])


def slug_of(name: Column) -> Column:
    return slugify(name)
