"""Line-up rules as data: a source's patterns in order of rank, applied to each text once in one vectorised pass.

A rule finds names in a text by a pattern; `Rules` runs a list of them over a text and gives the names in order. So a
source's line-up is a table of patterns, not a plan of nested branches that the optimiser would copy into each other.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.functions.lineups import ENSEMBLES

#: Patterns read ASCII letters, digits and word ends, as the sources' own do.
FLAGS = re.ASCII | re.IGNORECASE


class Rule(NamedTuple):
    """pattern: where names stand; groups: which parts hold them; cut: the source's way from a part to names; only: the
    match counts only if this pattern is in the text that `of` (a group) holds; unless: not if it is in the whole text;
    not_after: nor if it is in the 140 characters before; least: fewer names than this are none; ends: a match is the text's last rule; drop: removed from a part first."""

    pattern: str
    groups: tuple[int, ...] = (1,)
    cut: str = "many"
    only: str | None = None
    of: int = 0
    unless: str | None = None
    not_after: str | None = None
    least: int = 1
    ends: bool = False
    drop: str | None = None


class Rules:
    def __init__(self, rules: Iterable[Rule], cuts: Mapping[str, Callable[[str], list[str]]]):
        look = lambda p: re.compile(p, FLAGS) if p else None
        self.rules = [(r, look(r.pattern), look(r.only), look(r.unless), look(r.not_after), re.compile(r.drop, re.ASCII) if r.drop else None) for r in rules]
        self.cuts = cuts

    def names(self, text: str) -> list[str]:
        out: list[str] = []
        for rule, pattern, only, unless, not_after, drop in self.rules:
            m = pattern.search(text)
            if not m or (only and not only.search(m[rule.of] or "")) or (unless and unless.search(text)) or (not_after and not_after.search(text[max(0, m.start() - 140) : m.start()])):
                continue
            parts = [drop.sub("", m[g], count=1) if drop else m[g] for g in rule.groups if m[g]]
            found = [n for p in parts for n in self.cuts[rule.cut](p)]
            out += found if len(found) >= rule.least else []
            if rule.ends:
                break
        return out


def plain(text: str | None) -> str:
    """Entities decoded, white space collapsed."""
    return " ".join(html.unescape(text or "").split())


def slug(text: str) -> str:
    folded = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", plain(text))).lower().replace("&", " and ")
    return re.sub("[^a-z0-9]+", "-", folded).strip("-")


def edited(text: str, edits: Iterable[tuple[re.Pattern, str]]) -> str:
    for pattern, new in edits:
        text = pattern.sub(new, text)
    return plain(text)


def compiled(*edits: tuple[str, str] | str) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(e if isinstance(e, str) else e[0], FLAGS), "" if isinstance(e, str) else e[1]) for e in edits]


def distinct(names: Iterable[str], key: Callable[[str], str]) -> list[str]:
    """The first name of each key; those with an empty key go."""
    first: dict[str, str] = {}
    for n in names:
        if k := key(n):
            first.setdefault(k, n)
    return list(first.values())


def as_in_title(names: list[str], title: str) -> list[str]:
    """Names with the leading The or the ensemble that the title has; a name all in lower case as the title spells it."""
    out = []
    for n in names:
        words = r"\s+".join(map(re.escape, n.split()))
        m = re.search(rf"(?:^|[\W_])((?:The\s+)?{words}(?:\s+(?:{ENSEMBLES}))?)(?=$|[\W_])", title, re.I) if n and title else None
        own, theirs = slug(n), slug(m[1]) if m else ""
        takes = m and ((theirs == own and n == n.lower() != n.upper()) or (theirs == f"the-{own}" and m[1].startswith("The ")) or (theirs.startswith(f"{own}-") and plain(m[1])[: len(n)].lower() == n.lower()))
        out.append(plain(m[1]) if takes else n)
    return out


def lineup(f: Callable[..., tuple[list[str], str]], *texts: Column) -> Column:
    """(names, kind) of f over texts and lists of texts, for whole batches at a time; names may hold repeats."""

    @F.arrow_udf("struct<names:array<string>,kind:string>")
    def run(*columns: pa.Array) -> pa.Array:
        rows = [f(*row) for row in zip(*(c.to_pylist() for c in columns))]
        return pa.array([{"names": n, "kind": k} for n, k in rows], pa.struct([("names", pa.list_(pa.string())), ("kind", pa.string())]))

    return run(*texts)
