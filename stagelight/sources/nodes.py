"""Landed pages as tables of nodes: one pass over a page's tags marks what selectors pick, with each node's place, so that
"inside" is a range of places. A page's nodes stay in its own row, so nothing is shuffled or read twice."""

from __future__ import annotations

import re
from collections.abc import Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without an end tag, and starts of a block, which end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a start tag ends if it is open, and the element that such an end doesn't leave.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

PART = re.compile(r"\s*(>)?\s*((?:[\w-]+|\*)?(?:[.#][\w-]+|\[[^\]]*\])*)")
TEST = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([$^*]?=)\s*['\"]?([^'\"\]]*)['\"]?\s*)?\]")

NODE = "label:string,node:int,until:int,parent:int,nth:int,tag:string,attrs:map<string,string>,text:string,html:string"


def _compound(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    tests = [("~=", "class", m[2]) if m[1] == "." else ("=", "id", m[2]) if m[1] == "#" else (m[4] or "has", m[3].lower(), m[5] or "") for m in TEST.finditer(text)]
    return re.match(r"[\w-]*", text)[0].lower(), tests


def compile_selector(text: str) -> list[list[tuple[bool, tuple]]]:
    """Alternatives of steps (directly below the one before?, compound); steps are tag, .class, #id, [attr], [attr$='x']."""
    out = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps = [(m[1] == ">", _compound(m[2])) for m in PART.finditer(one.strip()) if m[2]]
        if not steps:
            raise ValueError(f"no selector: {text!r}")
        out.append(steps)
    return out


#: Tags in the plainest form, which start no raw text: equal texts of them mean equal elements.
PLAIN_START = re.compile(r"<(?!(?i:script|style|title|textarea|iframe|noembed|noframes|noscript|plaintext|xmp)\b)[a-zA-Z][a-zA-Z0-9]*(?: +[a-zA-Z][a-zA-Z0-9_-]*(?:='[^'<>]*'|=\"[^\"<>]*\")?)*>")
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
#: Most start tags whose reading is kept; they are forgotten together.
MOST_KNOWN = 4096

#: Stands for a line's end within the text of a fragment.
BREAK = "\0"


class _Node:
    __slots__ = ("tag", "attrs", "classes", "node", "until", "parent", "nth", "text", "html", "labels", "children", "up", "parts")

    def fits(self, compound: tuple) -> bool:
        tag, tests = compound
        if tag and tag != self.tag:
            return False
        for how, name, value in tests:
            have = self.attrs.get(name)
            if have is None or not (how == "has" or (how == "~=" and value in self.classes) or (how == "=" and have == value) or (how == "$=" and value and have.endswith(value)) or (how == "^=" and value and have.startswith(value)) or (how == "*=" and value and value in have)):
                return False
        return True

    def below(self, steps: list, at: int) -> bool:
        """Whether a node that fits the step `at` of a selector stands below nodes that fit the steps before it."""
        if at == 0:
            return True
        direct, above = steps[at][0], self.up
        while above is not None:
            if above.fits(steps[at - 1][1]) and above.below(steps, at - 1):
                return True
            above = None if direct else above.up
        return False


class _Reader(HTMLParser):
    """Nodes of one page in order, as far as selectors and texts need a tree: void elements, implied ends, raw scripts.

    known: what plain start tags of earlier pages mean to the same selectors, by their text; pages of a site repeat them.
    """

    def __init__(self, html: str, selectors: Mapping[str, list], line_ends: tuple[str, ...] = (), known: dict | None = None):
        super().__init__(convert_charrefs=True)
        self.line_ends = line_ends
        self.html, self.selectors, self.count, self.known = html, selectors, 0, {} if known is None else known
        self.base = self.here = 0
        self.texts = []
        self.top = self._new("", {}, frozenset(), None)
        self.open, self.marked = [self.top], []
        self.feed(html)
        self.base = len(html) - len(self.rawdata)  # what is left is read from its own start
        self.close()
        while self.open:
            self._end(len(html))

    def _new(self, tag: str, attrs: dict, classes: frozenset, up: _Node | None) -> _Node:
        x = _Node()
        x.tag, x.attrs, x.classes, x.up, x.node, x.labels, x.children, x.html, x.parts = tag, attrs, classes, up, self.count, [], 0, (0, 0), []
        x.parent, x.nth = (up.node, up.children) if up else (-1, 0)
        x.text = (len(self.texts), 0)
        self.count += 1
        if up is not None:
            up.parts.append(x)
        return x

    def updatepos(self, i: int, j: int) -> int:
        self.here = j
        return j

    def _at(self) -> int:
        return self.base + self.here

    def parse_starttag(self, i: int) -> int:
        plain = PLAIN_START.match(self.rawdata, i)
        if not plain:
            return super().parse_starttag(i)
        text = plain[0]
        if text not in self.known:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            super().parse_starttag(i)
            self.known[text] = self.read
        else:
            self._start(*self.known[text], len(text))
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else PLAIN_END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def _end(self, at: int) -> None:
        x = self.open.pop()
        if x.tag in self.line_ends:
            self.texts.append(BREAK)
        x.until, x.text, x.html = self.count, (x.text[0], len(self.texts)), (x.html[0], at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        x = _Node()
        x.tag, x.attrs = tag, {k: v or "" for k, v in reversed(attrs)}
        x.classes = frozenset((x.attrs.get("class") or "").split())
        fitting = [(label, [steps for steps in alternatives if x.fits(steps[-1][1])]) for label, alternatives in self.selectors.items()]
        self.read = (tag, x.attrs, x.classes, [(label, some) for label, some in fitting if some])
        self._start(*self.read, len(self.get_starttag_text() or ""))

    def _start(self, tag: str, attrs: dict, classes: frozenset, fitting: list, length: int) -> None:
        """Opens an element; fitting: the selectors of each label whose last step it fits."""
        at = self._at()
        if tag in SIBLINGS:
            (closes, bound), upto = SIBLINGS[tag], len(self.open)
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in bound:
                    break
                upto = i if self.open[i].tag in closes else upto
            while len(self.open) > upto:
                self._end(at)
        names = [x.tag for x in self.open] if tag in BLOCK else ()
        if "p" in names and not {"button", "td", "th"} & set(names[len(names) - 1 - names[::-1].index("p") :]):
            while self.open[-1].tag != "p":
                self._end(at)
            self._end(at)
        up = self.open[-1]
        x = self._new(tag, attrs, classes, up)
        up.children += 1
        x.labels = [label for label, some in fitting if any(x.below(steps, len(steps) - 1) for steps in some)]
        if x.labels:
            self.marked.append(x)
        x.html = (at + length, 0)
        self.open.append(x)
        if tag in VOID:
            self._end(x.html[0])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements, which are closed anyway

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag in [x.tag for x in self.open[1:]]:
            at = self._at()
            while self.open[-1].tag != tag:
                self._end(at)
            self._end(at)

    def handle_data(self, data: str) -> None:
        self.texts.append("" if self.open[-1].tag in ("script", "style") else data)
        self.open[-1].parts.append(self.texts[-1])

    def text(self, x: _Node) -> str:
        return self.html[slice(*x.html)] if x.tag in ("script", "style") else "".join(self.texts[slice(*x.text)])


def mark(html: Column, selectors: Mapping[str, str], inner: tuple[str, ...] = ()) -> Column:
    """The nodes of a page that selectors pick, in order, each under the selector's label: an array of NODE structs.

    node numbers the page's elements, those inside it come before `until`; parent is its parent's number, nth its place
    among the parent's elements. text is all text inside it, without scripts and styles, a script's own is its body;
    html, what stands between its tags, is set for the labels in `inner`. A page is read once for all selectors, in its
    own row, and only picked nodes leave the pass. Unclosed and misplaced tags are read as browsers read the common
    cases; a null or empty page has no nodes.
    """
    compiled = {label: compile_selector(text) for label, text in selectors.items()}

    names, number = ("label", "node", "until", "parent", "nth", "tag", "attrs", "text", "html"), pa.int32()
    known: dict = {}

    @F.arrow_udf(f"array<struct<{NODE}>>")
    def run(pages: pa.Array) -> pa.Array:
        out, attrs, ends, pairs = [], [], [0], [0]
        for page in pages.to_pylist():
            read = _Reader(page or "", compiled, known=known)
            for x in read.marked:
                text = read.text(x)
                for label in x.labels:
                    out.append((label, x.node, x.until, x.parent, x.nth, x.tag, text, read.html[slice(*x.html)] if label in inner else None))
                    attrs.extend(x.attrs.items())
                    pairs.append(len(attrs))
            ends.append(len(out))
        label, node, until, parent, nth, tag, text, html = zip(*out) if out else [()] * 8
        keys, values = zip(*attrs) if attrs else [()] * 2
        of = pa.MapArray.from_arrays(pa.array(pairs, number), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        columns = [pa.array(label, pa.string()), *(pa.array(c, number) for c in (node, until, parent, nth)), pa.array(tag, pa.string()), of, pa.array(text, pa.string()), pa.array(html, pa.string())]
        return pa.ListArray.from_arrays(pa.array(ends, number), pa.StructArray.from_arrays(columns, names))

    return run(html)


def fragment_lines(html: str | None, line_ends: tuple[str, ...] = ("br", "li")) -> tuple[str, list[str], list[str]]:
    """(whole text, text of each outermost element, lines of these) of a fragment; elements of `line_ends` end a line."""
    read = _Reader(html or "", {"any": compile_selector("*")}, line_ends)
    clean = lambda t: " ".join(t.split())
    outer = [read.text(x) for x in read.marked if x.parent == 0]
    lines = [clean(part) for t in outer for part in re.split(f"[\n{BREAK}]+", t)]
    return clean("".join(read.texts).replace(BREAK, "")), [t for t in (clean(x.replace(BREAK, "")) for x in outer) if t], [x for x in lines if x]


def part_text(part: _Node | str) -> str:
    """The text of a text or of an element with all in it; `br` is a line's end."""
    return part if isinstance(part, str) else "\n" if part.tag == "br" else "".join(map(part_text, part.parts))


def runs_around(html: str | None, tag: str) -> list[tuple[str, str, str, str]]:
    """For each element of a tag: its text, its parent's, and what stands beside it back and forth to its next sibling of
    that tag, the siblings parted by spaces."""
    read, clean = _Reader(html or "", {"any": compile_selector(tag)}), lambda t: " ".join(t.split())
    out = []
    for x in read.marked:
        at = next(i for i, p in enumerate(x.up.parts) if p is x)
        ends = [i for i, p in enumerate(x.up.parts) if isinstance(p, _Node) and p.tag == tag]
        low, high = max([i + 1 for i in ends if i < at], default=0), min([i for i in ends if i > at], default=len(x.up.parts))
        beside = lambda parts: clean(" ".join(map(part_text, parts)))
        out.append((clean(read.text(x)), clean(read.text(x.up) if x.up.tag else "".join(read.texts)), beside(x.up.parts[low:at]), beside(x.up.parts[at + 1 : high])))
    return out


def labelled(nodes: Column, label: str) -> Column:
    return F.filter(nodes, lambda x: x["label"] == label)


def inside(nodes: Column, outer: Column, label: str | None = None) -> Column:
    """The nodes within another one: those whose place lies in its range."""
    return F.filter(nodes, lambda x: (x["node"] > outer["node"]) & (x["node"] < outer["until"]) & (F.lit(True) if label is None else x["label"] == label))


def first(nodes: Column, label: str) -> Column:
    return F.get(labelled(nodes, label), 0)


def first_attr(nodes: Column, label: str, name: str) -> Column:
    """That attribute of the first node of a label; null where it has none."""
    return F.element_at(first(nodes, label)["attrs"], name)


def all_text(nodes: Column, label: str) -> Column:
    """The texts of a label's nodes one behind the other, the empty text without a node."""
    return F.array_join(F.transform(labelled(nodes, label), lambda x: x["text"]), "")
