"""The one HTML helper: raw fields of a captured page, in one Arrow-batched pass.

Work is linear in the page, however broken it is: an element knows its place among its siblings and what it stands in when it is made, and an
end tag that closes nothing is known by a count of open elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (
    "struct<info_html:string,h1_span:string,page_title:string,series:string,abstract:string,cover:string,author_anchors:array<string>,"
    "entries:array<struct<label:string,value:string>>,surfaces:struct<h1_title:boolean,abstract_block:boolean,json_ld:boolean,open_graph_title:boolean,open_graph_description:boolean>,"
    "heading:string,info_text:string,intro:string>"
)
LINKS = "array<struct<href:string,title_attr:string,text:string>>"

# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


# what an element may stand in: marks of its ancestors, as bits
IN_H1, IN_PICTURE, IN_REPORT, IN_FULL = 1, 2, 4, 8


class Node:
    """An element or a text. Nodes stand in ``page`` in the order of the page, so what an element holds is one slice of it."""

    __slots__ = ("attrs", "end", "kids", "marks", "page", "parent", "place", "start", "tag", "text", "within")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, text: str = "", marks: int = 0):
        self.tag, self.attrs, self.parent, self.text, self.kids, self.marks = tag, attrs, parent, text, [], marks
        if parent is None:
            self.within = self.place = 0
            self.page = []
        else:
            self.place, self.within, self.page = len(parent.kids), parent.within | parent.marks, parent.page
            parent.kids.append(self)
        self.start = len(self.page)
        self.end = self.start + 1
        self.page.append(self)

    def walk(self) -> list[Node]:
        return self.page[self.start : self.end]

    def content(self) -> str:
        return "".join([n.text for n in self.page[self.start : self.end]])

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def inner(self) -> str:
        """The markup of its children, as browsers write it."""
        out: list[str] = []
        todo: list[Node | str] = list(reversed(self.kids))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "#text":
                out.append(n.text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;") if _ESCAPED.search(n.text) else n.text)
            else:
                out.append(f"<{n.tag}{''.join(f' {k}={chr(34)}{_quoted(v)}{chr(34)}' for k, v in n.attrs.items())}>")
                if n.tag not in _VOID:
                    todo += [f"</{n.tag}>", *reversed(n.kids)]
        return "".join(out)


def _quoted(v: str) -> str:
    return v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def _marks(tag: str, attrs: dict[str, str]) -> int:
    """What an element is for those that stand in it."""
    marks = IN_H1 if tag == "h1" else 0
    if attrs:
        own = attrs.get("id")
        if own == "mainpic":
            marks |= IN_PICTURE
        elif own == "link-report":
            marks |= IN_REPORT
        if not {"hidden", "all"}.isdisjoint(attrs.get("class", "").split()):
            marks |= IN_FULL
    return marks


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def begin(self, tag: str, attrs: dict[str, str], marks: int) -> None:
        node = Node(tag, attrs, self.at, "", marks)
        if tag not in _VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        self.begin(tag, named, _marks(tag, named))

    def handle_startendtag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        Node(tag, named, self.at, "", _marks(tag, named))

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:  # what it leaves open is closed for good
            node = self.at
            self.open[node.tag] -= 1
            node.end = len(node.page)
            self.at = node.parent
            if node.tag == tag:
                return

    def handle_data(self, data):
        Node("#text", {}, self.at, data)

    def finish(self) -> Node:
        """The root; what is still open ends with the page."""
        node = self.at
        while node is not None:
            node.end = len(node.page)
            node = node.parent
        return self.root


# plain markup: texts, declarations, end tags, and start tags whose values are in double quotes, as most are
_PLAIN = re.compile(
    r"""([^<]++)(?=<)|(</([a-zA-Z][a-zA-Z0-9]*+)\s*+>)|(<([a-zA-Z][a-zA-Z0-9]*+)(?:\s++[a-zA-Z][-a-zA-Z0-9_:.]*+(?:="[^"]*+")?+)*+\s*+/?+>)|<!(?i:doctype)[^>]*+>|<!--[^->]*+-->"""
)
# elements whose content is no plain markup; a title's is, if it is one text
_RAW = frozenset("script style textarea xmp iframe noembed noframes plaintext".split())
_LONGEST = 200


class _One(HTMLParser):
    """The one start tag of a text."""

    def handle_starttag(self, tag, attrs):
        self.found = tag, {k: v or "" for k, v in reversed(attrs)}


def _read_tag(text: str) -> tuple[str, dict[str, str], int]:
    one = _One()
    one.feed(text)
    return *one.found, _marks(*one.found)


_known_tag = lru_cache(4096)(_read_tag)


def tree(html: str) -> Node:
    """A page's tree. Plain markup is cut by one expression, and tags that were met before are not read again; from the first place that is not plain on, the
    standard parser reads. It keeps nothing from one token to the next there, so the tree is the one that it makes of the whole page."""
    made = _Tree()
    at, match = 0, _PLAIN.match
    while found := match(html, at):
        kind = found.lastindex
        if kind == 1:
            text = found[1]
            Node("#text", {}, made.at, unescape(text) if "&" in text else text)
        elif kind == 2:
            made.handle_endtag(found[3].lower())
        elif kind == 4:
            text, tag = found[4], found[5].lower()
            if tag in _RAW or (tag == "title" and not html.startswith("</title>", html.find("<", found.end()))):
                break
            name, attrs, marks = _known_tag(text) if len(text) <= _LONGEST else _read_tag(text)
            if text.endswith("/>"):
                Node(name, attrs, made.at, "", marks)
            else:
                made.begin(name, attrs, marks)
        at = found.end()
    if at < len(html):
        made.feed(html[at:])
        made.close()
    return made.finish()


_ESCAPED = re.compile("[&<>\xa0]")
_RUNS = re.compile(f"[{_SPACES}]+")


def _squash(s: str) -> str:
    return _RUNS.sub(" ", s).strip(" ")


def _until_break(label: Node) -> Iterator[Node]:
    """The siblings after a label, up to the next line break."""
    for n in islice(label.parent.kids, label.place + 1, None):
        if n.tag == "br":
            return
        yield n


def _series(labels: list[Node]) -> str | None:
    for label in labels:
        if "丛书" in label.content():
            after = next((n for n in islice(label.parent.kids, label.place + 1, None) if n.tag != "#text"), None)
            if after is not None and after.tag == "a":
                return after.content().strip(_SPACES) or None
            text = "".join(n.content() for n in _until_break(label)).replace("&nbsp;", " ")
            return re.sub(r"\s*ISBN[:：]?\s*[0-9-]+.*$", "", text, flags=re.I | re.S).strip(_SPACES) or None
    return None


def _entries(info: Node) -> list[dict]:
    """Lines of the block between breaks: label and value, repeats kept."""
    out, lines = [], [[]]
    for n in info.walk():
        if n.tag == "br":
            lines.append([])
        elif n is not info:
            lines[-1].append(n)
    for line in lines:
        label = next((n for n in line if n.tag == "span" and n.has_class("pl")), None)
        if label is None:
            continue
        name = _squash(label.content()).replace(":", "").replace("：", "").replace(" ", "")
        value = _squash("".join([n.text for n in line if not label.start <= n.start < label.end]))
        if name and value:
            out.append({"label": name, "value": value})
    return out


def _landmarks(root: Node) -> tuple[dict[str, Node], set[str]]:
    """The first element of each kind that a field is read from, and the marks of surfaces, in one walk."""
    first: dict[str, Node] = {}
    marks: set[str] = set()
    for n in root.walk():
        if n.tag == "#text":
            continue
        if n.attrs.get("id") == "info":
            first.setdefault("info", n)
        if n.tag in ("title", "h1"):
            first.setdefault(n.tag, n)
        elif n.tag == "span" and "span" not in first and n.within & IN_H1:
            first["span"] = n
        elif n.tag == "img" and "image" not in first and n.within & IN_PICTURE:
            first["image"] = n
        elif n.tag == "meta":
            marks.update(x for x in (n.attrs.get("property"), n.attrs.get("name")) if x)
        elif n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            marks.add("json_ld")
        if "class" in n.attrs and n.has_class("intro"):
            first.setdefault("intro", n)
            if n.within & IN_REPORT:
                first.setdefault("report", n)
                if n.within & IN_FULL:
                    first.setdefault("full", n)
    return first, marks


def parse_page(html: str | None) -> dict:
    """Raw fields of one page; null without html."""
    found, marks = _landmarks(tree(html or ""))
    text = lambda n: n.content().strip(_SPACES) if n is not None else ""
    squashed = lambda name: _squash(found[name].content()) if name in found else ""
    info = found.get("info")
    labels = [n for n in info.walk() if n.tag == "span" and n.has_class("pl")] if info else []
    anchors = []
    for label in labels:
        if text(label).replace(":", "").replace("：", "") in ("作者", "著者"):
            names = [text(n) for n in _until_break(label) if n.tag == "a"]
            anchors.append("/".join(x for x in names if x))
    abstract = text(found.get("full")) or text(found.get("report")) or None
    return {
        "info_html": info.inner() if info else None,
        "h1_span": text(found.get("span")),
        "page_title": found["title"].content() if "title" in found else None,
        "series": _series(labels),
        "abstract": abstract,
        "cover": (found["image"].attrs.get("src") or None) if "image" in found else None,
        "author_anchors": anchors,
        "entries": _entries(info) if info else [],
        "surfaces": {
            "h1_title": squashed("span") != "",
            "abstract_block": abstract is not None,
            "json_ld": "json_ld" in marks,
            "open_graph_title": "og:title" in marks,
            "open_graph_description": "og:description" in marks,
        },
        "heading": squashed("h1"),
        "info_text": squashed("info"),
        "intro": squashed("intro"),
    }


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([parse_page(p) for p in pages], columns=list(_COLUMNS))


_COLUMNS = ("info_html", "h1_span", "page_title", "series", "abstract", "cover", "author_anchors", "entries", "surfaces", "heading", "info_text", "intro")


def page_fields(html: Column) -> Column:
    """Struct of a detail page's raw fields."""
    # declared so that the optimizer keeps it one pass instead of copying it into every use
    return F.pandas_udf(_parse, FIELDS).asNondeterministic()(html)


def _links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series(
            [[{"href": n.attrs["href"], "title_attr": n.attrs.get("title") or None, "text": _squash(n.content())} for n in tree(p or "").walk() if n.tag == "a" and "/subject/" in n.attrs.get("href", "")] for p in pages],
            dtype=object,
        )


def anchor_links(html: Column) -> Column:
    """Anchors whose address holds ``/subject/``, in page order."""
    return F.pandas_udf(_links, LINKS)(html)
