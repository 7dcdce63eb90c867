"""A small lenient element tree for HTML and inline XBRL, with namespace scopes; standard library only."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": frozenset("p div table h1 h2 h3 h4 h5 h6 ul ol dl section article header footer nav form blockquote pre hr".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}


def normalize(text: str) -> str:
    """NFKC, runs of white space as one space, trimmed."""
    if text.isascii():  # which is NFKC
        return " ".join(text.split())
    return " ".join(unicodedata.normalize("NFKC", text).split())


class Element:
    __slots__ = ("attrs", "children", "full", "name", "ns", "parent", "prefix")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.prefix, _, local = name.rpartition(":")
        self.name, self.attrs, self.parent = local, attrs, parent
        self.full = name if self.prefix else local
        self.children: list[Element | str] = []
        own = {k[6:] if k.startswith("xmlns:") else "": v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")} if attrs else {}
        self.ns = {**parent.ns, **own} if parent and own else own or (parent.ns if parent else {})

    @property
    def namespace(self) -> str | None:
        return self.ns.get(self.prefix)

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            one = stack.pop()
            yield one
            if one.children:
                stack.extend([c for c in reversed(one.children) if not isinstance(c, str)])

    def text(self, gap: str = " ") -> str:
        out, stack = [], [self]
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                out.append(one)
            else:
                stack.extend(reversed(one.children))
        return gap.join(out)

    def up(self) -> Iterator[Element]:
        one = self
        while one is not None:
            yield one
            one = one.parent


def _first(attrs: list) -> dict[str, str]:
    """Attributes by name, the first of each."""
    seen: dict[str, str] = {}
    for k, v in attrs:
        seen.setdefault(k, v or "")
    return seen


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("root", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(tag, _first(attrs))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        closers = _CLOSED_BY.get(self.open[-1].full)
        while closers and tag in closers:
            self.open.pop()
            closers = _CLOSED_BY.get(self.open[-1].full) if self.open[-1].full != "p" else None
        one = Element(tag, attrs, self.open[-1])
        self.open[-1].children.append(one)
        if tag not in _VOID:
            self.open.append(one)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.start_and_end(tag, _first(attrs))

    def start_and_end(self, tag: str, attrs: dict[str, str]) -> None:
        self.start(tag, attrs)
        if tag not in _VOID and self.open[-1].full == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].full == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


_PIECES = re.compile(r"(<[^<>]*>)")
_ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z_][-.:\w]*)=("[^"<>]*"|'[^'<>]*')"""
_PLAIN = re.compile(rf"<(/?)([a-zA-Z][-.:\w]*)((?:{_ATTRIBUTE})*)[ ]*(/?)>", re.ASCII)
_EACH = re.compile(_ATTRIBUTE, re.ASCII)


@functools.lru_cache(4096)
def _plain(piece: str) -> tuple[str, str, dict[str, str]] | None:
    """What a tag as most are written stands for: its kind, name and attributes; None for any other, and for those whose content is no markup. Pages repeat their tags."""
    m = _PLAIN.fullmatch(piece)
    if not m or m[1] and (m[3] or m[6]) or m[2].lower() in _Builder.CDATA_CONTENT_ELEMENTS:
        return None
    return m[1] or m[6] and "/>", m[2].lower(), _first([(k.lower(), unescape(v[1:-1])) for k, v in _EACH.findall(m[3])])


def _quick(raw: str) -> Element | None:
    """The tree of a page that has only plain tags and text, the same as the parser's; None for any other page."""
    builder = _Builder()
    pieces = _PIECES.split(raw)
    for i, piece in enumerate(pieces):
        if i % 2:
            tag = _plain(piece)
            if tag is None:
                return None
            kind, name, attrs = tag
            if kind == "/":
                builder.handle_endtag(name)
            elif kind:
                builder.start_and_end(name, attrs)
            else:
                builder.start(name, attrs)
        elif "<" in piece:
            return None
        elif piece:
            builder.handle_data(unescape(piece))
    return builder.root


def parse(raw: str | bytes) -> Element:
    raw = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
    found = _quick(raw)
    if found is not None:
        return found
    builder = _Builder()
    builder.feed(raw)
    builder.close()
    return builder.root


_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def hides(element: Element, ix_namespaces: frozenset[str]) -> bool:
    """Whether the element or one around it is hidden by markup: ix:hidden or ix:header, a hidden attribute, or its own style."""
    return any("hidden" in e.attrs or _HIDING.search(e.attrs.get("style", "")) or e.name in ("hidden", "header") and e.namespace in ix_namespaces for e in element.up())
