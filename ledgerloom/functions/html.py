"""A small HTML tree on the standard library's parser, forgiving about tags that are never closed."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

# How tags behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("div p li ul ol table center blockquote section h1 h2 h3 h4 h5 h6 hr".split())
SKIPPED = frozenset("script style head title noscript".split())
SPACED = frozenset("br p div li td th tr".split())
ACTIVE = frozenset("script noscript iframe frame frameset object embed applet link meta form".split())
#: Open tags that a start tag closes.
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, **{t: {"p"} for t in BLOCK if t != "hr"}}
#: Tags that such closing doesn't reach through.
FENCES = {"li": {"ul", "ol"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}}


class Node:
    """An element: kids are elements and strings in document order."""

    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """This element and those below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags and n is not self)

    def above(self, *tags: str) -> Node | None:
        return next((n for n in self.up() if n.tag in tags), None)

    @property
    def style(self) -> str:
        return self.attrs.get("style", "").replace(" ", "").lower()

    def pieces(self) -> Iterator[tuple[Node, str]]:
        """(owner, text) of each string below; a space follows tags that separate words."""
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                yield x
                continue
            if x is not self and x.tag in SPACED and x.parent is not None:
                todo.append((x.parent, " "))
            todo.extend((x, k) if isinstance(k, str) else k for k in reversed(x.kids))

    def text(self) -> str:
        return "".join(t for _, t in self.pieces())

    def words(self) -> str:
        return " ".join(self.text().split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            self.root.attrs |= {k: v or "" for k, v in attrs}
            return
        closes, fences = CLOSES.get(tag, ()), FENCES.get(tag, {"table", "td", "th"})
        node = self.at
        while node is not self.root and node.tag not in fences:
            if node.tag in closes:
                self.at = node.parent or self.root
                if tag != "tr":
                    break
            node = node.parent or self.root
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "html" and self.at is not self.root:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent or self.root
                return
            node = node.parent or self.root

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(content: str | bytes) -> Node:
    """The tree of a document; bytes are UTF-8, or else Windows-1252."""
    if isinstance(content, bytes):
        try:
            content = content.decode("utf-8")
        except UnicodeDecodeError:
            content = content.decode("cp1252", errors="replace")
    builder = _Builder()
    builder.feed(re.sub(r"^\s*<\?xml[^>]*\?>", "", content))
    builder.close()
    return builder.root


def visible(root: Node) -> Node:
    """root without what a reader doesn't see: hidden elements and the header of inline tags."""
    for node in list(root.walk()):
        node.kids = [k for k in node.kids if isinstance(k, str) or not ("display:none" in k.style or k.tag == "ix:header")]
    return root


_SIZE = re.compile(r"font-size:([\d.]+)(pt|px)")
_BOLD = re.compile(r"font-weight:(bold|[6-9]00)")


def font_points(node: Node) -> float | None:
    """The size that an element sets, in points."""
    sizes = [float(n) * {"pt": 1, "px": 0.75}[unit] for n, unit in _SIZE.findall(node.style)]
    return sizes[0] if sizes else None


def is_bold(node: Node) -> bool:
    return node.tag in ("b", "strong") or bool(_BOLD.search(node.style))


def body_points(root: Node) -> float:
    """The size that most text has among elements that set one; 10 if none does."""
    sized: Counter = Counter()
    for node in root.walk():
        lead = node.kids[0] if node.kids and isinstance(node.kids[0], str) else ""
        sized[font_points(node) or 0.0] += len(lead) if lead.strip() else 0
    sized.pop(0.0, None)
    return max(+sized, key=sized.__getitem__, default=10.0)


def _stands_out(owner: Node, within: Node, least: float) -> bool:
    """Whether text of owner is bold by an element up to `within`, or set in at least so many points by the nearest that sets a size."""
    chain = [owner, *owner.up()]
    inner = list(itertools.takewhile(lambda x: x is not within.parent, chain)) if within in chain else chain[:1]
    size = next(filter(None, map(font_points, chain)), 0.0)
    return size >= least or any(map(is_bold, inner))


def emphasis(node: Node, body: float) -> float:
    """Share of an element's characters that are bold within it, or larger than body text by 1.5 points or more."""
    sizes = [(len(text.strip()), _stands_out(owner, node, body + 1.5)) for owner, text in node.pieces() if text.strip()]
    return sum(n for n, out in sizes if out) / max(1, sum(n for n, _ in sizes))


def sanitised(root: Node) -> Node:
    """root without active elements, event handlers and script links."""
    for node in list(root.walk()):
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in ACTIVE]
        node.attrs = {a: v for a, v in node.attrs.items() if not a.lower().startswith("on") and not (a.lower() in ("href", "src", "action") and v.strip().lower().startswith("javascript:"))}
    return root


def escape(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return text


def serialise(node: Node) -> str:
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    if node.tag in VOID:
        return f"<{node.tag}{attrs}>"
    inner = "".join(escape(k) if isinstance(k, str) else serialise(k) for k in node.kids)
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>"
