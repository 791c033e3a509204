"""Minimal HTML tree + selectors for per-document extraction inside tasks.

Built on the standard library ``html.parser`` (entities decoded, script and
style kept as raw text).  It provides just the selector semantics the
extraction jobs need:

* ``find_all`` / ``find`` by tag, class and attributes (document order)
* ``text``: all descendant strings, script/style excluded
* ``string``: a tag's single string (looked up through single-child chains)
* ``next_sibling_tag`` / ``previous_sibling_tag`` / ``next_in_document``

One document is parsed per call; Spark distributes the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
RAW_TEXT = {"script", "style"}
# An open element of the first kind ends where one of the second begins.
IMPLIED_END = {
    "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section",
          "article", "form", "pre", "blockquote", "hr"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
}
#: Elements that keep an open one outside them from ending.
SCOPE = {"table", "ul", "ol", "dl", "select", "div", "#document"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.parent = parent

    # -- navigation ---------------------------------------------------------
    def elements(self) -> Iterator["Node"]:
        """Descendant elements in document order (an explicit stack: pages nest deeply)."""
        stack = [iter(self.children)]
        while stack:
            ch = next(stack[-1], None)
            if ch is None:
                stack.pop()
            elif isinstance(ch, Node):
                yield ch
                stack.append(iter(ch.children))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            ch = stack.pop()
            if isinstance(ch, str):
                out.append(ch)
            elif ch.tag not in RAW_TEXT:
                stack.extend(reversed(ch.children))
        return "".join(out)

    @property
    def string(self) -> str | None:
        node = self
        while len(node.children) == 1:
            ch = node.children[0]
            if isinstance(ch, str):
                return ch
            node = ch
        return None

    def _siblings(self):
        return self.parent.children if self.parent is not None else []

    def next_sibling_tag(self, tag: str) -> "Node | None":
        sib = self._siblings()
        i = next(j for j, x in enumerate(sib) if x is self)
        return next((x for x in sib[i + 1:] if isinstance(x, Node) and x.tag == tag), None)

    def previous_sibling_tag(self, tag: str) -> "Node | None":
        sib = self._siblings()
        i = next(j for j, x in enumerate(sib) if x is self)
        return next((x for x in reversed(sib[:i]) if isinstance(x, Node) and x.tag == tag), None)

    def next_in_document(self, tag: str) -> "Node | None":
        """First element with ``tag`` after this one's start tag (descendants first)."""
        for el in self.elements():
            if el.tag == tag:
                return el
        node = self
        while node.parent is not None:
            sib = node.parent.children
            i = next(j for j, x in enumerate(sib) if x is node)
            for x in sib[i + 1:]:
                if isinstance(x, Node):
                    if x.tag == tag:
                        return x
                    found = next((e for e in x.elements() if e.tag == tag), None)
                    if found is not None:
                        return found
            node = node.parent
        return None


def matcher(tag: str | None = None, class_: str | None = None,
            attrs: dict | None = None, string: Callable[[str], bool] | None = None):
    def ok(n: Node) -> bool:
        if tag is not None and n.tag != tag:
            return False
        if class_ is not None and class_ not in n.classes():
            return False
        for k, v in (attrs or {}).items():
            if n.attrs.get(k) != v:
                return False
        if string is not None:
            s = n.string
            if s is None or not string(s):
                return False
        return True
    return ok


def find_all(root: Node, **kw) -> list[Node]:
    ok = matcher(**kw)
    return [n for n in root.elements() if ok(n)]


def find(root: Node, **kw) -> Node | None:
    ok = matcher(**kw)
    return next((n for n in root.elements() if ok(n)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.stack = [self.root]

    def _end_implied(self, tag):
        """Close the nearest open elements that the start of ``tag`` ends."""
        for i in range(len(self.stack) - 1, 0, -1):
            if tag in IMPLIED_END.get(self.stack[i].tag, ()):
                del self.stack[i:]
                if tag != "tr":  # a new row ends an open cell and its row
                    return
            elif self.stack[i].tag in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        kids = self.stack[-1].children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    if html:
        b.feed(html)
        b.close()
    return b.root
