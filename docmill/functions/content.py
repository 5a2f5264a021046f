"""The main text of a page: the connected part of its tag tree with the largest weight.

A page becomes a tree of its block elements, with each run of text between them as a leaf. A leaf weighs its characters, less four times those in links, less a little;
an element that only holds others costs. What a part of the tree is worth is its own weight and what those of its children add that are worth anything, from the leaves up; the part worth
most, the inner one of two that are worth the same, is the text, without the branches that would lessen it. So lists of links and scattered lines fall away wherever they stand, and an article in several sections stays whole.

Elements that never hold text of the article (navigation, footers, forms) and those that say by name what they are (advertisement, sidebar) are left out. Unclosed paragraphs, list
items and cells end where HTML ends them. Time is linear in the page for pages nested at ordinary depth.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title nav footer aside form button select option iframe svg canvas menu dialog".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_TEXTUAL = frozenset("p li td th dd dt blockquote pre figcaption caption address h1 h2 h3 h4 h5 h6".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element ends if it is open, up to the element that confines it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_NAMED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|cookies?|menu|newsletter|popup|promo|related|share|sharing|sidebar|social|sponsored)(?:$|[\s_-])", re.IGNORECASE)
LINK_COST, LEAF_COST, HOLDER_COST = 4, 10, 100


class _Tree(HTMLParser):
    """Nodes in document order: parent, tag, and for leaves the text and how many characters of it are in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.text, self.linked = [-1], ["#root"], [""], [0]
        #: Open elements: (tag, node or -1 for inline ones, left out or not).
        self.open: list[tuple[str, int, bool]] = [("#root", 0, False)]
        self.links = 0
        self.run: list[str] = []
        self.run_linked = 0

    def _leaf(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self._node("#text", text, self.run_linked)
        self.run, self.run_linked = [], 0

    def _node(self, tag: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(next(n for _, n, _ in reversed(self.open) if n >= 0))
        self.tag.append(tag)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _close(self, depth: int) -> None:
        """Ends all elements from a depth on."""
        if any(n >= 0 for _, n, _ in self.open[depth:]):
            self._leaf()
        self.links -= sum(t == "a" for t, _, _ in self.open[depth:])
        del self.open[depth:]

    def _end_open(self, tags: set[str], confines: set[str]) -> None:
        found = None
        for d in range(len(self.open) - 1, 0, -1):
            if self.open[d][0] in confines:
                break
            if self.open[d][0] in tags:
                found = d
        if found:
            self._close(found)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            self.run.append(" ")
            return
        inline, out = tag in _INLINE, self.open[-1][2]
        if not inline:
            self._end_open(*_ENDS.get(tag, ({"p"}, {"td", "th", "li", "div", "section", "article", "table"})))
            out = self.open[-1][2]
            self._leaf()
        if not out:
            named = dict(attrs)
            out = tag in _SILENT or any(_NAMED.search(named.get(k) or "") for k in ("class", "id", "role") if not inline)
        self.open.append((tag, -1 if inline else self._node(tag), out))
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for d in range(len(self.open) - 1, 0, -1):
            if self.open[d][0] == tag:
                self._close(d)
                return
            # an inline end tag doesn't reach out of its block
            if tag in _INLINE and self.open[d][1] >= 0:
                return

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.run.append(data)
            if self.links:
                self.run_linked += len("".join(data.split()))

    def finished(self) -> "_Tree":
        self._close(1)
        self._leaf()
        return self


def _weights(tree: _Tree) -> list[int]:
    own = []
    for tag, text, linked, parent in zip(tree.tag, tree.text, tree.linked, tree.parent, strict=True):
        if tag == "#text":
            weight = len(text) - LINK_COST * linked - LEAF_COST
            own.append(max(weight, 1) if tree.tag[parent] in _HEADING else weight)
        else:
            own.append(0 if tag in _TEXTUAL else -HOLDER_COST)
    return own


def _within(parent: list[int], node: int, above: int) -> bool:
    while node > above:
        node = parent[node]
    return node == above


def main_blocks(html: str | None) -> list[str]:
    """The text runs of the part worth most, in order; none if no part is worth anything."""
    if not html:
        return []
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.finished()
    worth = _weights(tree)
    for node in range(len(worth) - 1, 0, -1):
        worth[tree.parent[node]] += max(0, worth[node])
    best = 0
    for node in range(1, len(worth)):
        if worth[node] > worth[best] or (worth[node] == worth[best] and _within(tree.parent, node, best)):
            best = node
    if worth[best] <= 0:
        return []
    inside, out = {best}, []
    for node in range(best, len(worth)):
        if node != best and tree.parent[node] in inside and worth[node] > 0:
            inside.add(node)
        if node in inside and tree.text[node]:
            out.append(tree.text[node])
    return out


def extract_main(html: str | None) -> str | None:
    """The main text, a line for each run; None without one."""
    return "\n".join(main_blocks(html)) or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _blocks(html: pd.Series) -> pd.Series:
    return html.map(main_blocks)


def main_text(html: Column) -> Column:
    """The main text of a page, a line for each run; null without one."""
    return F.nullif(F.array_join(_blocks(html.cast("string")), "\n"), F.lit(""))
