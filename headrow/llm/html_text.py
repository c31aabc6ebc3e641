"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from headrow.llm.batches import map_text

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template head title button select textarea iframe object svg canvas audio video dialog".split())
_BESIDE = frozenset("nav footer aside menu header".split())  # beside the text, unless the page's text stands in them
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset(["article", "main"])
_TEXT = frozenset(["p", "article", "main", "h1"])  # none of these stands in a button
_PARAGRAPH = frozenset("p pre td blockquote li dd".split())
_HOLDER = frozenset("div section article main html form fieldset center details figure nav aside header footer".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_BARRIER = frozenset(["article", "section", "main", "table"])  # a stray inline end tag doesn't end these
_SAME = {  # an open element of the left kind ends where one of the right kinds begins, up to the named containers
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus consent copyright "
    "disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain pagination pager popup promo "
    "promotion related replies reply share sharing shoutbox sidebar skyscraper social sponsor sponsored subscribe taboola tags toolbar widget".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_BODY_WORDS = frozenset("article body content entry main page post story text".split())
_ARTICLE_WORDS = frozenset("article entry post story".split())  # a container of this name holds the whole article
# Blocks of their own even where they are long: they hold the page's text only if its first heading stands in them.
_TALK_WORDS = frozenset("comment comments cookie cookies disqus consent gdpr related replies reply shoutbox".split())
_COMMA = re.compile("[,،、，]")


class _Node:
    __slots__ = ("tag", "parent", "items", "words", "hidden", "spared", "beside", "whole", "size", "linked", "flow", "commas", "points", "sum", "score")

    def __init__(self, tag: str, parent: _Node | None, attrs: Iterable[tuple[str, str | None]] = ()):
        self.tag, self.parent, self.items, self.spared = tag, parent, [], False
        said = dict(attrs)
        self.words = {w for k in ("class", "id") for w in re.split(r"[^a-z0-9]+", (said.get(k) or "").lower()) if w}
        style = (said.get("style") or "").replace(" ", "").lower()
        self.hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in style
        self.beside = (said.get("role") or "").lower() in _ASIDE_ROLES
        self.whole = bool(parent) and (parent.whole or parent.tag in _WHOLE)  # inside an article or main element


class _Tree(HTMLParser):
    """Builds a tree of nodes and text; end tags that HTML lets a page leave out are supplied.

    The open elements are a stack, and of each tag it is known where it stands there, so a tag costs the same however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None)
        self.open, self.at = [self.root], defaultdict(list)

    def _pop(self, depth: int) -> None:
        """Close the open elements from depth on."""
        while len(self.open) > max(depth, 1):
            self.at[self.open.pop().tag].pop()

    def _depth(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags stands; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        if (depth := self._depth(tags)) > self._depth(stop):
            self._pop(depth)

    def _leave_head(self) -> None:
        if depth := self._depth(["head"]):
            self._pop(depth)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._leave_head()
            self.root.words |= _Node(tag, None, attrs).words & _BODY_WORDS
            return
        if tag not in _IN_HEAD:
            self._leave_head()
        if tag in _CLOSES_P and self.at.get("p"):
            self._close(frozenset(["p"]), _CLOSES_P - {"p"})
        if tag in _HEADING:
            self._close(_HEADING, _BLOCK - _HEADING)
        if tag in _SAME:
            for _ in range(2 if tag == "tr" else 1):
                self._close(*_SAME[tag])
        if tag in _TEXT:
            for depth in reversed(self.at["button"]):  # its end tag is missing
                if self.open[depth].spared:
                    break
                self.open[depth].spared = True
        node = _Node(tag, self.open[-1], attrs)
        self.open[-1].items.append(node)
        if tag not in _VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        depth = self._depth([tag])
        if depth and (tag in _BLOCK or depth >= self._depth(_BARRIER)):
            self._pop(depth)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._leave_head()
        self.open[-1].items.append(data)


def _dropped(node: _Node) -> bool:
    return node.tag in _DROPPED and not node.spared or node.hidden


def _dropped_at_least(node: _Node) -> bool:
    return _dropped(node) and (node.tag != "noscript" or node.hidden)


def _aside(node: _Node) -> bool:
    """A form, an element for what stands beside the text, or named like something of the kind."""
    if node.tag == "form" or node.beside:
        return True
    if node.tag in _BESIDE:
        return node.tag != "header" or not node.whole
    if node.words & _ASIDE_WORDS and node.tag not in ("html", "body", "article", "main"):
        return not (node.words & _BODY_WORDS and not node.words & {"comment", "comments", "sidebar", "ad", "ads", "related", "footer", "nav", "menu"})
    return False


def _prune(root: _Node, unwanted: Callable[[_Node], bool]) -> list[_Node]:
    """Drop unwanted subtrees and measure the others; nodes in page order.

    size and linked: characters of text, and those inside links. flow and commas: of the text outside the node's blocks. points:
    what a paragraph has for length and commas, else 0. sum: points of the whole subtree, each discounted by its paragraph's links.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.items = [x for x in node.items if isinstance(x, str) or not unwanted(x)]
        stack += [x for x in reversed(node.items) if not isinstance(x, str)]
    for node in reversed(order):
        texts = [" ".join(x.split()) for x in node.items if isinstance(x, str)]
        kids = [x for x in node.items if not isinstance(x, str)]
        inline = [k for k in kids if k.tag not in _BLOCK]
        own = sum(map(len, texts))
        node.size = own + sum(k.size for k in kids)
        node.linked = node.size if node.tag == "a" else sum(k.linked for k in kids)
        node.flow = own + sum(k.flow for k in inline)
        node.commas = sum(len(_COMMA.findall(t)) for t in texts) + sum(k.commas for k in inline)
        node.points = 1 + node.commas + node.flow // 100 if node.flow and (node.tag in _PARAGRAPH or node.tag in _HOLDER) else 0
        node.sum = node.points * (1 - _density(node)) + sum(k.sum for k in kids)
    return order


def _prune_and_measure(root: _Node, dropped: Callable[[_Node], bool]) -> list[_Node]:
    """Drop what can't be text, then what stands beside it, but not what holds the text of the page."""
    order = _prune(root, dropped)
    if not any(map(_aside, order)):
        return order
    spared = _holders(order)
    return _prune(root, lambda n: _aside(n) and n not in spared)


def _holders(order: list[_Node]) -> set[_Node]:
    """Asides around the article or main element with the most points, or with most of the page's points.

    An element such as nav or aside has to hold the page's first heading or such an element too: then its end tag is missing. So it is where the page has no
    text beside all asides.
    """
    headed = set()
    for node in reversed(order):
        if node.tag == "h1" or node.tag in _WHOLE:
            headed.add(node)
        if node in headed and node.parent:
            headed.add(node.parent)
    free, under = 0.0, set()  # points beside all asides
    for node in order:
        if node.parent in under or _aside(node):
            under.add(node)
        else:
            free += node.points * (1 - _density(node))
    strict = lambda n: n.tag in _BESIDE or n.beside or n.words & _TALK_WORDS
    out = {n for n in order if _aside(n) and 2 * n.sum > order[0].sum and (n in headed or not strict(n))}
    best = max((n for n in order if n.tag in _WHOLE and n.sum), key=lambda n: n.sum, default=None)
    if not out and not best and free <= 1:  # a page has a point for being there
        out = {n for n in order if _aside(n) and 2 * n.sum > order[0].sum and not n.words & _TALK_WORDS}
    if best and 2 * best.sum >= free:  # a teaser beside a page's text isn't the text
        while best:
            out.add(best)
            best = best.parent
    return out


def _density(node: _Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _rank(node: _Node) -> float:
    return node.score * (1 - _density(node))


def _score(order: list[_Node]) -> _Node | None:
    """Points go from each paragraph to its container, and from there to all ancestors, halved at each; the best after the discount for links."""
    for node in order:
        node.score = 0.0
    found = set()
    for node in reversed(order):  # children before their parents
        to = node.parent if node.tag in _PARAGRAPH and node.parent else node
        if node.points:
            to.score += node.points
            found.add(to)
        if node.parent and (node in found or node.score):
            node.parent.score += node.score / 2
            found.add(node.parent)
    for node in found:
        node.score += 5.0 * (node.tag in _WHOLE) + 3.0 * bool(node.words & _BODY_WORDS)
    return max((n for n in order if n in found), key=_rank, default=None)


def _has_title(node: _Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == "h1":
            return True
        stack += [k for k in x.items if not isinstance(k, str)]
    return False


def _kept(best: _Node) -> list[_Node | str]:
    """The best container with the siblings that look like a part of it, and those of its ancestors that hold as much; in page order."""
    bar, whole = max(10.0, 0.2 * _rank(best)), best.tag in _WHOLE
    titled = whole and _has_title(best)
    node, enough = best, 0.5 * best.sum
    before: list[_Node | str] = []  # from the best one backwards
    after: list[_Node | str] = []
    while up := node.parent:
        at = next(i for i, x in enumerate(up.items) if x is node)

        def part(x: _Node | str, ahead: bool) -> bool:
            if isinstance(x, str) or not x.size:
                return False
            if x.tag in _HEADING and ahead and (not titled if x.tag == "h1" else not whole and node is best):
                return True
            if node is not best:
                return x.sum * (1 - _density(x)) >= max(10.0, enough)
            return _rank(x) >= bar or not whole and x.sum > 0 and _density(x) < 0.25

        before += [x for x in reversed(up.items[:at]) if part(x, True)]
        after += [x for x in up.items[at + 1 :] if part(x, False)]
        node = up
    return [*reversed(before), best, *after]


def _blocks(nodes: list[_Node | str]) -> list[str]:
    """Texts between block boundaries, white space made single; a line break inside a block is white space."""
    out, now = [], []

    def end():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        else:
            block = x.tag in _BLOCK
            if block:
                end()
                stack.append(None)
            stack += reversed(x.items)
    end()
    return out


def main_text(html: str | None) -> str:
    """Main text of one page; '' for null, empty or textless pages."""
    if not html:
        return ""
    for dropped in (_dropped, _dropped_at_least):
        tree = _Tree()
        tree.feed(html)
        tree.close()
        order = _prune_and_measure(tree.root, dropped)
        best = _score(order)
        if best is not None or "<noscript" not in html.lower():
            break
    if best is None:
        return "\n\n".join(_blocks([tree.root]))
    while best.parent and best.parent.parent and (best.parent.tag in _WHOLE or best.parent.words & _ARTICLE_WORDS) and _density(best.parent) < 0.5:
        best = best.parent
    return "\n\n".join(_blocks(_kept(best)))


def extract_html(df: DataFrame, html_col: str = "html", keep: list[str] | None = None, batch_bytes: int = 1 << 20) -> DataFrame:
    """Add text (main text of the whole page) and n_chars (its code points) for every row.

    Paragraphs have a point, one for each comma and one for each 100 characters. They pass them to their container and, halved at each step,
    to all its ancestors; a container's sum is discounted by its link density. The best container
    (or the article or main element, or the container named article, entry, post or story, around it) is kept with its siblings that have paragraphs and few links,
    or as many points (of an article's siblings only the latter), headings before it, and siblings of its ancestors that hold at least half as many points, without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments. One of these that holds the page's article or most of its
    points (a form around the page, a menu whose end tag is missing) stays, and what is unwanted inside it goes. A head ends at the first element
    or text that can't stand in it. Work is linear in tags and text, however they nest.
    Blocks are joined in page order by two line feeds. A null, empty or textless page
    has an empty text and 0 characters. A page of bare text comes back whole. Repeated rows are each worked on; input columns named
    text or n_chars are replaced; an empty table gives an empty one.
    """

    def make():
        def work(pages):
            texts = [main_text(x) for x in pages]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return work

    return map_text(df, html_col, make, "text string, n_chars long", batch_bytes, keep)
