"""HTML as a small tree of blocks, the features of its nodes, and main text from a choice of nodes."""
from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object title select textarea button annotation annotation-xml".split())
#: Formulas are text of their block.
MATHS = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded "
    "menclose merror mmultiscripts mprescripts semantics".split()
)
INLINE = MATHS | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var br img wbr input".split()
)
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: An opening tag of the first kind ends an open element of the second kind, if no element of the third is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
KINDS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav", "header", "footer", "aside",
         "form fieldset", "table thead tbody tr td th", "blockquote pre figure figcaption", "#text")
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
#: A start tag of these ends a hidden element that is never closed.
BLOCKS = frozenset(KIND) - {"#text"} | frozenset("address center details dialog hgroup hr menu summary".split())
#: Words of class, id and role attributes that tell main text from the rest.
MAIN_TOKENS = frozenset("article body content entry main post story text".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement alert author banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "discussion disqus dropdown footer form gdpr head header links login masthead menu meta modal nav navbar navigation newsletter "
    "notice notification overlay pagination pager popup privacy promo recommended related replies reply respond rail search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = (
    "depth", "chars", "link_share", "chars_per_tag", "tags", "punctuation", "words_per_block",
    *(f"is_{k.split()[0]}" for k in KINDS), "main_tokens", "other_tokens", "main_above", "other_above", "article_above", "edge_above",
    "siblings", "same_siblings", "place", "share_of_parent", "share_of_page", "siblings_links", "inputs",
)
ODD_COMMENT = re.compile(r"<!---?>|<!--(?:(?!--!?>).)*--!>", re.DOTALL)


class Node:
    __slots__ = ("tag", "parent", "children", "text", "tokens", "chars", "links", "tags", "marks", "words", "blocks", "depth", "inputs",
                 "place", "main")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str] = frozenset(), main: str | None = None):
        self.tag, self.parent, self.tokens, self.main = tag, parent, tokens, main
        self.place = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)
        self.children: list[Node] = []
        self.text: list[str] = []  # only in text nodes
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.tags = self.marks = self.words = self.blocks = self.inputs = 0


class Tree(HTMLParser):
    """Block elements and runs of text between them; inline elements only say what is link text.

    What is in a hidden element waits for its end tag and is then left out. If an element around it ends first, or the page does,
    the hidden element counts as ended by the next block's start tag, and what waited from there on is taken in after all.
    A comment or script that is never closed goes on to the end of the page.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open: list[tuple[str, Node | None]] = []  # tag, and its node if it is a block
        self.at = self.root
        self.waiting: list[tuple[str, str, list]] | None = None  # (kind, tag or text, attributes) since a hidden element's start
        self.inner: list[str] = []  # tags open there, the hidden element's own first
        self.inner_counts: Counter[str] = Counter()
        self.in_link = 0
        self.feed(_without_open_comment(html))
        self.close()
        if self.waiting is not None:
            self._take_in()
        _measure(self.root)

    def handle_starttag(self, tag, attrs):
        if self.waiting is not None:
            self.waiting.append(("start", tag, attrs))
        elif tag in HIDDEN:
            self._hide(tag)
            self.waiting = [("start", tag, attrs)]
            self.inner.clear()
            self.inner_counts.clear()
        else:
            self._start(tag, attrs)
            return
        if tag not in VOID:
            self.inner.append(tag)
            self.inner_counts[tag] += 1

    def handle_endtag(self, tag):
        if self.waiting is None:
            self._end(tag)
        elif self.inner_counts[tag]:
            self.waiting.append(("end", tag, []))
            last = None
            while last != tag:
                last = self.inner.pop()
                self.inner_counts[last] -= 1
            if not self.inner:
                self.waiting = None
        elif tag in ("html", "body") or any(tag == other for other, _ in self.open):
            self._take_in()
            self._end(tag)

    def handle_data(self, data):
        if self.waiting is None:
            self._text(data)
        else:
            self.waiting.append(("text", data, []))

    def _hide(self, tag):
        self.at.inputs += tag in ("select", "textarea", "button")
        self._text(" ")

    def _take_in(self):
        """What waited behind a hidden element that isn't closed, from the next block on."""
        events, self.waiting = self.waiting, None
        ends, starts = _matched(events)
        hidden, left_out, k = True, {0}, 1
        while k < len(events):
            kind, value, attrs = events[k]
            if kind == "start" and value in HIDDEN:
                if not hidden:
                    self._hide(value)
                hidden = hidden or k not in ends
                k = ends.get(k, k)
            elif kind == "start" and (not hidden or value in BLOCKS):
                hidden = False
                self._start(value, attrs)
            elif kind == "start":
                left_out.add(k)
            elif kind == "end" and not hidden and starts.get(k) not in left_out:
                self._end(value)
            elif kind == "text" and not hidden:
                self._text(value)
            k += 1

    def _start(self, tag, attrs):
        if tag in INLINE:
            if tag == "br":
                self._text(" ")
            elif tag == "input":
                self.at.inputs += 1
            elif tag not in VOID:
                self.open.append((tag, None))
                self.in_link += tag == "a"
            return
        if tag in VOID:
            self._text(" ")
            self.at.tags += 1
            return
        if tag in ("html", "body"):
            self.root.tokens |= _tokens(attrs)
            return
        self._end_implied(tag)
        node = Node(tag, self.at, _tokens(attrs), dict(attrs).get("data-main"))
        self.open.append((tag, node))
        self.at = node

    def _end_implied(self, tag):
        enders, scope = ENDS.get(tag, (set(), set()))
        for k in range(len(self.open) - 1, -1, -1):
            other = self.open[k][0]
            if other in enders or other == "p" and not enders:
                self._close(k)
                return
            if other in scope or not enders and self.open[k][1] is not None:
                return

    def _close(self, k):
        ended = self.open[k:]
        del self.open[k:]
        self.in_link -= sum(tag == "a" for tag, _ in ended)
        if outermost := next((node for _, node in ended if node is not None), None):
            self.at = outermost.parent

    def _end(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if self.open[k][1] is not None and tag in INLINE:
                return

    def _text(self, data):
        if self.at.tag in ("html", "table", "tr", "ul", "ol") and not data.strip():
            return
        if not self.at.children or self.at.children[-1].tag != "#text":
            if not data.strip():
                return
            Node("#text", self.at)
        node = self.at.children[-1]
        node.text.append(data)
        if self.in_link > 0:
            node.links += len(data)


def _without_open_comment(html: str) -> str:
    """The page up to a comment that is never closed, unless that is a part of a script or style.

    Comments' rarer forms, ``<!-->`` and an end with ``--!>``, are put in the usual one.
    """
    html = ODD_COMMENT.sub("<!---->", html) if "--!>" in html or "<!-->" in html or "<!--->" in html else html
    at = html.find("<!--", max(html.rfind("-->"), 0))
    if at < 0:
        return html
    lower = html.lower()
    while at >= 0:
        raw = max(lower.rfind("<script", 0, at), lower.rfind("<style", 0, at))
        closed = raw < 0 or lower.find("</style" if lower.startswith("<style", raw) else "</script", raw, at) >= 0
        if closed:
            return html[:at]
        end = lower.find("</style" if lower.startswith("<style", raw) else "</script", at)
        at = html.find("<!--", end) if end >= 0 else -1
    return html


def _matched(events) -> tuple[dict[int, int], dict[int, int]]:
    """Ends by start and starts by end, of elements that are closed."""
    ends, starts, opened, counts = {}, {}, [], Counter()
    for k, (kind, tag, _) in enumerate(events):
        if kind == "start" and tag not in VOID:
            opened.append((tag, k))
            counts[tag] += 1
        elif kind == "end" and counts[tag]:
            last = None
            while last != tag:
                last, at = opened.pop()
                counts[last] -= 1
            ends[at], starts[k] = k, at
    return ends, starts


def _tokens(attrs) -> frozenset[str]:
    value = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
    return frozenset(t.lower() for t in TOKEN.findall(value)) if value else frozenset()


def nodes_of(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    return out


def _measure(root: Node) -> None:
    for node in reversed(nodes_of(root)):
        if node.tag == "#text":
            joined = "".join(node.text)
            node.chars, node.words, node.blocks = len(joined), len(joined.split()), 1
            node.marks = sum(map(joined.count, ".,;:!?"))
        else:
            node.tags += 1
            for c in node.children:
                for name in ("chars", "links", "tags", "marks", "words", "blocks", "inputs"):
                    setattr(node, name, getattr(node, name) + getattr(c, name))


def features(nodes: list[Node]) -> np.ndarray:
    """A row of ``FEATURES`` per node."""
    rows = np.zeros((len(nodes), len(FEATURES)), np.float32)
    above: dict[Node, tuple[int, int, int, int]] = {}
    page = max(1, nodes[0].chars)
    kinds: dict[Node, Counter] = {}
    for row, node in zip(rows, nodes, strict=True):
        parent = node.parent
        main, other = len(node.tokens & MAIN_TOKENS), len(node.tokens & OTHER_TOKENS)
        up = above[parent] if parent else (0, 0, 0, 0)
        above[node] = (
            up[0] + main, up[1] + other, up[2] + (node.tag in ("article", "main")),
            up[3] + (node.tag in ("nav", "header", "footer", "aside", "form")),
        )
        siblings = len(parent.children) if parent else 1
        if parent and parent not in kinds:
            kinds[parent] = Counter(c.tag for c in parent.children)
        chars = max(1, node.chars)
        row[:7] = (node.depth, np.log1p(node.chars), node.links / chars, node.chars / (node.tags + 1), np.log1p(node.tags),
                   node.marks / chars, node.words / max(1, node.blocks))
        if (kind := KIND.get(node.tag)) is not None:
            row[7 + kind] = 1
        family = max(1, parent.chars) if parent else chars
        row[7 + len(KINDS) :] = (
            main, other, *up, siblings, kinds[parent][node.tag] / siblings if parent else 1, node.place / siblings, node.chars / family, node.chars / page,
            (parent.links - node.links) / family if parent else 0, node.inputs,
        )
    return rows


def labels(nodes: list[Node]) -> np.ndarray:
    """Which nodes hold main text, by the nearest ``data-main`` above a text, or an article element without one."""
    inside: dict[Node, bool] = {}
    for n in nodes:
        inside[n] = n.main == "1" if n.main is not None else n.tag == "article" or bool(n.parent) and inside[n.parent]
    out = {n: n.tag == "#text" and inside[n] and bool("".join(n.text).strip()) for n in nodes}
    for n in reversed(nodes):
        if n.parent and out[n]:
            out[n.parent] = True
    return np.array([out[n] for n in nodes], np.float64)


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the likeliest choice in which everything below a node left out is left out.

    Bottom-up, a node's subtree is either dropped whole or the node stays and each child takes its better form.
    """
    place = {node: k for k, node in enumerate(nodes)}
    stay_log = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    stay = stay_log.copy()
    for k in range(len(nodes) - 1, 0, -1):
        up = place[nodes[k].parent]
        stay[up] += max(stay[k], drop[k])
        drop[up] += drop[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[place[nodes[k].parent]] and stay[k] > drop[k]
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Blocks of kept text in page order, white space inside a block as one space, empty blocks left out."""
    blocks = (" ".join("".join(n.text).split()) for n, k in zip(nodes, kept, strict=True) if k and n.tag == "#text")
    return "\n\n".join(b for b in blocks if b)
