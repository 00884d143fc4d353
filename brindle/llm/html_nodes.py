"""DOM nodes of a page with their features, and made-up pages whose nodes are labelled, to learn from."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: What never is text of a page: scripts, styles, the head, sources of frames and the controls of forms.
UNSEEN = frozenset("script style head title iframe select option textarea button".split())
#: Formulas and drawings stand in their line, whatever they are made of; of drawings these parts aren't shown.
FOREIGN, NOT_DRAWN = frozenset(("math", "svg")), frozenset("title desc metadata style script".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open element of the key ends before a start tag of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
ENDS["option"] = CLOSES_P | {"option", "optgroup"}
#: What can stand in a head; other start tags and text end an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCOPE = frozenset("ul ol dl table td th div section article main body".split())

GOOD_TOKENS = frozenset("article content main post body entry story text page blog news prose".split())
BAD_TOKENS = (
    frozenset("nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager".split()),
    frozenset("header head masthead topbar logo brand banner hero".split()),
    frozenset("footer foot copyright legal bottom colophon".split()),
    frozenset("sidebar side aside widget related recommended rail trending popular tags".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion adbox".split()),
    frozenset("notice cookie cookies consent alert popup modal newsletter subscribe warning gdpr paywall".split()),
    frozenset("form search login signup share social follow".split()),
    frozenset("comment comments reply replies respond discussion disqus review reviews".split()),
)
TAGS = ["#text", "p", "div", "article", "main", "section", "body", "html", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "tr", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "figcaption", "ins", "dl", "dd", "noscript"]
_TAG = {t: i for i, t in enumerate(TAGS)}
_LANDMARKS = ["nav", "header", "footer", "aside", "form", "article", "main"]
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BUTTON = re.compile(r"<(/?)button(?=[\s/>])", re.I)
_CUT_TAG = re.compile(r"</?[A-Za-z]")
#: The open elements that a start tag may end.
ENDED_BY: dict[str, list[str]] = {}
for _open, _tags in ENDS.items():
    for _by in _tags:
        ENDED_BY.setdefault(_by, []).append(_open)


#: Stands for the tag of a button that has no end tag; a block or another button ends it.
_LOOSE = "button without end"


class _Node:
    __slots__ = ("tag", "parent", "kids", "tokens", "text", "linked", "links", "mark", "unseen")

    def __init__(self, tag: str, parent: _Node | None, tokens: frozenset = frozenset(), unseen: bool = False, mark: int | None = None):
        self.tag, self.parent, self.kids, self.tokens, self.unseen = tag, parent, [], tokens, unseen
        self.text, self.linked, self.links, self.mark = "", 0, 0, mark
        if parent is not None:
            parent.kids.append(self)


def _unclosed_buttons(html: str) -> set[tuple[int, int]]:
    """Line and offset of the buttons after which another one, or none, comes ahead of an end tag."""
    found = list(_BUTTON.finditer(html))
    loose = [m.start() for m, after in zip(found, [*found, None][1:], strict=True) if not m[1] and (after is None or not after[1])]
    out, line, at, newline = set(), 1, 0, -1
    for start in loose:
        line, newline, at = line + html.count("\n", at, start), max(newline, html.rfind("\n", at, start)), start
        out.add((line, start - newline - 1))
    return out


class _Tree(HTMLParser):
    """Block elements and, as their leaves, the runs of text between block boundaries.

    How many elements of a name are open is counted, so looking for one costs nothing where there is none.
    """

    def __init__(self, html: str, marked: bool):
        super().__init__(convert_charrefs=True)
        self.unclosed, self.marked = _unclosed_buttons(html), marked
        self.root = _Node("html", None)
        self.open: list[tuple[str, _Node]] = [("html", self.root)]
        self.count = Counter(html=1)
        self.run: list[str] = []
        self.linked = self.links = self.anchors = 0
        self.foreign: list[str] = []

    def _flush(self) -> None:
        if self.run:
            text = _SPACE.sub(" ", "".join(self.run)).strip()
            if text:
                leaf = _Node("#text", self.open[-1][1])
                leaf.text, leaf.linked, leaf.links = text, min(self.linked, len(text)), self.links
        self.run, self.linked, self.links = [], 0, 0

    def _pop(self, at: int) -> None:
        self._flush()
        self.count.subtract(name for name, _ in self.open[at:])
        del self.open[at:]

    def _end(self, name: str, scoped: bool = False) -> None:
        """The innermost open element of that name ends, with ``scoped`` only one inside the innermost container."""
        if self.count[name] <= 0:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                self._pop(i)
                return
            if scoped and self.open[i][0] in SCOPE and self.open[i][0] not in ("td", "th"):
                return

    def _end_head(self, anywhere: bool) -> None:
        if self.count["head"] <= 0:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == "head":
                self._pop(i)
                return
            if not anywhere or self.open[i][0] == "template":
                return

    def handle_startendtag(self, tag, attrs):
        if not self.foreign and tag not in FOREIGN:
            self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P or tag in ("body", "li", "td", "th", "tr"):
            self.foreign.clear()
        if self.foreign or tag in FOREIGN:
            self._end_head(False)
            self.foreign.append(tag)
            return
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag == "br":
            self.run.append(" ")
            return
        if tag in INLINE:
            if tag == "a":
                self.anchors, self.links = 1, self.links + 1
            return
        if tag in ("html", "body") and self.count[tag] > 0:
            return
        if tag in CLOSES_P and self.count["p"] > 0:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == "p":
                    self._pop(i)
                    break
                if self.open[i][0] in SCOPE:
                    break
        if tag in ("select", "input", "textarea"):
            self._end("select")
        if tag in CLOSES_P or tag == "button":
            self._end(_LOOSE)
        ended = [name for name in ENDED_BY.get(tag, ()) if self.count[name] > 0]
        if ended:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in ended:
                    self._pop(i)
                    break
                if self.open[i][0] in SCOPE and self.open[i][0] not in ("td", "th"):
                    break
        self._flush()
        if tag in VOID:
            return
        names = dict(attrs)
        words = " ".join(filter(None, (names.get("class"), names.get("id"), names.get("role"), names.get("aria-label"))))
        mark = int(names["data-gold"]) if self.marked and "data-gold" in names else None
        parent = self.open[-1][1]
        node = _Node(tag, parent, frozenset(_TOKEN.findall(_CAMEL.sub(" ", words).lower())), tag in UNSEEN or parent.unseen, mark)
        name = _LOOSE if tag == "button" and self.getpos() in self.unclosed else tag
        self.open.append((name, node))
        self.count[name] += 1

    def handle_endtag(self, tag):
        if self.foreign:
            if tag in self.foreign:
                del self.foreign[len(self.foreign) - 1 - self.foreign[::-1].index(tag) :]
                return
            if tag not in CLOSES_P and tag not in self.count:
                return
        if tag == "a":
            self.anchors = 0
        if tag in INLINE or tag in VOID:
            return
        if self.count[tag] > 0:
            self.foreign.clear()
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == tag:
                    self._pop(i)
                    return
        self._flush()

    def handle_data(self, data):
        if data.strip():
            self._end_head(False)
        if self.foreign and self.foreign[-1] in NOT_DRAWN:
            return
        if not self.open[-1][1].unseen:
            self.run.append(data)
            if self.anchors:
                self.linked += len(data.strip())


def parse(html: str, marked: bool = False) -> list[_Node]:
    """Block nodes that can hold text and runs of text, parents first, in page order. Only made-up pages are ``marked``."""
    # A tag that the text ends in is none. Without this the parser would look for its end from each of its brackets.
    tail = _CUT_TAG.search(html, html.rfind(">") + 1)
    tree = _Tree(html, marked)
    tree.feed(html[: tail.start()] if tail else html)
    tree.close()
    tree._flush()
    out, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in reversed(node.kids) if not k.unseen]
    return out


FEATURES = 30 + len(_LANDMARKS) + len(BAD_TOKENS) * 2


def features(nodes: list[_Node]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node, and the place of each node's parent (-1 for the root)."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([-1 if x.parent is None else place[id(x.parent)] for x in nodes])
    own = np.zeros((n, 8))  # chars, words, linked, links, sentence ends, commas, nodes, runs
    for i, x in enumerate(nodes):
        t = x.text
        if t:
            own[i] = len(t), t.count(" ") + 1, x.linked, x.links, t.count(". ") + t.endswith((".", "!", "?", "…", ":")), t.count(","), 0, 1
        own[i, 6] = 1
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    depth, index, siblings = np.zeros(n), np.zeros(n), np.ones(n)
    before = np.concatenate([[0], np.cumsum(own[:, 0])])[:-1]
    marks, self_bad, near_bad = ([0] * n for _ in range(3))  # a bit for each landmark or group of tokens
    good, near_good = np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    kids = np.bincount(parent[1:], minlength=n)
    for i, (x, p) in enumerate(zip(nodes, parent.tolist(), strict=True)):
        if x.tokens:
            for j, group in enumerate(BAD_TOKENS):
                self_bad[i] |= (not group.isdisjoint(x.tokens)) << j
            good[i] = len(GOOD_TOKENS & x.tokens)
        if x.tag in _LANDMARKS:
            marks[i] = 1 << _LANDMARKS.index(x.tag)
        if p >= 0:
            depth[i] = depth[p] + 1
            index[i] = seen.get(p, 0)
            seen[p] = int(index[i]) + 1
            siblings[i] = kids[p]
            marks[i] |= marks[p]
            near_bad[i] = near_bad[p] | self_bad[p]
            near_good[i] = near_good[p] + good[p]
    up = total[np.maximum(parent, 0)]
    whole = np.maximum(total[0], 1)
    chars, words, linked, links, stops, commas, count, runs = total.T
    longest = np.zeros(n)
    np.maximum.at(longest, np.maximum(parent, 0), own[:, 0])
    cols = [
        np.array([_TAG.get(x.tag, len(TAGS)) for x in nodes]), np.array([_TAG.get(nodes[p].tag, len(TAGS)) if p >= 0 else -1 for p in parent]),
        depth, np.log1p(chars), np.log1p(words), linked / np.maximum(chars, 1), links / np.maximum(words, 1), stops / np.maximum(words, 1) * 10,
        commas / np.maximum(words, 1) * 10, chars / np.maximum(count, 1), chars / np.maximum(words, 1), chars / whole[0], chars / np.maximum(up[:, 0], 1),
        runs, index, siblings, index / siblings, before / whole[0], (before + chars) / whole[0], up[:, 2] / np.maximum(up[:, 0], 1),
        up[:, 0] / np.maximum(up[:, 7], 1), chars / np.maximum(runs, 1), np.log1p(longest), np.log1p(up[:, 0]), up[:, 4] / np.maximum(up[:, 1], 1) * 10,
        stops, good, near_good, np.array([len(x.tokens) for x in nodes]), np.log1p(whole[0]) * np.ones(n),
    ]
    bits = [np.array(v)[:, None] >> np.arange(k) & 1 for v, k in ((marks, len(_LANDMARKS)), (self_bad, len(BAD_TOKENS)), (near_bad, len(BAD_TOKENS)))]
    return np.concatenate([np.stack(cols, axis=1), *bits], axis=1).astype(np.float32), parent


class MadeUpPages:
    """Pages of many layouts from a seeded generator; elements carry ``data-gold`` (1: main text, 0: not)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        syllables = [a + b for a in "b d f g h k l m n p r s t v th ch st".split() for b in "a e i o u an en on er al".split()]
        self.words = ["".join(self.r.choice(syllables, self.r.integers(1, 4))) for _ in range(900)]

    def some(self, *options):
        return options[int(self.r.integers(len(options)))]

    def maybe(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words, int(self.r.integers(low, high + 1))))

    def sentence(self) -> str:
        s = self.phrase(1, 4) if self.maybe(0.12) else self.phrase(4, 22)
        if self.maybe(0.4):
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + self.some(".", ".", ".", ".", "!", "?")

    def prose(self, low: int, high: int, links: float = 0.1) -> str:
        out = [self.sentence() for _ in range(int(self.r.integers(low, high + 1)))]
        if self.maybe(links):
            out[0] = f'<a href="/x">{out[0]}</a>'
        if self.maybe(0.15):
            out[-1] = f"<{self.some('b', 'em', 'i')}>{out[-1]}"
        if self.maybe(0.02):
            out.append(f"<math><mi>{self.phrase(1, 1)}</mi><mo>+</mo><mn>1</mn></math>.")
        return " ".join(out) + ("<br>" if self.maybe(0.1) else "")

    def odd(self) -> str:
        """Main text that isn't prose: lists on one line, shouting, marks after every word, a word over and over."""
        words = self.phrase(5, 120).split(" ")
        kind = int(self.r.integers(5))
        if kind == 0:
            return " | ".join(words)
        if kind == 1:
            return " ".join(w.upper() + "!!" for w in words)
        if kind == 2:
            return " ".join(w + self.some("###", "%%%", "&amp;&amp;&amp;", "***", "$$$") for w in words)
        if kind == 3:
            return " ".join(w for w in words[:8] for _ in range(12))
        return " ".join(words) + self.some(".", "", " 2.0.")

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.phrase(1, 3)}</a>' for i in range(int(self.r.integers(low, high + 1)))]
        kind = self.some("ul", "ul", "plain", "div", "pipes")
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{x}{'</li>' if self.maybe(0.9) else ''}" for x in items) + "</ul>"
        if kind == "div":
            return "".join(f"<div>{x}</div>" for x in items)
        return (" | " if kind == "pipes" else " ").join(items)

    def box(self, tag: str, names: list[str], body: str, gold: int = 0, named: float = 0.75) -> str:
        attr = f' {self.some("class", "class", "id")}="{self.some(*names)}"' if names and self.maybe(named) else ""
        return f'<{tag}{attr} data-gold="{gold}">{body}</{tag}>'

    def menu(self) -> str:
        return self.box(self.some("nav", "nav", "div", "ul"), ["menu", "nav", "main-nav", "navbar", "top-menu", "breadcrumb"], self.links(2, 9))

    def banner(self) -> str:
        body = f"<{self.some('h1', 'div', 'p', 'a')}>{self.phrase(1, 4)}</div>" + (f"<p>{self.phrase(2, 6)}</p>" if self.maybe(0.5) else "")
        return self.box(self.some("header", "header", "div"), ["header", "site-header", "masthead", "top"], body + (self.menu() if self.maybe(0.5) else ""))

    def foot(self) -> str:
        body = self.some("&copy; ", "Copyright ", "") + self.phrase(1, 3) + self.some(" &middot; ", ". ", " 2024 ") + (self.sentence() if self.maybe(0.6) else "")
        return self.box(self.some("footer", "footer", "div"), ["footer", "site-footer", "bottom", "copyright"], (f"<p>{body}</p>" if self.maybe(0.4) else body) + (self.links(2, 6) if self.maybe(0.4) else ""))

    def side(self) -> str:
        parts = [f"<h3>{self.phrase(1, 3)}</h3>" + (self.links(2, 7) if self.maybe(0.6) else f"<p>{self.prose(1, 3)}</p>") for _ in range(int(self.r.integers(1, 4)))]
        return self.box(self.some("aside", "div", "section"), ["sidebar", "side", "widget", "related", "related-posts"], "".join(parts), named=0.9)

    def advert(self) -> str:
        return self.box(self.some("div", "div", "ins", "section", "aside"), ["ad", "ads", "advert", "ad-box", "sponsored", "promo"], self.some(self.sentence(), f"<p>{self.prose(1, 2)}</p>", f'<a href="/b">{self.sentence()}</a>'), named=1)

    def notice(self) -> str:
        if self.maybe(0.08):
            return self.box("noscript", [], f"<p>{self.prose(1, 2)}</p>" if self.maybe(0.5) else self.sentence())
        return self.box(self.some("div", "section", "aside"), ["notice", "cookie-notice", "cookie-banner", "consent", "newsletter", "alert", "popup"], f"<p>{self.prose(1, 3)}</p>" + ("<button>OK</button>" if self.maybe(0.5) else ""), named=0.95)

    def form(self) -> str:
        return self.box("form", ["search", "login", "subscribe", "contact"], f"<label>{self.phrase(1, 3)}</label><input><p>{self.sentence()}</p><button>{self.phrase(1, 2)}</button>", named=0.5)

    def comments(self) -> str:
        one = lambda: self.box(self.some("div", "li", "article"), ["comment", "comment-body", "reply"], f"<b>{self.phrase(1, 2)}</b><p>{self.prose(1, 4)}</p>")
        return self.box(self.some("section", "div", "ol"), ["comments", "comment-list", "discussion", "reader-comments", "responses"], f"<h3>{self.phrase(1, 3)}</h3>" + "".join(one() for _ in range(int(self.r.integers(1, 5)))), named=0.95)

    def body(self) -> str:
        out = [f"<h1>{self.sentence()}</h1>"] if self.maybe(0.85) else []
        strange = 0.6 if self.maybe(0.25) else 0.04
        for _ in range(int(self.r.choice([0, 1, 2, 3, 5, 9, 16, 30]))):
            kind = self.r.random()
            if self.maybe(strange):
                out.append(f"<p>{self.odd()}" + ("</p>" if self.maybe(0.85) else ""))
            elif kind < 0.72:
                out.append(f"<p>{self.prose(1, 9)}" + ("</p>" if self.maybe(0.85) else ""))
            elif kind < 0.8:
                out.append(f"<h2>{self.phrase(2, 7)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.prose(1, 4)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.phrase(1, 3)}</td><td>{self.phrase(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.98:
                out.append(f"<div>{self.prose(1, 5)}</div>")
            else:
                out.append(self.some(self.advert, self.notice, self.form, self.side)())
        return "".join(out) or f"<p>{self.prose(1, 5)}</p>"

    def page(self) -> str:
        tag, names = self.some(("article", []), ("article", []), ("article", ["post"]), ("main", []), ("div", ["content", "post-content", "entry", "article-body", "story"]), ("section", ["content"]), ("td", []))
        article = self.box(tag, names, self.body(), 1, 0.85)
        if tag == "td":
            article = f"<table><tr>{article}<td data-gold='0'>{self.links(2, 5)}</td></tr></table>"
        ahead = [f() for f, p in ((self.banner, 0.5), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.side, 0.2)) if self.maybe(p)]
        after = [f() for f, p in ((self.side, 0.35), (self.advert, 0.35), (self.comments, 0.4), (self.form, 0.2), (self.notice, 0.15), (self.menu, 0.15), (self.foot, 0.8)) if self.maybe(p)]
        inner = "".join([*ahead, article, *after])
        if self.maybe(0.3):
            inner = f'<div class="{self.some("wrapper", "page", "container", "layout")}">{inner}</div>'
        html = f"<!DOCTYPE html><html><head><title>{self.phrase(2, 6)}</title><script>var a='</p>';</script></head><body>{inner}</body></html>"
        return html[: int(len(html) * self.r.uniform(0.85, 1))] if self.maybe(0.05) else html


def golden(nodes: list[_Node], parent: np.ndarray) -> np.ndarray:
    """Labels of made-up pages: runs as their nearest marked ancestor says, elements as whether they hold a good run."""
    inside = np.zeros(len(nodes), int)
    for i, x in enumerate(nodes):
        inside[i] = x.mark if x.mark is not None else inside[parent[i]] if parent[i] >= 0 else 0
    y = np.array([bool(x.text) and inside[i] == 1 for i, x in enumerate(nodes)])
    for i in range(len(nodes) - 1, 0, -1):
        y[parent[i]] |= y[i]
    return y


__all__ = ["FEATURES", "MadeUpPages", "features", "golden", "parse"]
