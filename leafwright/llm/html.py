"""The elements and text blocks of a web page, from tags as they come.

A forgiving reader in the spirit of browsers: paragraphs, list items and cells
end where the next begins, end tags without a start do nothing, scripts and
styles are skipped to their end tag, and a tag or comment that never ends takes
the rest.  Each reads on from where it ends, so time is linear in the page.

Only block elements are nodes; elements inside a line are text, of which the
part in links is counted.  A block is what stands between two starts or ends of
block elements, with character references decoded and white space as one space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape

#: Fixed names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp svg math template".split())
BLOCK = frozenset("""
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html
    legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul
""".split())
CONTAINERS = frozenset("html body main article section div td center form fieldset".split())
#: What begins where the elements named end without an end tag.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",),
    "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"), "thead": ("td", "th", "tr", "tbody", "thead", "tfoot"), "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot"),
}
#: Elements and roles that never hold an article's text.
ASIDE = frozenset("nav header footer aside form head button select option dialog menu search object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is not the article, and of them those for readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
MARKS = COMMENTS | frozenset("""
    ad ads adbox adsense adslot advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices overlay pager pagination popup promo promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets
""".split())

_ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)*+)"
_TAG = re.compile(rf"<(/?)([A-Za-z][^\s/>]*+){_ATTRIBUTES}>")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_NAME = re.compile(r"[A-Za-z][a-z]*+|[0-9]++")
_NUMBER = re.compile(r"[0-9]++")
_ODD = re.compile(r"[^\w#-]++")


class Page:
    """Nodes in page order, each with its parent and the last node inside it,
    and blocks (node, text, letters in links)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.last, self.steps = ["#"], [-1], [0], ["#"]
        self.aside, self.named, self.comment = [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open = [0], Counter()
        self._text: list[str] = []
        self._linked, self._link = 0, False
        self._read(html)
        self._pop(1)
        self.last[0] = len(self.tags) - 1
        self._settle()

    def _read(self, html: str) -> None:
        at, end, pattern = 0, len(html), _TAG
        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                self._say(html[at:])
                return
            if mark > at:
                self._say(html[at:mark])
            m = pattern.match(html, mark)
            if m is None and pattern is _TAG and html[mark + 1 : mark + 3].lstrip("/")[:1].isalpha():
                # quotes that never end: from here on, tags end at the next bracket
                pattern = _PLAIN
                m = pattern.match(html, mark)
            if m:
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                elif name in RAW:
                    at = self._skip(html, at, name) if name not in ("svg", "math") or not m[3].endswith("/") else at
                else:
                    self._start(name, m[3])
            elif html.startswith("<!--", mark):
                close = html.find("-->", mark + 2)
                at = close + 3 if close >= 0 else end
            elif html[mark + 1 : mark + 2] in ("!", "?", "/") or html[mark + 1 : mark + 2].isalpha():
                close = html.find(">", mark)
                at = close + 1 if close >= 0 else end
            else:
                self._say("<")
                at = mark + 1

    @staticmethod
    def _skip(html: str, at: int, name: str) -> int:
        m = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+>", re.I).search(html, at)
        return m.end() if m else len(html)

    def _say(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self._text.append(text)
        if self._link:
            self._linked += len(text) - text.count(" ")

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text.clear()
            self._linked = 0

    def _pop(self, depth: int) -> None:
        self._flush()
        while len(self._stack) > depth:
            node = self._stack.pop()
            self._open[self.tags[node]] -= 1
            self.last[node] = len(self.tags) - 1

    def _start(self, name: str, raw: str) -> None:
        if name == "br":
            self._text.append(" ")
        elif name == "a":
            self._link = True
        elif name in BLOCK:
            self._flush()
            self._link = False
            if self.tags[self._stack[-1]] == "p":
                self._pop(len(self._stack) - 1)
            while self.tags[self._stack[-1]] in _ENDS.get(name, ()):
                self._pop(len(self._stack) - 1)
            if name not in VOID:
                self._push(name, raw)

    def _push(self, name: str, raw: str) -> None:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}
        names = given.get("class", "").split() or [x for x in (given.get("id", ""),) if x]
        every = [*given.get("class", "").split(), *given.get("id", "").split()]
        words = {w.lower() for x in every if not x.lower().startswith(("has-", "with-", "no-", "is-")) for w in _NAME.findall(x)}
        kept = given.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in kept or "visibility:hidden" in kept
        inside = self._open["article"] or self._open["main"]
        tag = name in ASIDE and not (name == "header" and inside) or given.get("role", "").lower() in ROLES or hidden
        marks = MARKS - {"header"} if inside else MARKS
        comment = bool(words & COMMENTS)
        self.tags.append(name)
        self.parents.append(self._stack[-1])
        self.last.append(len(self.tags) - 1)
        self.steps.append(".".join([name, *sorted({_ODD.sub("", _NUMBER.sub("#", x.lower())) for x in names})]))
        self.aside.append(tag)
        self.named.append(bool(words & marks) and name not in ("html", "body", "main", "article"))
        self.comment.append(comment and name not in ("html", "body", "main"))
        self._stack.append(len(self.tags) - 1)
        self._open[name] += 1

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = False
        elif name in BLOCK:
            self._flush()
            if self._open[name] > 0:
                depth = len(self._stack) - 1
                while self.tags[self._stack[depth]] != name:
                    depth -= 1
                self._pop(depth)
            self._link = False

    def _settle(self) -> None:
        """The deepest node that is not the article's, at or above each node (0 if
        none).  A name alone does not mark what an article stands in.  On a page
        without an article element, names and forms mark nothing if nearly all
        text would go by them."""
        holds = [t in ("article", "main") for t in self.tags]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i]:
                holds[self.parents[i]] = True
        self.out = self._outside(lambda i: (self.aside[i] or self.named[i]) and not (holds[i] and (self.named[i] or self.tags[i] in ("form", "header"))))
        if not holds[0]:
            loose = self._outside(lambda i: self.aside[i] and self.tags[i] != "form")
            if sum(self.masses(self.out)) * 5 < sum(self.masses(loose)):
                self.out = loose

    def _outside(self, marked: Callable[[int], bool]) -> list[int]:
        out = [0] * len(self.tags)
        for i in range(1, len(out)):
            out[i] = i if self.comment[i] or marked(i) else out[self.parents[i]]
        return out

    def masses(self, out: list[int]) -> list[int]:
        """Letters of each node's own blocks, less those in links twice."""
        mass = [0] * len(self.tags)
        for node, text, linked in self.blocks:
            if out[node] == 0:
                mass[node] += max(0, len(text) - 2 * linked)
        return mass

    def best(self) -> int:
        """The deepest container with three quarters of the text outside links,
        or the article or main element that it stands in; -1 without text."""
        mass = self.masses(self.out)
        for i in range(len(mass) - 1, 0, -1):
            mass[self.parents[i]] += mass[i]
        if not mass[0]:
            return -1
        # those with most of the text stand in each other, so that the last is the deepest
        top = max(i for i, m in enumerate(mass) if 4 * m >= 3 * mass[0] and (i == 0 or self.tags[i] in CONTAINERS))
        for tag in ("article", "main"):
            node = top
            while node > 0:
                if self.tags[node] == tag:
                    return node
                node = self.parents[node]
        return top

    def path(self, node: int) -> str:
        """The steps from the top to a node."""
        steps = []
        while node > 0:
            steps.append(self.steps[node])
            node = self.parents[node]
        return ">".join(reversed(steps))

    def find(self, root: dict) -> dict[int, list[int]]:
        """Nodes by rank of their path, of those in a tree of steps."""
        out: dict[int, list[int]] = {}
        at: list[dict | None] = [root] + [None] * (len(self.tags) - 1)
        for i in range(len(self.tags)):
            if i:
                above = at[self.parents[i]]
                at[i] = None if above is None else above.get(self.steps[i])
            if at[i] is not None and "" in at[i]:
                out.setdefault(at[i][""], []).append(i)
        return out

    def text(self, nodes: list[int]) -> str:
        """The blocks inside any of ``nodes`` (ascending) that are the article's."""
        out, k, reach, top = [], 0, -1, 0
        for node, text, _ in self.blocks:
            while k < len(nodes) and nodes[k] <= node:
                if nodes[k] > reach:  # else inside the one before
                    reach, top = self.last[nodes[k]], nodes[k]
                k += 1
            if top <= node <= reach and self.out[node] <= top:
                out.append(text)
        return "\n".join(out)
