"""A forgiving HTML reader: pages to trees of block elements and text blocks, with node features."""

from __future__ import annotations

import html
import re

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
_LABEL = re.compile(r"data-y=\"([01])\"")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.!?;:,]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and is never shown; a template's is markup that isn't shown.
RAW = frozenset("script style title iframe noembed noframes template".split())
#: Elements whose content is shown as it is written: the first as typed, the second with references decoded.
PLAIN = {"xmp": False, "textarea": True}
FOREIGN, UNSHOWN = frozenset(("svg", "math")), frozenset("title desc metadata annotation annotation-xml style script".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img map picture source svg math".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_SIBLINGS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _SIBLINGS.items()}

#: Groups of tags and of attribute words; each is a bit of a node's mask.
TAGS = ["article main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu dir", "li dt dd", "nav", "header", "footer address", "aside", "form fieldset select optgroup option textarea", "table tbody thead tfoot tr", "td th caption", "blockquote pre", "figure figcaption", "button legend dialog details summary", "#text", "body html", "head", "noscript object", "xmp"]
TOKENS = [
    "article articles post entry story news blog", "content contents maincontent text body copy prose main", "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs", "sidebar side aside rail column complementary", "footer foot bottom copyright legal colophon contentinfo",
    "header head masthead banner top topbar logo branding", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense", "comment comments commentlist disqus reply replies respond discussion reader readers", "cookie cookies consent notice notices alert gdpr popup modal overlay warning message", "share sharing social follow facebook twitter",
    "related recommend recommended recommendations more popular trending also", "form newsletter subscribe subscription signup login search contact input", "widget widgets tag tags meta byline author date category categories", "hidden skip print sr offscreen",
]
_TAG_BIT = {t: 1 << i for i, group in enumerate(TAGS) for t in group.split()}
_TOKEN_BIT = {t: 1 << (len(TAGS) + i) for i, group in enumerate(TOKENS) for t in group.split()}
BITS = len(TAGS) + len(TOKENS)
NUMBERS = 16
FEATURES = 2 * BITS + NUMBERS
_masks: dict[str, int] = {}


def _mask(attributes: str) -> int:
    """The bits of the words in an element's class, id and role."""
    known = _masks.get(attributes)
    if known is None:
        known = 0
        for value in _ATTRIBUTE.findall(attributes):
            for word in _WORDS.findall(value):
                known |= _TOKEN_BIT.get(word.lower(), 0)
        if len(_masks) > 20_000:
            _masks.clear()
        _masks[attributes] = known
    return known


class Page:
    """Nodes in page order: `parent`, `mask`, own text and link lengths; `text` is None but for text blocks."""

    def __init__(self, source: str):
        self.parent, self.mask, self.text, self.links, self.label = [-1], [_TAG_BIT["html"]], [None], [0], [1]
        self._read(source)

    def _node(self, parent: int, mask: int, label: int, text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.mask.append(mask)
        self.text.append(text)
        self.links.append(links)
        self.label.append(label)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # tag and its nearest block node
        open_tags: dict[str, int] = {"html": 1}
        pieces: list[str] = []
        linked = [0]
        at, n = 0, len(source)

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    owner = stack[-1][1]
                    self._node(owner, _TAG_BIT["#text"], self.label[owner], text, min(linked[0], len(text)))
                pieces.clear()
                linked[0] = 0

        def say(raw: str) -> None:
            if raw:
                data = html.unescape(raw) if "&" in raw else raw
                pieces.append(data)
                if open_tags.get("a"):
                    linked[0] += len(data)

        def pop_to(depth: int) -> None:
            if any(tag not in INLINE and (tag in _TAG_BIT or "-" in tag) for tag, _ in stack[depth:]):
                flush()
            for tag, _ in stack[depth:]:
                open_tags[tag] -= 1
            del stack[depth:]

        def find(tags, stop) -> int:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in tags:
                    return depth
                if stack[depth][0] in stop:
                    break
            return 0

        nowhere = frozenset()
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                if name == "br":
                    pieces.append(" ")
                elif open_tags.get(name) and name not in ("html", "body"):
                    pop_to(find((name,), nowhere) or len(stack))
                elif name == "p":
                    flush()
                continue
            foreign = any(open_tags.get(f) for f in FOREIGN)
            if (foreign or name in FOREIGN) and attributes.endswith("/") and not _UNQUOTED.search(attributes):
                continue  # only in these may a tag close itself
            if name in RAW or name in PLAIN or foreign and name in UNSHOWN:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                inner, close = source[at : end.start() if end else n], source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else n
                if name in PLAIN:
                    flush()
                    owner = stack[-1][1]
                    node = self._node(owner, _TAG_BIT[name] | (_mask(attributes) if attributes else 0), self.label[owner])
                    stack.append((name, node))
                    pieces.append(html.unescape(inner) if PLAIN[name] and "&" in inner else inner)
                    flush()
                    stack.pop()
                continue
            if name in VOID:
                if name == "br" or name in INLINE:
                    pieces.append(" " if name == "br" else "")
                elif name == "hr":
                    flush()
                continue
            if name in INLINE or (name not in _TAG_BIT and "-" not in name):
                if name == "a" and open_tags.get("a"):
                    pop_to(find(("a",), nowhere) or len(stack))
                stack.append((name, stack[-1][1]))
                open_tags[name] = open_tags.get(name, 0) + 1
                continue
            flush()
            if name in CLOSES_P and open_tags.get("select") and (depth := find(("select",), nowhere)):
                pop_to(depth)  # blocks can't be in a list of options: it wasn't closed
            if name in ("html", "body") and open_tags.get(name):
                continue
            if name in CLOSES_P and open_tags.get("p") and (depth := find(("p",), ("button", "td", "th", "caption", "table", "object"))):
                pop_to(depth)
            if name == "body" and open_tags.get("head"):
                pop_to(find(("head",), nowhere) or len(stack))
            if name in _SIBLINGS and (depth := find(*_SIBLINGS[name])):
                while depth and stack[depth - 1][0] in _SIBLINGS[name][0]:
                    depth -= 1
                pop_to(depth)
            owner = stack[-1][1]
            label = _LABEL.search(attributes) if "data-y" in attributes else None
            node = self._node(owner, _TAG_BIT.get(name, _TAG_BIT["div"]) | (_mask(attributes) if attributes else 0), int(label[1]) if label else self.label[owner])
            stack.append((name, node))
            open_tags[name] = open_tags.get(name, 0) + 1
        flush()

    def features(self) -> np.ndarray:
        """One row per node: own and ancestors' bits, subtree density, depth and sibling statistics."""
        n = len(self.parent)
        parent = self.parent
        chars, links, marks, blocks, nodes, kids, depth, above, paragraphs = ([0] * n for _ in range(9))
        index, before = [0] * n, [0] * n
        p_bit = _TAG_BIT["p"]
        for i in range(n):
            up = parent[i]
            if up >= 0:
                depth[i], above[i] = depth[up] + 1, above[up] | self.mask[up]
                index[i] = kids[up]
                kids[up] += 1
            if self.text[i] is not None:
                chars[i], links[i], marks[i], blocks[i] = len(self.text[i]), self.links[i], len(_PUNCTUATION.findall(self.text[i])), 1
        seen = 0
        for i in range(n):
            before[i] = seen
            seen += chars[i]
        for i in range(n - 1, 0, -1):
            up = parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            marks[up] += marks[i]
            blocks[up] += blocks[i]
            nodes[up] += nodes[i] + 1
            paragraphs[up] += self.mask[i] & p_bit > 0
        c, k, m, b, t, q, d = (np.array(x, np.float32) for x in (chars, links, marks, blocks, nodes, kids, depth))
        up = np.maximum(np.array(parent), 0)
        page = max(1, chars[0])
        sibling_mean = (c[up] - c) / np.maximum(1, q[up] - 1)
        out = np.empty((n, FEATURES), np.float32)
        own, over = np.array(self.mask, np.int64), np.array(above, np.int64)
        bits = np.arange(BITS)
        out[:, :BITS] = own[:, None] >> bits & 1
        out[:, BITS : 2 * BITS] = over[:, None] >> bits & 1
        numbers = (np.log1p(c), k / np.maximum(1, c), 10 * m / np.maximum(1, c), c / page, np.log1p(c / np.maximum(1, t + 1)), np.log1p(b), d, np.array(index, np.float32) / np.maximum(1, q[up]), np.log1p(q[up]), np.log1p(sibling_mean), np.log1p(c[up]), k[up] / np.maximum(1, c[up]), c / np.maximum(1, c[up]), np.array(before, np.float32) / page, np.array(paragraphs, np.float32), np.log1p(q))
        for j, x in enumerate(numbers):
            out[:, 2 * BITS + j] = x
        return out

    def decoded(self, odds: np.ndarray) -> str:
        """The text of the best labelling in which nothing below a rejected node is kept."""
        n = len(self.parent)
        keep, drop = odds.tolist(), [-x for x in odds.tolist()]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
        kept, out = [True] * n, []
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i]
            if kept[i] and self.text[i] is not None:
                out.append(self.text[i])
        return "\n\n".join(out)
