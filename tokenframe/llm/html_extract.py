"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Method: a page becomes a tree of block elements and text blocks. Boosted trees give every node the odds that
main text lies in it, from tag and attribute words (its own and its ancestors'), subtree density, depth and
sibling statistics. Decoding picks the labelling with the highest total odds among those in which a node is
kept only if its parent is, so an ancestor and a descendant never contradict each other.

No table has labelled pages, so the trees are fitted in numpy on PAGES pages that a seeded generator writes
in many layouts, with semantic tags or with classes only. They depend on no table: forest.json has them as
`python -m tokenframe.llm.html_extract` fits them, with a digest of the generator's pages that tests compare.

Scripts, styles, titles, templates, frames' fallbacks and the descriptions in drawings and formulas are never shown
and give no text. All else goes to the trees: formulas, drawings' texts, fallbacks of objects and scripts, form fields.

Null and empty pages, and pages without main text, give the empty string. Truncated tags are dropped,
unclosed elements end where HTML ends them, and an unclosed list of options before the next block. Null page_ids and
urls are kept; repeated rows stay; an empty table gives no rows; columns other than page_id, url and html, whatever
their names, are ignored. Very long pages are read whole. Ties don't occur.
"""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .dom import FEATURES, Page

PAGES, TREES, DEPTH, RATE, BINS = 900, 60, 4, 0.3, 32
#: Nodes whose features a worker holds at a time, about.
NODES = 60_000
EXTRACTED = "page_id long, url string, text string, n_chars long"


@dataclass
class Forest:
    """Complete binary trees: inner nodes have a feature and a limit (go right above it), leaves a value."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, l, v in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > l[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Forest:
    """Second-order boosting of the logistic loss over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    inner = 2**DEPTH - 1
    features, limits, values = [], [], []
    p = float(np.clip(y.mean(), 0.01, 0.99))
    base = np.log(p / (1 - p))
    odds = np.full(len(y), base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-odds))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-3)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * BINS + binned[:, j]
                g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < 2) | (ht - h < 2)] = 0
                cut = gain[:, : len(e)].argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                limit[first : first + width][better] = e[cut[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        odds += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Forest(np.stack(features), np.stack(limits), np.stack(values), float(base))


# -- pages to learn from


def _words(r: random.Random, least: int, most: int) -> str:
    out = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(1, 10))) for _ in range(r.randint(least, most))]
    out[0] = out[0].capitalize()
    return " ".join(w + (r.choice(",...!?") if r.random() < 0.1 else "") for w in out)


def _article(r: random.Random) -> list[str]:
    """Blocks of main text, marked as such."""
    out = [f'<h1 data-y="1">{_words(r, 1, 9)}</h1>'] if r.random() < 0.8 else []
    for _ in range(r.choice((0, 1, 1, 2, 4, 8, 15)) or (not out)):
        kind, short = r.random(), r.random() < 0.2
        if kind < 0.75:
            text = _words(r, 1, 4) if short else _words(r, 5, 120)
            if r.random() < 0.05:
                text += r.choice((" <math><mi>{0}</mi><mo>=</mo><mn>5</mn></math> {1}", " <svg><path d='M0 0'/><text>{0}</text></svg> {1}")).format(_words(r, 1, 1), _words(r, 1, 9))
            if r.random() < 0.2:
                text += f' <a href="/x">{_words(r, 1, 3)}</a> {_words(r, 1, 20)}'
            out.append(f'<p data-y="1">{"<b>" if r.random() < 0.15 else ""}{text}{"<br>" if r.random() < 0.1 else ""}{"</p>" if r.random() < 0.8 else ""}')
        elif kind < 0.85:
            out.append(f'<h2 data-y="1">{_words(r, 1, 6)}</h2>')
        elif kind < 0.87:
            out.append(r.choice(('<noscript data-y="1"><p>{}</p></noscript>', '<object data-y="1"><p>{}</p></object>', '<div data-y="1"><xmp>{}</xmp></div>')).format(_words(r, 4, 30)))
        elif kind < 0.92:
            out.append('<ul data-y="1">' + "".join(f"<li>{_words(r, 1, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.96:
            out.append(f'<blockquote data-y="1"><p>{_words(r, 5, 40)}</p></blockquote>')
        else:
            out.append('<table data-y="1">' + "".join(f"<tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
    return out


def _links(r: random.Random, least: int, most: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(r.randint(least, most))) + "</ul>"


def _field(r: random.Random) -> str:
    return r.choice(("", "", "<textarea>" + _words(r, 1, 6) + "</textarea>", "<select>" + "".join(f"<option>{_words(r, 1, 2)}" for _ in range(r.randint(2, 5))) + "</select>"))


def _other(r: random.Random, kind: str) -> str:
    """Markup around the main text, marked as not it."""
    tag, name = {
        "nav": (("nav", "div", "ul"), ("", "menu", "nav", "navbar top-nav", "breadcrumb")), "header": (("header", "div"), ("", "header", "masthead", "site-header")), "ad": (("div", "aside", "section"), ("ad", "ads", "advert box", "sponsored", "promo-banner")),
        "sidebar": (("aside", "div"), ("sidebar", "right rail", "side-column")), "footer": (("footer", "div"), ("footer", "site-footer", "copyright", "bottom")), "comments": (("section", "div", "ol"), ("comments", "comment-list", "reader-comments", "discussion replies")),
        "notice": (("div", "section"), ("cookie-notice", "notice", "alert", "consent popup")), "form": (("form", "div"), ("newsletter", "search-form", "signup", "login")), "related": (("div", "section", "aside"), ("related", "recommended", "more-stories")), "share": (("div", "ul"), ("share", "social-links")),
    }[kind]
    tag, name = r.choice(tag), r.choice(name)
    if tag in ("div", "ul", "ol", "section") and not name:
        name = kind
    if tag in ("nav", "footer", "header", "aside", "form") and r.random() < 0.5:
        name = ""
    if kind in ("ad", "comments") and not name:
        name = kind
    inner = {
        "nav": lambda: _links(r, 2, 9), "header": lambda: r.choice((f"<p>{_words(r, 1, 6)}</p>", f"<h2>{_words(r, 1, 4)}</h2>" + _links(r, 2, 6), f'<a href="/">{_words(r, 1, 3)}</a>')), "ad": lambda: r.choice((_words(r, 2, 20), f"<p>{_words(r, 3, 30)}</p>", f'<a href="/ad">{_words(r, 2, 9)}</a>')),
        "sidebar": lambda: f"<h3>{_words(r, 1, 3)}</h3>" + r.choice((_links(r, 2, 7), f"<p>{_words(r, 5, 50)}</p>")), "footer": lambda: r.choice((f"&copy; {_words(r, 1, 12)}", f"<p>&copy; {_words(r, 2, 20)}</p>", _links(r, 2, 5) + f"<p>{_words(r, 3, 20)}</p>")),
        "comments": lambda: f"<h3>{_words(r, 1, 2)}</h3>" + "".join(f'<div class="{r.choice(("comment", "reply", "c-item"))}"><p>{_words(r, 1, 3)}</p><p>{_words(r, 3, 80)}</p></div>' for _ in range(r.randint(1, 6))), "notice": lambda: f"<p>{_words(r, 5, 30)}</p><button>{_words(r, 1, 2)}</button>",
        "form": lambda: f"<label>{_words(r, 1, 4)}</label><input name=q><button>{_words(r, 1, 2)}</button><p>{_words(r, 2, 12)}</p>" + _field(r), "related": lambda: f"<h3>{_words(r, 1, 3)}</h3>" + r.choice((_links(r, 2, 6), "".join(f'<p><a href="/r">{_words(r, 3, 12)}</a></p>' for _ in range(3)))), "share": lambda: _links(r, 2, 5),
    }[kind]()
    attribute = f' {r.choice(("class", "id"))}="{name}"' if name else ""
    return f'<{tag}{attribute} data-y="0">{inner}</{tag}>'


def written_page(r: random.Random) -> str:
    """A page in a random layout whose elements say by data-y whether main text lies in them."""
    blocks = _article(r)
    for kind in ("ad", "share", "related", "form"):
        if r.random() < 0.15:
            blocks.insert(r.randint(0, len(blocks)), _other(r, kind))
    if r.random() < 0.12:
        blocks.append(_other(r, "comments"))
    tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("div", "article-text"), ("section", "story"), ("td", "main"), ("", "")))
    attribute = f' {r.choice(("class", "id"))}="{name}"' if name else ""
    body = "".join(blocks)
    if tag == "article" and blocks[0].startswith("<h1") and r.random() < 0.2:
        body = f'<header data-y="1">{blocks[0]}</header>' + "".join(blocks[1:])
    body = f'<table data-y="1"><tr data-y="1"><td{attribute} data-y="1">{body}</td></tr></table>' if tag == "td" else f'<{tag}{attribute} data-y="1">{body}</{tag}>' if tag else body
    if r.random() < 0.3:
        body = f'<div class="{r.choice(("container", "wrap", "page", "row", "layout"))}" data-y="1">' + body + (_other(r, "sidebar") if r.random() < 0.6 else "") + "</div>"
    head = [_other(r, k) for k, p in (("notice", 0.15), ("header", 0.4), ("nav", 0.7), ("form", 0.1), ("ad", 0.4)) if r.random() < p]
    tail = [_other(r, k) for k, p in (("related", 0.15), ("comments", 0.3), ("sidebar", 0.2), ("ad", 0.2), ("form", 0.1), ("footer", 0.75), ("notice", 0.08)) if r.random() < p]
    return f'<!DOCTYPE html><html><head><title>{_words(r, 1, 5)}</title></head><body data-y="1">' + "".join(head) + body + "".join(tail) + "</body></html>"


MODEL = Path(__file__).with_name("forest.json")


def written_pages(pages: int = PAGES, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    return [written_page(r) for _ in range(pages)]


def digest(pages: list[str]) -> str:
    return hashlib.sha256("\0".join([str(FEATURES), str(TREES), *pages]).encode()).hexdigest()


def fit(pages: list[str] | None = None) -> Forest:
    """The trees, fitted to generated pages."""
    read = [Page(p) for p in (written_pages() if pages is None else pages)]
    return boost(np.concatenate([p.features()[1:] for p in read]), np.concatenate([p.label[1:] for p in read]).astype(np.float64))


def save() -> None:
    """Fit the trees and write them to forest.json."""
    pages = written_pages()
    f = fit(pages)
    MODEL.write_text(json.dumps({"pages": digest(pages), "base": f.base, "feature": f.feature.tolist(), "limit": [[None if np.isinf(x) else float(x) for x in t] for t in f.limit], "value": [[float(f"{x:.9g}") for x in t] for t in f.value]}))


@lru_cache(maxsize=1)
def forest() -> Forest:
    """The fitted trees of forest.json."""
    x = json.loads(MODEL.read_text())
    return Forest(np.array(x["feature"]), np.array([[np.inf if v is None else v for v in t] for t in x["limit"]], np.float32), np.array(x["value"]), x["base"])


def extract(forest: Forest, sources: list[str | None]) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    waiting: list[Page] = []

    def decode() -> None:
        if waiting:
            odds = forest.odds(np.concatenate([p.features() for p in waiting]))
            at = 0
            for p in waiting:
                out.append(p.decoded(odds[at : at + len(p.parent)]))
                at += len(p.parent)
            waiting.clear()

    held = 0
    for source in sources:
        waiting.append(Page(source or ""))
        held += len(waiting[-1].parent)
        if held > NODES:
            decode()
            held = 0
    decode()
    return out


def main_text(pages: DataFrame, own: Forest | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    sent = ship(pages.sparkSession).sparkContext.broadcast(own or forest())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract(sent.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, EXTRACTED)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    save()
