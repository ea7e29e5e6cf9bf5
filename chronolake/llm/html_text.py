"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks.  A block's features are its words and link
density, those of its neighbours, the share of the page's prose that stands in its
container, what kind of element it is, and, as further evidence, its region and how
far class names hint at boilerplate.  A decision tree (CART, Gini) trained on the
blocks of some labelled pages (`html_pages`) decides; blocks that it calls content
are joined.

Defined results: null or empty html gives an empty text; markup that is cut off
ends the page; character references are decoded, those cut off stay as they are;
rows are returned one for one, repeated rows too; pages of any length are read
whole; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolake.llm import html_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W_]\S*")  # what holds a letter or a digit
_NAME = re.compile(r"[a-z0-9]+")

# Element, role and class names of HTML.
RAW = frozenset("script style title textarea iframe".split())  # their content is no markup
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section select datalist summary table tbody td template tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre li dd dt td th caption figcaption summary blockquote h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("article aside blockquote body datalist details dialog div dl fieldset figure footer form header head main menu nav noscript ol search section select span table template tr ul".split()) | PROSE
OUTSIDE = frozenset("nav footer aside head dialog menu search select datalist template noscript".split())  # never the article, whatever is inside
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad adv advert advertisement advertising sponsor sponsored promo promotion banner cookie consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb footer masthead topbar related "
    "recommended recommendation share sharing social pagination pager widget toolbar search skip hidden paywall rail".split()
)
READERS = frozenset("comment commentlist disqus discussion reply replies respond response".split())
PLAIN = frozenset(
    "area bar block bottom box button center col column container content group inner item left link list main module outer page panel post right row "
    "section site slot story title top unit wrap wrapper".split()
)

PLAIN_REGION, ARTICLE, BOILERPLATE = 0, 1, 2


def hint(value: str, in_article: bool) -> int:
    """How far class names or an id hint at boilerplate: 3 readers' comments, 2 a name of such words alone, 1 such a word beside others, 0 none."""
    level = 0
    for name in value.lower().split():
        parts = [w[:-1] if w.endswith("s") and w[:-1] in HINTS | READERS | PLAIN else w for w in _NAME.findall(name)]
        told = [w for w in parts if w in HINTS or w in READERS or w == "header" and not in_article]
        if told:
            alone = all(w in told or w in PLAIN or w.isdigit() for w in parts)
            level = max(level, 1 if not alone else 3 if READERS.intersection(told) else 2)
    return level


def _region(name: str, attrs: str, now: tuple[int, bool]) -> tuple[tuple[int, bool], int]:
    """((region, whether for good), hint) inside an element that opens in region `now`."""
    region, fixed = now
    told = 0
    if name in OUTSIDE or name == "header" and region != ARTICLE:
        region, fixed = BOILERPLATE, True
    elif name in ("form", "fieldset"):
        region = BOILERPLATE  # some sites put the whole page into a form: an article inside is one
    elif name in ("article", "main") and not fixed:
        region = ARTICLE
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and name not in ("body", "html"):
                told = max(told, hint(value, region == ARTICLE))
            elif key.startswith("data-") and value.lower() not in ("false", "0"):
                told = max(told, hint(key[5:], True))
            elif key == "role" and value.lower() in ROLES:
                region, fixed = BOILERPLATE, True
            elif key == "role" and value.lower() in ("main", "article") and not fixed:
                region = ARTICLE
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                region, fixed = BOILERPLATE, True
    return (region, fixed), told


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words in links
    region: int
    hint: int
    kind: int  # 0 bare text, 1 a paragraph, list item, cell, ..., 2 a heading
    container: int


def blocks(page: str) -> list[Block]:
    """The flat text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, bool], int, int, int]] = [("", (PLAIN_REGION, False), 0, 0, 0)]  # name, region, hint, kind, container
    parts: list[tuple[str, bool]] = []
    at, link, made = 0, 0, 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            words = len(_WORD.findall(text))
            linked = sum(len(_WORD.findall(t)) for t, a in parts if a)
            _, region, told, kind, container = stack[-1]
            out.append(Block(text, words, min(linked, words), region[0], told, kind, container))
        parts.clear()

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((html.unescape(page[at:]), bool(link)))
            break
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), bool(link)))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, close, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK:
            flush()
        if name in RAW and not close and not attrs.endswith("/"):
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if name == "a":
            link = 0 if close else 1
            continue
        if name not in KEPT:
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    flush()
                    del stack[i:]
                    break
        elif not attrs.endswith("/"):
            if name in BLOCK:
                link = 0
                if stack[-1][0] == "p" or stack[-1][0] in HEADING and name in HEADING:
                    stack.pop()
            _, region, told, kind, container = stack[-1]
            inside, own = _region(name, attrs, region)
            if inside != region or own > told:
                flush()
            if name not in PROSE and name in BLOCK:
                made += 1
                container = made
                kind = 0
            elif name in PROSE:
                kind = 2 if name in HEADING else 1
            stack.append((name, inside, max(told, own), kind, container))
    flush()
    return out


# ------------------------------------------------------------ decision tree

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "weight", "prose", "kind", "region", "hint", "place",
)


def features(found: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block.

    weight: unlinked words in the block's container, against the heaviest container of the page; prose: share of the
    page's unlinked words, without boilerplate regions, that stand in paragraphs and the like; place: 2 in the
    article, 1 on a page without one, 0 outside it.
    """
    has = any(b.region == ARTICLE and b.words for b in found)
    dens = [(b.words, b.linked / b.words if b.words else 0.0) for b in found]
    heavy: dict[int, int] = {}
    prose = rest = 0
    for b in found:
        free = b.words - b.linked
        heavy[b.container] = heavy.get(b.container, 0) + free
        if b.region != BOILERPLATE:
            prose, rest = prose + free * (b.kind == 1), rest + free * (b.kind == 0)
    most = max(1, max(heavy.values(), default=1))
    share = prose / max(1, prose + rest)
    edge = (0, 0.0)
    rows = []
    for i, b in enumerate(found):
        before, after = dens[i - 1] if i else edge, dens[i + 1] if i + 1 < len(found) else edge
        place = 2 if b.region == ARTICLE else 0 if has else 1
        rows.append((*dens[i], *before, *after, heavy[b.container] / most, share, b.kind, b.region, b.hint, place))
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, leaf: int = 2) -> tuple:
    """A tree as nested tuples: (label,) or (feature, cut, at most the cut, above it)."""
    if depth == 0 or y.min() == y.max():
        return (int(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(n[at] >= leaf) & (len(y) - n[at] >= leaf)]
        if not len(at):
            continue
        low, high = n[at], len(y) - n[at]
        a, b = up[at], up[-1] - up[at]
        gini = 2 * a * (low - a) / low + 2 * b * (high - b) / high
        k = int(np.argmin(gini))
        if best is None or gini[k] < best[0] - 1e-12:
            best = (gini[k], f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf))


def examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of labelled pages: a block's text begins with + (content) or - (boilerplate)."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        bare = [b._replace(text=b.text[1:]) for b in found]
        x += features(bare)
        y += [int(b.text[0] == "+") for b in found]
    return np.array(x, float), np.array(y)


@functools.cache
def tree() -> tuple:
    return grow(*examples(html_pages.labelled()))


def decide(node: tuple, row: tuple) -> int:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


def main_text(page: str | None, t: tuple | None = None) -> str:
    if not page:
        return ""
    found = blocks(page)
    t = t or tree()
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if decide(t, row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`."""

    grown = tree()  # on the driver, once

    def each(batches):
        for batch in batches:
            texts = [main_text(p, grown) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {kind}, url string, text string, n_chars long")
