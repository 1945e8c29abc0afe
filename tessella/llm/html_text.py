"""Main text of web pages from flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those of
its neighbours on both sides, the kind of its element, its place in or beside an article, and how
strongly what encloses it is named as a menu, header, footer, sidebar, notice, advert, form or
comment: a share between 0 and 1, not a verdict (name_strength()). A decision tree, grown on a small
labelled table, tells main text. The table is made of the blocks of a few labelled pages of
several makes (labelled_pages()), written so that no feature alone decides: long and short paragraphs,
link lists without a name, paragraphs whose class only sounds like a header, adverts and comments
of the length of paragraphs. Kept blocks are joined in page order by one space, their own white
space turned into one space.

Scripts, styles, form fields and what is marked as hidden are no blocks. The page is read once from
front to end, also where markup is broken: a tag whose quotes are never closed ends at the next
bracket, and quotes are not minded any more after it.

Every page is one row's work: no shuffle. Null and empty pages, and pages without main text,
give an empty text; repeated rows and null ids are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import field, slices, text_of

#: A tag with its attributes; quotes count after an equals sign only. What is matched is never given back, so a tag is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|[\"'=])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Their content is never text of the page.
UNSEEN = {"script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "svg", "object", "canvas", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo mrow ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded semantics".split()
)
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
#: They hold the article, so what encloses them says nothing, and their names speak of the whole page.
WHOLE = {"html", "body", "main"}
#: Parts of names of boilerplate; parts of names that tell of the place or number of anything; the other parts speak for text.
BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside rail widget related recommended"
    " share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond disqus discussion skip pagination pager toc".split()
)
PLACE_NAMES = set("site page main global top left right upper lower primary secondary inner outer wrap wrapper container box block area section region panel bar list item items row col column group unit slot zone links link body holder card module set first last thread".split())
PARAGRAPHS = {"p": 2, "pre": 2, "blockquote": 2, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 3, "td": 4, "th": 4, "dd": 4, "dt": 4}


def name_strength(attributes: str, whole_names: bool = False) -> float:
    """How far a class, id or role names boilerplate: of its parts that tell anything, the share in BOILER_NAMES; the strongest name counts.

    whole_names: parts are not looked at, as the names of an article tell what it has.
    """
    most = 0.0
    for a, b, c in NAMED.findall(attributes):
        for name in (a or b or c).lower().split():
            parts = [name] if whole_names else [p for p in re.split(r"[_\-:;.\d]+", name) if p and p not in PLACE_NAMES]
            if parts:
                most = max(most, sum(p in BOILER_NAMES for p in parts) / len(parts))
    return most


class Block:
    __slots__ = ("article", "kind", "linked", "main", "named", "text", "words")

    def __init__(self, text: str, linked: int, kind: int, named: float, article: bool, main: bool):
        self.text, self.linked, self.kind, self.named, self.article, self.main = text, linked, kind, named, article, main
        self.words = text.count(" ") + 1


#: What is not inside anything: tag, kind, strength of names, in an article, in main, hidden, links that were open before.
OUTSIDE = ("", 0, 0.0, False, False, False, 0)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack, opened = [OUTSIDE], Counter()
    parts: list[str] = []
    linked = links = at = 0
    tags, last = TAG, page.rfind(">")

    def close() -> None:
        nonlocal linked
        if parts:
            _, kind, named, article, main, hidden, _ = stack[-1]
            if not hidden and (text := " ".join("".join(parts).split())):
                out.append(Block(text, linked, kind, named, article, main))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text := html.unescape(text) if "&" in text else text)
            if links:
                linked += len(text.split())

    def leave(k: int) -> None:
        """Close all elements from place k of the stack on."""
        nonlocal links
        links = min(links, stack[k][6])
        for e in stack[k:]:
            opened[e[0]] -= 1
        del stack[k:]

    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        if follows in ("!", "?"):
            add(page[at:start])
            stop = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            at = stop + 1 if stop > 1 else len(page)
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/" and page[start + 2 : start + 3].isalpha()):
            add(page[at : start + 1])  # a bracket that opens nothing
            at = start + 1
            continue
        add(page[at:start])
        if start > last:
            at = len(page)  # a tag that the page's end cuts off
            break
        m = tags.match(page, start)
        if m is None:
            tags = PLAIN_TAG
            m = tags.match(page, start)
        if m is None:
            at = start + 2
            continue
        at, end, tag, attributes = m.end(), bool(m[1]), m[2].lower(), m[3]
        if tag == "a":
            links = max(0, links - 1) if end else links + 1
        if tag in INLINE:
            continue
        close()
        if end:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
        elif tag in UNSEEN:
            if tag == "svg" and attributes.endswith("/"):
                continue  # closed by itself
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            stop = page.find(">", stop.end()) if stop else -1
            at = stop + 1 if stop >= 0 else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in ("p", "li") and stack[-1][0] == tag:
                leave(len(stack) - 1)
            _, _, named, article, main, hidden, _ = stack[-1]
            strength = 0.0 if tag in WHOLE else 1.0 if tag in BOILER or tag == "header" and not article else name_strength(attributes, tag == "article")
            opened[tag] += 1
            stack.append((tag, PARAGRAPHS.get(tag, 0), 0.0 if tag in WHOLE else max(named, strength), article or tag == "article", main or tag == "main", hidden or bool(HIDDEN.search(attributes)), links))
    add(page[at:])
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "most_words_near", "kind", "named", "place")


def features(found: list[Block]) -> np.ndarray:
    """A row per block, by FEATURES; neighbours beyond the ends have no words.

    most_words_near: unlinked words of the longest of the two blocks on each side. place: 2 in the article (or in main, where no article is), 1 beside
    it, 0 on a page with neither.
    """
    n = len(found)
    words = np.array([0, 0, *(b.words for b in found), 0, 0], float)
    linked = np.array([0, 0, *(b.linked for b in found), 0, 0], float)
    density, unlinked = linked / np.maximum(words, 1), words - linked
    near = np.max([unlinked[:n], unlinked[1 : n + 1], unlinked[3 : n + 3], unlinked[4 : n + 4]], axis=0)
    article = np.array([b.article for b in found], bool)
    inside = article if article.any() else np.array([b.main for b in found], bool)
    place = np.where(inside, 2.0, 1.0) if inside.any() else np.zeros(n)
    kind, named = np.array([b.kind for b in found], float), np.array([b.named for b in found], float)
    w, d = words[2 : n + 2], density[2 : n + 2]
    return np.column_stack([w, d, words[1 : n + 1], density[1 : n + 1], words[3 : n + 3], density[3 : n + 3], near, kind, named, place])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 5) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, low side, high side), or (label,); leaves have `least` rows or more."""
    if depth == 0 or len(set(y)) == 1 or len(y) < 2 * least:
        return (int(2 * y.sum() > len(y)),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if not least <= low.sum() <= len(y) - least:
                continue
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t, low)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return (int(2 * y.sum() > len(y)),)
    _, f, t, low = best
    return (f, float(t), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def labels(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = labels(tree[2], x[low]), labels(tree[3], x[~low])
    return out


# The labelled pages. In their texts every word of main text is "m" and every other word "b", so that a block's label is in
# its words whatever the reader of blocks makes of the page.


def main(*sizes: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{' '.join('m' * n)}</{tag}>" for n in sizes)


def other(*sizes: int, tag: str = "p", links: float = 0.0) -> str:
    def block(n: int) -> str:
        k = round(n * links)
        return " ".join(["<a href=x>" + " ".join("b" * k) + "</a>"] * (k > 0) + ["b"] * (n - k))

    return "".join(f"<{tag}>{block(n)}</{tag}>" for n in sizes)


def menu(*sizes: int) -> str:
    return f"<ul>{other(*sizes, tag='li', links=1.0)}</ul>"


def lengths(k: int) -> list[int]:
    """Words of the title and the paragraphs of a text, three of these at least, by a linear congruence: short, middling and long ones mixed."""
    out, x = [], 7919 * k + 17
    for _ in range(5 + k % 6):
        x = (x * 1103515245 + 12345) % (1 << 31)
        least, span = ((1, 5), (6, 15), (15, 30), (40, 160))[(x >> 8) % 4]
        out.append(least + (x >> 16) % span)
    return out


def labelled_pages(n: int = 24) -> list[str]:
    """Pages of several makes, each with n texts."""
    pages = []
    for k in range(n):
        texts = lengths(k)
        title, *rest = texts
        head = main(title // 4 + 2, tag="h1")
        paragraphs = main(*rest)
        quote = main(rest[1] // 2 + 3, tag="blockquote") + f"<ul>{main(4, 9, rest[0] // 2 + 1, tag='li')}</ul>"
        table = f"<table><tr>{main(2, 3, 1, tag='td')}</tr></table>"
        link = f"<p>{'m ' * 12}<a href=x>{'m ' * (2 + k % 5)}</a>{'m ' * 9}</p><p><a href=x>m m m</a> {'m ' * rest[2]}</p>"
        a, b, c, d, e, *_ = lengths(k + 1000) + lengths(k + 2000)
        advert, comments = other(a, b), other(c, d, e)
        foot = other(e, 9 + k % 12, tag="div")
        pages += [
            # semantic elements; the advert, the share links and the comments are inside the article or beside it
            f"<html class='has-sidebar'><head><title>b b</title></head><body><nav>{menu(1, 1, 2, 1)}</nav><div class='ad'>{'b ' * a}</div><article>{head}{paragraphs}{quote}</article><footer>{'b ' * d}</footer></body>",
            f"<header><h2>b b</h2>{menu(1, 2, 1)}</header><article><header>{head}<p>m m m</p></header>{paragraphs}{link}<div class='share-links'>{other(1, 1, 1, tag='span', links=1.0)}</div><section class='comments'>{comments}</section></article><aside>{other(b, d)}</aside><footer>{foot}</footer>",
            f"<main>{head}<p class='header-summary'>{'m ' * (5 + 9 * k % 90)}</p><div class='post-search-guide'>{main(*rest[:3])}</div>{table}<aside class='related'>{other(3, 4, tag='li', links=1.0)}</aside></main><div id='site-footer'>{foot}</div>",
            f"<div class='cookie-notice'>{other(c, tag='div')}</div><main><article class='post ad-free comments-open'>{head}{paragraphs}{link}<figure><figcaption>{'m ' * 8}</figcaption></figure></article><div id='comment-list'>{comments}</div><p>{'b ' * a}</p></main><footer>{foot}</footer>",
            # plain divisions with names
            f"<div id='header'>{other(3, tag='h2')}</div><div class='top-menu'>{menu(1, 1, 1, 2, 1)}</div><div id='content'>{head}{paragraphs}{quote}</div><div class='sidebar-left'>{other(c, d, tag='div')}{menu(3, 4, 3)}</div><div class='footer'>{foot}</div>",
            f"<div class='banner_ad'>{advert}</div><div class='story'>{head}<div class='header-photo-text'>{main(rest[1] + 20, d)}</div>{paragraphs}{table}</div><div class='comments'>{comments}</div><div class='newsletter-signup'><form>{other(b)}</form></div>",
            f"<div class='post'><div class='notice-history'>{main(10 + 5 * k % 60)}</div>{head}{link}{paragraphs}<div class='ads'>{advert}</div>{main(b, c, d)}</div><div class='widget'>{other(b, e, tag='div')}</div>",
            # no names at all: links and neighbours decide
            f"<div>{menu(1, 1, 2, 1, 1)}</div><div>{head}{main(*(n + 15 for n in rest))}</div><div>{menu(3, 4, 5, 3)}</div>",
            f"<table><tr><td>{menu(1, 2, 1, 1)}</td><td>{head}{main(*(n + 25 for n in rest))}{main(30)}</td></tr></table><div>{other(2, tag='span', links=1.0)} {other(3, tag='span', links=1.0)}</div>",
            f"<ul>{other(2, 3, 2, tag='li', links=1.0)}</ul><h2>b b</h2><ul>{other(3, 2, 4, tag='li', links=1.0)}</ul>{head}<p>{'m ' * (20 + 10 * k % 100)}</p><p>{'m ' * 4}</p><p>{'m ' * 40}</p><ul>{other(5, 6, 4, tag='li', links=0.9)}</ul>",
            f"<div>{head}{main(*(n + 9 for n in rest))}</div><p>{' | '.join(['<a href=x>' + 'b ' * (1 + (k + i) % 3) + '</a>' for i in range(2 + k % 4)])}</p>",
            f"<p>{'m ' * (3 + 6 * k % 70)}</p>" + main(*rest[: k % 5]),
        ]
    return pages


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: features, and 1 for main text."""
    x, y = [], []
    for page in labelled_pages():
        found = blocks(page)
        x.append(features(found))
        y += [int("m" in b.text) for b in found]
    return np.vstack(x), np.array(y)


def trained() -> tuple:
    return grow(*labelled())


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, labels(tree, features(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([field(pages, id_col, "page_id"), field(pages, url_col, "url"), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html")).mapInArrow(run, schema)
