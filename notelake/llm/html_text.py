"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks: the text between two block-level tags. Each block has its number of words and the
share of them inside links, the same of the block before and the one after, whether it is a heading or a list item, and what its
enclosing elements say: inside an article or the page's main element; inside a menu, header, footer, form and the like, or named as one. A
decision tree, grown here on a small labelled table of blocks, says which blocks are main text: where a page has no article
element, the words and links of a block and of its neighbours decide. The tree comes to a few
comparisons, and each page is worked on whole inside one row of its partition, so nothing is shuffled.

Null and empty pages give an empty text. Unclosed tags, truncated pages and stray ends are read the way browsers
do: a tag cut off by the end of the page is dropped, an unknown end tag is ignored. Deep nesting and long pages take time in proportion
to their length. Only the html is read, so extra columns are carried along whatever their names, repeated rows give equal rows, and an
empty table gives an empty one.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table

#: Fixed lists of element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; what they hold is never shown as text of the page.
RAW_TAGS = frozenset("script style textarea title noscript template iframe noframes svg math object select".split())
CONTENT_TAGS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset search figure head".split())
#: Words in an element's class, id or role that name it as beside the article, and whole names that name an article: words for one and
#: for its text, with numbers perhaps, and no other word in the same name. An element with both is an article.
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|widget\w*|aside|related|recommend\w*|share|sharing|social|comments?|replies|reply|respond|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|pager|pagination|toolbar|tags|meta|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|content|main)(?:[_-]+(?:article|post|entry|story|content|main|body|text|\d+))*|body-?text)(?:$|\s)", re.I)

#: Comments, tags and declarations. A quotation begins behind an equals sign alone: a value without one ends at white space, whatever signs it has.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: article: 1 inside, -1 outside on a page that has one, 0 on a page without.
FEATURES = ("article", "beside", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "list_item")

#: The labelled table: pages in short, one block a line: label, element path (with a name after a dot), words, words in links. The first
#: part has articles and names; in the second most pages have neither, so that only words and links tell.
LABELLED_PAGES = (
    "0 nav/li 1 1|0 nav/li 2 2|0 nav/li 1 1|0 div.ad 8 0|1 article/h1 9 0|1 article/p 60 0|1 article/p 30 2|1 article/p 3 0|0 footer 14 0",
    "0 header 4 0|0 nav/li 2 2|0 nav/li 1 1|1 article/h1 2 0|1 article/p 1 0|1 article/p 120 5|0 article/aside 25 0|1 article/p 40 0|0 article/div.comments/p 30 0|0 footer 9 2",
    "0 header/h1 5 5|0 div.notice 16 0|1 main/h1 6 0|1 main/p 22 0|1 main/ul/li 5 0|1 main/ul/li 4 0|1 main/p 90 1|0 main/form 7 0|0 aside/p 40 0|0 aside/li 3 3|0 footer/p 20 0",
    "0 div.menu/li 2 2|0 div.menu/li 2 2|1 div.content/h2 5 0|1 div.content/p 45 0|1 div.content/p 18 0|1 div.content/p 70 4|0 div.sidebar/p 35 0|0 div.footer 11 1",
    "1 article/h1 4 0|1 article/p 2 0|1 article/blockquote/p 15 0|1 article/li 2 0|1 article/li 6 1|1 article/p 9 9|0 article/div.share 4 4|0 article/footer 12 1|0 section.comments/p 50 0|0 section.comments/form 6 0",
    "0 div.cookies/p 30 1|0 header/p 6 0|0 nav/li 3 3|1 article/p 12 0|1 article/p 1 0|1 article/h2 2 0|1 article/p 33 0|0 aside.ad 22 0|0 form/p 15 0|0 footer/p 30 6",
    "0 div.banner 10 0|1 div.post/h1 4 0|1 div.post/p 5 0|1 div.post/p 64 0|1 div.post/p 17 0|0 div.related/li 6 6|0 div.comment/p 44 0|0 div.comment/p 3 0",
    "0 div 2 2|0 div 9 0|1 article/h1 5 0|1 article/p 2 0|1 article/p 1 0|1 article/p 48 0|0 div 35 0|0 div 60 2|0 div 8 1",
    "0 p 40 1|0 p 6 0|1 main/p 3 0|1 main/p 28 0|1 main/p 2 0|1 main/p 7 2|0 p 55 0|0 p 12 0|0 p 25 3",
    "1 article/p 80 3|1 article/h2 3 0|1 article/p 20 0|1 article/ul/li 1 0|1 article/ul/li 12 2|0 section/h2 2 0|0 section/p 31 0|0 section/p 4 0|0 div 70 5",
    "0 div.sidebar/p 50 1|0 div.widget/p 70 0|0 div.menu/li 4 1|1 div.entry/p 33 1|1 div.entry/p 6 0|1 div.entry/p 58 0|0 div.comments/p 90 0|0 div.comments/p 15 0|0 div.ads/p 24 3",
    "0 nav/li 1 1|1 article/h1 3 0|1 article/p 40 0|1 article/p 3 0",
    "1 article/p 2 0",
    "1 main/h1 5 0|1 main/p 8 0|1 main/p 1 1",
    "0 div.menu 3 3|1 div.post 6 0|1 div.post/li 4 2|1 div.post/p 9 1",
    "0 header 6 1|1 article/p 12 0|1 article/li 5 5|1 article/li 7 0",
    "0 p 2 2|0 p 3 3|1 p 50 0|1 p 24 1|1 p 8 0|1 p 66 0|0 p 4 4|0 p 3 3",
    "0 div 1 1|0 div 2 2|0 div 3 2|1 h1 6 0|1 p 40 0|1 p 35 0|1 h2 3 0|1 p 80 3|0 div 5 5|0 div 4 4|0 div 6 4",
    "0 li 1 1|0 li 2 2|0 li 1 1|1 h1 7 0|1 p 28 0|1 p 55 2|1 p 19 0|0 li 3 3|0 li 2 2|0 p 5 4",
    "0 div 2 2|0 div 1 1|0 div 11 0|1 h1 8 0|1 div 45 0|1 div 12 0|1 div 77 2|0 div 9 0",
    "0 td 1 1|0 td 2 2|0 td 8 1|1 td 90 3|1 td 6 0|1 td 110 4|0 td 7 0|0 td 2 2|0 td 2 2",
    "0 li 2 2|0 li 2 2|0 p 14 0|1 h1 5 0|1 p 38 0|1 p 4 0|1 p 41 0|1 p 9 0|1 p 52 1|0 p 12 0",
    "0 div 3 3|0 div 2 2|1 h1 4 0|1 p 25 0|1 p 60 0|1 h3 2 0|1 p 31 0|1 p 10 0|1 p 26 0|0 p 10 1|0 p 2 2|0 p 1 1",
    "0 p 6 5|0 p 4 4|0 p 7 0|1 h2 6 0|1 p 100 0|1 p 2 0|1 p 80 0|0 p 6 0|0 p 3 3|0 p 5 5",
    "1 h1 3 0|1 p 70 1|1 p 3 0|1 p 44 0|1 p 11 0|1 p 39 1|0 p 8 0",
    "1 h1 6 0|1 p 21 0|1 p 35 0|1 blockquote 12 0|1 p 61 0|0 div 5 2|0 div 9 0|0 div 4 4",
    "0 div 1 1|0 div 10 0|0 div 2 2|1 p 55 0|1 p 33 0|1 p 5 0|1 p 49 3|0 p 16 6|0 div 8 8|0 div 6 6",
    "0 p 9 0|0 p 2 2|0 p 2 2|1 h1 5 0|1 p 88 0|1 li 6 0|1 li 8 0|1 li 5 0|1 p 47 0|0 p 13 0|0 p 1 1",
    "1 p 130 4|1 p 15 0|1 p 96 0|1 p 7 0|1 p 75 2|0 p 10 0",
    "1 p 30 0|1 p 26 0",
    "1 p 40 0",
    "1 h1 4 0|1 p 50 0",
    "0 li 1 1|0 li 1 1|1 p 60 0|0 p 9 0",
    "0 li 3 3|1 h1 5 0|1 p 34 0|1 p 6 0|1 p 43 0|1 p 27 0|0 p 7 0|0 li 2 2",
)
#: Bounds of the tree and of the labelled table.
MAX_DEPTH, MIN_ROWS, MAX_LABELLED = 8, 1, 10_000


class Place(NamedTuple):
    """What holds below an element: inside an article, beside it, inside a heading, and the last two block-level elements."""

    inside: bool = False
    beside: bool = False
    heading: bool = False
    blocks: tuple[str, str] = ("", "")


def below(above: Place, tag: str, names: str) -> Place:
    """The place below an element. An article's own header and figures stay in; an element with an article's name is inside, whatever else it is called."""
    article = tag in CONTENT_TAGS or bool(names and CONTENT_NAMES.search(names))
    aside = not article and (tag in ASIDE_TAGS and not (above.inside and tag in ("header", "figure")) or bool(names and ASIDE_NAMES.search(names)))
    block = tag in BLOCK_TAGS
    return Place(
        above.inside or article,
        above.beside and not article or aside,
        tag[0] == "h" and tag[1:].isdigit() if block else above.heading,
        (above.blocks[1], tag) if block else above.blocks,
    )


def block_of(place: Place, words: int, link_words: int) -> tuple[int, ...]:
    return words, min(link_words, words), int(place.heading), int("li" in place.blocks), int(place.inside), int(place.beside)


def features(blocks: list[tuple[int, ...]]) -> np.ndarray:
    """One row per block of (words, link words, heading, list item, inside, beside); missing neighbours count 0."""
    b = np.array(blocks, float).reshape(-1, 6)
    density = b[:, 1] / np.maximum(b[:, 0], 1)
    before, after = np.r_[0, b[:-1, 0]], np.r_[b[1:, 0], 0]
    inside, beside = b[:, 4] * (1 - b[:, 5]), b[:, 5]
    article = np.where(inside > 0, 1, -1) if inside.any() else np.zeros(len(b))
    return np.column_stack([article, beside, b[:, 0], density, before, np.r_[0, density[:-1]], after, np.r_[density[1:], 0], b[:, 2:4]])


#: Each page of the labelled table also counts with blocks of these times the words.
LENGTHS = (1, 0.2, 4)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, and the number of the page of each labelled block. On pages without an article, lengths are as they are."""
    rows, labels, pages = [], [], []
    for page, times in ((p, t) for p in enumerate(LABELLED_PAGES) for t in LENGTHS):
        blocks, said = [], []
        for line in page[1].split("|"):
            label, path, words, links = line.split()
            place = Place()
            for x in path.split("/"):
                place = below(place, *(x + ".").split(".")[:2])
            blocks.append(block_of(place, math.ceil(int(words) * times), math.ceil(int(links) * times)))
            said.append(int(label))
        x = features(blocks)
        if times == 1 or x[0, 0]:
            rows.append(x)
            labels += said
            pages += [page[0]] * len(said)
    return np.concatenate(rows), np.array(labels), np.array(pages)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0):
    """A tree of (feature, threshold, at most, above) down to 0 or 1, split by least Gini impurity.

    The first feature in order and the lowest threshold win ties.
    """
    if depth == MAX_DEPTH or len(y) < 2 * MIN_ROWS or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            cost = sum(len(s) * (s.mean() * (1 - s.mean())) for s in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t, left)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, t, left = best
    return f, float(t), grow(x[left], y[left], depth + 1), grow(x[~left], y[~left], depth + 1)


@lru_cache(1)
def tree():
    x, y, _ = labelled_blocks()
    assert len(y) <= MAX_LABELLED
    return grow(x, y)


def classify(x: np.ndarray, node) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), bool(node))
    f, t, low, high = node
    left = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(x[left], low), classify(x[~left], high)
    return out


def text_blocks(page: str) -> Iterator[tuple[str, tuple[int, ...]]]:
    """(text, block_of) of each block with a word."""
    pieces: list[str] = []
    link_words = 0
    path: list[tuple[str, Place]] = []
    open_tags: dict[str, int] = {}

    def close() -> tuple | None:
        nonlocal pieces, link_words
        if not pieces:
            return None
        words = html.unescape("".join(pieces)).split()
        links, pieces, link_words = link_words, [], 0
        return (" ".join(words), block_of(path[-1][1] if path else Place(), len(words), links)) if words else None

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            pieces.append(piece)
            if open_tags.get("a"):
                link_words += len(piece.split())
        if not m:
            break
        at = m.end()
        ends, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCK_TAGS or name in RAW_TAGS:
            if done := close():
                yield done
        elif name in ("br", "img"):
            pieces.append(" ")
        if name in RAW_TAGS:
            if not ends and not rest.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = over.end() if over else n
        elif ends:
            if open_tags.get(name):
                while True:
                    tag, _ = path.pop()
                    open_tags[tag] -= 1
                    if tag == name:
                        break
        elif name not in VOID_TAGS:
            if name in BLOCK_TAGS and path and path[-1][0] == "p" or name in ("li", "p", "option") and path and path[-1][0] == name:
                open_tags[path.pop()[0]] -= 1
            names = " ".join(x for got in NAMES.findall(rest) for x in got if x) if rest else ""
            path.append((name, below(path[-1][1] if path else Place(), name, names if name not in ("html", "body") else "")))
            open_tags[name] = open_tags.get(name, 0) + 1
    if done := close():
        yield done


def main_text(page: str | None) -> str:
    blocks = list(text_blocks(page)) if page else []
    if not blocks:
        return ""
    keep = classify(features([b[1] for b in blocks]), tree())
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract_text(page: Column) -> Column:
    return F.pandas_udf(_main_texts, "string")(page)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
