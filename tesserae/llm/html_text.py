"""Main text of web pages: flat text blocks, judged by a decision tree over them and their neighbours.

A block's words and link density, and those of the blocks before and after it, are the
tree's main features. Beside them it sees the block's kind of element, whether menus,
footers or forms hold it, whether the page's article does, and whether a name around it
speaks of adverts, comments and the like. The tree is grown from a small labelled table
of pages on which none of these is right alone: menus and teasers in articles, articles
in forms, text outside of the marked article, pages without any mark or name.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from tesserae.llm.common import map_texts

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "annotation", "annotation-xml", "canvas", "textarea", "select", "title", "head"}
#: Of these, what holds the rest of the page if it is not closed; the others end where they begin.
OPEN_ENDED = {"script", "style"}
#: Elements that end a text block.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and class words of what surrounds an article, and of the article itself.
AROUND = {"nav", "footer", "aside", "form", "header", "menu", "button", "dialog", "fieldset"}
AROUND_WORDS = set("nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar side aside widget ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond discussion pagination pager toolbar search masthead copyright legal disclaimer toc skip".split())
HEADER_WORDS = {"header", "site-header", "page-header", "top", "topbar"}
ARTICLE = {"article", "main"}
ARTICLE_WORDS = {"article", "articlebody", "post-content", "entry-content", "main-content", "article-body", "post-body", "story-body"}
_HOLDS = {"div", "section", "article", "main", "nav", "footer", "aside", "form", "header", "menu", "ul", "ol", "table", "dialog", "fieldset", "button", "blockquote", "figure", "details", "p", "td", "li"}

#: Words in names that mark even an <article> as something else.
OTHER_ARTICLES = {"comment", "comments", "reply", "card", "teaser", "related", "recommended", "promo", "ad"}
#: Words in names of what lays a page out, whatever else they speak of.
LAYOUT_WORDS = {"with", "has", "no", "without", "layout", "wrapper", "container", "page", "site"}
#: Kinds of elements, and where a block stands: outside the article of a page that marks one, on a page that marks none, in the article.
DIV, CELL, HEAD, PARA = range(4)
OUT, NONE, IN = range(3)
KINDS = {**dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], HEAD), **dict.fromkeys(["p", "blockquote", "pre"], PARA), **dict.fromkeys(["li", "td", "th", "dd", "dt", "option", "figcaption", "caption", "label", "legend", "summary"], CELL)}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "kind", "framed", "article", "named")
#: The labelled table: for each page its blocks in order, as kind, framed, article, named, words, words in links, and 1 for main text.
LABELLED = [
    # An article with its mark, short and long paragraphs, between a menu, an advert and a footer.
    [(CELL, 1, OUT, 0, 1, 1, 0), (CELL, 1, OUT, 0, 2, 2, 0), (DIV, 0, OUT, 1, 7, 0, 0), (HEAD, 0, IN, 0, 9, 0, 1), (PARA, 0, IN, 0, 45, 0, 1), (PARA, 0, IN, 0, 2, 0, 1), (PARA, 0, IN, 0, 80, 3, 1),
     (PARA, 0, IN, 0, 1, 0, 1), (HEAD, 0, IN, 0, 3, 0, 1), (PARA, 0, IN, 0, 12, 0, 1), (CELL, 0, IN, 0, 8, 0, 1), (CELL, 0, IN, 0, 3, 0, 1), (PARA, 0, IN, 0, 66, 0, 1), (DIV, 1, OUT, 0, 9, 0, 0)],
    # The same without names: a notice, a list of links and a linked sentence inside.
    [(DIV, 0, OUT, 0, 6, 0, 0), (PARA, 0, OUT, 0, 25, 1, 0), (HEAD, 0, IN, 0, 6, 0, 1), (PARA, 0, IN, 0, 70, 0, 1), (PARA, 0, IN, 0, 5, 5, 1), (PARA, 0, IN, 0, 50, 4, 1), (CELL, 0, IN, 0, 4, 4, 0), (CELL, 0, IN, 0, 6, 6, 0),
     (CELL, 0, IN, 0, 5, 5, 0), (DIV, 0, OUT, 0, 2, 2, 0), (PARA, 1, OUT, 0, 14, 1, 0)],
    # No mark and no name: what is long and free of links, and what stands between it.
    [(DIV, 0, NONE, 0, 1, 1, 0), (DIV, 0, NONE, 0, 1, 1, 0), (DIV, 0, NONE, 0, 2, 2, 0), (HEAD, 0, NONE, 0, 8, 0, 1), (PARA, 0, NONE, 0, 60, 0, 1), (PARA, 0, NONE, 0, 3, 0, 1), (PARA, 0, NONE, 0, 90, 2, 1), (PARA, 0, NONE, 0, 14, 0, 1),
     (DIV, 0, NONE, 0, 5, 0, 0), (PARA, 0, NONE, 0, 40, 0, 1), (PARA, 0, NONE, 0, 6, 0, 1), (PARA, 0, NONE, 0, 1, 0, 1), (PARA, 0, NONE, 0, 20, 0, 1), (DIV, 0, NONE, 0, 2, 2, 0), (DIV, 0, NONE, 0, 3, 3, 0), (DIV, 0, NONE, 0, 6, 0, 0)],
    # Text in plain containers.
    [(CELL, 0, NONE, 0, 1, 1, 0), (CELL, 0, NONE, 0, 2, 2, 0), (DIV, 0, NONE, 0, 11, 0, 0), (HEAD, 0, NONE, 0, 5, 0, 1), (DIV, 0, NONE, 0, 70, 2, 1), (DIV, 0, NONE, 0, 55, 0, 1), (DIV, 0, NONE, 0, 120, 5, 1), (DIV, 0, NONE, 0, 8, 6, 0),
     (DIV, 0, NONE, 0, 4, 4, 0), (DIV, 0, NONE, 0, 10, 0, 0)],
    # Teasers are marked as articles, the text is not.
    [(CELL, 1, OUT, 0, 1, 1, 0), (PARA, 0, OUT, 0, 85, 0, 1), (PARA, 0, OUT, 0, 70, 1, 1), (PARA, 0, OUT, 0, 95, 0, 1), (PARA, 0, OUT, 0, 110, 2, 1), (HEAD, 0, IN, 0, 4, 4, 0), (PARA, 0, IN, 0, 18, 14, 0), (HEAD, 0, IN, 0, 6, 6, 0),
     (PARA, 0, IN, 0, 15, 12, 0), (HEAD, 0, IN, 0, 5, 5, 0), (PARA, 0, IN, 0, 20, 15, 0), (DIV, 1, OUT, 0, 7, 1, 0)],
    # Readers' comments below and inside the article.
    [(HEAD, 0, IN, 0, 7, 0, 1), (PARA, 0, IN, 0, 65, 1, 1), (PARA, 0, IN, 0, 30, 0, 1), (PARA, 0, IN, 0, 9, 0, 1), (HEAD, 0, IN, 1, 2, 0, 0), (PARA, 0, IN, 1, 40, 0, 0), (PARA, 0, IN, 1, 12, 0, 0), (PARA, 0, OUT, 1, 33, 0, 0), (PARA, 0, OUT, 1, 75, 1, 0),
     (PARA, 0, OUT, 1, 4, 0, 0), (PARA, 0, OUT, 1, 90, 0, 0), (DIV, 1, OUT, 0, 2, 0, 0)],
    # A form holds the whole page.
    [(CELL, 1, NONE, 0, 1, 1, 0), (CELL, 1, NONE, 0, 1, 1, 0), (PARA, 1, NONE, 0, 80, 0, 1), (PARA, 1, NONE, 0, 75, 1, 1), (PARA, 1, NONE, 0, 90, 0, 1), (PARA, 1, NONE, 0, 100, 2, 1), (DIV, 1, NONE, 0, 3, 0, 0), (CELL, 1, NONE, 0, 2, 0, 0)],
    # A cookie notice first, quotations, a box of comments on a page without marks.
    [(DIV, 0, NONE, 0, 24, 5, 0), (DIV, 0, NONE, 0, 1, 1, 0), (HEAD, 0, NONE, 0, 10, 0, 1), (PARA, 0, NONE, 0, 48, 0, 1), (PARA, 0, NONE, 0, 15, 0, 1), (PARA, 0, NONE, 0, 52, 3, 1), (CELL, 0, NONE, 0, 9, 0, 1), (CELL, 0, NONE, 0, 12, 1, 1),
     (PARA, 0, NONE, 0, 33, 0, 1), (HEAD, 0, NONE, 1, 2, 0, 0), (PARA, 0, NONE, 1, 28, 0, 0), (PARA, 0, NONE, 1, 60, 1, 0), (PARA, 0, NONE, 1, 80, 0, 0)],
    # Sidebars with prose, a short life of the author outside.
    [(HEAD, 1, OUT, 0, 2, 0, 0), (PARA, 1, OUT, 0, 55, 0, 0), (PARA, 1, OUT, 0, 20, 2, 0), (PARA, 1, OUT, 0, 23, 0, 0), (HEAD, 0, IN, 0, 8, 0, 1), (PARA, 0, IN, 0, 100, 8, 1), (PARA, 0, IN, 0, 23, 0, 1), (PARA, 1, IN, 0, 23, 0, 0), (PARA, 0, IN, 0, 5, 0, 1),
     (HEAD, 0, OUT, 0, 3, 0, 0), (PARA, 0, OUT, 0, 45, 2, 0), (DIV, 0, OUT, 0, 2, 2, 0)],
    # Very short articles, with and without a mark.
    [(HEAD, 0, IN, 0, 3, 0, 1), (PARA, 0, IN, 0, 1, 0, 1), (PARA, 0, IN, 0, 2, 0, 1), (DIV, 1, OUT, 0, 8, 0, 0)],
    [(DIV, 0, NONE, 0, 1, 1, 0), (HEAD, 0, NONE, 0, 4, 0, 1), (PARA, 0, NONE, 0, 22, 0, 1), (DIV, 0, NONE, 0, 3, 1, 0)],
    # An article rich in links, with containers for text and tables.
    [(CELL, 1, OUT, 0, 2, 2, 0), (DIV, 0, IN, 0, 35, 2, 1), (PARA, 0, IN, 0, 60, 30, 1), (PARA, 0, IN, 0, 22, 12, 1), (CELL, 0, IN, 0, 2, 0, 1), (CELL, 0, IN, 0, 1, 0, 1), (CELL, 0, IN, 0, 4, 0, 1), (DIV, 0, IN, 0, 6, 0, 1), (PARA, 0, IN, 0, 41, 6, 1),
     (DIV, 0, IN, 1, 3, 3, 0), (DIV, 0, IN, 1, 2, 0, 0), (PARA, 0, IN, 0, 18, 0, 1), (PARA, 1, OUT, 0, 60, 0, 0), (DIV, 1, OUT, 0, 5, 3, 0)],
    # Long paragraphs right after and before what does not belong; short containers and linked sentences in the article.
    [(CELL, 1, OUT, 0, 2, 2, 0), (DIV, 0, OUT, 1, 7, 0, 0), (PARA, 0, IN, 0, 130, 2, 1), (PARA, 0, IN, 0, 24, 6, 1), (DIV, 0, IN, 0, 9, 0, 1), (PARA, 0, IN, 0, 12, 0, 1), (PARA, 0, IN, 0, 12, 3, 1), (PARA, 0, IN, 0, 140, 3, 1), (PARA, 0, OUT, 0, 12, 1, 0), (DIV, 1, OUT, 0, 40, 2, 0)],
    [(DIV, 0, OUT, 0, 10, 0, 0), (PARA, 0, IN, 0, 105, 0, 1), (DIV, 0, IN, 0, 2, 0, 1), (DIV, 0, IN, 0, 11, 0, 1), (PARA, 0, IN, 0, 3, 1, 1), (DIV, 0, IN, 0, 15, 0, 1), (PARA, 0, IN, 0, 125, 0, 1), (DIV, 1, OUT, 0, 70, 1, 0)],
    [(PARA, 0, OUT, 0, 18, 1, 0), (PARA, 0, IN, 0, 99, 0, 1), (PARA, 0, IN, 0, 33, 8, 1), (PARA, 0, IN, 0, 4, 4, 0), (PARA, 0, IN, 0, 5, 5, 0), (PARA, 0, IN, 0, 4, 3, 0), (PARA, 1, OUT, 0, 30, 1, 0)],
    [(PARA, 0, NONE, 0, 23, 0, 1), (PARA, 0, NONE, 0, 40, 0, 1), (PARA, 1, NONE, 0, 92, 1, 0)],
    [(PARA, 1, NONE, 0, 110, 0, 0), (HEAD, 0, NONE, 0, 6, 0, 1), (PARA, 0, NONE, 0, 44, 0, 1)],
    # Pages that break off in their text, or end with it.
    [(HEAD, 0, IN, 0, 7, 0, 1), (PARA, 0, IN, 0, 40, 0, 1), (PARA, 0, IN, 0, 30, 0, 1)],
    [(CELL, 1, OUT, 0, 1, 1, 0), (PARA, 0, IN, 0, 22, 0, 1), (PARA, 0, IN, 0, 2, 0, 1)],
    [(PARA, 0, NONE, 0, 23, 0, 1), (PARA, 0, NONE, 0, 24, 0, 1)],
    [(DIV, 0, NONE, 0, 3, 0, 0), (PARA, 0, NONE, 0, 70, 1, 1), (PARA, 0, NONE, 0, 31, 0, 1), (PARA, 0, NONE, 0, 12, 0, 1)],
    [(DIV, 0, IN, 0, 50, 0, 1), (DIV, 0, IN, 0, 28, 0, 1)],
    [(PARA, 0, NONE, 0, 60, 0, 1), (PARA, 0, NONE, 0, 45, 1, 1)],
    [(PARA, 0, IN, 0, 35, 0, 1), (PARA, 0, IN, 0, 26, 2, 1), (DIV, 0, IN, 0, 4, 0, 1)],
    [(CELL, 0, NONE, 0, 1, 1, 0), (DIV, 0, NONE, 0, 17, 0, 0), (HEAD, 0, NONE, 0, 12, 0, 1), (DIV, 0, NONE, 0, 14, 0, 0), (PARA, 0, NONE, 0, 27, 0, 1), (DIV, 0, NONE, 0, 18, 1, 0)],
    # Long terms of use in a footer, long prose in sidebars and between links, links after long paragraphs.
    [(HEAD, 0, IN, 0, 5, 0, 1), (PARA, 0, IN, 0, 80, 0, 1), (PARA, 1, IN, 0, 70, 0, 0), (PARA, 0, IN, 0, 30, 0, 1), (DIV, 0, IN, 0, 3, 3, 0), (PARA, 0, IN, 0, 75, 2, 1), (CELL, 0, IN, 0, 2, 2, 0), (DIV, 0, OUT, 0, 2, 2, 0), (DIV, 0, OUT, 0, 90, 2, 0),
     (DIV, 0, OUT, 0, 3, 3, 0), (PARA, 1, OUT, 0, 120, 1, 0), (PARA, 1, OUT, 0, 85, 0, 0), (DIV, 1, OUT, 0, 2, 0, 0)],
    # Text in plain containers alone, of even lengths, with and without links around it.
    [(DIV, 0, NONE, 0, 31, 0, 1), (DIV, 0, NONE, 0, 30, 0, 1), (DIV, 0, NONE, 0, 28, 0, 1), (DIV, 0, NONE, 0, 33, 1, 1), (DIV, 0, NONE, 0, 30, 0, 1), (DIV, 0, NONE, 0, 25, 0, 1), (DIV, 0, NONE, 0, 32, 0, 1), (DIV, 0, NONE, 0, 30, 0, 1)],
    [(DIV, 0, NONE, 0, 1, 1, 0), (DIV, 0, NONE, 0, 2, 2, 0), (DIV, 0, NONE, 0, 35, 0, 1), (DIV, 0, NONE, 0, 38, 0, 1), (DIV, 0, NONE, 0, 1, 1, 0)],
    [(DIV, 0, NONE, 0, 36, 0, 1), (DIV, 0, NONE, 0, 38, 1, 1)],
    [(CELL, 1, NONE, 0, 1, 1, 0), (CELL, 1, NONE, 0, 1, 1, 0), (DIV, 0, NONE, 0, 26, 0, 1), (DIV, 0, NONE, 0, 34, 0, 1), (DIV, 0, NONE, 0, 41, 1, 1), (DIV, 0, NONE, 0, 29, 0, 1), (DIV, 0, NONE, 0, 2, 2, 0), (DIV, 1, NONE, 0, 8, 1, 0)],
    [(HEAD, 0, NONE, 0, 6, 0, 1), (DIV, 0, NONE, 0, 44, 0, 1), (DIV, 0, NONE, 0, 27, 0, 1), (DIV, 0, NONE, 0, 31, 2, 1), (DIV, 0, NONE, 0, 9, 9, 0), (DIV, 0, NONE, 0, 3, 0, 0)],
    # Sidebars and forms in the article, short and long, whatever stands beside them.
    [(PARA, 0, IN, 0, 60, 0, 1), (PARA, 1, IN, 0, 25, 0, 0), (PARA, 0, IN, 0, 90, 0, 1), (HEAD, 1, IN, 0, 3, 0, 0), (PARA, 1, IN, 0, 44, 0, 0), (PARA, 0, IN, 0, 70, 1, 1)],
    [(HEAD, 0, IN, 0, 6, 0, 1), (PARA, 0, IN, 0, 30, 0, 1), (DIV, 1, IN, 0, 12, 0, 0), (PARA, 0, IN, 0, 55, 0, 1), (CELL, 1, IN, 0, 2, 0, 0), (CELL, 1, IN, 0, 1, 0, 0), (PARA, 0, IN, 0, 110, 2, 1)],
    [(PARA, 0, IN, 0, 100, 0, 1), (PARA, 1, IN, 0, 9, 0, 0), (DIV, 1, IN, 0, 2, 0, 0), (PARA, 0, IN, 0, 58, 0, 1), (PARA, 1, IN, 0, 80, 1, 0), (PARA, 0, IN, 0, 35, 0, 1), (DIV, 1, OUT, 0, 4, 0, 0)],
    [(PARA, 0, IN, 0, 40, 0, 1), (PARA, 1, IN, 0, 61, 0, 0), (PARA, 1, IN, 0, 64, 0, 0), (PARA, 0, IN, 0, 62, 0, 1)],
    # Headlines that link to their own page, above long text; and such of other pages, in lists and between paragraphs.
    [(CELL, 1, OUT, 0, 1, 1, 0), (CELL, 1, OUT, 0, 2, 2, 0), (HEAD, 0, IN, 0, 7, 7, 1), (PARA, 0, IN, 0, 62, 0, 1), (PARA, 0, IN, 0, 48, 2, 1)],
    [(HEAD, 0, IN, 0, 4, 4, 1), (PARA, 0, IN, 0, 41, 0, 1), (PARA, 0, IN, 0, 77, 1, 1), (DIV, 1, OUT, 0, 5, 1, 0)],
    [(DIV, 0, OUT, 0, 2, 2, 0), (HEAD, 0, IN, 0, 11, 11, 1), (PARA, 0, IN, 0, 90, 0, 1), (HEAD, 0, IN, 0, 3, 0, 1), (PARA, 0, IN, 0, 55, 0, 1), (HEAD, 0, IN, 0, 6, 6, 0), (HEAD, 0, IN, 0, 5, 5, 0), (HEAD, 0, IN, 0, 8, 8, 0)],
    [(HEAD, 0, IN, 0, 5, 0, 1), (PARA, 0, IN, 0, 64, 0, 1), (HEAD, 0, IN, 0, 7, 7, 0), (PARA, 0, IN, 0, 52, 0, 1), (HEAD, 0, IN, 0, 4, 4, 0), (PARA, 0, IN, 0, 80, 2, 1)],
    [(PARA, 0, NONE, 0, 5, 5, 0), (PARA, 0, NONE, 0, 4, 4, 0), (PARA, 0, NONE, 0, 6, 6, 0), (PARA, 0, NONE, 0, 47, 0, 1), (PARA, 0, NONE, 0, 52, 0, 1), (PARA, 0, NONE, 0, 5, 5, 0), (PARA, 0, NONE, 0, 4, 4, 0)],
    [(HEAD, 0, OUT, 0, 9, 9, 1), (DIV, 0, IN, 0, 66, 0, 1), (DIV, 0, IN, 0, 71, 0, 1), (HEAD, 0, OUT, 0, 5, 5, 0), (PARA, 0, OUT, 0, 16, 12, 0), (HEAD, 0, OUT, 0, 6, 6, 0), (PARA, 0, OUT, 0, 14, 10, 0)],
]


def features(blocks: list[tuple[int, int, int, int, int, int]]) -> list[tuple]:
    """FEATURES of each of a page's blocks, given as in LABELLED without the label."""
    about = [(words, min(1.0, linked / words)) for _, _, _, _, words, linked in blocks]
    around = [(0, 0.0), *about, (0, 0.0)]
    return [(*about[i], *around[i], *around[i + 2], *b[:4]) for i, b in enumerate(blocks)]


def labelled_rows(pages: list[list[tuple]]) -> list[tuple]:
    return [(*f, b[-1]) for page in pages for f, b in zip(features([b[:-1] for b in page]), page, strict=True)]


def grow(rows: list[tuple], depth: int = 8, least: int = 1):
    """A decision tree by Gini impurity: (feature, bound, below or at, above) or a leaf 0 or 1."""
    data = np.array(rows, float)
    labels = data[:, -1]
    if depth == 0 or len(set(labels)) == 1 or len(rows) < 2 * least:
        return int(2 * labels.sum() >= len(labels))
    best = None
    for f in range(data.shape[1] - 1):
        found = np.unique(data[:, f])
        for bound in (found[:-1] + found[1:]) / 2:
            low = labels[data[:, f] <= bound]
            high = labels[data[:, f] > bound]
            if min(len(low), len(high)) >= least:
                score = sum(len(x) * x.mean() * (1 - x.mean()) for x in (low, high))
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, float(bound))
    if best is None:
        return int(2 * labels.sum() >= len(labels))
    _, f, bound = best
    return (f, bound, grow([r for r in rows if r[f] <= bound], depth - 1, least), grow([r for r in rows if r[f] > bound], depth - 1, least))


def decide(tree, features: tuple) -> int:
    while not isinstance(tree, int):
        f, bound, low, high = tree
        tree = low if features[f] <= bound else high
    return tree


class _Markup:
    """Finds a page's markup from left to right, in time that grows with the page however broken it is.

    A tag ends at the first > outside of quotes. Where quotes do not close before the page ends, they no longer count from there on;
    without any further > the rest is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.unclosed = page, True, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """The place after a tag whose attributes begin at `at`, or -1."""
        if self.quotes:
            stop = at
            while m := _STOP.search(self.page, stop):
                c = m.group()
                if c == ">":
                    return m.end()
                if m.start() >= self.last[c]:
                    break
                stop = self.page.index(c, m.end()) + 1
            self.quotes = False
        return self.page.index(">", at) + 1 if at <= self.last[">"] else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, closing, attributes) of the next piece of markup; the tag is empty for comments and declarations."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self.last[">"]:
                rest = page.find("<!--", start)
                if rest < 0:
                    return None
                at = rest
                continue
            if m := _TAG.match(page, start):
                end = self._end(m.end())
                if end >= 0:
                    return start, end, m.group(2).lower(), bool(m.group(1)), page[m.end() : end - 1]
            elif page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, "", False, ""
            at = start + 1
        return None

    def after(self, tag: str, at: int) -> int:
        """The place after what a raw element holds; `at` if it is not closed and does not hold the rest."""
        if tag not in self.unclosed:
            if end := re.compile(rf"</{tag}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(self.page, at):
                return end.start() if tag == "head" and self.page[end.start() + 1] != "/" else end.end()
            self.unclosed.add(tag)
        return len(self.page) if tag in OPEN_ENDED else at


def _context(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(framed, article, named) of an element."""
    framed, article, named = tag in AROUND, tag in ARTICLE, False
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            whole = set(next((v for v in values if v), "").lower().split())
            if name.lower() == "role":
                framed |= bool(whole & {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"})
                article |= bool(whole & {"main", "article"})
            elif tag not in {"body", "html", "main"}:
                text = bool(whole & ARTICLE_WORDS) or name.lower() == "itemprop" and "articlebody" in whole
                article |= text
                each = [set(re.split(r"[-_]+", w)) for w in whole]
                words = {p for parts in each if not parts & LAYOUT_WORDS for p in parts}
                named |= not text and (bool(words & (OTHER_ARTICLES if tag == "article" else AROUND_WORDS)) or bool(whole & HEADER_WORDS))
    return framed, article and not framed and not named, named


def blocks(page: str) -> list[tuple[str, tuple[int, int, int, int, int, int]]]:
    """(text, (kind, framed, article, named, words, words in links)) of each flat text block, in page order."""
    found = _flat(page)
    marked = any(b[3] and not b[2] and not b[4] for b in found)
    return [(text, (kind, int(framed), IN if inside else OUT if marked else NONE, int(named), words, linked)) for text, kind, framed, inside, named, words, linked in found]


def _flat(page: str) -> list[tuple[str, int, bool, bool, bool, int, int]]:
    """(text, kind, framed, inside, named, words, words in links) of each block."""
    out: list[tuple[str, int, bool, bool, bool, int, int]] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []
    framed = inside = named = forms = outer = 0  # outer: forms around the innermost article, which are no frame of it
    linked, opened, own = False, 0, ""
    held: list[str] = []
    links: list[str] = []

    def close() -> None:
        nonlocal held, links
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                words = len(text.split())
                in_links = len(html.unescape("".join(links)).split()) if links else 0
                out.append((text, KINDS.get(own, DIV), framed > 0 or forms > outer, inside > 0, named > 0, words, min(words, in_links)))
        held, links = [], []

    def put(text: str) -> None:
        if text:
            held.append(text)
            if linked:
                links.append(text + " ")

    def pop(upto: int) -> None:
        nonlocal framed, inside, named, forms, outer
        while len(stack) > upto:
            tag, a, b, c, around = stack.pop()
            forms -= a and tag == "form"
            framed -= a and tag != "form"
            inside -= b
            named -= c
            outer = around

    markup, at, size = _Markup(page), 0, len(page)
    while at < size:
        found = markup.next(at)
        if not found:
            put(page[at:])
            break
        start, end, tag, closing, attributes = found
        put(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                at = markup.after(tag, at)
            continue
        if tag == "a":
            linked, opened = not closing and "href" in attributes.lower(), 0
        elif tag == "br":
            put(" ")
        elif tag in BLOCKS:
            close()
            # A link holds the blocks that open in it, and ends with the one that it stands in.
            opened += -1 if closing else 1
            linked = linked and opened >= 0
            if closing:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is not None and not (tag in {"p", "li"} and any(s[0] not in {"p", "li"} for s in stack[k + 1 :])):
                    pop(k)
                own = stack[-1][0] if stack else ""
            elif tag in _HOLDS and not attributes.endswith("/"):
                if stack and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                if tag == "li" and stack and stack[-1][0] == "li":
                    pop(len(stack) - 1)
                a, b, c = _context(tag, attributes)
                stack.append((tag, a, b, c, outer))
                outer = forms if b else outer
                forms += a and tag == "form"
                framed += a and tag != "form"
                inside += b
                named += c
                own = tag
            else:
                own = tag
    close()
    return out


def main_text(page: str | None, tree) -> str:
    """The page's main text: its blocks that the tree takes for it, by single spaces."""
    found = blocks(page or "")
    return " ".join(text for (text, _), f in zip(found, features([b for _, b in found]), strict=True) if decide(tree, f))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", extra: tuple[str, ...] = ("url",), labelled: list[list[tuple]] | None = None) -> DataFrame:
    """(id, extra columns, text, n_chars) for every row of pages.

    The tree is grown from pages labelled as in LABELLED, by default these. Null and empty pages, and pages
    without main text, have an empty text; pages that break off are read as far as they go;
    repeated rows each get a row; other columns of pages are ignored.
    """
    tree = grow(labelled_rows(labelled or LABELLED))

    def make():
        def apply(texts):
            out = []
            for t in texts:
                text = main_text(t, tree)
                out.append((text, len(text)))
            return out

        return apply

    return map_texts(pages, make, "text string, n_chars bigint", id_col, html_col, {c: c for c in extra})
