"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks.  Their sizes and link densities, those of
their neighbours, and marks of the elements around them are the features of a decision
tree, which a table of labelled pages trains (``html_samples``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Tree, _grow
from .common import check_columns

# Element names of HTML by their role.
SILENT = frozenset("noscript template svg math object applet canvas audio video select button datalist".split())
#: Silent elements whose content is text up to their closing tag; an open head or title goes on as the page.
RAW = frozenset("script style textarea iframe head title".split())
#: Parts of silent elements that may hold blocks where the element itself ends at one.
HOLDERS = frozenset("foreignobject desc annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements that are never the frame of the whole page.
ALWAYS = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class names and ids that mark what is not the article, and what is.
OUTSIDE = re.compile(
    r"(?<![a-z])(?:ad(?:s|vert\w*|sense|slot|box|unit|block|container|wrapper|area)?|banner|sponsor\w*|promo\w*|(?:top|sub|main|side|foot|bottom|mega|drop)?(?:menu|nav)\w*|dropdown|breadcrumbs?|(?:site|page|top)?(?:footer|header)|masthead"
    r"|(?:side|left|right|top|bottom|info|tool)bar|side|rail|widgets?|complementary|contentinfo|comment\w*|disqus|repl(?:y|ies)|respond|responses?|discussion|(?:cookie|consent|gdpr)\w*|notices?|alert|popup|modal|overlay"
    r"|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|tags|tag (?:list|cloud|links)|copyright|legal|skip)(?![a-z])"
)
#: What says that a page has, or has not, something beside its article, and the head of the article itself.
BESIDE = re.compile(r"(?<![a-z])(?:no|has|have|with|without|hide|show) ?(?:sidebars?|menu|nav\w*|header|footer|banner|ads?|comments?|widgets?)(?![a-z])")
HEAD_OF = re.compile(r"(?<![a-z])(article|entry|post|story|content) ?(?:header|heading|head|title)(?![a-z])")
#: What a heading's own class names say of it.
TITLE = re.compile(r"(?<![a-z])(?:page|section|block|main|top)? ?(?:header|heading|head|title)(?![a-z])")
INSIDE = re.compile(r"(?<![a-z])(?:article|content|entry|main|post|story|text|body)(?![a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Characters of scripts that put no spaces between words, and how many of them make a word about.
UNSPACED = ((re.compile("[\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"), 2), (re.compile("[\u0e00-\u109f\u1780-\u17ff]"), 5))
#: An element that is marked as something else but holds the first heading and this share of the page's words
#: is the page's frame; without any first heading in the page it takes FRAME_ALONE, and FRAME_WORDS words.
FRAME_SHARE, FRAME_ALONE, FRAME_WORDS = 0.5, 0.75, 30
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "inside", "article", "heading")


class Block(NamedTuple):
    """A text block: its text, its share of linked words, and what the elements around it say."""

    text: str
    words: int
    links: float
    outside: bool
    inside: bool
    article: bool
    heading: bool


class Open(NamedTuple):
    """An open element: its name, the marks that it stands in, and whether it gives no text."""

    name: str
    marks: tuple[int, ...] = ()
    inside: bool = False
    article: bool = False
    silent: bool = False


PAGE = Open("")


def words_in(text: str) -> int:
    """Words of a text; a few characters of an unspaced script count as one."""
    n = len(text.split())
    return n if text.isascii() else n + sum(len(p.findall(text)) // k for p, k in UNSPACED)


def class_names(attributes: str) -> str:
    """The words of an element's classes, id and role: lower case, parted at case changes, ``-`` and ``_``."""
    if "=" not in attributes:
        return ""
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    names = re.sub(r"(?<=[a-z])(?=[A-Z])|[-_]+", " ", names).lower()
    return HEAD_OF.sub(r"\1", BESIDE.sub("", names)).strip()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order.

    A block ends where a block element starts or ends; inline elements, also line
    breaks, do not end it.  Silent elements and comments give no text; an element
    that is never closed ends with its parent, one of plain text (script, style,
    textarea, iframe) with the page, drawings and formulas also where a block starts.
    Marks of elements that turn out to be the frame of the whole page do not count.
    """
    found: list[tuple[str, int, float, Open, bool]] = []
    open_: list[Open] = []
    pieces: list[tuple[str, bool]] = []
    strong: list[bool] = []  # of each mark: whether it counts whatever its element holds
    unclosed: set[str] = set()
    link, heading = 0, ""

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(words_in(t) for t, a in pieces if a)
                n = words_in(text)
                found.append((text, n, min(1.0, linked / max(1, n)), open_[-1] if open_ else PAGE, heading))
            pieces = []

    at, end = 0, len(page)
    while at < end:
        mark = TOKEN.search(page, at)
        stop = mark.start() if mark else end
        silent = bool(open_) and open_[-1].silent
        if stop > at and not silent:
            pieces.append((html.unescape(page[at:stop]), link > 0))
        if not mark:
            break
        at = mark.end()
        name = (mark[2] or "").lower()
        if not name:
            continue
        if mark[1]:
            if name == "a" and not silent:
                link = max(0, link - 1)
            elif name in BLOCKS or name in SILENT or name in HOLDERS:
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].name == name), -1)
                if name in BLOCKS and not (silent and (k < 0 or open_[k].silent)):
                    close()
                    heading = ""
                if k >= 0:
                    del open_[k:]
            continue
        if name in RAW:
            if not mark[3].endswith("/"):
                over = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if over:
                    at = over.end()
                else:
                    unclosed.add(name)
                    if name not in ("head", "title"):
                        at = end
            continue
        if silent and name in BLOCKS and open_[-1].name in ("svg", "math"):
            while open_ and open_[-1].name in ("svg", "math"):
                open_.pop()
            silent = bool(open_) and open_[-1].silent
        if name in SILENT or (silent and (name in BLOCKS or name in HOLDERS)):
            if not mark[3].endswith("/") and name not in VOID:
                if name in ("select", "button") and silent and open_[-1].name == name:  # a sibling ends the open one
                    open_.pop()
                open_.append((open_[-1] if open_ else PAGE)._replace(name=name, silent=True))
            continue
        if silent:
            continue
        if name == "a":
            link += 1
        elif name == "br":
            pieces.append((" ", link > 0))
        elif name in BLOCKS:
            close()
            link = 0
            if name in VOID:
                continue
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # a sibling ends the open one
                if open_ and open_[-1].name == name:
                    open_.pop()
            parent = open_[-1] if open_ else PAGE
            names = class_names(mark[3])
            marks, always = parent.marks, bool(HIDDEN.search(mark[3])) or name in ALWAYS
            if always or (name in FRAME and not (name == "header" and parent.article)) or _is_outside(name, names):
                marks = (*marks, len(strong))
                strong.append(always)
            inside = parent.inside or name in ("article", "main") or bool(names and INSIDE.search(names))
            open_.append(Open(name, marks, inside, parent.article or name in ("article", "main")))
            heading = name if name in HEADINGS else ""
    close()
    void = _frames(found, strong)
    return [Block(text, n, links, any(m not in void for m in e.marks), e.inside, e.article, bool(h)) for text, n, links, e, h in found]


def _is_outside(name: str, names: str) -> bool:
    if not names or name in ("html", "body", "article", "main"):
        return False
    return bool(OUTSIDE.search(TITLE.sub("", names) if name in HEADINGS else names))


def _frames(found: list[tuple], strong: list[bool]) -> set[int]:
    """The marks whose elements hold most of the page, as FRAME_SHARE says."""
    if not strong:
        return set()
    total = sum(n for _, n, _, _, _ in found)
    held, titled = [0] * len(strong), [False] * len(strong)
    for _, n, _, e, h in found:
        for m in e.marks:
            held[m] += n
            titled[m] |= h == "h1"
    any_title = any(h == "h1" for *_, h in found)
    alone = lambda m: not any_title and held[m] > FRAME_ALONE * total and held[m] >= FRAME_WORDS
    return {m for m, kept in enumerate(strong) if not kept and ((titled[m] and held[m] > FRAME_SHARE * total) or alone(m))}


def block_features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours beyond the ends count as empty."""
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    # where a page has an article element, other blocks are outside of it: 0 none in the page, 1 in, -1 out
    has = any(b.article for b in found)
    marks = np.array([(b.outside, b.inside, 1 if b.article else -1 if has else 0, b.heading) for b in found], float).reshape(len(found), 4)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], marks])


@lru_cache(maxsize=1)
def decision_tree() -> Tree:
    """The tree that the labelled pages train; leaves are the share of main text."""
    from .html_samples import labelled_pages

    tables, labels = [], []
    for page in labelled_pages():
        found = blocks(page)
        tables.append(block_features(found))
        labels += [is_labelled_main(b.text) for b in found]
    y = np.array(labels, float)
    return _grow(np.concatenate(tables), y, np.ones(len(y)), depth=DEPTH, least=LEAST)


#: Depth of the tree, and the least blocks of a leaf.
DEPTH, LEAST = 8, 12


def is_labelled_main(text: str) -> bool:
    """The label of a block of a labelled page: its text starts with ``m`` (or with an unspaced script's first character)."""
    return text[0] in "m\u6587\u0e01"


def _is_main(tree: Tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree: Tree | None = None) -> str:
    tree = decision_tree() if tree is None else tree
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, block_features(found).tolist(), strict=True) if _is_main(tree, row)) if found else ""


def _extractor(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page", "url", "text", "n_chars"])

    return run


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars) for every row; a null or empty page has an empty text.

    Pages are read alone, so repeated rows, null ids or urls and other columns
    change nothing; memory is one page's blocks.  Markup that is cut off or never
    closed is read as far as it goes.  A block whose leaf of the tree is even counts as
    main text.  An empty table gives no rows.  The tree is grown on the driver.
    """
    check_columns(pages, id_col, url_col, html_col)
    plain = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(_extractor(decision_tree()), "page long, url string, text string, n_chars long").withColumnRenamed("page", id_col)


#: The texts of the given tables in DuckDB: their pages all have one article element, with plain tags and few references in it.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS bare FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(bare, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS decoded FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(decoded, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
