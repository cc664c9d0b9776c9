"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks. Each has its number of words and its link density (words in links
over words), those of both neighbours, and the words of link-poor text in the two blocks on either side. Further
features are its sentence marks a word, whether it stands in furniture by element or role, in the article or outside of
it, how far class and id words name it furniture (see ``weigh_names``), and whether it is a heading; its place in the
page is none, so that the later paragraphs of long flat pages are judged as the first ones. A decision tree (Spark ML,
trained on the labelled table of ``page_table``: 2,000 pages by default) says which blocks are main text; it is fitted
once a driver. Pages are read one at a time inside mapInArrow with no shuffle; the fitted tree is a list of thresholds.

Defined cases: a null or empty page has an empty text; unclosed elements end with the page; unclosed scripts, styles
and comments hide the rest of it; repeated rows are read each; a very long page is read whole by one task; an empty
table gives no rows; other columns pass through (a column named as the result is replaced).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm import page_table
from telemill.llm.wordhash import slices

FEATURES = [
    "words", "links", "prev_words", "prev_links", "next_words", "next_links", "near_words", "marks_a_word", "furniture", "named", "article", "heading",
]

# Element names of HTML by their role here, and words of class and id names that mark page furniture.
_HIDDEN = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|title|select|option|datalist"
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form header menu dialog search fieldset button".split())
_ARTICLE = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_WORDS = (
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "dialog disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
    "popup promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tooltip widget"
)
# Lists of entries: an article inside one, or named so, is an entry and not the page's own.
_LISTS = frozenset("ad ads advert adverts advertisement comment comments disqus promo promotion recommended related sponsor sponsored".split())
_WHOLE = frozenset("html body main article".split())
# Words of layout that say nothing of what an element holds.
_LAYOUT = frozenset("area bar block box buttons container icons inner item items links list posts section slot wrap wrapper".split())
_MODIFIERS = frozenset("has no not with without is js".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_BODY = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", re.IGNORECASE)
_WORDS = frozenset(_FURNITURE_WORDS.split())
_MARK = re.compile(r"[.!?…:;。！？।؟](?=\W|$)")
_HIDES = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: int
    article: int
    heading: int
    marks: tuple = ()
    named: float = 0.0


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether an element is page furniture by its role or hidden, and its class and id tokens that hold furniture words.

    A token comes as (key, plain): plain if it holds nothing but such words and words of layout; the key of one that has other words before
    them ends with the last of them (x-widget-text and x-widget-head share one). Names that only modify (has-sidebar,
    page-no-ads) don't count, nor do headers in articles. Whole-page elements are never furniture themselves.
    """
    found: list[tuple[str, bool]] = []
    for kind, *values in _NAMES.findall(attributes):
        value = next(filter(None, values), "").lower()
        if kind.lower() == "role":
            if value in _ROLES and name not in _WHOLE:
                return True, found
            continue
        for token in value.split():
            parts = [x for x in re.split(r"[^a-z]+", token) if x]
            places = [i for i, x in enumerate(parts) if x in _WORDS and not (in_article and x == "header")]
            if places and not _MODIFIERS.intersection(parts[: places[0]]):
                found.append(("-".join(parts[: places[-1] + 1] if places[0] else parts), len(places) + sum(x in _LAYOUT for x in parts) == len(parts)))
    return name not in _WHOLE and bool(_HIDES.search(attributes)), found


def _listed(marks) -> bool:
    return any(_LISTS.intersection(key.split("-")) for key, _ in marks)


def weigh_names(blocks: list[Block]) -> None:
    """Set ``named``: 0 without a mark by name, 1 with a plain one, else the share of the page's words outside the mark.

    A name on a wrapper of nearly the whole text, or on each of its paragraphs, thus says nothing about its blocks.
    Words in furniture or under plain names aren't of the page's text.
    """
    own = [b for b in blocks if not b.furniture and not any(plain for _, plain in b.marks)]
    total = sum(b.words for b in own)
    held: dict[str, int] = {}
    for b in own:
        for key in {key for key, _ in b.marks}:
            held[key] = held.get(key, 0) + b.words
    for b in blocks:
        b.named = max((1.0 if plain or not total else 1 - held.get(key, 0) / total for key, plain in b.marks), default=0.0)


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, tuple]] = []  # element, and furniture and article depth and marks by name inside it
    parts: list[str] = []
    linked: list[str] = []
    furniture = article = heading = link = 0
    marks: tuple = ()
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(1.0, n / len(words)), int(furniture > 0), int(article > 0), heading, marks))
            parts, linked = [], []

    def text(piece: str) -> None:
        parts.append(piece)
        if link:
            linked.append(piece)

    for m in _TAG.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing = name.lower(), m[2] == "/"
        if name == "a":
            if closing and link:
                linked.append(" ")
            link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        barred, names = _marks(name, m[4], article > 0) if not closing and m[4] and name not in _VOID else (False, [])
        marked = barred or bool(names) and name not in _WHOLE
        if name not in _BLOCK and not marked and not (closing and any(s[0] == name for s in stack)):
            continue
        flush()
        heading = int(not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit())
        if name == "p" or not closing and name in _BLOCK:  # ends a paragraph that is open
            top = len(stack)
            while top and stack[top - 1][0] not in _BLOCK:
                top -= 1
            if top and stack[top - 1][0] == "p":
                del stack[top - 1 :]
                furniture, article, marks = stack[-1][1:] if stack else (0, 0, ())
        if name in _VOID or name == "p" and not marked:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            body = name == "main" or bool(_BODY.search(m[4]))
            if body or name == "article" and not _listed([*marks, *names]):
                inside: tuple = ()
            else:
                inside = marks if name in _WHOLE else (*marks, *names)
            is_furniture = barred or name in _FURNITURE and not (name == "header" and article)
            stack.append((name, int(furniture + is_furniture), int(article + (name in _ARTICLE or body)), inside))
        furniture, article, marks = stack[-1][1:] if stack else (0, 0, ())
        link = 0
    if at < len(page):
        tail = page[at:]
        text(tail[: tail.rfind("<")] if "<" in tail and ">" not in tail[tail.rfind("<") :] and re.match(r"<[/!a-zA-Z]", tail[tail.rfind("<") :]) else tail)
    flush()
    weigh_names(out)
    return out


def vectors(blocks: list[Block]) -> list[tuple]:
    """The features of each block, neighbours included (0 words and links beyond either end).

    ``article`` is -1 for blocks outside of the article or main element that a page has.
    """
    ends = Block("", 0, 0.0, 0, 0, 0)
    around = [ends, ends, *blocks, ends, ends]
    plain = [b.words if b.links < 0.34 else 0 for b in around]
    inside = any(b.article and not b.furniture for b in blocks)
    out = []
    for i, b in enumerate(blocks):
        p, n = around[i + 1], around[i + 3]
        near = sum(plain[i : i + 5]) - plain[i + 2]
        marks = len(_MARK.findall(b.text)) / b.words
        at = 1 if b.article else -1 if inside else 0
        out.append(tuple(map(float, (
            b.words, b.links, p.words, p.links, n.words, n.links, near, marks, b.furniture, b.named, at, b.heading,
        ))))
    return out


def table_rows(pages: list[list[tuple[int | None, str]]]) -> list[tuple]:
    """Features and label of every block of labelled pages."""
    rows = []
    for page in pages:
        found = blocks_of("".join(markup for _, markup in page))
        labels = [label for label, _ in page if label is not None]
        rows += [(*v, float(label)) for v, label in zip(vectors(found), labels, strict=True)]
    return rows


def labelled_table(spark: SparkSession, seed: int = 1, pages: int = 2000) -> DataFrame:
    """The labelled blocks with their features."""
    columns = zip(*table_rows(page_table.pages(seed, pages)), strict=True)
    return spark.createDataFrame(pa.table(dict(zip([*FEATURES, "label"], map(pa.array, columns), strict=True))))


def fit_tree(labelled: DataFrame, max_depth: int = 9, least_rows: int = 8) -> list[tuple[int, float, int, int, int]]:
    """A decision tree as nodes (feature, threshold, left, right, label); feature -1 marks a leaf."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=least_rows, maxBins=128, seed=1).fit(data)
    nodes: list[tuple] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.numDescendants() == 0:
            nodes[at] = (-1, 0.0, 0, 0, int(node.prediction()))
        else:
            split = node.split()
            nodes[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0)
        return at

    walk(model._java_obj.rootNode())
    return nodes


_FITTED: dict[tuple[int, int], list] = {}


def default_tree(spark: SparkSession, seed: int = 1, pages: int = 2000) -> list[tuple[int, float, int, int, int]]:
    """The tree of the labelled table, fitted once for a seed and size."""
    if (seed, pages) not in _FITTED:
        _FITTED[seed, pages] = fit_tree(labelled_table(spark, seed, pages))
    return _FITTED[seed, pages]


def is_main(tree: list[tuple[int, float, int, int, int]], vector: tuple) -> bool:
    at = 0
    while tree[at][0] >= 0:
        feature, threshold, left, right, _ = tree[at]
        at = left if vector[feature] <= threshold else right
    return tree[at][4] == 1


def main_text(page: str, tree: list[tuple[int, float, int, int, int]]) -> str:
    found = blocks_of(page)
    return "\n\n".join(b.text for b, v in zip(found, vectors(found), strict=True) if is_main(tree, v))


def extract_text(pages: DataFrame, page: str = "html", out: str = "text", tree: list | None = None) -> DataFrame:
    """The rows without ``page``, with ``out``: the main text."""
    tree = tree or default_tree(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (page, out)]
    slot = "_page" + "_" * max(map(len, pages.columns))  # longer than any other name
    slim = pages.select(*rest, F.coalesce(F.col(page), F.lit("")).alias(slot))
    schema = T.StructType([*(slim.schema[c] for c in rest), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p.as_py(), tree) for p in batch.column(slot)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], schema.names)

    return slim.mapInArrow(run, schema)
