"""Main text of web pages: flat text blocks with word counts and link
densities of themselves and their neighbours, classified by a decision tree
trained on a small labelled table."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches
from tessera.llm.html_samples import PAGES

# --- blocks ------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>?", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Elements whose content is not markup, up to their closing tag.
RAW = frozenset("script style noscript textarea title iframe".split())
#: Elements whose text is left out.
HIDDEN = frozenset("template svg math foreignobject object select option head".split())
FOREIGN = frozenset("svg math".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes template".split()) | RAW
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements around an article, and words in class, id or role that name such.
AROUND = frozenset("aside button dialog fieldset footer form menu nav".split())
AROUND_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright dialog disqus footer gdpr legal login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promoted recommended related respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
ARTICLE = frozenset("article main".split())


#: Pieces that may stand beside such a word in a name.
NEUTRAL = frozenset(
    "area bar block box bottom container content group inner item items left link links list panel right section "
    "site slot top wrap wrapper".split())
#: Elements whose class words say how the page is laid out.
WHOLE = frozenset("html body main article".split())


def _names_around(value: str) -> bool:
    """Whether one whole name consists of such words, neutral ones aside."""
    for name in value.split():
        pieces = [x for x in _SPLIT.split(name) if x and not x.isdigit()]
        if AROUND_WORDS.intersection(pieces) and all(x in AROUND_WORDS or x in NEUTRAL for x in pieces):
            return True
    return False


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>?", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    around: bool
    article: bool
    heading: bool


def text_blocks(page: str) -> list[Block]:
    """The flat blocks of a page in order, decoded and with single spaces.

    Unclosed and wrongly nested elements are tolerated: a closing tag closes
    the nearest open element of its name, or nothing.  Class words count
    neither on the page's outer elements nor on one that contains the first
    article or a main element.
    """
    blocks: list[Block] = []
    texts: list[str] = []
    linked: list[bool] = []
    # element, how often around / article / hidden up to it, innermost one named around
    stack: list[tuple[str, int, int, int, int]] = []
    link = heading = 0
    around = article = hidden = mark = 0
    marks = 0
    marked: list[tuple[Block, int]] = []
    lifted: set[int] = set()
    articles = False

    def flush() -> None:
        nonlocal texts, linked
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                n_linked = sum(len(entities.unescape(t).split()) for t, inside in zip(texts, linked) if inside)
                blocks.append(Block(text, len(text.split()), n_linked, around > 0, article > 0, heading > 0))
                if mark:
                    marked.append((blocks[-1], mark))
        texts, linked = [], []

    def leave(i: int) -> None:
        nonlocal around, article, hidden, mark
        around, article, hidden, mark = stack[i - 1][1:] if i else (0, 0, 0, 0)
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            low = n
        if low > at:
            if stack and stack[-1][0] == "head" and not page[at:low].isspace():
                leave(len(stack) - 1)
            if not hidden:
                texts.append(page[at:low])
                linked.append(link > 0)
        if low == n:
            break
        token = _TOKEN.match(page, low)
        if token is None:  # a bare "<" is text
            if not hidden:
                texts.append("<")
                linked.append(link > 0)
            at = low + 1
            continue
        at = token.end()
        name = (token.group(2) or "").lower()
        if not name:
            continue
        closing = bool(token.group(1))
        if name in RAW and not closing:
            flush()
            end = _raw_end(name).search(page, at)
            at = end.end() if end else n
            continue
        if stack and not closing:  # elements that end without a closing tag
            if stack[-1][0] == "head" and name not in IN_HEAD:
                leave(len(stack) - 1)
            elif stack[-1][0] in FOREIGN and name in BLOCK:
                while stack and stack[-1][0] in FOREIGN:
                    leave(len(stack) - 1)
            elif stack[-1][0] == "option" and (name in BLOCK or name in ("option", "optgroup")):
                leave(len(stack) - 1)
        if name in HIDDEN:
            flush()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        leave(i)
                        break
            elif not (name in FOREIGN and token.group(3).rstrip().endswith("/")):
                hidden += 1
                stack.append((name, around, article, hidden, mark))
            continue
        if hidden and name not in BLOCK:
            continue
        if name == "br":
            texts.append(" ")
            linked.append(False)
        if name == "a":
            link = 0 if closing else 1
        if name not in BLOCK:
            continue
        flush()
        if not hidden:
            link = 0
        if name in HEADING and not hidden:
            heading = 0 if closing else 1
        if name in VOID or name == "p":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        if name == "main" or (name == "article" and not articles):
            lifted.update(x[4] for x in stack)
            articles = True
        named = name in AROUND or (name == "header" and not article)
        if not named and token.group(3):
            for key, *values in _ATTRIBUTE.findall(token.group(3)):
                value = next(filter(None, values), "").lower()
                if key.lower() in ("class", "id", "role") and name not in WHOLE and _names_around(value):
                    marks += 1
                    mark = marks
                elif key.lower() == "aria-hidden" and value == "true":
                    named = True
        around, article = around + named, article + (name in ARTICLE)
        stack.append((name, around, article, hidden, mark))
    flush()
    for block, named_by in marked:
        block.around = block.around or named_by not in lifted
    return blocks


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "around", "article", "heading")


def features(blocks: list[Block]) -> np.ndarray:
    """Word count and link density of each block and of the blocks before and
    after it (0 beyond the ends), and the kind of element it lies in."""
    words = np.array([b.words for b in blocks], dtype=float)
    links = np.array([b.linked / b.words for b in blocks])
    pad = lambda x: np.concatenate([[0], x, [0]])
    w, d = pad(words), pad(links)
    kinds = np.array([(b.around, b.article, b.heading) for b in blocks], dtype=float)
    return np.column_stack([words, links, w[:-2], d[:-2], w[2:], d[2:], kinds])


# --- the decision tree ------------------------------------------------------------------

@dataclass
class Tree:
    """Node arrays: feature (-1 at a leaf), threshold, children, prediction."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return self.keep[node]
            value = x[np.arange(len(x)), np.maximum(self.feature[node], 0)]
            down = np.where(value <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)


def labelled_blocks(pages: list[str] = PAGES) -> list[tuple[list[float], float]]:
    """(features, label) of every block of the sample pages."""
    rows = []
    for page in pages:
        blocks = text_blocks(page)
        labels = [1.0 if b.text[0] == "+" else 0.0 for b in blocks]
        rows += [(f.tolist(), y) for f, y in zip(features(blocks), labels)]
    return rows


def train_tree(spark: SparkSession, rows: list[tuple[list[float], float]] | None = None, depth: int = 5) -> Tree:
    """A decision tree fitted on labelled blocks (by default the sample pages)."""
    table = spark.createDataFrame(rows or labelled_blocks(), "f array<double>, label double").coalesce(1)
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, maxBins=64, seed=1).fit(
        table.withColumn("x", array_to_vector("f")))
    nodes: list[list[float]] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at][:2] = [split.featureIndex(), split.threshold()]
            nodes[at][2] = visit(node.leftChild())
            nodes[at][3] = visit(node.rightChild())
        return at
    visit(model._java_obj.rootNode())
    feature, threshold, left, right, keep = map(np.array, zip(*nodes))
    return Tree(feature.astype(int), threshold, left.astype(int), right.astype(int), keep > 0.5)


# --- the operator ---------------------------------------------------------------------

_TEXT = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks of a page, joined by an empty line."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    keep = tree.predict(features(blocks))
    return "\n\n".join(b.text for b, ok in zip(blocks, keep) if ok)


def extract_main_text(spark: SparkSession, pages: DataFrame, tree: Tree | None = None,
                      id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    A null or empty html, or one without a main block, gives an empty text.
    Truncated pages are read to their end; null ids and urls stay null;
    repeated rows get equal texts; other columns are not read.
    """
    bounded_batches(spark)
    tree = tree or train_tree(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=_TEXT.fieldNames())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(run, _TEXT)
