"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks: runs of text between block-level tags. The features of a block are the words in it and the share
of words inside links, the same of the block before and after, whether a heading or a long block without links came before and one comes
after, the kind of its tag, a copyright sign, and the mark of the part of the page that it stands in. A decision tree, trained on
the labelled table of labelled_pages before the pages are read, keeps the blocks of the main text. Its upper DENSE levels look at words, links and
neighbours only, so these sort out pages without marks too; marks and the rest refine below.

The mark of a part is its tag's or its class's, id's or role's: parts that hold no main text and parts that do. Inside a part without
main text everything is; a class that says both says nothing, nor does one whose element holds the page's first heading, as a wrapper.

Scripts, styles, comments of the markup, the head and form controls are never text. Pages are read whole, truncated ones too (an
unfinished tag at the end is no text), in time linear in their length and nesting. Null and empty pages give an empty text. Repeated
rows and rows without a page_id give a result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import html as markup
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read
from .labelled_pages import PAGES

SILENT = "script|style|template|noscript|svg|math|iframe|object|select|textarea|button|title|audio|video|canvas"
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{SILENT})\b[^>]*+>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that can stay open around blocks; a `p` ends with the next block.
HOLDER = BLOCK - frozenset("p hr html body head h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = frozenset("nav aside footer form menu dialog".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Words of class, id and role that mark parts without main text, always or unless another class says otherwise, and parts with it.
NEVER = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|newsletter|subscribe|signup|comments?|respond|replies|disqus\w*|complementary|contentinfo)(?:$|[_-])", re.I)
RARELY = re.compile(r"(?:^|[_-])(?:promo\w*|banner|notice|popup|modal|alert|login|search|share|sharing|social|related|recommended|widget|tags?)(?:$|[_-])", re.I)
MAIN = re.compile(r"(?:^|[_-])(?:article|content|post|entry|story|main)(?:$|[_-])", re.I)
#: Words of a long block, whose links are less than THIN of it.
LONG, THIN = 15, 0.3
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "long_before", "long_after", "headed", "heading", "item", "paragraph", "sign", "mark")
#: The features that the upper levels of the tree see, how many levels these are, and how many there are at most.
DENSITIES, DENSE, DEPTH = 9, 3, 14
#: Blocks of a leaf at least; pages that are made of each page of the labelled table.
LEAF, VARIANTS = 4, 64
TEXTS = "page_id long, url string, text string"


def mark_of(tag: str, more: str) -> int:
    """What an element says about its part: -1 for no main text, 1 for main text, 0 for nothing."""
    names = [x for group in NAMED.findall(more) for part in group for x in part.split()]
    rarely, main = any(map(RARELY.search, names)), tag in ("article", "main") or any(MAIN.search(x) and not RARELY.search(x) for x in names)
    if tag in APART or any(map(NEVER.search, names)):
        return -1
    return main - rarely


class Reader:
    """Collects the blocks of a page, each with its tag and the element that it stands in."""

    def __init__(self):
        self.blocks: list[tuple[str, int, float, str, bool, int]] = []
        self.parts: list[tuple[str, bool]] = []
        self.in_link, self.tag = False, ""
        #: Elements that were opened: name, parent, own mark, whether the tag itself says it, first block.
        self.elements: list[list] = [["", 0, 0, True, 0]]
        self.open_: list[int] = [0]
        self.open_names: Counter = Counter()
        self.title = -1

    def close(self) -> None:
        if not self.parts:
            return
        text = " ".join(markup.unescape("".join(p for p, _ in self.parts)).split())
        if text:
            linked = len(markup.unescape(" ".join(p for p, link in self.parts if link)).split())
            words = len(text.split())
            self.blocks.append((text, words, min(1.0, linked / words), self.tag, self.open_names["li"] > 0, self.open_[-1]))
            if self.tag == "h1" and self.title < 0:
                self.title = self.open_[-1]
        self.parts.clear()

    def block_tag(self, name: str, end: bool, more: str) -> None:
        self.close()
        self.tag, self.in_link = "" if end else name, False
        if name not in HOLDER:
            return
        if not end:
            self.elements.append([name, self.open_[-1], mark_of(name, more), name in APART, len(self.blocks)])
            self.open_.append(len(self.elements) - 1)
            self.open_names[name] += 1
        elif self.open_names[name]:
            while True:
                gone = self.elements[self.open_.pop()][0]
                self.open_names[gone] -= 1
                if gone == name:
                    break

    def marks(self) -> list[int]:
        """Each element's mark: its own, unless it lies in a part without main text; what says nothing says what is around it."""
        wraps, e = set(), self.title
        while e > 0:
            wraps.add(e)
            e = self.elements[e][1]
        out = [0]
        for i, (_, parent, own, by_tag, _) in enumerate(self.elements[1:], 1):
            own = 0 if own < 0 and not by_tag and i in wraps else own
            out.append(-1 if out[parent] < 0 or own < 0 else own or out[parent])
        return out


def read_page(page: str) -> Reader:
    r, at = Reader(), 0
    for m in TAG.finditer(page):
        if m.start() > at:
            r.parts.append((page[at : m.start()], r.in_link))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                r.parts.append((" ", False))
        elif name == "a":
            r.in_link = not m["end"]
        elif name == "br":
            r.parts.append((" ", False))
        elif name in BLOCK:
            r.block_tag(name, bool(m["end"]), m["more"])
    if at < len(page):
        r.parts.append((page[at:], r.in_link))
    r.close()
    return r


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """Text and features of each block, in page order; blocks without a character that shows are left out."""
    r = read_page(page or "")
    marks, n = r.marks(), len(r.blocks)
    long = [b[1] >= LONG and b[2] < THIN for b in r.blocks]
    heading = [b[3] in HEADINGS for b in r.blocks]
    last = max((i for i in range(n) if long[i]), default=-1)
    out, seen, headed = [], False, False
    for i, (text, words, links, tag, item, element) in enumerate(r.blocks):
        _, w0, l0, *_ = r.blocks[i - 1] if i else ("", 0, 0.0)
        _, w1, l1, *_ = r.blocks[i + 1] if i + 1 < n else ("", 0, 0.0)
        headed |= heading[i]
        row = (words, links, w0, l0, w1, l1, seen, i < last, headed, heading[i], item, tag in ("p", "blockquote", "pre", "dd"), "©" in text, marks[element])
        out.append((text, [float(x) for x in row]))
        seen |= long[i]
    return out


def best_cut(x: np.ndarray, y: np.ndarray, features: range) -> tuple[int, float] | None:
    """The feature and threshold of least Gini impurity that leave LEAF blocks on either side; None if none lowers it."""
    n, total = len(y), y.sum()
    best, cost = None, total * (n - total) / n - 1e-9
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, low = x[order, f], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        impurity = low * (size - low) / size + (total - low) * (n - size - total + low) / (n - size)
        impurity[(v[1:] == v[:-1]) | (size < LEAF) | (n - size < LEAF)] = np.inf
        i = int(np.argmin(impurity)) if n > 1 else 0
        if n > 1 and impurity[i] < cost:
            best, cost = (f, float(v[i] + v[i + 1]) / 2), impurity[i]
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0) -> tuple:
    """A decision tree: (share,) or (feature, threshold, tree below or at it, tree above).

    Down to DENSE levels only the first DENSITIES features are tried, if one of them parts the labels at all, and then the mark for two.
    """
    stages = [range(DENSITIES)] * (depth < DENSE) + [range(len(FEATURES) - 1, len(FEATURES))] * (DENSE <= depth < DENSE + 2) + [range(x.shape[1])] * (depth < DEPTH)
    best = next((b for b in (best_cut(x, y, features) for features in stages) if b), None)
    if best is None:
        return (float(y.mean()),)
    low = x[:, best[0]] <= best[1]
    return (*best, grow(x[low], y[low], depth + 1), grow(x[~low], y[~low], depth + 1))


def decide(tree: tuple, features: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def variant(line: str, factors: Iterator[float], bare: bool) -> str:
    """A chunk of the labelled table with filler of other lengths, or also without the tags and names that mark parts."""
    word = "main" if line[0] == "+" else "rest"
    text = re.sub(r"\{(\d+)\}", lambda m: " ".join([word] * max(1, round(int(m[1]) * next(factors)))), line[2:])
    if bare:
        text = re.sub(r"<(/?)(?:nav|footer|article|aside|header|main|section|form)\b[^>]*>", r"<\1div>", text)
        text = re.sub(r'(<\w+)(?: (?:class|id|role)="[^"]*")+', r"\1", text)
    return text


@functools.lru_cache(maxsize=2)
def labelled(pages: str = PAGES, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of some pages for each of the table's: itself, and every other one without marks.

    Fillers carry the label, so a block of a page says its own.
    """
    rng, x, y = np.random.default_rng(5), [], []
    factors = iter(lambda: float(np.exp(rng.normal(0, 0.7))), None)
    for page in pages.strip().split("\n\n"):
        for i in range(variants):
            for text, features in blocks("".join(variant(line, factors if i > 1 else itertools.repeat(1.0), i % 2 == 1) for line in page.splitlines())):
                x.append(features)
                y.append("main" in text)
    return np.array(x), np.array(y, float)


@functools.lru_cache(maxsize=1)
def trained() -> tuple:
    return grow(*labelled())


def main_text(page: str | None, tree: tuple) -> str:
    return "\n\n".join(text for text, features in blocks(page) if decide(tree, features) >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page."""

    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), TEXTS)


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(read(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
