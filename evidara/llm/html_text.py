"""Main text of HTML pages: flat text blocks judged by a decision tree over word counts and link densities.

Blocks are the runs of text between block-level tags. A block is described by its word count and link
density and by those of the blocks before and after it, by whether it is a heading, and by what its containers say they are.
The tree is grown on a small labelled table, the blocks of typical page layouts, with and without such
containers: it learns to read link lists and lone short lines as furniture also inside a named article, and to trust a doubtful name only where the
words agree. A page is read once, from tag to tag, in time that grows with its length alone: quotes count where
an attribute's value begins, and no tag, quote or end that is missing is looked for twice."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidara.llm.session import plain, prepare, table

#: Tags that end a block, tags whose content is no text, containers of page furniture or of the article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template iframe svg math object select datalist textarea button title canvas audio video".split())
#: Of those, the ones that run to the end of the page if they are not closed.
RAW_TAGS = frozenset("script style".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the tags named.
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot"),
}
#: Parts of class, id and role names that mark page furniture, for certain or maybe, and articles; names with a part of OTHERWISE say nothing.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus cookie cookies consent gdpr popup modal newsletter subscribe pagination pager widget login signup contentinfo complementary".split()
)
MAYBE_FURNITURE = frozenset("banner promo share sharing social related recommend recommended recommendations search copyright legal notice header tags toolbar form reply replies respond".split())
ARTICLE = frozenset("article content entry post story main body text".split())
#: Parts that say where or how, and leave a certain name certain; beside any other part it is doubtful (as in menu-of-the-day).
PLACES = frozenset("area bar block bottom box col column container custom desktop global group head header inner item items left link links list mobile module outer page panel primary region right row secondary section site slot top unit wrap wrapper".split())
OTHERWISE = frozenset("no has with without hide show is".split())
#: Comments, other declarations, tags (slash, name, attributes) and text, by the states of an HTML tokenizer. A quote that is not closed belongs to its tag up to the next >.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?=[^a-zA-Z])[^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+)>?|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LINK = re.compile(r"^[\s/]*$|(?<![\w-])href\s*=", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "furniture", "article")
#: The layouts behind the labelled table: kinds of blocks in page order, by hand.
LAYOUTS = (
    "menu menu menu slogan headline para para short para footer",
    "menu menu menu menu ad headline para para para links links links footer footer",
    "slogan menu menu crumb headline short para quote para item item item para comment comment footer",
    "menu menu notice headline para head para para head item item para sidebar sidebar links links footer",
    "slogan form menu menu menu headline para para short quote para para para tagline footer footer",
    "menu menu headline short short para para short footer menu menu",
    "crumb headline para item item item item item para comment form comment footer",
    "menu menu menu head links links links head links links links footer",
    "headline para para",
    "para",
    "para para para",
    "headline short short short",
    "short",
    "head item item item para",
    "menu menu title para short short links links footer",
    "menu menu menu title para para quote links links links footer",
    "slogan menu title short para quote short menu menu footer",
    "menu title para para short tagline footer",
    "menu menu headline short links links",
    "menu quote menu menu",
    "lone",
    "menu menu menu permalink para para short links links footer",
    "permalink para item item para",
    "headline para links links links para para links links links links",
    "menu menu headline para head links links para comment comment footer",
    "menu menu headline line para line line para line item line footer footer",
    "slogan menu line headline line line line short line line tagline footer",
    "menu menu menu line para line para links links",
    "headline line para line",
    "menu line menu",
    "line line line",
    "menu menu headline para para short",
    "menu headline para quote footer",
    "slogan menu menu headline para short para line",
    "menu menu headline para links short",
    "headline para links quote links para line",
)
#: So many layouts more are drawn for each style; a leaf of the tree holds so many blocks at least.
DRAWN, LEAF = 300, 8
#: What is drawn before the article, in it and after it.
BEFORE, INSIDE, AFTER = "menu menu menu slogan crumb notice ad form", "para para para short line line item quote head links", "links links comment sidebar ad form tagline footer footer"
#: Words (drawn between the least and the most) and link densities of a kind of block, and whether it is text of the article.
KINDS = {
    "lone": ((1, 3, 2, 5), (0.0,), 1),
    "menu": ((1, 2, 1, 3), (1.0,), 0),
    "slogan": ((3, 6, 4), (0.0,), 0),
    "crumb": ((5, 7), (0.8, 0.7), 0),
    "ad": ((8, 14, 20), (0.0, 0.3), 0),
    "notice": ((18, 35), (0.05, 0.0), 0),
    "form": ((2, 5), (0.0,), 0),
    "headline": ((8, 13, 5), (0.0,), 1),
    "title": ((3, 2, 4), (0.0,), 1),
    "permalink": ((6, 3, 9), (1.0,), 1),
    "head": ((3, 5, 2), (0.0,), 1),
    "para": ((45, 90, 28, 150, 60), (0.0, 0.05, 0.1, 0.0), 1),
    "line": ((1, 2, 3, 1, 4, 2, 7, 5), (0.0, 0.0, 0.1), 1),
    "short": ((9, 14, 18, 6), (0.0,), 1),
    "quote": ((16, 24), (0.0,), 1),
    "item": ((4, 9, 12, 6), (0.0, 0.25), 1),
    "links": ((6, 9, 4, 11), (1.0, 0.9), 0),
    "tagline": ((4, 7), (1.0, 0.6), 0),
    "sidebar": ((12, 30, 8), (0.0, 0.4), 0),
    "comment": ((15, 40, 70, 9), (0.0,), 0),
    "footer": ((4, 8, 3, 10), (0.3, 0.6, 0.0), 0),
}
#: Kinds that only their containers tell apart from the article.
NEEDS_NAME = frozenset("ad notice sidebar comment form".split())


#: How layouts are named: the mark of furniture that needs a name, of other furniture and of the article's text (2 certain, 1 maybe), and what lies in a named article.
STYLES = {
    "certain": (2, 2, 0, "text"),
    "wrapped": (2, 2, 0, "page"),
    "maybe": (2, 1, 0, ""),
    "misnamed": (2, 2, 1, "text"),
    "around": (2, 1, 1, "page"),
    "loose": (0, 0, 0, "page"),
    "bare": (0, 0, 0, ""),
}


def drawn(rng: random.Random) -> str:
    """A page: some furniture, maybe a headline, the article's blocks (lists of links come in threes), and furniture again."""
    inside = [k for part in rng.choices(INSIDE.split(), k=rng.randint(1, 7)) for k in ([part] * 3 if part == "links" else [part])]
    title = rng.choice(([], ["headline"], ["title"], ["permalink"]))
    return " ".join(rng.choices(BEFORE.split(), k=rng.randint(0, 4)) + title + inside + rng.choices(AFTER.split(), k=rng.randint(0, 4)))


def labelled() -> list[tuple]:
    """The labelled table: FEATURES, then 1 for text of the article.

    Each layout comes in all STYLES: with containers that are certain, with names that may mean furniture, also
    around the article itself (as in a class share-price), and with a named article around its text, around the whole page or
    nowhere. Labels are those of the blocks, whatever the names. Where furniture is not named, kinds that need a name are left out,
    and so are lone short lines where nothing is named at all; where all lies in an article and nothing else is named, furniture is what consists of links."""
    rng = random.Random(0)
    rows = []
    for style, (needy, other, own, inside) in STYLES.items():
        left_out = {"loose": NEEDS_NAME | {"slogan", "crumb", "tagline", "footer"}, "bare": NEEDS_NAME | {"line"}}.get(style, frozenset())
        for layout in [*LAYOUTS, *(drawn(rng) for _ in range(DRAWN))]:
            kinds = [k for k in layout.split() if k not in left_out]
            page = []
            for i, k in enumerate(kinds):
                words, links, label = KINDS[k]
                n, d = rng.randint(min(words), max(words)), rng.choice(links)
                if k == "head" and i + 1 < len(kinds) and kinds[i + 1] == "links":
                    label = 0
                mark = own if label else needy if k in NEEDS_NAME else other
                page.append((n, d, k in ("headline", "title", "head", "permalink"), mark, inside == "page" or inside == "text" and label, label))
            none = (0, 0.0)
            for i, (n, d, h, mark, within, label) in enumerate(page):
                before, after = page[i - 1][:2] if i else none, page[i + 1][:2] if i + 1 < len(page) else none
                rows.append((n, d, *before, *after, int(h), mark, int(within), label))
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14):
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree at most it, tree above it)."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() >= len(y))
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) < min(LEAF, len(y) // 2):
                continue
            score = gini(y[low]) + gini(y[~low])
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(t), low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, t, low = best
    one, other = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return one if one == other and isinstance(one, int) else (f, t, one, other)


def fitted_tree(rows: list[tuple] | None = None):
    table_ = np.array(labelled() if rows is None else rows, dtype=float)
    return grow(table_[:, :-1], table_[:, -1])


def predict(tree, x: np.ndarray) -> np.ndarray:
    """Whether each row is text of the article."""
    return np.array([_label(tree, row) for row in x.tolist()], dtype=bool)


def _label(tree, row: list[float]) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree == 1


def named(attributes: str) -> tuple[int, bool]:
    """What class, id and role say: furniture (2 for certain, 1 maybe, 0 no), and article."""
    furniture, article = 0, False
    for value in ATTRIBUTE.findall(attributes):
        for name in "".join(value).split():
            parts = {p for p in PARTS.split(HUMP.sub("-", name).lower()) if len(p) > 1}
            if parts & OTHERWISE:
                continue
            if parts & FURNITURE:
                furniture = max(furniture, 1 if parts - FURNITURE - MAYBE_FURNITURE - ARTICLE - PLACES else 2)
            elif parts & MAYBE_FURNITURE:
                furniture = max(furniture, 1)
            article = article or bool(parts & ARTICLE)
    return furniture, article


class Container:
    """An open block-level tag: what it says it is, the nearest furniture around it, and the words and articles read before it, then those in it."""

    __slots__ = ("tag", "furniture", "article", "by_name", "outer", "words", "articles", "level")

    def __init__(self, tag: str, furniture: int, article: bool, by_name: bool, outer: Container | None, words: int, articles: int):
        self.tag, self.furniture, self.article, self.by_name, self.outer = tag, furniture, article, by_name, outer
        self.words, self.articles, self.level = words, articles, 0


class Open:
    """The open containers, and by tag where they lie."""

    def __init__(self) -> None:
        self.stack: list[Container] = []
        self.places: dict[str, list[int]] = {}
        self.furniture: list[Container] = []  # all that ever were, outer ones first
        self.words = self.articles = self.within = 0

    def push(self, tag: str, furniture: int, article: bool, by_name: bool) -> None:
        c = Container(tag, furniture, article, by_name, self.nearest(), self.words, self.articles)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(c)
        self.within += article
        if furniture:
            self.furniture.append(c)

    def pop(self) -> None:
        c = self.stack.pop()
        self.places[c.tag].pop()
        self.within -= c.article
        c.words, c.articles = self.words - c.words, self.articles - c.articles

    def end(self, tag: str) -> None:
        """Close the innermost container of a tag and all in it; an end tag without a start does nothing."""
        if self.places.get(tag):
            for _ in range(len(self.stack) - self.places[tag][-1]):
                self.pop()

    def nearest(self) -> Container | None:
        return None if not self.stack else self.stack[-1] if self.stack[-1].furniture else self.stack[-1].outer

    def settle(self) -> None:
        """Close all and tell every furniture's level, its outer ones' if that is higher."""
        while self.stack:
            self.pop()
        for c in self.furniture:
            own = 0 if c.by_name and c.articles and 2 * c.words >= self.words else c.furniture
            c.level = max(own, c.outer.level if c.outer else 0)


def blocks(page: str) -> list[tuple[str, int, int, bool, int, bool]]:
    """(text, words, linked words, is a heading, furniture, article) of each block with text, in page order.

    A form, or a container that only its name marks, which holds the article and half of the page's words or more, is no furniture.
    A link reaches over the blocks in it, but not out of the container it began in."""
    found, text, words, linked = [], [], 0, 0
    around = Open()
    stack = around.stack
    heading, link, at = 0, None, 0  # link: how many containers are around the open link
    missing: set[str] = set()  # tags that have no end in the rest of the page

    def close() -> None:
        nonlocal text, words, linked
        line = SPACE.sub(" ", "".join(text)).strip()
        if line:
            found.append((line, words, linked, heading > 0, around.nearest(), around.within > 0))
        text, words, linked = [], 0, 0

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw[0] == "<" and raw != "<":
                continue
            said = entities.unescape(raw) if "&" in raw else raw
            text.append(said)
            n = len(said.split())
            words += n
            around.words += n
            linked += n * (link is not None)
            continue
        name, closing = name.lower(), bool(m[1])
        if name == "a":
            link = len(stack) if not closing and LINK.search(m[3]) else None
            continue
        if name in BLOCK_TAGS:
            close()
        if name in SILENT_TAGS:
            if not closing and not m[3].endswith("/"):
                end = None if name in missing else re.compile(rf"</{name}(?![a-z])[^>]*>?", re.I).search(page, at)
                if end is None:
                    missing.add(name)
                at = end.end() if end else len(page) if name in RAW_TAGS else at
            continue
        if name in VOID_TAGS:
            continue
        if name in HEADINGS:
            heading = 0 if closing else 1
        if closing:
            around.end(name)
        elif not m[3].endswith("/"):
            if name in BLOCK_TAGS:
                while stack and (stack[-1].tag == "p" or stack[-1].tag in IMPLIED.get(name, ())):
                    around.pop()
            furniture, article = named(m[3]) if m[3] and name not in ("html", "body") else (0, False)
            article = article and not furniture or name in ARTICLE_TAGS
            by_name = True
            if name in FURNITURE_TAGS and not (name == "header" and around.within):
                furniture, by_name = 2, name == "form"
            if name in ARTICLE_TAGS:
                furniture = 0
            if name in BLOCK_TAGS or furniture:
                around.push(name, furniture, article, by_name)
            around.articles += name in ARTICLE_TAGS or name == "h1"
        if link is not None and len(stack) < link:
            link = None
    close()
    around.settle()
    return [(*b[:4], b[4].level if b[4] else 0, b[5]) for b in found]


def features(found: list[tuple[str, int, int, bool, int, bool]]) -> np.ndarray:
    n = np.array([b[1] for b in found], dtype=float)
    d = np.array([b[2] / b[1] if b[1] else 0.0 for b in found])
    x = np.zeros((len(found), len(FEATURES)))
    x[:, 0], x[:, 1] = n, d
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = n[:-1], d[:-1], n[1:], d[1:]
    for k, i in ((6, 3), (7, 4), (8, 5)):
        x[:, k] = [b[i] for b in found]
    return x


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, yes in zip(found, predict(tree, features(found)), strict=True) if yes)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Very long pages are read whole, in time that grows with their length.
    Null and empty pages give the empty text. A script or style that is not closed runs to the end of the page, other tags that are not closed hide
    nothing; character references without a semicolon are decoded as HTML 5 does. Repeated rows each give a row; an empty
    table gives an empty table; other columns are ignored."""
    prepare(pages.sparkSession)
    tree = fitted_tree()

    def run(batches):
        for b in batches:
            texts = [main_text(x, tree) if x else "" for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return plain(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
