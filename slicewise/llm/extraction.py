"""Main text of HTML pages by a recurrent block labeller.

Method: a page becomes the sequence of its leaf blocks; each block is a vector of its hashed tag path, its hashed
words and a few measurements. A bidirectional LSTM (lstm.py) reads the whole sequence in both directions and says for
every block whether it belongs to the article, so the verdict on a block rests on all of the page.

Training: at most SAMPLE pages of the table (those with the smallest hash of id and content, of at most LARGEST
characters), which is a documented bound; all pages are labelled by the model. Labels come from the pages' own
markup where it says what is what (an `article` or `main` element, and the elements inside it that say otherwise), and
from the same pages set anew in other markup: their paragraphs, links and notices are put into layouts drawn at
random, with the elements, class names and parts that sites use. A table without such pages is learned from layouts alone.

Defined results: a null or empty page has an empty text; a page whose blocks are all refused too; broken markup is
read as far as it makes sense, an element that is never closed ends with its parent; repeated rows are rows; columns
named `text` or `n_chars` are replaced.
"""

from __future__ import annotations

import html
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .html_blocks import FEATURES, blocks, features
from .lstm import Labeller

#: most pages that training looks at, and most characters of one of them
SAMPLE, LARGEST = 200, 50_000
#: layouts drawn for each page of the sample
LAYOUTS = 4
HIDDEN, EPOCHS, BATCH, RATE = 24, 18, 32, 0.02

# Words by which sites name the parts of a page.
NAMES = {
    "article": "article content post entry story main body text blog single page prose".split(),
    "header": "header masthead topbar banner branding site-header logo hero".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs links tabs pagination toc".split(),
    "sidebar": "sidebar related widget side aside recommended popular trending more".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense".split(),
    "notice": "cookie consent notice alert newsletter subscribe popup modal gdpr warning paywall".split(),
    "comments": "comments comment discussion replies reply respond disqus thread".split(),
    "form": "form search login signup contact feedback".split(),
    "share": "share social tags meta tools byline author-box".split(),
    "footer": "footer copyright colophon bottom site-footer legal credits".split(),
}
ARTICLE_TAGS = ("article", "main")
OTHER_TAGS = frozenset(
    "nav header footer aside form button select option label textarea head title fieldset dialog menu".split()
)
OTHER_WORDS = frozenset(w for k, v in NAMES.items() if k != "article" for n in v for w in n.split("-")) - {"site", "more"}
PLACES = ["before", "after"]


def told(path: tuple) -> int:
    """1 if the markup says that a block is of the article, else 0."""
    inside = False
    for name, words in path:
        if name in ARTICLE_TAGS:
            inside = True
        elif name in OTHER_TAGS or OTHER_WORDS.intersection(words):
            return 0
    return int(inside)


class Setter:
    """Sets the texts of a page anew in a layout drawn at random; every block it writes has a known label."""

    def __init__(self, rng: np.random.Generator, paragraphs: list[str], others: list[str]):
        self.rng = rng
        fill = ["One two three, four five.", "Read more", "Six seven eight nine ten eleven twelve."]
        self.paragraphs, self.others = paragraphs or fill, others or fill
        self.words = " ".join(self.paragraphs + self.others).split() or ["word"]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def some(self, low: int, high: int) -> str:
        """A run of words of the page."""
        n = int(self.rng.integers(low, high + 1))
        at = int(self.rng.integers(max(1, len(self.words) - n)))
        return html.escape(" ".join(self.words[at : at + n]))

    def whole(self) -> str:
        return html.escape(self.pick(self.paragraphs))

    def opened(self, part: str, tags: list[str], plain: float = 0.0) -> tuple[str, str]:
        """Start and end of an element that is named after its part, but for a share `plain` of them."""
        tag = self.pick(tags)
        if self.chance(plain):
            return f"<{tag}>", f"</{tag}>"
        name = self.pick(NAMES[part])
        if self.chance(0.4):
            name += self.pick(["-", "_", " ", "-"]) + self.pick([*NAMES[part], "wrap", "box", "inner", "1", "container", "list"])
        attribute = self.pick(["class", "class", "id"])
        return f'<{tag} {attribute}="{name}">', f"</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/{k}">{self.some(1, 4)}</a></li>' for k in range(int(self.rng.integers(low, high + 1)))]
        return "<ul>" + "".join(items) + "</ul>" if self.chance(0.8) else " | ".join(i[4:-5] for i in items)

    def menu(self) -> str:
        a, b = self.pick([("<nav>", "</nav>"), self.opened("menu", ["div", "ul", "nav", "section"])])
        return a + self.links(2, 9) + b

    def header(self) -> str:
        a, b = self.pick([("<header>", "</header>"), self.opened("header", ["div", "header"])])
        title = f"<h1>{self.some(1, 4)}</h1>" if self.chance(0.4) else f"<p>{self.some(1, 8)}</p>"
        return a + title + (self.menu() if self.chance(0.4) else "") + b

    def advert(self) -> str:
        a, b = self.opened("advert", ["div", "aside", "section", "p"] if self.chance(0.9) else ["div"])
        return a + (self.some(2, 25) if "<p" in a or self.chance(0.6) else f"<p>{self.some(3, 30)}</p>") + b

    def notice(self) -> str:
        a, b = self.opened("notice", ["div", "section", "aside"])
        return a + f"<p>{self.some(4, 40)}</p>" + (f"<button>{self.some(1, 3)}</button>" if self.chance(0.6) else "") + b

    def sidebar(self) -> str:
        a, b = self.pick([("<aside>", "</aside>"), self.opened("sidebar", ["div", "aside", "section"])])
        inner = f"<h3>{self.some(1, 4)}</h3>" + (self.links(2, 7) if self.chance(0.6) else f"<p>{self.some(5, 50)}</p>")
        return a + inner + b

    def comments(self) -> str:
        a, b = self.opened("comments", ["div", "section", "ol"])
        items = []
        for _ in range(int(self.rng.integers(1, 7))):
            c, d = self.opened("comments", ["div", "article", "li"])
            by = f"<span>{self.some(1, 2)}</span>" if self.chance(0.5) else f"<h4>{self.some(1, 3)}</h4>"
            items.append(c + by + f"<p>{self.whole() if self.chance(0.5) else self.some(3, 60)}</p>" + d)
        return a + (f"<h3>{self.some(1, 3)}</h3>" if self.chance(0.7) else "") + "".join(items) + b

    def form(self) -> str:
        a, b = ("<form>", "</form>") if self.chance(0.5) else self.opened("form", ["form", "div"])
        field = f"<select><option>{self.some(1, 2)}</option><option>{self.some(1, 2)}</option></select>"
        return a + f"<label>{self.some(1, 4)}</label>" + (field if self.chance(0.4) else "<input>") + f"<button>{self.some(1, 2)}</button>" + b

    def share(self) -> str:
        a, b = self.opened("share", ["div", "ul", "p"])
        return a + self.some(1, 10) + b

    def footer(self) -> str:
        a, b = self.pick([("<footer>", "</footer>"), self.opened("footer", ["div", "footer"])])
        text = "&copy; " * self.chance(0.6) + (self.some(2, 25) if self.chance(0.6) else f"<p>{html.escape(self.pick(self.others))}</p>")
        return a + text + (self.links(1, 5) if self.chance(0.4) else "") + b

    def article(self) -> list[tuple[str, str]]:
        """Paragraphs and other parts of the article, each with what it is."""
        out = []
        if self.chance(0.8):
            out.append(("own", f"<h1>{self.some(1, 10)}</h1>"))
        n = int(self.rng.integers(1, 12)) if self.chance(0.94) else int(self.rng.integers(40, 250))
        at = int(self.rng.integers(len(self.paragraphs)))
        for k in range(n):
            text = html.escape(self.paragraphs[(at + k) % len(self.paragraphs)])
            if self.chance(0.2):
                text = self.some(1, 12)
            kind = self.rng.random()
            if kind < 0.75:
                out.append(("own", f"<p>{text}</p>" if self.chance(0.8) else f"<p><b>{text}<br>"))
            elif kind < 0.82:
                out.append(("own", f"<h{self.pick('234')}>{self.some(1, 8)}</h2>"))
            elif kind < 0.88:
                out.append(("own", f"<ul><li>{self.some(2, 20)}</li><li>{self.some(2, 20)}</li></ul>"))
            elif kind < 0.94:
                out.append(("own", f"<blockquote>{text}</blockquote>"))
            else:
                out.append(("own", f"<p>{text} <a href='/x'>{self.some(1, 4)}</a> {self.some(1, 6)}.</p>"))
            if self.chance(0.08):
                out.append(("other", self.pick([self.advert, self.sidebar, self.share, self.notice, self.form])()))
        return out

    def page(self) -> list[tuple[int, str]]:
        """[(label, piece of markup)]; pieces put together are the page."""
        pieces: list[tuple[int, str]] = [(0, f"<html><head><title>{self.some(1, 9)}</title></head><body>")]
        for part, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.15), (self.sidebar, 0.2)):
            if self.chance(p):
                pieces.append((0, part()))
        wrap = self.opened("article", ["div", "section"], 0.15) if self.chance(0.3) else ("", "")
        a, b = self.pick([("<article>", "</article>"), ("<main>", "</main>"), self.opened("article", ["div", "section", "article", "td"])])
        pieces.append((0, wrap[0] + a))
        pieces += [(int(kind == "own"), part) for kind, part in self.article()]
        within = self.chance(0.3)
        if not within:
            pieces.append((0, b))
        for part, p in ((self.share, 0.3), (self.advert, 0.25), (self.comments, 0.4), (self.sidebar, 0.4), (self.form, 0.2), (self.menu, 0.2)):
            if self.chance(p):
                pieces.append((0, part()))
        pieces.append((0, (b if within else "") + wrap[1]))
        if self.chance(0.85):
            pieces.append((0, self.footer()))
        if self.chance(0.2):
            pieces.append((0, self.pick([self.notice, self.advert])()))
        return [*pieces, (0, "</body></html>")]


#: stands before each block of a set page while its label is read off
_MARK = ("", "")


def labelled(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a set page. Marks in the texts carry the labels through the parser."""
    marked = []
    for label, piece in pieces:
        mark = _MARK[label]
        marked.append("".join(f"{mark}{part}" if part and part[0] != "<" else part for part in _texts(piece)))
    found = blocks("".join(marked))
    labels = np.array([float(_MARK[1] in text) for text, _, _ in found], np.float32)
    clean = [(text.replace(_MARK[0], "").replace(_MARK[1], ""), path, linked) for text, path, linked in found]
    return features([clean])[0], labels


def _texts(piece: str) -> list[str]:
    """Markup cut into tags and texts."""
    out, at = [], 0
    while at < len(piece):
        end = piece.find(">", at) + 1 if piece[at] == "<" else piece.find("<", at)
        end = len(piece) if end <= 0 else end
        out.append(piece[at:end])
        at = end
    return out


def train(pages: list[str], seed: int = 11) -> Labeller:
    """A labeller from a bounded sample of pages."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        labels = np.array([told(path) for _, path, _ in found], np.float32)
        paragraphs = [t for (t, _, _), y in zip(found, labels) if y]
        others = [t for (t, _, _), y in zip(found, labels) if not y]
        if paragraphs:
            xs.append(features([found])[0])
            ys.append(labels)
        setter = Setter(rng, paragraphs, others)
        for _ in range(LAYOUTS):
            x, y = labelled(setter.page())
            xs.append(x)
            ys.append(y)
    for _ in range(max(0, 200 - len(xs))):  # too few pages: layouts with words of no page
        x, y = labelled(Setter(rng, [], []).page())
        xs.append(x)
        ys.append(y)
    return Labeller(FEATURES, HIDDEN, seed).fit(xs, ys, EPOCHS, BATCH, RATE, seed)


def learned(pages: DataFrame, key: str, content: str) -> Labeller:
    """A labeller from at most SAMPLE pages, the same ones whatever the order of rows; trained in one task."""
    some = pages.where(F.length(content).between(1, LARGEST)).select(F.col(content).alias("c"), F.xxhash64(key, content).alias("h"))
    some = some.orderBy("h").limit(SAMPLE).select("c").coalesce(1)

    def fit(batches):
        found = [page for batch in batches for page in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(found).weights)], pa.binary())], ["weights"])

    out = Labeller(FEATURES, HIDDEN, 0)
    rows = some.mapInArrow(fit, "weights binary").collect()
    out.weights = pickle.loads(rows[0][0]) if rows else train([]).weights
    return out


def main_text(found: list[tuple[str, tuple, int]], chosen: np.ndarray) -> str:
    return "\n".join(t for (t, _, _), y in zip(found, chosen) if y)


def extract(pages: DataFrame, key: str = "page_id", content: str = "html", model: Labeller | None = None) -> DataFrame:
    """Rows of `pages` without their content, with text and n_chars."""
    model = model or learned(pages, key, content)
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name not in (content, "text", "n_chars")]
    names = [f.name for f in kept]
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches):
        model = shipped.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high, data, rows in arrays.pieces(column):
                found = [blocks(data[a:b].tobytes().decode("utf-8")) for a, b in zip(rows[:-1], rows[1:])]
                chosen = model.labels(features(found))
                texts = [main_text(f, y) for f, y in zip(found, chosen)]
                columns = [batch.column(k).slice(low, high - low) for k in range(len(names))]
                columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return pages.select(*names, F.col(content)).mapInArrow(run, T.StructType([*kept, *added]))
