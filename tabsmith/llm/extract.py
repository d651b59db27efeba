"""Main text of HTML pages: gradient-boosted trees score the nodes of a page, hierarchical decoding chooses among them.

The trees are fitted by Spark on a bounded sample of pages whose main text is marked by an article element. Each
sampled page is also rebuilt in other layouts from its own blocks and its neighbours' (other wrappers, menus,
sidebars, notices, comments, forms), so that the model learns attribute words, densities and places besides that
one element. Pages are then independent: no shuffle, one Arrow batch at a time.
"""
from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import require, saved
from tabsmith.llm.dom import FEATURES, Tree, decode, features, labels, nodes_of, text_of

SAMPLE_PAGES = 300
VARIANTS = 4
TREES, DEPTH = 12, 5
SEED = 7
#: Share of the main blocks of a rebuilt page that are cut to a few words, as titles and short lines are.
SHORT = 0.3
WRAPPERS = ("article", "main", "section", 'div class="content"', 'div class="post-content"', 'div id="main"', 'div class="entry"',
            'div class="article-body"', 'div class="story"', 'section class="post"', 'div role="main"', "div")
MENUS = ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="navbar"', 'div class="breadcrumbs"')
EDGES = ("header", "footer", 'div class="header"', 'div id="footer"', 'div class="masthead"', 'div class="site-footer"')
SIDES = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related-posts"', 'section class="recommended"')
NOTES = ('div class="cookie-notice"', 'div id="consent"', 'div class="banner"', 'div class="ad"', 'div class="advert"', 'aside class="promo"',
         'div class="sponsored"', 'div class="newsletter"', 'p class="notice"', 'div class="popup"', 'div class="social-share"', 'p class="byline"')
COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="replies"', 'div id="disqus_thread"')


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: feature (-1: leaf), threshold, left, right, value, one row per node."""

    roots: tuple[int, ...]
    weights: tuple[float, ...]
    nodes: np.ndarray

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Trees:
        rows: list[tuple] = []

        def add(node) -> int:
            at = len(rows)
            if node.subtreeDepth() == 0:
                rows.append((-1, 0.0, at, at, node.prediction()))
                return at
            rows.append(())
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            rows[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            return at

        roots = tuple(add(t._call_java("rootNode")) for t in model.trees)
        return cls(roots, tuple(model.treeWeights), np.array(rows, np.float64))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        feature, left, right = (self.nodes[:, k].astype(np.int64) for k in (0, 2, 3))
        margin, every = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                goes_left = x[every, np.maximum(feature[at], 0)] <= self.nodes[at, 1]
                at = np.where(goes_left, left[at], right[at])
            margin += weight * self.nodes[at, 4]
        return 2 * margin


def _element(kind: str, inner: str, main: int | None = None) -> str:
    return f"<{kind}{'' if main is None else f' data-main={chr(34)}{main}{chr(34)}'}>{inner}</{kind.split()[0]}>"


def rebuilt(blocks: list[str], others: list[str], rng: random.Random) -> str:
    """A page of another layout: ``blocks`` are its main text, ``others`` fill what is around and inside it."""
    def prose() -> str:
        return escape(rng.choice(others)[: rng.choice((40, 120, 400, 4000))])

    def links() -> str:
        items = "".join(f'<li><a href="#">{escape(" ".join(rng.choice(others).split()[:3]))}</a></li>' for _ in range(rng.randint(2, 9)))
        return items if rng.random() < 0.3 else f"<ul>{items}</ul>"

    def comments() -> str:
        own = "".join(_element(rng.choice(('div class="comment"', "li", "p", "article")), f"<p>{prose()}</p>") for _ in range(rng.randint(1, 6)))
        return _element(rng.choice(COMMENTS), rng.choice(("", "<h3>%s</h3>" % prose()[:30])) + own, 0)

    def extra() -> str:
        kind = rng.random()
        if kind < 0.3:
            return _element(rng.choice(SIDES), rng.choice(("", f"<h3>{prose()[:30]}</h3>")) + rng.choice((links(), f"<p>{prose()}</p>")), 0)
        if kind < 0.65:
            return _element(rng.choice(NOTES), rng.choice((prose(), f"<p>{prose()}</p>", f'<a href="#">{prose()[:40]}</a>')), 0)
        if kind < 0.8:
            return _element("form", f"<label>{prose()[:30]}</label><input><p>{prose()[:60]}</p><button>{prose()[:10]}</button>", 0)
        return comments()

    def block(k: int, text: str) -> str:
        tag = "h1" if k == 0 else rng.choice(("p", "p", "p", "p", "p", "p", "blockquote", "h2", "ul", "pre", "div"))
        if tag == "ul":
            words = text.split()
            step = rng.randint(2, 9)
            return f"<ul>{''.join(_element('li', escape(' '.join(words[i : i + step]))) for i in range(0, min(len(words), 8 * step), step))}</ul>"
        if rng.random() < SHORT:
            text = " ".join(text.split()[: rng.randint(1, 4)])
        return _element(tag, escape(text))

    body = [block(k, b) for k, b in enumerate(blocks)]
    for _ in range(rng.choice((0, 1, 2, 3))):
        body.insert(rng.randint(0, len(body)), extra())
    wrapper = rng.choice(WRAPPERS)
    main = _element(wrapper, "".join(body), 1)
    for _ in range(rng.choice((0, 1, 2, 3))):
        main = _element(rng.choice(('div class="wrapper"', 'div id="page"', "div", 'div class="container"')), main)
    before = [_element(rng.choice(EDGES), prose()[:60] + rng.choice(("", links())), 0)] * rng.choice((0, 1))
    before += [_element(rng.choice(MENUS), links(), 0)] * rng.choice((0, 1, 1))
    after = [_element(rng.choice(EDGES), "&copy; " + prose()[:80] + rng.choice(("", links())), 0)] * rng.choice((0, 1, 1))
    around = [extra() for _ in range(rng.choice((0, 1, 2, 3)))]
    cut = rng.randint(0, len(around))
    return "".join([*before, *around[:cut], main, *around[cut:], comments() if rng.random() < 0.3 else "", *after])


def training_rows(htmls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the pages as they are and of their rebuilt forms."""
    pages = []
    for html in htmls:
        nodes = nodes_of(Tree(html).root)
        truth = labels(nodes)
        main = text_of(nodes, truth > 0).split("\n\n")
        pages.append((html, main, [t for t in text_of(nodes, truth == 0).split("\n\n") if t]))
    for k, (html, main, _) in enumerate(pages):
        rng = random.Random(SEED * 1_000_003 + k)
        _, near, rest = pages[(k + 1) % len(pages)]
        forms = [html] + [rebuilt(main, [*near, *rest], rng) for _ in range(VARIANTS)]
        for form in forms:
            nodes = nodes_of(Tree(form).root)
            yield features(nodes), labels(nodes)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Trees | None:
    """Fits on at most ``sample`` pages with one article element, those of smallest hash; None without any."""
    marked = (F.regexp_count("html", F.lit(r"(?i)<article\b")) == 1) & (F.regexp_count("html", F.lit(r"(?i)</article>")) == 1)
    key = F.xxhash64("page_id", "url")
    chosen = pages.filter(marked).select(key.alias("key")).distinct().orderBy("key").limit(sample)
    rows = pages.withColumn("key", key).join(F.broadcast(chosen), "key", "left_semi").filter(marked).select("key", "html")
    rows = rows.groupBy("key").agg(F.min("html").alias("html"))  # repeated rows once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((k, h) for b in batches for k, h in zip(b["key"].to_pylist(), b["html"].to_pylist(), strict=True))
        for x, y in training_rows([h for _, h in found]):
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_pydict({"x": flat, "label": pa.array(y)})

    table = saved(rows.coalesce(1).mapInArrow(run, "x array<double>, label double"))
    if table.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=64)
    return Trees.of(trees.fit(table.select(array_to_vector("x").alias("features"), "label")))


def extract_text(pages: DataFrame, model: Trees | None) -> DataFrame:
    """page_id, url, text (the main text; empty if there is none), n_chars (its code points), per row.

    Scripts, styles, form controls and markup never are text; character references are decoded; white space
    inside a block becomes one space and blocks are joined by two line feeds. Null and empty pages give an empty
    text. Without a model all text of a page is taken. Repeated rows, null ids and null URLs stay as they are.
    """
    require(pages, "page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, shared.value) for html in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def main_text(html: str | None, model: Trees | None) -> str:
    nodes = nodes_of(Tree(html or "").root)
    odds = np.full(len(nodes), 1.0) if model is None else model.log_odds(features(nodes))
    return text_of(nodes, decode(nodes, odds))


assert len(FEATURES) == 7 + 15 + 13
