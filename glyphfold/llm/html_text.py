"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable: content or not.  Its own features
(tag, words of class and id, text and link length) give a unary potential, a
logistic regression's probability.  Every parent-child pair of elements has a
potential, how much more often than by chance the two states occur together.
Sum-product messages, upward from the leaves and then downward from the root,
give each element's exact marginal; the text of elements that are content with
a probability of one half or more is the main text.

Both potentials are trained from labelled pages: those of
:mod:`glyphfold.llm.labelled_pages` and a sample of at most about
``sample_pages`` pages of the table that mark their article themselves.  In
copies of the latter the marking tags become plain ``div``, so that the model
learns to do without them.

Pages are parsed in Arrow batches; nothing is shuffled.  Parsing and features
take time and memory in proportion to a page's length, however deep it is.

Defined cases: null or empty html has no text; a page without labelled
companions is judged by the shipped pages alone; the sample holds pages up to
``SAMPLE_CHARS`` characters, all pages are judged whole; repeated rows are judged
alike; hidden elements (by tag, ``hidden``, ``aria-hidden``, ``display`` or
``visibility``) have no text, nor has anything inside them; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.llm.dom import Node, is_hidden, parse
from glyphfold.llm.labelled_pages import LABELLED

SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000
#: What one shipped page weighs against one of the sample.
SHIPPED_WEIGHT = 40.0
#: Elements whose text is never shown as prose: evidence, not opinion.
HIDDEN = frozenset(
    "script style head title template noscript svg math canvas object iframe form select button textarea option datalist noembed noframes map audio video".split()
)
#: Of these, elements inside which nothing is prose either.  A form is not one: many pages are a form as a whole, so that
#: its elements are judged by themselves.
COVERING = HIDDEN - {"form"}
#: Elements whose tag says what they are for.
SECTIONS = frozenset("article main section nav aside footer header form menu body".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _bucket(n: int) -> int:
    """None, a few words, a line, more."""
    return sum(n >= limit for limit in (1, 12, 200))


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features of each node, from itself, its ancestors' names and the text below it."""
    chars = [n.chars for n in nodes]
    links = [n.link_chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    inherited: list[frozenset[str]] = []
    nearest: list[frozenset[str]] = []
    found = []
    for i, node in enumerate(nodes):
        named = " ".join(v for k, v in node.attributes.items() if k in ("class", "id", "role", "itemprop", "aria-label"))
        words = {w.lower() for w in _WORD.findall(named)}
        above = inherited[node.parent] if i else frozenset()
        inherited.append(above | {node.tag} | words)
        # The closest element, itself included, that says by name what it is.
        own_names = words | ({node.tag} & SECTIONS)
        nearest.append(frozenset(own_names) if own_names or not i else nearest[node.parent])
        density = 10 * links[i] // max(1, chars[i])
        own = [
            "bias",
            f"tag={node.tag}",
            f"own={_bucket(node.chars)}",
            f"links={min(10, density)}",
            f"parent={nodes[node.parent].tag if i else ''}",
        ]
        found.append(own + [f"near={w}" for w in sorted(nearest[i])] + [f"in={w}" for w in sorted(above)])
    return found


def scores(nodes: list[Node], weights: dict[str, float]) -> list[float]:
    """The summed weights of :func:`features`, in one addition for each name that a node is the first to have on its path."""
    chars = [n.chars for n in nodes]
    links = [n.link_chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    on_path: Counter[str] = Counter()
    path: list[tuple[int, frozenset[str]]] = []
    near: list[float] = []
    below: list[float] = []  # what a node's children get from the names on their path
    out = []
    for i, node in enumerate(nodes):
        while path and path[-1][0] != node.parent:
            on_path.subtract(path.pop()[1])
        named = " ".join(v for k, v in node.attributes.items() if k in ("class", "id", "role", "itemprop", "aria-label"))
        words = {w.lower() for w in _WORD.findall(named)}
        above = below[node.parent] if i else 0.0
        mine = frozenset(words | {node.tag})
        below.append(above + sum(weights.get(f"in={w}", 0.0) for w in sorted(mine) if not on_path[w]))
        on_path.update(mine)
        path.append((i, mine))
        own_names = words | ({node.tag} & SECTIONS)
        near.append(sum(weights.get(f"near={w}", 0.0) for w in sorted(own_names)) if own_names or not i else near[node.parent])
        own = (
            "bias",
            f"tag={node.tag}",
            f"own={_bucket(node.chars)}",
            f"links={min(10, 10 * links[i] // max(1, chars[i]))}",
            f"parent={nodes[node.parent].tag if i else ''}",
        )
        out.append(sum(weights.get(name, 0.0) for name in own) + near[i] + above)
    return out


@dataclass(frozen=True)
class Model:
    """``weights`` by feature for being content; ``pairs[parent state][child state]``."""

    weights: dict[str, float]
    pairs: list[list[float]]


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Probability of each node to be content: sum-product on the tree of nodes."""
    unary: list[tuple[float, float]] = []
    covered: list[bool] = []
    for node, score in zip(nodes, scores(nodes, model.weights), strict=True):
        # What a hidden element holds is as hidden as itself.
        under = covered[node.parent] if node.parent >= 0 else False
        covered.append(under or node.tag in COVERING or is_hidden(node.attributes))
        chance = 0.0 if covered[-1] or node.tag in HIDDEN else 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        unary.append((1 - chance, chance))
    (p00, p01), (p10, p11) = model.pairs
    n = len(nodes)
    below = [list(u) for u in unary]  # unary times the messages of the children
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        off, on = below[i]
        total = off + on
        off, on = off / total, on / total
        message = (p00 * off + p01 * on, p10 * off + p11 * on)
        up[i] = message
        parent = below[nodes[i].parent]
        parent[0] *= message[0]
        parent[1] *= message[1]
        scale = parent[0] + parent[1]
        parent[0] /= scale
        parent[1] /= scale
    beliefs = [tuple(below[0])] + [(0.0, 0.0)] * (n - 1)
    for i in range(1, n):
        above, sent = beliefs[nodes[i].parent], up[i]
        off, on = above[0] / sent[0], above[1] / sent[1]
        here = below[i]
        a = here[0] * (p00 * off + p10 * on)
        b = here[1] * (p01 * off + p11 * on)
        beliefs[i] = (a / (a + b), b / (a + b))
    return [on / (off + on) for off, on in beliefs]


def main_blocks(source: str | None, model: Model) -> list[str]:
    nodes, blocks = parse(source or "")
    if not blocks:
        return []
    chance = marginals(nodes, model)
    return [b.text for b in blocks if chance[b.node] >= 0.5]


# ---- training


def labels_by_mark(nodes: list[Node]) -> list[int]:
    """Labels of a page whose elements carry ``data-main`` 1 or 0; children inherit."""
    labels = [0] * len(nodes)
    for i, node in enumerate(nodes):
        inherited = labels[node.parent] if i else 0
        labels[i] = int(node.attributes["data-main"]) if "data-main" in node.attributes else inherited
    return labels


#: Elements inside an article that are not part of it.
ASIDE = frozenset("nav aside footer form menu".split()) | HIDDEN


def labels_by_article(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that has one ``article``: what is inside, without :data:`ASIDE`; else None."""
    if sum(n.tag == "article" for n in nodes) != 1:
        return None
    labels = [0] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        labels[i] = int(node.tag == "article" or (labels[node.parent] == 1 and node.tag not in ASIDE))
    return labels


def without_marks(nodes: list[Node]) -> list[Node]:
    """The same tree with the tags that mark regions made plain."""
    plain = frozenset("article main section nav aside footer header".split())
    return [Node("div" if n.tag in plain else n.tag, n.parent, n.attributes, n.chars, n.link_chars) for n in nodes]


def fit(
    pages: list[tuple[list[Node], list[int], float]], steps: int = 600, rate: float = 0.5, penalty: float = 1e-4
) -> Model:
    """Logistic weights by gradient steps (each with its own scale), pair potentials by counting.

    ``pages`` are (nodes, labels, weight of the page).
    """
    names: dict[str, int] = {}
    rows, columns, labels, weighed, pairs = [], [], [], [], np.ones((2, 2))
    for nodes, marks, page_weight in pages:
        for node, mark, named in zip(nodes, marks, features(nodes), strict=True):
            if node.tag in HIDDEN or node.tag == "#root":
                continue
            rows += [len(labels)] * len(named)
            columns += [names.setdefault(name, len(names)) for name in named]
            labels.append(mark)
            weighed.append(page_weight)
        for node, mark in zip(nodes[1:], marks[1:], strict=True):
            if node.tag not in HIDDEN:
                pairs[marks[node.parent], mark] += page_weight
    y, r, c, share = np.array(labels, float), np.array(rows), np.array(columns), np.array(weighed) / sum(weighed)
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(steps):
        score = np.bincount(r, weights=weights[c], minlength=len(y))
        error = (1 / (1 + np.exp(-score)) - y) * share
        gradient = np.bincount(c, weights=error[r], minlength=len(names)) + penalty * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    joint = pairs / pairs.sum()
    lift = joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))
    return Model({name: float(weights[i]) for name, i in names.items() if abs(weights[i]) > 1e-4}, lift.tolist())


def train_model(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """From the shipped labelled pages and a sample of self-marked ones, brought to the driver."""
    labelled = []
    for source in LABELLED:
        nodes, _ = parse(source)
        marks = labels_by_mark(nodes)
        bare = [Node(n.tag, n.parent, {k: v for k, v in n.attributes.items() if k != "data-main"}, n.chars, n.link_chars) for n in nodes]
        labelled += [(bare, marks, SHIPPED_WEIGHT), (without_marks(bare), marks, SHIPPED_WEIGHT)]
    total = pages.count()
    if total:
        share = min(1.0, 1.2 * sample_pages / total) * 1_000_003
        chosen = pages.filter(F.pmod(F.xxhash64(id_col, html_col), F.lit(1_000_003)) < share).filter(
            F.col(html_col).isNotNull() & (F.length(html_col) <= SAMPLE_CHARS) & F.contains(html_col, F.lit("<article"))
        )
        # A top-k by a hash: the same pages however the table is dealt to tasks.
        for row in chosen.orderBy(F.xxhash64(id_col, html_col), html_col).select(html_col).limit(sample_pages).collect():
            nodes, _ = parse(row[0])
            marks = labels_by_article(nodes)
            if marks is not None:
                labelled += [(nodes, marks, 1.0), (without_marks(nodes), marks, 1.0)]
    return fit(labelled)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks) for each row."""
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            T.StructField(url_col, pages.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("n_blocks", T.LongType()),
        ]
    )
    # Bounded by the features of the training sample.
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(source.as_py(), shared.value) for source in batch.column(2)]
            texts = ["\n\n".join(f) for f in found]
            columns = [
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(f) for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages, train_model(pages)).select("page_id", "url", "text", "n_chars")
