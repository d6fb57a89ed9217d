"""Main text of web pages by a graphical model over the tree of a page.

A node is a wrapper of main text, main text, or something else. Its look (tag, names,
length, links) and the state of its parent make it likely to be one or the other;
sum-product messages up and down the tree give the exact marginals, and runs of text
that are more likely main text than not are kept. Trained from labelled pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.dom import HEADINGS, Node, parse
from purchase_insights.llm.labelled_pages import labelled_pages
from purchase_insights.llm.sampling import in_batches

WRAPPER, CONTENT, OTHER = range(3)
#: Tags that say little by themselves. Siblings of one kind look alike, so that their
#: number counts for less than independent evidence would.
PLAIN = frozenset(("#", *(f"<{tag}>" for tag in "p div section ul ol li h1 h td tr table tbody blockquote hr".split())))
PLAIN_WEIGHT = 0.3
PART = re.compile(r'data-part="(\w+)"')


class Model(NamedTuple):
    weights: dict[str, tuple[float, float, float]]  # of a feature, for each state
    prior: tuple[float, float, float]
    passed_on: list[list[float]]  # [state of the parent][state of the child]


def features(node: Node, parent_tag: str) -> tuple[str, ...]:
    size, linked = min(node.size.bit_length(), 6), node.linked * 4 // max(node.size, 1)
    if node.tag == "#":
        kind = "heading" if parent_tag in HEADINGS else "li" if parent_tag == "li" else "text"
        return ("#", f"# size {size}", f"# links {linked}", f"# in {kind}", *(["# bare"] if node.bare else []))
    tag = "h" if node.tag in HEADINGS and node.tag != "h1" else node.tag
    look = (f"size {size}", f"links {linked}") if tag in ("div", "section", "ul", "ol", "li", "p") else ()
    return (f"<{tag}>", *(f"{'s' if tag == 'p' else ''}{x}" for x in look), *sorted(f"name {n}" for n in node.names()))


def train(pages: list[str], steps: int = 400, rate: float = 0.05) -> Model:
    """Fit looks by softmax regression, and how states pass from parent to child by counting."""
    seen: Counter[tuple[tuple[str, ...], int]] = Counter()
    passed_on = np.ones((3, 3)) * [[1, 1, 1], [0.02, 1, 1], [0.02, 0.02, 1]]
    for page in pages:
        nodes, states = parse(page), []
        holds = [False] * len(nodes)
        for i, node in enumerate(nodes):
            mark = PART.search(node.attributes)
            inherited = states[node.parent] if i else None
            state = {"content": CONTENT, "other": OTHER}.get(mark[1]) if mark else inherited
            states.append(state)
            if state == CONTENT:
                k = node.parent
                while k >= 0 and not holds[k]:
                    holds[k] = True
                    k = nodes[k].parent
        for i, node in enumerate(nodes):
            if states[i] is None:
                states[i] = WRAPPER if holds[i] and node.tag != "#" else OTHER
            if i:
                passed_on[states[node.parent], states[i]] += 1
                seen[features(node, nodes[node.parent].tag), states[i]] += 1
    names = sorted({f for look, _ in seen for f in look})
    column = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for row, (look, _) in enumerate(seen):
        x[row, [column[f] for f in look]] = 1
    y = np.eye(3)[[state for _, state in seen]]
    share = np.array(list(seen.values()), float)[:, None] / seen.total()
    weights = np.zeros((len(names), 3))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        p = np.exp(x @ weights)
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (share * (p - y)) + 1e-7 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        # a rare name learns as fast as a common tag
        weights -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    prior = (share * y).sum(axis=0)
    passed_on = np.sqrt(passed_on / passed_on.sum(axis=1, keepdims=True))  # siblings are alike here too
    return Model(
        {f: tuple(map(float, weights[k])) for f, k in column.items()},
        tuple(map(float, prior)),
        (passed_on / passed_on.sum(axis=1, keepdims=True)).tolist(),
    )


class Extractor:
    """Marginals and texts of pages under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.looks: dict[tuple[str, ...], tuple[float, float, float]] = {}

    def look(self, found: tuple[str, ...]) -> tuple[float, float, float]:
        """How likely a look is in each state, up to a common factor."""
        known = self.looks.get(found)
        if known is None:
            z = np.sum([self.model.weights[f] for f in found if f in self.model.weights] or [(0.0, 0.0, 0.0)], axis=0)
            p = np.exp(z - z.max())
            p = np.maximum(p / p.sum(), 1e-9) / self.model.prior
            if found[0] in PLAIN and not any(f.startswith("name ") for f in found):
                p **= PLAIN_WEIGHT
            if found[0] == "#":
                p[WRAPPER] = 0.0  # text wraps nothing
            known = tuple(map(float, p / p.sum()))
            if len(self.looks) > 100_000:
                self.looks.clear()
            self.looks[found] = known
        return known

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Sum-product: beliefs from below in reverse page order, then what comes from above."""
        passed = self.model.passed_on
        below = [self.look(features(n, nodes[n.parent].tag)) if n.parent >= 0 else (0.98, 0.01, 0.01) for n in nodes]
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = below[i]
            (t0, t1, t2), (u0, u1, u2), (v0, v1, v2) = passed
            message = (t0 * a + t1 * b + t2 * c, u0 * a + u1 * b + u2 * c, v0 * a + v1 * b + v2 * c)
            up[i] = message
            k = nodes[i].parent
            a, b, c = below[k]
            a, b, c = a * message[0], b * message[1], c * message[2]
            total = a + b + c
            below[k] = (a / total, b / total, c / total)
        beliefs = [below[0]]
        for i in range(1, len(nodes)):
            above, message = beliefs[nodes[i].parent], up[i]
            x, y, z = above[0] / message[0], above[1] / message[1], above[2] / message[2]
            (t0, t1, t2), (u0, u1, u2), (v0, v1, v2) = passed
            a, b, c = below[i]
            a, b, c = a * (t0 * x + u0 * y + v0 * z), b * (t1 * x + u1 * y + v1 * z), c * (t2 * x + u2 * y + v2 * z)
            total = a + b + c
            beliefs.append((a / total, b / total, c / total))
        return beliefs

    def text(self, page: str) -> str:
        nodes = parse(page)
        beliefs = self.marginals(nodes)
        return "\n\n".join(n.text for n, belief in zip(nodes, beliefs) if n.tag == "#" and belief[CONTENT] > 0.5)


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url and text of each page of ``pages`` (page_id, url, html).

    Blocks are joined in page order by an empty line. A missing or blank page, and one
    without main text, has an empty text. Repeated rows are repeated and other columns
    ignored. ``model`` is trained from ``labelled_pages()`` by default.
    """
    model = model or train(labelled_pages())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in batches:
            texts = [extractor.text(page.as_py() or "") for page in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    chosen = in_batches(pages).select(F.col("page_id").cast("bigint"), "url", "html")
    return chosen.mapInArrow(extract, "page_id bigint, url string, text string")
