"""Main text of web pages by a graphical model on the DOM tree.

Each element is content or not. Its features (tag, words of class, id and role, share of linked text,
whether there is text at all) give a node potential, and each parent and child share a potential by the child's kind. Sum-product
messages go up the tree and down again, level by level for all pages of a batch at once, which gives each element's
exact marginal; elements over one half are content. Potentials are fitted to labelled pages by gradient ascent on
the exact log-likelihood, whose expected counts are the same marginals.

Defined cases: a null or empty page has an empty text; broken markup is read as browsers about do; text within a
content element that stands in a line goes with it unspaced, blocks and line breaks are set off by a space; text that
a style or an attribute hides is text like other; repeated rows are extracted alike; an empty table gives no rows; the
report has its own four columns, and main_text_column goes with any others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.llm import labelled_pages as lp
from assetweave.llm.common import arrow_limits
from assetweave.llm.dom import INLINE, Tree, main_text, parse

PAGES = 800
STEPS = 200

TAGS = {t: k for k, t in enumerate("#root html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form fieldset label button details summary address center head a b strong em i span code small font".split())}
#: Words of the names of classes that the training pages have.
WORDS = {w: k for k, w in enumerate(sorted({p for group in (lp.CONTENT, lp.MENU, lp.SIDE, lp.ADVERT, lp.NOTICE, lp.FORM, lp.COMMENTS, lp.HEADER, lp.FOOTER, lp.SHARE) for name in group for p in name.lower().split("-")}))}
N_TAGS, N_WORDS = len(TAGS) + 1, len(WORDS)
#: One feature for each tag and word, then always-on, link-share and length steps.
LINK, LENGTH = 4, 4
N = N_TAGS + N_WORDS + 1 + LINK + LENGTH
START = (0.0, 1.0, 4.0, 4.0)
RATE, PENALTY = 0.2, 1e-4
KINDS = 4  # sections with a meaning, other containers, blocks, inline
SECTION, CONTAINER = frozenset("nav header footer aside form article main".split()), frozenset("div section td table tr tbody ul ol dl body html fieldset center details".split())


def kind(tag: str) -> int:
    return 0 if tag in SECTION else 1 if tag in CONTAINER else 3 if tag in INLINE else 2


class Forest:
    """The trees of some pages as arrays: node by node the parent, depth, kind and features."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.start[-1])
        own = np.repeat(self.start[:-1], sizes)
        self.parent = np.array([p for t in trees for p in t.parent], np.int64) + own
        self.depth = np.array([d for t in trees for d in t.depth], np.int64)
        tags = [x for t in trees for x in t.tag]
        self.kind = np.array([kind(x) for x in tags], np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 2))
        self.levels = np.split(order, cuts[:-1])
        length = np.zeros(n)
        in_link = np.array([x == "a" for x in tags], bool)
        node = np.array([s + p[0] for s, t in zip(self.start[:-1], trees, strict=True) for p in t.pieces], np.int64)
        np.add.at(length, node, np.array([len(p[1].strip()) for t in trees for p in t.pieces], float))
        for level in self.levels[1:]:
            in_link[level] |= in_link[self.parent[level]]
        linked = np.where(in_link, length, 0.0)
        for level in self.levels[:0:-1]:  # totals of whole subtrees
            for total in (length, linked):
                np.add.at(total, self.parent[level], total[level])
        share = linked / np.maximum(length, 1)
        base = N_TAGS + N_WORDS
        nodes, features = [np.arange(n)], [np.array([TAGS.get(x, N_TAGS - 1) for x in tags], np.int64)]
        hinted = [(k, WORDS[v]) for k, ws in enumerate(w for t in trees for w in t.words) if ws for v in set(ws) if v in WORDS]
        for add in (np.array(hinted, np.int64).reshape(-1, 2),):
            nodes.append(add[:, 0])
            features.append(add[:, 1] + N_TAGS)
        for f in (np.full(n, base), base + 1 + np.minimum((share * LINK).astype(int), LINK - 1), base + 1 + LINK + np.digitize(length, [1, 20, 80])):
            nodes.append(np.arange(n))
            features.append(f)
        self.node, self.feature = np.concatenate(nodes), np.concatenate(features)

    def potentials(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weight[self.feature], minlength=int(self.start[-1]))

    def marginals(self, weight: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each node to be content, and of each node's (parent, own) states, by sum-product."""
        n = int(self.start[-1])
        up = np.zeros((n, 2))  # log of all that stands at and below a node, by its state
        up[:, 1] = self.potentials(weight)
        message = np.zeros((n, 2))  # to the parent, by the parent's state
        for level in self.levels[:0:-1]:
            both = up[level][:, None, :] + edge[self.kind[level]]
            top = both.max(axis=2)
            message[level] = top + np.log(np.exp(both - top[:, :, None]).sum(axis=2))
            np.add.at(up, self.parent[level], message[level])
        belief, pair = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            outside = belief[self.parent[level]] - message[level]
            joint = outside[:, :, None] + edge[self.kind[level]] + up[level][:, None, :]
            top = joint.max(axis=(1, 2), keepdims=True)
            share = np.exp(joint - top)
            share /= share.sum(axis=(1, 2), keepdims=True)
            pair[level] = share
            belief[level] = np.log(share.sum(axis=1) + 1e-300)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def truth(trees: list[Tree]) -> np.ndarray:
    """Labels of the nodes: that of the nearest marked element above, or not content."""
    out = []
    for t in trees:
        state = [False] * len(t.tag)
        for k in range(1, len(t.tag)):
            state[k] = t.mark[k] == "1" if t.mark[k] is not None else state[t.parent[k]]
        out += state
    return np.array(out, bool)


def fit(pages: list[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and edge potentials from labelled pages, by Adam steps on the mean log-likelihood."""
    trees = [parse(p) for p in pages]
    forest, label = Forest(trees), truth([*trees])
    child = np.flatnonzero(forest.depth > 0)
    seen_node = np.bincount(forest.feature, label[forest.node].astype(float), minlength=N)
    seen_edge = np.zeros((KINDS, 2, 2))
    np.add.at(seen_edge, (forest.kind[child], label[forest.parent[child]].astype(int), label[child].astype(int)), 1)
    # the ascent starts where blocks and inline elements are what their parents are
    at = np.concatenate([np.zeros(N), np.stack([np.eye(2) * START[k] for k in range(KINDS)]).ravel()])
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        weight, edge = at[:N], at[N:].reshape(KINDS, 2, 2)
        chance, pair = forest.marginals(weight, edge)
        made_edge = np.stack([pair[child][forest.kind[child] == k].sum(axis=0) for k in range(KINDS)])
        slope = np.concatenate([seen_node - np.bincount(forest.feature, chance[forest.node], minlength=N), (seen_edge - made_edge).ravel()]) / len(pages) - PENALTY * at
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        at = at + RATE * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return at[:N], at[N:].reshape(KINDS, 2, 2)


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """Fitted to PAGES labelled pages, once a process."""
    return fit(lp.labelled_pages(PAGES))


def extracted(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Main texts of some pages."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    content = forest.marginals(*model)[0] > 0.5
    return [main_text(t, content[a:b].tolist()) for t, a, b in zip(trees, forest.start[:-1], forest.start[1:], strict=True)]


def main_text_column(page: Column, model: tuple[np.ndarray, np.ndarray] | None = None) -> Column:
    model = model or default_model()

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        own = [p for p in pages]
        return pd.Series([t for k in range(0, len(own), 200) for t in extracted(own[k : k + 200], model)], dtype=object)

    return texts(page)


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    arrow_limits(pages.sparkSession)
    found = pages.select("page_id", "url", main_text_column(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
