"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Trees of a fixed depth are grown level by level on quantile bins (second-order logistic loss). A feature with a
constraint of -1 can only lower the log-odds as it grows: splits that violate it are refused, and both children
inherit the midpoint as a bound on their values, so that no deeper split can undo it. The fitted trees are flattened
to numpy node arrays (complete binary trees), and a batch of documents walks all trees at once, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, filter_rows
from .labelled import labelled_sample
from .textstats import FEATURES, statistics

#: More of these never raises a document's score.
MONOTONE = {
    "symbols_per_word": -1, "bars_per_word": -1, "bangs_per_word": -1, "dup_line_share": -1,
    "repeat_word_share": -1, "adjacent_repeat_share": -1,
}


@dataclass
class FlatTrees:
    """``feature`` and ``threshold``: trees x inner nodes in breadth-first order; ``value``: trees x leaves.

    A row goes right where its feature is above the threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        if not trees:
            return out
        at = np.zeros((len(x), trees), dtype=np.int64)
        every, rows = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[every, at]] > self.threshold[every, at])
        return out + self.value[every, at - inner].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        l2: float = 1.0, least: int = 20, monotone: dict[str, int] = MONOTONE) -> FlatTrees:
    """Boost on binary labels. With no rows, or one class only, the model is the constant of that class."""
    inner, leaves = 2**depth - 1, 2**depth
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    model = FlatTrees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]  # v > cuts[b] <=> bin > b
    sign = [monotone.get(n, 0) for n in FEATURES]
    margin = np.full(len(y), model.base)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        f_at, t_at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            pick: list[tuple[int, int] | None] = [None] * width
            mids = np.zeros(width)
            for f, (cut, b) in enumerate(zip(cuts, binned, strict=True)):
                k = len(cut) + 1
                if k < 2:
                    continue
                key = local * k + b
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(axis=1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(axis=1)
                ns = np.bincount(key, minlength=width * k).reshape(width, k).cumsum(axis=1)
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                bound = low[first:first + width, None], high[first:first + width, None]
                wl = np.clip(gl / (hl + l2), *bound)
                wr = np.clip((gt - gl) / (ht - hl + l2), *bound)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least) | (sign[f] * (wr - wl) < 0)] = 0
                j = gain.argmax(axis=1)
                for w in np.nonzero(gain[np.arange(width), j] > best)[0]:
                    best[w], pick[w], mids[w] = gain[w, j[w]], (f, j[w]), (wl[w, j[w]] + wr[w, j[w]]) / 2
            for w, found in enumerate(pick):
                at = first + w
                left, right = 2 * at + 1, 2 * at + 2
                low[[left, right]], high[[left, right]] = low[at], high[at]
                if found is None:  # everything goes left: the threshold stays infinite
                    continue
                f, j = found
                f_at[at], t_at[at] = f, cuts[f][j]
                if sign[f] < 0:
                    low[left], high[right] = max(low[at], mids[w]), min(high[at], mids[w])
                elif sign[f] > 0:
                    high[left], low[right] = min(high[at], mids[w]), max(low[at], mids[w])
            node = 2 * node + 1 + (x[np.arange(len(x)), f_at[node]] > t_at[node])
        leaf = node - inner
        w = np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        w = rate * np.clip(w, low[inner:], high[inner:])
        margin += w[leaf]
        feature.append(f_at)
        threshold.append(t_at)
        value.append(w)
    return FlatTrees(np.array(feature), np.array(threshold), np.array(value), model.base)


def judge(texts: list[bytes | None], model: FlatTrees, threshold: float = 0.5) -> list[tuple]:
    """(base counts, base_failed, score, kept) of each text."""
    stats = [statistics(t) for t in texts]
    p = 1 / (1 + np.exp(-model.margin(np.array([s[1] for s in stats]).reshape(-1, len(FEATURES)))))
    out = []
    for (base, _), v in zip(stats, p.tolist(), strict=True):
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        out.append((base, failed, v, not failed and v >= threshold))
    return out


def passing(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns, whatever their names.

    Null and empty texts have no words and go; repeated rows all stay or all go; an empty table gives none.
    """
    return filter_rows(docs, "text", lambda texts: [j[3] for j in judge(texts, model)])


def quality_rules(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, tree_score and kept of every row; one pass without a shuffle.

    Null and empty texts have no words, so they fail the base rule. Texts of any length are read whole. Repeated rows
    each get a row, as do null ids; an empty table gives none; other columns of ``docs`` are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("tree_score", pa.float64()), ("kept", pa.bool_())])

    def score(batches):
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                judged = judge(part.column("_raw").to_pylist(), model, threshold)
                rows = [(i, *j[0], *j[1:]) for i, j in zip(part.column("doc_id").to_pylist(), judged, strict=True)]
                yield batch_of(schema, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_raw")).mapInArrow(
        score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, tree_score double, kept boolean")


def fitted(documents: DataFrame, labels: DataFrame) -> FlatTrees:
    return fit(*labelled_sample(documents, labels))
