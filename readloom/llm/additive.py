"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins and gets a lookup table of log-odds. The tables are learned cyclically: round
after round, each feature in turn fits a shallow tree (at most four leaves over its bins) to the current gradient and
adds a small step of it to its table, so that no feature can take what another explains better. Then the pairs with
the largest remaining gain get two-dimensional tables on coarse bins in the same manner. A score is a sum of looked-up
bins, vectorised over the batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, filter_rows
from .labelled import fold, labelled_sample
from .textstats import FEATURES, statistics


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for c, t, v in zip(self.cuts, self.tables, x.T, strict=False):
            out += t[np.searchsorted(c, v, side="left")]
        for a, b, t in self.pairs:
            out += t[np.searchsorted(self.coarse[a], x[:, a], side="left"), np.searchsorted(self.coarse[b], x[:, b], side="left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, l2: float, least: int) -> np.ndarray:
    """The values of a tree of this depth over consecutive bins."""
    total = g.sum() / (h.sum() + l2)
    if depth and len(g) > 1:
        gl, hl, nl = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
        gt, ht = g.sum(), h.sum()
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (n.sum() - nl < least)] = 0
        j = int(gain.argmax())
        if gain[j] > 1e-6:
            return np.concatenate([_line_tree(g[s], h[s], n[s], depth - 1, l2, least) for s in (slice(0, j + 1), slice(j + 1, None))])
    return np.full(len(g), total)


def _corner_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid into four corners: its gain and the grid of values."""
    def corners(m):
        c = m.cumsum(axis=0).cumsum(axis=1)
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = corners(g), corners(h)
    gain = sum(a**2 / (b + l2) for a, b in zip(gs, hs, strict=True)) - g.sum() ** 2 / (h.sum() + l2)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    w = [a[i, j] / (b[i, j] + l2) for a, b in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1:], out[i + 1:, : j + 1], out[i + 1:, j + 1:] = w
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15,
        bins: int = 64, coarse_bins: int = 12, depth: int = 2, l2: float = 1.0, least: int = 10) -> AdditiveModel:
    """Fit on binary labels; with no rows, or one class only, the model is the constant of that class."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = AdditiveModel(float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.cuts = [quantiles(v, bins) for v in x.T]
    model.coarse = [quantiles(v, coarse_bins) for v in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine = [np.searchsorted(c, v, side="left") for c, v in zip(model.cuts, x.T, strict=True)]
    count = [np.bincount(b, minlength=len(t)) for b, t in zip(fine, model.tables, strict=True)]
    margin = np.full(len(y), model.base)

    def slopes():
        prob = 1 / (1 + np.exp(-margin))
        return y - prob, prob * (1 - prob)

    for _ in range(rounds):
        for b, n, t in zip(fine, count, model.tables, strict=True):
            g, h = slopes()
            step = rate * _line_tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), n, depth, l2, least)
            t += step
            margin += step[b]
    wide = [np.searchsorted(c, v, side="left") for c, v in zip(model.coarse, x.T, strict=True)]
    size = [len(c) + 1 for c in model.coarse]

    def grid(a, b, v):
        return np.bincount(wide[a] * size[b] + wide[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    ranked = sorted(((_corner_tree(grid(a, b, g), grid(a, b, h), l2)[0], a, b) for a in range(x.shape[1]) for b in range(a)), key=lambda r: (-r[0], r[1:]))
    chosen = [(a, b, np.zeros((size[a], size[b]))) for gain, a, b in ranked[:n_pairs] if gain > 1e-6]
    for _ in range(pair_rounds):
        for a, b, t in chosen:
            g, h = slopes()
            step = rate * _corner_tree(grid(a, b, g), grid(a, b, h), l2)[1]
            t += step
            margin += step[wide[a], wide[b]]
    model.pairs = chosen
    return model


def passing(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more, with all columns, whatever their names.

    A null or empty text is judged by the score of one without words; repeated rows all stay or all go; an empty table
    gives none.
    """

    def keep(texts: list[bytes | None]) -> list[bool]:
        return (model.score(np.array([statistics(t)[1] for t in texts]).reshape(-1, len(FEATURES))) >= 0.5).tolist()

    return filter_rows(docs, "text", keep)


def quality_scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; one pass without a shuffle.

    The features come from the text alone, the whole of it. Null and empty texts have all features zero and get the
    score of those. A null id counts as not held out. Repeated rows each get a row; an empty table gives none; columns
    other than doc_id and text aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                x = np.array([statistics(t)[1] for t in part.column("_raw").to_pylist()]).reshape(-1, len(FEATURES))
                p = model.score(x).tolist()
                yield batch_of(schema, [(i, o, v, int(v >= 0.5)) for i, o, v in zip(
                    part.column("doc_id").to_pylist(), part.column("_held_out").to_pylist(), p, strict=True)])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("_held_out"),
        F.col("text").cast("binary").alias("_raw"),
    ).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def fitted(documents: DataFrame, labels: DataFrame) -> AdditiveModel:
    return fit(*labelled_sample(documents, labels))
