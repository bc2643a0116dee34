"""A quality classifier: a generalised additive model with pairwise interactions (Lou et al. 2012, 2013).

Every feature of a text falls into a bin, and every bin has a score; some pairs of features have a table of bins by bins
besides. The tables are learned by cyclic boosting: feature after feature, a tree of few leaves over the bins is
fitted to what the others leave open, shrunk and added to the feature's table. A text's log-odds are the sum of its bins' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import labelled_sample
from .textbatch import WORD_BYTE, U64, find_words, per_row, row_blocks, text_bytes

FEATURES = (
    "log_bytes", "upper_share", "digit_share", "exclamation_share", "bar_share", "symbol_share", "full_stop_share", "comma_share", "line_end_share",
    "blank_share", "beyond_ascii_share", "mean_word_bytes", "longest_word_log", "repeats_previous_share", "repeats_second_share",
    "distinct_word_share", "mark_after_word_share", "mean_line_log",
)


def _one(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LETTER, _DIGIT = _one("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, dtype=bool), _one("0123456789")
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL, _BEYOND = _one("#$%&*+/<=>@[\\]^_`{}~"), np.arange(256) >= 128


def text_features(col: pa.Array) -> np.ndarray:
    """Rows by ``FEATURES``, each from the whole text; an empty or null text has 0 everywhere."""
    data, offs = text_bytes(col)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for lo, hi in row_blocks(offs):
        x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        size = np.maximum(np.diff(o), 1)
        count = lambda flags: per_row(flags[x].astype(np.int64), o)
        w = find_words(x, o)
        n = np.diff(w.first)
        words, length = np.maximum(n, 1), w.end - w.start
        row = w.row()
        previous = np.zeros(len(row))
        previous[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        second = np.zeros(len(row))
        second[2:] = (w.hash[2:] == w.hash[:-2]) & (row[2:] == row[:-2])
        keys = np.sort(row.astype(np.uint64) << U64(40) | w.hash >> U64(24))
        new = np.ones(len(keys), dtype=np.int64)
        new[1:] = keys[1:] != keys[:-1]
        marked = np.zeros(len(row))
        inside = w.end < o[row + 1]
        after = x[w.end[inside]]
        marked[inside] = ~WORD_BYTE[after] & (after > 32)
        lines = count(_one("\n"))
        out[lo:hi] = np.stack([
            np.log2(np.diff(o) + 1), count(_UPPER) / np.maximum(count(_LETTER), 1), count(_DIGIT) / size, count(_one("!")) / size,
            count(_one("|")) / size, count(_SYMBOL) / size, count(_one(".")) / words, count(_one(",")) / words, lines / size, count(_one(" \t")) / size,
            count(_BEYOND) / size, per_row(length, w.first) / words, np.log2(per_row(length, w.first, np.maximum) + 1), per_row(previous, w.first) / words,
            per_row(second, w.first) / words, per_row(new, w.first) / words, per_row(marked, w.first) / words, np.log2(np.diff(o) / (lines + 1) + 1)], 1)
    return out


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The place that parts histograms of gradients and curvatures best, and what it gains; place 0 if nothing does."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return (at + 1, float(gain[at])) if gain[at] > 1e-12 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of ``depth`` over consecutive bins."""
    at, _ = _cut(g, h) if depth else (0, 0.0)
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _tree_of_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of a tree that cuts the first feature and then, on either side, the second; and its gain."""
    at, _ = _cut(g.sum(1), h.sum(1))
    out, gain = np.zeros_like(g), -float(_gain(g.sum(), h.sum()))
    for a, z in ((0, at), (at, len(g))) if at else ((0, len(g)),):
        across_g, across_h = g[a:z].sum(0), h[a:z].sum(0)
        cut, _ = _cut(across_g, across_h)
        for b, y in ((0, cut), (cut, g.shape[1])) if cut else ((0, g.shape[1]),):
            out[a:z, b:y] = _leaf(across_g[b:y].sum(), across_h[b:y].sum())
            gain += float(_gain(across_g[b:y].sum(), across_h[b:y].sum()))
    return out, gain


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # upper bin edges per feature
    coarse: list[np.ndarray]  # the same, for the tables of pairs
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        at = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (j, k), table in zip(self.pairs, self.pair_tables):
            z += table[at[j], at[k]]
        return z


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower")) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.25, bins: int = 32, coarse_bins: int = 8,
        n_pairs: int = 6) -> AdditiveModel | None:
    """Cyclic boosting of all features, then of the ``n_pairs`` pairs whose trees gain most on what is left. None without rows."""
    if not len(x):
        return None
    weight = weight / weight.mean()
    features = x.shape[1]
    # quantiles of each class: a trait of a rare class gets bins of its own
    edges = [np.unique(np.concatenate([_edges(x[y == c, j], bins) for c in (0, 1)])) for j in range(features)]
    coarse = [np.unique(np.concatenate([_edges(x[y == c, j], coarse_bins) for c in (0, 1)])) for j in range(features)]
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(rounds):
        for j in range(features):
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[j], g, len(tables[j])), np.bincount(binned[j], h, len(tables[j])))
            tables[j] += step
            z += step[binned[j]]
    g, h = slopes()
    gains = []
    for j, k in combinations(range(features), 2):
        shape = len(coarse[j]) + 1, len(coarse[k]) + 1
        at = rough[j] * shape[1] + rough[k]
        gains.append((_tree_of_pair(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))[1], -j, -k))
    pairs = [(-j, -k) for _, j, k in sorted(gains, reverse=True)[:n_pairs]]
    pair_tables = [np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1)) for j, k in pairs]
    for _ in range(rounds // 2):
        for (j, k), table in zip(pairs, pair_tables):
            g, h = slopes()
            at = rough[j] * table.shape[1] + rough[k]
            step = rate * _tree_of_pair(np.bincount(at, g, table.size).reshape(table.shape), np.bincount(at, h, table.size).reshape(table.shape))[0]
            table += step
            z += step[rough[j], rough[k]]
    return AdditiveModel(edges, coarse, base, tables, pairs, pair_tables)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
                  per_class: int = 2500) -> DataFrame:
    """``(key, score)`` per row, from the whole text: the probability of label 1.

    Learns from at most ``per_class`` labelled documents of each class that are not held out (``held_out`` is a condition on
    the key), weighted so that the classes keep their shares among all such labels. Only their features reach the driver.
    Null counts as empty. Without labels every score is 0.5.
    """
    drawn = labelled_sample(docs, labels, label, held_out, per_class, key, text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    rows = drawn.select("text", F.col("label").cast("double").alias("label")).mapInArrow(measure, "x array<double>, label double").limit(4 * per_class).toArrow()
    y = (np.asarray(rows["label"]) > 0).astype(float)
    x = np.asarray([v.values.to_numpy() for v in rows["x"]]).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    share = labels.where(~held_out & F.col(label).isNotNull()).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    weight = np.where(y > 0, (share or 0) / max(y.sum(), 1), (1 - (share or 0)) / max((1 - y).sum(), 1)) if len(y) else y
    model = fit(x, y, np.maximum(weight, 1e-12))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    source = docs.select(F.col(key), F.col(text))
    schema = source.select(key).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = shared.value.logits(text_features(b.column(1))) if shared.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=schema.names)

    return source.mapInArrow(run, schema)
