"""Toxicity by subword-bag embeddings (Bojanowski et al. 2017; Joulin et al. 2017).

A window of words is the mean of the embeddings of its character n-grams; a linear softmax on that mean gives the
window's probability, and a document is as toxic as its worst window, so that a few words in a long text are
not averaged away. Embeddings and softmax are learned together. A misspelling shares most of its n-grams with
the word it comes from, and with them their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import labelled_sample
from .textbatch import LETTER_BYTES, byte_ngrams, find_words, per_row, row_blocks, text_bytes

BUCKET_BITS = 18
ORDERS = (3, 4, 5, 6)
WORDS = 24
#: A window of fewer n-grams is averaged as if it had so many, the rest of them zero vectors.
LEAST = 400

_LETTER = np.arange(256) != 32


def window_blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """``(first row, last row, first window of each row, buckets, offsets by window)``, one entry per n-gram order, in blocks.

    A word that repeats the one before it is left out. A window is ``WORDS`` consecutive words of a row; the last one also
    takes the rest. A row without words has none.
    """
    data, offs = text_bytes(pc.utf8_lower(pc.fill_null(col, "")))
    for lo, hi in row_blocks(offs, 1 << 20):
        x, o = LETTER_BYTES[data[offs[lo]:offs[hi]]], offs[lo:hi + 1] - offs[lo]
        w = find_words(x, o, _LETTER, lower=False)
        again = np.zeros(len(w.hash), dtype=bool)
        again[1:] = w.hash[1:] == w.hash[:-1]
        again[w.first[:-1][w.first[:-1] < len(again)]] = False
        if again.any():
            size = w.end[again] - w.start[again]
            x[np.repeat(w.start[again] - np.cumsum(size) + size, size) + np.arange(size.sum())] = 32
        start = w.start[~again]
        first = np.searchsorted(start, o)
        count = np.diff(first)
        number = np.arange(len(start)) - np.repeat(first[:-1], count)
        begin = start[(number % WORDS == 0) & ((number == 0) | (np.repeat(count, count) - number >= WORDS))]
        # an n-gram may begin with the boundary before a word
        edges = np.append(np.maximum(begin - 1, 0), len(x))
        found, where = byte_ngrams(x, o, ORDERS, BUCKET_BITS)
        yield lo, hi, np.searchsorted(begin, o), found, [np.searchsorted(i, edges) for i in where]


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # buckets x dimensions
    softmax: np.ndarray  # dimensions x 2
    bias: float

    def bucket_logits(self) -> np.ndarray:
        """What each n-gram adds to a window's log-odds: the mean and the softmax are linear, so vectors need not be averaged."""
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)


def fit(texts: list[str], toxic: np.ndarray, dimensions: int = 8, rounds: int = 80, least_docs: int = 4, seed: int = 1) -> ToxicityModel | None:
    """Gradient descent with momentum on the cross-entropy; None if a class is missing.

    In the first rounds each window carries its document's label; then a document is judged by its worst window, as when
    scoring. N-grams of fewer than ``least_docs`` texts stay zero.
    """
    if not len(texts) or len(set(toxic.tolist())) < 2:
        return None
    parts, docs_with = [], np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    for lo, _, windows, found, firsts in window_blocks(pa.array(texts, pa.string())):
        counts = np.maximum(sum(np.diff(f) for f in firsts), LEAST)
        n = len(counts)
        keys = np.concatenate([np.repeat(np.arange(n, dtype=np.int64), np.diff(f)) << 20 | b[f[0]:f[-1]] for b, f in zip(found, firsts)])
        keys, times = np.unique(keys, return_counts=True)
        window, bucket = keys >> 20, (keys & ((1 << 20) - 1)).astype(np.int32)
        row = np.repeat(np.arange(lo, lo + len(windows) - 1), np.diff(windows))
        docs_with += np.bincount(np.unique(row[window] << 20 | bucket) & ((1 << 20) - 1), minlength=1 << BUCKET_BITS).astype(np.int32)
        parts.append((bucket, (times / counts[window]).astype(np.float32), np.bincount(window, minlength=n), row))
    index, value, size, row = map(np.concatenate, zip(*parts))
    del parts
    often = docs_with[index] >= least_docs
    if not often.any():
        return None
    window = np.repeat(np.arange(len(size), dtype=np.int32), size)[often]
    index, value = index[often], value[often]
    kept, first = np.unique(window, return_index=True)
    window_of = np.repeat(np.arange(len(kept), dtype=np.int32), np.diff(np.append(first, len(window))))
    row = row[kept]
    number = np.cumsum(docs_with >= least_docs, dtype=np.int32) - 1
    used, index = np.flatnonzero(docs_with >= least_docs), number[index]
    del window, often
    rows, doc_first = np.unique(row, return_index=True)
    per_doc = np.diff(np.append(doc_first, len(first)))
    label = toxic[rows].astype(float)
    balance = np.where(label > 0, .5 / max(label.sum(), 1), .5 / max((1 - label).sum(), 1))
    rng = np.random.default_rng(seed)
    direction = rng.normal(size=dimensions)
    e, bias = np.zeros((len(used), dimensions)), 0.0
    softmax = np.outer(direction / np.linalg.norm(direction), [-.5, .5])
    along, turned, shifted = np.zeros_like(e), np.zeros_like(softmax), 0.0
    for t in range(rounds):
        axis = softmax[:, 1] - softmax[:, 0]
        z = np.add.reduceat(value * (e @ axis).astype(np.float32)[index], first) + bias
        pull = np.zeros(len(z))
        if t < rounds // 4:
            pull[:] = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - np.repeat(label, per_doc)) * np.repeat(balance / per_doc, per_doc)
        else:
            top = np.flatnonzero(z == np.repeat(np.maximum.reduceat(z, doc_first), per_doc))
            _, once = np.unique(row[top], return_index=True)
            worst = top[once]
            pull[worst] = (1 / (1 + np.exp(-np.clip(z[worst], -40, 40))) - label) * balance
        s = np.bincount(index, value * pull[window_of], len(used))
        along = .9 * along + np.outer(s, axis)
        toward = e.T @ s
        turned = .9 * turned + np.stack([-toward, toward], 1)
        shifted = .9 * shifted + pull.sum()
        e -= 4000 * along
        softmax -= .01 * turned
        bias -= .3 * shifted
    full = np.zeros((1 << BUCKET_BITS, dimensions))
    full[used] = e
    return ToxicityModel(full, softmax, float(bias))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   per_class: int = 800, max_chars: int = 5_000) -> DataFrame:
    """``(key, score)`` per row, from the whole text; higher is more toxic.

    Learns from at most ``per_class`` labelled texts of each class that are not held out (``held_out`` is a condition on the key).
    Null counts as empty; a text without words scores as an empty window. Without both classes every score is 0.
    """
    drawn = labelled_sample(docs, labels, label, held_out, per_class, key, text, max_chars).limit(4 * per_class).toPandas()
    drawn = drawn.assign(label=drawn.label.astype(float)).sort_values(["label", "text"])
    model = fit(drawn.text.tolist(), drawn.label.to_numpy() > 0)
    logits = None if model is None else (model.bucket_logits(), model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(logits)  # one number per bucket: 1 MB
    source = docs.select(F.col(key), F.col(text))
    schema = source.select(key).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            p = np.zeros(b.num_rows)
            if known is not None:
                weight, bias = known
                for lo, hi, windows, found, firsts in window_blocks(b.column(1)):
                    total, n = np.zeros(windows[-1]), np.zeros(windows[-1])
                    for bucket, first in zip(found, firsts):
                        total += per_row(weight[bucket], first)
                        n += np.diff(first)
                    z = per_row(total / np.maximum(n, LEAST), windows, np.maximum) + bias
                    p[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=schema.names)

    return source.mapInArrow(run, schema)
