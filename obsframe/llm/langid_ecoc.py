"""Language identification with error-correcting output codes (Dietterich and Bakiri 1995; Allwein et al. 2000).

Every language has a codeword of +1 and -1. One linear classifier per bit, on hashed n-grams of the text's letters,
predicts that bit; the decoder sums the logistic losses of all bits against each codeword, weighted by how reliable
the bits were in training, and takes the language of the least loss. A text whose two best languages lie close is
flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_sample
from .textbatch import LETTER_BYTES, byte_ngrams, row_blocks, text_bytes

BUCKET_BITS = 15
ORDERS = (1, 2, 3, 4)
#: Bytes of text whose n-grams are held at a time.
SLICE = 1 << 16
#: Bytes of text whose rows are given back at a time.
PASSED = 1 << 19
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(col: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script; only texts without ASCII letters are searched one by one."""
    ascii_letters = np.zeros(256, dtype=bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True
    count = np.concatenate([[0], np.cumsum(ascii_letters[data], dtype=np.int64)])
    out = count[offs[1:]] > count[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = bool(_LETTER.search(col[int(i)].as_py()))
    return out


def ngram_blocks(col: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """``(first row, last row, buckets, offsets by row)`` of the n-grams of every text, one entry per order, in blocks."""
    for lo, hi in row_blocks(text_bytes(col)[1], SLICE):
        data, o = text_bytes(pc.utf8_lower(pc.fill_null(col.slice(lo, hi - lo), "")))
        found, where = byte_ngrams(LETTER_BYTES[data], o, ORDERS, BUCKET_BITS)
        yield lo, hi, found, [np.searchsorted(i, o) for i in where]


def bucket_counts(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, buckets, counts)`` of every text."""
    for lo, hi, found, firsts in ngram_blocks(col):
        for r in range(hi - lo):
            got = np.concatenate([b[f[r]:f[r + 1]] for b, f in zip(found, firsts)])
            u, c = np.unique(got, return_counts=True)
            yield lo + r, u, c


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """One row of +1 and -1 per language. Up to 5 languages: every way to part them in two. More: the best of many
    random codes of ``ceil(10 log2 n)`` bits by the least distance of two rows."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        code = np.array([[1 if r == 0 else 1 - 2 * ((b >> (r - 1)) & 1) for b in range(1, bits + 1)] for r in range(n)])
        return code
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, bits))
        code[:, abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        near = ((bits - code @ code.T) // 2 + bits * np.eye(n, dtype=int)).min()
        if near > far:
            best, far = code, near
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of the bits, summing to 1
    sharpness: float

    def decode(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and margin to the second best of bit margins ``z`` (rows x bits)."""
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ranked = np.take_along_axis(p, order, 1)
        margin = ranked[:, 0] - ranked[:, 1] if len(self.languages) > 1 else np.ones(len(z))
        return order[:, 0], ranked[:, 0], margin


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 60) -> LanguageModel | None:
    """Bit classifiers by full-batch Adam on the logistic loss, all bits together; None without labelled rows."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not rows:
        return None
    y = np.array([languages.index(r[0]) for r in rows])
    code = codewords(len(languages))
    size = np.array([len(r[1]) for r in rows])
    index = np.concatenate([r[1] for r in rows])
    value = np.concatenate([r[2] / r[2].sum() for r in rows])
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), size)
    used, index = np.unique(index, return_inverse=True)
    bits = code.shape[1]
    weight, bias = np.zeros((len(used), bits)), np.zeros(bits)
    share = (len(rows) / len(languages) / np.bincount(y))[y] / len(rows)  # each language counts the same
    target = code[y]
    first_moment, second_moment = np.zeros_like(weight), np.zeros_like(weight)
    for t in range(1, rounds + 1):
        z = np.stack([np.add.reduceat(value * weight[index, b], first) for b in range(bits)], 1) + bias
        pull = -target / (1 + np.exp(np.clip(target * z, -40, 40))) * share[:, None]
        grad = np.stack([np.bincount(index, value * pull[row, b], len(used)) for b in range(bits)], 1) + 1e-8 * weight
        first_moment = .9 * first_moment + .1 * grad
        second_moment = .999 * second_moment + .001 * grad ** 2
        weight -= 1.5 * (first_moment / (1 - .9 ** t)) / (np.sqrt(second_moment / (1 - .999 ** t)) + 1e-9)
        bias -= .5 * pull.sum(0)
    right = ((z * target > 0) * share[:, None]).sum(0) / share.sum()
    trust = np.maximum(right - .5, 1e-3)
    full = np.zeros((1 << BUCKET_BITS, bits), dtype=np.float32)
    full[used] = weight
    return LanguageModel(languages, code, full, bias, trust / trust.sum(), 2.0)


def per_row_sums(weight: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of each text's buckets."""
    out = np.zeros((len(first) - 1, weight.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(weight[bucket], first[full], axis=0, dtype=np.float64)
    return out


def predict(model: LanguageModel | None, col: pa.Array, ambiguous_below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of every text of a column."""
    n = len(col)
    name, p, close = np.full(n, UNDETERMINED, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
    if model is None:
        return name, p, close
    for lo, hi, found, firsts in ngram_blocks(col):
        z, total = np.zeros((hi - lo, len(model.bias))), np.zeros(hi - lo)
        for bucket, first in zip(found, firsts):
            z += per_row_sums(model.weight, bucket, first)
            total += np.diff(first)
        best, p[lo:hi], margin = model.decode(z / np.maximum(total, 1)[:, None] + model.bias)
        name[lo:hi], close[lo:hi] = np.array(model.languages, dtype=object)[best], margin < ambiguous_below
        part = col.slice(lo, hi - lo)
        bare = lo + np.flatnonzero(~has_letter(part, *text_bytes(part)))
        name[bare], p[bare], close[bare] = UNDETERMINED, 0.0, True
    return name, p, close


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250) -> LanguageModel | None:
    """A model of at most ``per_language`` rows of each non-null language among those of ``learn``, drawn by a hash of the key.
    Whole texts are counted where they lie; the driver gets their n-gram buckets."""
    usable = learn & F.col(lang).isNotNull() & F.col(text).isNotNull()
    draw = bounded_sample(docs, usable, F.col(lang), per_language, key, lang, text)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, got = b.column(0).to_pylist(), list(bucket_counts(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r] for r, _, _ in got], pa.string()), pa.array([u for _, u, _ in got], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, _, c in got], pa.list_(pa.int32()))], names=["lang", "bucket", "count"])

    counted = draw.select(F.col(lang), F.col(text)).mapInArrow(features, "lang string, bucket array<int>, count array<int>").toArrow()
    rows = [(name, np.asarray(u.values), np.asarray(c.values)) for name, u, c in zip(counted["lang"].to_pylist(), counted["bucket"], counted["count"])]
    return fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes())))


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250,
             ambiguous_below: float = 0.05) -> DataFrame:
    """``(key, lang_pred, score, ambiguous)`` per row, from the whole text.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous; so is every text if there is nothing to
    learn from. Ties go to the language that sorts first. Repeated rows are scored each, an empty table gives an empty result, a long text
    is a slice by itself, and other columns are not looked at.
    """
    # 2^15 buckets by the bits of a code: the size follows the number of languages
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learn, key, text, lang, per_language))
    source = docs.select(F.col(key), F.col(text))
    schema = source.select(key).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, p, close = predict(shared.value, b.column(1), ambiguous_below)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(p), pa.array(close)], names=schema.names)

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250,
                    ambiguous_below: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose text has a language: neither without letters nor ambiguous. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learn, key, text, lang, per_language))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(text_bytes(batch.column(at))[1], PASSED):  # whole rows come and go
                b = batch.slice(lo, hi - lo)
                yield b.filter(pa.array(~predict(shared.value, b.column(at), ambiguous_below)[2]))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
