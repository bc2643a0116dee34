"""Secret scans with a linear-chain conditional random field (Lafferty, McCallum and Pereira 2001).

Three patterns find the plain cases. A random field over the tokens of a text (outside, begin, inside) adds what looks
like them: it is trained on the plain cases, sees a token's shape, the words around it, the marks between them and
traits of the whole text, and is decoded by Viterbi. Spans of the patterns always stay; spans of the field are added
where they do not overlap those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import LOWER, U64, find_words, per_row, row_blocks, text_bytes

KINDS = ("assign", "access", "hex", "field")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OUTSIDE, BEGIN, INSIDE = range(3)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UP, _LOW, _DIGIT, _SPECIAL = (_flags(x) for x in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"_+/-"))
_HEXDIGIT, _FAR = _flags(b"0123456789abcdef"), np.arange(256) >= 128
TOKEN = _UP | _LOW | _DIGIT | _SPECIAL | _FAR
#: Marks around tokens: 0 none, then blank, line end, equals, colon, quotes, brackets, others.
_MARK = np.full(256, 7, dtype=np.int64)
for _i, _chars in enumerate((b" \t", b"\n\r", b"=", b":", b"\"'`", b"()[]{}<>"), 1):
    _MARK[list(_chars)] = _i
#: What a byte is within a token, to count changes between letters, digits and others.
_CLASS = _DIGIT.astype(np.int8) + 2 * (_UP | _LOW) + 3 * _FAR
_LENGTHS = np.array([2, 4, 6, 9, 13, 17, 21, 25, 33, 41])
WORD_BITS = 12
#: Sizes of the feature groups: shape, texture, marks before, mark after, three neighbouring words, traits of the text.
GROUPS = (32 * 11, 5 * 2 * 4 * 2, 128, 8, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 32)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the plain cases in code points, leftmost and not overlapping within a kind, sorted."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: of an assignment, its value."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out + [(a, z) for a, z, kind in pattern_spans(text) if kind])


def rows_to_search(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows whose bytes leave it possible that a pattern matches; all others cannot match."""
    at = []
    low, raw = LOWER[x].tobytes(), x.tobytes()
    for haystack, needles in ((low, _NAMES), (raw, (b"AKIA",))):
        for needle in needles:
            i = haystack.find(needle)
            while i >= 0:
                at.append(i)
                i = haystack.find(needle, i + 1)
    run = np.concatenate([[0], np.cumsum(_HEXDIGIT[x], dtype=np.int32)])
    hexes = np.flatnonzero(run[24:] - run[:-24] == 24) if len(x) >= 24 else np.zeros(0, np.int64)
    return np.unique(np.searchsorted(offs, np.concatenate([np.array(at, dtype=np.int64), hexes]), "right") - 1)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: np.ndarray
    features: list[np.ndarray]  # one feature number per token and group


def _count(flags: np.ndarray, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags[x], dtype=np.int32)])
    return c[end] - c[start]


def tokenize(x: np.ndarray, offs: np.ndarray) -> Tokens:
    """Tokens of a block of texts and their features."""
    w = find_words(x, offs, TOKEN)
    start, end, row = w.start, w.end, w.row()
    n = len(start)
    if not n:
        return Tokens(start, end, w.first, row, [np.zeros(0, np.int64)] * len(GROUPS))
    size = end - start
    ups, lows, digits, specials, far, hexes = (_count(f, x, start, end) for f in (_UP, _LOW, _DIGIT, _SPECIAL, _FAR, _HEXDIGIT))
    length = np.searchsorted(_LENGTHS, size, "right")
    shape = ((ups > 0) + 2 * (lows > 0) + 4 * (digits > 0) + 8 * (specials > 0) + 16 * (far > 0)) * 11 + length
    change = np.zeros(len(x) + 1, dtype=np.int32)
    np.cumsum(_CLASS[x[1:]] != _CLASS[x[:-1]], out=change[2:])
    turns = np.searchsorted([1, 2, 4], change[end] - change[start + 1], "right")
    share = np.where(digits == size, 4, np.searchsorted([.001, .2, .5], digits / size, "right"))
    texture = ((share * 2 + (hexes == size)) * 4 + turns) * 2 + (size >= 16)
    same = np.zeros(n, dtype=bool)
    same[1:] = row[1:] == row[:-1]
    begin, stop = offs[row], offs[row + 1]
    gap_from = np.where(same, np.concatenate([[0], end[:-1]]), begin)
    mark1 = np.where(start > begin, _MARK[x[np.maximum(start - 1, 0)]], 0)
    mark2 = np.where(start - 1 > begin, _MARK[x[np.maximum(start - 2, 0)]], 0)
    assigns = _count(_flags(b"=:"), x, gap_from, start) > 0
    marks = (mark1 * 8 + mark2) * 2 + assigns
    after = np.where(end < stop, _MARK[x[np.minimum(end, len(x) - 1)]], 0)
    word = (w.hash >> U64(64 - WORD_BITS)).astype(np.int64)
    none = np.zeros(1, np.int64)
    previous = np.where(same, np.concatenate([none, word[:-1]]), 0)
    before = np.where(same & np.concatenate([[False], same[:-1]]), np.concatenate([none, none, word[:-2]])[:n], 0)
    following = np.where(np.append(same[1:], False), np.append(word[1:], 0), 0)
    # traits of the text: tokens with digits, short lines, marks of code
    numeric = np.searchsorted([.02, .1, .3], per_row((digits > 0).astype(np.int64), w.first) / np.maximum(np.diff(w.first), 1), "right")
    size_of = np.maximum(np.diff(offs), 1)
    lines = per_row((x == 10).astype(np.int64), offs) / size_of > .02
    code = per_row(_flags(b"{}=;")[x].astype(np.int64), offs) / size_of > .01
    traits = ((numeric * 2 + lines) * 2 + code)[row] * 2 + (digits > 0)
    return Tokens(start, end, w.first, row, [shape, texture, marks, after, previous, before, following, traits])


@dataclass
class Field:
    weights: list[np.ndarray]  # per feature group: features x labels
    step: np.ndarray  # labels x labels
    enter: np.ndarray

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), 3), dtype=np.float32)
        for w, f in zip(self.weights, features):
            out += w[f]
        return out

    def decode(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label path of every row.

        A token at which leaving "outside" cannot pay, whatever its neighbours are, is outside in a best path; this
        settles nearly all. What remains are runs of tokens between such ones, decoded by Viterbi, all runs step by step.
        """
        n = len(u)
        labels = np.zeros(n, dtype=np.int8)
        into = np.concatenate([self.step, self.enter[None]])  # from each label or the start of a row
        out_of = np.concatenate([self.step, np.zeros((3, 1), self.step.dtype)], 1)  # to each label or the end
        undecided = np.zeros(n, dtype=bool)
        for s in (BEGIN, INSIDE):
            best = (into[:, s] - into[:, OUTSIDE]).max() + (out_of[s] - out_of[OUTSIDE]).max()
            undecided |= u[:, s] - u[:, OUTSIDE] + best > 0
        at = np.flatnonzero(undecided)
        if not len(at):
            return labels
        row_starts = np.zeros(n + 1, dtype=bool)
        row_starts[first] = True
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | row_starts[at[1:]]
        begin = at[new]
        length = np.diff(np.append(np.flatnonzero(new), len(at)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        longer = lambda t: int(np.searchsorted(-length, -t, "left"))  # noqa: E731  runs of more than t tokens
        back = np.zeros((n, 3), dtype=np.int8)
        score = u[begin] + np.where(row_starts[begin][:, None], self.enter, self.step[OUTSIDE])
        last, alive = np.empty_like(score), len(begin)
        for t in range(1, int(length[0]) + 1):
            more = longer(t)
            last[more:alive] = score[more:alive]
            alive = more
            if alive:
                paths = score[:alive, :, None] + self.step[None]
                back[begin[:alive] + t] = paths.argmax(1)
                score = paths.max(1) + u[begin[:alive] + t]
        end = begin + length - 1
        state = (last + np.where(row_starts[end + 1][:, None], 0, self.step[:, OUTSIDE])).argmax(1)
        labels[end] = state
        for t in range(1, int(length[0])):
            alive = longer(t)
            at = end[:alive] - t
            state = back[at + 1, state[:alive]]
            labels[at] = state
        return labels


def likelihood(params: list[np.ndarray], groups: list[np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Negative log-likelihood of the label sequences and its gradient; sums over all paths come from the forward and
    backward recursions. ``labels``: sequences x tokens, -1 fills up short sequences."""
    *weights, step, enter = params
    s, t = labels.shape
    real = labels >= 0
    pairs = real[:, 1:] & real[:, :-1]
    truth = np.eye(3)[np.maximum(labels, 0)] * real[..., None]
    u = sum(w[g] for w, g in zip(weights, groups))
    forward, backward = np.zeros((s, t, 3)), np.zeros((s, t, 3))
    forward[:, 0] = enter + u[:, 0]
    for k in range(1, t):
        new = np.logaddexp.reduce(forward[:, k - 1, :, None] + step, axis=1) + u[:, k]
        forward[:, k] = np.where(real[:, k, None], new, forward[:, k - 1])
    for k in range(t - 2, -1, -1):
        new = np.logaddexp.reduce(step + (u[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
        backward[:, k] = np.where(real[:, k + 1, None], new, 0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    p = np.exp(forward + backward - total[:, None, None]) * real[..., None]
    joint = np.exp(forward[:, :-1, :, None] + step + (u[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
    true_steps = np.einsum("nti,ntj->ij", truth[:, :-1] * pairs[..., None], truth[:, 1:])
    loss = total.sum() - (truth * u).sum() - (true_steps * step).sum() - (truth[:, 0] * enter).sum()
    rest = (p - truth)[real]
    grads = [np.stack([np.bincount(g[real], rest[:, c], len(w)) for c in range(3)], 1) for g, w in zip(groups, weights)]
    return float(loss), [*grads, joint.sum((0, 1)) - true_steps, (p[:, 0] - truth[:, 0]).sum(0)]


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field | None:
    """Maximum likelihood with a penalty, by Adam. ``features``: sequences x tokens x groups. None without a secret."""
    if not (labels > 0).any():
        return None
    groups = [features[:, :, g] for g in range(len(GROUPS))]
    params = [*(np.zeros((size, 3)) for size in GROUPS), np.zeros((3, 3)), np.zeros(3)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for r in range(1, rounds + 1):
        _, grads = likelihood(params, groups, labels)
        for q, m, g in zip(params, moments, grads):
            g = g / len(labels) + decay * q
            m[0] = .9 * m[0] + .1 * g
            m[1] = .999 * m[1] + .001 * g * g
            q -= rate * (m[0] / (1 - .9 ** r)) / (np.sqrt(m[1] / (1 - .999 ** r)) + 1e-8)
    as32 = [q.astype(np.float32) for q in params]
    return Field(as32[:-2], as32[-2], as32[-1])


def _byte_places(text: str) -> np.ndarray:
    """Byte offset of every code point, and of the end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def training_windows(col: pa.Array, around: int = 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(features, labels)`` of windows of ``2 * around + 4`` tokens: around each secret, and one of every text without any."""
    data, offs = text_bytes(col)
    width = 2 * around + 4
    for lo, hi in row_blocks(offs):
        x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        tokens = tokenize(x, o)
        searched = set(rows_to_search(x, o).tolist())
        stacked = np.stack(tokens.features, 1)
        for r in range(hi - lo):
            a, z = int(tokens.first[r]), int(tokens.first[r + 1])
            if a == z:
                continue
            labels, anchors = np.zeros(z - a, dtype=np.int8), []
            if r in searched:
                text = col[lo + r].as_py()
                places = _byte_places(text) + o[r]
                for from_, to in secret_values(text):
                    i = int(np.searchsorted(tokens.end[a:z], places[from_], "right"))
                    j = int(np.searchsorted(tokens.start[a:z], places[to], "left"))
                    if i < j and not labels[i:j].any():
                        labels[i], labels[i + 1:j] = BEGIN, INSIDE
                        anchors.append(i)
            else:
                anchors.append((z - a) // 2)
            for i in anchors:
                b = max(0, min(i - around, z - a - width))
                yield stacked[a + b:min(a + b + width, z)], labels[b:b + width]


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 20_000, windows: int = 6_000, max_chars: int = 20_000) -> Field | None:
    """A field from about ``sample`` rows, drawn by a hash of the key among texts of up to ``max_chars`` characters; at most
    ``windows`` windows of fixed length reach the driver. Texts without secrets are represented by every fourth."""
    below = int(min(1.0, sample / max(docs.count(), 1)) * (1 << 31))
    drawn = docs.where((F.pmod(F.xxhash64(F.col(key), F.lit(21)), F.lit(1 << 31)) <= below) & (F.length(F.col(text)) <= max_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(f, y) for i, (f, y) in enumerate(training_windows(b.column(0))) if y.any() or i % 4 == 0]
            yield pa.RecordBatch.from_arrays([pa.array([f.ravel().astype(np.int32) for f, _ in got], pa.list_(pa.int32())),
                                              pa.array([y for _, y in got], pa.list_(pa.int8()))], names=["features", "labels"])

    rows = drawn.select(F.col(text)).mapInArrow(run, "features array<int>, labels array<tinyint>").limit(windows).toArrow()
    both = sorted(zip((v.values.to_numpy() for v in rows["features"]), (v.values.to_numpy() for v in rows["labels"])),
                  key=lambda x: (x[0].tobytes(), x[1].tobytes()))
    if not both:
        return None
    longest = max(len(y) for _, y in both)
    features, labels = np.zeros((len(both), longest, len(GROUPS)), dtype=np.int64), np.full((len(both), longest), -1, dtype=np.int8)
    for i, (f, y) in enumerate(both):
        features[i, :len(y)], labels[i, :len(y)] = f.reshape(-1, len(GROUPS)), y
    return fit(features, labels)


def scan(field: Field | None, col: pa.Array, least: int = 6) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, end, kind)`` in code points, sorted, of every row that has a span. Spans of the field have ``least`` bytes or more."""
    data, offs = text_bytes(col)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi in row_blocks(offs):
        x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        for r in rows_to_search(x, o).tolist():
            if spans := pattern_spans(col[lo + r].as_py()):
                out[lo + r] = spans
        if field is None:
            continue
        tokens = tokenize(x, o)
        labels = field.decode(field.emissions(tokens.features), tokens.first)
        on = np.flatnonzero(labels)
        new = np.ones(len(on), dtype=bool)
        new[1:] = (labels[on[1:]] == BEGIN) | (on[1:] != on[:-1] + 1) | (tokens.row[on[1:]] != tokens.row[on[:-1]])
        heads, tails = on[new], on[np.append(new[1:], True)] if len(on) else on
        for h, t in zip(heads.tolist(), tails.tolist()):
            r, a, z = int(tokens.row[h]), int(tokens.start[h]), int(tokens.end[t])
            if z - a < least:
                continue
            start = len(x[o[r]:a].tobytes().decode())
            end = start + len(x[a:z].tobytes().decode())
            spans = out.setdefault(lo + r, [])
            if not any(s < end and start < e for s, e, _ in spans):
                spans.append((start, end, 3))
                spans.sort(key=lambda s: (s[0], s[2]))
    return {r: s for r, s in out.items() if s}


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", **training) -> DataFrame:
    """``(key, spans)`` per row: spans ``(kind, start, end)`` in code points by start, then kind in the order of ``KINDS``.

    A null text counts as empty and has none; without a plain case to learn from, the patterns alone are used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text, key, **training))  # tables of fixed size
    source = docs.select(F.col(key), F.col(text))
    schema = T.StructType([source.schema[0], T.StructField("spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(shared.value, b.column(1))
            spans = [[{"kind": KINDS[k], "start": a, "end": z} for a, z, k in found.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=schema.names)

    return source.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]", **training) -> DataFrame:
    """The rows of ``docs``, every found span replaced by ``mask``; overlapping spans are replaced once."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text, key, **training))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(shared.value, b.column(at))
            if found:
                texts = b.column(at).to_pylist()
                for r, spans in found.items():
                    parts, upto = [], 0
                    for a, z, _ in spans:
                        if a >= upto:
                            parts += [texts[r][upto:a], mask]
                        upto = max(upto, z)
                    texts[r] = "".join([*parts, texts[r][upto:]])
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
