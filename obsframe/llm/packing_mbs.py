"""Packing of token sequences by minimum bin slack (Gupta and Ho 1999).

Texts become token ids, cut into pieces of at most one window. How pieces share windows depends on their lengths
alone, so it is planned on the histogram of lengths, which has at most one row per length however many rows there are:
for the longest piece left, a subset-sum over the multiset of remaining lengths finds the fill closest to the window,
and the pattern found is used as often as the counts allow. Pieces are then numbered within their length
and look their window and offset up in the plan.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .frames import number_rows
from .textbatch import per_row, text_bytes

#: Entries of a worker's cache of words already split into ids.
CACHED_WORDS = 1_000_000
#: Marks that may be split off the end of a word: they never join the letters before them.
_TAIL = ".,!?:;*%&$#|"


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Ids of the parts of a text between blanks, as little-endian unsigned 32-bit values.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts. A part is split
    once and kept. Parts of letters up to U+00FF in lower case, with marks after them, go straight to the tokenizer's model,
    since nothing before it would change them; all other parts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.tokenizer, self.letters, self.known = Tokenizer.from_file(path), _byte_letters(), {}
        self.direct = self._keeps_letters()

    def _keeps_letters(self) -> bool:
        """Whether the short way gives what the whole tokenizer gives, tried on words of both kinds."""
        words = ["thing", "élan", "straße", "ñandú", "a", "zzzzzzzz", "ªº", "øåæ"]
        return all(self._ids(w) == [t.id for t in self.tokenizer.model.tokenize(self._spelled(w))] for w in words) and (
            self._ids("thing.,") == self._ids("thing") + self._ids(".,"))

    def _ids(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _spelled(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _add(self, part: str, plain: bool) -> bytes:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        if plain:
            word = part.rstrip(_TAIL)
            if word.isalpha():
                if len(word) < len(part):
                    raw = self._get(word, True) + self._get(part[len(word):], True)
                else:
                    raw = array("I", [t.id for t in self.tokenizer.model.tokenize(self._spelled(word))]).tobytes()
                self.known[part] = raw
                return raw
        self.known[part] = raw = array("I", self._ids(part)).tobytes()
        return raw

    def _get(self, part: str, plain: bool) -> bytes:
        return self.known.get(part) or self._add(part, plain)

    def of_text(self, text: str, latin: bool) -> bytes:
        """``latin``: the text has no character beyond U+00FF. Special tokens are looked for before letters are made small."""
        plain = self.direct and latin and "<|" not in text
        parts = (text.lower() if plain else text).replace("\n", " ").split(" ")
        known = self.known
        return b"".join([known.get(p) or self._add(p, plain) for p in parts if p])


_loaded: dict[str, WordIds] = {}


def token_bytes(col: pa.Array, path: str) -> Iterator[bytes]:
    """The ids of each text of a column; null counts as empty."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    data, offs = text_bytes(col)
    latin = per_row(data, offs, np.maximum) <= 0xC3
    for text, is_latin in zip(col, latin.tolist()):
        yield _loaded[path].of_text(text.as_py() or "", is_latin)


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text",
               with_ids: bool = False) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens)`` per piece, with its ``ids`` if asked for.

    A text's ids are followed by ``end_id``; null counts as empty, so every row gives one piece at least. Pieces
    are full windows and a rest.
    """
    schema = T.StructType([docs.select(F.col(key)).schema[0], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end, width = int(end_id).to_bytes(4, "little"), 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for i, raw in enumerate(token_bytes(b.column(1), tokenizer)):
                raw += end
                for at in range(0, len(raw), width):
                    piece = raw[at:at + width]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(raw) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            cols = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is closest to ``capacity`` from below, longest lengths first.

    Reachable sums are the bits of one integer. A length that may be taken m times enters in groups of 1, 2, 4 ... so
    that each group is one shift; the sums before each group are kept, and the way back reads the counts off them.
    """
    mask, sums, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left:
            take = min(group, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            group *= 2
        if sums >> capacity & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: count})`` patterns that use up every piece of the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    plan = []
    while left:
        first = max(left)
        left[first] -= 1
        pattern = fill(left, window - first)
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[x] // c for x, c in pattern.items())
        for x, c in pattern.items():
            left[x] -= times * c
            if not left[x]:
                del left[x]
        plan.append((times, pattern))
    return plan


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id``, gapless ``offset`` in it, and the sequence's tokens and padded length.

    A sequence is padded to the window unless its tokens are a power of two. Equal pieces of equal rows are told apart
    by nothing and may trade places. The plan has at most as many entries as lengths a window can hold; its size
    follows the window, not the data.
    """
    pieces = cut_lineage(cut_pieces(docs, tokenizer, window, end_id, key, text, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries, base = [], 0
    for times, pattern in plan_windows(histogram, window):
        offset, tokens = 0, sum(x * c for x, c in pattern.items())
        for length, count in sorted(pattern.items(), reverse=True):
            entries.append((length, count, times, base, offset, tokens))
            offset += length * count
        base += times
    entries.sort(key=lambda e: e[0])
    length, count, times, base, offset, tokens = (np.array(c, dtype=np.int64) for c in zip(*entries)) if entries else np.zeros((6, 0), np.int64)
    used = count * times
    begin = np.cumsum(used) - used
    first = np.searchsorted(length, length)
    begin = begin - begin[first] if len(begin) else begin
    numbered = number_rows(pieces, "length", "__rank")
    schema = pieces.schema
    for c in ("sequence_id", "offset", "sequence_tokens", "padded_to"):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rank = np.asarray(b.column("length")), np.asarray(b.column("__rank"))
            at = np.zeros(len(own), dtype=np.int64)
            for x in np.unique(own):  # at most as many as lengths
                lo, hi = np.searchsorted(length, [x, x + 1])
                mine = own == x
                at[mine] = lo + np.searchsorted(begin[lo:hi], rank[mine], "right") - 1
            inside = rank - begin[at]
            total = tokens[at]
            padded = np.where(total & (total - 1), window, total)
            new = base[at] + inside // count[at], offset[at] + inside % count[at] * own, total, padded
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, new)], names=schema.names)

    return numbered.mapInArrow(run, schema)
