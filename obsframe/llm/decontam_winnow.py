"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken 2003).

Of every ``span - k + 1`` consecutive hashes of k words the smallest is kept as a fingerprint, so two texts that share
``span`` words share a fingerprint inside them. Fingerprints of documents and items are joined, and each hit is
extended word by word on both sides; what is reported rests on words, not on hashes. An item shorter than ``span``
words is one window by itself and is looked up by the hash of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textbatch import LOWER, U64, Words, find_words, mix, row_blocks, text_bytes

#: Leading bits of a fingerprint that index the fixed-size filter of item fingerprints.
FILTER_BITS = 22


def gram_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which k words of one row begin, and the hashes of all k-word runs (by word number)."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = w.hash[:n - k + 1].copy()
    for j in range(1, k):
        acc = acc * U64(0xD1342543DE82EF95) + w.hash[j:n - k + 1 + j]
    stop = np.repeat(w.first[1:], np.diff(w.first))
    at = np.arange(n - k + 1)
    return at[at + k <= stop[:n - k + 1]], mix(acc + U64(k))


def winnow(w: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the fingerprints; of equal smallest hashes in a window the last counts."""
    windows, _ = gram_hashes(w, span)
    _, grams = gram_hashes(w, k)
    if not len(windows):
        return windows, np.zeros(0, np.uint64)
    at, best = windows.copy(), grams[windows]
    for step in range(1, span - k + 1):
        other = grams[windows + step]
        less = other <= best
        best[less] = other[less]
        at[less] = windows[less] + step
    kept = np.ones(len(at), dtype=bool)
    kept[1:] = at[1:] != at[:-1]
    return at[kept], best[kept]


def whole(w: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of m words, apart from those of fingerprints."""
    at, grams = gram_hashes(w, m)
    return at, mix(grams[at] ^ U64(0xA5A5A5A5A5A5A5A5))


def _context(low: bytes, w: Words, lo: int, hi: int) -> str:
    return " ".join(low[a:z].decode() for a, z in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist()))


def _hits(data, w: Words, k: int, span: int, lengths: list[int], known: np.ndarray | None):
    """``(row, fingerprint, words before it, context, need)`` → word numbers within the row, of fingerprints in ``known``."""
    low, row = LOWER[data].tobytes(), w.row()
    found: dict[tuple, list[int]] = {}
    for m, (at, fp) in [(0, winnow(w, k, span)), *((m, whole(w, m)) for m in lengths)]:
        if known is not None:
            hit = known[(fp >> U64(64 - FILTER_BITS)).astype(np.int64)]
            at, fp = at[hit], fp[hit]
        for i, f in zip(at.tolist(), fp.view(np.int64).tolist()):
            r = int(row[i])
            begin, stop = int(w.first[r]), int(w.first[r + 1])
            lo, hi = (i, i + m) if m else (max(begin, i - span + k), min(stop, i + span))
            found.setdefault((r, f, i - lo, _context(low, w, lo, hi), m or span), []).append(i - begin)
    return found


def item_fingerprints(items: DataFrame, item: str, text: str, k: int, span: int) -> DataFrame:
    """``(item, fp, lead, context, need)``: fingerprints with the words around them; items without words give none."""
    schema = "item string, fp long, lead int, context string, need int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, (data, offs) = b.column(0).to_pylist(), text_bytes(b.column(1))
            for lo, hi in row_blocks(offs):
                part, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                w = find_words(part, o)
                count = np.diff(w.first)
                keep = [(names[lo + r], f, lead, c, need) for r, f, lead, c, need in
                        _hits(part, w, k, span, sorted(set(count[(count > 0) & (count < span)].tolist())), None)
                        if need == min(span, count[r])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*keep) if keep else ([],) * 5, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()))],
                    names=["item", "fp", "lead", "context", "need"])

    return items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).mapInArrow(run, schema)


def _filter_of(fingerprints: DataFrame) -> np.ndarray:
    """One flag per leading ``FILTER_BITS`` bits: half a MB however many items there are; it only spares work."""
    n = F.shiftrightunsigned("fp", 64 - FILTER_BITS) + 1
    rows = (fingerprints.select(n.alias("n")).groupBy(F.bitmap_bucket_number("n").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).collect())
    known = np.zeros(1 << FILTER_BITS, dtype=bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        at = (r["bucket"] - 1) * len(bits)
        known[at:at + len(bits)] = bits
    return np.packbits(known)


def document_hits(docs: DataFrame, fingerprints: DataFrame, key: str, text: str, k: int, span: int) -> DataFrame:
    """Per row ``(key, text_hash, n_words)``, and rows ``(key, text_hash, fp, lead, context, need, at)`` for its fingerprints
    that may belong to an item."""
    known = _filter_of(fingerprints)
    lengths = [r[0] for r in fingerprints.where(F.col("need") < span).select("need").distinct().collect()]
    source = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))
    fields = [("n_words", pa.int64()), ("fp", pa.int64()), ("lead", pa.int32()), ("context", pa.string()), ("need", pa.int32()), ("at", pa.list_(pa.int32()))]
    schema = source.select(key, "text_hash").schema
    for name, kind in zip(("n_words", "fp", "lead", "context", "need"), ("long", "long", "integer", "string", "integer")):
        schema = schema.add(name, kind)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", at array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(known).astype(bool)
        for b in batches:
            data, offs = text_bytes(b.column(2))
            for lo, hi in row_blocks(offs):
                part, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                w = find_words(part, o)
                hits = _hits(part, w, k, span, lengths, flags)
                rows = [*range(lo, hi), *(lo + x[0] for x in hits)]
                own = [None] * (hi - lo)
                cols = [[*np.diff(w.first).tolist(), *[None] * len(hits)], *([*own, *(x[i] for x in hits)] for i in (1, 2, 3, 4)), [*own, *hits.values()]]
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, t) for c, (_, t) in zip(cols, fields))],
                    names=[*b.schema.names[:2], *(name for name, _ in fields)])

    return source.mapInArrow(run, ddl)


def _extend(theirs: list[str], at: int, ours: list[str], where: int, k: int) -> tuple[int, int]:
    """Equal words before and after the k words at the given places; (-1, -1) if those differ."""
    if theirs[at:at + k] != ours[where:where + k]:
        return -1, -1
    a = b = 0
    while a < min(at, where) and theirs[at - a - 1] == ours[where - a - 1]:
        a += 1
    while at + k + b < len(theirs) and where + k + b < len(ours) and theirs[at + k + b] == ours[where + k + b]:
        b += 1
    return a, b


def shared_spans(hits: DataFrame, fingerprints: DataFrame, key: str, k: int, span: int) -> DataFrame:
    """``(key, text_hash, item, spans)``: word ranges of the document, each within a run of ``span`` words that the item has
    too. A fingerprint of many documents meets few item rows; its rows are split by the join where they are many."""
    mine = hits.where(F.col("fp").isNotNull()).select(key, "text_hash", "fp", "lead", "context", "need", "at")
    theirs = fingerprints.select("fp", "need", F.col("lead").alias("item_lead"), F.col("context").alias("item_context"), "item")
    pairs = mine.join(theirs, ["fp", "need"])
    pairs = pairs.select(key, "text_hash", "item", "lead", "context", "need", "at", "item_lead", "item_context")
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, begins, ends = [], [], []
            cols = [b.column(i).to_pylist() for i in range(3, 9)]
            for i, (lead, context, need, at, item_lead, item_context) in enumerate(zip(*cols)):
                ours, theirs = context.split(" "), item_context.split(" ")
                width = k if need == span else need
                left, right = _extend(theirs, item_lead, ours, lead, width)
                if left >= 0 and left + right + width >= need:
                    rows.append(i)
                    begins.append([p - left for p in at])
                    ends.append([p + width + right for p in at])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(3)), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                names=[*b.schema.names[:3], "begins", "ends"])

    return pairs.mapInArrow(run, f"`{key}` {kind}, text_hash long, item string, begins array<int>, ends array<int>")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, key: str = "doc_id", text: str = "text",
                  item: str = "item_id") -> DataFrame:
    """``(key, text_hash, n_words, n_hit, n_items, items, contaminated)`` per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of an item's window, ``items`` lists the items as sorted strings.
    Null texts have no words; a null item id counts as an empty string; repeated rows get the same answer; without items
    nothing is hit.
    """
    prints = cut_lineage(item_fingerprints(items, item, text, k, span))
    hits = cut_lineage(document_hits(docs, prints, key, text, k, span))
    spans = cut_lineage(shared_spans(hits, prints, key, k, span))
    ranges = (spans.select(key, "text_hash", F.explode(F.arrays_zip("begins", "ends")).alias("r")).distinct()
              .groupBy(key, "text_hash").agg(F.array_sort(F.collect_list("r")).alias("r")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    union = F.aggregate("r", start, lambda s, x: F.struct(
        (s.n + F.greatest(x.ends - F.greatest(x.begins, s.upto), F.lit(0))).alias("n"), F.greatest(s.upto, x.ends).alias("upto")))
    covered = ranges.select(key, "text_hash", union.n.cast("long").alias("__hit"))
    named = spans.select(key, "text_hash", "item").distinct().groupBy(key, "text_hash").agg(F.sort_array(F.collect_list("item")).alias("__items"))
    found = covered.join(named.withColumnsRenamed({key: "__k", "text_hash": "__t"}), F.col(key).eqNullSafe(F.col("__k")) & (F.col("text_hash") == F.col("__t")))
    found = found.select(F.col(key).alias("__k"), F.col("text_hash").alias("__t"), "__hit", "__items")
    rows = hits.where(F.col("n_words").isNotNull()).select(key, "text_hash", "n_words")
    out = rows.join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col("text_hash") == F.col("__t")), "left")
    names = F.coalesce("__items", F.array().cast("array<string>"))
    n = F.coalesce("__hit", F.lit(0).cast("long"))
    return out.select(key, "text_hash", "n_words", n.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"),
                      (n > 0).alias("contaminated"))
