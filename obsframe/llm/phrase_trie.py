"""Collocations: phrases of 2 to 5 words, counted with broadcast double-array tries of Apriori-safe candidates.

1. Words are counted per language; then pairs of frequent words, by 64-bit hashes; then the phrases all of whose pairs are frequent. No part of a
   candidate can be rarer than it (Apriori). These phrases are counted twice. First by hashed places in a table of fixed size (Park, Chen and Yu 1995): where a
   place is too rare, so is every phrase on it. Then those on other places are counted with their words, and what occurs often enough is a candidate. Counts are
   gathered in each task by numpy before they are shuffled, and a bitmap of fixed size keeps most rare words and pairs out.
2. Candidates are put in double-array tries (Aoe 1989) of at most ``TRIE`` phrases, by a hash of language and first two words, so that all first parts of a phrase are in its
   trie. Each is broadcast; a task advances the states of all positions of a block of texts at once, level by level, and counts the accepting states. Sums over
   tasks are the exact counts. More candidates than one trie holds take more passes, not a larger broadcast.
3. Cuts, scores and containment are joins of the small tables of phrases, in exact decimal arithmetic.

Cases: a null text is empty, a null language is ``und``; repeated rows count each time; a long text is cut between two words, which does not part a
phrase; equal scores go by count and then by the phrase's bytes; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_k_per_group
from ..session import cut_lineage
from .frames import bitmap_of
from .textbatch import U64, find_words, mix, row_blocks, text_bytes

LONGEST = 5
#: Phrases of one broadcast trie: about 20 MB with states and hashes.
TRIE = 1 << 18
#: Bytes of counts, with the words of their phrases, that a task holds before it passes them on, and rows that it passes at a time.
HELD = 1 << 25
PASSED = 1 << 16
FILTER_BITS = 24
#: Places of the table of phrases that are summed up at a time, and how far a task counts on each.
SLICE = 1 << 18
FULL = 255
_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_PIECE_END
_WORD[[32, 9]] = False
_ODD = U64(0xD1342543DE82EF95)


# -- words of texts --------------------------------------------------------------------------

@dataclass
class Block:
    """Words of some texts: hashes that know their language, its number, and whether the next word follows in the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def _language_hashes(names: list[str]) -> np.ndarray:
    """By the bytes of the names alone, so that all tasks agree."""
    data, offs = text_bytes(pa.array(names, pa.string()))
    w = find_words(data, offs, np.ones(256, dtype=bool), lower=False)
    out = np.zeros(len(names), dtype=np.uint64)
    out[w.row()] = w.hash
    return mix(out + U64(1))


def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[str]]]:
    """Blocks of a stream of (language, text), with the names of the languages of their batch."""
    for b in batches:
        codes = b.column(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        seeds, lang_of = _language_hashes(names), codes.indices.to_numpy(zero_copy_only=False)
        data, offs = text_bytes(b.column(1))
        for lo, hi in row_blocks(offs):
            x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            w = find_words(x, o, _WORD)
            row = w.row()
            lang = lang_of[lo:hi][row]
            ends = np.concatenate([[0], np.cumsum(_PIECE_END[x], dtype=np.int32)])
            joined = np.zeros(len(row), dtype=bool)
            joined[:-1] = (row[1:] == row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
            yield Block(x, w.start, w.end, mix(w.hash ^ seeds[lang]) if len(lang) else w.hash, lang, joined), names


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, hash, n)`` of each block; a null word has the number of all words."""
    for b, names in word_blocks(batches):
        hashes, at, n = np.unique(b.word, return_index=True, return_counts=True)
        lang, every = b.lang[at], np.bincount(b.lang, minlength=len(names))
        lower = np.where((b.data >= 65) & (b.data <= 90), b.data + 32, b.data).astype(np.uint8).tobytes()
        words = [lower[s:e].decode() for s, e in zip(b.start[at].tolist(), b.end[at].tolist())]
        k = len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in lang.tolist()] + names, pa.string()), pa.array(words + [None] * k, pa.string()),
             pa.array(np.concatenate([hashes.view(np.int64), np.zeros(k, np.int64)])), pa.array(np.concatenate([n, every]))], names=["lang", "word", "hash", "n"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


def _flags(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - FILTER_BITS)).astype(np.int64)


def _bitmap(hashes: DataFrame) -> bytes:
    return bitmap_of(hashes, F.shiftrightunsigned("hash", 64 - FILTER_BITS), FILTER_BITS)


def _busy(texts: DataFrame) -> DataFrame:
    """As many tasks as keep the cores busy, however long the input is: for passes in which a task gives a row per candidate that it meets."""
    return texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)


class Tally:
    """Counts by hash, with some columns of the first row of each hash."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, *columns: np.ndarray) -> bool:
        """Whether the counts have to be passed on: those of equal hashes are put together before, and kept if they take little room."""
        u, at, n = np.unique(hashes, return_index=True, return_counts=True)
        self._hold(u, n, *(c[at] for c in columns))
        if self.size < HELD:
            return False
        self._merge()
        return self.size >= HELD // 2

    def take(self) -> tuple[np.ndarray, ...]:
        self._merge()
        whole = self.parts[0]
        self.parts, self.size = [], 0
        return whole

    def _hold(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += sum(c.nbytes for c in part)

    def _merge(self) -> None:
        if len(self.parts) > 1:
            whole = [np.concatenate(p) for p in zip(*self.parts)]
            self.parts, self.size = [], 0
            u, at, back = np.unique(whole[0], return_index=True, return_inverse=True)
            self._hold(u, np.bincount(back, whole[1], len(u)).astype(np.int64), *(c[at] for c in whole[2:]))


def _slices(columns: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    for lo in range(0, len(columns[0]), PASSED):
        yield tuple(c[lo:lo + PASSED] for c in columns)


def _pairs(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, tally = _flags(packed), Tally()

        def passed() -> Iterator[pa.RecordBatch]:
            for u, n in _slices(tally.take()):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for b, _ in word_blocks(batches):
            often = flags[_place(b.word)]
            i = np.flatnonzero(b.joined[:-1] & often[:-1] & often[1:])
            if tally.add(pair_hash(b.word[i], b.word[i + 1])):
                yield from passed()
        if tally.size:
            yield from passed()

    return run


def _linked(b: Block, flags: np.ndarray, often: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, at, h)``: where phrases of ``k`` words begin all of whose pairs are flagged, and their hashes; with ``often``, if they and their first parts lie on such places."""
    link = np.zeros(len(b.word), dtype=bool)
    link[:-1] = b.joined[:-1] & flags[_place(pair_hash(b.word[:-1], b.word[1:]))]
    at, h = np.arange(len(b.word)), b.word
    for k in range(2, LONGEST + 1):
        on = link[at + k - 2]
        at, h = at[on], h[on]
        h = pair_hash(h, b.word[at + k - 1])
        if often is not None:
            on = often[_bucket(h)]
            at, h = at[on], h[on]
        if not len(at):
            return
        yield k, at, h


def _bucket(h: np.ndarray) -> np.ndarray:
    """By other bits than ``_place``: a rare pair let through for a frequent one's place is not counted with that one."""
    return (h & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _buckets(packed: bytes):
    """``(slice, counts)``: how many phrases of a task lie on each place, up to ``FULL``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, counts = _flags(packed), np.zeros(1 << FILTER_BITS, dtype=np.uint8)
        for b, _ in word_blocks(batches):
            for _, _, h in _linked(b, flags):
                at, n = np.unique(_bucket(h), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, FULL)
        for i in range(0, len(counts), SLICE):
            part = counts[i:i + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    return run


def _often(texts: DataFrame, packed: bytes, min_count: int) -> bytes:
    """A bit for each place on which all tasks together have ``min_count`` phrases, or one task more than it counts."""
    def summed(t: pa.Table) -> pa.Table:
        total, full = np.zeros(SLICE, dtype=np.int64), np.zeros(SLICE, dtype=bool)
        for counts in t["counts"]:
            one = np.frombuffer(counts.as_buffer(), np.uint8)
            total += one
            full |= one == FULL
        bits = np.packbits((total >= min_count) | full, bitorder="little")
        return pa.table([t["slice"].slice(0, 1), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

    made = _busy(texts).mapInArrow(_buckets(packed), "slice int, counts binary")
    known = {r["slice"]: bytes(r["bits"]) for r in made.groupBy("slice").applyInArrow(summed, "slice int, bits binary").collect()}
    return b"".join(known.get(i, bytes(SLICE // 8)) for i in range((1 << FILTER_BITS) // SLICE))


def _phrases(packed: bytes, places: bytes | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, often, tally = _flags(packed), None if places is None else _flags(places), Tally()
        names: dict[str, int] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            known = pa.array(list(names), pa.string())
            for _, n, lang, words in _slices(tally.take()):
                length = (words != 0).sum(1)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(words[words != 0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(lang)), flat, pa.array(n)], names=["lang", "words", "n"])

        for b, langs in word_blocks(batches):
            number = np.array([names.setdefault(x, len(names)) for x in langs] or [0])
            for k, at, h in _linked(b, flags, often):
                words = np.zeros((len(at), LONGEST), dtype=np.uint64)
                for j in range(k):
                    words[:, j] = b.word[at + j]
                if tally.add(h ^ U64(k), number[b.lang[at]], words):
                    yield from passed()
        if tally.size:
            yield from passed()

    return run


# -- tries -----------------------------------------------------------------------------------

class DoubleArray:
    """A trie over word hashes: the child of state ``s`` by symbol ``c`` is ``base[s] + c``, if ``check`` says that it is a child of ``s``.

    Symbols are ranks of the hashes that occur. ``key`` has the number of the phrase that ends in a state, or -1.
    """

    def __init__(self, phrases: list[np.ndarray]):
        self.hashes = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
        ids = [np.searchsorted(self.hashes, p).tolist() for p in phrases]
        size = max(1024, 4 * sum(len(p) for p in phrases) + len(self.hashes) + 2)
        base, check, key, used = *(np.full(size, -1, np.int32) for _ in range(3)), np.zeros(size, np.int32)
        used[0] = 1  # the root
        level = [(0, 0, sorted(range(len(ids)), key=lambda i: ids[i]))]
        free = 1
        while level:
            below = []
            for state, depth, mine in level:
                children: dict[int, list[int]] = {}
                for i in mine:
                    if len(ids[i]) == depth:
                        key[state] = i
                    else:
                        children.setdefault(ids[i][depth], []).append(i)
                if not children:
                    continue
                symbols = np.array(list(children))
                at = max(free - int(symbols[0]), 1)
                step = 512
                while True:  # the first shift at which all places are free, looked for in growing windows
                    if at + step + int(symbols[-1]) >= len(used):
                        more = len(used) + step + int(symbols[-1])
                        base, check, key, used = (np.concatenate([a, np.full(more, fill, np.int32)]) for a, fill in ((base, -1), (check, -1), (key, -1), (used, 0)))
                    taken = np.zeros(step, dtype=bool)
                    for c in symbols.tolist():
                        taken |= used[at + c:at + c + step] > 0
                    hit = np.flatnonzero(~taken)
                    if len(hit):
                        at += int(hit[0])
                        break
                    at, step = at + step, min(2 * step, 1 << 16)
                base[state] = at
                places = at + symbols
                check[places], used[places] = state, 1
                while used[free]:
                    free += 1
                below += [(int(p), depth + 1, inner) for p, inner in zip(places.tolist(), children.values())]
            level = below
        top = int(np.flatnonzero(used)[-1]) + 1
        self.base, self.check, self.key = base[:top], check[:top], key[:top]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and for which of the given ones there is one. A negative symbol has none."""
        base = self.base[state]
        there = np.where((base >= 0) & (symbol >= 0), base + symbol, len(self.check))
        ok = there < len(self.check)
        ok[ok] = self.check[there[ok]] == state[ok]
        return there, ok

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def trie_counts(trie: DoubleArray, blocks: Iterator[Block]) -> np.ndarray:
    """How often each state accepts, over all positions of the blocks."""
    out = np.zeros(len(trie.key), dtype=np.int64)
    accepts = trie.key >= 0
    for b in blocks:
        symbol = trie.symbols(b.word)
        at = np.flatnonzero(symbol >= 0)
        state = np.zeros(len(at), dtype=np.int64)
        for depth in range(LONGEST):
            state, ok = trie.step(state, symbol[at + depth])
            state, at = state[ok], at[ok]
            out += np.bincount(state[accepts[state]], minlength=len(out))
            more = b.joined[at + depth]
            state, at = state[more], at[more]
            if not len(at):
                break
    return out


def count_candidates(texts: DataFrame, candidates: DataFrame, trie: int = TRIE) -> DataFrame:
    """``(lang, words, a)``: the exact counts of ``candidates`` ``(lang, words, id)`` in ``texts`` ``(lang, text)``, a trie after the other.

    A task gives one row per candidate that it meets, so there are few (``_busy``), and each streams its share of the texts through counts as large as the trie.
    """
    spark = texts.sparkSession
    texts = _busy(texts)
    n = candidates.count()
    rounds = max(1, -(-n // trie))
    shard = F.pmod(F.xxhash64("lang", F.slice("words", 1, 2)), F.lit(rounds))
    counted = None
    for i in range(rounds):
        mine = candidates.where(shard == i)
        rows = mine.select("id", "words").toArrow()  # about ``trie`` rows
        built = DoubleArray([w.values.to_numpy().view(np.uint64) for w in rows["words"].combine_chunks()] if len(rows) else [])
        shared = spark.sparkContext.broadcast((built, rows["id"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built, ids = shared.value
            n = trie_counts(built, (b for b, _ in word_blocks(batches)))
            state = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[built.key[state]], pa.int64()), pa.array(n[state])], names=["id", "n"])

        part = cut_lineage(texts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("a")))
        counted = part if counted is None else counted.unionByName(part)
    return candidates.join(counted, "id").select("lang", "words", "a")


# -- scores ----------------------------------------------------------------------------------

def _exact(c: str, digits: int = 15) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, min_count: int = 100, k: int = 2000, text: str = "text", lang: str = "lang", trie: int = TRIE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``k`` phrases of each language by ``score``, then ``a``, then the phrase.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all words of the language; ``score`` is the floor of
    ``1000 a n / (l r)``. A phrase within a longer one that is as frequent is left out. Counts below 10^15 are exact.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("a"))
    words = cut_lineage(counted.where(F.col("word").isNull() | (F.col("a") >= min_count)))
    total, words = words.where(F.col("word").isNull()).select("lang", F.col("a").alias("n")), words.where(F.col("word").isNotNull())
    pairs = texts.mapInArrow(_pairs(_bitmap(words)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    packed = _bitmap(cut_lineage(pairs.select("hash")))
    listed = _phrases(packed, _often(texts, packed, min_count))
    proposed = _busy(texts).mapInArrow(listed, "lang string, words array<long>, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))
    proposed = proposed.where(F.col("n") >= min_count).select("lang", "words", F.monotonically_increasing_id().alias("id"))
    candidates = cut_lineage(count_candidates(texts, cut_lineage(proposed), trie).where(F.col("a") >= min_count))

    # every part of a candidate is a candidate or a frequent word
    known = candidates.unionByName(words.select("lang", F.array("hash").alias("words"), "a"))
    part = lambda side, n: known.select("lang", F.col("words").alias(side), F.col("a").alias(n))
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("cut")).alias("left"), F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")).alias("right"))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    top, bottom = _exact("a") * F.lit(1000).cast("decimal(4,0)") * _exact("n"), _exact("l") * _exact("r")
    scored = scored.withColumn("__top", top).withColumn("__bottom", bottom).withColumn("score", F.expr("__top div __bottom"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    longer = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("whole"), "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inside = longer.select("lang", "whole", F.expr("explode(transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m)))").alias("words"))
    inside = inside.groupBy("lang", "words").agg(F.max("whole").alias("whole"))
    kept = best.join(inside, ["lang", "words"], "left").where(F.coalesce(F.col("whole") < F.col("a"), F.lit(True)))

    spelled = kept.select("lang", "words", F.posexplode("words").alias("pos", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "word"))).word, " ").alias("phrase"))
    rows = cut_lineage(kept.join(spelled, ["lang", "words"]).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return top_k_per_group(rows, ["lang"], order, k, "rank").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
