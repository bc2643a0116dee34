"""Near-duplicate detection by Order MinHash (Marçais et al. 2019).

A document's shingles of five words, and those of three, are labelled with their occurrence, so that repeats count. For each of several random
orders the smallest few labelled shingles, some way apart, are taken and kept in text order: two documents agree on such a
tuple with a probability that follows their edit similarity, not only the sets of shingles they share. Documents that agree on a tuple are candidates,
and a banded alignment of their words decides: they are linked if at most a fifth of the longer one's words must be edited.
Classes are the connected components of the links, and all documents of the same words are in one class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..operators.pairwise import BLOCK
from ..session import arrow_batches, cut_counted, cut_lineage, drop_steps, tasks_for
from .frames import bitmap_of
from .textbatch import U64, SpanHash, Words, find_words, mix, per_row, row_blocks, text_bytes

SHINGLE = 5
TUPLES = 32
#: Edits of a fifth of the words may leave no shingle of five words whole, but always two in five of those of three words.
SHORT_SHINGLE = 3
SHORT_TUPLES = 96
#: Shingles of one tuple begin at least so many words apart, or this share of a shorter text. Texts that have no more than a passage
#: in common, a licence say, then do not agree on a tuple.
APART, APART_SHARE = 80, 0.4
FILTER_BITS = 22
#: A tuple that more nodes of one component have sends others to the component, not to each of these nodes.
MANY = 64
#: Tuples of more undecided nodes than this count as crowded: their nodes are gathered into homes.
CROWD = 16
#: Bytes of text that are sketched at a time.
SLICE = 1 << 19
#: Bytes of a batch that goes to Python: of pairs with their words 10,000 would take 50 MB, which an executor holds several times for each core.
BATCH = 8 << 20
#: 64-bit words of the bitmap that says which words, by hash, a text has.
BITMAP = 16
_OTHER_BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def content_ids(x: np.ndarray, offs: np.ndarray, w: Words) -> np.ndarray:
    """Two 64-bit numbers that name a text's sequence of words; texts without words are named by their bytes."""
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
    out = np.empty((len(offs) - 1, 2), dtype=np.uint64)
    for i, odd in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
        out[:, i] = mix(per_row(mix(w.hash + U64(i)) * mix((place.astype(np.uint64) + U64(1)) * U64(odd)), w.first) + U64(1) + np.diff(w.first).astype(np.uint64))
    bare = np.flatnonzero(np.diff(w.first) == 0)
    for i, values in enumerate((None, _OTHER_BYTES)):
        if len(bare):
            h = SpanHash(x) if values is None else SpanHash(x, values)
            out[bare, i] = mix(h(offs[bare], offs[bare + 1]) ^ (offs[bare + 1] - offs[bare]).astype(np.uint64))
    return out


def _binary(ids: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in ids], pa.binary())


def labelled_shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with their occurrence number in the row, and the number of each row's first shingle."""
    n = np.maximum(np.diff(w.first) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) - first[row] + w.first[row]
    h = w.hash[at].copy()
    for j in range(1, k):
        h = h * U64(0xD1342543DE82EF95) + w.hash[at + j]
    h = mix(h)
    own = mix(h ^ mix(row.astype(np.uint64) + U64(1)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(total, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    count = np.empty(total, dtype=np.int64)
    count[order] = np.arange(total) - np.repeat(begin, np.diff(np.append(begin, total)))
    return mix(h + count.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), first


def word_bitmaps(w: Words) -> np.ndarray:
    """Rows by ``BITMAP`` 64-bit words; the bit of every word of the row is set. An edit changes two bits at most, so texts whose
    bitmaps differ in more bits than twice the edits allowed cannot be linked."""
    bit = (w.hash >> U64(7)) % U64(64 * BITMAP)
    mask = U64(1) << (bit & U64(63))
    return np.stack([per_row(np.where(bit >> U64(6) == U64(i), mask, U64(0)), w.first, np.bitwise_or) for i in range(BITMAP)], 1)


def order_sketch(shingles: np.ndarray, first: np.ndarray, tuples: int = TUPLES, k: int = SHINGLE, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, sketch)``: for every row with shingles one value per random order, the hash of its smallest shingle and the smallest
    some way apart from it, in text order. A row without a second one takes the first alone. Orders are numbered from ``begin``."""
    rows = np.flatnonzero(np.diff(first))
    sketch = np.empty((len(rows), tuples), dtype=np.uint64)
    if not len(rows):
        return rows, sketch
    start, end = first[rows], first[rows + 1]
    size = end - start
    low, used = U64((1 << 24) - 1), U64(2 ** 64 - 1)
    place = (np.arange(len(shingles)) - np.repeat(start, size)).astype(np.uint64)
    high, v = shingles & ~low, np.empty_like(shingles)
    apart = np.maximum(np.minimum(APART, (APART_SHARE * (size + k - 1)).astype(np.int64)), 1)
    cuts = np.empty((len(rows), 3), dtype=np.int64)  # of each row: what is left of the first minimum, what is too near to it, what is right of it
    cuts[:, 0] = start
    for j in range(tuples):
        np.multiply(high, np.random.default_rng(1000 + begin + j).integers(1, 1 << 63, 1, dtype=np.uint64) << U64(1) | U64(1), out=v)
        v |= place & low  # the place of a minimum comes with it; the low bits of ``high`` are none
        at = start + (np.minimum.reduceat(v, start) & low).astype(np.int64)
        left, right = at - apart + 1, at + apart
        cuts[:, 1], cuts[:, 2] = np.where(left > start, left, start), np.where(right < end, right, at)
        least = np.minimum.reduceat(v, cuts.ravel()).reshape(-1, 3)
        second = np.minimum(np.where(left > start, least[:, 0], used), np.where(right < end, least[:, 2], used))
        alone = second == used
        other = np.where(alone, at, start + (second & low).astype(np.int64))
        h = mix(U64(begin + j + 1) + np.where(alone, U64(0), shingles[np.minimum(at, other)]))
        sketch[:, j] = mix(h * U64(0xD1342543DE82EF95) + shingles[np.maximum(at, other)])
    return rows, sketch


def text_sketch(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, sketch)`` of the rows of five words or more: the tuples of their long and then of their short shingles."""
    rows, long = order_sketch(*labelled_shingles(w))
    more, short = order_sketch(*labelled_shingles(w, SHORT_SHINGLE), SHORT_TUPLES, SHORT_SHINGLE, TUPLES)
    return rows, np.concatenate([long, short[np.searchsorted(more, rows)]], axis=1)


def within_band(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``.

    Only cells within ``most`` of the diagonal are looked at. A column of the band is two integers whose bits say where
    the next row costs one more or one less (Myers 1999, Hyyrö 2003); the distance is read along the band's lower edge
    and then along the last row.
    """
    same = np.flatnonzero(a[:min(len(a), len(b))] != b[:min(len(a), len(b))])
    head = int(same[0]) if len(same) else min(len(a), len(b))
    a, b = a[head:], b[head:]
    same = np.flatnonzero(a[::-1][:min(len(a), len(b))] != b[::-1][:min(len(a), len(b))])
    tail = int(same[0]) if len(same) else min(len(a), len(b))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return False
    if not m or not n:
        return True
    left = Counter(a.tolist())
    shared = sum(min(c, left[x]) for x, c in Counter(b.tolist()).items() if x in left)
    if max(m, n) - shared > most:  # a word without a partner costs an edit
        return False
    below, above = min(most, m), most
    width = below + above + 1
    full, top = (1 << width) - 1, width - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    more, less, cost = full & ~((1 << above) - 1), 0, below
    for j, x in enumerate(b.tolist(), 1):
        match = places.get(x, 0)
        shift = j - above - 1
        match = (match >> shift if shift >= 0 else match << -shift) & full
        level = ((((match & more) + more) ^ more) | match | less) & full
        right_more = less | (full & ~(level | more))
        right_less = level & more
        if j <= m - below:
            cost += not level >> top & 1
        else:
            at = m - j + above
            cost += (right_more >> at & 1) - (right_less >> at & 1)
        down = level >> 1
        more = right_less | (full & ~(down | right_more))
        less = down & right_more
    return cost <= most


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    source = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))
    schema = T.StructType([*source.schema[:2], T.StructField("content", T.BinaryType()), T.StructField("n_words", T.LongType()),
                           T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("bitmap", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column(2))
            for lo, hi in row_blocks(offs, SLICE):
                x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                w = find_words(x, o, scripts=True)
                rows, sketch = text_sketch(w)
                listed: list = [None] * (hi - lo)
                for r, s in zip(rows.tolist(), sketch.view(np.int64)):
                    listed[r] = s
                part = b.slice(lo, hi - lo)
                bitmap = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BITMAP, pa.int32()), pa.array(word_bitmaps(w).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], _binary(content_ids(x, o, w)), pa.array(np.diff(w.first)), pa.array(listed, pa.list_(pa.int64())), bitmap],
                    names=schema.names)

    return source.mapInArrow(run, schema)


def _flags(wanted: DataFrame) -> bytes:
    """A bitmap of fixed size over the first bits of the contents of ``wanted``."""
    place = F.shiftright(F.conv(F.hex(F.substring("content", 1, 3)), 16, 10).cast("long"), 24 - FILTER_BITS)
    return bitmap_of(wanted, place, FILTER_BITS)


def _flagged(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the contents, as rows of 16 bytes, are in the bitmap."""
    head = ids[:, :3].astype(np.int64)
    return flags[(head[:, 0] << 16 | head[:, 1] << 8 | head[:, 2]) >> (24 - FILTER_BITS)]


def _unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)


def _among(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``content`` is one of those of ``wanted``, and few others, so that a join with wide rows shuffles little; the join decides."""
    packed, at = _flags(wanted), table.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _unpacked(packed)
        for b in batches:
            data, offs = text_bytes(b.column(at))
            yield b.filter(pa.array(_flagged(flags, data[offs[0]:offs[-1]].reshape(len(b), 16))))

    return table.mapInArrow(run, table.schema)


def _word_codes(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``(content, words)`` of the wanted contents, words as 64-bit hashes.

    A bitmap of fixed size over the first bits of the contents keeps texts that are certainly not wanted out of the
    shuffle; the join decides.
    """
    packed = _flags(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _unpacked(packed)
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for lo, hi in row_blocks(offs, SLICE):
                x, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                w = find_words(x, o, scripts=True)
                ids = content_ids(x, o, w)
                kept = np.flatnonzero(_flagged(flags, ids.view(np.uint8).reshape(len(ids), 16)))
                words = [w.hash[w.first[r]:w.first[r + 1]].view(np.int64) for r in kept]
                yield pa.RecordBatch.from_arrays([_binary(ids[kept]), pa.array(words, pa.list_(pa.int64()))], names=["content", "words"])

    coded = docs.select(F.col(text)).mapInArrow(run, "content binary, words array<long>")
    return coded.join(wanted, "content", "left_semi").dropDuplicates(["content"])


def _linked(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(src, dst)`` whose alignment stays within the band."""
    both = (pairs.join(words.select(F.col("content").alias("src"), F.col("words").alias("__a")), "src")
            .join(words.select(F.col("content").alias("dst"), F.col("words").alias("__b")), "dst").select("src", "dst", "__a", "__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                keep.append(within_band(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "src binary, dst binary")


def _shared_bands(nodes: DataFrame, rows: int = 8192) -> DataFrame:
    """``(id, band, __n)`` of the tuples that several nodes have, ``__n`` of them.

    Values are dealt by their leading bits to four parts a shuffle partition. A part's values of some nodes travel as one row, two arrays of values and of
    places from the first of these nodes on: ten bytes a value, most of which no other node has.
    """
    parts = min(4 * max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), (1 << 16) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sketch = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().view(np.uint64).reshape(len(b), -1)
            new = np.flatnonzero(np.diff(ids) != 1) + 1  # places stand for numbers without gaps
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(ids)]):
                for lo in range(a, z, rows):
                    values = sketch[lo:min(lo + rows, z)]
                    node = np.repeat(np.arange(len(values), dtype=np.uint16), values.shape[1])
                    part = (((values.ravel() >> U64(32)) * U64(parts)) >> U64(32)).astype(np.uint16)
                    order = np.argsort(part, kind="stable")
                    value, node = values.ravel()[order], node[order]
                    cut = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                    own = [i for i in range(parts) if cut[i] < cut[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int32()), pa.array([int(ids[lo])] * len(own), pa.int64()), pa.array([value[cut[i]:cut[i + 1]].tobytes() for i in own], pa.binary()),
                         pa.array([node[cut[i]:cut[i + 1]].tobytes() for i in own], pa.binary())], names=["part", "first", "values", "places"])

    def meet(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint64)
        places = [np.frombuffer(x, np.uint16) for x in table["places"].to_pylist()]
        ids = np.concatenate(places).astype(np.int64) + np.repeat(table["first"].to_numpy(), [len(x) for x in places])
        order = np.argsort(value)
        ranked = value[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        n = np.diff(np.append(begin, len(ranked)))
        n = np.repeat(n, n)
        return pa.table({"id": ids[order][n > 1], "band": ranked[n > 1].view(np.int64), "__n": n[n > 1]})

    return nodes.select("id", "sketch").mapInArrow(deal, "part int, first long, values binary, places binary").groupBy("part").applyInArrow(meet, "id long, band long, __n long")


def _parts(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(content, component)`` of the nodes that have links. Of the links that gave the parts ``before``, only one a node is needed."""
    if before is not None:
        links = before.where(F.col("content") != F.col("component")).select(F.col("content").alias("src"), F.col("component").alias("dst")).unionByName(links)
    return cut_lineage(connected_components(links).select(F.col("name").alias("content"), "component"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("content"))


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(parts, "content", "left").withColumn("component", F.coalesce("component", "content"))


def _standing(placed: DataFrame, seed: int, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """Written if both are read (``once``): one row ``(band, component, n, pick)`` per tuple and component of its nodes, and of the tuples of several components the largest one as ``m``."""
    each = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min_by("content", F.xxhash64("content", F.lit(seed))).alias("pick"))
    each = cut_lineage(each) if once else each
    top = each.groupBy("band").agg(F.max_by(F.struct("component", "pick", "n"), F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("__k"))
    return each, top.where(F.col("__k") > 1).select("band", "m")


def _homes(undecided: DataFrame) -> DataFrame | None:
    """``(content, home)`` of the nodes that meet more cheaply by home than tuple by tuple; None if no tuple is crowded.

    A node's home is the node of most mass that leads most of its crowded tuples, and that one's own leader in turn. A home whose tuples
    have few pairs beside the square of its nodes is none.
    """
    sizes = undecided.groupBy("band").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWD)
    crowded, n = cut_counted(undecided.select("band", "content", "component").join(sizes, "band"))
    if not n:
        drop_steps(crowded)
        return None
    mass = crowded.groupBy("content").agg(F.sum("__n").alias("mass"))
    leaders = crowded.join(mass, "content").groupBy("band").agg(F.max_by("content", F.struct("mass", "content")).alias("leader"))
    led = crowded.join(leaders, "band").groupBy("content", "leader").agg(F.count(F.lit(1)).alias("__k"), F.sum("__n").alias("__pairs"), F.min("component").alias("component"))
    first = cut_lineage(led.groupBy("content").agg(F.max_by("leader", F.struct("__k", "leader")).alias("leader"), F.sum("__pairs").alias("__pairs"),
                                                   F.min("component").alias("component")))
    above = first.select(F.col("content").alias("leader"), F.col("leader").alias("__above"))
    homed = cut_lineage(first.join(above, "leader", "left").select("content", "component", "__pairs", F.coalesce("__above", "leader").alias("home")))
    dense = homed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("__pairs").alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    dense = dense.where((F.col("lo") != F.col("hi")) & (4 * F.col("p") >= F.col("n").cast("double") * F.col("n"))).select("home")
    out = cut_lineage(homed.join(dense, "home", "left_semi").select("content", "home", "component"))
    drop_steps(crowded, first, homed)
    return out


def _near_pairs(undecided: DataFrame, nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The pairs ``(src, dst)`` of nodes of two components and two homes that share a band, if their lengths and their bitmaps of words allow a link.

    Lengths are cut into zones so wide that only nodes of one zone or of neighbouring zones can be linked. A key is a band and a zone, in
    which the nodes of the zone meet each other and those of the zone below; one of more than ``block`` nodes is cut into blocks, each
    pair of blocks its own key. A pair that shares several bands comes several times. Without a column ``home`` every node is its own.
    """
    if "home" not in undecided.columns:
        undecided = undecided.withColumn("home", F.col("content"))
    zone = F.floor(F.ln("n_words") / max(-math.log(similarity - 1e-6), 0.05)) if similarity > 0.01 else F.lit(0)
    own = undecided.select("band", "content", "n_words", "component", "home", zone.cast("int").alias("__own"))
    met = own.withColumn("__zone", F.explode(F.array("__own", F.col("__own") + 1)))
    keys = ["band", "__zone"]
    sizes = met.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("__blocks"), F.max("__own").alias("__top"),
                                   F.min("component").alias("__lo"), F.max("component").alias("__hi"), F.min("home").alias("__from"), F.max("home").alias("__to"))
    several = (F.col("__lo") != F.col("__hi")) & (F.col("__from") != F.col("__to"))
    sizes = cut_lineage(sizes.where((F.col("__top") == F.col("__zone")) & several).select(*keys, "__blocks"))
    mine = F.pmod(F.xxhash64("content"), F.col("__blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    bits = lambda c: [F.col("bitmap")[i].alias(f"{c}{i}") for i in range(BITMAP)]
    left = own.withColumnRenamed("__own", "__zone").join(sizes, keys).withColumn("__l", mine).withColumn("__r", every).join(nodes.select("content", "bitmap"), "content")
    left = left.select(*keys, "__l", "__r", F.col("content").alias("__a"), "n_words", "component", "home", *bits("__b"))
    right = met.join(sizes, keys).withColumn("__r", mine).withColumn("__l", every).join(nodes.select("content", "bitmap"), "content")
    right = right.select(*keys, "__l", "__r", F.col("content").alias("__d"), F.col("n_words").alias("__m"), F.col("component").alias("__c"), F.col("home").alias("__h"), "__own", *bits("__o"))
    edits = (1 - similarity) * F.greatest("n_words", "__m") + 1e-9
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"__b{i}").bitwiseXOR(F.col(f"__o{i}"))) for i in range(BITMAP)])
    once = (F.col("__own") < F.col("__zone")) | (F.col("__a") < F.col("__d"))
    near = (F.abs(F.col("n_words") - F.col("__m")) <= edits) & (differ <= 2 * edits)
    pairs = left.join(right, [*keys, "__l", "__r"]).where(once & (F.col("component") != F.col("__c")) & (F.col("home") != F.col("__h")) & near)
    return pairs.select(F.least("__a", "__d").alias("src"), F.greatest("__a", "__d").alias("dst"))


def _first_links(table: pa.Table, similarity: float) -> pa.Table:
    """Of one block of asking nodes and one of a component's nodes, a link of every asking node that has one: pairs whose lengths and bitmaps allow a link
    are aligned, those of the most similar bitmaps first."""
    mine = table["mine"].to_numpy(zero_copy_only=False)
    names, size = table["content"].to_numpy(zero_copy_only=False), table["n_words"].to_numpy()
    bits = table["bitmap"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP)
    words = [w.values.to_numpy() for w in table["words"]]
    other, found = np.flatnonzero(~mine), []
    for i in np.flatnonzero(mine).tolist():
        differ = np.bitwise_count(bits[i] ^ bits[other]).sum(1, dtype=np.int64)
        edits = (1 - similarity) * np.maximum(size[i], size[other]) + 1e-9
        near = np.flatnonzero((np.abs(size[i] - size[other]) <= edits) & (differ <= 2 * edits))
        for j in near[np.argsort(differ[near], kind="stable")].tolist():
            if within_band(words[i], words[other[j]], int(edits[j])):
                found.append((names[i], names[other[j]]))
                break
    return pa.table({"src": pa.array([min(x) for x in found], pa.binary()), "dst": pa.array([max(x) for x in found], pa.binary())})


def _joining_links(table: pa.Table, similarity: float) -> pa.Table:
    """Of two blocks of a home's nodes, or of one, links that join all components that candidate pairs join: pairs of different components that share a
    tuple and whose lengths and bitmaps allow a link are aligned, those of the most similar bitmaps first, unless found links join them already."""
    table = table.combine_chunks()
    left = table["__left"].to_numpy(zero_copy_only=False)
    names, size = table["content"].to_numpy(zero_copy_only=False), table["n_words"].to_numpy()
    wide = lambda c, n: table[c].combine_chunks().flatten().to_numpy().reshape(-1, n)
    bits, sketch = wide("bitmap", BITMAP).view(np.uint64), wide("sketch", TUPLES + SHORT_TUPLES)
    words = [w.values.to_numpy() for w in table["words"]]
    part = np.unique(table["component"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)[1]
    alone = bool(left.all())
    mine, found = np.flatnonzero(left), []
    for i in mine.tolist():
        other = mine[mine > i] if alone else np.flatnonzero(~left)
        other = other[part[other] != part[i]]
        differ = np.bitwise_count(bits[i] ^ bits[other]).sum(1, dtype=np.int64)
        edits = (1 - similarity) * np.maximum(size[i], size[other]) + 1e-9
        near = np.flatnonzero((np.abs(size[i] - size[other]) <= edits) & (differ <= 2 * edits))
        near = near[(sketch[other[near]] == sketch[i]).any(1)]
        for j in near[np.argsort(differ[near], kind="stable")].tolist():
            if part[other[j]] != part[i] and within_band(words[i], words[other[j]], int(edits[j])):
                found.append((names[i], names[other[j]]))
                part[part == part[other[j]]] = part[i]
    return pa.table({"src": pa.array([min(x) for x in found], pa.binary()), "dst": pa.array([max(x) for x in found], pa.binary())})


def _links_within_homes(homes: DataFrame, nodes: DataFrame, words: DataFrame, similarity: float, block: int = 500) -> DataFrame:
    """Links ``(src, dst)`` of nodes of one home, see ``_joining_links``. A home is cut into blocks, each pair of blocks its own key."""
    sizes = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("__blocks"))
    own = homes.join(sizes, "home").withColumn("__own", F.pmod(F.xxhash64("content"), "__blocks").cast("int"))
    met = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    met = met.select("home", F.least("__own", "__other").alias("__l"), F.greatest("__own", "__other").alias("__r"), "content", "component",
                     (F.col("__own") <= F.col("__other")).alias("__left"))
    both = met.join(_among(nodes.select("content", "n_words", "bitmap", "sketch"), homes), "content").join(_among(words, homes), "content")
    return both.groupBy("home", "__l", "__r").applyInArrow(lambda t: _joining_links(t, similarity), "src binary, dst binary")


def _links_with_components(asked: DataFrame, members: DataFrame, nodes: DataFrame, words: DataFrame, similarity: float, block: int = 500) -> DataFrame:
    """Links ``(src, dst)`` of nodes ``asked`` with nodes of their ``target`` component, one per block of it if there is any.

    A node that shares tuples with many of a component's nodes meets the component once, not once per tuple and node. Both sides are cut into blocks, so
    no row is made for a pair that is not linked.
    """
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    blocks = lambda n: F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = asked.groupBy("target").agg(blocks("__m"))
    members = members.withColumnRenamed("component", "target").join(asking, "target")
    sizes = members.groupBy("target", "__m").agg(blocks("__n"))
    left = asked.select("target", "content").join(sizes, "target").select("target", cut("content", "__m").alias("__l"), every("__n").alias("__r"), "content", F.lit(True).alias("mine"))
    right = members.select("target", "content").join(sizes, "target").select("target", every("__m").alias("__l"), cut("content", "__n").alias("__r"), "content", F.lit(False).alias("mine"))
    met = cut_lineage(left.unionByName(right))
    both = met.join(_among(nodes.select("content", "n_words", "bitmap"), met), "content").join(_among(words, met), "content")
    return both.groupBy("target", "__l", "__r").applyInArrow(lambda t: _first_links(t, similarity), "src binary, dst binary")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text_hash, class_id, class_size, class_key, representative, n_words)`` per row of ``docs``.

    ``class_id`` is the smallest key of the class (null if none is known), ``class_key`` names the class whatever its keys are.
    One ``(key, text)`` of each class is its representative: the smallest key, then the smallest text hash. In scripts without blanks a character is a word. Texts of fewer than five words are
    only classed with equal ones, null with empty texts; rows of equal words, repeated rows included, are one class. An empty table gives an empty
    result, and other columns are not looked at.

    Texts of equal words are one node. A node is first aligned with the few leading nodes it shares most tuples with, then
    component by component, with nodes of the largest components that share tuples, which gathers large groups without their pairs; last, all pairs
    that share a tuple and are still in different components are aligned, if their lengths and their bitmaps of words allow a link at all. So every candidate
    pair whose link could join two classes is decided.
    """
    with arrow_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, similarity, key, text)


def _near_duplicates(docs: DataFrame, similarity: float, key: str, text: str) -> DataFrame:
    sketched = cut_lineage(_sketches(docs, key, text))
    nodes = sketched.where(F.col("sketch").isNotNull()).select("content", "n_words", "sketch", "bitmap").dropDuplicates(["content"])
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    rows = cut_lineage(sketched.select(key, "text_hash", "content", "n_words"))  # without the sketches, which are many times larger
    drop_steps(sketched)
    members = cut_lineage(_shared_bands(nodes).join(nodes.select("id", "content", "n_words"), "id").select("band", "content", "n_words", "__n"))
    # of edited copies of one text, the text itself has most tuples in common with the others: it leads
    mass = members.groupBy("content").agg(F.sum("__n").alias("mass"))
    leaders = members.join(mass, "content").groupBy("band").agg(F.max_by("content", F.struct("mass", "content")).alias("leader"))
    few = Window.partitionBy("content").orderBy(F.col("__n").desc(), "leader")
    stars = (members.join(leaders, "band").where(F.col("leader") != F.col("content")).groupBy("content", "leader").agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__rn", F.row_number().over(few)).where(F.col("__rn") <= 3))
    stars, n = cut_counted(stars.select(F.least("leader", "content").alias("src"), F.greatest("leader", "content").alias("dst")).distinct())
    narrow = tasks_for(n)
    words = cut_lineage(_word_codes(docs, members.select("content").distinct(), text))
    links, tried = cut_lineage(_linked(stars, words, similarity)), stars

    undecided, parts = members.select("content", "n_words", "band"), _parts(links)
    for seed in (1, 2):
        # one node of every component that is not the one most of a tuple's nodes belong to is aligned with one of that
        each, top = _standing(_placed(undecided, parts), seed)
        other = each.join(top, "band").where(F.col("component") != F.col("m.component"))
        pairs = other.select(F.least("pick", "m.pick").alias("src"), F.greatest("pick", "m.pick").alias("dst")).distinct()
        pairs, n = cut_counted(pairs.join(tried, ["src", "dst"], "left_anti").coalesce(narrow))
        # components only grow: a tuple whose nodes are in one component stays decided
        if seed == 1:
            undecided = cut_lineage(undecided.join(top.select("band"), "band", "left_semi"))
        drop_steps(each)
        if not n:
            break
        tried = tried.unionByName(pairs)
        last, parts = parts, _parts(cut_lineage(_linked(pairs, _among(words, _ends(pairs)), similarity)), parts)
        drop_steps(last)
    placed = cut_lineage(_placed(undecided, parts))
    drop_steps(undecided)
    top = cut_lineage(_standing(placed, 1, once=False)[1])
    many = F.col("m.n") > MANY
    few, n = cut_counted(placed.join(top, [placed["band"] == top["band"], (F.col("component") != F.col("m.component")) | ~many])
                         .select(placed["band"], "content", "n_words", "component"))
    asked, m = cut_counted(placed.join(top.where(many), [placed["band"] == top["band"], F.col("component") != F.col("m.component")])
                           .select("content", "n_words", F.col("m.component").alias("target")).distinct().coalesce(narrow))
    found = []
    if n:
        homes = _homes(few)
        if homes is not None:
            found.append(cut_lineage(_links_within_homes(homes, nodes, words, similarity)))
            few = few.join(homes.select("content", "home"), "content", "left").withColumn("home", F.coalesce("home", "content"))
        pairs = cut_lineage(_near_pairs(few, nodes, similarity).distinct().join(tried, ["src", "dst"], "left_anti"))
        found.append(cut_lineage(_linked(pairs, _among(words, _ends(pairs)), similarity)))
    if m:
        whole = cut_lineage(_placed(members.select("content").distinct(), parts))
        found.append(cut_lineage(_links_with_components(asked, whole, nodes, words, similarity)))
    if found:
        parts = _parts(reduce(DataFrame.unionByName, found), parts)
    drop_steps(members, placed, top, few, nodes, words)

    parts = parts.withColumnRenamed("component", "__class")
    first = F.struct(F.col(key).isNull().alias("a"), F.col(key).alias("k"), F.col("text_hash").alias("t"))
    texts = rows.groupBy("content").agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("__n"))
    texts = cut_lineage(texts.join(parts, "content", "left").withColumn("__class", F.coalesce("__class", "content")))
    classes = texts.groupBy("__class").agg(F.min("__first").alias("__first"), F.sum("__n").alias("class_size"))
    named = texts.select("content", "__class").join(classes, "__class")
    return rows.select(key, "text_hash", "content", "n_words").join(named, "content").select(
        key, "text_hash", F.col("__first.k").alias("class_id"), "class_size", F.hex("__class").alias("class_key"),
        (F.col(key).eqNullSafe(F.col("__first.k")) & (F.col("text_hash") == F.col("__first.t"))).alias("representative"), "n_words")
