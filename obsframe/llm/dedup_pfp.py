"""Exact removal of long repeated byte strings, with prefix-free parsing (Boucher et al. 2019).

A rolling hash sets triggers that depend on the bytes around them alone, so a repeated string is cut into the same phrases
wherever it stands. A string of ``LENGTH`` bytes is identified by its trigger, its distance from it, and names of
what lies on both sides; names are 64-bit hashes. Sorting is only needed down to depth ``LENGTH``, where all that matters is
which strings are equal, so names take the place of ranks in the corpus order, and they are compared by grouping:

1. The core of a trigger is what every string with this trigger holds. Cores that one text alone has are done with.
2. What is left is cut into blocks of ``STEP`` neighbouring strings, named by what all of them hold (core) and by all they
   hold together (union). If another text has the same union, all strings of the block are repeated.
3. Blocks with the same core and different unions, which is where matches begin and end, are resolved string by string.

The trigger of a string is the smallest hash among those that begin in its first ``REACH`` bytes, the last one of equals. So
every string has a trigger, in texts of any kind, and no phrase is too long to be found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .frames import bitmap_of
from .textbatch import U64, SpanHash, mix, row_blocks, text_bytes

LENGTH = 400
REACH = 256
GRAM = 8
STEP = 16
PIECE = 1 << 20
FILTER_BITS = 22
_LOW = U64((1 << 24) - 1)
_SECOND = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first row, bytes, offsets of the rows in them, place of the bytes in the first row)`` in pieces that hold every string of
    ``LENGTH`` bytes of one row; a long row comes in several that overlap."""
    for lo, hi in row_blocks(offs, PIECE):
        a, z = int(offs[lo]), int(offs[hi])
        if z - a <= 2 * PIECE or hi - lo > 1:
            yield lo, data[a:z], offs[lo:hi + 1] - a, 0
            continue
        for s in range(a, z - LENGTH + 1, PIECE):
            part = data[s:min(s + PIECE + LENGTH - 1, z)]
            yield lo, part, np.array([0, len(part)]), s - a


def segments(x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(trigger, first, last)``: the strings that begin from ``first`` to ``last`` have this trigger and lie in one row."""
    n = len(x)
    none = np.zeros(0, np.int64)
    begin, end = offs[:-1], offs[1:] - LENGTH
    begin, end = begin[end >= begin], end[end >= begin]
    if not len(begin):
        return none, none, none
    grams = np.ndarray((n - GRAM + 1,), dtype="<u8", buffer=np.ascontiguousarray(x).data, strides=(1,))
    t = grams * U64(0x9E3779B97F4A7C15)
    t ^= t >> U64(32)
    t *= U64(0xD6E8FEB86659FD93)
    t = (t & ~_LOW) | (_LOW - np.arange(len(t), dtype=np.uint64))
    step = 1
    while step < REACH:
        t = np.minimum(t[:-step], t[step:])
        step *= 2
    trigger = (_LOW - (t[:n - LENGTH + 1] & _LOW)).astype(np.int64)
    mark = np.zeros(n - LENGTH + 2, dtype=np.int8)
    mark[begin] += 1
    mark[end + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (trigger[at[1:]] != trigger[at[:-1]])
    first = at[new]
    return trigger[first], first, at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` of ``count[i]`` numbers each, one after the other."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


def _row_key(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix(name ^ mix(row.astype(np.uint64) + U64(1)))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(keys) else False
    return out


def _batch_segments(data: np.ndarray, offs: np.ndarray):
    """Per piece: its hasher, row offsets, and rows, triggers, firsts, lasts and cores of its segments, with their place in the row."""
    for lo, x, o, place in pieces(data, offs):
        trigger, first, last = segments(x, o)
        if len(first):
            span = SpanHash(x)
            local = np.searchsorted(o, first, "right") - 1
            shift = place - o[local]  # from the piece to the row
            yield span, local + lo, shift, trigger, first, last, span(trigger, trigger + LENGTH - REACH + 1)


def _small_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of one MB of text, or of one longer row: what a task holds does not follow the batches given."""
    for b in batches:
        _, offs = text_bytes(b.column(text))
        for lo, hi in row_blocks(offs, PIECE):
            yield b.slice(lo, hi - lo)


def _parse(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row ``(key, tk, n_bytes, whole, self)``, and rows ``(tk, core)`` of its distinct cores. ``self``: a core occurs twice in it."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key), F.xxhash64(body).alias("tk"), F.octet_length(body).cast("long").alias("n_bytes"),
                         F.sha2(body.cast("binary"), 256).alias("whole"), body.alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small_batches(batches, 4):
            data, offs = text_bytes(b.column(4))
            rows, cores, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, row, shift, trigger, _, _, core in _batch_segments(data, offs):
                rows.append(row)
                cores.append(core)
                places.append(trigger + shift)
            row, core, place = map(np.concatenate, (rows, cores, places))
            # a segment cut between two pieces comes twice with one trigger
            _, once = np.unique(row << 40 | place, return_index=True)
            row, core = row[once], core[once]
            keys = _row_key(row, core)
            own = np.zeros(b.num_rows, dtype=bool)
            own[row[_repeated(keys)]] = True
            _, once = np.unique(keys, return_index=True)
            row, core = row[once], core[once]
            n = len(row)
            pad = lambda t: pa.nulls(n, t)
            cols = [pa.concat_arrays([b.column(0), pad(b.column(0).type)]), pa.concat_arrays([b.column(1), b.column(1).take(pa.array(row))]),
                    pa.concat_arrays([b.column(2), pad(pa.int64())]), pa.concat_arrays([b.column(3), pad(b.column(3).type)]),
                    pa.concat_arrays([pa.array(own), pad(pa.bool_())]), pa.concat_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array(core.view(np.int64))])]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:4], "self", "core"])

    return source.mapInArrow(run, f"`{key}` {kind}, tk long, n_bytes long, whole string, self boolean, core long")


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``(tk, text)``, each wanted text once. Rows that are certainly not wanted do not reach the shuffle."""
    packed = bitmap_of(wanted, F.shiftrightunsigned("tk", 64 - FILTER_BITS), FILTER_BITS)
    body = F.coalesce(F.col(text), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            tk = np.asarray(b.column(0)).view(np.uint64)
            yield b.filter(pa.array(flags[(tk >> U64(64 - FILTER_BITS)).astype(np.int64)]))

    few = docs.select(F.xxhash64(body).alias("tk"), body.alias("text")).mapInArrow(run, "tk long, text string")
    return few.dropDuplicates(["tk"])


def _blocks(work: DataFrame) -> DataFrame:
    """From ``(tk, text, cores)``: spans repeated within the text (``core`` null), and blocks of strings under the given cores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small_batches(batches, 1):
            data, offs = text_bytes(b.column(1))
            cores = b.column(2)
            count = np.diff(np.asarray(cores.offsets))
            given = _row_key(np.repeat(np.arange(b.num_rows), count), np.asarray(cores.flatten()).view(np.uint64))
            out = []  # row, first, last, core, union
            inner = []  # row, place, name of strings that may be repeated within their text
            # the segments are made twice, since their hashers are too large to keep
            keys = [np.zeros(0, np.uint64), *(_row_key(s[1], s[6]) for s in _batch_segments(data, offs))]
            own = _repeated(np.concatenate(keys))
            upto = 0
            for (span, row, shift, trigger, first, last, _), key in zip(_batch_segments(data, offs), keys[1:]):
                mine = own[upto:upto + len(key)]
                upto += len(key)
                if mine.any():
                    size = last[mine] - first[mine] + 1
                    at = ranges(first[mine], size)
                    inner.append((np.repeat(row[mine], size), at + np.repeat(shift[mine], size), span(at, at + LENGTH)))
                shared = np.flatnonzero(np.isin(key, given))
                if len(shared):
                    t, f, z = trigger[shared], first[shared], last[shared]
                    low, n = (t - z) // STEP, (t - f) // STEP - (t - z) // STEP + 1
                    t, f, z, i = (np.repeat(v, n) for v in (t, f, z, shared))
                    far = ranges(low, n) * STEP  # the least distance from the trigger in this block
                    near, most = np.maximum(far, t - z), np.minimum(far + STEP - 1, t - f)
                    core = span(t - far, t - far - STEP + 1 + LENGTH)
                    union = mix(span(t - most, t - near + LENGTH) + near.astype(np.uint64) * U64(1009) + most.astype(np.uint64))
                    out.append((row[i], t - most + shift[i], t - near + shift[i], core, union))
            spans = []
            if inner:
                row, place, name = map(np.concatenate, zip(*inner))
                one = row << 40 | place
                _, once = np.unique(one, return_index=True)
                one, name, row = one[once], name[once], row[once]
                one = one[_repeated(_row_key(row, name))]
                if len(one):
                    new = np.append(True, one[1:] != one[:-1] + 1)
                    head, tail = one[new], one[np.append(np.flatnonzero(new)[1:] - 1, len(one) - 1)]
                    spans = [head >> 40, head & ((1 << 40) - 1), tail & ((1 << 40) - 1)]
            row, first, last, core, union = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
            n = len(spans[0]) if spans else 0
            if n:
                row, first, last = (np.concatenate(v) for v in ((spans[0], row), (spans[1], first), (spans[2], last)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(first), pa.array(last),
                 *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(v.view(np.int64))]) for v in (core, union))],
                names=["tk", "first", "last", "core", "union"])

    return work.select("tk", "text", "cores").mapInArrow(run, "tk long, first long, last long, core long, union long")


def _strings(work: DataFrame) -> DataFrame:
    """From ``(tk, text, first, last)`` with lists of ranges: every string that begins in a range, with two names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for r in range(b.num_rows):
                x = data[offs[r]:offs[r + 1]]
                first, last = (c[r].values.to_numpy() for c in b.columns[2:4])
                at = np.unique(ranges(first, last - first + 1))
                for lo in range(0, len(at), PIECE):
                    part = at[lo:lo + PIECE]
                    while len(part):
                        now = part[part < part[0] + PIECE]
                        part = part[len(now):]
                        near, begin = x[now[0]:now[-1] + LENGTH], now - now[0]
                        names = [h(begin, begin + LENGTH).view(np.int64) for h in (SpanHash(near), SpanHash(near, _SECOND))]
                        tk = pa.array(np.full(len(now), b.column(0)[r].as_py()))
                        yield pa.RecordBatch.from_arrays([tk, pa.array(now), *map(pa.array, names)], names=["tk", "first", "name", "second"])

    return work.select("tk", "text", "first", "last").mapInArrow(run, "tk long, first long, name long, second long")


def _digests(work: DataFrame, with_text: bool) -> DataFrame:
    """From ``(tk, text, begins, ends)``: what is left of the text when the ranges are taken out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column(1))
            rows = []
            for r in range(b.num_rows):
                begin, end = (c[r].values.to_numpy() for c in b.columns[2:4])
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                head, tail = begin[new], end[np.append(new[1:] - 1, len(end) - 1)]
                x, at, kept = data[offs[r]:offs[r + 1]].tobytes(), 0, []
                for a, z in zip(head.tolist(), tail.tolist()):
                    kept.append(x[at:a])
                    at = z
                left = b"".join([*kept, x[at:]])
                rows.append((int((tail - head).sum()), len(head), hashlib.sha256(left).hexdigest(), left if with_text else None))
            cols = [pa.array([row[i] for row in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["tk", "n_removed", "n_spans", "kept_sha256", "kept"])

    return work.select("tk", "text", "begins", "ends").mapInArrow(run, "tk long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _two_texts(df: DataFrame, *by: str) -> DataFrame:
    """The groups in which two different texts occur."""
    return df.groupBy(*by).agg(F.min("tk").alias("__lo"), F.max("tk").alias("__hi")).where(F.col("__lo") < F.col("__hi")).select(*by)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, repeated, removed_share)`` per row, with the ``kept`` bytes if asked for.

    Removed is every byte inside a string of ``LENGTH`` bytes that also begins anywhere else, in the same text or another;
    strings do not cross texts. Null counts as empty; texts under ``LENGTH`` bytes lose nothing; a text that occurs twice
    loses everything, and so do repeated rows. ``repeated`` says whether anything is removed. An empty table gives an empty result; other columns are
    not looked at. Texts and strings are told apart by 64-bit and 128-bit hashes.
    """
    parsed = cut_lineage(_parse(docs, key, text))
    rows, cores = parsed.where(F.col("core").isNull()).drop("core"), parsed.where(F.col("core").isNotNull()).select("core", "tk")
    copies = rows.groupBy("tk").agg(F.count(F.lit(1)).alias("__copies"))

    listed = cores.join(_two_texts(cores, "core"), "core").groupBy("tk").agg(F.collect_set("core").alias("cores"))
    alone = rows.where("self").select("tk").distinct().withColumn("cores", F.array().cast("array<long>"))
    wanted = cut_lineage(listed.unionByName(alone).groupBy("tk").agg(F.flatten(F.collect_list("cores")).alias("cores")))
    work = cut_lineage(_texts(docs, wanted, text).join(wanted, "tk"))
    blocks = cut_lineage(_blocks(work))
    within, blocks = blocks.where(F.col("core").isNull()), blocks.where(F.col("core").isNotNull())

    unions = blocks.groupBy("core", "union").agg(F.min("tk").alias("__lo"), F.max("tk").alias("__hi"))
    done = blocks.join(unions.where(F.col("__lo") < F.col("__hi")).select("core", "union"), ["core", "union"])
    several = (unions.groupBy("core").agg(F.min("union").alias("__a"), F.max("union").alias("__b"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
               .where((F.col("__a") != F.col("__b")) & (F.col("__lo") < F.col("__hi"))).select("core"))
    edges = (blocks.join(several, "core").groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("r"))
             .select("tk", F.col("r.first").alias("first"), F.col("r.last").alias("last")))
    strings = cut_lineage(_strings(work.drop("cores").join(edges, "tk")))
    single = strings.join(_two_texts(strings, "name", "second"), ["name", "second"]).select("tk", "first", F.col("first").alias("last"))

    found = within.select("tk", "first", "last").unionByName(done.select("tk", "first", "last")).unionByName(single)
    spans = found.groupBy("tk").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    spans = spans.select("tk", F.col("r.first").alias("begins"), F.transform("r.last", lambda x: x + LENGTH).alias("ends"))
    left = _digests(work.drop("cores").join(spans, "tk"), with_text).withColumnsRenamed({c: f"__{c}" for c in ("n_removed", "n_spans", "kept_sha256", "kept")})

    whole = (F.col("__copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = rows.join(copies, "tk").join(left, "tk", "left").select(
        key, "tk", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("__n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("__n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("__kept_sha256", "whole")).alias("kept_sha256"), whole.alias("__whole"), "__kept")
    out = out.withColumn("repeated", F.col("n_removed") > 0).withColumn("removed_share", F.coalesce(F.try_divide("n_removed", "n_bytes"), F.lit(0.0)))
    if not with_text:
        return out.drop("tk", "__whole", "__kept")
    body = F.coalesce(F.col(text), F.lit(""))
    again = docs.select(F.xxhash64(body).alias("tk"), body.cast("binary").alias("__body")).dropDuplicates(["tk"])
    return out.join(again, "tk").withColumn("kept", F.when(F.col("__whole"), F.lit("").cast("binary")).otherwise(F.coalesce("__kept", "__body"))).drop(
        "tk", "__whole", "__kept", "__body")
