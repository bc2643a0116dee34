"""N-gram Jaccard join by a token-group matrix (Li et al. 2021, set similarity search).

A document's tokens are its distinct shingles of five words; two documents are linked if their Jaccard similarity reaches
the threshold. Nothing is approximate but the 64-bit hashes that stand for shingles.

1. Every document is told how many of its tokens occur in other documents at all. Tasks deal their distinct tokens by hash range,
   one entry for a token that occurs several times in a block of texts, and get counts back, so no (token, document) row is formed. Only documents whose
   shared tokens could make up the threshold go on.
2. Of equal sets one is kept. Tokens are ordered by how many sets have them, rarest first; two linked sets share one of the few first ones
   that leave less than the overlap needed (prefixes). Sets with none left drop out.
3. Sets are partitioned into groups of similar ones: those of about the same size whose prefixes have the same most frequent
   token, in slices of about ``GROUP`` sets. The matrix says which tokens the prefixes of a group hold.
4. Groups are compared within themselves, then with the largest group they share a token with, then with all groups they share a token with
   unless all sets of both are in one component already. When a query group meets a group, every query's overlap with the union of the group's
   tokens bounds its similarity to any member; the group is opened, as a product of 0/1 matrices, for the queries that qualify.
5. Links found are reduced to a star per component inside the task; classes are connected components.

Cases: null and empty texts, and those without a word, have no token and are linked with nothing; fewer than five words are one token;
rows with equal sets, repeated rows included, are one set; a null key has a component like any other and is nobody's smallest key; a long text is one row of
tokens; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..session import cut_counted, cut_lineage
from .frames import bitmap_of, spread
from .textbatch import U64, Words, find_words, mix, row_blocks, text_bytes

SHINGLE = 5
#: About so many sets, and so many tokens, make a group.
GROUP, GROUP_TOKENS = 256, 1 << 18
FILTER_BITS = 22
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[9:14] = NOT_BLANK[32] = False
_LOW = U64(0xFFFFFFFF)


# -- tokens ----------------------------------------------------------------------------------

def token_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, first)``: each row's distinct tokens in ascending order, and where each row begins."""
    n = np.diff(w.first)
    m = np.where(n >= k, n - k + 1, n > 0)
    begin = np.concatenate([[0], np.cumsum(m)])
    row = np.repeat(np.arange(len(m)), m)
    at = np.arange(begin[-1]) - begin[row] + w.first[row]
    last, h = w.first[1:][row], np.zeros(len(at), dtype=np.uint64)
    words = np.concatenate([w.hash, np.zeros(k, dtype=np.uint64)])
    for j in range(k):  # a row of fewer words is told from a shingle by what fills its places
        h = h * U64(0xD1342543DE82EF95) + np.where(at + j < last, words[at + j], U64(j + 1))
    h = mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(m) + 1))


def set_names(tokens: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; None for the empty one."""
    sums = np.zeros((len(first) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            sums[full, i] = np.add.reduceat(mix(tokens * U64(odd) + U64(i)), first[full])
    return [s.tobytes() if n else None for s, n in zip(sums, np.diff(first))]


def _token_blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = text_bytes(col)
    for lo, hi in row_blocks(offs):
        for a in range(lo, hi, 16384):  # places in a block fit in 16 bits
            z = min(hi, a + 16384)
            x, o = data[offs[a]:offs[z]], offs[a:z + 1] - offs[a]
            yield a, z, *token_sets(find_words(x, o, NOT_BLANK))


# -- how many tokens of a document occur elsewhere -------------------------------------------

def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))


def _counts_batch(names: list[str], block: int, shared: np.ndarray, key_type: pa.DataType) -> pa.RecordBatch:
    """The counts of one block's documents, which the rows of the documents (range -1) follow."""
    at = np.flatnonzero(shared)
    whole = np.array([0, len(at)])
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([-2], pa.int32()), pa.nulls(1, key_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()),
         _lists(whole, shared[at].astype(np.int32)), _lists(whole, at.astype(np.int16))], names=names)


def _shared_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, node, size, shared)`` per row: its set's name, its tokens and how many of them other sets have too.

    A row of the stream is a document of a block of texts, or the tokens of a block in one hash range: the low 32 bits of every token and the place of
    the only document that has it, or -1 if several of the block do. Tokens that differ and agree in range and bits count as one, which only
    makes ``shared`` larger. ``docs`` is read from files, so that a task that is run again deals the same blocks.
    """
    parts = spread(docs.sparkSession)
    source = docs.select(F.col(key), F.col(text))
    kind = source.schema[0].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("key", kind), T.StructField("node", T.BinaryType()),
                           T.StructField("size", T.IntegerType()), T.StructField("bits", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.ShortType()))])
    names = schema.names

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            keys = b.column(0)
            for lo, hi, tokens, first in _token_blocks(b.column(1)):
                block, rows, size = block + 1, hi - lo, np.diff(first)
                sets = set_names(tokens, first)
                lead: dict[bytes | None, int] = {}
                leads = np.array([lead.setdefault(n, i) for i, n in enumerate(sets)], dtype=np.int16)  # of equal sets the first speaks for all
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, block)), pa.array(np.full(rows, -1, np.int32)), keys.slice(lo, rows), pa.array(sets, pa.binary()),
                     pa.array(size.astype(np.int32)), pa.nulls(rows, pa.list_(pa.int32())), _lists(np.arange(rows + 1), leads)], names=names)
                row = np.repeat(np.arange(rows, dtype=np.int16), size)
                own = leads[row] == row
                tok, row = tokens[own], row[own]
                if not len(tok):
                    continue
                order = np.argsort(tok, kind="stable")
                tok, row = tok[order], row[order]
                at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
                run = np.diff(np.append(at, len(tok)))
                yield _counts_batch(names, block, np.bincount(row[np.repeat(run > 1, run)], minlength=1), keys.type)
                tok, place = tok[at], np.where(run > 1, -1, row[at]).astype(np.int16)
                ranges = ((tok >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
                cut = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(tok))
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(ranges[cut[:-1]]), pa.nulls(n, keys.type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()),
                     _lists(cut, (tok & _LOW).astype(np.uint32).view(np.int32)), _lists(cut, place)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One hash range after the other: tokens seen twice count for the documents that hold them."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        current, key_type = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            bits, place = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            order = np.argsort(bits, kind="stable")
            ranked = bits[order]
            begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            run = np.diff(np.append(begin, len(ranked)))
            twice = np.empty(len(bits), dtype=bool)
            twice[order] = np.repeat((run > 1) | np.logical_or.reduceat(place[order] < 0, begin), run)
            twice &= place >= 0
            lo = 0
            for block, _, mine in held:
                here = mine[twice[lo:lo + len(mine)]]
                lo += len(mine)
                if len(here):
                    yield _counts_batch(names, block, np.bincount(here), key_type)

        for b in batches:
            ranges, blocks, key_type = b.column(1).to_numpy(), b.column(0).to_numpy(), b.column(2).type
            if (ranges < 0).any():
                yield b.filter(pa.array(ranges < 0))
            for i in np.flatnonzero(ranges >= 0).tolist():
                if ranges[i] != current:
                    yield from flush()
                    held, current = [], ranges[i]
                held.append((int(blocks[i]), b.column(5)[i].values.to_numpy(), b.column(6)[i].values.to_numpy()))
        yield from flush()

    out = T.StructType([T.StructField("key", kind), T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("shared", T.IntegerType())])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block after block: counts come first, then the documents."""
        current, counts = None, np.zeros(1 << 15, dtype=np.int32)
        for b in batches:
            blocks, is_doc = b.column(0).to_numpy(), b.column(1).to_numpy() == -1
            bounds = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(blocks) != 0) | (np.diff(is_doc) != 0)])), len(blocks)) if len(blocks) else np.zeros(1, int)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if blocks[lo] != current:
                    current, counts = blocks[lo], np.zeros(1 << 15, dtype=np.int32)
                part = b.slice(lo, hi - lo)
                if is_doc[lo]:
                    shared = counts[part.column(6).flatten().to_numpy()]
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(shared)], names=out.names)
                else:
                    np.add.at(counts, part.column(6).flatten().to_numpy(), part.column(5).flatten().to_numpy())

    place = F.when(F.col("range") >= 0, F.col("range").cast("long")).otherwise(F.col("block"))
    met = source.mapInArrow(deal, schema).repartition(parts, place).sortWithinPartitions("range").mapInArrow(meet, schema)
    return met.repartition(parts, "block").sortWithinPartitions("block", "range").mapInArrow(total, out).withColumnRenamed("key", key)


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``(node, size, tokens)`` once for each wanted node.

    A bitmap of fixed size over the first bits of the names keeps texts that are certainly not wanted out of the shuffle; the join decides.
    """
    head = F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("long")
    packed = bitmap_of(wanted, F.shiftright(head, 24 - FILTER_BITS), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            for _, _, tokens, first in _token_blocks(b.column(0)):
                names = set_names(tokens, first)
                kept = sorted({n: i for i, n in enumerate(names) if n is not None and flags[int.from_bytes(n[:3], "big") >> (24 - FILTER_BITS)]}.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in kept], pa.binary()), pa.array([int(first[i + 1] - first[i]) for i in kept], pa.int32()),
                     pa.array([tokens[first[i]:first[i + 1]].view(np.int64) for i in kept], pa.list_(pa.int64()))], names=["node", "size", "tokens"])

    found = docs.select(F.col(text)).mapInArrow(run, "node binary, size int, tokens array<long>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


# -- groups and their meetings ---------------------------------------------------------------

def _needed(size, percent: int):
    """The overlap that a set of ``size`` tokens needs with any set it is linked with."""
    return F.ceil(size * percent / F.lit(100.0) - F.lit(1e-9)).cast("int")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, size, prefix)``: of each set's tokens that other sets have, rarest first, those of its prefix."""
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    ranked = tokens.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    alone = F.col("size") - F.size("ranked")  # tokens of no other set come first in the order
    take = F.col("size") - _needed(F.col("size"), percent) + 1 - alone
    return sets.select("id", "size").join(ranked, "id").where(take > 0).select(
        "id", "size", F.slice("ranked", F.lit(1), take.cast("int")).alias("prefix"))


def _groups(ranked: DataFrame, percent: int) -> DataFrame:
    """Sets with their group: the most frequent token of the prefix, the zone of sizes, and a slice of bounded size and weight."""
    zone = F.floor(F.ln("size") / max(-math.log(percent / 100 - 1e-6), 0.05)).cast("int")
    placed = ranked.select("id", "size", F.col("prefix.token").alias("prefix"), F.element_at("prefix", -1).token.alias("lead"), zone.alias("zone"))
    weight = placed.groupBy("lead", "zone").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("size") / GROUP_TOKENS)).alias("slices"))
    piece = F.pmod(F.xxhash64("id"), F.col("slices"))
    return placed.join(weight, ["lead", "zone"]).select(F.xxhash64("lead", "zone", piece).alias("group"), "id", "size", "prefix")


def overlaps(a_tokens: list[np.ndarray], b_tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens every set of ``a`` has in common with every set of ``b``: products of 0/1 matrices over the tokens of both, some columns at a time."""
    out = np.zeros((len(a_tokens), len(b_tokens)), dtype=np.float32)
    a_all, b_all = np.concatenate(a_tokens), np.concatenate(b_tokens)
    both = np.intersect1d(a_all, b_all)
    rows = [np.repeat(np.arange(len(t)), [len(x) for x in t]) for t in (a_tokens, b_tokens)]
    cols = [np.searchsorted(both, x) for x in (a_all, b_all)]
    for i, x in enumerate((a_all, b_all)):
        known = (cols[i] < len(both)) & (both[np.minimum(cols[i], len(both) - 1)] == x) if len(both) else np.zeros(len(x), dtype=bool)
        order = np.argsort(cols[i][known], kind="stable")
        rows[i], cols[i] = rows[i][known][order], cols[i][known][order]
    for lo in range(0, len(both), 4096):
        block = []
        for i, n in enumerate(out.shape):
            s, e = np.searchsorted(cols[i], [lo, lo + 4096])
            m = np.zeros((n, min(4096, len(both) - lo)), dtype=np.float32)
            m[rows[i][s:e], cols[i][s:e] - lo] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out.astype(np.int64)


def qualifying(a_tokens: list[np.ndarray], b_tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """The queries of ``a`` whose overlap with the union of ``b`` allows a link with any of its sets.

    With an overlap of at most ``c`` with a set of at least ``least`` tokens, the union has at least ``max(size, size + least - c)``.
    """
    union, least = np.unique(np.concatenate(b_tokens)), min(len(t) for t in b_tokens)
    size = np.array([len(t) for t in a_tokens])
    every = np.concatenate(a_tokens)
    at = np.minimum(np.searchsorted(union, every), len(union) - 1)
    c = np.add.reduceat((union[at] == every).astype(np.int64), np.cumsum(size) - size)
    return np.flatnonzero(100 * c >= percent * np.maximum(size, size + least - c))


def _stars(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Of a bipartite link matrix, every node of a component with the smallest node of it."""
    label = {int(x): int(x) for x in [*a, *b]}

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(links)):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            label[max(x, y)] = min(x, y)
    return [(x, r) for x in label if (r := root(x)) != x]


def _meet(table: pa.Table, percent: int) -> pa.Table:
    """Links between the sets of two groups, or of one with itself, as stars."""
    side = table["side"].to_numpy()
    ids, tokens = table["id"].to_numpy(), [x.values.to_numpy() for x in table["tokens"]]
    a, b = (np.flatnonzero(side == s) for s in (0, 1))
    b = b if len(b) else a
    edges: list[tuple[int, int]] = []
    mine = a[qualifying([tokens[i] for i in a], [tokens[j] for j in b], percent)]
    if len(mine):
        sizes = np.array([len(t) for t in tokens])
        common = overlaps([tokens[i] for i in mine], [tokens[j] for j in b])
        union = sizes[mine][:, None] + sizes[b][None] - common
        edges = _stars(ids[mine], ids[b], 100 * common >= percent * union)
    return pa.table({"src": pa.array([x for x, _ in edges], pa.int64()), "dst": pa.array([y for _, y in edges], pa.int64())})


def _links(pairs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)`` of the meetings ``(one, two)`` of groups."""
    sides = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("group"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("one").alias("group"), F.lit(0).alias("side")), F.struct(F.col("two").alias("group"), F.lit(1).alias("side"))))
    asked = pairs.select("one", "two", F.explode(sides).alias("s")).select("one", "two", "s.*")
    members = groups.select("group", "id").join(sets.select("id", "tokens"), "id")
    return asked.join(members, "group").select("one", "two", "side", "id", "tokens").groupBy("one", "two").applyInArrow(lambda t: _meet(t, percent), "src long, dst long")


def _cells(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The token-group matrix: ``(token, group, n, least, most, lo, hi)`` with the sizes and components of the group's sets that have the token in
    their prefix; tokens of one group, or whose sets are all in one component, are left out."""
    parts = connected_components(links).select(F.col("name").alias("id"), "component")
    known = groups.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = known.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"),
                                       F.min("component").alias("lo"), F.max("component").alias("hi"))
    cells = groups.select("group", F.explode("prefix").alias("token")).distinct().join(whole, "group")
    open_ = cells.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).where((F.col("g") > 1) & (F.col("__lo") != F.col("__hi")))
    return cells.join(open_.select("token"), "token", "left_semi")


def _possible(percent: int):
    """Whether sizes allow a link between sets of two groups, and not all of their sets are in one component."""
    fit = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    return fit & ((F.col("a.lo") != F.col("a.hi")) | (F.col("b.lo") != F.col("b.hi")) | (F.col("a.lo") != F.col("b.lo")))


def jaccard_components(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id, component_size)`` per row of ``docs``; documents of at least ``percent`` per cent Jaccard similarity are linked.

    ``component_id`` is the smallest key that links lead to (null if none is known), ``component_size`` the number of rows there.
    """
    rows = cut_lineage(_shared_counts(docs, key, text))
    enough = rows.where(F.col("node").isNotNull() & (F.col("shared") >= _needed(F.col("size"), percent)))
    sets = cut_lineage(_sets(docs, enough.select("node").distinct(), text).withColumn("id", F.monotonically_increasing_id()))
    ranked = cut_lineage(_prefixes(sets, percent))
    groups = cut_lineage(_groups(ranked, percent))
    own = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("group").alias("one"), F.col("group").alias("two"))
    links = cut_lineage(_links(own, groups, sets, percent))

    cells, n = cut_counted(_cells(groups, links))
    if n:
        top = cells.groupBy("token").agg(F.max_by(F.struct("group", "least", "most", "lo", "hi"), F.struct("n", "group")).alias("b"))
        stars = cells.alias("a").join(top.select("token", "b.*").alias("b"), "token").where((F.col("a.group") != F.col("b.group")) & _possible(percent))
        stars = cut_lineage(stars.select(F.least("a.group", "b.group").alias("one"), F.greatest("a.group", "b.group").alias("two")).distinct())
        links = links.unionByName(cut_lineage(_links(stars, groups, sets, percent)))
        cells, n = cut_counted(_cells(groups, links))
        if n:
            rest = cells.alias("a").join(cells.alias("b"), "token").where((F.col("a.group") < F.col("b.group")) & _possible(percent))
            rest = rest.select(F.col("a.group").alias("one"), F.col("b.group").alias("two")).distinct().join(stars, ["one", "two"], "left_anti")
            links = links.unionByName(cut_lineage(_links(cut_lineage(rest), groups, sets, percent)))

    parts = connected_components(links).select(F.col("name").alias("id"), F.col("component").alias("class"))
    classes = sets.select("id", "node").join(parts, "id").select("node", "class")
    named = rows.select(F.col(key).alias("__key"), "node", F.col("size").cast("long").alias("n_shingles")).join(classes, "node", "left")
    # a set that is linked with no other is a class by itself, named by its node
    named = cut_lineage(named.withColumn("__class", F.when(F.col("class").isNotNull(), F.concat(F.lit("c"), F.col("class").cast("string"))).otherwise(F.hex("node"))))
    firsts = named.where(F.col("__class").isNotNull()).groupBy("__class").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    out = named.join(firsts, "__class", "left")
    alone = F.col("__class").isNull()
    return out.select(F.col("__key").alias(key), "n_shingles", F.when(alone, F.col("__key")).otherwise(F.col("__first")).alias("component_id"),
                      F.when(alone, F.lit(1)).otherwise(F.col("__n")).cast("long").alias("component_size"))
