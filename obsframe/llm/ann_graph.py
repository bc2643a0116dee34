"""Approximate nearest neighbours by inner product, with robust-pruned directed graphs (Jayaram Subramanya et al. 2019).

Vectors go to shards of bounded size by a hash. In each shard a graph is built: a greedy search proposes neighbours of a
vector, and pruning keeps an edge only if no kept neighbour is much closer to its end, which leaves few edges in many
directions. A query walks every shard's graph with a beam, and the shards' answers are merged by their exact scores.

Searching the largest inner product becomes searching the nearest vector by one more coordinate that fills every vector up to the
longest one's length. Equal vectors are one point of the graph with the smallest of their ids, so large groups of copies cannot
crowd out other neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .frames import spread

#: Points per shard and queries per block: what one task holds.
SHARD = 4096
BLOCK = 512


def beam_search(points: np.ndarray, edges: np.ndarray, enter: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(points, squared distances)`` of the beam of every query, nearest first; -1 and infinity fill it up.

    All queries step together: each expands the nearest point of its beam that it has not expanded yet, until it has none.
    """
    q, n = len(queries), len(points)
    norms = (points ** 2).sum(1)
    own = (queries ** 2).sum(1)
    ids = np.full((q, width), -1, dtype=np.int32)
    far = np.full((q, width), np.inf, dtype=np.float32)
    done = np.zeros((q, width), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    ids[:, 0], seen[:, enter] = enter, True
    far[:, 0] = own + norms[enter] - 2 * queries @ points[enter]
    active = np.arange(q)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        some = open_.any(1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        at = open_.argmax(1)  # the beam is sorted: the first open one is the nearest
        done[active, at] = True
        near = edges[ids[active, at]]
        fresh = near >= 0
        fresh &= ~seen[active[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        new = near[rows, cols]
        seen[active[rows], new] = True
        dist = np.full(near.shape, np.inf, dtype=np.float32)
        dist[rows, cols] = own[active[rows]] + norms[new] - 2 * np.einsum("ij,ij->i", queries[active[rows]], points[new])
        all_far = np.concatenate([far[active], dist], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[active] = np.take_along_axis(all_far, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], 1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros_like(fresh)], 1), order, 1)
    return ids, far


def robust_prune(points: np.ndarray, who: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point of ``who`` from its candidates (-1: none): the nearest is kept, and every candidate that it is
    closer to, by the factor ``alpha``, than the point is goes; and so on."""
    c = candidates.copy()
    c[c == who[:, None]] = -1
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    place = points[np.maximum(c, 0)]
    far = np.where(c >= 0, ((place - points[who][:, None]) ** 2).sum(2), np.inf)
    out = np.full((len(who), degree), -1, dtype=np.int32)
    rows = np.arange(len(who))
    for k in range(degree):
        at = far.argmin(1)
        alive = np.isfinite(far[rows, at])
        if not alive.any():
            break
        out[alive, k] = c[rows, at][alive]
        between = ((place - place[rows, at][:, None]) ** 2).sum(2)
        far[alpha * alpha * between <= far] = np.inf
        far[rows, at] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int, width: int, alpha: float, seed: int = 1) -> tuple[np.ndarray, int]:
    """``(edges, entry)``: points are inserted in random order in batches that double, then all are pruned once more with ``alpha``.
    A batch searches the graph as it stands, prunes what it visited, and adds the reverse edges."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int32)
    enter = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([[np.int32(enter)], order[order != enter]])
    for factor in (1.0, alpha):
        lo = 1 if factor == 1.0 and alpha != 1.0 else 0
        while lo < n:
            hi = min(n, lo + min(512, max(1, lo)))
            who = order[lo:hi]
            found, _ = beam_search(points, edges, enter, points[who], width)
            edges[who] = robust_prune(points, who, np.concatenate([found, edges[who]], 1), degree, factor)
            target, source = edges[who].ravel(), np.repeat(who, degree)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else target
            counts = np.diff(np.append(heads, len(target)))
            touched = target[heads]
            back = np.full((len(touched), int(counts.max(initial=0))), -1, dtype=np.int32)
            back[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(heads, counts)] = source
            used = (edges[touched] >= 0).sum(1)
            room = used + counts <= degree
            for i in np.flatnonzero(room):
                have = set(edges[touched[i]].tolist())
                add = [s for s in back[i, :counts[i]].tolist() if s not in have]
                edges[touched[i], used[i]:used[i] + len(add)] = add
            crowded = np.flatnonzero(~room)
            for a in range(0, len(crowded), 512):
                c = crowded[a:a + 512]
                edges[touched[c]] = robust_prune(points, touched[c], np.concatenate([edges[touched[c]], back[c]], 1), degree, factor)
            lo = hi
        if alpha == 1.0:
            break
    return edges, enter


def valid(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", degree: int = 32,
            width: int = 128, alpha: float = 1.2) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` nearest found of every query row among all other rows, nearest first by exact inner product
    in double precision, ties to the smaller key.

    Rows whose vector is null, zero or holds null or non-finite components, rows without a key, and queries of another
    length than a shard's vectors take no part. Of equal vectors only the ``k + 1`` smallest keys can appear, so only they are kept. Rows
    with equal key and vector count once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = rows.withColumn("h", F.xxhash64("v"))

    def smallest(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__rn") <= k + 1).drop("__rn")

    # copies: a part of each group keeps its smallest ids, then the group
    parts = spread(spark)
    kept = rows.select("h", "v", "id").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    kept = smallest(smallest(kept, "h", "v", "part"), "h", "v")
    points = kept.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v"))
    points = cut_lineage(points)
    stats = {r["dim"]: r for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()}
    queries = rows.where("q").select("id", "v").distinct().withColumn("dim", F.size("v"))
    n_queries = queries.count()
    if not stats or not n_queries:
        return rows.where(F.lit(False)).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.lit(0.0).alias("score"))
    shards = {d: -(-r["n"] // SHARD) for d, r in stats.items()}
    of_dim = F.create_map(*[F.lit(x) for d, s in shards.items() for x in (d, s)])
    longest = {d: float(r["m"]) for d, r in stats.items()}
    blocks = -(-n_queries // BLOCK)
    id_type = rows.schema["id"].dataType.simpleString()

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        p = np.concatenate([v, np.sqrt(np.maximum(longest[v.shape[1]] - (v * v).sum(1), 0))[:, None]], 1).astype(np.float32)
        edges, enter = build_graph(p, degree, width, alpha)
        counts = pdf["ids"].map(len).to_numpy()
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "points": [v.tobytes()], "edges": [edges.tobytes()], "entry": [enter],
                             "counts": [counts.astype(np.int32).tobytes()], "ids": [np.concatenate(pdf["ids"].to_numpy())]})

    hashed = F.pmod(F.xxhash64("h", F.lit(3)), F.col("dim").cast("long") * 0 + F.element_at(of_dim, F.col("dim")))
    graphs = cut_lineage(points.withColumn("shard", hashed.cast("int")).groupBy("dim", "shard").applyInPandas(
        graph, f"dim int, shard int, points binary, edges binary, entry int, counts binary, ids array<{id_type}>"))
    # every block of queries meets every shard of its length; a pair of them is one group
    block = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int")
    asked = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(of_dim, F.col("dim")) - 1)))
    walked = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key_: tuple, graphs_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype=object), "id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        if not len(graphs_) or not len(asked_):
            return empty
        g, d = graphs_.iloc[0], int(key_[0])
        v = np.frombuffer(g["points"]).reshape(-1, d)
        p = np.concatenate([v, np.sqrt(np.maximum(longest[d] - (v * v).sum(1), 0))[:, None]], 1).astype(np.float32)
        edges, counts = np.frombuffer(g["edges"], np.int32).reshape(len(v), -1), np.frombuffer(g["counts"], np.int32)
        first, ids = np.cumsum(counts) - counts, np.asarray(g["ids"])
        out = []
        for lo in range(0, len(asked_), BLOCK):
            part = asked_.iloc[lo:lo + BLOCK]
            q = np.stack(part["v"].to_numpy())
            scale = np.sqrt((q * q).sum(1, keepdims=True))  # the order does not depend on a query's length
            walk = np.concatenate([q / scale * np.sqrt(longest[d] or 1), np.zeros((len(q), 1))], 1).astype(np.float32)
            found, _ = beam_search(p, edges, int(g["entry"]), walk, max(width, 2 * k))
            row, at = np.nonzero(found >= 0)
            point = found[row, at]
            score = np.array([float(np.dot(q[r], v[x])) for r, x in zip(row, point)])
            size = counts[point]
            who = np.repeat(np.arange(len(point)), size)
            mine = ids[np.repeat(first[point] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            asker = part["id"].to_numpy()[row[who]]
            ranked = pd.DataFrame({"query_id": asker, "id": mine, "score": score[who]})
            ranked = ranked[ranked["query_id"] != ranked["id"]].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
            out.append(ranked.groupby("query_id", sort=False).head(k))
        return pd.concat(out)

    found = walked.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(
        search, f"query_id {id_type}, id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
