import math
import random

import numpy as np
import pytest

from obsframe.llm.ann_graph import beam_search, build_graph, nearest, robust_prune
from pyspark.sql import functions as F


def brute(rows, queries, k):
    """rows: id → vector; exact answers in the wanted order."""
    out = {}
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids], dtype=float)
    for q in queries:
        s = m @ np.array(rows[q], dtype=float)
        order = sorted((-s[i], int(ids[i])) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -x) for x, i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    """Of the exact answers, those found or tied with the last score."""
    hits = total = 0
    for q, w in want.items():
        total += len(w)
        hits += sum(s >= w[-1][1] - 1e-9 for _, s in got.get(q, [])[:len(w)])
    return hits / total


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.2], [-3, 0]], dtype=np.float32)
    got = robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 5, 5, 0, -1]], dtype=np.int32), 4, 1.2)
    assert got.tolist() == [[1, 3, 5, -1]]


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 16)).astype(np.float32)
    edges, enter = build_graph(points, 24, 48, 1.2)
    assert (edges < 1500).all() and (edges != np.arange(1500)[:, None]).all()
    q = rng.normal(size=(60, 16)).astype(np.float32)
    found, far = beam_search(points, edges, enter, q, 64)
    exact = ((q[:, None] - points[None]) ** 2).sum(2)
    best = np.argsort(exact, 1)[:, :10]
    assert np.mean([len(set(b) & set(f[:10])) / 10 for b, f in zip(best, found)]) > .95
    assert (np.diff(far, axis=1) >= 0).all()


@pytest.mark.parametrize("kind", ["normal", "clusters", "lengths"])
def test_recall_over_shards(spark, kind, monkeypatch):
    import obsframe.llm.ann_graph as m

    monkeypatch.setattr(m, "SHARD", 700)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 12))
    if kind == "clusters":
        v = rng.normal(size=(10, 12))[rng.integers(0, 10, 3000)] * 3 + v * .2
    if kind == "lengths":
        v *= rng.lognormal(0, 1, (3000, 1))
    rows = {i: v[i].astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    queries = range(0, 3000, 50)
    got, want = answers(nearest(df, F.col("vec_id") % 50 == 0, 10)), brute(rows, queries, 10)
    assert recall(got, want) > .95
    for q, found in got.items():
        for i, s in found:
            assert math.isclose(s, float(np.dot(np.array(rows[q], dtype=float), np.array(rows[i], dtype=float))), rel_tol=1e-12, abs_tol=1e-12)


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(2)
    rows = {i: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for i in range(300)}
    rows |= {1000 + i: [5.0, 5.0, 5.0] for i in range(400)}
    table = [*rows.items(), (2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 2.0]), (2060, [float("nan"), 1.0, 1.0]), (2080, [float("inf"), 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (2100, []), (0, rows[0]), (1000, rows[1000])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in table], "vec_id long, embedding array<double>, score double, rank string")
    good = {i: v for i, v in rows.items() if any(v)}
    queries = [i for i in good if i % 20 == 0]
    got = answers(nearest(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {q: [(i, s) for i, s in w] for q, w in brute(good, queries, 20).items()}


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert answers(nearest(df, F.col("vec_id") % 20 == 0, 20)) == {0: [(20, 4.0), (3, 3.0)], 20: [(0, 4.0), (3, 3.0)]}
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).collect() == []


def test_query_on_the_tables(spark, folder):
    from obsframe.llm.queries import op5_nearest_pruned_graph

    rows = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = answers(op5_nearest_pruned_graph(spark, folder))
    assert recall(got, brute(rows, [i for i in rows if i % 20 == 0], 20)) > .95
