import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.operators import graph as G

# two triangles and a square joined by bridges, a tail, and a separate triangle
EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("g", "h"), ("h", "i"),
         ("i", "j"), ("j", "g"), ("j", "k"), ("k", "l"), ("x", "y"), ("y", "z"), ("z", "x")]


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def brute_betweenness(edges):
    near = neighbours(edges)
    out = {tuple(sorted(e)): 0.0 for e in edges}
    for s, t in itertools.combinations(sorted(near), 2):
        paths, queue, best = [], deque([[s]]), None
        while queue:
            p = queue.popleft()
            if best is not None and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                paths.append(p)
                continue
            queue.extend(p + [n] for n in near[p[-1]] if n not in p)
        for p in paths:
            for e in zip(p, p[1:]):
                out[tuple(sorted(e))] += 1 / len(paths)
    return out


def brute_components(nodes, edges):
    near = neighbours(edges)
    seen = {}
    for n in sorted(nodes):
        if n in seen:
            continue
        stack = [n]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen[v] = n
                stack.extend(near.get(v, ()))
    return seen


def test_edge_betweenness(spark):
    got = {(r.src, r.dst): r.betweenness for r in G.edge_betweenness(table(spark, EDGES)).collect()}
    want = brute_betweenness(EDGES)
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)


def test_components_on_path_hub_and_random(spark):
    rng = np.random.default_rng(5)
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    hub = [("h", f"s{i}") for i in range(300)]
    rand = [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 80, (60, 2))]
    edges = path + hub + rand
    got = {r.name: r.component for r in G.connected_components(table(spark, edges).repartition(5)).collect()}
    assert got == brute_components(set(itertools.chain(*edges)), edges)


def blocks(edges):
    """Blocks by removing each node and joining the edges at it whose ends stay connected."""
    near, label = neighbours(edges), {tuple(sorted(e)): i for i, e in enumerate(edges)}
    for v in near:
        comp = brute_components([n for n in near if n != v], [e for e in edges if v not in e])
        for a, b in itertools.combinations(sorted(near[v]), 2):
            if comp[a] == comp[b]:
                x, y = label[tuple(sorted((v, a)))], label[tuple(sorted((v, b)))]
                label = {e: (x if g == y else g) for e, g in label.items()}
    return sorted(sorted(e for e in label if label[e] == g) for g in set(label.values()))


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_biconnected(spark, seed):
    edges = EDGES
    if seed is not None:
        rng = np.random.default_rng(seed)
        edges = sorted({tuple(sorted((f"n{a}", f"n{b}"))) for a, b in rng.integers(0, 16, (22, 2)) if a != b})
    got = {}
    for r in G.biconnected_components(table(spark, edges)).collect():
        got.setdefault(r.group, []).append((r.src, r.dst))
    assert sorted(sorted(v) for v in got.values()) == blocks(edges)


def test_tree_has_only_single_edge_blocks(spark):
    got = G.biconnected_components(table(spark, [("a", "b"), ("b", "c"), ("b", "d")])).collect()
    assert len({r.group for r in got}) == 3


def test_authority_is_the_leading_eigenvector(spark):
    rng = np.random.default_rng(0)
    edges = sorted({tuple(sorted((f"n{a:02d}", f"n{b:02d}"))) for a, b in rng.integers(0, 20, (90, 2)) if a != b})
    names = sorted(set(itertools.chain(*edges)))
    a = np.zeros((len(names),) * 2)
    for s, d in edges:
        a[names.index(s), names.index(d)] = a[names.index(d), names.index(s)] = 1
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.name: r.centrality for r in G.authority(table(spark, edges)).collect()}
    assert np.allclose([got[n] for n in names], v / v.max(), atol=1e-4)


def propagated(edges):
    """The rule round by round, to the end; in a cycle the smallest label."""
    near = neighbours(edges)
    lab, states = {n: n for n in near}, []
    while lab not in states:
        states.append(lab)
        new = {}
        for n in near:
            votes = [lab[m] for m in near[n]] + [lab[n]]
            new[n] = min(set(votes), key=lambda x: (-votes.count(x), x))
        lab = new
    cycle = states[states.index(lab):]
    return {n: min(s[n] for s in cycle) for n in near}


@pytest.mark.parametrize("edges", [[(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)], [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("a", "z"), ("b", "z")]])
def test_label_propagation_runs_to_its_end(spark, edges):
    got = {r.name: r.group for r in G.label_propagation(table(spark, edges)).collect()}
    assert got == propagated(edges)


def test_label_propagation(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0")]
    got = {r.name: r.group for r in G.label_propagation(table(spark, cliques)).collect()}
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and len({got[f"b{i}"] for i in range(5)}) == 1


def test_hierarchy_and_filters(spark):
    df = spark.createDataFrame([("A", "o1", "f1"), ("A", "o1", "f2"), ("A", "o2", "f3")], "class string, ord string, fam string")
    e, n = G.hierarchy_edges(df, ["class", "ord", "fam"]), G.hierarchy_nodes(df, ["class", "ord", "fam"])
    assert e.count() == 5 and n.count() == 6
    assert [r.name for r in G.roots(n, e).collect()] == ["A"]
    assert sorted(r.name for r in G.adjacent_to(n, e, ["o1"]).collect()) == ["A", "f1", "f2"]
    nodes, links = G.export_graph(n, e)
    assert [r.id for r in nodes.orderBy("id").collect()] == list(range(1, 7))
    assert sorted((r["from"], r["to"]) for r in links.collect()) == [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6)]
    nodes, edges = G.graph_from_pairs(spark.createDataFrame([("b", "a", 1)], "item1 string, item2 string, n int"))
    assert sorted(tuple(r) for r in nodes.collect()) == [(1, "a"), (2, "b")] and tuple(edges.first()) == (2, 1, 1)
    strong = table(spark, [("a", "b"), ("b", "c")])
    assert G.induced(strong, nodes).count() == 1
    assert G.drop_isolated(spark.createDataFrame([("a",), ("q",)], "name string"), strong).count() == 1
    assert G.flag_edges(strong, ["a"]).where("flag").count() == 1
    assert G.ego_edges(strong, ["b"], both_ends=False).count() == 1 and G.ego_edges(strong, ["b"]).count() == 2


def test_component_rounds_have_as_many_tasks_as_their_edges_need(spark, monkeypatch):
    """Rounds on few edges used to be as many tasks as there are shuffle partitions, each of them and for each of its shuffles."""
    tasks, written = [], G.cut_observed
    monkeypatch.setattr(G, "cut_observed", lambda df, *aggs: (tasks.append(df.rdd.getNumPartitions()), written(df, *aggs))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 7] + [(100, i) for i in range(101, 140)], "src long, dst long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["name"]: r["component"] for r in G.connected_components(edges).collect()}
        stars = spark.createDataFrame([(i, c) for i, c in got.items() if i != c], "src long, dst long")
        rounds = len(tasks) - 1
        again = {r["name"]: r["component"] for r in G.connected_components(stars).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == again == {i: i if i % 7 == 1 else max(j for j in range(i + 1) if j % 7 == 1) for i in range(1, 61)} | {i: 100 for i in range(100, 140)}
    assert max(tasks[1:rounds + 1]) <= 8
    assert len(tasks) - rounds - 1 == 2  # the edges themselves and one round
