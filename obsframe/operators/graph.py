"""Graph operators over edge and node DataFrames.

Edges are ``(src, dst, …)``. Iterative operators keep their state in DataFrames, aggregate
messages with partial aggregation (no neighbour list is ever gathered), and cut the lineage with
a reliable checkpoint each round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted, cut_lineage, cut_observed, drop_steps, tasks_for
from .ordered import row_number


# -- construction ----------------------------------------------------------------------------

def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def graph_from_pairs(pairs: DataFrame, item1: str = "item1", item2: str = "item2") -> tuple[DataFrame, DataFrame]:
    """``nodes(id, name)`` with dense ids by name, and ``edges(src, dst, …)`` by id."""
    nodes = row_number(pairs.select(F.explode(F.array(item1, item2)).alias("name")).distinct(), ["name"], "id")
    nodes = nodes.select("id", "name")
    return nodes, edges_by_id(pairs, nodes, item1, item2)


def edges_by_id(pairs: DataFrame, nodes: DataFrame, from_: str, to: str) -> DataFrame:
    """Replace two name columns by the node ids ``src`` and ``dst``."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("__a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("__b"))
    rest = [c for c in pairs.columns if c not in (from_, to)]
    named = pairs.withColumnsRenamed({from_: "__from", to: "__to"})
    return (named.join(a, F.col("__from") == F.col("__a")).join(b, F.col("__to") == F.col("__b"))
            .select("src", "dst", *rest))


def hierarchy_edges(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct (parent, child) pairs of adjacent levels."""
    pairs = F.explode(F.array(*[
        F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(i).alias("level"))
        for i, (a, b) in enumerate(zip(levels, levels[1:]))]))
    return df.select(pairs.alias("e")).select("e.*").distinct()


def hierarchy_nodes(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct ``(name, type)`` with the level's rank."""
    parts = F.explode(F.array(*[
        F.struct(F.col(c).alias("name"), F.lit(c).alias("type"), F.lit(i).alias("level")) for i, c in enumerate(levels)]))
    return df.select(parts.alias("n")).select("n.*").distinct()


def export_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered 1..n by (level, name) and links by those numbers."""
    numbered = row_number(nodes, ["level", "name"], "id").select("id", "name", "type", "level")
    a = numbered.select(F.col("id").alias("from"), F.col("name").alias("__a"), F.col("level").alias("__la"))
    b = numbered.select(F.col("id").alias("to"), F.col("name").alias("__b"), F.col("level").alias("__lb"))
    links = (edges.join(a, (F.col("src") == F.col("__a")) & (F.col("level") == F.col("__la")))
             .join(b, (F.col("dst") == F.col("__b")) & (F.col("level") + 1 == F.col("__lb"))).select("from", "to"))
    return numbered.drop("level"), links


# -- filters ---------------------------------------------------------------------------------

def drop_isolated(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    return nodes.join(endpoints(edges).withColumnRenamed("name", key), key, "left_semi")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """Edges with both ends among the nodes."""
    a = nodes.select(F.col(key).alias("__a"))
    b = nodes.select(F.col(key).alias("__b"))
    return edges.join(a, F.col("src") == F.col("__a"), "left_semi").join(b, F.col("dst") == F.col("__b"), "left_semi")


def ego_edges(edges: DataFrame, targets: Sequence, both_ends: bool = True) -> DataFrame:
    """Edges at (or, with ``both_ends=False``, leaving) the target nodes."""
    hit = F.col("src").isin(list(targets))
    return edges.where(hit | F.col("dst").isin(list(targets))) if both_ends else edges.where(hit)


def flag_edges(edges: DataFrame, targets: Sequence, name: str = "flag") -> DataFrame:
    return edges.withColumn(name, F.col("src").isin(list(targets)) | F.col("dst").isin(list(targets)))


def roots(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def adjacent_to(nodes: DataFrame, edges: DataFrame, targets: Sequence, key: str = "name") -> DataFrame:
    """Nodes one step away from a target, in either direction."""
    near = symmetric(edges).where(F.col("src").isin(list(targets))).select(F.col("dst").alias(key)).distinct()
    return nodes.join(near, key, "left_semi")


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct directed copies of undirected edges, loops removed."""
    both = F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                             F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.where(F.col("src") != F.col("dst")).select(both.alias("e")).select("e.*").distinct()


# -- components ------------------------------------------------------------------------------

def connected_components(edges: DataFrame) -> DataFrame:
    """``(name, component)``: the smallest node name of each component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): a logarithmic number in
    practice, each two aggregations for minima and joins, so a hub is never one task's list. The tasks of a
    round follow its edges, not the shuffle partitions. Edges that are stars around the smallest names take one round.
    """
    down = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")]
    cur, seen = cut_observed(down.distinct(), *mark)
    nodes = cut_lineage(endpoints(edges).coalesce(tasks_for(seen["n"])))
    while True:
        k = tasks_for(seen["n"])
        # edges always point from the larger to the smaller node and are distinct
        both = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
                                 F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
        sym = cur.select(both.alias("e")).select("e.*")
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or u itself)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = sym.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).coalesce(k).distinct().coalesce(k)
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (large.join(least, "src").coalesce(k).select(F.explode(F.array(
            F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")),
            F.struct(F.col("src").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*")
            .where(F.col("src") != F.col("dst")).distinct().coalesce(k))
        last = cur
        cur, state = cut_observed(small, *mark)
        drop_steps(last)
        if state == seen:
            break
        seen = state
    return nodes.join(cur.select(F.col("src").alias("name"), F.col("dst").alias("__c")), "name", "left").select(
        "name", F.coalesce("__c", "name").alias("component"))


# -- centrality and communities --------------------------------------------------------------

def authority(edges: DataFrame, weight: str | None = None, tol: float = 1e-6, check_every: int = 5) -> DataFrame:
    """``(name, centrality)``: HITS authority on an undirected graph, scaled to a maximum of 1.

    One round multiplies by the adjacency twice. Rounds go on until no value moves by ``tol`` in ``check_every`` rounds; an error
    if the movement does not shrink any more. Unweighted unless ``weight`` names a column.
    """
    both = F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                             F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    adj = cut_lineage(edges.select(both.alias("e"), w.alias("w")).select("e.*", "w"))
    score = cut_lineage(endpoints(edges).withColumn("s", F.lit(1.0)))

    def spread(vec):
        sent = adj.join(vec, F.col("src") == F.col("name")).groupBy("dst").agg(F.sum(F.col("w") * F.col("s")).alias("s"))
        return sent.withColumnRenamed("dst", "name")

    smallest, stalled = None, 0
    while True:
        # scaling once per batch of rounds is enough: doubles hold the growth in between
        raw = score
        for _ in range(check_every):
            raw = spread(spread(raw))
        raw = cut_lineage(raw)
        top = raw.agg(F.max("s")).first()[0]
        new = raw.withColumn("s", F.try_divide(F.col("s"), F.lit(top)))
        old = score.withColumnsRenamed({"name": "__n", "s": "__s"})
        gap = new.join(old, F.col("name") == F.col("__n")).agg(F.max(F.abs(F.col("s") - F.col("__s")))).first()[0]
        score = new
        if gap is None or gap < tol:
            return score.withColumnRenamed("s", "centrality")
        smallest, stalled = (gap, 0) if smallest is None or gap < smallest else (smallest, stalled + 1)
        if math.isnan(gap) or stalled > 20:
            raise RuntimeError(f"authority does not settle: values still move by {gap}")


def label_propagation(edges: DataFrame) -> DataFrame:
    """``(name, group)``: each node takes the label most of its neighbours carry; its own label
    counts once, ties go to the smallest label.

    Rounds go on until nothing changes. If they come back to an earlier state instead, each node takes the smallest label it
    has in that cycle.
    """
    adj = cut_lineage(symmetric(edges))
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("name", "group").cast("decimal(38,0)")).alias("h")]
    lab, state = cut_observed(endpoints(edges).withColumn("group", F.col("name")), *mark)
    states, seen = [lab], [state]
    while True:
        sent = adj.join(lab, F.col("src") == F.col("name")).select(F.col("dst").alias("name"), "group").unionByName(lab)
        votes = sent.groupBy("name", "group").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("name").agg(F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("group"))
        lab, state = cut_observed(best, *mark)
        if state in seen:
            cycle = states[seen.index(state):]
            every = reduce(lambda a, b: a.unionByName(b), cycle)
            return every.groupBy("name").agg(F.min("group").alias("group"))
        states.append(lab)
        seen.append(state)


def _brandes_levels(adj: DataFrame) -> DataFrame:
    """One level-synchronous Brandes pass from every source at once.

    The frontier is a table of (source, node) with path counts, grown level by level; then the
    dependencies are summed back level by level. Every level is written once.
    """
    frontier = cut_lineage(adj.select(F.col("src").alias("s"), F.col("src").alias("v")).distinct()
                           .withColumn("sigma", F.lit(1.0)))
    levels = [frontier]
    visited = frontier.select("s", "v")
    while True:
        step = (frontier.join(adj, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), "sigma")
                .join(visited, ["s", "v"], "left_anti")
                .groupBy("s", "v").agg(F.sum("sigma").alias("sigma")))
        frontier, n = cut_counted(step)
        if n == 0:
            break
        levels.append(frontier)
        visited = visited.unionByName(frontier.select("s", "v"))
    flows, delta = [], None
    for depth in range(len(levels) - 1, 0, -1):
        low = levels[depth].select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"))
        if delta is None:
            low = low.withColumn("delta", F.lit(0.0))
        else:
            low = low.join(delta.withColumnRenamed("v", "w"), ["s", "w"], "left")
        low = low.withColumn("share", (1 + F.coalesce("delta", F.lit(0.0))) / F.col("sw"))
        back = cut_lineage(low.join(adj.withColumnsRenamed({"src": "w", "dst": "v"}), "w")
                           .join(levels[depth - 1].select("s", "v", "sigma"), ["s", "v"])
                           .select("s", "v", "w", (F.col("sigma") * F.col("share")).alias("flow")))
        flows.append(back.select("v", "w", "flow"))
        delta = back.groupBy("s", "v").agg(F.sum("flow").alias("delta"))
    if not flows:
        kind = adj.schema["src"].dataType.simpleString()
        return adj.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, betweenness double")
    every = flows[0]
    for f in flows[1:]:
        every = every.unionByName(f)
    return (every.groupBy(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"))
            .agg((F.sum("flow") / 2).alias("betweenness")))


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """``(src, dst, betweenness)`` of an undirected, unweighted graph.

    All sources walk at once, so the work is one row per source and node that reach each other: for graphs of items, not of rows.
    """
    return _brandes_levels(cut_lineage(symmetric(edges)))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Newman modularity of a node grouping, for distinct undirected edges."""
    a = groups.select(F.col("name").alias("src"), F.col("group").alias("ga"))
    b = groups.select(F.col("name").alias("dst"), F.col("group").alias("gb"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst")
    m = e.agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("ga") == F.col("gb"), 1)).alias("inside")).first()
    deg = (e.select(F.explode(F.array("ga", "gb")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("d"))
           .agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("q")).first())
    return m["inside"] / m["m"] - deg["q"] / (4.0 * m["m"] ** 2)


def bfs_forest(edges: DataFrame) -> DataFrame:
    """``(name, parent, depth)``: a breadth-first tree per component, rooted at its smallest node;
    the parent is the smallest neighbour one level up."""
    adj = cut_lineage(symmetric(edges))
    comp = connected_components(edges)
    front = cut_lineage(comp.where(F.col("name") == F.col("component")).select(
        "name", F.lit(None).cast(comp.schema["name"].dataType).alias("parent"), F.lit(0).alias("depth")))
    forest = front
    depth = 0
    while True:
        depth += 1
        nxt = (front.select(F.col("name").alias("src")).join(adj, "src")
               .join(forest.select(F.col("name").alias("dst")), "dst", "left_anti")
               .groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("parent")).withColumn("depth", F.lit(depth)))
        front, n = cut_counted(nxt)
        if n == 0:
            return forest
        forest = cut_lineage(forest.unionByName(front))


def biconnected_components(edges: DataFrame) -> DataFrame:
    """``(src, dst, group)``: a label per undirected edge.

    On a breadth-first forest each tree edge is named by its lower node. Every other edge closes
    one cycle with the tree; all tree edges on that cycle belong together. The cycles are climbed
    level by level as (a, b) pairs of nodes, duplicates merged, and the links between tree edges
    go to ``connected_components``. The label is the smallest lower node of the component.
    """
    base = cut_lineage(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
                       .where(F.col("src") != F.col("dst")).distinct())
    forest = bfs_forest(base)
    up = forest.select("name", "parent", "depth")

    def lookup(df, side):
        t = up.withColumnsRenamed({"name": f"__{side}", "parent": f"p{side}", "depth": f"d{side}"})
        return df.join(t, F.col(side) == F.col(f"__{side}")).drop(f"__{side}")

    placed = lookup(lookup(base.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a"), "b")
    is_tree = F.col("pa").eqNullSafe(F.col("b")) | F.col("pb").eqNullSafe(F.col("a"))
    placed = cut_lineage(placed.withColumn("tree", is_tree).withColumn(
        "lower", F.when(F.col("tree"), F.when(F.col("pa").eqNullSafe(F.col("b")), F.col("a")).otherwise(F.col("b")))
        .when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b"))))
    pairs, n_pairs = cut_counted(placed.where(~F.col("tree")).select("a", "b").distinct())
    links = []
    while n_pairs:
        at = lookup(lookup(pairs, "a"), "b")
        # the deeper end climbs; at equal depth both do
        na = F.when(F.col("da") >= F.col("db"), F.col("pa")).otherwise(F.col("a"))
        nb = F.when(F.col("db") >= F.col("da"), F.col("pb")).otherwise(F.col("b"))
        moved = cut_lineage(at.withColumn("na", na).withColumn("nb", nb))
        deep = F.greatest("da", "db")
        own_a, own_b = F.col("da") == deep, F.col("db") == deep
        link = moved.select(F.explode(F.array_compact(F.array(
            # both ends passed in this step belong to the cycle
            F.when(own_a & own_b, F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))),
            # a passed edge belongs with the next one of its side, unless the cycle ends there
            F.when(own_a & (F.col("na") != F.col("nb")) & (F.col("da") > 1),
                   F.struct(F.col("a").alias("src"), F.col("na").alias("dst"))),
            F.when(own_b & (F.col("na") != F.col("nb")) & (F.col("db") > 1),
                   F.struct(F.col("b").alias("src"), F.col("nb").alias("dst"))),
            # ends of different depth: the lower one's edge and the other end share the cycle
            F.when(own_a & ~own_b & (F.col("na") != F.col("nb")), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))),
            F.when(own_b & ~own_a & (F.col("na") != F.col("nb")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))),
        ))).alias("l")).select("l.*")
        links.append(link)
        pairs, n_pairs = cut_counted(moved.where(F.col("na") != F.col("nb")).select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    tree_ids = forest.where(F.col("parent").isNotNull()).select("name")
    if links:
        joined = links[0]
        for link in links[1:]:
            joined = joined.unionByName(link)
        comp = connected_components(joined)
        label = tree_ids.join(comp, "name", "left").select("name", F.coalesce("component", "name").alias("group"))
    else:
        label = tree_ids.withColumn("group", F.col("name"))
    return placed.join(label, F.col("lower") == F.col("name")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "group")
