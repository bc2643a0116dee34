"""Graphs of item pairs and of the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import R, query, r

LEVELS = ["class", "ord", "family_com_name"]
HIERARCHY = """h AS (SELECT DISTINCT class AS src, ord AS dst, 0 AS level FROM taxonomy
  UNION SELECT DISTINCT ord, family_com_name, 1 FROM taxonomy)"""
IDS = "ids AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT item1 AS name FROM pairs UNION SELECT item2 FROM pairs))"


@query("g01_graph_from_pairs", ("pairs",), f"""
WITH {IDS} SELECT a.id AS src, b.id AS dst, a.name AS name, p.n FROM pairs p JOIN ids a ON p.item1 = a.name JOIN ids b ON p.item2 = b.name""")
def _(t):
    nodes, edges = G.graph_from_pairs(t.pairs)
    return edges.join(nodes.withColumnRenamed("id", "src"), "src").select("src", "dst", "name", "n")


@query("g02_directed_graph", ("taxonomy",), f"""
WITH {HIERARCHY}, ids AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT src AS name FROM h UNION SELECT dst FROM h))
SELECT a.id AS src, b.id AS dst, h.level FROM h JOIN ids a ON h.src = a.name JOIN ids b ON h.dst = b.name""")
def _(t):
    _, edges = G.graph_from_pairs(G.hierarchy_edges(t.taxonomy, LEVELS), "src", "dst")
    return edges


@query("g03_edge_filter", ("pairs",), "SELECT item1 AS src, item2 AS dst, n FROM pairs WHERE n > (SELECT AVG(n) FROM pairs)")
def _(t):
    e = t.pairs.withColumnsRenamed({"item1": "src", "item2": "dst"})
    return e.where(F.col("n") > t.pairs.agg(F.avg("n")).scalar())


@query("g04_drop_isolated", ("phi",), """
SELECT DISTINCT item1 AS name FROM phi WHERE abs(correlation) > 0.012""")
def _(t):
    nodes = t.phi.select(F.col("item1").alias("name")).distinct()
    edges = t.phi.where(F.abs("correlation") > 0.012).select(F.col("item1").alias("src"), F.col("item2").alias("dst"))
    return G.drop_isolated(nodes, edges)


@query("g05_induced", ("strong", "clean"), """
WITH k AS (SELECT common_name FROM clean GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / COUNT(DISTINCT common_name) FROM clean))
SELECT src, dst FROM strong WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)""")
def _(t):
    mean = t.clean.agg(F.count(F.lit(1)) / F.countDistinct("common_name")).scalar()
    often = t.clean.groupBy("common_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > mean)
    return G.induced(t.strong, often.select(F.col("common_name").alias("name")))


@query("g06_node_attributes", ("strong", "clean"), """
SELECT n.name, COUNT(*) AS species_count FROM (SELECT src AS name FROM strong UNION SELECT dst FROM strong) n
JOIN clean c ON c.common_name = n.name GROUP BY 1""")
def _(t):
    counts = t.clean.groupBy(F.col("common_name").alias("__k")).agg(F.count(F.lit(1)).alias("species_count"))
    return G.endpoints(t.strong).join(counts, F.col("name") == F.col("__k"), "left").drop("__k")


@query("g07_ego", ("strong",), "SELECT src, dst FROM strong WHERE src IN ('Brand#4', 'Brand#7') OR dst IN ('Brand#4', 'Brand#7')")
def _(t):
    return G.ego_edges(t.strong, ["Brand#4", "Brand#7"])


@query("g07_ego_leaving", ("pairs",), "SELECT item1 AS src, item2 AS dst, n FROM pairs WHERE item1 IN ('Brand#4', 'Brand#7')")
def _(t):
    return G.ego_edges(t.pairs.withColumnsRenamed({"item1": "src", "item2": "dst"}), ["Brand#4", "Brand#7"], both_ends=False)


AUTHORITY_ROUNDS = 60


def authority_sql() -> str:
    """Power iteration written out round by round."""
    steps = ["a AS (SELECT item1 AS src, item2 AS dst FROM phi WHERE abs(correlation) > 0.005)",
             "s0 AS MATERIALIZED (SELECT src AS name, CAST(1 AS DOUBLE) AS s FROM a GROUP BY 1)"]
    for i in range(1, AUTHORITY_ROUNDS + 1):
        steps.append(f"t{i} AS MATERIALIZED (SELECT dst AS name, SUM(s) AS s FROM a JOIN s{i - 1} ON src = name GROUP BY 1)")
        steps.append(f"s{i} AS MATERIALIZED (SELECT name, s / (SELECT MAX(s) FROM t{i}) AS s FROM t{i})")
    last = f"s{AUTHORITY_ROUNDS}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT name, {R('s', 4)} AS centrality FROM {last} WHERE s > 0.01"


@query("g08_authority", ("phi",), authority_sql())
def _(t):
    e = t.phi.where((F.col("item1") < F.col("item2")) & (F.abs("correlation") > 0.005))
    c = G.authority(e.select(F.col("item1").alias("src"), F.col("item2").alias("dst")))
    return c.where(F.col("centrality") > 0.01).withColumn("centrality", r("centrality", 4))


@query("g09_edge_betweenness", ("strong",), f"""
WITH RECURSIVE b AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
walk AS (SELECT DISTINCT src AS s, src AS v, 0 AS d FROM b UNION SELECT w.s, b.dst, w.d + 1 FROM walk w JOIN b ON w.v = b.src WHERE w.d < 24),
dist AS (SELECT s, v, MIN(d) AS d FROM walk GROUP BY 1, 2),
path AS (SELECT s, v, d, CAST([] AS VARCHAR[]) AS used FROM dist WHERE d = 0
  UNION ALL SELECT p.s, n.v, n.d, list_append(p.used, LEAST(p.v, n.v) || '~' || GREATEST(p.v, n.v))
  FROM path p JOIN b ON p.v = b.src JOIN dist n ON n.s = p.s AND n.v = b.dst AND n.d = p.d + 1),
share AS (SELECT unnest(used) AS e, 1.0 / COUNT(*) OVER (PARTITION BY s, v) AS part FROM path WHERE s < v)
SELECT split_part(e, '~', 1) AS src, split_part(e, '~', 2) AS dst, {R('SUM(part)')} AS betweenness FROM share GROUP BY 1, 2""")
def _(t):
    return G.edge_betweenness(t.strong).withColumn("betweenness", r("betweenness"))


def propagation_sql(rounds: int = 20) -> str:
    steps = ["b AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong)",
             "l0 AS MATERIALIZED (SELECT DISTINCT src AS name, src AS lab FROM b)"]
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS MATERIALIZED (SELECT name, lab FROM (SELECT name, lab, row_number() OVER (PARTITION BY name ORDER BY COUNT(*) DESC, lab) AS rn
  FROM (SELECT b.dst AS name, l.lab FROM b JOIN l{i - 1} l ON b.src = l.name UNION ALL SELECT name, lab FROM l{i - 1}) GROUP BY 1, 2) WHERE rn = 1)""")
    return "WITH " + ",\n".join(steps) + f'\nSELECT name, lab AS "group" FROM l{rounds}'


@query("g10_label_propagation", ("strong",), propagation_sql())
def _(t):
    return G.label_propagation(t.strong)


@query("g11_biconnected", ("strong",), """
WITH RECURSIVE b AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
nodes AS (SELECT DISTINCT src AS name FROM b),
reach AS (SELECT c.name AS cut, n.name AS a, n.name AS z FROM nodes c, nodes n WHERE c.name <> n.name
  UNION SELECT r.cut, r.a, b.dst FROM reach r JOIN b ON r.z = b.src WHERE b.dst <> r.cut),
ends AS (SELECT src || '|' || dst AS e, src AS v, dst AS o FROM strong UNION ALL SELECT src || '|' || dst, dst, src FROM strong),
link AS (SELECT x.e AS e1, y.e AS e2 FROM ends x JOIN ends y ON x.v = y.v JOIN reach r ON r.cut = x.v AND r.a = x.o AND r.z = y.o),
grp AS (SELECT e AS e, e AS o FROM ends UNION SELECT g.e, l.e2 FROM grp g JOIN link l ON g.o = l.e1)
SELECT split_part(e, '|', 1) AS src, split_part(e, '|', 2) AS dst, MIN(o) AS block FROM grp GROUP BY e""")
def _(t):
    d = G.biconnected_components(t.strong)
    named = d.withColumn("e", F.concat("src", F.lit("|"), "dst"))
    return named.join(named.groupBy("group").agg(F.min("e").alias("block")), "group").select("src", "dst", "block")


@query("g12_roots", ("taxonomy",), f"WITH {HIERARCHY} SELECT DISTINCT src AS name FROM h WHERE src NOT IN (SELECT dst FROM h)")
def _(t):
    e = G.hierarchy_edges(t.taxonomy, LEVELS)
    return G.roots(G.endpoints(e), e)


@query("g13_adjacent", ("taxonomy",), f"""
WITH {HIERARCHY}, k AS (SELECT MIN(ord) AS name FROM taxonomy)
SELECT DISTINCT CASE WHEN src = name THEN dst ELSE src END AS name FROM h, k WHERE src = name OR dst = name""")
def _(t):
    e = G.hierarchy_edges(t.taxonomy, LEVELS)
    first = t.taxonomy.agg(F.min("ord")).first()[0]
    return G.adjacent_to(G.endpoints(e), e, [first])


@query("g14_hierarchy_edges", ("taxonomy",), f"WITH {HIERARCHY} SELECT src, dst, level FROM h")
def _(t):
    return G.hierarchy_edges(t.taxonomy, LEVELS)


@query("g15_hierarchy_nodes", ("taxonomy",), """
SELECT class AS name, 'class' AS type, 0 AS level FROM taxonomy UNION SELECT ord, 'ord', 1 FROM taxonomy
UNION SELECT family_com_name, 'family_com_name', 2 FROM taxonomy""")
def _(t):
    return G.hierarchy_nodes(t.taxonomy, LEVELS)


@query("g16_flag_edges", ("strong",), "SELECT src, dst, src = 'Brand#4' OR dst = 'Brand#4' AS flag FROM strong")
def _(t):
    return G.flag_edges(t.strong, ["Brand#4"])


@query("g17_export", ("taxonomy",), f"""
WITH {HIERARCHY}, n AS (SELECT class AS name, 0 AS level FROM taxonomy UNION SELECT ord, 1 FROM taxonomy UNION SELECT family_com_name, 2 FROM taxonomy),
ids AS (SELECT *, row_number() OVER (ORDER BY level, name) AS id FROM n)
SELECT a.id AS "from", b.id AS "to" FROM h JOIN ids a ON h.src = a.name AND h.level = a.level JOIN ids b ON h.dst = b.name AND b.level = h.level + 1""")
def _(t):
    _, links = G.export_graph(G.hierarchy_nodes(t.taxonomy, LEVELS), G.hierarchy_edges(t.taxonomy, LEVELS))
    return links


REACH = """both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT src AS name, src AS other FROM both_ways UNION SELECT r.name, b.dst FROM reach r JOIN both_ways b ON r.other = b.src)
SELECT name, MIN(other) AS component FROM reach GROUP BY 1"""


@query("g18_components", ("strong",), f"WITH RECURSIVE e AS (SELECT * FROM strong), {REACH}")
def _(t):
    return G.connected_components(t.strong)


@query("g18_components_of_customers", (), """
WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'd' || CAST(o_orderdate AS DATE) AS dst FROM orders),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT MIN(src) AS first, MIN(src) AS name FROM both_ways UNION SELECT r.first, b.dst FROM reach r JOIN both_ways b ON r.name = b.src),
parts AS (SELECT n.name, r.first FROM (SELECT DISTINCT src AS name FROM both_ways) n LEFT JOIN reach r USING (name))
SELECT COUNT(*) AS nodes, first AS component FROM parts GROUP BY 2"""
)
def _(t):
    """Customers and days, linked by orders: a graph that grows with the orders table."""
    e = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                        F.concat(F.lit("d"), F.col("o_orderdate").cast("date").cast("string")).alias("dst")).distinct()
    return G.connected_components(e).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
