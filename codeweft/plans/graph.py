"""Graph queries (K) over package relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import metrics as M
from codeweft.operators import graph as G
from codeweft.operators.skew import cell_join
from codeweft.plans.adapters import reduced_sql
from codeweft.session import cut_lineage, load


def _reduced_edges(spark, sf, depth: int = 3):
    """Relations with both names reduced to ``depth`` parts."""
    return load(spark, sf, "edges").select("repo", M.reduce_namespace("src", depth).alias("src"), M.reduce_namespace("dst", depth).alias("dst"), "weight")


def _graph(spark, sf):
    return G.dependency_graph(_reduced_edges(spark, sf))


def detected(spark, sf):
    """Graph and communities of all repos by label propagation, one repo at a time; nodes are named ``repo:package``.

    Returns ``(graph, members)``, both written once.
    """
    e = _reduced_edges(spark, sf).where("src is not null and dst is not null and src <> dst")
    named = lambda c: F.concat_ws(":", "repo", c)
    members = cut_lineage(G.label_communities(e, "repo").select(F.concat_ws(":", "scope", "node").alias("node"), F.concat_ws(":", "scope", "community").alias("community")))
    return cut_lineage(G.dependency_graph(e.select(named("src").alias("src"), named("dst").alias("dst")))), members


def _members(spark, sf):
    """Given communities, by the last part of the name, over which SQL can repeat the measures; ``detected`` finds communities."""
    g = _reduced_edges(spark, sf).where("src is not null and dst is not null and src <> dst")
    return g.select(F.col("src").alias("node")).unionAll(g.select("dst")).distinct().select("node", F.element_at(F.split("node", r"\."), -1).alias("community"))


def k01_dependency_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)


def k02_external_nodes(spark, sf):
    """Targets that are never a source."""
    g = _graph(spark, sf)
    return g.select(F.col("dst").alias("node")).distinct().join(g.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def k03_communities(spark, sf):
    """Communities of each repo by asynchronous label propagation."""
    return G.label_communities(load(spark, sf, "edges"), "repo")


def k04_undirected(spark, sf):
    return G.undirected(_graph(spark, sf))


def k06_density(spark, sf):
    return G.density(_graph(spark, sf)).withColumn("density", F.round("density", 9))


def k07_modularity(spark, sf):
    return G.modularity(_graph(spark, sf), _members(spark, sf)).withColumn("modularity", F.round("modularity", 9))


def k08_purity(spark, sf):
    """Most frequent first name part of each community, its share and the size (K-08, K-20)."""
    return G.purity(_members(spark, sf))


def k09_community_edges(spark, sf):
    return G.community_edges(_graph(spark, sf), _members(spark, sf))


def k10_boundary_nodes(spark, sf):
    return G.boundary_nodes(_graph(spark, sf), _members(spark, sf))


def k11_coupling_ratio(spark, sf):
    return G.community_coupling(k09_community_edges(spark, sf))


def _whole(df, run, schema):
    """A small graph (one node per community) in one task."""
    return df.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, schema)


def k12_betweenness(spark, sf):
    """Betweenness of communities in the undirected graph between them."""
    links = k09_community_edges(spark, sf).where("from_community <> to_community").select(F.col("from_community").alias("src"), F.col("to_community").alias("dst"))
    return G.betweenness_of(links).select(F.col("node").alias("community"), "betweenness")


def k13_levels(spark, sf):
    """Strongly connected components and longest-path levels of all communities, over all edges between them."""
    links = k09_community_edges(spark, sf).where("from_community <> to_community").select(F.col("from_community").alias("src"), F.col("to_community").alias("dst"))
    own = _members(spark, sf).select(F.col("community").alias("src"), F.col("community").alias("dst")).distinct()  # a loop changes no component or level
    links = links.unionByName(own)
    return _whole(links, lambda pdf: pd.DataFrame([(v, c, n) for v, (c, n) in sorted(G.components_and_levels(pdf).items())], columns=["community", "component", "level"]), "community string, component string, level bigint")


def k14_matrix_order(spark, sf):
    links = k09_community_edges(spark, sf).where("from_community <> to_community").select(F.col("from_community").alias("src"), F.col("to_community").alias("dst"))
    return _whole(links, lambda pdf: pd.DataFrame([(v, i) for i, v in enumerate(G.bandwidth_order(pdf))], columns=["community", "place"]), "community string, place bigint")


def k15_top_paths(spark, sf):
    """The five most probable paths from communities that nothing points to, up to eight communities long (K-15)."""
    links = k09_community_edges(spark, sf).where("from_community <> to_community").select(F.col("from_community").alias("src"), F.col("to_community").alias("dst"), "weight")
    return G.top_paths(links, _members(spark, sf).select(F.col("community").alias("node")))


def k16_subgraph(spark, sf, name: str = "core", depth: int = 2):
    """Packages within ``depth`` steps of ``name``, and direct users of it (K-16, N-05)."""
    g = _graph(spark, sf)
    near = G.reach(g, spark.createDataFrame([(name,)], "start string"), depth).select("node", "depth")
    return near.unionByName(g.where(F.col("dst") == name).select(F.col("src").alias("node"), F.lit(-1).alias("depth")))


def n05_get_dependencies(spark, sf, name: str = "ledger", depth: int = 2):
    """Edges of the packages within ``depth`` steps of every package whose name holds ``name``, and edges to it (N-05)."""
    g = cut_lineage(_graph(spark, sf))
    starts = cut_lineage(g.select(F.col("src").alias("start")).where(F.lower("start").contains(name.lower())).distinct())
    near = cut_lineage(G.reach(g, starts, depth - 1).select("start", F.col("node").alias("src")))
    # both parts hold a row once and no row is in both, as the whole, starts times the edges of their hubs, is too much to be made distinct
    back = g.join(starts, F.col("dst") == F.col("start")).join(near, ["start", "src"], "left_anti")
    return cell_join(g, near, "src").select("start", "src", "dst", "n").unionByName(back.select("start", "src", "dst", "n"))


def k17_bounded_depth(spark, sf):
    """Greatest depth of at most 4 that each repo-wide package reaches."""
    g = _graph(spark, sf)
    starts = spark.createDataFrame([(x,) for x in ("core", "app", "internal", "shared.util", "common.model")], "start string")
    return G.reach(g, starts, 4).groupBy("start").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_reached"))


def k05_merged_communities(spark, sf, least: int = 3):
    """Detected communities, those of fewer than ``least`` packages merged into their strongest neighbour (K-05)."""
    graph, members = detected(spark, sf)
    return G.merge_small(members, graph, least)


def k18_lcom4(spark, sf):
    """LCOM4 of customers: orders as methods, supplier groups as attributes (D-08)."""
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    t = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("class_id"), F.col("o_orderkey").alias("method"), F.col("l_suppkey").alias("attribute")).distinct()
    return G.lcom4(t)


def k19_coupling_lookup(spark, sf, name: str = "Ledger"):
    """What packages whose name holds ``name`` depend on, and what depends on them."""
    g = _graph(spark, sf)
    part = name.lower()
    a = g.where(F.lower("src").contains(part)).select(F.col("src").alias("package"), F.col("dst").alias("other"), F.lit("depends_on").alias("direction"), "n")
    b = g.where(F.lower("dst").contains(part)).select(F.col("dst").alias("package"), F.col("src").alias("other"), F.lit("depended_by").alias("direction"), "n")
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (
    k01_dependency_graph, k02_external_nodes, k03_communities, k04_undirected, k06_density, k07_modularity, k08_purity, k09_community_edges, k10_boundary_nodes, k11_coupling_ratio, k12_betweenness, k13_levels, k14_matrix_order, k15_top_paths,
    k16_subgraph, n05_get_dependencies, k05_merged_communities, k17_bounded_depth, k18_lcom4, k19_coupling_lookup,
)}

_G = f"""e3 AS (SELECT repo, {reduced_sql('src', 3)} AS src, {reduced_sql('dst', 3)} AS dst FROM edges), g AS (SELECT src, dst, count(*) AS n FROM e3 WHERE src <> dst GROUP BY src, dst),
    m AS (SELECT node, split_part(node, '.', -1) AS community FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)),
    u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g)"""
_L = _G + ", l AS (SELECT x.community AS from_community, y.community AS to_community, count(*) AS n_edges, CAST(sum(n) AS BIGINT) AS weight FROM g JOIN m x ON x.node = src JOIN m y ON y.node = dst GROUP BY 1, 2)"

SQL = {
    "k01_dependency_graph": f"WITH {_G} SELECT * FROM g",
    "k02_external_nodes": f"WITH {_G} SELECT DISTINCT dst AS node FROM g WHERE dst NOT IN (SELECT src FROM g)",
    "k04_undirected": f"WITH {_G} SELECT * FROM u",
    "k06_density": f"WITH {_G}, c AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM u) AS m) SELECT n, m, round(CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1))::DOUBLE ELSE 0.0 END, 9) AS density FROM c",
    "k07_modularity": f"WITH {_G}, d AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node), w AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM u), i AS (SELECT count(*) AS e, sum(x.k * y.k) AS kk FROM u JOIN d x ON x.node = a JOIN d y ON y.node = b JOIN m p ON p.node = a JOIN m q ON q.node = b WHERE p.community = q.community) SELECT round((e - coalesce(kk, 0) / (2 * m)) / (2 * m), 9) AS modularity, CAST(m AS BIGINT) AS m FROM w, i",
    "k08_purity": f"WITH {_G}, c AS (SELECT community, split_part(node, '.', 1) AS ns, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY community) AS BIGINT) AS size, row_number() OVER (PARTITION BY community ORDER BY n DESC, ns) AS k FROM c) SELECT community, size, ns AS top_namespace, round(n / size::DOUBLE, 6) AS purity FROM r WHERE k = 1",
    "k09_community_edges": f"WITH {_L} SELECT * FROM l",
    "k10_boundary_nodes": f"WITH {_G} SELECT src AS node, count(DISTINCT y.community) AS n_foreign FROM g JOIN m x ON x.node = src JOIN m y ON y.node = dst WHERE x.community <> y.community GROUP BY src HAVING count(DISTINCT y.community) >= 2",
    "k11_coupling_ratio": f"""WITH {_L}, s AS (SELECT community, CAST(sum(i) AS BIGINT) AS inside, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(n) AS BIGINT) AS incoming FROM (
        SELECT from_community AS community, CASE WHEN from_community = to_community THEN n_edges ELSE 0 END AS i, CASE WHEN from_community <> to_community THEN n_edges ELSE 0 END AS o, 0 AS n FROM l
        UNION ALL SELECT to_community, 0, 0, n_edges FROM l WHERE from_community <> to_community) GROUP BY community)
        SELECT *, round(CASE WHEN inside + outgoing + incoming > 0 THEN outgoing / (inside + outgoing + incoming)::DOUBLE ELSE 0.0 END, 6) AS coupling FROM s""",
    "k15_top_paths": f"""WITH RECURSIVE {_L}, k AS (SELECT from_community AS src, to_community AS dst, weight FROM l WHERE from_community <> to_community),
        o AS (SELECT src AS f, sum(weight) AS whole FROM k GROUP BY 1), p AS (SELECT src, dst, weight / whole::DOUBLE AS share FROM k JOIN o ON f = src),
        r AS (SELECT DISTINCT community AS start, community AS node, [community] AS nodes, CAST(1.0 AS DOUBLE) AS p FROM m WHERE community NOT IN (SELECT dst FROM k)
            UNION ALL SELECT start, dst, list_append(nodes, dst), r.p * share FROM r JOIN p ON src = node WHERE len(nodes) < 8 AND r.p >= 0.001 AND NOT list_contains(nodes, dst)),
        e AS (SELECT start, array_to_string(nodes, '>') AS path, round(p, 9) AS p FROM r WHERE len(nodes) = 8 OR p < 0.001 OR node NOT IN (SELECT src FROM p))
        SELECT * FROM (SELECT start, path, p, row_number() OVER (PARTITION BY start ORDER BY p DESC, path) AS place FROM e) WHERE place <= 5""",
    "k16_subgraph": f"""WITH {_G}, a AS (SELECT DISTINCT dst AS node FROM g WHERE src = 'core' AND dst <> 'core'), b AS (SELECT DISTINCT dst AS node FROM g JOIN a ON src = node WHERE dst <> 'core' AND dst NOT IN (SELECT node FROM a))
        SELECT 'core' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b UNION ALL SELECT src, -1 FROM g WHERE dst = 'core'""",
    "k17_bounded_depth": f"""WITH RECURSIVE {_G}, r AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES ('core'), ('app'), ('internal'), ('shared.util'), ('common.model')) v(s)
        UNION SELECT start, dst, depth + 1 FROM r JOIN g ON src = node WHERE depth < 4), f AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2)
        SELECT start, max(depth) AS depth, count(*) AS n_reached FROM f GROUP BY start""",
    "k19_coupling_lookup": f"WITH {_G} SELECT src AS package, dst AS other, 'depends_on' AS direction, n FROM g WHERE contains(lower(src), 'ledger') UNION ALL SELECT dst, src, 'depended_by', n FROM g WHERE contains(lower(dst), 'ledger')",
    "n05_get_dependencies": f"""WITH {_G}, st AS (SELECT DISTINCT src AS s FROM g WHERE contains(lower(src), 'ledger')), r AS (SELECT s, s AS node FROM st UNION SELECT s, dst FROM g JOIN st ON src = s) SELECT s AS start, src, dst, n FROM g JOIN r ON r.node = g.src UNION SELECT s, src, dst, n FROM g JOIN st ON st.s = g.dst""",
    "k18_lcom4": """WITH RECURSIVE t AS (SELECT DISTINCT o_custkey AS class_id, o_orderkey AS m, l_suppkey AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT DISTINCT x.class_id, x.m, y.m AS n FROM t x JOIN t y ON y.class_id = x.class_id AND y.a = x.a),
        r AS (SELECT class_id, m, n FROM e UNION SELECT r.class_id, r.m, e.n FROM r JOIN e ON e.class_id = r.class_id AND e.m = r.n) SELECT class_id, count(DISTINCT root) AS lcom4 FROM (SELECT class_id, m, min(n) AS root FROM r GROUP BY 1, 2) GROUP BY 1""",
}
