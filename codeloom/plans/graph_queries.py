"""Graph algorithms over the graphs that the driver's tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import algorithms, graph, search, validation
from codeloom.plans.base import FLOW_SQL, GEO_SQL, TURNS_SQL, event_flow, geography, n, query, supplies, table, turns


@query("top_fanout", "SELECT s_suppkey AS id, s_name AS name, count(DISTINCT l_partkey) AS fan_out FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY fan_out DESC, id LIMIT 20")
def top_fanout(spark, d):
    fan = supplies(spark, d).groupBy("src").agg(n().alias("fan_out"))
    first = search.top(fan, "fan_out", 20, "src")
    return first.join(table(spark, d, "supplier"), F.col("src") == F.col("s_suppkey")).select(F.col("src").alias("id"), F.col("s_name").alias("name"), "fan_out")


@query("fan_metrics", "SELECT p_partkey AS id, coalesce(f, 0) AS fan_in, CAST(0 AS BIGINT) AS fan_out FROM part LEFT JOIN (SELECT l_partkey, count(*) AS f FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def fan_metrics(spark, d):
    edges = table(spark, d, "lineitem").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))
    return graph.fan_metrics(table(spark, d, "part").select(F.col("p_partkey").alias("id")), edges).select("id", "fan_in", "fan_out")


@query("graph_stats", f"WITH e AS ({GEO_SQL}), x AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, max(d) AS max_degree, round(sum(d) / count(*), 8) AS mean_degree, round((sum(d) / 2) / (count(*) * (count(*) - 1.0)), 10) AS density FROM x")
def graph_stats(spark, d):
    return algorithms.graph_stats(*geography(spark, d)).withColumn("mean_degree", F.round("mean_degree", 8)).withColumn("density", F.round("density", 10))


@query("bfs_levels", f"WITH RECURSIVE e AS ({GEO_SQL}), r(id, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN e ON src = id) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def bfs_levels(spark, d):
    return algorithms.bfs_levels(geography(spark, d)[1], spark.range(1))


@query("bfs_tree", f"WITH RECURSIVE e AS ({GEO_SQL}), r(id, hops, parent) AS (SELECT CAST(0 AS BIGINT), 0, CAST(NULL AS BIGINT) UNION SELECT dst, hops + 1, src FROM r JOIN e ON src = id) SELECT id, hops, min(parent) AS parent FROM r GROUP BY 1, 2")
def bfs_tree(spark, d):
    return algorithms.bfs_tree(geography(spark, d)[1], spark.range(1))


@query("reachable_incoming", f"WITH RECURSIVE e AS ({GEO_SQL}), r(id) AS (SELECT CAST(2000000007 AS BIGINT) UNION SELECT src FROM r JOIN e ON dst = id) SELECT id FROM r")
def reachable_incoming(spark, d):
    return algorithms.reachable(geography(spark, d)[1], spark.range(2000000007, 2000000008), incoming=True)


@query("shortest_paths", f"WITH RECURSIVE e AS ({GEO_SQL}), r(id, hops, path) AS (SELECT CAST(1 AS BIGINT), 0, '1' UNION SELECT dst, hops + 1, path || '>' || dst FROM r JOIN e ON src = id) SELECT * FROM r")
def shortest_paths(spark, d):
    found = algorithms.shortest_paths(geography(spark, d)[1], spark.range(1, 2))
    return found.select("id", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("all_paths", f"WITH RECURSIVE e AS ({FLOW_SQL}), r(id, path) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL SELECT CAST(dst AS BIGINT), list_append(path, CAST(dst AS BIGINT)) FROM r JOIN e ON src = id WHERE id <> 4 AND NOT list_contains(path, CAST(dst AS BIGINT)) AND len(path) <= 3) SELECT array_to_string(path, '>') AS path FROM r WHERE id = 4")
def all_paths(spark, d):
    found = algorithms.all_paths(event_flow(spark, d)[1], 0, 4, 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("weak_components", f"SELECT id, min(id) OVER (PARTITION BY conv_id) AS component FROM ({TURNS_SQL})")
def weak_components(spark, d):
    return algorithms.weak_components(*turns(spark, d))


@query("component_sizes", f"SELECT c AS size, count(*) AS n FROM (SELECT conv_id, count(*) AS c FROM ({TURNS_SQL}) GROUP BY 1) GROUP BY 1")
def component_sizes(spark, d):
    return algorithms.weak_components(*turns(spark, d)).groupBy("component").agg(n().alias("size")).groupBy("size").agg(n().alias("n"))


@query("supplier_part_component", "SELECT 'sp' AS graph, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS nodes FROM lineitem")
def supplier_part_component(spark, d):
    e = supplies(spark, d).select((-1 - F.col("src")).alias("src"), "dst")
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return algorithms.weak_components(nodes, e).agg(n().alias("nodes")).select(F.lit("sp").alias("graph"), "nodes")


@query("is_bipartite", "SELECT true AS bipartite")
def is_bipartite(spark, d):
    e = supplies(spark, d).select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    return spark.createDataFrame([(algorithms.is_bipartite(e),)], "bipartite boolean")


@query("topological_levels", f"SELECT id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY id) - 1 AS INTEGER) AS level FROM ({TURNS_SQL})")
def topological_levels(spark, d):
    return algorithms.topological_levels(*turns(spark, d))


@query("is_acyclic", "SELECT true AS acyclic")
def is_acyclic(spark, d):
    return spark.createDataFrame([(algorithms.is_acyclic(*geography(spark, d)),)], "acyclic boolean")


@query("scc_event_types", f"WITH RECURSIVE e AS ({FLOW_SQL}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON src = b) SELECT CAST(x.a AS BIGINT) AS id, CAST(least(x.a, min(y.a)) AS BIGINT) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def scc_event_types(spark, d):
    return algorithms.strong_components(*event_flow(spark, d))


@query("cycles", f"WITH RECURSIVE e AS ({FLOW_SQL}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON src = b) SELECT CAST(c AS BIGINT) AS component, count(*) AS size FROM (SELECT x.a, least(x.a, min(y.a)) AS c FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) GROUP BY c HAVING count(*) > 1")
def cycles(spark, d):
    return algorithms.cycles(*event_flow(spark, d)).select("component", "size")


@query(
    "cycles_severity",
    f"""WITH e AS ({FLOW_SQL}), m AS (SELECT count(*) AS links FROM e WHERE src <> dst)
    SELECT CAST(0 AS BIGINT) AS component, CAST(5 AS BIGINT) AS size, CAST(1 AS BIGINT) AS files, round(0.1 * (0 + 1 + 2 + 3 + 4) + 0.2 * 2 * (SELECT count(*) FROM e) + 1.0 * links + 0.5 * 5, 6) AS impact, 'Critical' AS severity FROM m""",
)
def cycles_severity(spark, d):
    nodes, edges = event_flow(spark, d)
    edges = edges.withColumn("kind", F.lit("Calls"))
    nodes = graph.fan_metrics(nodes.select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.lit("f").alias("file_path"), F.col("id").alias("complexity")), edges)
    return validation.circular_dependencies(nodes, edges).withColumn("impact", F.round("impact", 6))


SSSP = f"e AS ({FLOW_SQL}), r(origin, id, dist, k) AS (SELECT i, i, CAST(0 AS DOUBLE), 0 FROM range(5) t(i) UNION ALL SELECT origin, CAST(dst AS BIGINT), dist + weight, k + 1 FROM r JOIN e ON src = id WHERE k < 4 AND src <> dst)"


@query("sssp_weighted", f"WITH RECURSIVE {SSSP} SELECT id, origin, min(dist) AS dist FROM r WHERE origin = 0 GROUP BY 1, 2")
def sssp_weighted(spark, d):
    return algorithms.distances(event_flow(spark, d)[1], spark.range(1))


@query("all_pairs", f"WITH RECURSIVE {SSSP} SELECT origin AS src, id AS dst, min(dist) AS dist FROM r GROUP BY 1, 2")
def all_pairs(spark, d):
    return algorithms.all_pairs(*event_flow(spark, d))


@query("closeness", f"WITH RECURSIVE {SSSP}, m AS (SELECT origin, id, min(dist) AS dist FROM r GROUP BY 1, 2) SELECT origin AS id, round(count(*) / sum(dist), 10) AS closeness FROM m WHERE dist > 0 GROUP BY 1")
def closeness(spark, d):
    return algorithms.closeness(*event_flow(spark, d)).withColumn("closeness", F.round("closeness", 10))


@query("betweenness")
def betweenness(spark, d):
    nodes, edges = geography(spark, d)
    return algorithms.betweenness(nodes, edges, directed=False).withColumn("betweenness", F.round("betweenness", 10))


@query("depth_first")
def depth_first(spark, d):
    found = algorithms.depth_first(geography(spark, d)[1], 0)
    return spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(found)], "position long, id long, parent long")


@query("call_graph_roles", f"WITH e AS (SELECT DISTINCT src, dst FROM ({GEO_SQL})), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT CASE WHEN o IS NULL THEN 'leaf' WHEN i IS NULL THEN 'entry' ELSE 'inner' END AS role, count(*) AS n FROM v LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id) GROUP BY 1")
def call_graph_roles(spark, d):
    nodes, edges = geography(spark, d)
    fan = graph.fan_metrics(nodes, edges.distinct())
    role = F.when(F.col("fan_out") == 0, "leaf").when(F.col("fan_in") == 0, "entry").otherwise("inner")
    return fan.groupBy(role.alias("role")).agg(n().alias("n"))


@query("data_flow_depth", f"WITH RECURSIVE e AS ({GEO_SQL}), r(id, hops) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, hops + 1 FROM r JOIN e ON src = id) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def data_flow_depth(spark, d):
    edges = geography(spark, d)[1]
    sources = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return algorithms.bfs_levels(edges, sources)


@query("induced_subgraph", f"WITH e AS ({GEO_SQL}) SELECT src, dst FROM e WHERE src < 1000000010 AND dst < 1000000010")
def induced_subgraph(spark, d):
    nodes, edges = geography(spark, d)
    return graph.induced(nodes, edges, nodes.where("id < 1000000010"))[1].select("src", "dst")


@query("page_links", "SELECT dst, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages) GROUP BY 1")
def page_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst")).distinct()
    return links.groupBy("dst").agg(n().alias("n"))
