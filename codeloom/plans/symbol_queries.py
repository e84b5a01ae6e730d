"""Search, filters, paging, statistics, merging and exports over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import exports, graph, search, validation
from codeloom.plans.base import n, part_symbols, query, supplies, table

COLS = "p_partkey AS id, p_name AS name, p_brand AS file_path, p_type AS kind, p_size AS complexity"


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "file_path", "kind", "complexity")


@query("find_symbols_ci", f"SELECT {COLS} FROM part WHERE contains(lower(p_name), 'red') ")
def find_symbols_ci(spark, d):
    return _out(part_symbols(spark, d).where(F.contains(F.lower("name"), F.lit("RED".lower()))))


@query("find_symbols_distinct_names", "SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'wid')")
def find_symbols_distinct_names(spark, d):
    return search.find_symbols(part_symbols(spark, d).select("name"), "WID", "name")


@query("symbols_by_kind", f"SELECT {COLS} FROM part WHERE lower(p_type) = 'promo'")
def symbols_by_kind(spark, d):
    return _out(search.by_kind(part_symbols(spark, d), "Promo"))


@query("symbols_in_file", f"SELECT {COLS} FROM part WHERE p_brand = 'Brand#7'")
def symbols_in_file(spark, d):
    return _out(search.in_file(part_symbols(spark, d), "Brand#7"))


@query("complex_symbols_topk", f"SELECT {COLS} FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def complex_symbols_topk(spark, d):
    return _out(search.top(part_symbols(spark, d), "complexity", 25, "id"))


@query("complex_files", "SELECT p_brand AS file_path, CAST(sum(p_size) AS BIGINT) AS score FROM part GROUP BY 1 HAVING sum(p_size) >= 2000")
def complex_files(spark, d):
    return part_symbols(spark, d).groupBy("file_path").agg(F.sum("complexity").alias("score")).where("score >= 2000")


@query(
    "filter_engine_all",
    f"""SELECT {COLS} FROM part WHERE (contains(p_name, 'ring') OR (starts_with(p_name, 'blue') AND ends_with(p_name, 't')))
    AND p_type IN ('SMALL', 'PROMO', 'ECONOMY') AND p_size BETWEEN 5 AND 40
    AND NOT (contains(p_brand, '#2') OR p_type IN ('ECONOMY') AND false OR contains(lower(p_name), 'test') OR contains(lower(p_brand), 'test') OR contains(lower(p_brand), 'spec'))""",
)
def filter_engine_all(spark, d):
    f = search.Filter(names=["ring", "blue*t"], kinds=["SMALL", "PROMO", "ECONOMY"], complexity=(5, 40), exclude=search.Exclude(files=["#2"], tests=True))
    return _out(search.apply_filter(part_symbols(spark, d), f))


@query("glob_match", f"SELECT {COLS} FROM part WHERE starts_with(p_name, 'b') AND ends_with(p_name, 'g')")
def glob_match(spark, d):
    return _out(part_symbols(spark, d).where(text.one_star_match(F.col("name"), "b*g")))


@query("paginate_sorted", f"SELECT {COLS}, row_number FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS row_number FROM part) WHERE row_number BETWEEN 41 AND 60")
def paginate_sorted(spark, d):
    page = search.paginate(part_symbols(spark, d), 2, 20, [("complexity", True), ("name", False), ("id", False)])
    return page.select("id", "name", "file_path", "kind", "complexity", "row_number")


@query(
    "page_stats",
    """WITH b AS (SELECT p_type AS kind, p_brand AS file, CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'medium' WHEN p_size <= 20 THEN 'high' ELSE 'very_high' END AS bucket FROM part)
    SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM b GROUP BY kind UNION ALL SELECT 'file', file, count(*) FROM b GROUP BY file UNION ALL SELECT 'bucket', bucket, count(*) FROM b GROUP BY bucket""",
)
def page_stats(spark, d):
    return search.histograms(part_symbols(spark, d), kind=F.col("kind"), file=F.col("file_path"), bucket=text.bucket(F.col("complexity")))


@query("analysis_metrics", "SELECT count(*) AS symbols, CAST(sum(p_size) AS BIGINT) AS total_complexity, CAST(max(p_size) AS BIGINT) AS max_complexity, round(avg(p_size), 6) AS mean_complexity, CAST(count(*) FILTER (WHERE p_type = 'PROMO') AS BIGINT) AS documented FROM part")
def analysis_metrics(spark, d):
    p = part_symbols(spark, d).withColumn("documentation", F.when(F.col("kind") == "PROMO", F.col("name")))
    return search.analysis_metrics(p).withColumn("mean_complexity", F.round("mean_complexity", 6)).withColumn("max_complexity", F.col("max_complexity").cast("long"))


@query("complexity_hist", "SELECT p_type AS kind, CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'medium' WHEN p_size <= 20 THEN 'high' ELSE 'very_high' END AS bucket, count(*) AS n FROM part GROUP BY 1, 2")
def complexity_hist(spark, d):
    return part_symbols(spark, d).groupBy("kind", text.bucket(F.col("complexity")).alias("bucket")).agg(n().alias("n"))


@query("file_info", "SELECT p_brand AS file_path, count(*) AS symbols, round(avg(p_size), 6) AS mean_complexity FROM part GROUP BY 1")
def file_info(spark, d):
    return part_symbols(spark, d).groupBy("file_path").agg(n().alias("symbols"), F.round(F.avg("complexity"), 6).alias("mean_complexity"))


@query("top_files_share", "SELECT p_brand AS file_path, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM part GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10")
def top_files_share(spark, d):
    sums = part_symbols(spark, d).groupBy("file_path").agg(n().alias("n"))
    # one row per file, summed in one task after the aggregation
    share = sums.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))
    return search.top(share, "n", 10, "file_path")


@query(
    "nearest_rank_percentile",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
    SELECT event_type, p AS percent, value FROM r, (VALUES (50.0::DOUBLE), (90.0), (99.0)) t(p) WHERE r = floor(p / 100 * (c - 1)) + 1""",
)
def nearest_rank_percentile(spark, d):
    return search.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [50, 90, 99])


@query("sliding_hist", "SELECT user_id, event_id, round(avg(value) OVER w, 6) AS average, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_hist(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("average"), F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


@query("find_dependents", "SELECT l_suppkey AS id, count(*) AS edges FROM lineitem WHERE l_partkey = 42 GROUP BY 1")
def find_dependents(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("Uses").alias("kind"))
    return search.dependents(edges, 42).groupBy("id").agg(n().alias("edges"))


@query("find_dependencies", "SELECT l_partkey AS id, 'Uses' AS kind FROM lineitem WHERE l_suppkey = 7")
def find_dependencies(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("Uses").alias("kind"))
    return search.dependencies(edges, 7)


@query("dependency_lines", "SELECT n_name || ' -> ' || r_name || ' (DefinedIn) @ nation:' || CAST(n_nationkey AS VARCHAR) AS line FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'A') OR contains(r_name, 'A')")
def dependency_lines(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    deps = rows.select(F.col("n_name").alias("from_symbol"), F.col("r_name").alias("to_symbol"), F.lit("DefinedIn").alias("relationship_type"), F.lit("nation").alias("file_path"), F.col("n_nationkey").cast("long").alias("start_line"))
    return search.dependencies_like(deps, "A")


@query("related_files", "SELECT DISTINCT p_brand AS file_path FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3 AND p_brand <> 'Brand#1'")
def related_files(spark, d):
    edges = supplies(spark, d).where("src = 3")
    return edges.join(part_symbols(spark, d), F.col("dst") == F.col("id")).where("file_path <> 'Brand#1'").select("file_path").distinct()


@query("cross_file_edges", "SELECT c_mktsegment AS src_file, o_orderpriority AS dst_file, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> o_orderpriority GROUP BY 1, 2")
def cross_file_edges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("file_path"))
    o = table(spark, d, "orders").select((-1 - F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("file_path"))
    nodes = c.unionByName(o).withColumn("is_external", F.lit(False))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"))
    return graph.cross_file(nodes, edges).groupBy("src_file", "dst_file").agg(n().alias("n"))


@query("architectural_issues", "SELECT p_partkey AS id, 'high complexity: ' || p_size AS issue FROM part WHERE p_size > 45 UNION ALL SELECT l_partkey, 'many dependencies: ' || count(DISTINCT l_suppkey) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 30")
def architectural_issues(spark, d):
    fan = supplies(spark, d).groupBy(F.col("dst").alias("id")).agg(n().alias("fan_out"))
    return search.issues(part_symbols(spark, d).join(fan, "id", "left"), 45, 30)


MERGE_SQL = """WITH x AS (SELECT c_custkey AS k, c_nationkey AS name, c_acctbal > 0 AS kind, c_acctbal > 8000 AS ext FROM customer), y AS (SELECT s_suppkey AS k, s_nationkey AS name, s_acctbal > 0 AS kind, s_acctbal > 5000 AS ext FROM supplier)
SELECT coalesce(x.k, y.k) AS k, CASE WHEN y.k IS NULL THEN 'left_only' WHEN x.k IS NULL THEN 'right_only' WHEN x.kind = y.kind AND x.name = y.name THEN 'keep_existing'
WHEN x.ext THEN 'use_other' WHEN y.ext THEN 'keep_existing' WHEN x.kind <> y.kind THEN 'error' ELSE 'merge' END AS resolution FROM x FULL JOIN y ON x.k = y.k"""


@query("merge_conflicts", MERGE_SQL)
def merge_conflicts(spark, d):
    """All customers merged with all suppliers by their numbers."""

    def side(name, prefix, key, ext):
        rows, null = table(spark, d, name), F.lit(None).cast("string")
        text_of = lambda c: F.col(f"{prefix}_{c}").cast("string")
        return rows.select(text_of(key).alias("qualified_name"), text_of("nationkey").alias("name"), (F.col(f"{prefix}_acctbal") > 0).cast("string").alias("kind"), F.lit("sql").alias("language"), F.lit(name).alias("file_path"), null.alias("signature"), null.alias("documentation"), F.array().cast("array<string>").alias("modifiers"), (F.col(f"{prefix}_acctbal") > ext).alias("is_external"))

    return graph.merge(side("customer", "c", "custkey", 8000), side("supplier", "s", "suppkey", 5000)).select(F.col("qualified_name").cast("long").alias("k"), "resolution")


@query("merge_edges", "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_suppkey, l_partkey FROM lineitem l WHERE l_returnflag <> 'N' AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'N' AND k.l_suppkey = l.l_suppkey AND k.l_partkey = l.l_partkey)")
def merge_edges(spark, d):
    """All order lines that were not returned merged with all others."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    return graph.merge_edges(rows.where("l_returnflag = 'N'").drop("l_returnflag"), rows.where("l_returnflag <> 'N'").drop("l_returnflag"))


@query("validate_orphans", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def validate_orphans(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"))
    return validation.orphans(nodes, edges)


@query("health_score", "SELECT CAST(0 AS BIGINT) AS errors, count(*) AS warnings, round(least(1.0, greatest(0.0, 1.0 - 0.05 * count(*))), 6) AS score FROM (SELECT 1 FROM supplier WHERE s_acctbal < -900)")
def health_score(spark, d):
    w = table(spark, d, "supplier").where("s_acctbal < -900").agg(n().alias("warnings"))
    zero = F.lit(0).cast("long")
    return w.select(zero.alias("errors"), "warnings", F.round(validation.health_score(zero, F.col("warnings"), zero, zero), 6).alias("score"))


@query("dot_edges", """SELECT '  "' || r_name || '" -> "' || n_name || '";' AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dot_edges(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return exports.dot_lines(e, "r_name", "n_name")


@query("mermaid_edges")
def mermaid_edges(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return exports.mermaid_lines(e, "r_name", "n_name")


@query("lsp_symbols", "SELECT p_name AS name, CASE WHEN p_type = 'SMALL' THEN 12 WHEN p_type = 'LARGE' THEN 5 ELSE 13 END AS kind, 'file:///' || p_brand AS uri, CAST(p_size AS BIGINT) AS line FROM part")
def lsp_symbols(spark, d):
    p = part_symbols(spark, d).withColumn("kind", F.when(F.col("kind") == "SMALL", "Function").when(F.col("kind") == "LARGE", "Class").otherwise(F.col("kind")))
    zero = F.lit(0).cast("long")
    p = p.select("*", F.col("complexity").cast("long").alias("start_line"), zero.alias("start_column"), zero.alias("end_line"), zero.alias("end_column"), F.array().cast("array<string>").alias("modifiers"))
    return exports.lsp_symbols(p).select("name", "kind", "uri", F.col("range.start.line").alias("line"))


@query("export_symbols", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type IN ('PROMO') AND contains(p_brand, '#1') ORDER BY p_brand, p_size, p_name, p_partkey LIMIT 500")
def export_symbols(spark, d):
    p = part_symbols(spark, d).withColumn("start_line", F.col("complexity").cast("long"))
    return exports.export_symbols(p, kinds=["PROMO"], file_part="#1", limit=None).orderBy("file_path", "start_line", "name", "id").limit(500).select("id", "name")


@query("symbol_tags", "SELECT p_partkey AS id, 'sql' || CASE WHEN p_size > 25 THEN ',documented' ELSE '' END AS tags FROM part")
def symbol_tags(spark, d):
    p = part_symbols(spark, d).select("id", F.lit("Variable").alias("kind"), F.lit("sql").alias("language"), F.array().cast("array<string>").alias("modifiers"), F.array().cast("array<string>").alias("scope_chain"), F.when(F.col("complexity") > 25, "x").alias("documentation"))
    return exports.tags(p).select("id", F.array_join("tags", ",").alias("tags"))


@query("file_sizes", "SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE printf('%d B', n_chars) END AS size FROM documents")
def file_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.format_file_size(F.col("n_chars")).alias("size"))


@query("quality_by_kind", "SELECT p_type AS kind, round(avg(CASE WHEN p_size > 30 THEN 1.0 WHEN p_size > 10 THEN 0.7 ELSE 0.3 END), 6) AS completeness FROM part GROUP BY 1")
def quality_by_kind(spark, d):
    p = part_symbols(spark, d)
    value = reduce(lambda w, x: w.when(F.col("complexity") > x[0], x[1]), [(10, 0.7)], F.when(F.col("complexity") > 30, 1.0)).otherwise(0.3)
    return p.groupBy("kind").agg(F.round(F.avg(value), 6).alias("completeness"))
