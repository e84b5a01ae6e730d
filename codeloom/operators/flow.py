"""Call, import, data-flow and control-flow analytics over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import algorithms, graph
from codeloom.sources.extract import python

#: What counts as much.
HIGH_FAN_OUT, DEEP, MANY_IMPORTS, POPULAR, HEAVY_FLOW, MANY_SOURCES, COMPLEX_FLOW, MANY_HANDLERS = 10, 5, 15, 10, 5, 3, 10, 2
MAX_COMPLEXITY = 100


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()


def in_cycle(pairs: DataFrame) -> DataFrame:
    """(id) of nodes on a real cycle: in a component of several nodes, or with a self loop."""
    found = algorithms.strong_components(_ends(pairs), pairs)
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(several, "component", "left_semi").select("id").unionByName(pairs.where("src = dst").select(F.col("src").alias("id"))).distinct()


def depth(pairs: DataFrame) -> DataFrame:
    """(id, depth): nodes on the longest way down from each; a cycle counts as one step."""
    nodes = _ends(pairs)
    found = algorithms.strong_components(nodes, pairs)
    a, b = found.select(F.col("id").alias("src"), F.col("component").alias("ca")), found.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    up = pairs.join(a, "src").join(b, "dst").where("ca <> cb").select(F.col("cb").alias("src"), F.col("ca").alias("dst")).distinct()
    levels = algorithms.topological_levels(found.select(F.col("component").alias("id")).distinct(), up)
    return found.join(levels.select(F.col("id").alias("component"), "level"), "component").select("id", (F.col("level") + 1).alias("depth"))


def _analysis(nodes: DataFrame, pairs: DataFrame, into: str, out: str) -> DataFrame:
    own = _ends(pairs)
    i = pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias(into))
    o = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias(out))
    cyclic = in_cycle(pairs).withColumn("cyclic", F.lit(True))
    rows = own.join(nodes, "id").join(i, "id", "left").join(o, "id", "left").join(cyclic, "id", "left").join(depth(pairs), "id", "left")
    return rows.fillna(0, [into, out]).fillna({"cyclic": False})


def call_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the call graph with callers, calls, recursive flag (cyclic), depth, leaf and entry."""
    rows = _analysis(nodes, graph.edge_set(edges, "Calls"), "callers", "calls")
    return rows.withColumn("leaf", F.col("calls") == 0).withColumn("entry", F.col("callers") == 0)


def call_patterns(analysis: DataFrame) -> DataFrame:
    """One row of counts: functions, recursive, leaves, entries, those that call many, deep ones."""
    n = lambda c: F.count(F.when(c, 1))
    return analysis.agg(
        F.count(F.lit(1)).alias("functions"), n(F.col("cyclic")).alias("recursive"), n(F.col("leaf")).alias("leaves"), n(F.col("entry")).alias("entries"),
        n(F.col("calls") > HIGH_FAN_OUT).alias("high_fan_out"), n(F.col("depth") > DEEP).alias("deep"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def import_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the import graph with imports, imported_by, circular flag (cyclic), depth and what is much."""
    rows = _analysis(nodes, graph.edge_set(edges, "Imports"), "imported_by", "imports")
    return rows.withColumn("heavy", F.col("imports") > MANY_IMPORTS).withColumn("popular", F.col("imported_by") > POPULAR)


def chain(edges: DataFrame, kind: str, source, target) -> DataFrame:
    """The shortest path (array of ids) along edges of a kind, if there is one."""
    pairs = graph.edge_set(edges, kind)
    start = pairs.sparkSession.createDataFrame([(source,)], f"id {dict(pairs.dtypes)['src']}")
    return algorithms.shortest_paths(pairs, start).where(F.col("id") == target).select("path")


def data_flow_metrics(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """Incoming and outgoing flows, cycle flag, and hops from the nearest node without incoming flow (0 if none reaches it)."""
    pairs = graph.edge_set(edges, *kinds)
    sources = pairs.select(F.col("src").alias("id")).distinct().join(pairs.select(F.col("dst").alias("id")), "id", "left_anti")
    hops = algorithms.bfs_levels(pairs, sources).select("id", F.col("hops").alias("from_source"))
    rows = _analysis(nodes, pairs, "incoming", "outgoing").drop("depth").join(hops, "id", "left").fillna(0, ["from_source"])
    return rows.withColumn("heavy", F.col("incoming") + F.col("outgoing") > HEAVY_FLOW).withColumn("many_sources", F.col("incoming") > MANY_SOURCES)


def control_flow(texts: DataFrame) -> DataFrame:
    """(file_path, function, node, kind) of branches, loops, handlers and exits in Python functions."""
    import pyarrow as pa

    names = ["file_path", "function", "node", "kind"]

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for x in python.control_flow(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=names)

    return texts.where("language = 'python'").select("path", "content").mapInArrow(run, ", ".join(f"{n} string" for n in names))


def control_flow_metrics(flow: DataFrame) -> DataFrame:
    """Conditions, loops, handlers, exits and complexity of each function."""
    n = lambda *k: F.count(F.when(F.col("kind").isin(*k), 1))
    rows = flow.groupBy("file_path", "function").agg(n("Conditional").alias("conditions"), n("Loop").alias("loops"), n("Switch").alias("switches"), n("Exception").alias("handlers"), n("Termination").alias("exits"), n("Break", "Continue").alias("jumps"))
    total = F.least(F.lit(MAX_COMPLEXITY), 1 + F.col("conditions") + F.col("loops") + F.col("switches") + F.col("handlers"))
    return rows.withColumn("complexity", total.cast("long")).withColumn("complex", F.col("complexity") > COMPLEX_FLOW).withColumn("many_handlers", F.col("handlers") > MANY_HANDLERS)
