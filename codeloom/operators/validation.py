"""Cycles, graph validation and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import algorithms, graph

#: Weight of a relationship in a cycle's impact, and names of core parts.
KIND_WEIGHTS = {"Inherits": 2.0, "Implements": 2.0, "Imports": 1.5, "Calls": 1.0}
OTHER_WEIGHT = 0.5
CORE = ("main", "core", "system", "manager", "controller")


def severity(impact: Column, files: Column, core: Column) -> Column:
    return F.when((impact > 20) | (files > 5) | core, "Critical").when((impact > 10) | (files > 2), "High").when(impact > 5, "Medium").otherwise("Low")


def circular_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, files, impact, severity) of each cycle, from nodes with complexity, fan_in and fan_out."""
    found = algorithms.strong_components(nodes, edges)
    parts = found.join(nodes.select("id", "name", "file_path", "complexity", "fan_in", "fan_out"), "id")
    core = reduce(lambda a, b: a | b, [F.lower("name").contains(w) for w in CORE])
    own = parts.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct("file_path").alias("files"),
        F.sum(0.1 * F.col("complexity") + 0.2 * (F.col("fan_in") + F.col("fan_out"))).alias("base"),
        F.max(core.cast("int")).alias("core"),
    )
    a, b = found.select(F.col("id").alias("src"), F.col("component").alias("ca")), found.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    weight = reduce(lambda w, k: w.when(F.col("kind") == k, KIND_WEIGHTS[k]), KIND_WEIGHTS, F.when(F.lit(False), 0.0)).otherwise(OTHER_WEIGHT)
    inner = edges.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.sum(weight).alias("links"))
    impact = F.col("base") + F.coalesce("links", F.lit(0.0)) + 0.5 * F.col("size")
    rows = own.where("size > 1").join(inner, "component", "left").withColumn("impact", impact)
    return rows.select("component", "size", "files", "impact", severity(F.col("impact"), F.col("files"), F.col("core") == 1).alias("severity"))


def suggestions(size: Column, files: Column) -> Column:
    """What to do about a cycle, as text rows."""
    return F.array_compact(
        F.array(
            F.lit("extract the shared part into a module of its own"),
            F.when(size > 5, "split the cycle into smaller groups"),
            F.when(size == 2, "merge the two or invert one dependency"),
            F.when(files > 1, "depend on an interface across files"),
            F.lit("pass dependencies in instead of importing them"),
        )
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    b = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return a.unionByName(b.select(a.columns)).distinct() if not any(t.startswith("map") for _, t in edges.dtypes) else a.unionByName(b.select(a.columns))


def odd_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose kind doesn't fit their ends."""
    a = nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    b = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    rows = edges.select("src", "dst", "kind").join(a, "src").join(b, "dst")
    return rows.where(
        ((F.col("kind") == "Calls") & ~F.col("src_kind").isin("Function", "Method"))
        | ((F.col("kind") == "Inherits") & ~F.col("src_kind").isin("Class", "Struct", "Trait", "Interface"))
        | ((F.col("kind") == "Imports") & ~F.col("dst_kind").isin("Module", "Namespace", "Class", "Function", "Import", "Variable", "Struct", "Interface", "Trait", "Type", "Enum", "Constant"))
    )


def misplaced(nodes: DataFrame) -> DataFrame:
    """Nodes whose qualified name doesn't start with their scope."""
    scope = F.array_join(F.expr("transform(scope_chain, s -> s.name)"), "::")
    return nodes.where(F.size("scope_chain") > 0).where(~F.startswith("qualified_name", scope))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, level, n) of all checks that found something."""
    named = [
        ("dangling_edge", "error", dangling(nodes, edges)),
        ("odd_relationship", "warning", odd_relationships(nodes, edges)),
        ("orphan", "warning", orphans(nodes, edges)),
        ("misplaced_scope", "warning", misplaced(nodes)),
        ("import_cycle", "error", algorithms.cycles(nodes, graph.edge_set(edges, "Imports"))),
        ("inheritance_cycle", "error", algorithms.cycles(nodes, graph.edge_set(edges, "Inherits", "Implements"))),
        ("call_cycle", "info", algorithms.cycles(nodes, graph.edge_set(edges, "Calls"))),
    ]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("check"), F.lit(level).alias("level"), "n") for c, level, df in named]
    return reduce(DataFrame.unionByName, counts).where("n > 0")


def health(found: DataFrame) -> DataFrame:
    """One row from ``validate``: score in [0, 1] and whether it is at least 0.8."""
    cyclic = F.col("check").endswith("_cycle")
    sums = found.agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (
            ("errors", (F.col("level") == "error") & ~cyclic), ("warnings", (F.col("level") == "warning") & ~cyclic),
            ("critical_cycles", (F.col("level") == "error") & cyclic), ("warning_cycles", (F.col("level") != "error") & cyclic),
        )]
    )
    score = health_score(F.col("errors"), F.col("warnings"), F.col("critical_cycles"), F.col("warning_cycles"))
    return sums.select("*", score.alias("score")).withColumn("healthy", F.col("score") >= 0.8)


def health_score(errors: Column, warnings: Column, critical: Column, cycle_warnings: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - 0.2 * errors - 0.05 * warnings - 0.25 * critical - 0.05 * cycle_warnings))
