"""The property graph: nodes and edges from symbols and dependencies, degrees and subgraphs.

Nodes are one row per qualified name, edges keep parallels. Everything is an equi-join or
an aggregation on ids; no step collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import model
from codeloom.functions import text


def node_id(name) -> "F.Column":
    return F.xxhash64(name)


def build_nodes(symbols: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """One node per qualified name, the first definition by file and line; names that are only referred to become external nodes."""
    order = Window.partitionBy("qualified_name").orderBy("file_path", "start_line", "start_column", "kind")
    own = symbols.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    own = own.withColumn("is_external", F.lit(False))
    if dependencies is not None:
        ends = dependencies.select(F.col("from_symbol").alias("qualified_name"), "file_path").unionByName(dependencies.select(F.col("to_symbol").alias("qualified_name"), "file_path"))
        names = ends.groupBy("qualified_name").agg(F.min("file_path").alias("file_path")).join(own.select("qualified_name"), "qualified_name", "left_anti")
        outer = names.select(
            F.col("qualified_name").alias("name"), "qualified_name", F.lit("Variable").alias("kind"), F.lit(None).cast("string").alias("language"), "file_path",
            *[F.lit(0).cast("long").alias(c) for c in ("start_line", "start_column", "end_line", "end_column")],
            F.array().cast(model.SCOPE).alias("scope_chain"), F.array(F.lit("external")).alias("modifiers"),
            F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("documentation"), F.lit(True).alias("is_external"),
        )
        own = own.unionByName(outer)
    lines = F.col("end_line") - F.col("start_line") + 1
    routine = F.col("kind").isin("Function", "Method")
    return own.select(
        node_id(F.col("qualified_name")).alias("id"),
        "*",
        F.when(routine, text.estimate_complexity(F.col("signature"))).when(F.col("kind").isin("Class", "Struct"), 1).otherwise(0).cast("long").alias("complexity"),
        F.when(routine, text.parameters_nested(F.col("signature"))).otherwise(0).cast("long").alias("parameters"),
        F.when(routine, text.nesting_depth(F.col("signature"))).otherwise(0).cast("long").alias("nesting"),
        lines.alias("lines_of_code"),
    )


def build_edges(dependencies: DataFrame, wide: bool = False) -> DataFrame:
    """Edges of kinds with confidence, location and metadata; parallel ones are kept."""
    table = model.KIND_OF_DEPENDENCY_WIDE if wide else model.KIND_OF_DEPENDENCY
    kinds = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return dependencies.select(
        node_id(F.col("from_symbol")).alias("src"),
        node_id(F.col("to_symbol")).alias("dst"),
        F.coalesce(F.try_element_at(kinds, F.col("relationship_type")), F.lit("DependsOn")).alias("kind"),
        F.col("strength").alias("confidence"),
        F.concat_ws(":", "file_path", F.col("start_line").cast("string"), F.col("start_column").cast("string")).alias("source_location"),
        F.create_map(F.lit("type"), F.col("relationship_type"), F.lit("language"), F.col("language"), F.lit("conditional"), F.col("is_conditional").cast("string")).alias("metadata"),
    )


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out, parallel edges counted."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["fan_in", "fan_out"])


def edge_set(edges: DataFrame, *kinds: str) -> DataFrame:
    """Distinct (src, dst) of edges of the kinds."""
    return (edges.where(F.col("kind").isin(*kinds)) if kinds else edges).select("src", "dst").distinct()


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the node ids in ``keep`` (id)."""
    keep = keep.select("id").distinct()
    inside = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(keep, "id", "left_semi"), inside


def callers(edges: DataFrame, target) -> DataFrame:
    return edge_set(edges, "Calls").where(F.col("dst") == target).select(F.col("src").alias("id"))


def callees(edges: DataFrame, source) -> DataFrame:
    return edge_set(edges, "Calls").where(F.col("src") == source).select(F.col("dst").alias("id"))


def importers(edges: DataFrame, target) -> DataFrame:
    return edge_set(edges, "Imports").where(F.col("dst") == target).select(F.col("src").alias("id"))


def imported(edges: DataFrame, source) -> DataFrame:
    return edge_set(edges, "Imports").where(F.col("src") == source).select(F.col("dst").alias("id"))


def cross_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different files, with both files."""
    a = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("src_file"))
    b = nodes.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_file"), F.col("is_external").alias("external"))
    return edges.join(a, "src").join(b, "dst").where("src_file <> dst_file")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two node tables by qualified name, with the resolution of each conflict.

    Equal symbols keep the first; an external side yields to the other; different
    languages rename the second; different kinds are an error; anything else merges
    documentation, signature and modifiers.
    """
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col("a.qualified_name") == F.col("b.qualified_name"), "full_outer")
    same = F.col("a.kind").eqNullSafe(F.col("b.kind")) & F.col("a.language").eqNullSafe(F.col("b.language")) & F.col("a.signature").eqNullSafe(F.col("b.signature")) & F.col("a.name").eqNullSafe(F.col("b.name"))
    how = (
        F.when(F.col("b.qualified_name").isNull(), "left_only")
        .when(F.col("a.qualified_name").isNull(), "right_only")
        .when(same, "keep_existing")
        .when(F.col("a.is_external"), "use_other")
        .when(F.col("b.is_external"), "keep_existing")
        .when(F.col("a.kind") != F.col("b.kind"), "error")
        .when(~F.col("a.language").eqNullSafe(F.col("b.language")), "rename")
        .otherwise("merge")
    )
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    return both.select(
        F.coalesce("a.qualified_name", "b.qualified_name").alias("qualified_name"),
        how.alias("resolution"),
        pick("name"), pick("kind"), pick("language"), pick("file_path"), pick("signature"), pick("documentation"),
        F.array_union(F.coalesce("a.modifiers", F.array().cast("array<string>")), F.coalesce("b.modifiers", F.array().cast("array<string>"))).alias("modifiers"),
        F.when(how == "rename", F.concat(F.col("b.name"), F.lit("_"), F.regexp_replace("b.file_path", r"[/.]", "_"))).alias("renamed"),
    )


def merge_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of the first, and those of the second whose pair the first doesn't have."""
    return left.unionByName(right.join(left.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))
