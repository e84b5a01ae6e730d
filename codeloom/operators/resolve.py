"""Name resolution against a registry of symbols, ranked by relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What adds to the relevance of a candidate.
SAME_FILE, PUBLIC, EXPORTED, SCOPE, FILE_DEPENDENCY = 100, 50, 25, 20, 30
#: Visibility by modifier, the first that matches wins, and by language without one.
VISIBILITY = (("public", ("public", "pub", "export", "open")), ("private", ("private", "fileprivate", "private_class")), ("protected", ("protected",)), ("internal", ("internal", "package")))
DEFAULT_VISIBILITY = {"rust": "private", "java": "package", "csharp": "package"}


def visibility(modifiers: Column, language: Column) -> Column:
    out = None
    for name, words in VISIBILITY:
        hit = F.arrays_overlap(modifiers, F.array(*map(F.lit, words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    rest = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_VISIBILITY.items() for x in kv]), language), F.lit("public"))
    return out.otherwise(rest)


def exported(name: Column, kind: Column, modifiers: Column, language: Column, depth: Column) -> Column:
    """By modifier; global functions and classes of scripts; Python names without a leading underscore."""
    script = language.isin("javascript", "typescript") & (depth == 0) & kind.isin("Function", "Class")
    return F.arrays_overlap(modifiers, F.array(F.lit("export"), F.lit("pub"), F.lit("public"))) | script | ((language == "python") & ~F.startswith(name, F.lit("_")))


def scope_similarity(a: Column, b: Column) -> Column:
    """Leading segments in common over the longer of two scope arrays; 0 if both are empty."""
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: (i <= F.least(F.size(a), F.size(b))) & (F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest > 0, shared / longest).otherwise(0.0)


def registry(symbols: DataFrame) -> DataFrame:
    """Symbols under their name and, where it differs, their qualified name."""
    rows = symbols.select(
        "name", "qualified_name", "kind", F.col("file_path").alias("def_file"), F.expr("transform(scope_chain, s -> s.name)").alias("def_scope"),
        visibility(F.col("modifiers"), F.col("language")).alias("visibility"),
        exported(F.col("name"), F.col("kind"), F.col("modifiers"), F.col("language"), F.size("scope_chain")).alias("exported"),
    )
    return rows.withColumn("key", F.explode(F.array_distinct(F.array("name", "qualified_name"))))


def resolve(references: DataFrame, symbols: DataFrame, file_edges: DataFrame | None = None, best: bool = False) -> DataFrame:
    """Candidates of references (name, file_path, scope array) with their relevance; ``best``: the first of each.

    A name is looked up as it is and under each prefix of its scope: an equi-join on keys.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size("scope")), lambda i: F.array_join(F.concat(F.slice(F.col("scope"), F.lit(1), i), F.array("name")), "::"))
    keyed = references.withColumn("key", F.explode(F.array_distinct(prefixes)))
    found = keyed.join(registry(symbols).withColumnRenamed("name", "def_name"), "key").drop("key").distinct()
    linked = F.lit(0)
    if file_edges is not None:
        pairs = file_edges.select(F.col("src_file").alias("file_path"), F.col("dst_file").alias("def_file")).distinct().withColumn("linked", F.lit(1))
        found = found.join(pairs, ["file_path", "def_file"], "left")
        linked = F.coalesce("linked", F.lit(0)) * FILE_DEPENDENCY
    score = (
        F.when(F.col("file_path") == F.col("def_file"), SAME_FILE).otherwise(0) + F.when(F.col("visibility") == "public", PUBLIC).otherwise(0)
        + F.when(F.col("exported"), EXPORTED).otherwise(0) + SCOPE * scope_similarity(F.col("scope"), F.col("def_scope")) + linked
    )
    out = found.withColumn("relevance", score.cast("double")).drop("linked")
    if not best:
        return out
    order = Window.partitionBy("name", "file_path", "scope").orderBy(F.desc("relevance"), "qualified_name", "def_file")
    return out.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def file_dependencies(resolved: DataFrame) -> DataFrame:
    """(src_file, dst_file, n) of references that resolve into another file."""
    return resolved.where("file_path <> def_file").groupBy(F.col("file_path").alias("src_file"), F.col("def_file").alias("dst_file")).agg(F.count(F.lit(1)).alias("n"))
