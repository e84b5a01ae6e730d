"""Design patterns as predicates over symbols, their children and edges.

Children are the symbols whose innermost scope names the parent. Each detector is an
aggregation over the children (or edges) of a candidate followed by a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(column, *words: str) -> Column:
    low = F.lower(column)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _starts(column, *words: str) -> Column:
    low = F.lower(column)
    return reduce(lambda a, b: a | b, [low.startswith(w) for w in words])


def children(nodes: DataFrame) -> DataFrame:
    """Nodes that have a scope, with the qualified name of their parent."""
    scope = F.expr("transform(scope_chain, s -> s.name)")
    return nodes.where(F.size("scope_chain") > 0).withColumn("parent", F.array_join(scope, "::"))


def _with_children(nodes: DataFrame, **counts: Column) -> DataFrame:
    """Nodes with the counts of children that meet each condition."""
    own = children(nodes).groupBy("parent").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])
    return nodes.join(own, F.col("qualified_name") == F.col("parent"), "left").drop("parent").fillna(0, list(counts))


def _static() -> Column:
    return F.exists("modifiers", lambda m: F.lower(m).contains("static"))


def _method() -> Column:
    return F.col("kind").isin("Method", "Function")


def _found(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.select(F.lit(pattern).alias("pattern"), F.col("qualified_name").alias("symbol"))


def factory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names with factory that call a class, and static makers that return an object."""
    classes = nodes.where("kind = 'Class'").select(F.col("id").alias("dst"))
    calling = edges.where("kind = 'Calls'").join(classes, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    named = nodes.where(_has("name", "factory")).join(calling, "id", "left_semi")
    signature = F.coalesce("signature", F.lit(""))
    kind = F.lower(F.trim(F.regexp_extract(signature, r"(?:->|=>|\breturns\b|:(?!:))\s*([^:{]*)", 1)))
    returns = ~kind.isin("", "void", "unit", "none", "()")
    hint = _starts("name", "create", "make", "build", "factory", "instantiate")
    return _found(named.unionByName(nodes.where(_method() & _static() & returns & hint)).dropDuplicates(["id"]), "factory")


def singleton(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes named so, or with a private constructor and a static instance method or field."""
    private = _has("name", "constructor", "__init__", "new") & F.exists("modifiers", lambda m: F.lower(m).contains("private"))
    instance = _has("name", "instance") & _static()
    rows = _with_children(nodes.where("kind in ('Class', 'Struct') or size(scope_chain) > 0"), n_private=private, n_instance=instance & F.col("kind").isin("Method", "Function", "Field"))
    return _found(rows.where((F.col("kind") == "Class") & (_has("name", "singleton") | ((F.col("n_private") > 0) & (F.col("n_instance") > 0)))), "singleton")


def builder(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes whose methods score as a builder's: fluent, configuring and building ones."""
    prefix = _starts("name", "with", "set", "add", "and")
    fluent = F.when(_has(F.coalesce("signature", F.lit("")), "self", "this"), 1).otherwise(0) + F.when(prefix, 1).otherwise(0)
    own = children(nodes).where(_method()).groupBy("parent").agg(
        F.sum(fluent).alias("fluent"),
        F.count(F.when(_starts("name", "with", "set", "add", "enable", "disable", "configure"), 1)).alias("config"),
        F.count(F.when(F.lower("name").isin("build", "create", "construct"), 1)).alias("builds"),
    )
    rows = nodes.where("kind in ('Class', 'Struct')").join(own, F.col("qualified_name") == F.col("parent"), "left").fillna(0, ["fluent", "config", "builds"])
    named = _has("name", "builder")
    score = 2 * F.col("fluent") + F.col("config") + 3 * (F.col("builds") > 0).cast("int") + 2 * (F.col("fluent") >= 2).cast("int") + 2 * named.cast("int") + F.lower("name").endswith("builder").cast("int")
    # what the name alone gives doesn't make a builder
    return _found(rows.where((named & (score - 3 >= 3)) | (~named & (score >= 4) & (F.col("builds") > 0))), "builder")


def abstract_factory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces of factories with several product makers or implementations."""
    product = F.regexp_extract(F.lower("name"), r"^(?:create|make|build|get)_?(\w+)$", 1)
    own = children(nodes).where(_method()).groupBy("parent").agg(F.count_distinct(F.when(product != "", product)).alias("products"))
    implementing = edges.where("kind = 'Implements'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_impl"))
    rows = nodes.where("kind in ('Class', 'Interface', 'Trait')").join(own, F.col("qualified_name") == F.col("parent"), "left").join(implementing, "id", "left").fillna(0, ["products", "n_impl"])
    face = F.col("kind").isin("Interface", "Trait") | F.exists("modifiers", lambda m: F.lower(m).contains("abstract"))
    return _found(rows.where(_has("name", "factory", "creator") & face & ((F.col("products") >= 2) | (F.col("n_impl") >= 2))), "abstract_factory")


def observer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _with_children(nodes, n_notify=_method() & _has("name", "notify", "update", "onchange", "handle"))
    return _found(rows.where(F.col("kind").isin("Class", "Interface") & _has("name", "observer", "listener", "subscriber") & (F.col("n_notify") > 0)), "observer")


def strategy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces named strategy with more than one implementation."""
    several = edges.where("kind = 'Implements'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(nodes.where(F.col("kind").isin("Interface", "Trait") & _has("name", "strategy")).join(several, "id", "left_semi"), "strategy")


def decorator(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Decorators that implement an interface which what they hold implements too."""
    implements = edges.where("kind = 'Implements'").select("src", "dst").distinct()
    holds = edges.where("kind = 'Composition'").select(F.col("src").alias("id"), F.col("dst").alias("held")).distinct()
    mine = implements.select(F.col("src").alias("id"), F.col("dst").alias("face"))
    theirs = implements.select(F.col("src").alias("held"), F.col("dst").alias("face"))
    both = holds.join(theirs, "held").join(mine, ["id", "face"]).select("id").distinct()
    return _found(nodes.where(_has("name", "decorator", "wrapper")).join(both, "id", "left_semi"), "decorator")


def adapter(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.when(F.col("kind") == "Implements", 1)).alias("i"), F.count(F.when(F.col("kind") == "DependsOn", 1)).alias("d")).where("i > 0 and d > 0")
    return _found(nodes.where(_has("name", "adapter", "wrapper")).join(ends, "id", "left_semi"), "adapter")


def mvc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row if names of all three roles exist."""
    seen = nodes.agg(*[F.max(_has("name", w).cast("int")).alias(w) for w in ("controller", "model", "view")])
    return seen.where("controller = 1 and model = 1 and view = 1").select(F.lit("mvc").alias("pattern"), F.lit(None).cast("string").alias("symbol"))


def repository(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repositories with at least two methods of the verbs that data stores have."""
    rows = _with_children(nodes, n_crud=_method() & _has("name", "create", "read", "update", "delete", "find", "save", "get", "remove"))
    return _found(rows.where(F.col("kind").isin("Class", "Interface") & _has("name", "repository") & (F.col("n_crud") >= 2)), "repository")


def dependency_injection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Containers by name, and one row if more than three constructors take several arguments."""
    made = nodes.where(_has("name", "constructor", "__init__") & F.coalesce("signature", F.lit("")).contains(",")).agg(F.count(F.lit(1)).alias("n"))
    whole = made.where("n > 3").select(F.lit("dependency_injection").alias("pattern"), F.lit(None).cast("string").alias("symbol"))
    return whole.unionByName(_found(nodes.where((F.col("kind") == "Class") & _has("name", "container", "injector", "ioc")), "dependency_injection"))


DETECTORS = (factory, singleton, builder, abstract_factory, observer, strategy, decorator, adapter, mvc, repository, dependency_injection)


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, symbol) of all detectors."""
    return reduce(DataFrame.unionByName, [d(nodes, edges) for d in DETECTORS])
