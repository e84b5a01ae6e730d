"""Entry points for programs: a project analysis and graphs as objects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import config
from codeloom.operators import algorithms, flow, graph, patterns, search, validation
from codeloom.sources import extract, files


@dataclass
class Analysis:
    """A project's tables; each is evaluated when it is used."""

    texts: DataFrame
    skipped: DataFrame

    @cached_property
    def symbols(self) -> DataFrame:
        return extract.symbols(self.texts)

    @cached_property
    def dependencies(self) -> DataFrame:
        return extract.dependencies(self.texts)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.build_edges(self.dependencies)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.fan_metrics(graph.build_nodes(self.symbols, self.dependencies), self.edges)

    def summary(self) -> DataFrame:
        """One row: files, symbols, dependencies, skipped files."""
        counts = [(k, df.agg(F.count(F.lit(1)).alias("n"))) for k, df in (("files", self.texts), ("symbols", self.symbols), ("dependencies", self.dependencies), ("skipped", self.skipped))]
        rows = None
        for k, df in counts:
            row = df.select(F.lit(k).alias("what"), "n")
            rows = row if rows is None else rows.unionByName(row)
        return rows

    def find_symbols(self, pattern: str) -> DataFrame:
        return search.find_symbols(self.nodes, pattern)

    def by_kind(self, kind: str) -> DataFrame:
        return search.by_kind(self.nodes, kind)

    def in_file(self, path: str) -> DataFrame:
        return search.in_file(self.nodes, path)

    def find_dependencies(self, part: str) -> DataFrame:
        return search.dependencies_like(self.dependencies, part)

    def dependents_of(self, qualified_name: str) -> DataFrame:
        return search.dependents(self.edges, graph.node_id(F.lit(qualified_name))).withColumnRenamed("kind", "relationship").join(self.nodes, "id")

    def dependencies_of(self, qualified_name: str) -> DataFrame:
        return search.dependencies(self.edges, graph.node_id(F.lit(qualified_name))).withColumnRenamed("kind", "relationship").join(self.nodes, "id")

    def complex_symbols(self, limit: int) -> DataFrame:
        return search.top(self.nodes, "complexity", limit, "qualified_name")

    def issues(self, preset: str = "default") -> DataFrame:
        t = search.thresholds(preset)
        return search.issues(self.nodes, t["complexity"], t["fan_out"])

    def patterns(self) -> DataFrame:
        return patterns.detect(self.nodes, self.edges)

    def validate(self) -> DataFrame:
        return validation.validate(self.nodes, self.edges)

    def health(self) -> DataFrame:
        return validation.health(self.validate())

    def calls(self) -> DataFrame:
        return flow.call_analysis(self.nodes.select("id", "qualified_name", "file_path"), self.edges)

    def imports(self) -> DataFrame:
        return flow.import_analysis(self.nodes.select("id", "qualified_name", "file_path", "is_external"), self.edges)


def analyze(spark: SparkSession, root: str, settings: dict | None = None) -> Analysis:
    """Scan a source tree and hold its tables."""
    a = (settings or config.load())["analysis"]
    found = files.scan(spark, root, a["languages"], files.validate_ignores(a["ignore"]), a["max_files"])
    texts, skipped = files.read_texts(found, a["max_file_bytes"])
    return Analysis(texts.select("path", "content", "language"), skipped)


class Graph:
    """An undirected weighted graph: tables of nodes (id, data) and edges (src, dst, weight)."""

    directed = False

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def of(cls, spark: SparkSession, nodes=(), edges=()):
        return cls(spark.createDataFrame(list(nodes), "id long, data string"), spark.createDataFrame(list(edges), "src long, dst long, weight double"))

    def _ways(self) -> DataFrame:
        return self.edges if self.directed else algorithms.both_ways(self.edges)

    def add_nodes(self, rows):
        return type(self)(self.nodes.unionByName(self.nodes.sparkSession.createDataFrame(list(rows), "id long, data string")), self.edges)

    def add_edges(self, rows):
        """Edges whose ends exist; others are left out."""
        new = self.nodes.sparkSession.createDataFrame(list(rows), "src long, dst long, weight double")
        ids = self.nodes.select("id")
        new = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return type(self)(self.nodes, self.edges.unionByName(new.select("src", "dst", "weight")))

    def remove_node(self, node: int):
        return type(self)(self.nodes.where(F.col("id") != node), self.edges.where((F.col("src") != node) & (F.col("dst") != node)))

    def remove_edge(self, a: int, b: int):
        hit = (F.col("src") == a) & (F.col("dst") == b)
        return type(self)(self.nodes, self.edges.where(~(hit if self.directed else hit | ((F.col("src") == b) & (F.col("dst") == a)))))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def has_edge(self, a: int, b: int) -> bool:
        return not self._ways().where((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def neighbors(self, node: int) -> DataFrame:
        return self._ways().where(F.col("src") == node).select(F.col("dst").alias("id"), "weight")

    successors = neighbors

    def predecessors(self, node: int) -> DataFrame:
        return self._ways().where(F.col("dst") == node).select(F.col("src").alias("id"), "weight")

    def degrees(self) -> DataFrame:
        return graph.fan_metrics(self.nodes, self.edges)

    def distances(self, source: int) -> DataFrame:
        return algorithms.distances(self._ways(), self.nodes.where(F.col("id") == source).select("id"))

    def all_pairs(self) -> DataFrame:
        return algorithms.all_pairs(self.nodes, self._ways())

    def betweenness(self, normalized: bool = True) -> DataFrame:
        return algorithms.betweenness(self.nodes, self.edges, self.directed, normalized)

    def closeness(self, normalized: bool = True) -> DataFrame:
        return algorithms.closeness(self.nodes, self._ways(), normalized)

    def components(self) -> DataFrame:
        return algorithms.weak_components(self.nodes, self.edges)

    def is_bipartite(self) -> bool:
        return algorithms.is_bipartite(self.edges)

    def bfs_tree(self, start: int) -> DataFrame:
        return algorithms.bfs_tree(self._ways(), self.nodes.where(F.col("id") == start).select("id"))

    def dfs_tree(self, start: int) -> list[tuple]:
        return algorithms.depth_first(self._ways(), start)

    def stats(self) -> DataFrame:
        return algorithms.graph_stats(self.nodes, self.edges)


class DiGraph(Graph):
    """A directed weighted graph."""

    directed = True

    def strong_components(self) -> DataFrame:
        return algorithms.strong_components(self.nodes, self.edges)

    def is_acyclic(self) -> bool:
        return algorithms.is_acyclic(self.nodes, self.edges)

    def topological_order(self) -> DataFrame:
        """(id, level) ordered; no rows if there is a cycle."""
        levels = algorithms.topological_levels(self.nodes, self.edges)
        return levels.limit(0) if not levels.where("level is null").isEmpty() else levels.orderBy("level", "id")
