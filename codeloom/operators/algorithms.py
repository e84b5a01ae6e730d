"""Graph algorithms over edge tables (src, dst, weight), ids of any ordered type.

A graph of at most ``SMALL_EDGES`` edges is worked off in memory, where a round of Spark
costs more than the whole search; beyond that, loops keep one table of state and write it
to the shared folder each round, so plans stay short and lost executors cost one round.
Both ways give the same rows: one for each distinct id, and edges with a null end lead nowhere. A search
that ``MAX_ROUNDS`` rounds don't end raises an error. Path algorithms that need a whole graph in memory
(betweenness, depth-first order) say so and check its size first.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import local
from codeloom.operators.components import components
from codeloom.plans.storage import materialize

#: Edges that one task may hold for algorithms without a distributed form.
MAX_LOCAL_EDGES = 2_000_000
#: Nodes for which a table of all pairs is made.
MAX_PAIR_NODES = 5_000
MAX_ROUNDS = 10_000
#: Edges, and starts, up to which a graph is searched in memory.
SMALL_EDGES, SMALL_STARTS = 100_000, 2_000


def _small(edges: DataFrame, *more: str) -> list[tuple] | None:
    """The edges (src, dst and more), or None if there are more than ``SMALL_EDGES``."""
    rows = edges.select("src", "dst", *more).where("src is not null and dst is not null").limit(SMALL_EDGES + 1).collect() if SMALL_EDGES else [None]
    return None if len(rows) > SMALL_EDGES else [tuple(r) for r in rows]


def _starts(starts: DataFrame) -> list | None:
    rows = starts.select("id").distinct().limit(SMALL_STARTS + 1).collect()
    return None if len(rows) > SMALL_STARTS else [r["id"] for r in rows]


def _labelled(nodes: DataFrame, found: dict, name: str, kind: str, default) -> DataFrame:
    """The nodes with what was found for them, or the default."""
    rows = nodes.sparkSession.createDataFrame(list(found.items()), f"node {dict(nodes.dtypes)['id']}, found {kind}").withColumn("known", F.lit(True))
    joined = nodes.select("id").distinct().join(rows, F.col("id") == F.col("node"), "left")
    return joined.select("id", F.when(F.col("known"), F.col("found")).otherwise(default).alias(name))


def _unfinished(what: str) -> RuntimeError:
    return RuntimeError(f"{what} did not end in {MAX_ROUNDS} rounds")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def bfs_levels(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, hops) for each node that ``starts`` (id) reaches along edges."""
    links = edges.select("src", "dst").where("src <> dst").distinct()
    if max_hops is None and (small := _small(links)) is not None and (first := _starts(starts)) is not None:
        return edges.sparkSession.createDataFrame(list(local.levels(small, first).items()), f"id {dict(starts.dtypes)['id']}, hops int")
    frontier = materialize(starts.select("id").distinct().withColumn("hops", F.lit(0)), "bfs")
    seen = frontier
    for hop in range(1, (MAX_ROUNDS if max_hops is None else max_hops) + 1):
        step = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        if max_hops is None:
            raise _unfinished("the search")
    return seen


def reachable(edges: DataFrame, starts: DataFrame, incoming: bool = False) -> DataFrame:
    """Ids that ``starts`` reaches, itself included."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if incoming else edges
    return bfs_levels(e, starts).select("id")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, hops, path) by fewest hops; of equally short paths the smallest."""
    links = edges.select("src", "dst").where("src <> dst").distinct()
    frontier = materialize(starts.select("id").distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("path")), "paths")
    seen = frontier
    for hop in range(1, (MAX_ROUNDS if max_hops is None else max_hops) + 1):
        step = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")).select("id", F.lit(hop).alias("hops"), "path")
        frontier = materialize(step, "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        if max_hops is None:
            raise _unfinished("the search")
    return seen


def bfs_tree(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, hops, parent): the smallest neighbour one hop nearer."""
    levels = materialize(bfs_levels(edges, starts), "levels")
    near = levels.select(F.col("id").alias("src"), (F.col("hops") + 1).alias("hops"))
    parents = edges.select("src", F.col("dst").alias("id")).distinct().join(near, "src").join(levels, ["id", "hops"]).groupBy("id").agg(F.min("src").alias("parent"))
    return levels.join(parents, "id", "left")


def all_paths(edges: DataFrame, source, target, max_hops: int) -> DataFrame:
    """Simple paths of at most ``max_hops`` edges."""
    links = edges.select("src", "dst").where("src <> dst").distinct()
    at = edges.sparkSession.createDataFrame([(source,)], f"id {dict(edges.dtypes)['src']}").select("id", F.array("id").alias("path"))
    found = at.where(F.col("id") == F.lit(target))
    for _ in range(max_hops):
        at = at.where(F.col("id") != F.lit(target)).join(links, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        at = materialize(at.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")), "walks")
        found = found.unionByName(at.where(F.col("id") == F.lit(target)))
        if at.isEmpty():
            break
    return found.select("path")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges in any direction reach."""
    if (small := _small(edges)) is not None:
        return _labelled(nodes, local.components(small), "component", dict(nodes.dtypes)["id"], F.col("id"))
    roots = components(edges, "src", "dst")
    return nodes.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def is_bipartite(edges: DataFrame) -> bool:
    """Whether no component has an odd cycle: no node meets itself in the double cover."""
    pairs = edges.select((F.col("src") * 2).alias("u"), (F.col("dst") * 2 + 1).alias("v")).unionByName(edges.select((F.col("src") * 2 + 1).alias("u"), (F.col("dst") * 2).alias("v")))
    roots = components(pairs, "u", "v").withColumn("own", F.floor(F.col("node") / 2))
    clash = roots.groupBy("own").agg(F.countDistinct("root").alias("n"), F.count(F.lit(1)).alias("sides")).where("sides = 2 and n = 1")
    return clash.isEmpty() and edges.where("src = dst").isEmpty()


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each strongly connected component.

    Rounds of colouring: every node takes the largest id that reaches it; the nodes of a
    colour that reach its owner are a component and leave the graph. Nodes without edges in
    one direction leave first.
    """
    if (small := _small(edges)) is not None:
        return _labelled(nodes, local.strong_components(small), "component", dict(nodes.dtypes)["id"], F.col("id"))
    left = materialize(nodes.select("id").distinct(), "scc")
    links = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    done = None
    for _ in range(MAX_ROUNDS):
        # nodes without a way in or out are components of their own
        while True:
            inner = links.select(F.col("src").alias("id")).intersect(links.select(F.col("dst").alias("id")))
            single = materialize(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")), "scc")
            done = single if done is None else done.unionByName(single)
            left = materialize(inner, "scc")
            before = links.count()
            links = materialize(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc")
            if links.count() == before:
                break
        if left.isEmpty():
            return done
        colour = materialize(left.select("id", F.col("id").alias("c")), "scc")
        while True:
            spread = links.join(colour, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "c")
            wider = materialize(colour.unionByName(spread).groupBy("id").agg(F.max("c").alias("c")), "scc")
            changed = not wider.join(colour, ["id", "c"], "left_anti").isEmpty()
            colour = wider
            if not changed:
                break
        # backwards from each owner within its colour
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = materialize(links.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        owners = colour.where("id = c").select("id")
        back = materialize(bfs_levels(inside, owners).select("id").join(colour, "id"), "scc")
        low = back.groupBy("c").agg(F.min("id").alias("component"))
        done = done.unionByName(back.join(low, "c").select("id", "component"))
        left = materialize(left.join(back.select("id"), "id", "left_anti"), "scc")
        links = materialize(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc")
    raise RuntimeError("strong components did not settle")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest distance from a node without incoming edges; nodes on or behind a cycle have none."""
    if (small := _small(edges)) is not None:
        return _labelled(nodes, local.topological_levels(small), "level", "int", F.lit(0))
    links = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "topo")
    left = materialize(nodes.select("id").distinct(), "topo")
    out = None
    for level in range(MAX_ROUNDS):
        ready = materialize(left.join(links.select(F.col("dst").alias("id")), "id", "left_anti"), "topo")
        if ready.isEmpty():
            break
        out = ready.withColumn("level", F.lit(level)) if out is None else out.unionByName(ready.withColumn("level", F.lit(level)))
        left = materialize(left.join(ready, "id", "left_anti"), "topo")
        links = materialize(links.join(ready.withColumnRenamed("id", "src"), "src", "left_anti"), "topo")
    else:
        raise _unfinished("levels")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    return topological_levels(nodes, edges).where("level is null").isEmpty()


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, origin, dist) from each start over non-negative weights, by relaxation of whatever improved last."""
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    if (small := _small(edges, "weight")) is not None and (first := _starts(starts)) is not None:
        kind = dict(starts.dtypes)["id"]
        return edges.sparkSession.createDataFrame(local.distances(small, first), f"id {kind}, origin {kind}, dist double")
    links = materialize(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")), "dist")
    best = materialize(starts.select("id", F.col("id").alias("origin"), F.lit(0.0).alias("dist")).distinct(), "dist")
    moved = best
    for _ in range(MAX_ROUNDS):
        step = moved.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "origin", (F.col("dist") + F.col("weight")).alias("dist"))
        step = step.groupBy("id", "origin").agg(F.min("dist").alias("dist"))
        old = best.withColumnRenamed("dist", "old")
        moved = materialize(step.join(old, ["id", "origin"], "left").where("old is null or dist < old").select("id", "origin", "dist"), "dist")
        if moved.isEmpty():
            return best
        best = materialize(best.unionByName(moved).groupBy("id", "origin").agg(F.min("dist").alias("dist")), "dist")
    raise RuntimeError("distances did not settle")


def all_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, dist) of all pairs, null where there is no path; for graphs of a checked size."""
    if nodes.count() > MAX_PAIR_NODES:
        raise ValueError(f"all pairs are made of at most {MAX_PAIR_NODES} nodes")
    ids = nodes.select("id").distinct()
    found = distances(edges, ids).select(F.col("origin").alias("src"), F.col("id").alias("dst"), "dist")
    # the checked bound makes this product small; it is the operator's own output
    grid = ids.select(F.col("id").alias("src"), F.lit(1).alias("k")).join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("k")), "k").drop("k")
    return grid.join(found, ["src", "dst"], "left")


def closeness(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """(id, closeness) over outgoing distances: reached / total, or 1 / total; zero distances don't count."""
    ids = nodes.select("id").distinct()
    sums = distances(edges, ids).where("dist > 0").groupBy(F.col("origin").alias("id")).agg(F.sum("dist").alias("total"), F.count(F.lit(1)).alias("n"))
    value = F.col("n") / F.col("total") if normalized else 1 / F.col("total")
    return ids.join(sums, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def _local_edges(edges: DataFrame) -> list[tuple]:
    rows = edges.select("src", "dst").distinct().limit(MAX_LOCAL_EDGES + 1).collect()
    if len(rows) > MAX_LOCAL_EDGES:
        raise ValueError(f"this algorithm holds at most {MAX_LOCAL_EDGES} edges in a task")
    return [(r["src"], r["dst"]) for r in rows]


def betweenness(nodes: DataFrame, edges: DataFrame, directed: bool = True, normalized: bool = True) -> DataFrame:
    """(id, betweenness) by counting shortest hop paths from each source, sources spread over the tasks.

    Each task holds the adjacency of a graph of a checked size. Normalisation multiplies
    by 2 / ((n - 1)(n - 2)) in either case.
    """
    spark = nodes.sparkSession
    pairs = _local_edges(edges if directed else both_ways(edges))
    adjacency = defaultdict(list)
    for a, b in sorted(pairs):
        if a != b:
            adjacency[a].append(b)
    held = spark.sparkContext.broadcast(dict(adjacency))

    def run(batches):
        near = held.value
        total: dict = defaultdict(float)
        for pdf in batches:
            for s in pdf["id"].tolist():
                order, before, count, depth = [], defaultdict(list), defaultdict(float), {s: 0}
                count[s] = 1.0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in near.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            count[w] += count[v]
                            before[w].append(v)
                share: dict = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += count[v] / count[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    ids = nodes.select("id").distinct()
    kind = dict(ids.dtypes)["id"]
    parts = ids.repartition("id").mapInPandas(run, f"id {kind}, part double").groupBy("id").agg(F.sum("part").alias("b"))
    n = ids.count()
    factor = 2.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    return ids.join(parts, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * factor).alias("betweenness"))


def depth_first(edges: DataFrame, start) -> list[tuple]:
    """(id, parent) in depth-first preorder, neighbours in ascending order; for graphs of a checked size."""
    near = defaultdict(list)
    for a, b in sorted(_local_edges(edges), reverse=True):
        near[a].append(b)
    seen, out, stack = set(), [], [(start, None)]
    while stack:
        v, parent = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        out.append((v, parent))
        stack += [(w, v) for w in near[v] if w not in seen]
    return out


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and largest degree, density."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("d")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("d")))
    degrees = nodes.select("id").distinct().withColumn("d", F.lit(0)).unionByName(ends).groupBy("id").agg(F.sum("d").alias("d"))
    both = degrees.agg(F.count(F.lit(1)).alias("nodes"), (F.coalesce(F.sum("d"), F.lit(0)) / 2).cast("long").alias("edges"), F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_degree"))
    spread = F.col("nodes") * (F.col("nodes") - 1)
    return both.select(
        "nodes", "edges", "max_degree",
        F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("mean_degree"),
        F.when(spread > 0, F.col("edges") / spread).otherwise(0.0).alias("density"),
    )


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, members) of each component of several nodes."""
    found = strong_components(nodes, edges)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    return size.where("size > 1")
