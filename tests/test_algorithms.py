import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import algorithms as A
from codeloom.operators.components import components


def graph(spark, n, edges):
    nodes = spark.range(n).select("id")
    return nodes, spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def closure(n, edges):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b, _ in edges:
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            for j in range(n):
                reach[i][j] = reach[i][j] or (reach[i][k] and reach[k][j])
    return reach


def floyd(n, edges):
    inf = float("inf")
    d = [[0.0 if i == j else inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        if a != b:
            d[a][b] = min(d[a][b], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


CASES = {
    "chain": (3, [(0, 1, 1), (1, 2, 2)]),
    "cycle_and_tail": (5, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 4), (3, 3, 1)]),
    "parallel": (3, [(0, 1, 5), (0, 1, 2), (1, 2, 1), (0, 2, 9)]),
    "random": (9, [(a, b, random.Random(a * 31 + b).randint(1, 9)) for a in range(9) for b in range(9) if random.Random(a * 7 + b * 13).random() < 0.2]),
    "no_edges": (3, []),
}


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("name", CASES)
def test_components_paths_and_order(spark, name, small, monkeypatch):
    monkeypatch.setattr(A, "SMALL_EDGES", small)
    n, edges = CASES[name]
    nodes, e = graph(spark, n, edges)
    reach, dist = closure(n, edges), floyd(n, edges)
    scc = {r["id"]: r["component"] for r in A.strong_components(nodes, e).collect()}
    assert scc == {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}
    both = closure(n, edges + [(b, a, w) for a, b, w in edges])
    assert {r["id"]: r["component"] for r in A.weak_components(nodes, e).collect()} == {i: min(j for j in range(n) if both[i][j]) for i in range(n)}
    assert {r["id"] for r in A.reachable(e, nodes.where("id = 0")).collect()} == {j for j in range(n) if reach[0][j]}
    got = {(r["src"], r["dst"]): r["dist"] for r in A.all_pairs(nodes, e).collect()}
    assert got == {(i, j): dist[i][j] if dist[i][j] < float("inf") else None for i in range(n) for j in range(n)}
    cyclic = any(a == b or reach[b][a] for a, b, _ in edges)
    assert A.is_acyclic(nodes, e) == (not cyclic)
    close = {r["id"]: r["closeness"] for r in A.closeness(nodes, e).collect()}
    for i in range(n):
        far = [d for d in dist[i] if 0 < d < float("inf")]
        assert close[i] == pytest.approx(len(far) / sum(far) if far else 0.0)


def test_betweenness_of_a_path(spark):
    nodes, e = graph(spark, 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    got = {r["id"]: r["betweenness"] for r in A.betweenness(nodes, e, directed=True).collect()}
    assert got == {0: 0.0, 1: pytest.approx(2 * 2 / 6), 2: pytest.approx(2 * 2 / 6), 3: 0.0}


def test_bipartite(spark):
    assert A.is_bipartite(graph(spark, 4, [(0, 1, 1), (2, 3, 1)])[1])
    assert not A.is_bipartite(graph(spark, 6, [(0, 1, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)])[1])


def test_trees_and_paths(spark):
    _, e = graph(spark, 5, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1)])
    assert A.depth_first(e, 0) == [(0, None), (1, 0), (3, 1), (4, 3), (2, 0)]
    assert {(r["id"], r["parent"]) for r in A.bfs_tree(e, spark.range(1)).collect()} == {(0, None), (1, 0), (2, 0), (3, 1), (4, 3)}
    assert sorted(r["path"] for r in A.all_paths(e, 0, 3, 5).collect()) == [[0, 1, 3], [0, 2, 3]]
    assert {r["id"]: r["path"] for r in A.shortest_paths(e, spark.range(1)).collect()}[4] == [0, 1, 3, 4]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[i] for i in range(1000, 1300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        A.distances(graph(spark, 2, [(0, 1, -1)])[1], spark.range(1))


def test_graph_stats_of_nothing(spark):
    row = A.graph_stats(spark.range(0).select("id"), spark.createDataFrame([], "src long, dst long")).first()
    assert row["nodes"] == 0 and row["density"] == 0.0
    assert A.graph_stats(spark.range(2).select("id"), spark.createDataFrame([(0, 1)], "src long, dst long")).select(F.col("mean_degree")).first()[0] == 1.0


def test_bounds_and_awkward_rows_of_both_forms(spark, monkeypatch):
    """A search beyond the bound of rounds raises; repeated ids and edges with a null end are the same in memory and distributed."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(7)] + [(3,), (9,)], "id long")
    holed = chain.unionByName(spark.createDataFrame([(None, 2), (5, None)], "src long, dst long"))
    got = {}
    for small in (100_000, 0):
        monkeypatch.setattr(A, "SMALL_EDGES", small)
        got[small] = [sorted(tuple(r) for r in f.collect()) for f in (A.weak_components(nodes, holed), A.topological_levels(nodes, holed), A.bfs_levels(holed, spark.range(1)))]
    assert got[0] == got[100_000] and got[0][0] == [(i, 0) for i in range(7)] + [(9, 9)]
    monkeypatch.setattr(A, "MAX_ROUNDS", 3)
    for f in (lambda: A.bfs_levels(chain, spark.range(1)), lambda: A.shortest_paths(chain, spark.range(1)), lambda: A.is_acyclic(nodes, chain)):
        with pytest.raises(RuntimeError, match="did not end"):
            f()
