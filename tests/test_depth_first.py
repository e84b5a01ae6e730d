from codeloom.plans import registry


def test_depth_first_reaches_customers_and_suppliers(spark, sf):
    """The same nodes as the breadth-first query, each after its parent."""
    got = sorted(registry.QUERIES["depth_first"](spark, sf).collect())
    assert {r["id"] for r in got} == {r["id"] for r in registry.QUERIES["bfs_levels"](spark, sf).collect()}
    assert {r["id"] // 10**9 for r in got} == {0, 1, 2, 3}
    seen = set()
    for r in got:
        assert r["parent"] in seen or r["id"] == 0 and r["parent"] is None
        seen.add(r["id"])
