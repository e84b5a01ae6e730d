import pytest

from codeloom import api, cli, config
from codeloom.operators import flow


def test_settings(tmp_path):
    assert config.deep_merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert config.load(environ={"CODELOOM_ANALYSIS__MAX_FILES": "7"})["analysis"]["max_files"] == 7
    (tmp_path / "c.json").write_text('{"analysis": {"ignore": ["x/**"]}}')
    assert config.load(str(tmp_path / "c.json"), preset="fast")["analysis"]["ignore"] == ["x/**"]
    with pytest.raises(ValueError):
        config.load(analysis={"max_files": -1})
    assert config.duration_ms("2s") == 2000 and config.boolean("Yes") and not config.boolean("off")
    for bad in (lambda: config.duration_ms("5"), lambda: config.boolean("maybe"), lambda: config.url("ftp://x"), lambda: config.url("http://127.0.0.1/"), lambda: config.email("x"), lambda: config.json_value("[" + "1," * 2000 + "1]")):
        with pytest.raises(ValueError):
            bad()
    assert config.url("https://x.example/a") and config.email("a@b.cd") and config.json_value('{"a": [1]}') == {"a": [1]}


def test_project(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n\ndef f(x):\n    if x:\n        return g(x)\n    return f(x)\n\ndef g(y):\n    return os.getcwd()\n")
    (tmp_path / "b.js").write_text("function h() { return k(); }\nfunction k() { return 1; }\n")
    a = api.analyze(spark, str(tmp_path))
    assert {r["what"]: r["n"] for r in a.summary().collect()}["files"] == 2
    assert {r["name"] for r in a.by_kind("function").collect()} == {"f", "g", "h", "k"}
    calls = {r["qualified_name"]: r for r in a.calls().collect()}
    assert calls["f"]["cyclic"] and not calls["g"]["cyclic"] and calls["os.getcwd"]["leaf"] and calls["f"]["depth"] == 3
    assert {r["qualified_name"] for r in a.dependencies_of("f").where("relationship = 'Calls'").collect()} == {"f", "g"}
    assert "f" in {r["qualified_name"] for r in a.dependents_of("g").collect()}
    assert 0 <= a.health().first()["score"] <= 1
    m = {r["function"]: r for r in flow.control_flow_metrics(flow.control_flow(a.texts)).collect()}
    assert m["f"]["conditions"] == 1 and m["f"]["complexity"] == 2 and m["f"]["exits"] == 2
    assert flow.call_patterns(a.calls()).first()["recursive"] == 1
    cli.main(["--format", "json", "symbols", str(tmp_path), "Function"])


def test_graphs(spark):
    g = api.DiGraph.of(spark, [(i, f"n{i}") for i in range(4)], [(0, 1, 1.0), (1, 2, 2.0)])
    assert g.node_count() == 4 and g.has_edge(0, 1) and not g.has_edge(1, 0) and g.is_acyclic()
    g = g.add_edges([(2, 0, 1.0), (9, 0, 1.0)])
    assert g.edge_count() == 3 and not g.is_acyclic() and g.topological_order().count() == 0
    assert {r["id"]: r["dist"] for r in g.distances(0).collect()} == {0: 0.0, 1: 1.0, 2: 3.0}
    assert g.remove_node(1).edge_count() == 1 and g.remove_edge(0, 1).edge_count() == 2
    u = api.Graph.of(spark, [(0, "a"), (1, "b"), (2, "c")], [(0, 1, 1.0), (1, 2, 2.0)])
    assert u.has_edge(1, 0) and {r["id"]: r["dist"] for r in u.distances(2).collect()} == {0: 3.0, 1: 2.0, 2: 0.0}
    assert u.is_bipartite() and u.dfs_tree(0) == [(0, None), (1, 0), (2, 1)]
