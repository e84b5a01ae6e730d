from codeloom import model
from codeloom.operators import resolve


def test_resolve(spark):
    def row(name, scope, file, kind="Function", language="python", mods=()):
        return (name, "::".join([*scope, name]), kind, language, file, 0, 0, 0, 0, [(s, "Class") for s in scope], list(mods), None, None)

    symbols = spark.createDataFrame([row("f", [], "a.py"), row("f", [], "b.py"), row("f", ["A"], "a.py"), row("_g", [], "b.py"), row("h", [], "c.rs", language="rust")], model.SYMBOLS)
    refs = spark.createDataFrame([("f", "a.py", ["A", "m"]), ("f", "z.py", []), ("_g", "a.py", []), ("h", "a.py", []), ("none", "a.py", [])], "name string, file_path string, scope array<string>")
    found = {(r["name"], r["file_path"], r["qualified_name"], r["def_file"]): r["relevance"] for r in resolve.resolve(refs, symbols).collect()}
    assert found["f", "a.py", "A::f", "a.py"] == 100 + 50 + 25 + 20 * 0.5
    assert found["f", "a.py", "f", "b.py"] == 75 and found["_g", "a.py", "_g", "b.py"] == 50 and found["h", "a.py", "h", "c.rs"] == 0
    best = {(r["name"], r["file_path"]): (r["qualified_name"], r["def_file"]) for r in resolve.resolve(refs, symbols, best=True).collect()}
    assert best["f", "a.py"] == ("A::f", "a.py") and ("none", "a.py") not in best
    edges = spark.createDataFrame([("z.py", "b.py")], "src_file string, dst_file string")
    best = {(r["name"], r["file_path"]): r["def_file"] for r in resolve.resolve(refs, symbols, edges, best=True).collect()}
    assert best["f", "z.py"] == "b.py"
    assert {(r["src_file"], r["dst_file"]) for r in resolve.file_dependencies(resolve.resolve(refs, symbols, edges, best=True)).collect()} >= {("z.py", "b.py"), ("a.py", "b.py")}
