import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import docs, text
from codeloom.sources import extract, files
from codeloom.sources.extract import markup, patterns, python


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scan(spark, tmp_path):
    for path, body in {"a/x.py": b"import os\n", "a/y.d.ts": b"x", "a/z.ts": b"let a = 1", "node_modules/q.js": b"1", "b/bad.rs": b"\xff\xfe", "b/n.txt": b"t"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(body)
    found = files.scan(spark, str(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in found.collect()} == {"x.py", "z.ts", "bad.rs"}
    texts, skipped = files.read_texts(found)
    assert texts.count() == 2 and [r["reason"] for r in skipped.collect()] == ["not valid UTF-8"]
    assert files.read_texts(found, max_bytes=9)[1].count() == 2
    assert files.scan(spark, str(tmp_path), languages=["python"], max_files=1).count() == 1
    with pytest.raises(ValueError):
        files.validate_languages(["cobol"])
    with pytest.raises(ValueError):
        files.validate_ignores(["**/*"])


def test_line_counts(spark):
    got = one(spark, files.count_lines(F.lit("/* a\n b */\n\nx = 1 // c\n// d\n"), "go"))
    assert (got["total"], got["blank"], got["comment"], got["code"]) == (5, 1, 3, 1)
    assert one(spark, files.count_lines(F.lit(""), "go"))["total"] == 0
    assert one(spark, files.count_lines(F.lit(None).cast("string"), "python"))["total"] == 0


@pytest.mark.parametrize("signature, simple, nested, depth", [("f()", 0, 0, 1), ("f(a, b)", 2, 2, 1), ("f(a: Map<K, V>, g(x, y))", 4, 2, 2), ("none", 0, 0, 0), (None, 0, 0, 0), ("))((", 0, 0, 2)])
def test_signatures(spark, signature, simple, nested, depth):
    c = F.lit(signature).cast("string")
    row = spark.range(1).select(text.parameters_simple(c).alias("a"), text.parameters_nested(c).alias("b"), text.nesting_depth(c).alias("c")).first()
    assert row["b"] == nested and row["c"] == depth
    if signature is None or "(" not in signature[3:]:
        assert row["a"] == simple


def test_complexity(spark):
    assert one(spark, text.estimate_complexity(F.lit("if a && b { } else { for x in y { } } gift?"))) == 6
    assert one(spark, text.decision_points(F.lit("elif"))) == 2
    assert one(spark, text.function_complexity(F.lit("if"), F.lit(60))) == 4


def test_globs(spark):
    for pattern, path, hit in (("**/build/**", "a/build/c.js", True), ("*.min.js", "x/y.min.js", True), ("src/*.py", "src/a/b.py", False), ("**/a?.rs", "q/ab.rs", True)):
        assert one(spark, files.ignored(F.lit(path), [pattern])) == hit
    assert one(spark, text.one_star_match(F.lit("aba"), "ab*ba")) and not one(spark, text.one_star_match(F.lit("abc"), "x*c"))


def test_documentation(spark):
    a = one(spark, docs.analyze(F.lit("/**\n * Adds two numbers together for the caller.\n * @param a - first\n * @param b\n * @returns {int}\n * @see other\n */"), "jsdoc"))
    assert [p["name"] for p in a["parameters"]] == ["a", "b"] and a["returns"] == "int" and a["references"] == ["other"]
    assert a["issues"] == ["parameter lacks description: b"] and 0 < a["score"] <= 100
    assert one(spark, docs.analyze(F.lit(None).cast("string"), "python"))["issues"] == ["empty documentation"]


def test_python_extraction():
    symbols, found = python.extract("class A(B, metaclass=M):\n    X = 1\n    @staticmethod\n    def f(a: int) -> int:\n        if a:\n            g(a)\n        return a\n")
    assert [(s.name, s.kind) for s in symbols] == [("A", "Class"), ("X", "Constant"), ("f", "Function")]
    assert "staticmethod" in symbols[2].modifiers and symbols[2].signature == "def f(a: int) -> int" and symbols[2].scope == (("A", "Class"),)
    kinds = {(d.source, d.target, d.kind, d.conditional) for d in found}
    assert ("A", "B", "Inherits", False) in kinds and ("A::f", "g", "Calls", True) in kinds and ("A::f", "return_value", "ReturnFlow", False) in kinds
    assert python.extract("def broken(:") == ([], [])
    assert ("f", "if@1", "Conditional") in python.control_flow("def f(a):\n    if a:\n        return 1\n")


@pytest.mark.parametrize("language, source, expected", [
    ("typescript", "export interface A { x: number }\ntype B = string;\nenum C { X }\nclass D extends E { run(a) { go(a); } }", {("A", "Interface"), ("B", "Type"), ("C", "Enum"), ("D", "Class")}),
    ("cpp", "#include <map>\nnamespace n {\nclass A : public B {\n  int x;\n};\nint add(int a) { return a; }\n}", {("map", "Import"), ("n", "Module"), ("A", "Class"), ("x", "Field"), ("add", "Function")}),
    ("csharp", "using System;\nnamespace N {\npublic class A : B {\n  private int x;\n  public void Run(int a) { }\n}\n}", {("System", "Import"), ("N", "Namespace"), ("A", "Class"), ("x", "Field"), ("Run", "Method")}),
    ("php", "<?php\nnamespace App;\nuse Foo\\Bar;\nclass A {\n  private $x;\n  public function run($a) { }\n}\nfunction f($a) { }", {("App", "Namespace"), ("Foo\\Bar", "Import"), ("A", "Class"), ("x", "Field"), ("run", "Method"), ("f", "Function")}),
    ("ruby", "require 'json'\nmodule M\n  class A < B\n    def run(a)\n      go(a)\n    end\n  end\nend\nLIMIT = 3", {("json", "Import"), ("M", "Module"), ("A", "Class"), ("run", "Method"), ("LIMIT", "Constant")}),
    ("swift", "import UIKit\nprotocol P { }\nstruct S: P {\n  let x = 1\n  func run(a: Int) -> Int { return a }\n}", {("UIKit", "Import"), ("P", "Interface"), ("S", "Struct"), ("x", "Constant"), ("run", "Method")}),
    ("scala", "package a.b\nimport c.d\ntrait T\nclass A extends T {\n  def run(x: Int) = x\n  val y = 1\n}", {("a.b", "Namespace"), ("c.d", "Import"), ("T", "Interface"), ("A", "Class"), ("run", "Method"), ("y", "Constant")}),
    ("dart", "import 'a.dart';\nclass A extends B {\n  final int x = 1;\n  int run(int a) { return a; }\n}", {("a.dart", "Import"), ("A", "Class"), ("x", "Field"), ("run", "Method")}),
    ("lua", "local m = require('x')\nlocal function f(a)\n  return a\nend\nfunction m.g() end", {("x", "Import"), ("f", "Function"), ("m.g", "Function")}),
    ("zig", "const std = @import(\"std\");\npub fn main() void { }\nconst P = struct { x: i32 };\nvar n: i32 = 1;", {("std", "Import"), ("main", "Function"), ("P", "Struct"), ("n", "Variable")}),
    ("objc", "#import <A/B.h>\n@interface Foo : Bar\n@property (nonatomic) int x;\n- (void)run;\n@end", {("A/B.h", "Import"), ("Foo", "Class"), ("x", "Field"), ("run", "Method")}),
    ("bash", "source lib.sh\nreadonly A=1\nB=2\nrun() {\n  go\n}", {("lib.sh", "Import"), ("A", "Constant"), ("B", "Variable"), ("run", "Function")}),
])
def test_patterns(language, source, expected):
    assert expected <= {(s.name, s.kind) for s in patterns.extract(source, language)[0]}


def test_scopes_and_edges_of_braces():
    symbols, found = patterns.extract("class A extends B {\n  run(x) {\n    go(x);\n  }\n}\nfunction f() {\n  A.make();\n}\n", "javascript")
    assert {(d.source, d.target, d.kind) for d in found} == {("A", "B", "Inherits"), ("A::run", "go", "Calls"), ("f", "A.make", "Calls")}


def test_markup():
    names = {(s.name, s.kind) for s in markup.html('<div id="a" class="b c"><script src="x.js"></script><p>t</p></div>')}
    assert {("div#a", "Class"), ("#a", "Variable"), (".b", "Class"), (".c", "Class"), ("script[src=x.js]", "Function"), ("p", "Class")} <= names
    assert [(s.name, s.kind) for s in markup.json_paths('{"a": {"b": [1, {"c": "http://x.y/z"}]}}')] == [("a", "Field"), ("a.b", "Field"), ("a.b[1].c", "Field"), ('a.b[1].c="http://x.y/z"', "Constant")]
    assert markup.json_paths("{") == []
    md = markup.markdown("# A\n## B\n[x](u)\n# C\n```py\n1\n```\n")
    assert [(s.name, s.kind, [n for n, _ in s.scope]) for s in md] == [("A", "Module", []), ("B", "Module", ["A"]), ("x", "Import", ["A", "B"]), ("C", "Module", []), ("code_block_py", "Function", ["C"])]
    ys = markup.yaml("a: &x 1\nb:\n  - *x\n  - item\n# a longer comment\n")
    assert {("x", "Constant"), ("x", "Variable"), ("b", "Namespace"), ("item", "Variable")} <= {(s.name, s.kind) for s in ys}
    assert {("r", "Class"), ("version", "Field"), ("ns", "Namespace")} <= {(s.name, s.kind) for s in markup.xml('<r version="1" xmlns:ns="u"><c/></r>')}
    assert {(".a", "Class"), ("--v", "Variable"), ("print", "Namespace")} <= {(s.name, s.kind) for s in markup.css(".a { --v: 1 } @media print { }")}


def test_extraction_table(spark):
    rows = spark.createDataFrame([("a.py", "def f(): pass", "python"), ("b.py", None, "python"), ("c.xx", "x", None), ("d.py", "def (", "python")], "path string, content string, language string")
    assert [(r["qualified_name"], r["kind"]) for r in extract.symbols(rows).collect()] == [("f", "Function")]
    assert extract.symbols(rows.limit(0)).count() == 0
