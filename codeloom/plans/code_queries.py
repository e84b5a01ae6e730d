"""Extraction from source texts: small inline projects, and the markup in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import graph, patterns, validation
from codeloom.plans.base import n, query, table
from codeloom.sources import extract, files

#: A small project in several languages, written for these queries.
PROJECT = {
    "app/shop.py": '''"""Shop."""
import os
from decimal import Decimal

LIMIT = 10
rate2 = 0.5


class Basket(object):
    """Holds items."""

    def __init__(self, owner):
        self.owner = owner

    @property
    def total(self) -> Decimal:
        """Sum of prices."""
        out = Decimal(0)
        for item in self.items:
            if item.price > LIMIT:
                out = add(out, item.price)
        return out


def add(a, b):
    return a + b


async def load(path: str):
    try:
        return os.open(path)
    except OSError as e:
        raise e
''',
    "app/core.rs": '''use std::fmt;
pub struct Point { x: i32 }
pub enum Kind { A, B }
trait Shape { fn area(&self) -> f64; }
impl Shape for Point {
    fn area(&self) -> f64 {
        compute(self.x)
    }
}
pub fn compute(x: i32) -> f64 {
    if x > 0 { helper(x) } else { 0.0 }
}
fn helper(x: i32) -> f64 { x as f64 }
''',
    "web/util.js": '''import { join } from "path";
export const LIMIT = 3;
let state = 0;
export class Store extends Base {
  get(key) {
    return lookup(key);
  }
}
const twice = (x) => x * 2;
function lookup(key) {
  if (key) { return twice(key); }
  return null;
}
''',
    "src/Main.java": '''package demo.app;
import java.util.List;
public class Main extends Base implements Runnable {
    private static int count = 0;
    public static Main create(String a, int b) {
        return new Main();
    }
    public void run() {
        helper(count);
    }
}
interface Job {}
''',
    "srv/main.go": '''package main
import "fmt"
type Server struct { name string }
type Handler interface { Serve() }
func (s *Server) Run(port int) {
	fmt.Println(port)
}
func main() {
	start()
}
''',
    "docs/readme.md": '''# Guide
See [site](http://x.example/a).
## Use
```sh
run me
```
| a | b |
|---|---|
''',
    "conf/app.yaml": '''name: demo
server:
  port: 80
  hosts:
    - one
''',
    "conf/pkg.json": '{"name": "demo", "version": "1.2.3", "dependencies": {"left": "^1.0.0"}}',
    "web/site.css": ".card { color: red } #top { margin: 0 } @media print { .x { a: b } }",
}


def project(spark) -> DataFrame:
    rows = spark.createDataFrame(list(PROJECT.items()), "path string, content string")
    return rows.withColumn("language", files.detect_language(F.col("path")))


def _values(rows: list[tuple], names: str) -> str:
    def shown(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


PYTHON_ROWS = [
    ("os", "Import", None), ("Decimal", "Import", "from decimal import Decimal"), ("LIMIT", "Constant", None), ("rate2", "Variable", None), ("Basket", "Class", "class Basket"),
    ("Basket::__init__", "Function", "def __init__(self, owner)"), ("Basket::total", "Function", "def total(self) -> Decimal"), ("Basket::total::out", "Variable", None),
    ("Basket::total::out", "Variable", None), ("add", "Function", "def add(a, b)"), ("load", "Function", "def load(path: str)"),
]


@query("python_symbols", _values(PYTHON_ROWS, "qualified_name, kind, signature"))
def python_symbols(spark, d):
    return extract.symbols(project(spark).where("language = 'python'")).select("qualified_name", "kind", "signature")


@query("python_calls", _values([("Basket::total", "Decimal"), ("Basket::total", "add"), ("load", "os.open")], "from_symbol, to_symbol"))
def python_calls(spark, d):
    return extract.dependencies(project(spark).where("language = 'python'")).where("relationship_type = 'Calls'").select("from_symbol", "to_symbol").distinct()


@query("project_symbols")
def project_symbols(spark, d):
    return extract.symbols(project(spark)).select("file_path", "qualified_name", "kind", "start_line", "signature")


@query("project_kinds", _values([("rust", "Function", 2), ("rust", "Method", 1), ("rust", "Struct", 1), ("rust", "Enum", 1), ("rust", "Trait", 1), ("java", "Class", 1), ("java", "Interface", 1), ("java", "Method", 2), ("java", "Namespace", 1), ("java", "Import", 1), ("java", "Field", 1), ("go", "Function", 1), ("go", "Method", 1), ("go", "Struct", 1), ("go", "Interface", 1), ("go", "Namespace", 1), ("go", "Import", 1), ("rust", "Import", 1)], "language, kind, n").replace("SELECT *", "SELECT language, kind, CAST(n AS BIGINT) AS n"))
def project_kinds(spark, d):
    return extract.symbols(project(spark)).where("language in ('rust', 'java', 'go')").groupBy("language", "kind").agg(n().alias("n"))


@query("project_dependencies")
def project_dependencies(spark, d):
    return extract.dependencies(project(spark)).select("file_path", "from_symbol", "to_symbol", "relationship_type", "start_line", "strength")


@query("project_loc", _values([("css", 1), ("go", 10), ("java", 12), ("javascript", 13), ("json", 1), ("markdown", 8), ("python", 33), ("rust", 13), ("yaml", 5)], "language, total").replace("SELECT *", "SELECT language, CAST(total AS BIGINT) AS total"))
def project_loc(spark, d):
    return files.loc_by_language(project(spark)).select("language", "total")


@query("project_graph")
def project_graph(spark, d):
    p = project(spark)
    deps = extract.dependencies(p)
    nodes = graph.build_nodes(extract.symbols(p), deps)
    return graph.fan_metrics(nodes, graph.build_edges(deps)).select("qualified_name", "kind", "is_external", "complexity", "parameters", "fan_in", "fan_out")


@query("project_validation")
def project_validation(spark, d):
    p = project(spark)
    deps = extract.dependencies(p)
    nodes = graph.build_nodes(extract.symbols(p), deps)
    return validation.validate(nodes, graph.build_edges(deps))


#: Symbols and edges that hold one case of each pattern, and near misses.
SHAPES = [
    ("UserRepository", "Class", None, "", []), ("findUser", "Method", "UserRepository", "findUser(id)", []), ("saveUser", "Method", "UserRepository", "saveUser(u)", []),
    ("OrderRepository", "Class", None, "", []), ("findOrder", "Method", "OrderRepository", "findOrder(id)", []),
    ("PriceStrategy", "Interface", None, "", []), ("CheapPrice", "Class", None, "", []), ("DearPrice", "Class", None, "", []), ("SortStrategy", "Interface", None, "", []),
    ("ConfigSingleton", "Class", None, "", []), ("Registry", "Class", None, "", []), ("constructor", "Method", "Registry", "constructor()", ["private"]), ("instance", "Field", "Registry", None, ["static"]),
    ("ClickListener", "Class", None, "", []), ("onChangeEvent", "Method", "ClickListener", "onChangeEvent()", []), ("MouseListener", "Class", None, "", []),
    ("FileAdapter", "Class", None, "", []), ("Stream", "Interface", None, "", []), ("LegacyFile", "Class", None, "", []),
    ("MainController", "Class", None, "", []), ("UserModel", "Class", None, "", []), ("UserView", "Class", None, "", []),
    ("ServiceContainer", "Class", None, "", []), ("LogWrapper", "Class", None, "", []),
    ("QueryBuilder", "Class", None, "", []), ("withLimit", "Method", "QueryBuilder", "withLimit(self, n)", []), ("build", "Method", "QueryBuilder", "build(self)", []),
    ("WidgetFactory", "Class", None, "", []), ("ShapeFactory", "Interface", None, "", []), ("createCircle", "Method", "ShapeFactory", "createCircle()", []), ("createSquare", "Method", "ShapeFactory", "createSquare()", []),
]
LINKS = [
    ("CheapPrice", "PriceStrategy", "Implements"), ("DearPrice", "PriceStrategy", "Implements"), ("CheapPrice", "SortStrategy", "Implements"), ("FileAdapter", "Stream", "Implements"),
    ("FileAdapter", "LegacyFile", "DependsOn"), ("LogWrapper", "Stream", "Implements"), ("LogWrapper", "FileAdapter", "Composition"), ("WidgetFactory", "UserModel", "Calls"),
]
FOUND = [
    ("repository", "UserRepository"), ("strategy", "PriceStrategy"), ("singleton", "ConfigSingleton"), ("singleton", "Registry"), ("observer", "ClickListener"), ("adapter", "FileAdapter"),
    ("mvc", None), ("dependency_injection", "ServiceContainer"), ("decorator", "LogWrapper"), ("builder", "QueryBuilder"), ("factory", "WidgetFactory"), ("abstract_factory", "ShapeFactory"),
]


def shapes(spark) -> tuple[DataFrame, DataFrame]:
    rows = [(name, f"{parent}::{name}" if parent else name, kind, [{"name": parent, "kind": "Class"}] if parent else [], sig, mods) for name, kind, parent, sig, mods in SHAPES]
    nodes = spark.createDataFrame(rows, "name string, qualified_name string, kind string, scope_chain array<struct<name string, kind string>>, signature string, modifiers array<string>")
    edges = spark.createDataFrame(LINKS, "a string, b string, kind string")
    return nodes.withColumn("id", graph.node_id(F.col("qualified_name"))), edges.select(graph.node_id(F.col("a")).alias("src"), graph.node_id(F.col("b")).alias("dst"), "kind")


@query("design_patterns", _values(FOUND, "pattern, symbol"))
def design_patterns(spark, d):
    return patterns.detect(*shapes(spark))


TAGS = "a|article|b|body|br|div|footer|h1|head|html|li|nav|p|style|script|title|ul"


@query("html_elements", f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<({TAGS})[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2")
def html_elements(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"<({TAGS})[ >]"), 1)).alias("tag"))
    return found.groupBy("page_id", "tag").agg(n().alias("n"))


@query("html_symbols")
def html_symbols(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"), F.lit("html").alias("language"))
    return extract.symbols(pages).groupBy("file_path", "kind").agg(n().alias("n"))


@query("json_paths", "SELECT event_id, 'k' AS name, 'Field' AS kind FROM events")
def json_paths(spark, d):
    props = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"), F.lit("json").alias("language"))
    return extract.symbols(props).select(F.col("file_path").cast("long").alias("event_id"), "name", "kind")


@query("json_path_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_path_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
