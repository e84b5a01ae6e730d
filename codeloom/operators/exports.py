"""Exports: documents, editor protocol records, diagrams and feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import escape_dot

#: Kinds of the editor protocol.
LSP_KINDS = {
    "Module": 2, "Namespace": 3, "Class": 5, "Method": 6, "Field": 8, "Enum": 10, "Interface": 11, "Function": 12, "Variable": 13,
    "Constant": 14, "Struct": 23, "Type": 26, "Trait": 11, "Parameter": 13, "Union": 23,
}
#: Kinds that become a tag of a symbol.
TAGGED_KINDS = ("Function", "Method", "Class", "Interface", "Struct", "Enum")
#: Keywords by language for feature rows, and those of any other language.
SCRIPT_KEYWORDS = ("function", "class", "const", "let", "var", "if", "for", "while", "try", "catch")
KEYWORDS = {
    "rust": ("fn", "struct", "enum", "impl", "trait", "pub", "mut", "let", "const"),
    "python": ("def", "class", "import", "from", "if", "for", "while", "try", "except"),
    "javascript": SCRIPT_KEYWORDS,
    "typescript": SCRIPT_KEYWORDS,
    "java": ("public", "private", "class", "interface", "extends", "implements", "static", "final"),
}
OTHER_KEYWORDS = ("function", "class", "public", "private", "static")


def lsp_kind(kind: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in LSP_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, kind), F.lit(LSP_KINDS["Variable"]))


def path_to_uri(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("file://")), path).when(F.startswith(path, F.lit("/")), F.concat(F.lit("file://"), path)).otherwise(F.concat(F.lit("file:///"), path))


def lsp_symbols(nodes: DataFrame, shift: int = 0) -> DataFrame:
    """name, kind code, uri and range of each symbol; ``shift`` -1 for readers that expect lines counted so."""
    at = lambda line, col: F.struct(F.greatest(F.col(line) + shift, F.lit(0)).alias("line"), F.col(col).alias("character"))
    return nodes.select("name", lsp_kind(F.col("kind")).alias("kind"), path_to_uri(F.col("file_path")).alias("uri"), F.struct(at("start_line", "start_column").alias("start"), at("end_line", "end_column").alias("end")).alias("range"), F.exists("modifiers", lambda m: F.lower(m).contains("deprecated")).alias("deprecated"))


def hover(nodes: DataFrame) -> DataFrame:
    """Markdown shown for a symbol."""
    parts = F.concat_ws("\n\n", F.concat(F.lit("```\n"), F.coalesce("signature", "name"), F.lit("\n```")), F.col("documentation"), F.format_string("complexity %d", "complexity"))
    return nodes.select("qualified_name", parts.alias("hover"))


def tags(nodes: DataFrame) -> DataFrame:
    """Symbols with their tags: kind, modifiers, language, scoped, documented."""
    kind = F.when(F.col("kind").isin(*TAGGED_KINDS), F.array(F.lower("kind"))).otherwise(F.array().cast("array<string>"))
    more = F.array_compact(F.array(F.col("language"), F.when(F.size("scope_chain") > 0, "scoped"), F.when(F.col("documentation").isNotNull(), "documented")))
    return nodes.withColumn("tags", F.array_distinct(F.concat(kind, F.coalesce("modifiers", F.array().cast("array<string>")), more)))


def symbol_documents(nodes: DataFrame) -> DataFrame:
    """One JSON document per symbol, in the order of file, line and name."""
    keep = [c for c in nodes.columns if c != "id"]
    return nodes.select("file_path", "start_line", "name", F.to_json(F.struct(*keep)).alias("document"))


def export_symbols(nodes: DataFrame, languages=(), kinds=(), file_part: str | None = None, limit: int | None = None) -> DataFrame:
    """Filter, sort by file, line and name, and cut at ``limit``."""
    if languages:
        nodes = nodes.where(F.col("language").isin(list(languages)))
    if kinds:
        nodes = nodes.where(F.col("kind").isin(list(kinds)))
    if file_part:
        nodes = nodes.where(F.contains("file_path", F.lit(file_part)))
    nodes = nodes.orderBy("file_path", "start_line", "name")
    return nodes.limit(limit) if limit is not None else nodes


def dot_lines(edges: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None) -> DataFrame:
    """(line) of a DOT digraph per edge."""
    q = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c).cast("string")), F.lit('"'))
    tail = F.concat(F.lit(" [label="), q(label), F.lit("];")) if label else F.lit(";")
    return edges.select(F.concat(F.lit("  "), q(src), F.lit(" -> "), q(dst), tail).alias("line"))


def mermaid_lines(edges: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None) -> DataFrame:
    """(line) of a Mermaid flow chart per edge; node names are their digests."""
    name = lambda c: F.concat(F.lit("n"), F.lower(F.hex(F.xxhash64(F.col(c).cast("string")))), F.lit('["'), F.regexp_replace(F.col(c).cast("string"), r'["\[\]]', "'"), F.lit('"]'))
    arrow = F.concat(F.lit(" -->|"), F.col(label), F.lit("| ")) if label else F.lit(" --> ")
    return edges.select(F.concat(F.lit("  "), name(src), arrow, name(dst)).alias("line"))


def write_diagram(lines: DataFrame, path: str, kind: str = "dot") -> None:
    """The lines as text files between a head and a tail row of their own partition."""
    head, tail = {"dot": ("digraph g {", "}"), "mermaid": ("graph LR", "")}[kind]
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, head), (2, tail)], "part int, line string")
    ends.unionByName(lines.select(F.lit(1).alias("part"), "line")).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def features(nodes: DataFrame) -> DataFrame:
    """Token counts, keywords (in any case, as they come) and quality of each symbol's text."""
    body = F.concat_ws(" ", "signature", "documentation")
    tokens = F.filter(F.split(body, r"\s+"), lambda t: t != "")
    table = F.create_map(*[x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.coalesce(F.try_element_at(table, F.lower("language")), F.array(*map(F.lit, OTHER_KEYWORDS)))
    complete = F.when(F.col("documentation").isNotNull() & F.col("signature").isNotNull(), 1.0).when(F.col("documentation").isNotNull() | F.col("signature").isNotNull(), 0.7).otherwise(0.3)
    return nodes.select("qualified_name", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("distinct_tokens"), F.octet_length(body).alias("bytes"), F.filter(tokens, lambda t: F.array_contains(words, F.lower(t))).alias("keywords"), complete.alias("completeness"))
