"""Documentation analytics: cleaning, parts, issues and a quality score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comment marks by format, removed at line starts and ends.
MARKS = {
    "jsdoc": r"(?m)^\s*/\*\*+\s?|\s*\*/\s*$|^\s*\*\s?",
    "javadoc": r"(?m)^\s*/\*\*+\s?|\s*\*/\s*$|^\s*\*\s?",
    "python": r'(?m)^\s*("""|\'\'\')|("""|\'\'\')\s*$',
    "rust": r"(?m)^\s*//[/!]\s?",
    "csharp": r"(?m)^\s*///\s?",
}
OTHER = r"(?m)^\s*(//+|#+|--+|;+)\s?"
#: Patterns of a parameter by format: name group, description group.
PARAMETERS = {
    "jsdoc": (r"@param\s+(?:\{[^}]*\}\s+)?\[?(\w+)[^\s]*[^\S\n]*-?[^\S\n]*([^\n]*)", 1, 2),
    "javadoc": (r"@param\s+(\w+)[^\S\n]*([^\n]*)", 1, 2),
    "python": (r"(?::param\s+(?:\w+\s+)?|^\s+)(\w+)\s*(?:\([^)]*\))?:[^\S\n]*([^\n]*)", 1, 2),
    "rust": (r"[*-]\s+`(\w+)`\s*-?[^\S\n]*([^\n]*)", 1, 2),
    "csharp": (r'<param\s+name="(\w+)">([^<]*)</param>', 1, 2),
}
RETURNS = {
    "jsdoc": r"@returns?\s+(?:\{([^}]*)\})?",
    "javadoc": r"@return\s+([^\n]*)",
    "python": r"(?::returns?:|Returns?:)\s*([^\n]*)",
    "rust": r"#\s*Returns\s*([^\n]*)",
    "csharp": r"<returns>([^<]*)</returns>",
}
TAGS = ("deprecated", "since", "version", "author", "throws", "todo", "example")
STOPS = r"(?s)(?:^|\n)\s*(?:@|Parameters:|Returns:|Args:|Example).*$"


def clean(text: Column, fmt: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), MARKS.get(fmt, OTHER), ""))


def description(cleaned: Column) -> Column:
    """Lines before the first tag or section, joined by spaces."""
    head = F.regexp_replace(cleaned, STOPS, "")
    return F.trim(F.regexp_replace(head, r"\s*\n\s*", " "))


def parameters(cleaned: Column, fmt: str) -> Column:
    """array<struct<name, description>>."""
    pattern, name, text = PARAMETERS.get(fmt, PARAMETERS["javadoc"])
    pattern = "(?m)" + pattern
    return F.transform(F.regexp_extract_all(cleaned, F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, name).alias("name"), F.trim(F.regexp_extract(m, pattern, text)).alias("description")))


def returns(cleaned: Column, fmt: str) -> Column:
    found = F.trim(F.regexp_extract(cleaned, RETURNS.get(fmt, RETURNS["javadoc"]), 1))
    return F.when(found != "", found)


def examples(cleaned: Column) -> Column:
    """Bodies of fenced code."""
    return F.regexp_extract_all(cleaned, F.lit(r"(?s)```\w*\n(.*?)```"), 1)


def references(cleaned: Column) -> Column:
    return F.concat(
        F.regexp_extract_all(cleaned, F.lit(r"@see\s+(\S+)"), 1),
        F.regexp_extract_all(cleaned, F.lit(r"\{@link\s+([^}]+)\}"), 1),
        F.regexp_extract_all(cleaned, F.lit(r'<see\s+cref="([^"]+)"'), 1),
    )


def tags(cleaned: Column) -> Column:
    """First value of each known tag, as a map."""
    pairs = F.array(*[F.struct(F.lit(t).alias("k"), F.trim(F.regexp_extract(cleaned, rf"@{t}\b[^\S\n]*([^\n]*)", 1)).alias("v"), F.rlike(cleaned, F.lit(rf"@{t}\b")).alias("has")) for t in TAGS])
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["has"]), lambda p: F.struct(p["k"], p["v"])))


def issues(cleaned: Column, params: Column, ret: Column) -> Column:
    bare = F.transform(F.filter(params, lambda p: p["description"] == ""), lambda p: F.concat(F.lit("parameter lacks description: "), p["name"]))
    found = F.concat(
        F.when(cleaned == "", F.array(F.lit("empty documentation"))).otherwise(F.array().cast("array<string>")),
        F.when((cleaned != "") & (F.octet_length(cleaned) < 20), F.array(F.lit("documentation too short"))).otherwise(F.array().cast("array<string>")),
        bare,
        F.when(F.lower(cleaned).contains("return") & ret.isNull(), F.array(F.lit("undocumented return"))).otherwise(F.array().cast("array<string>")),
    )
    return found


def quality(desc: Column, params: Column, ret: Column, shown: Column) -> Column:
    """Up to 40 for the description, 30 for described parameters, 20 for the return, 10 for examples; whole percent."""
    length = F.length(desc)
    first = F.when(length >= 100, 40).when(length >= 50, 30).when(length >= 20, 20).when(length > 0, 10).otherwise(0)
    told = F.size(F.filter(params, lambda p: p["description"] != ""))
    second = F.when(F.size(params) == 0, 30).otherwise(30 * told / F.greatest(F.size(params), F.lit(1)))
    return F.floor(first + second + F.when(ret.isNotNull(), 20).otherwise(0) + F.when(F.size(shown) > 0, 10).otherwise(0)).cast("long")


def analyze(text: Column, fmt: str) -> Column:
    """All parts of one documentation text as a struct."""
    c = clean(text, fmt)
    d, p, r, e = description(c), parameters(c, fmt), returns(c, fmt), examples(c)
    return F.struct(d.alias("description"), p.alias("parameters"), r.alias("returns"), e.alias("examples"), references(c).alias("references"), tags(c).alias("tags"), issues(c, p, r).alias("issues"), quality(d, p, r, e).alias("score"))
