"""Search, filters, paging and statistics over symbol tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text


def find_symbols(symbols: DataFrame, pattern: str, column: str = "qualified_name") -> DataFrame:
    """Case-insensitive substring search; one row per name."""
    return symbols.where(F.contains(F.lower(column), F.lit(pattern.lower()))).dropDuplicates([column])


def by_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.lower("kind") == kind.lower())


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path)


def dependents(edges: DataFrame, target) -> DataFrame:
    """Sources of the edges into a node, one row per edge."""
    return edges.where(F.col("dst") == target).select(F.col("src").alias("id"), "kind")


def dependencies(edges: DataFrame, source) -> DataFrame:
    """Targets of the edges out of a node, one row per edge."""
    return edges.where(F.col("src") == source).select(F.col("dst").alias("id"), "kind")


def dependencies_like(deps: DataFrame, part: str) -> DataFrame:
    """Dependencies with the text at either end, as one line each."""
    p = F.lit(part)
    line = F.format_string("%s -> %s (%s) @ %s:%d", "from_symbol", "to_symbol", "relationship_type", "file_path", "start_line")
    return deps.where(F.contains("from_symbol", p) | F.contains("to_symbol", p)).select(line.alias("line"))


def top(symbols: DataFrame, column: str, limit: int, *ties: str) -> DataFrame:
    """The rows of the largest values; ties by the given columns, so that reruns agree."""
    return symbols.orderBy(F.desc(column), *ties).limit(limit)


@dataclass
class Exclude:
    names: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    tests: bool = False
    generated: bool = False


@dataclass
class Filter:
    """A conjunction of what is given; text patterns are substrings or one-star globs, any of a list."""

    names: list[str] = field(default_factory=list)
    qualified_names: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    complexity: tuple[int | None, int | None] = (None, None)
    dependencies: tuple[int | None, int | None] = (None, None)
    dependents: tuple[int | None, int | None] = (None, None)
    tags: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    documented: bool | None = None
    signed: bool | None = None
    exclude: Exclude | None = None


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _like(column: str, patterns: list[str]) -> Column:
    return _any([text.one_star_match(F.col(column), p) for p in patterns])


def is_test(columns: set[str]) -> Column:
    out = F.lower("name").contains("test")
    if "file_path" in columns:
        out = out | F.lower("file_path").contains("test") | F.lower("file_path").contains("spec")
    if "tags" in columns:
        out = out | F.exists("tags", lambda t: t.contains("test"))
    return out


def is_generated(columns: set[str]) -> Column:
    f = F.lower("file_path")
    out = f.contains("generated") | f.contains(".gen.") | f.contains("_gen.") | f.endswith(".gen")
    return out | F.exists("tags", lambda t: t.contains("generated")) if "tags" in columns else out


def condition(f: Filter, columns: set[str]) -> Column:
    """The filter as one boolean expression, which scans can take in part."""
    tests: list[Column] = []
    for column, patterns in (("name", f.names), ("qualified_name", f.qualified_names), ("file_path", f.files)):
        if patterns:
            tests.append(_like(column, patterns))
    for column, values in (("kind", f.kinds), ("language", f.languages)):
        if values:
            tests.append(F.col(column).isin(values))
    for column, (low, high) in (("complexity", f.complexity), ("n_dependencies", f.dependencies), ("n_dependents", f.dependents)):
        if low is not None:
            tests.append(F.col(column) >= low)
        if high is not None:
            tests.append(F.col(column) <= high)
    for column, values in (("tags", f.tags), ("modifiers", f.modifiers)):
        if values:
            tests.append(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    for column, wanted in (("documentation", f.documented), ("signature", f.signed)):
        if wanted is not None:
            tests.append(F.col(column).isNotNull() if wanted else F.col(column).isNull())
    if x := f.exclude:
        out: list[Column] = []
        if x.names:
            out.append(_like("name", x.names))
        if x.files:
            out.append(_like("file_path", x.files))
        if x.kinds:
            out.append(F.col("kind").isin(x.kinds))
        if x.tests:
            out.append(is_test(columns))
        if x.generated:
            out.append(is_generated(columns))
        if out:
            tests.append(~F.coalesce(_any(out), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filter(symbols: DataFrame, f: Filter) -> DataFrame:
    return symbols.where(condition(f, set(symbols.columns)))


def paginate(symbols: DataFrame, page: int, size: int, order: list[tuple[str, bool]], max_items: int | None = None) -> DataFrame:
    """Rows of one page (from 0) in the order of (column, descending) pairs, with their row number.

    Only as many rows as pages up to this one hold are sorted: a limit, not a full sort.
    """
    if size <= 0:
        return symbols.withColumn("row_number", F.lit(0).cast("long")).limit(0)
    keys = [F.desc(c) if down else F.asc(c) for c, down in order]
    stop = min((page + 1) * size, max_items if max_items is not None else (page + 1) * size)
    if stop <= page * size:
        return symbols.withColumn("row_number", F.lit(0).cast("long")).limit(0)
    # a limit under an offset keeps at most `stop` rows, which one task numbers
    first = symbols.orderBy(*keys).limit(stop)
    numbered = first.withColumn("row_number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("long"))
    return numbered.where(F.col("row_number") > page * size)


def page_info(total: int, page: int, size: int) -> dict:
    pages = -(-total // size) if size > 0 else 1
    return {"page": page, "page_size": size, "total_items": total, "total_pages": max(1, pages), "has_next": size > 0 and page + 1 < pages, "has_previous": page > 0}


def histograms(items: DataFrame, **columns: Column) -> DataFrame:
    """(facet, value, n) of several groupings in one pass."""
    named = items.select(*[c.cast("string").alias(k) for k, c in columns.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in columns]))
    return named.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def analysis_metrics(symbols: DataFrame) -> DataFrame:
    """One row: symbols, complexity sum, mean and largest, documented share."""
    return symbols.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.coalesce(F.sum("complexity"), F.lit(0)).alias("total_complexity"),
        F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"),
        F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("mean_complexity"),
        F.count(F.when(F.col("documentation").isNotNull(), 1)).alias("documented"),
    )


def nearest_rank(values: DataFrame, keys: list[str], column: str, percents: list[float]) -> DataFrame:
    """Values at index int(p / 100 * (n - 1)) of each group's ascending order, without gathering a group."""
    w = Window.partitionBy(*keys)
    ranked = values.where(F.col(column).isNotNull()).select(*keys, column, F.row_number().over(w.orderBy(column)).alias("r"))
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"), "n")
    wanted = wanted.withColumn("r", (F.floor(F.col("percent") / 100 * (F.col("n") - 1)) + 1).cast("int"))
    return wanted.join(ranked, [*keys, "r"]).select(*keys, "percent", F.col(column).alias("value"))


def issues(symbols: DataFrame, complexity: int = 10, fan_out: int = 20) -> DataFrame:
    """(id, issue) for symbols over a threshold."""
    found = F.array_compact(
        F.array(
            F.when(F.col("complexity") > complexity, F.concat(F.lit("high complexity: "), F.col("complexity").cast("string"))),
            F.when(F.col("fan_out") > fan_out, F.concat(F.lit("many dependencies: "), F.col("fan_out").cast("string"))),
        )
    )
    return symbols.select("id", F.explode(found).alias("issue"))


#: Ranges that thresholds are held in.
THRESHOLD_RANGES = {"complexity": (5, 50), "fan_out": (10, 100), "large_result": (5, 100)}
PRESETS = {"default": {"complexity": 10, "fan_out": 20, "large_result": 20}, "large": {"complexity": 15, "fan_out": 30, "large_result": 50}, "small": {"complexity": 8, "fan_out": 15, "large_result": 10}}


def thresholds(preset: str = "default", **over: int) -> dict[str, int]:
    out = PRESETS[preset] | over
    return {k: min(max(v, THRESHOLD_RANGES[k][0]), THRESHOLD_RANGES[k][1]) for k, v in out.items()}
