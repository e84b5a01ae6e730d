"""Source trees as tables: scanning, language, ignore globs, size limits, skipped files, line counts."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import model
from codeloom.functions.text import glob_regex

MAX_FILE_BYTES = 10 * 1024 * 1024
#: What a scan leaves out unless told otherwise.
DEFAULT_IGNORES = (
    "node_modules/**", ".git/**", "target/**", "dist/**", "build/**", "coverage/**", ".nyc_output/**", "__pycache__/**", "*.pyc",
)
#: Line and block comment marks by language.
LINE_COMMENT = {
    **dict.fromkeys(("python", "ruby", "bash", "yaml"), "#"),
    **dict.fromkeys(("rust", "javascript", "typescript", "java", "go", "cpp", "csharp", "php", "swift", "scala", "dart", "zig", "objc"), "//"),
    "lua": "--",
}
BLOCK_COMMENT = {
    **dict.fromkeys(("rust", "javascript", "typescript", "java", "go", "cpp", "csharp", "php", "swift", "scala", "dart", "objc", "css"), ("/*", "*/")),
    **dict.fromkeys(("html", "xml", "markdown"), ("<!--", "-->")),
    "python": ('"""', '"""'),
    "lua": ("--[[", "]]"),
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def detect_language(path: Column, display: bool = False) -> Column:
    """Language of a path by its extension, null if unknown."""
    names = {e: model.display_name(lang) if display else lang for e, lang in model.LANGUAGE_OF.items()}
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(names.items()))), extension(path))


def merged_ignores(patterns: list[str] | None) -> list[str]:
    return list(dict.fromkeys([*DEFAULT_IGNORES, *(patterns or [])]))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a glob of the list matches; one without a rooted start also matches below any folder."""
    tried = list(chain.from_iterable([p] if p.startswith(("**/", "/")) or ":" in p else [p, f"**/{p}"] for p in patterns))
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in tried)) if tried else F.lit(False)


def is_declaration(path: Column) -> Column:
    return F.lower(path).rlike(r"\.d\.[mc]?ts$")


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, ignores: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """path, length, modified, content (binary) and language of the source files below ``root``.

    Path conditions and the size stand before the content is used, so that files which
    are left out aren't decoded. ``max_files`` takes the first paths in order.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = raw.select("path", "length", F.col("modificationTime").alias("modified"), "content").withColumn("language", detect_language(F.col("path")))
    return select_files(rows, languages, ignores, max_files)


def select_files(rows: DataFrame, languages: list[str] | None = None, ignores: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    keep = F.col("language").isNotNull() & ~is_declaration(F.col("path")) & ~ignored(F.col("path"), merged_ignores(ignores))
    if languages:
        keep = keep & F.col("language").isin(validate_languages(languages))
    rows = rows.where(keep)
    return rows.orderBy("path").limit(max_files) if max_files is not None else rows


def read_texts(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts with content as string, skipped with file_path, stage, reason): too large, or not UTF-8."""
    large = F.col("length") > max_bytes
    text = F.try_validate_utf8(F.col("content").cast("string"))
    skipped = files.where(large | text.isNull()).select(
        F.col("path").alias("file_path"), F.lit("read").alias("stage"),
        F.when(large, F.concat(F.lit("File too large: "), F.col("length").cast("string"), F.lit(" bytes"))).otherwise("not valid UTF-8").alias("reason"),
    )
    return files.where(~large).withColumn("content", text).where(F.col("content").isNotNull()), skipped


def validate_languages(languages: list[str]) -> list[str]:
    unknown = [x for x in languages if x.lower() not in model.LANGUAGES]
    if unknown:
        raise ValueError(f"unknown languages: {unknown}")
    return [x.lower() for x in languages]


def validate_ignores(patterns: list[str]) -> list[str]:
    for p in patterns:
        if p in ("*", "**/*", "/**", "**") or ".." in p or len(p) > 200 or not p:
            raise ValueError(f"ignore pattern not allowed: {p!r}")
    return patterns


def count_lines(content: Column, language: str) -> Column:
    """struct<total, blank, comment, code> of a text in one language, with the state of block comments."""
    mark = LINE_COMMENT.get(language)
    start, end = BLOCK_COMMENT.get(language, (None, None))
    lines = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\n$", ""), "\n"))

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(raw)
        blank = line == ""
        opens = F.startswith(line, F.lit(start)) if start else F.lit(False)
        rest = F.substring(line, len(start) + 1, 1 << 30) if start else line
        closes = F.contains(rest, F.lit(end)) if start else F.lit(False)
        ends = F.contains(line, F.lit(end)) if start else F.lit(False)
        comment = ~blank & (s["inside"] | opens | (F.startswith(line, F.lit(mark)) if mark else F.lit(False)))
        inside = F.when(s["inside"], ~ends).otherwise(opens & ~closes)
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(inside.alias("inside"), (s["blank"] + one(blank)).alias("blank"), (s["comment"] + one(comment)).alias("comment"), (s["code"] + one(~blank & ~comment)).alias("code"))

    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(0).alias("code"))
    done = F.aggregate(lines, zero, step)
    return F.struct(F.size(lines).cast("long").alias("total"), done["blank"].cast("long").alias("blank"), done["comment"].cast("long").alias("comment"), done["code"].cast("long").alias("code"))


def loc_by_language(texts: DataFrame) -> DataFrame:
    """Files and lines of each language, ordered by name."""
    languages = sorted(model.EXTENSIONS)
    counted = reduce(lambda c, lang: c.when(F.col("language") == lang, count_lines(F.col("content"), lang)), languages[1:], F.when(F.col("language") == languages[0], count_lines(F.col("content"), languages[0])))
    rows = texts.where(F.col("language").isNotNull()).select("language", counted.alias("loc"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), *[F.sum(f"loc.{c}").alias(c) for c in ("total", "blank", "comment", "code")]).orderBy("language")


def language_stats(files: DataFrame, lines: str = "lines") -> DataFrame:
    """Files, lines and percent of lines (two decimals) of each language; the total counts as 1 at least."""
    sums = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).cast("long").alias("lines"))
    total = F.greatest(F.sum("lines").over(_everything()), F.lit(1))
    return sums.withColumn("percent", F.round(F.col("lines") / total * 10000) / 100)


def _everything():
    from pyspark.sql import Window

    # over one row per language
    return Window.partitionBy(F.lit(0))


def validate_relative(path: str) -> str:
    """A path that stays where it is put."""
    if not path or len(path) > 4096 or ".." in path.split("/") or path.startswith("~"):
        raise ValueError(f"path not allowed: {path[:80]!r}")
    return path


def project_size(count: int) -> str:
    return next((name for top, name in ((100, "tiny"), (1_000, "small"), (10_000, "medium"), (100_000, "large")) if count < top), "massive")


def estimates(files: DataFrame) -> DataFrame:
    """One row from (length, lines, complexity): milliseconds and megabytes that an analysis is expected to take."""
    sums = files.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.avg("complexity"), F.lit(1.0)).alias("complexity"))
    return sums.select(
        "*",
        (F.floor(F.col("lines") / 1000) + 100).alias("parse_ms"),
        F.floor(F.col("lines") * F.col("complexity") * 0.1 + 500).alias("analysis_ms"),
        F.floor(F.floor(F.col("bytes") / 1048576) * 5 * F.col("complexity") + 50).alias("memory_mb"),
    )
