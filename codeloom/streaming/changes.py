"""File changes as a stream: filtering, quiet-time batches, incremental refresh and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import files

#: Kinds of change.
CHANGE_TYPES = ("created", "modified", "deleted", "renamed")
#: Extensions of files whose changes count.
WATCHED = (
    "rs", "py", "js", "ts", "java", "go", "cs", "swift", "m", "mm", "php", "rb", "scala", "zig", "dart", "lua", "sh", "bash", "css", "html", "xml",
    "json", "yaml", "yml", "md",
)


def watch(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """A stream of (path, modified, length, content) of files that appear below ``root``."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def watched(changes: DataFrame, ignores: list[str] | None = None, extensions=WATCHED) -> DataFrame:
    """Changes of watched extensions outside of ignored paths."""
    return changes.where(files.extension(F.col("path")).isin(list(extensions)) & ~files.ignored(F.col("path"), files.merged_ignores(ignores)))


def quiet_batches(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute", keys: list[str] | None = None) -> DataFrame:
    """One row per run of changes of a key that no pause of ``quiet`` interrupts, with its last change.

    Works on batches and on streams; a stream gives a run once its watermark is past it.
    """
    keys = keys or ["path"]
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    if changes.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.session_window("ts", quiet).alias("w"), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("changes"), F.max_by("change_type", "ts").alias("last_change"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", "last_change")


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    return changes.groupBy("path").agg(F.max_by("change_type", F.struct("ts", "change_type")).alias("change_type"), F.max("ts").alias("ts"))


def change_stats(changes: DataFrame) -> DataFrame:
    """(change_type, extension, n)."""
    return changes.groupBy("change_type", files.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def content_keys(texts: DataFrame) -> DataFrame:
    """(path, sha256): what tells whether a file has to be analysed again."""
    return texts.select("path", F.sha2("content", 256).alias("sha256"))


def stale(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't the one known under their path."""
    return texts.withColumn("sha256", F.sha2("content", 256)).join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


def affected(changed: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Changed paths, the files that depend on them and those that they depend on (one level)."""
    own = changed.select("path").distinct()
    up = file_edges.join(own.withColumnRenamed("path", "dst_file"), "dst_file", "left_semi").select(F.col("src_file").alias("path"))
    down = file_edges.join(own.withColumnRenamed("path", "src_file"), "src_file", "left_semi").select(F.col("dst_file").alias("path"))
    return own.unionByName(up).unionByName(down).distinct()


def refresh(changes: DataFrame, target: str, checkpoint: str, analyze):
    """A query that analyses each micro batch of changed files and appends the rows to ``target``.

    A batch is written under its number, so one that runs again after a failure replaces itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        analyze(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
