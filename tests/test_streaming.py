from pyspark.sql import functions as F

from codeloom.sources import extract, files
from codeloom.streaming import changes


def rows(spark):
    data = [("a.py", "created", 0), ("a.py", "modified", 1), ("a.py", "deleted", 100), ("b.py", "created", 3), ("build/c.py", "created", 4), ("d.txt", "created", 5)]
    return spark.createDataFrame(data, "path string, change_type string, s long").select("path", "change_type", F.timestamp_seconds("s").alias("ts"))


def test_batches_and_filters(spark):
    seen = changes.watched(rows(spark))
    assert {r["path"] for r in seen.collect()} == {"a.py", "b.py"}
    got = {(r["path"], r["changes"], r["last_change"]) for r in changes.quiet_batches(seen, "10 seconds").collect()}
    assert got == {("a.py", 2, "modified"), ("a.py", 1, "deleted"), ("b.py", 1, "created")}
    assert {r["path"]: r["change_type"] for r in changes.last_changes(seen).collect()} == {"a.py": "deleted", "b.py": "created"}


def test_stream_of_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark).unionByName(spark.createDataFrame([("z.py", "created")], "path string, change_type string").withColumn("ts", F.timestamp_seconds(F.lit(9_999)))).write.parquet(src)
    stream = spark.readStream.schema("path string, change_type string, ts timestamp").parquet(src)
    run = changes.quiet_batches(stream, "10 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["path"], r["changes"]) for r in spark.table("sessions").collect()}
    assert ("a.py", 2) in got and ("a.py", 1) in got and not any(p == "z.py" for p, _ in got)


def test_refresh_replaces_a_batch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("def f(): pass\n")
    stream = changes.watch(spark, str(tmp_path / "src"))

    def analyze(df):
        texts, _ = files.read_texts(df.withColumn("language", files.detect_language(F.col("path"))))
        return extract.symbols(texts)

    for _ in range(2):
        changes.refresh(stream, str(tmp_path / "out"), str(tmp_path / "ck"), analyze).awaitTermination()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["f"]
