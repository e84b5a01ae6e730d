"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, media, mixing, simhash, tokencount, toxicity, winnowing
from .common import documents, held_out

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to the sources' target weights."""
    return mixing.report(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every whole document, and those that its lines name."""
    return licenses.scan(documents(spark, sf_dir)).withColumn("line_licenses", F.array_join("line_licenses", ","))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; three words, two bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public byte-level vocabulary."""
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path(), keep_ids=False)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks that it shares with an earlier one."""
    found = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("cut").cast("long").alias("n_cut"), "cut", "blank", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the gated recurrent network."""
    docs = documents(spark, sf_dir)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, net, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media, read back and described."""
    return media.media_columns(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document."""
    return tokencount.section_counts(documents(spark, sf_dir), tokenizer_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing entropy."""
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text."""
    return winnowing.edit_report(documents(spark, sf_dir))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_media": op3_media,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_winnowing": op10_winnowing,
}
ORACLE_SQL: dict[str, str] = {"op7_licenses": licenses.oracle()}
