"""A corpus pipeline: language ID, line dedup, near-dedup, mixing and token encoding.

``run(spark, sf_dir)`` applies the stages to ``documents``. Each stage's rows are written
as Parquet to the shared folder and reread as the next one's input; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, langid, linededup, mixing, neardup
from codeloom.llm.common import documents, materialize
from codeloom.llm.queries import tokenizer_path


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their place, which can't clash with an operator's, and these names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned go on; those whose text is null or has no letter are rejected.

    Empty texts are rejected, texts of any length are parsed whole, ties of languages keep the
    document, repeated rows all go on, an empty table stays empty, other columns don't matter.
    """
    rows, at = plain(docs)
    found = langid.identify(rows, langid.train(rows, at["doc_id"], at["text"], at["lang"]), rows.columns, at["text"])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks leave the later documents; those of which nothing is left are dropped.

    Documents without a cut stay as they are, null and empty texts too; ``n_chars`` follows the
    text where it was cut; ties of ids, repeated rows, long texts and empty tables as in ``linededup``.
    """
    rows, at = plain(docs)
    found = linededup.dedup(rows, at["doc_id"], at["text"]).where("size(cut) = 0 or not blank")
    n = F.col(at["n_chars"])
    kept = F.when(F.size("cut") > 0, F.char_length(at["text"]).cast(rows.schema[at["n_chars"]].dataType)).otherwise(n)
    return found.withColumn(at["n_chars"], kept).select(rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays, that of the smallest id.

    Null, empty and blank texts are one group; null ids come last, ties and repeated rows keep one
    row; texts of any length enter whole; an empty table stays empty; other columns don't matter.
    """
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are never taken; a null source is one of its own; rows of
    equal ids are taken alike; an empty table stays empty; other columns don't matter.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows and ties
    of ids each have a row; an empty table stays empty; other columns are left out.
    """
    return bpe.encode_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("encode", encode)]
#: Automata, alignments and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
