"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts are lower-cased in A-Z only, cut at ASCII white space and hashed as word shingles
(XXH64, seed 42). Two fingerprints within ``radius`` bits share at least one variant
that is within half the radius of both, so each distinct fingerprint emits that ball,
variants are shuffled with a map-side combine, and the fingerprints that meet on one
are linked. A variant keeps its visitors as a bit mask, which bounds each group at 65.

Defined cases: null or blank text has fingerprint zero and is linked like any other;
texts of fewer words than a shingle hash as one sequence; repeated rows share a
component; a null id never names a component unless all its ids are null; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import components

from .common import materialize

SEED = 42
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
COLUMN = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, ">u8")
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), SEED)], ">u8")
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())], ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0)
    else:
        ones = np.einsum("cb,bk->ck", np.bincount((octets + COLUMN).ravel(), minlength=2048).reshape(8, 256), BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > len(octets)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_cols`` and fp (signed long) per row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*id_cols, "fp"])

    picked = docs.select(F.col(text_col), *id_cols)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{ddl}, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) that connect all distinct fingerprints within ``radius`` 2 of each other.

    All visitors of a variant are within one bit of it, so any two are within two bits:
    each is linked to the smallest, which keeps every connection without all pairs.
    """
    if radius != 2:
        raise ValueError("the mask of visitors is laid out for a radius of 2")
    bit = F.col("i")
    one = F.expr("shiftleft(1L, i)")
    # each row grows 65-fold: an explicit number of partitions isn't coalesced by the small size before that
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").repartition(parts, "fp").distinct().select("fp", F.explode(F.expr("sequence(-1, 63)")).alias("i"))
    rows = rows.select(
        F.when(bit < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(one)).alias("variant"),
        F.when(bit < 0, F.lit(0).cast("long")).otherwise(one).alias("mask"),
        F.when(bit < 0, F.lit(1)).otherwise(F.lit(0)).alias("own"),
    )
    met = rows.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") > 1)
    flipped = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1L) = 1L), i -> variant ^ shiftleft(1L, i))")
    met = met.select(F.when(F.col("own") == 1, F.concat(flipped, F.array("variant"))).otherwise(flipped).alias("them"))
    met = met.select(F.array_min("them").alias("a"), F.explode("them").alias("b")).where("a != b")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_groups(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``marked`` (id_col, fp)."""
    firsts = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "fingerprints")
    roots = components(ball_links(firsts), "a", "b")
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id that links reach)."""
    marked = materialize(fingerprints(docs, [id_col], text_col, words), "marked")
    return marked.join(simhash_groups(marked, id_col), "fp").select(id_col, "fp", "component_id")
