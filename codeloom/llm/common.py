"""Helpers that every training-data operator shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.storage import materialize, new_path, scratch, shared_dir

__all__ = ["documents", "fresh", "held_out", "materialize", "new_path", "scratch", "shared_dir", "slices"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col) -> "F.Column":
    """Rows whose label must not be learned: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, text: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and some ``size`` bytes of the column ``text``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as it needs to differ from ``taken`` (names compare without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
