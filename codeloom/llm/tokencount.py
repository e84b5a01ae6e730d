"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Each token covers a span of the text's UTF-8 bytes;
an interval join of these sorted spans with the sorted spans of the sections (or of
fields joined by a separator) attributes the tokens. The rule at boundaries: a token that
lies in several sections counts whole in the one where it starts (``n_tokens``) and by its
share of bytes in each (``weighted_tokens``), so both columns sum to the document's total.
Separators belong to the section that they end.

Defined cases: null and empty texts have one empty section with 0 tokens; blank sections
count like others; documents of any length are encoded whole; rows repeat as they come; a
null field is an empty section; rows of tied ids each have their own sections; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that start in each section, and tokens weighted by their bytes in it; ends are ascending."""
    whole, weighted = np.zeros(len(section_ends), np.int64), np.zeros(len(section_ends))
    if not len(token_ends):
        return whole, weighted
    starts = np.concatenate(([0], token_ends[:-1]))
    # a section that is empty never holds a start: the first that ends behind it does
    first = np.searchsorted(section_ends, starts, side="right")
    np.add.at(whole, first, 1)
    cuts = np.unique(np.concatenate((token_ends, section_ends)))
    begins = np.concatenate(([0], cuts[:-1]))
    keep = cuts > begins
    cuts, begins = cuts[keep], begins[keep]
    token = np.searchsorted(token_ends, begins, side="right")
    section = np.searchsorted(section_ends, begins, side="right")
    np.add.at(weighted, section, (cuts - begins) / (token_ends - starts)[token])
    return whole, weighted


COUNTS = "section long, start long, stop long, n_tokens long, weighted_tokens double"


def _counted(parts: DataFrame, path: str, id_col: str, split, gap: str) -> DataFrame:
    """``COUNTS`` of each row of ``parts`` (id, value); ``split`` gives a value's sections, which ``gap`` joins to the document."""
    mark = len(gap.encode("utf-8"))

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(at, 1000)
                rows: list[list] = [[] for _ in range(6)]
                for i, value in enumerate(batch.column(1).slice(at, 1000)):
                    sections = split(value.as_py())
                    byte_ends = np.cumsum([len(p.encode("utf-8")) + mark for p in sections])
                    byte_ends[-1] -= mark
                    char_ends = np.cumsum([len(p) + len(gap) for p in sections])
                    char_ends[-1] -= len(gap)
                    ends = np.cumsum(c.piece_len[c.encode(gap.join(sections))])
                    whole, weighted = attribute(ends, byte_ends)
                    n = len(sections)
                    for col, values in zip(rows, ([i] * n, range(n), [0, *char_ends[:-1].tolist()], char_ends.tolist(), whole.tolist(), weighted.tolist())):
                        col.extend(values)
                ids = ids.take(pa.array(rows[0], pa.int64()))
                cols = [pa.array(v, pa.int64()) for v in rows[1:5]] + [pa.array(rows[5], pa.float64())]
                for a in range(0, max(1, len(ids)), 50_000):
                    yield pa.RecordBatch.from_arrays([ids.slice(a, 50_000), *(x.slice(a, 50_000) for x in cols)], names=["id", "section", "start", "stop", "n_tokens", "weighted_tokens"])

    out = parts.mapInArrow(run, f"id {parts.schema[0].dataType.simpleString()}, {COUNTS}")
    return out.withColumnRenamed("id", id_col)


def section_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """One row per section of each text: its number, character span, n_tokens and weighted_tokens."""
    return _counted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("value")), path, id_col, lambda t: (t or "").split(separator), separator)


def field_counts(rows: DataFrame, path: str, id_col: str, fields: list[str], separator: str = "\n") -> DataFrame:
    """Tokens of each of several text columns, encoded as one document in the order given; fields may hold the separator."""
    values = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    counts = _counted(rows.select(F.col(id_col).alias("id"), values.alias("value")), path, id_col, list, separator)
    return counts.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), (F.col("section") + 1).cast("int")))
