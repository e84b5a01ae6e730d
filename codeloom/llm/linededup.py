"""Line dedup by pairwise alignment.

Documents that share a rare line (or two lines in a row) are paired, each later one with
the earliest that holds the line, so pairs grow with the lines and not with the square
of a group. Each pair is aligned by patience diff over its line hashes; a run of aligned
lines of at least ``min_words`` words is a common block and is deleted from the later
document. The earliest holder always keeps its copy.

A line that more than ``RARE`` places hold and that is shorter than a block doesn't pair
documents by itself: a block that has only such lines has two of them in a row, and such
a couple pairs documents at any frequency.

An alignment keeps the order and pairs are few, so passages that were moved or repeated,
or whose lines have different earliest holders, can be left. They are found by whole runs:
the shortest runs of ``min_words`` words from each line and up to each line cover every
block, and each that an earlier document holds is deleted. So no block is missed.

Defined cases: null text stays null; blank lines are never part of a block but don't break
one; documents are ordered by id, null first, then by a hash of the text; rows of equal id
and text are one document and keep or lose the same lines; lines are compared without outer
white space; repeats inside one document stay; texts and lines of any length enter whole; an
empty table gives an empty result; extra columns are kept by ``dedup``, and where they are
called like the columns that it adds, these get an underscore.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, scratch, slices

MIN_WORDS = 20
RARE = 64
NO_ID = -(2**63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_table(docs: DataFrame) -> DataFrame:
    """(id, h) of each document with hash, word count and number of its lines that aren't blank."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in (part for whole in batches for part in slices(whole, 2, 2000)):
            hashes, words, places = [], [], []
            for text in batch.column(2):
                h, w, p = [], [], []
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    if line := line.strip():
                        h.append(_signed(digest(line.encode("utf-8"))))
                        w.append(len(line.split()))
                        p.append(i)
                hashes.append(h)
                words.append(w)
                places.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))],
                names=["id", "h", "hashes", "words", "places"],
            )

    return docs.select("id", "h", "t").mapInArrow(run, "id long, h long, hashes array<long>, words array<int>, places array<int>")


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose second members rise; the first members rise already."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences.

    Equal ends are aligned first; then lines that occur once in both ranges, by their
    longest rising subsequence, and the ranges between them in turn. A range without
    such lines aligns equal lines occurrence by occurrence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a: dict[int, list[int]] = {}
        in_b: dict[int, list[int]] = {}
        for i in range(al, ah):
            in_a.setdefault(a[i], []).append(i)
        for j in range(bl, bh):
            if b[j] in in_a:
                in_b.setdefault(b[j], []).append(j)
        single = sorted((in_a[x][0], js[0]) for x, js in in_b.items() if len(js) == 1 and len(in_a[x]) == 1)
        if not single:
            out += _longest_rising(sorted(p for x, js in in_b.items() for p in zip(in_a[x], js)))
            continue
        i0, j0 = al, bl
        for i, j in [*_longest_rising(single), (ah, bh)]:
            if i < ah:
                out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions in ``b`` of aligned blocks of at least ``min_words`` words."""
    known = set(a)
    if sum(w for x, w in zip(b, words) if x in known) < min_words:
        return []
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= min_words:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


def shortest_runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Ranges (start, end) of the shortest runs of at least ``min_words`` words from each line and up to each line.

    They depend on the lines inside alone and their union covers any longer run.
    """
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    out = set()
    for i in range(len(words)):
        if (j := bisect_left(total, total[i] + min_words)) < len(total):
            out.add((i, j))
        if total[i + 1] >= min_words:
            out.add((bisect_right(total, total[i + 1] - min_words) - 1, i + 1))
    return sorted(out)


def run_table(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, h, run, at, size): hash and range of each shortest run of each document."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows, runs, starts, sizes = [], [], [], []
                for k, (x, w) in enumerate(zip(*(batch.column(c).slice(a, 1000) for c in (2, 3))), a):
                    packed = np.array(x.as_py(), "<i8").tobytes()
                    for i, j in shortest_runs(w.as_py(), min_words):
                        rows.append(k)
                        runs.append(_signed(digest(packed[8 * i : 8 * j])))
                        starts.append(i)
                        sizes.append(j - i)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(runs, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["id", "h", "run", "at", "size"])

    return lines.select("id", "h", "hashes", "words").mapInArrow(run, "id long, h long, run long, at int, size int")


def held_runs(lines: DataFrame, min_words: int, put) -> DataFrame:
    """(id, h, line): numbers of the lines of each document in runs that an earlier document holds."""
    runs = run_table(lines, min_words)
    # with the earliest holder alone there is nothing to delete
    held = runs.groupBy("run").agg(F.min(F.struct("id", "h")).alias("first"), F.max(F.struct("id", "h")).alias("last")).where("first < last").select("run", "first")
    held = put(held, "held_runs")
    found = runs.join(held.hint("merge"), "run").where(F.col("first") < F.struct("id", "h"))
    covered = found.select("id", "h", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("j")).distinct()
    covered = covered.groupBy("id", "h").agg(F.collect_list("j").alias("js"))
    places = lines.select("id", "h", "places").dropDuplicates(["id", "h"])
    both = covered.join(places.hint("merge"), ["id", "h"])
    return both.select("id", "h", F.explode(F.transform("js", lambda j: F.get("places", j))).alias("line"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("h")]


# Joins are sort-merge joins at every size: tables of lines grow with the rows and are never broadcast.


def cuts(docs: DataFrame, put, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, cut array<int>): numbers of the lines that each document loses; ``put`` writes intermediate tables."""
    lines = put(line_table(docs.select(*_keyed(docs, id_col, text_col), F.col(text_col).alias("t")).where("t is not null")), "lines")
    single = F.transform("hashes", lambda x, i: F.struct(x.alias("seed"), F.get("words", i).alias("w")))
    couple = F.transform(F.slice("hashes", 2, F.greatest(F.size("hashes") - 1, F.lit(0))), lambda y, i: F.struct(F.xxhash64(F.get("hashes", i), y).alias("seed"), F.lit(min_words).alias("w")))
    seeds = lines.select("id", "h", F.explode(F.concat(single, couple)).alias("s")).select("id", "h", "s.seed", "s.w")
    held = seeds.groupBy("seed").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))
    held = held.where(f"(first < last or h0 < h1) and (n <= {RARE} or w >= {min_words})").select("seed", "first", (F.col("first") == F.col("last")).alias("tied"))
    # written first, so that both sides of the join are plain shuffles and a hot line's can be split
    held = put(held, "held")
    pairs = seeds.select("seed", "id", "h").join(held.hint("merge"), "seed").where("first < id or tied").select("first", "id", "h").distinct()
    a = lines.select(F.col("id").alias("first"), F.col("h").alias("first_h"), F.col("hashes").alias("a"))
    b = lines.select("id", "h", F.col("hashes").alias("b"), "words", "places")
    both = pairs.join(b.hint("merge"), ["id", "h"]).join(a.hint("merge"), "first").where("first < id or (first = id and first_h < h)")

    def align(batches):
        for batch in batches:
            keep, cut = [], []
            for k, (x, y, w, p) in enumerate(zip(*(batch.column(c) for c in range(2, 6)))):
                if found := common_blocks(x.as_py(), y.as_py(), w.as_py(), min_words):
                    at = p.as_py()
                    keep.append(k)
                    cut.append([at[j] for j in found])
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(cut, pa.list_(pa.int32()))], names=["id", "h", "cut"])

    found = both.select("id", "h", "a", "b", "words", "places").mapInArrow(align, "id long, h long, cut array<int>")
    each = found.select("id", "h", F.explode("cut").alias("line")).unionByName(held_runs(lines, min_words, put)).distinct()
    return each.groupBy("id", "h").agg(F.array_sort(F.collect_list("line")).alias("cut"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shortened texts, then n_lines, cut (line numbers) and blank (nothing but white space is left)."""
    with scratch(docs.sparkSession) as put:
        gone = materialize(cuts(docs, put, id_col, text_col, min_words), "cuts")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), dict(zip(docs.columns, names))
    rows = plain.select("*", *_keyed(plain, at[id_col], at[text_col])).join(gone.hint("merge"), ["id", "h"], "left").select(*names, "cut")
    where = names.index(at[text_col])

    def shorten(batches):
        for batch in (part for whole in batches for part in slices(whole, where, 2000)):
            texts, counts, blank = [], [], []
            for text, cut in zip(batch.column(where), batch.column(len(names))):
                text, cut = text.as_py(), cut.as_py()
                parts = text.split("\n") if text is not None else []
                counts.append(len(parts))
                if cut:
                    out = set(cut)
                    parts = [p for i, p in enumerate(parts) if i not in out]
                texts.append(None if text is None else "\n".join(parts))
                blank.append(not any(p.strip() for p in parts))
            cols = batch.columns[:-1]
            cols[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, batch.column(len(names)), pa.array(counts, pa.int64()), pa.array(blank, pa.bool_())], names=[*names, "cut", "n_lines", "blank"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = rows.mapInArrow(shorten, f"{ddl}, cut array<int>, n_lines long, blank boolean")
    return out.select(*names, "n_lines", F.coalesce("cut", F.array().cast("array<int>")).alias("cut"), "blank").toDF(*docs.columns, *fresh(docs.columns, "n_lines", "cut", "blank"))
