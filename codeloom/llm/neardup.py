"""Near-duplicate groups of whole texts: SimHash balls, completed to a Jaccard similarity of word shingles.

Shingles and fingerprints are those of ``simhash``, of five words. Colliding fingerprints
(two bits at most) are verified by the whole shingle sets and linked if these are similar
enough. Texts of similarity 0.8 differ in some ten of 64 bits, and balls of half that
radius have millions of variants; so what the balls can't reach is completed by prefixes:

* Two sets of similarity t share at least l of their first n - ceil(t n) + l shingles in any
  fixed order. Rows with too few shared shingles among these have no partner and are left
  out; so are those with fewer than t n shared shingles once all sets of the rest are counted.
* Of the rest, sets ordered by rising frequency share one of their first n - ceil(t n) + 1
  shingles, at positions that leave room for the overlap. Rows that meet there are
  candidates: first each with the smallest row of its group; then, in groups that still hold
  several components, with a share of the group that grows 32-fold, up to all of it. Pairs
  whose parities of shingles in ``SLOTS`` slots differ more than similar sets may are left out.

Nothing is lost on the way, so rows of one component are exactly those that a chain of
similar pairs joins. Groups are counted with a map-side combine and joined, never gathered.

Defined cases: null, empty and blank texts have the empty set, which equals only itself;
texts of fewer words than a shingle are one shingle; texts of any length enter whole;
repeated rows and ties of ids keep one row; a null id comes after all others; an empty
table gives an empty result; extra columns are kept, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import components

from .common import materialize, scratch
from .simhash import ball_links, fingerprint, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Part of the least overlap that must be shared in the first prefix.
SHARED = 0.125
#: Part of a group that is paired in the second round, in rows, and its growth from round to round.
HUBS = 32
#: Slots of parities, in longs of 64.
SLOTS = 512
#: Rows of one Arrow slice in Python, which bounds a worker's memory.
SLICE = 1_000
#: For products that aren't exact in binary.
EPS = 1e-9


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(hashes.astype(np.uint64).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def parities(s: np.ndarray) -> list[int]:
    """Bits that tell whether a slot has an odd number of shingles: two sets differ in as many shingles at least as in bits."""
    return np.packbits((np.bincount(s & (SLOTS - 1), minlength=SLOTS) & 1).astype(np.uint8)).view(np.int64).tolist()


def overlap(n: int, least: float) -> int:
    """Shingles that a set of n shares with any similar set, at least."""
    return math.ceil(least * n - EPS)


def shared_in_prefix(n: int, least: float) -> int:
    return max(1, int(SHARED * overlap(n, least)))


def prefixes(plain: DataFrame, words: int, least: float) -> DataFrame:
    """row, size of the set, first shingles and how many of these a similar set must share, for each row of ``plain``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes, needs, firsts = [], [], []
                for t in part.column(0):
                    s = shingle_set(shingle_hashes(t.as_py(), words))
                    n = len(s)
                    sizes.append(n)
                    # a similar set may be smaller, down to the least overlap
                    needs.append(shared_in_prefix(overlap(n, least), least))
                    firsts.append(s[: n - overlap(n, least) + shared_in_prefix(n, least)])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["row", "n", "need", "prefix"])

    return plain.select("t", "row").mapInArrow(run, "row long, n int, need int, prefix array<long>")


def whole_sets(plain: DataFrame, words: int) -> DataFrame:
    """row, key of the set, its size, fingerprint, parities and shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys, fps, bits, sets = [], [], [], []
                for t in part.column(0):
                    hashes = shingle_hashes(t.as_py(), words)
                    fps.append(fingerprint(hashes))
                    sets.append(s := shingle_set(hashes))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bits.append(parities(s))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(fps, pa.int64()), pa.array(bits, longs), pa.array(sets, longs)],
                    names=["row", "key", "n", "fp", "bits", "shingles"],
                )

    return plain.select("t", "row").mapInArrow(run, "row long, key binary, n int, fp long, bits array<long>, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of rows of ``sets`` that are similar enough."""
    side = lambda x: sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s{x}")).hint("merge")
    both = pairs.select("a", "b").distinct().join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep = [similarity(x.values.to_numpy(), y.values.to_numpy()) >= least - EPS for x, y in zip(part.column(2), part.column(3))]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def ball_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of rows whose fingerprints collide: each with the first row of its fingerprint, and first rows of linked fingerprints."""
    firsts = sets.groupBy("fp").agg(F.min("row").alias("a"))
    same = sets.select("fp", F.col("row").alias("b")).join(firsts.hint("merge"), "fp").where("a <> b").select("a", "b")
    links = ball_links(firsts)
    near = links.join(firsts.select(F.col("fp").alias("a"), F.col("a").alias("x")).hint("merge"), "a").join(firsts.select(F.col("fp").alias("b"), F.col("a").alias("y")).hint("merge"), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def candidates(plain: DataFrame, put, words: int, least: float) -> DataFrame:
    """Rows that may have a similar row: with enough shared shingles among their first ones."""
    marked = put(prefixes(plain, words, least), "prefixes")
    held = marked.select("row", "need", F.explode("prefix").alias("s"))
    shared = put(held.groupBy("s").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("s"), "shared")
    # the empty sets, which share nothing, are told apart by their size alone
    found = held.join(shared.hint("merge"), "s").groupBy("row", "need").agg(F.count(F.lit(1)).alias("have")).where("have >= need").select("row")
    return put(found.unionByName(marked.where("n = 0").select("row")), "candidates")


def ordered(sets: DataFrame, put, least: float) -> DataFrame:
    """row, n and the shared shingles of each row of ``sets`` by rising frequency, where they suffice for a similar row."""
    held = sets.select("row", "n", F.explode("shingles").alias("s"))
    often = put(held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    # an array has a document's shingles at most
    rows = held.join(often.hint("merge"), "s").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    return put(rows.where(F.size("shared") >= F.expr(f"ceil({least!r}D * n - {EPS!r}D)")), "ordered")


def similar_links(sets: DataFrame, rows: DataFrame, put, least: float) -> DataFrame:
    """(node, root) of the rows of ``sets`` that a chain of similar pairs joins; ``rows`` are those of ``ordered``."""
    at_least = F.expr(f"cast(ceil({least!r}D * n - {EPS!r}D) as int)")
    # shingles that no other row holds come first, so they take the first positions of a prefix
    cut = rows.select("row", "n", (F.col("n") - F.size("shared")).alias("alone"), F.slice("shared", 1, F.size("shared") - at_least + 1).alias("first"))
    held = cut.select("row", "n", "alone", F.posexplode("first").alias("k", "x")).select(F.col("x.s").alias("s"), "row", "n", (F.col("alone") + F.col("k")).alias("at"))
    held = put(held, "firsts")
    groups = put(held.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("row", "n", "at")).alias("hub")).where("size > 1"), "groups")
    room = F.expr(f"least(n, m) >= {least!r}D * greatest(n, m) - {EPS!r}D and least(n - at, m - q) >= ceil({least / (1 + least)!r}D * (n + m) - {EPS!r}D)")
    hubbed = held.join(groups.hint("merge"), "s").select("row", "n", "at", F.col("hub.row").alias("a"), F.col("hub.n").alias("m"), F.col("hub.at").alias("q"))
    pairs = hubbed.where("row <> a").where(room).select("a", F.col("row").alias("b"))
    links = put(verified(pairs.unionByName(ball_pairs(sets)), sets, least), "similar")
    most = groups.agg(F.max("size")).first()[0] or 0
    held = held.join(groups.select("s", "size").hint("merge"), "s").join(sets.select("row", "bits").hint("merge"), "row")
    held = put(held, "grouped")
    apart = " + ".join(f"bit_count(bits[{i}] ^ abits[{i}])" for i in range(SLOTS // 64))
    near = F.expr(f"{apart} <= {(1 - least) / (1 + least)!r}D * (n + m) + {EPS!r}D")
    low, high = 0, HUBS
    while True:
        roots = components(links, "a", "b")
        if low >= most:
            return roots
        rooted = held.join(roots.select(F.col("node").alias("row"), "root").hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        mixed = put(rooted.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("s"), "mixed")
        if mixed.isEmpty():
            return roots
        rooted = put(rooted.join(mixed.hint("merge"), "s", "left_semi"), "rooted")
        place = F.pmod(F.xxhash64("row"), F.col("size"))
        hubs = rooted.where((place >= low) & (place < high)).select("s", F.col("row").alias("a"), F.col("n").alias("m"), F.col("at").alias("q"), F.col("root").alias("ra"), F.col("bits").alias("abits"))
        pairs = hubs.hint("merge").join(rooted, "s").where("ra <> root").where(room).where(near)
        found = put(verified(pairs.select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")), sets, least), "similar")
        links = links.unionByName(found)
        held, low, high = rooted.drop("root"), high, high * HUBS


def repeated(rows: DataFrame, rank: str, text: str, put, words: int, least: float) -> DataFrame:
    """(row) of the rows that aren't the first of their near-duplicate group; ``rows`` has row, a rank and a text."""
    plain = rows.select(F.col(text).alias("t"), "row")
    ranks = rows.select("row", F.col(rank).alias("rank"))
    some = candidates(plain, put, words, least)
    sets = put(whole_sets(plain.join(some.hint("merge"), "row", "left_semi"), words), "sets")
    members = put(sets.select("row", "key").join(ranks.hint("merge"), "row"), "members")
    firsts = put(members.groupBy("key").agg(F.min("rank").alias("rank")).select("rank", F.col("rank.r").alias("row")), "unequal")
    unequal = put(sets.where("n > 0").join(firsts.select("row").hint("merge"), "row", "left_semi").select("row", "n", "fp", "bits", "shingles"), "unequal_sets")
    kin = ordered(unequal, put, least)
    unequal = put(unequal.join(kin.select("row").hint("merge"), "row", "left_semi"), "kin")
    roots = similar_links(unequal, kin, put, least)
    rooted = firsts.join(roots.hint("merge"), firsts["row"] == roots["node"], "left").select(F.coalesce("root", "row").alias("root"), "rank")
    keep = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.r").alias("row"))
    return members.select("row").join(keep.hint("merge"), "row", "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that of the smallest id, then the first row.

    All columns of ``docs`` return unchanged, whatever they are called.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    key, text = F.col(names[docs.columns.index(id_col)]), names[docs.columns.index(text_col)]
    ranked = rows.withColumn("rank", F.struct(key.isNull().alias("n"), key.alias("k"), F.col("row").alias("r")))
    with scratch(docs.sparkSession) as put:
        gone = materialize(repeated(ranked, "rank", text, put, words, least), "repeated")
    return rows.join(gone.hint("merge"), "row", "left_anti").select(names).toDF(*docs.columns)
