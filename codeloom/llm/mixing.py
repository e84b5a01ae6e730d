"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. Each pattern offers
its size once at no cost and again at a rising cost per repetition (convex), each source
asks for its target; the min-cost flow through that small graph says how much of each
pattern every source takes. Documents are then taken in a seeded order: whole rounds
first, then those whose keys lie below a threshold that a distributed histogram and one
boundary bucket give exactly. Choosing is a comparison with that threshold, so texts are
never shuffled.

The driver holds patterns and sources only, at most ``MAX_PATTERNS`` of them. Documents of
more than 1/64 of what a round takes come first in it, so that the cut falls among small ones.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its
own, last in order; sources without words have target 0; rows with equal ids are taken alike;
an empty table gives an empty result; extra columns stay with the row in ``mix`` and are
ignored by ``report``.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Weights in turn over the sources, share of all words, most repeats of a document.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), Fraction(3, 2), 2
MAX_PATTERNS = 100_000
SEED = "mix-1"
BUCKET_BITS = 16
LARGE = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share=SHARE, repeats: int = REPEATS) -> dict:
    """Target of each source: shares by weight, none above ``repeats`` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > repeats * sizes[s] * total]
        if not full:
            out |= {s: Fraction(left * weight[s], total) for s in open_}
            break
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def flow(capacity: dict, quota: dict, repeats: int = REPEATS) -> dict:
    """(pattern, source) -> words, of a flow that meets the quotas as far as possible at least cost.

    ``capacity``: words of each pattern (a tuple of sources); the r-th round through a
    pattern costs r - 1 a word. Successive shortest paths with potentials.
    """
    patterns, sources = list(capacity), list(quota)
    start, end = 0, 1
    p_at = {p: 2 + i for i, p in enumerate(patterns)}
    s_at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(room)
            cost.append(price)
        return len(to) - 2

    between = {}
    for p in patterns:
        for r in range(repeats):
            arc(start, p_at[p], capacity[p], r)
        for s in p:
            if s in s_at:
                between[p, s] = arc(p_at[p], s_at[s], capacity[p] * repeats, 0)
    for s in sources:
        arc(s_at[s], end, quota[s], 0)
    potential = [0] * len(graph)
    while True:
        dist, via = {start: 0}, {}
        queue, done = [(0, start)], set()
        while queue:
            d, a = heappop(queue)
            if a in done:
                continue
            done.add(a)
            for e in graph[a]:
                if cap[e] > 0 and (n := d + cost[e] + potential[a] - potential[to[e]]) < dist.get(to[e], n + 1):
                    dist[to[e]], via[to[e]] = n, e
                    heappush(queue, (n, to[e]))
        if end not in done:
            return {k: cap[e ^ 1] for k, e in between.items() if cap[e ^ 1]}
        far = max(dist[a] for a in done)
        for a in range(len(graph)):
            potential[a] += dist[a] if a in done else far
        room, at = None, end
        while at != start:
            e = via[at]
            room = cap[e] if room is None else min(room, cap[e])
            at = to[e ^ 1]
        at = end
        while at != start:
            e = via[at]
            cap[e] -= room
            cap[e ^ 1] += room
            at = to[e ^ 1]


class Plan:
    """What the driver decides: sizes, targets and allotments, and per pattern the rounds and the cut."""

    def __init__(self, sizes, target, allotted, rules):
        self.sizes, self.target, self.allotted, self.rules = sizes, target, allotted, rules


def order_key(id_: Column, size: Column, large_from: Column) -> Column:
    """Place of a document in its round: large ones first, then by seeded hash; 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), id_.cast("string")), 3).bitwiseOR(F.when(size >= large_from, F.lit(0)).otherwise(F.lit(1 << 61)))


def _crossing(sums: DataFrame, place: str, base: Column) -> DataFrame:
    """Of each pattern the place in which the running size passes ``rest``, with the size before it."""
    upto = base + F.sum("size").over(Window.partitionBy("members").orderBy(place))
    return sums.withColumn("upto", upto).where("upto >= rest and upto - size < rest").withColumn("before", F.col("upto") - F.col("size"))


def plan(narrow: DataFrame) -> Plan:
    """Decide a mix from (id, members array<string>, size)."""
    spark = narrow.sparkSession
    sums = narrow.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r["members"]): r["size"] for r in sums}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes)
    allotted = flow(capacity, {s: int(t) for s, t in target.items()})
    rules = []
    for p, n in capacity.items():
        take = sum(allotted.get((p, s), 0) for s in p)
        rounds, rest = divmod(take, n) if n else (0, 0)
        rules.append((list(p), rounds, rest, max(1, -(-max(rest, 1) // LARGE))))
    ruled = spark.createDataFrame(rules, "members array<string>, rounds long, rest long, large_from long")
    cutting = ruled.where("rest > 0")
    shift = 62 - BUCKET_BITS
    # the table of rules has at most MAX_PATTERNS rows: small enough for every executor
    keyed = narrow.where("size > 0").join(F.broadcast(cutting), "members").select("members", "size", "rest", order_key(F.col("id"), F.col("size"), F.col("large_from")).alias("key"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", shift))
    histogram = keyed.groupBy("members", "rest", "bucket").agg(F.sum("size").alias("size"))
    # two levels, so that no window holds more than 2^8 rows of a pattern
    half = BUCKET_BITS // 2
    histogram = histogram.withColumn("coarse", F.shiftright("bucket", half))
    coarse = _crossing(histogram.groupBy("members", "rest", "coarse").agg(F.sum("size").alias("size")), "coarse", F.lit(0))
    fine = histogram.join(F.broadcast(coarse.select("members", "coarse", F.col("before").alias("base"))), ["members", "coarse"])
    cut = _crossing(fine, "bucket", F.col("base")).select("members", "bucket", "before")
    inside = keyed.join(F.broadcast(cut), ["members", "bucket"])
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("members", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    # a document belongs to the round if its middle lies before the cut
    taken = inside.withColumn("upto", upto).where("2 * upto - size <= 2 * rest").groupBy("members").agg(F.max("key").alias("last"))
    ends = {tuple(r["members"]): r["last"] for r in taken.collect()}
    lows = {tuple(r["members"]): r["bucket"] << shift for r in cut.collect()}
    final = [(m, rounds, large, ends.get(tuple(m), lows.get(tuple(m), 0) - 1) if rest else -1) for m, rounds, rest, large in rules]
    return Plan(sizes, target, allotted, spark.createDataFrame(final, "members array<string>, rounds long, large_from long, last long"))


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """id, members (one source, or an array of several) and size."""
    source = F.col(source_col)
    if dict(docs.dtypes)[source_col].startswith("array"):
        members = F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string")))))
    else:
        members = F.array(source.cast("string"))
    return [F.col(id_col).alias("id"), members.alias("members"), words(F.col(text_col)).alias("size")]


def _copies(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (id, members, size and more) with copies, the times that each is taken."""
    key = order_key(F.col("id"), F.col("size"), F.col("large_from"))
    out = rows.join(F.broadcast(rules), "members", "left")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("rounds") + F.when(key <= F.col("last"), 1).otherwise(0))
    return out.withColumn("copies", copies.cast("long")).drop("rounds", "large_from", "last")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document of one source: id, size, source_size, target, taken, copies."""
    narrow = materialize(docs.select(_facts(docs, id_col, text_col, source_col)), "sizes")
    p = plan(narrow)
    facts = docs.sparkSession.createDataFrame([([s], p.sizes[s], float(p.target[s])) for s in p.sizes], "members array<string>, source_size long, target double")
    out = _copies(narrow, p.rules).join(F.broadcast(facts), "members", "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged."""
    p = plan(materialize(docs.select(_facts(docs, id_col, text_col, source_col)), "sizes"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), dict(zip(docs.columns, names))
    taken = _copies(plain.select("*", *_facts(plain, at[id_col], at[text_col], at[source_col])), p.rules).where("copies > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*names).toDF(*docs.columns)
