"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is reduced to its lower-cased letters and digits. Each run of ``k`` characters has
a rolling hash; of every ``w`` neighbouring hashes the smallest is chosen, the rightmost
of equals, and kept with its position. Two texts that share a run of at least
``k + w - 1`` kept characters therefore share a chosen hash. A choice is one long:
31 bits of hash above 31 bits of falling position, so that one integer minimum picks
both. Windows are worked off in blocks inside the row, which bounds what a long text
needs besides its own bytes and choices.

Defined cases: null text is the empty text; texts of fewer than ``k`` kept characters have
one hash of all they have, and fewer hashes than ``w`` make one window; two texts
without any kept character are alike (1.0); equal texts have equal fingerprints; rows with
equal ids follow each other in text order; null ids come first; the next document of a
lone row is itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 8, 8
#: Windows in a block.
BLOCK = 2048
TOP = 0x7FFFFFFF
#: Bits of a hash that take part in a choice.
UPPER = TOP << 32


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def kept_text(text: Column) -> Column:
    """Lower-cased letters and digits; the one letter whose lower case depends on its neighbours is folded first,
    so that the kept text of two joined texts is that of the first and that of the second."""
    folded = F.translate(F.coalesce(text, F.lit("")), "\u03a3\u03c2", "\u03c3\u03c3")
    return F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", "")


def _with_later(values: Column, step: int, merge) -> Column:
    """Each entry merged with the one ``step`` places on, which is null past the end."""
    return let(values, lambda g: F.zip_with(g, F.slice(g, F.lit(1 + step), F.size(g)), merge))


def _shifted(step: int):
    return lambda x, y: F.shiftleft(x, step).bitwiseXOR(y)


def rolling_hashes(chars: Column, k: int) -> Column:
    """Polynomial hash of ``k`` characters from every character on; null where fewer are left.

    Each character's 64 bits are shifted by one bit for each character that follows, and xored: the
    upper half, from which choices are made, has bits of all ``k`` (at most 32) of them. The hash of
    twice as many is that of the first half, shifted by its length, xor that of the second.
    """
    out, reach = F.transform(chars, lambda c: F.xxhash64(c)), 1
    while reach < k:
        out = _with_later(out, reach, _shifted(reach))
        reach *= 2
    return out


def _min_of_windows(cells: Column, w: int) -> Column:
    """Smallest of each ``w`` entries from every entry on, by doubling the reach."""
    out, reach = cells, 1
    while reach < w:
        step = min(reach, w - reach)
        out = _with_later(out, step, lambda x, y: F.least(x, y))
        reach += step
    return out


def choices(kept: Column, k: int = K, w: int = W, first: Column | None = None) -> Column:
    """Choices of all windows from window ``first`` on, in order and without repeats."""
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    first = F.lit(0) if first is None else first

    def chosen(chars: Column) -> Column:
        # an empty text splits into one empty string, which is too short as well
        n = F.size(chars)
        grams = F.greatest(n - F.lit(k - 1), F.lit(1))
        windows = F.greatest(grams - F.lit(w - 1), F.lit(1))

        def block(start: Column) -> Column:
            count = F.least(F.lit(BLOCK), windows - start)
            part = F.slice(chars, start + F.lit(1), count + F.lit(w + k - 2))
            hashed = F.slice(rolling_hashes(part, k), F.lit(1), F.least(count + F.lit(w - 1), grams - start))
            hashed = F.when(n < k, F.array(F.xxhash64(kept))).otherwise(hashed)
            last = (F.lit(TOP) - start).cast("long")
            cells = let(hashed, lambda h: F.zip_with(h, F.sequence(last, last - F.size(h) + 1, F.lit(-1).cast("long")), lambda x, at: x.bitwiseAND(F.lit(UPPER)).bitwiseOR(at)))
            return F.array_distinct(F.slice(_min_of_windows(cells, w), F.lit(1), count))

        starts = F.when(first < windows, F.sequence(first, F.greatest(windows - F.lit(1), first), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(starts, block)))

    return let(F.split(kept, ""), chosen)


def hash_of(choice: Column) -> Column:
    return F.shiftright(choice, 32).cast("int")


def position_of(choice: Column) -> Column:
    return (F.lit(TOP) - choice.bitwiseAND(F.lit(TOP).cast("long"))).cast("int")


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared hashes over the hashes of both (Dice), of two distinct hash arrays."""
    return F.size(F.array_intersect(a, b)) * F.lit(2.0) / (F.size(a) + F.size(b))


def digest(chosen: Column) -> Column:
    """128 bits over hashes and positions as 32 hex digits."""
    one, two = F.xxhash64(chosen), F.xxhash64(F.lit("second"), chosen)
    return F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``id_col`` and choices: array<struct<hash int, position int>> of each row, positions in kept characters."""
    chosen = choices(F.col("kept"), k, w)
    return docs.select(F.col(id_col), kept_text(F.col(text_col)).alias("kept")).select(
        id_col, F.transform(chosen, lambda c: F.struct(hash_of(c).alias("hash"), position_of(c).alias("position"))).alias("choices")
    )


def with_next(docs: DataFrame, id_col: str, prepare, lead: list[str]) -> DataFrame:
    """Each row of ``docs`` (id and text ``t``) with the row that follows it by id as struct ``nxt``.

    Rows are dealt by ranges of ids whose bounds are ids of rows, taken from approximate
    quantiles (a bounded number, twice the shuffle partitions). Each range also gets a
    copy of the row that starts the range after it, the last one that of the first, so
    no row needs more than its own range. ``prepare`` adds columns after the shuffle.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    steps = [i / parts for i in range(parts)]
    cut = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, steps, max(10_000, 4 * parts)).alias("cuts")).first()
    bounds = sorted({cut["low"], *(cut["cuts"] or [])} - {None}) or [0]
    wide = 32
    fine = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::wide]])
    jump = F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("key"))) - 1, F.lit(0)) * wide
    part = jump + F.size(F.filter(F.slice(fine, jump + 1, F.lit(wide)), lambda b: b <= F.col("key")))
    before = F.when(F.col("part") == 1, F.lit(len(bounds))).otherwise(F.col("part") - 1)
    starts = F.array_contains(fine, F.col("key"))
    rows = docs.select(key.alias("key"), id_col, "t").withColumn("part", part).withColumn("starts", starts)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    rows = rows.select("key", id_col, "t", F.explode(F.when(F.col("starts"), F.array(own, F.struct(before.alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(own))).alias("to"))
    rows = prepare(rows.select("key", id_col, "t", "to.part", "to.extra").repartition("part"))
    order = Window.partitionBy("part").orderBy("extra", "key", "t")
    return rows.select("*", F.lead(F.struct(*lead)).over(order).alias("nxt")).where("not extra")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    The edited text ends in the start of the next one: its last quarter of code points is
    replaced by as many of the next document's first. Windows that lie wholly in characters
    that both texts begin with are not hashed again.
    """
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def prepare(rows: DataFrame) -> DataFrame:
        n = F.char_length("t")
        rows = rows.withColumn("n", n).withColumn("cut", F.floor(n / 4).cast("int"))
        rows = rows.withColumn("head", F.substring("t", F.lit(1), F.col("n") - F.col("cut"))).withColumn("hkept", kept_text(F.col("head")))
        kept = F.concat("hkept", kept_text(F.substring("t", F.col("n") - F.col("cut") + 1, F.col("cut"))))
        rows = rows.withColumn("chosen", let(kept, lambda x: choices(x, k, w)))
        return rows.withColumn("set", hashes(F.col("chosen")))

    rows = with_next(texts, id_col, prepare, ["t", "set"])
    rows = rows.withColumn("piece", F.substring("nxt.t", F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", F.concat("head", "piece")).withColumn("ekept", F.concat("hkept", kept_text(F.col("piece"))))
    # the first `early` windows lie in shared characters: what they choose lies before `early` or is chosen again from `again` on
    rows = rows.withColumn("early", F.greatest(F.char_length("hkept") - F.lit(k + w - 2), F.lit(0)).cast("int"))
    again = choices(F.col("ekept"), k, w, F.greatest(F.col("early") - F.lit(w - 1), F.lit(0)))
    known = F.filter("chosen", lambda c: position_of(c) < F.col("early"))
    rows = rows.select(id_col, "n", "edited", "chosen", "set", F.col("nxt.set").alias("next_set"), F.array_distinct(F.concat(known, again)).alias("echosen"))
    rows = rows.withColumn("eset", hashes(F.col("echosen")))
    return rows.select(
        id_col,
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("echosen")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("eset")).alias("near_edited"),
        likeness(F.col("set"), F.col("next_set")).alias("near_next"),
        F.size("chosen").cast("long").alias("n_choices"),
    )
