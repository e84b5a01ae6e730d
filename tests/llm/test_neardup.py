"""The near-duplicate stage against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm import neardup, simhash


def brute_kept(rows, words=5, least=0.8):
    """Ids kept by single linkage over all pairs."""
    sets = [set(simhash.shingle_hashes(t, words).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = sets[i] | sets[j]
            if not union or 10 * len(sets[i] & sets[j]) >= 10 * least * len(union):
                root[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append((k is None, k or 0, k))
    return sorted((min(g)[2] is None, min(g)[2] or 0) for g in groups.values())


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def sample():
    r = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 40, 150]))]
        rows += [" ".join(edited(r, base, r.choice([0, 1, 1, 2, 4]))) for _ in range(6)]
    # a passage that many texts hold, at similarities around the bound: groups that need several rounds
    passage = [f"p{k}" for k in range(60)]
    rows += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.choice([3, 6, 9, 14]))]) for _ in range(50)]
    rows += [None, "", " \n", "one two", "One TWO", "a b c d e", "a b c d f"]
    r.shuffle(rows)
    return [(None if i == 5 else i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("hubs", "shared"), [(32, 0.125), (3, 0.5)])
def test_keep_one_by_all_pairs(spark, monkeypatch, hubs, shared):
    """Any number of rounds and any length of the first prefix give the same rows."""
    monkeypatch.setattr(neardup, "HUBS", hubs)
    monkeypatch.setattr(neardup, "SHARED", shared)
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in neardup.keep_one(df).collect())
    assert got == brute_kept(rows)
    clashing = df.select(*df.columns, *[F.lit(1).alias(c) for c in ("row", "n", "s", "rank", "root", "c0")])
    assert neardup.keep_one(clashing).columns == clashing.columns
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    one = " ".join([*base[:100], "changed", *base[101:]])
    far = " ".join(edited(r, base, 30))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, one), (3, far)], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3]
