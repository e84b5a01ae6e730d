"""Line dedup against a search of all runs in all earlier documents."""

import random

from codeloom.llm import linededup


def brute_cuts(rows, min_words=20):
    """Lines of each row in a run of min_words words that a row of smaller id holds."""
    docs = {k: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for k, t in rows}
    out, seen = {}, set()
    for k in sorted(docs):
        lines = [x for _, x in docs[k]]
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(len(x.split()) for x in lines[i:j]) >= min_words]
        gone = {p for i, j in runs if tuple(lines[i:j]) in seen for p in range(i, j)}
        out[k] = sorted(docs[k][p][0] for p in gone)
        seen |= {tuple(lines[i:j]) for i, j in runs}
    return out


def cuts(spark, rows):
    return {r["doc_id"]: r["cut"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def passage(name, lines, words=7):
    return [" ".join(f"{name}{k}-{w}" for w in range(words)) for k in range(lines)]


def test_moved_repeated_and_split_passages(spark):
    p, q = passage("p", 4), passage("q", 3)
    l1, l2, l3 = passage("l", 3)
    rows = [
        (1, [*p, "between", *q]), (2, [*q, "else", *p]),
        (3, passage("r", 4)), (4, [*passage("r", 4), "again", *passage("r", 4)]),
        (5, [l1, l2, "one"]), (6, ["two", l2, l3]), (7, ["three", l1, l2, l3]), (8, ["four", l1, "", l2, l3]),
    ]
    rows = [(k, "\n".join(x)) for k, x in rows]
    got = cuts(spark, rows)
    assert got == brute_cuts(rows)
    assert got[2] == [0, 1, 2, 4, 5, 6, 7] and got[4] == [0, 1, 2, 3, 5, 6, 7, 8] and got[8] == [1, 3, 4] and got[7] == []


def test_blocks_by_brute_force(spark):
    r = random.Random(12)
    lines = [" ".join(f"w{r.randrange(9)}" for _ in range(r.choice([1, 3, 7, 12, 21]))) for _ in range(14)]
    rows = [(k, "\n".join(r.choice(["", *lines, *lines]) for _ in range(r.randrange(12)))) for k in range(150)]
    assert cuts(spark, rows) == brute_cuts(rows)
