"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A run of letters longer than ``WORD_CHARS`` is read as half-overlapping pieces, each a
word. Each word enters as two vectors: one learned for the word and the sum of those learned
for its character n-grams, so that unseen forms of a known stem still count. Windows of
``SPAN`` words, each overlapping the next by half, run through gated units in both
directions; attention pools their states into a logit. A document's score is that of
its highest window, calibrated on labelled rows kept out of training. All windows of
whole texts are scored; the products of a word's vectors and the input weights are
computed once per distinct word of a batch.

Training reads a bounded sample: at most ``PER_LABEL`` rows of each label (those whose
ids hash lowest in as many slots) and ``ROW_CHARS`` characters of each. Scores use the
text alone.

Defined cases: null, empty and wordless texts score 0; texts shorter than a window are
one window; equal texts and repeated rows get equal scores, ties of windows too; several labels of one id count as toxic if any
is; null labels aren't learned; without both labels every score is 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, slices

PER_LABEL, ROW_CHARS = 2_000, 20_000
SPAN, STRIDE = 32, 16
WORD_SLOTS, GRAM_SLOTS, DIM, HIDDEN, ATTEND = 1 << 13, 1 << 15, 8, 8, 8
GRAMS = (3, 4, 5)
#: Characters of a word that its vectors cover; longer runs of letters, as in unspaced scripts, enter as several words.
WORD_CHARS = 24
EPOCHS, BATCH, RATE = 8, 128, 0.02
WORDS = re.compile(r"[^\W\d_]+")


def pieces(word: str) -> list[str]:
    """A word, or half-overlapping pieces of ``WORD_CHARS`` characters that cover a longer one, the last full."""
    n = len(word) - WORD_CHARS
    return [word] if n <= 0 else [word[a : a + WORD_CHARS] for a in (*range(0, n, WORD_CHARS // 2), n)]


def words_of(text: str | None) -> list[str]:
    words = WORDS.findall(text.lower()) if text else []
    return words if max(map(len, words), default=0) <= WORD_CHARS else [p for w in words for p in pieces(w)]


def starts_of(n: int) -> list[int]:
    """Window starts that cover n words, the last window full."""
    return [0] if n <= SPAN else [*range(0, n - SPAN, STRIDE), n - SPAN]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word and slots of its character n-grams (slot 0: none)."""
    n = len(words)
    width = max(map(len, words), default=0) + 2
    flat = "".join(("<" + w + ">").ljust(width, "\0") for w in words)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.uint64)
    longest = int((c != 0).sum(axis=1).max()) if n else 0
    c = c[:, :longest]
    parts = []
    whole = np.zeros(n, np.uint64)
    for j in range(longest):
        whole = np.where(c[:, j] > 0, whole * np.uint64(1_000_003) + c[:, j], whole)
    mix = lambda h, slots, salt: (((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slots - 1) + np.uint64(1)
    for g in GRAMS:
        for a in range(max(0, longest - g + 1)):
            h = np.zeros(n, np.uint64)
            for j in range(g):
                h = h * np.uint64(1_000_003) + c[:, a + j]
            parts.append(np.where(c[:, a + g - 1] > 0, mix(h, GRAM_SLOTS, g), 0).astype(np.int32))
    grams = np.stack(parts, axis=1) if parts else np.zeros((n, 1), np.int32)
    return mix(whole, WORD_SLOTS, 77).astype(np.int32), grams


def squash(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {
            "word": np.zeros((WORD_SLOTS, DIM), np.float32), "gram": np.zeros((GRAM_SLOTS, DIM), np.float32),
            "wx": w(2, 2 * DIM, 3 * HIDDEN), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": w(2, HIDDEN, 3 * HIDDEN),
            "wa": w(2 * HIDDEN, ATTEND), "va": w(ATTEND, 1)[:, 0], "wo": w(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32),
        }
        self.scale = (1.0, 0.0)

    def inputs(self, slots: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Word and character vectors of distinct words."""
        chars = np.zeros((len(slots), DIM), np.float32)
        for j in range(grams.shape[1]):
            chars += self.p["gram"][grams[:, j]]
        return np.concatenate([self.p["word"][slots], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x, self.p["wx"]) + self.p["bx"]

    def run(self, proj: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; ids (windows, span) index the rows of proj (2, words, 3 x hidden)."""
        p, h3 = self.p, HIDDEN
        n, span = ids.shape
        h = np.zeros((2, n, h3), np.float32)
        states = np.empty((span, 2, n, h3), np.float32)
        tape = []
        x = np.empty((2, n, 3 * h3), np.float32)
        for t in range(span):
            np.take(proj[0], ids[:, t], axis=0, out=x[0])
            np.take(proj[1], ids[:, span - 1 - t], axis=0, out=x[1])
            hu = np.matmul(h, p["u"])
            zr = squash(x[..., : 2 * h3] + hu[..., : 2 * h3])
            z, r = zr[..., :h3], zr[..., h3:]
            un = hu[..., 2 * h3 :]
            c = np.tanh(x[..., 2 * h3 :] + r * un)
            if keep:
                tape.append((h, z, r, un, c))
            h = c + z * (h - c)
            states[t] = h
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # span, n, 2 x hidden
        hidden = np.tanh(both @ p["wa"])
        e = hidden @ p["va"]
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, (tape, both, hidden, a, pooled)) if keep else logit

    def gradients(self, words: tuple, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, h3 = self.p, HIDDEN
        slots, grams = words
        x = self.inputs(slots, grams)
        proj = self.project(x)
        logit, (tape, both, hidden, a, pooled) = self.run(proj, ids, keep=True)
        n, span = ids.shape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((squash(logit) - y) * weight / n).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["wo"]
        da = np.einsum("nh,tnh->tn", dpool, both)
        de = a * (da - (a * da).sum(axis=0))
        dboth = a[:, :, None] * dpool
        dhid = (de[:, :, None] * p["va"]) * (1 - hidden**2)
        g["va"] = np.einsum("tn,tna->a", de, hidden)
        g["wa"] = np.einsum("tnh,tna->ha", both, dhid)
        dboth = dboth + dhid @ p["wa"].T
        dstate = np.stack([dboth[:, :, :h3], dboth[::-1, :, h3:]], axis=1)  # span, 2, n, hidden
        dh = np.zeros((2, n, h3), np.float32)
        dproj = np.zeros_like(proj)
        for t in range(span - 1, -1, -1):
            h, z, r, un, c = tape[t]
            dh = dh + dstate[t]
            dz = dh * (h - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * un * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), dhu)
            dx = np.concatenate([dz, dr, dc], axis=2)
            np.add.at(dproj[0], ids[:, t], dx[0])
            np.add.at(dproj[1], ids[:, span - 1 - t], dx[1])
            dh = dh * z + np.matmul(dhu, p["u"].transpose(0, 2, 1))
        g["bx"] = dproj.sum(axis=1, keepdims=True)
        g["wx"] = np.matmul(x.T, dproj)
        dx = np.matmul(dproj, p["wx"].transpose(0, 2, 1)).sum(axis=0)
        np.add.at(g["word"], slots, dx[:, :DIM])
        for j in range(grams.shape[1]):
            np.add.at(g["gram"], grams[:, j], dx[:, DIM:])
        g["gram"][0] = 0
        return g

    def fit(self, windows: list[list[str]], y: np.ndarray, weight: np.ndarray, seed: int = 3) -> None:
        """Adam over windows, whose words are padded in front by an empty word."""
        index: dict[str, int] = {"": 0}
        ids = np.zeros((len(windows), SPAN), np.int32)
        for i, w in enumerate(windows):
            ids[i, SPAN - len(w) :] = [index.setdefault(x, len(index)) for x in w]
        slots, grams = word_features(list(index))
        slots[0], grams[0] = 0, 0
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = r.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                used, local = np.unique(ids[pick], return_inverse=True)
                g = self.gradients((slots[used], grams[used]), local.reshape(len(pick), SPAN), y[pick], weight[pick])
                step += 1
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-5)).astype(np.float32)

    def highest(self, docs: list[list[str]]) -> np.ndarray:
        """Largest logit over all windows of each document; -inf without words."""
        out = np.full(len(docs), -np.inf)
        index: dict[str, int] = {}
        ids = [np.array([index.setdefault(w, len(index)) for w in d], np.int32) for d in docs]
        if not index:
            return out
        names = list(index)
        proj = np.empty((2, len(names), 3 * HIDDEN), np.float32)
        for a in range(0, len(names), 8192):
            proj[:, a : a + 8192] = self.project(self.inputs(*word_features(names[a : a + 8192])))
        spans: dict[int, list[tuple[int, int]]] = {}
        for i, d in enumerate(ids):
            if len(d):
                spans.setdefault(min(len(d), SPAN), []).extend((i, s) for s in starts_of(len(d)))
        for span, at in spans.items():
            for a in range(0, len(at), 2048):
                part = at[a : a + 2048]
                logit = self.run(proj, np.stack([ids[i][s : s + span] for i, s in part]))
                np.maximum.at(out, [i for i, _ in part], logit)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        top = self.highest([words_of(t) for t in texts])
        a, b = self.scale
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(top), squash(np.clip(a * np.where(np.isfinite(top), top, 0) + b, -60, 60)), 0.0)


def fit(texts: list[str], labels: list[int]) -> Network | None:
    """A network for the texts, or None without both labels.

    A fifth of the rows is kept out for calibration. Which window of a text is learned is
    first chosen by the log odds of its words and n-grams, then by the network itself.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    docs = [words_of(t) for t in texts]
    keep = [i for i, d in enumerate(docs) if d]
    if len({int(y[i]) for i in keep}) < 2:
        return None
    docs, y = [docs[i] for i in keep], y[keep]
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in d]) for d in docs]
    _, grams = word_features(list(index))
    seen = np.zeros((2, GRAM_SLOTS))
    for d, k in zip(ids, y.tolist()):
        seen[k][np.unique(grams[np.unique(d)])] += 1
    share = (seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1.0)
    odds = np.log(share[1] / share[0])
    odds[0] = 0
    by_word = odds[grams].max(axis=1)
    r = np.random.default_rng(11)
    calib = np.zeros(len(docs), bool)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        calib[r.permutation(own)[: len(own) // 5]] = True
    train = np.flatnonzero(~calib)

    def learn(picked: dict[int, list[int]]) -> Network:
        net = Network()
        windows = [(docs[i][s : s + SPAN], y[i]) for i in picked for s in picked[i]]
        labels = np.array([k for _, k in windows], np.float32)
        share = max(1, labels.sum()) / len(labels)
        net.fit([w for w, _ in windows], labels, np.where(labels > 0, 0.5 / share, 0.5 / max(1e-3, 1 - share)).astype(np.float32))
        return net

    def by_odds(i: int, s: int) -> float:
        return float(np.sort(by_word[ids[i][s : s + SPAN]])[-3:].sum())

    picked = {}
    for i in train.tolist():
        starts = starts_of(len(docs[i]))
        ranked = sorted(starts, key=lambda s: -by_odds(i, s))
        picked[i] = ranked[:1] if y[i] else list({ranked[0], starts[int(r.integers(len(starts)))]})
    net = learn(picked)
    top = net.highest([docs[i] for i in np.flatnonzero(calib)]) if calib.any() else np.zeros(0)
    if len(set(y[calib].tolist())) == 2:
        net.scale = calibrate(top, y[calib])
    return net


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with a mild prior towards the identity."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = squash(a * x + b)
        w = p * (1 - p)
        ga, gb = ((p - y) * x).sum() + 0.5 * (a - 1), (p - y).sum() + 0.05 * b
        haa, hab, hbb = (w * x * x).sum() + 0.5, (w * x).sum(), w.sum() + 0.05
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a - 0.5 * da), b - 0.5 * db
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Network | None:
    """Fit on at most ``per_label`` rows of each label whose labels may be learned."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    h = F.xxhash64("id")
    picked = known.groupBy("y", F.pmod(h, F.lit(per_label)).alias("slot")).agg(F.min_by("id", h).alias("id")).collect()
    y = {r["id"]: int(r["y"] > 0) for r in picked}
    if not y:
        return None
    rows = docs.where(F.col(id_col).isin(list(y)) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.substring(F.col(text_col), 1, ROW_CHARS).alias("t"))
    have = {r["id"]: r["t"] for r in rows.groupBy("id").agg(F.min("t").alias("t")).collect()}
    ids = sorted(have)
    return fit([have[i] for i in ids], [y[i] for i in ids])


_loaded: dict[str, Network | None] = {}


def score(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row and its score."""
    # a network of a fixed size: the broadcast doesn't grow with the rows
    packed, key = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(net), 1)), uuid.uuid4().hex
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = pickle.loads(zlib.decompress(packed.value))
        m = _loaded[key]
        for batch in batches:
            for part in slices(batch, 0, 1000):
                got = m.score(part.column(0).to_pylist()) if m else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(got, pa.float64())], names=[*names, "score"])

    picked = docs.select(F.col(text_col), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{ddl}score double").toDF(*keep, *fresh(keep, "score"))
