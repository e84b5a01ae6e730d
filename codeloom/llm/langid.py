"""Language identification by cross-parsing entropy over suffix automata.

For each language one suffix automaton is built from labelled text. A text is cut
greedily into phrases, each the longest match that the automaton knows from there (one
character where it knows none); the language whose automaton needs the fewest phrases,
normalised by the letters parsed, wins. The transitions of all automata lie interleaved
in one array, so memory grows with the text learned and not with the alphabet, and many
texts step through all languages together in numpy.

Long texts step in parallel pieces that start without a phrase. Afterwards each piece
is walked again from the state that the piece before it ended in, until both walks are in
the same state; from there on they agree. So pieces leave no trace in the counts.

Learning reads a bounded sample of labelled rows: ``TRAIN_CHARS`` characters a language,
taken from the rows with the smallest hash of their text (so it doesn't depend on the
order or number of files). Everything else covers all rows and whole texts.

Defined cases: a null text or one without any letter is ``und`` with score 0; texts of
any length are parsed whole; ties go to the language that sorts first; equal texts and
repeated rows get equal results; null languages aren't learned; without any labelled text
everything is ``und``; an empty table gives an empty result; extra columns are ignored, and
where kept columns are called like the result's, these get an underscore.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, slices

#: Characters of labelled text per language that make its automaton.
TRAIN_CHARS = 24_000
#: Characters of one row that training takes at most, so that a few long rows don't make a language.
ROW_CHARS = 1_500
#: Characters that step in parallel; results don't depend on it.
PIECE = 512
#: Code points below this are folded through a table.
TABLE = 0x10000
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Each code point's lower-cased letter; 32 for anything that is no letter."""
    out = np.full(TABLE, 32, np.uint32)
    for c in range(TABLE):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    return _fold_table()


def folded(text: str) -> np.ndarray:
    """Lower-cased letters with single spaces between runs, as code points."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = cps >= TABLE
    out = fold_table()[np.where(high, 0, cps)]
    if high.any():
        out[high] = [c if chr(c).isalpha() else 32 for c in cps[high].tolist()]
    gap = out == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return out[keep]


class SuffixAutomaton:
    """All substrings of a symbol sequence; states with transitions, links and lengths."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            return cur
        q = nxt[p][c]
        if length[p] + 1 == length[q]:
            link[cur] = q
            return cur
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = link[cur] = clone
        return cur


class Transitions:
    """Transitions of many states in one array: that of state s by symbol c lies at ``base[s] + c`` if the entry names s."""

    def __init__(self, width: int):
        self.width = width
        self.base: list[int] = []
        self.free = bytearray(b"\1") * (1 << 16)
        self.owner: dict[int, tuple[int, int]] = {}
        #: where the last state of more than one transition, and of one, was put
        self.several = self.one = width

    def _room(self, symbols: list[int], at: int) -> int:
        """First slot from ``at`` on that is free, as are those of the further symbols."""
        while True:
            at = self.free.find(1, at)
            if at < 0 or at + self.width >= len(self.free):
                at = len(self.free) - self.width if at < 0 else at
                self.free.extend(b"\1" * max(len(self.free), 2 * self.width))
                continue
            first = at - symbols[0]
            if first >= 0 and all(self.free[first + c] for c in symbols):
                return at
            at += 1

    def add(self, states: list[dict[int, int]]) -> int:
        """Add an automaton; the number of its first state."""
        offset = len(self.base)
        self.base += [0] * len(states)
        for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
            if not (symbols := sorted(states[s])):
                continue
            # states of several transitions follow each other; those of one fill what they leave free
            if len(symbols) > 1:
                at = self.several = self._room(symbols, self.several)
            else:
                at = self.one = self._room(symbols, self.one)
            first = at - symbols[0]
            self.base[offset + s] = first
            for c in symbols:
                self.free[first + c] = 0
                self.owner[first + c] = (offset + s, offset + states[s][c])
        return offset

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Bases, and entries of owner and target state in one integer."""
        slots = np.full(max([*self.owner, 0, *self.base]) + self.width + 1, -1, np.int64)
        at = np.fromiter(self.owner, np.int64, len(self.owner))
        pair = np.array(list(self.owner.values()), np.int64).reshape(-1, 2)
        slots[at] = pair[:, 0] << 32 | pair[:, 1]
        return np.array(self.base, np.int64), slots


class Model:
    """Languages, symbols and the transitions of all automata. State 0 has none: no phrase has begun."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        codes = {k: np.concatenate([np.append(folded(t), 32) for t in v] or [np.zeros(0, np.uint32)]) for k, v in texts.items()}
        self.symbols = np.unique(np.concatenate([*codes.values(), np.zeros(0, np.uint32)]))
        self.width = len(self.symbols) + 1
        self.kind = np.min_scalar_type(self.width)
        joint = Transitions(self.width)
        joint.add([{}])
        #: state of each language after a phrase's first symbol; 0 where that is unknown
        self.begin = np.zeros((len(self.langs), self.width), np.int64)
        for k, lang in enumerate(self.langs):
            auto = SuffixAutomaton((np.searchsorted(self.symbols, codes[lang]) + 1).tolist())
            at = joint.add(auto.next)
            for c, s in auto.next[0].items():
                self.begin[k, c] = at + s
        self.base, self.slots = joint.arrays()
        #: symbols of the lower code points
        self.low = np.zeros(TABLE, self.kind)
        small = self.symbols < TABLE
        self.low[self.symbols[small]] = np.flatnonzero(small).astype(self.kind) + 1

    def encode(self, codes: np.ndarray) -> np.ndarray:
        if codes.size and codes.max() >= TABLE and len(self.symbols):
            at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
            return np.where(self.symbols[at] == codes, at + 1, 0).astype(self.kind)
        return self.low[np.minimum(codes, TABLE - 1)]

    def step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a phrase begins."""
        got = self.slots.take(self.base.take(state) + symbol)
        new = got >> 32 != state
        return np.where(new, self.begin.take(lang * self.width + symbol), got & 0xFFFFFFFF), new

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language."""
        langs = len(self.langs)
        out = np.zeros((len(texts), langs), np.int64)
        owner, starts = [], []
        for i, t in enumerate(texts):
            owner += [i] * -(-len(t) // PIECE)
            starts += range(0, len(t), PIECE)
        if not owner or not langs:
            return out
        owner, starts = np.array(owner), np.array(starts)
        sizes = np.minimum(PIECE, np.array([len(t) for t in texts])[owner] - starts)
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((int(sizes.max()), len(owner)), self.kind)
        for j, k in enumerate(order.tolist()):
            grid[: sizes[k], j] = texts[owner[k]][starts[k] : starts[k] + sizes[k]]
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        each = np.arange(langs)[:, None]
        state, count = np.zeros((langs, len(owner)), np.int64), np.zeros((langs, len(owner)), np.int64)
        alive = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), side="right")
        for row, live in zip(grid, alive.tolist()):
            state[:, :live], new = self.step(state[:, :live], each, row[:live].astype(np.int64))
            count[:, :live] += new
        state, count = state[:, column], count[:, column]
        end, alone = state.copy(), count.copy()
        later = np.flatnonzero(starts > 0)
        lang, piece = np.repeat(np.arange(langs), len(later)), np.tile(later, langs)
        while len(piece):
            # from the end of the piece before, until the walk without it is caught up with
            real, anew = end[lang, piece - 1], np.zeros(len(piece), np.int64)
            n_real, n_anew = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
            before = end[lang, piece]
            open_, at = np.arange(len(piece)), 0
            while True:
                met = real[open_] == anew[open_]
                done = open_[met]
                count[lang[done], piece[done]] = alone[lang[done], piece[done]] - n_anew[done] + n_real[done]
                end[lang[done], piece[done]] = state[lang[done], piece[done]]
                open_ = open_[~met]
                over = open_[sizes[piece[open_]] <= at]
                count[lang[over], piece[over]], end[lang[over], piece[over]] = n_real[over], real[over]
                open_ = open_[sizes[piece[open_]] > at]
                if not len(open_):
                    break
                symbol = grid[at, column[piece[open_]]].astype(np.int64)
                real[open_], new = self.step(real[open_], lang[open_], symbol)
                n_real[open_] += new
                anew[open_], new = self.step(anew[open_], lang[open_], symbol)
                n_anew[open_] += new
                at += 1
            # a piece that ends in another state than was taken for the next one's start
            moved = end[lang, piece] != before
            lang, piece = lang[moved], piece[moved] + 1
            inside = piece < len(owner)
            lang, piece = lang[inside], piece[inside]
            lang, piece = lang[starts[piece] > 0], piece[starts[piece] > 0]
        for k in range(langs):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        letters = np.array([int((c != 32).sum()) for c in codes])
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        # neighbours in length step together
        rate = self.phrases([self.encode(c) for c in codes]) / np.maximum(letters, 1)[:, None]
        best = rate.argmin(axis=1)
        out = []
        for i, n in enumerate(letters.tolist()):
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            r = rate[i]
            rest = np.delete(r, best[i])
            score = 1.0 if not rest.size else float(1.0 - r[best[i]] / rest.min()) if rest.min() > 0 else 0.0
            out.append((self.langs[best[i]], min(1.0, max(0.0, score))))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows that may be learned.

    Of each language the rows with the smallest text hashes in so many slots are taken that
    these hold some twice ``chars`` characters; of each row at most its first ``ROW_CHARS``.
    """
    own = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    hashed = own.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    means = {r["lang"]: r["m"] for r in hashed.groupBy("lang").agg(F.avg(F.least(F.length("t"), F.lit(ROW_CHARS))).alias("m")).collect()}
    texts: dict[str, list[str]] = {lang: [] for lang in means}
    if not means:
        return Model(texts)
    slots = F.create_map(*[F.lit(x) for lang, m in means.items() for x in (lang, int(2 * chars / m) + 8)])[F.col("lang")]
    wanted = {(r["lang"], r["h"]) for r in hashed.groupBy("lang", F.pmod("h", slots).alias("slot")).agg(F.min("h").alias("h")).collect()}
    picked = hashed.where(F.col("h").isin(sorted({h for _, h in wanted}))).select("lang", "h", F.substring("t", 1, ROW_CHARS).alias("t"))
    for r in sorted(picked.distinct().collect(), key=lambda r: (r["lang"], r["h"], r["t"])):
        have = texts[r["lang"]]
        if (r["lang"], r["h"]) in wanted and (room := chars - sum(map(len, have))) > 0:
            have.append(r["t"][:room])
    return Model(texts)


_loaded: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, then its predicted language and score."""
    spark = docs.sparkSession
    # one automaton a language, of a fixed number of characters (some 2 MB): the broadcast doesn't grow with the rows
    packed, key = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1)), uuid.uuid4().hex

    def run(batches):
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = pickle.loads(zlib.decompress(packed.value))
        m = _loaded[key]
        for batch in batches:
            for part in slices(batch, 0, 2000):
                got = m.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(F.col(text_col), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{ddl + ', ' if ddl else ''}lang_pred string, score double").toDF(*keep, *fresh(keep, "lang_pred", "score"))
