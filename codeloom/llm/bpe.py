"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list.

Every pre-token starts as a linked list of byte symbols. A heap holds the rank and
the left position of each adjacent pair that the merge table knows; the lowest rank
(leftmost first) is popped, skipped when stale (a side is gone or the pair there has
another rank by now), else merged, which unlinks the right symbol and queues the two
new pairs. Decoding concatenates vocabulary strings and maps them back to bytes.

Defined cases: null text is the empty text; empty text has no ids; texts of any length
are encoded whole; equal texts give equal ids; rows repeat as they come, also under tied
ids; an empty table gives an empty result; columns other than the named id and text columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The split pattern of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern's library counts as white space.
SPACE = r"\p{White_Space}"
#: Texts of these characters alone can be split by the standard library's faster engine, with the same pieces.
COMMON = re.compile("[\t-\r -~\u00c0-\u024f\u2010-\u2027\u20ac]*")
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
COMMON_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
#: Distinct pre-tokens (of at most 64 characters) in each of the two generations whose ids one worker remembers, some
#: 50 MB in all; results don't depend on it.
WORDS_KEPT = 120_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in names)
    names |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.byte_id = [vocab[c] for c in alphabet]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault(vocab[a] << 24 | vocab[b], (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.piece_len = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.split = regex.compile(SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in word.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [p[0] << 32 | i for i in range(n - 1) if (p := pairs.get(ids[i] << 24 | ids[i + 1]))]
        heapify(queue)
        while queue:
            top = heappop(queue)
            left = top & 0xFFFFFFFF
            a = ids[left]
            if a < 0 or (right := after[left]) >= n:
                continue
            found = pairs.get(a << 24 | ids[right])
            if found is None or found[0] != top >> 32:
                continue
            merged = ids[left] = found[1]
            ids[right] = -1
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                if p := pairs.get(merged << 24 | ids[far]):
                    heappush(queue, p[0] << 32 | left)
            near = before[left]
            if near >= 0 and (p := pairs.get(ids[near] << 24 | merged)):
                heappush(queue, p[0] << 32 | near)
        return [i for i in ids if i >= 0]

    def _learn(self, word: str) -> bytes:
        if len(self.known) >= WORDS_KEPT:
            self.known, self.older = {}, self.known
        packed = self.older.get(word) or struct.pack(f"<{len(ids := self.merge(word))}I", *ids)
        if len(word) <= 64:
            self.known[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        words = (COMMON_SPLIT if COMMON.fullmatch(text) else self.split).findall(text)
        get, learn = self.known.get, self._learn
        return b"".join([get(w) or learn(w) for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if self.specials is None or not self.specials.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode and decode each text: id, n_tokens, digests of ids and decoded text, and the ids and decoded text themselves on demand."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(pa.field("ids", pa.list_(pa.int64())))
        ddl += ", ids array<long>"
    if keep_text:
        fields.append(pa.field("decoded", pa.string()))
        ddl += ", decoded string"

    def run(batches):
        c = codec(path)
        for batch in (part for whole in batches for part in slices(whole, 1, 2000)):
            cols = {f.name: [] for f in fields}
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                back = c.decode(ids)
                cols["n_tokens"].append(len(ids))
                cols["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if keep_ids:
                    cols["ids"].append(ids.astype(np.int64))
                if keep_text:
                    cols["decoded"].append(back)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[f.name], f.type) for f in fields)], names=[id_col, *cols])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, {ddl}")
