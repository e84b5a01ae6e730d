"""Media columns: content-addressed payloads in tar shards, rows that point into them.

A payload is the bytes of a row padded to a multiple of 64; its stored form is an 8-bit
greyscale PNG, 64 samples wide, whose samples are the payload. A payload lies under its
SHA-256 in a tar shard of the shared folder; all rows of a payload carry the digest,
shard, offset and length of one copy, and a task stores a payload at most once. Metadata columns are filled by range reads of the PNG's first 33 bytes alone,
features by range reads of the whole stored form.

Shards are written by tasks under names that no other attempt uses, and count only once
their index row is in the index table, so a lost executor or a repeated attempt leaves
unused files but no wrong row.

Defined cases: null text is the empty text, which pads to 64 zero bytes; texts of any
length are stored whole; equal texts point at the same stored payload; rows repeat as they come; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

UNIT, WIDTH = 64, 64
#: Bytes after which a task starts another shard.
SHARD_BYTES = 64 << 20
#: Bytes of stored forms that one task reads.
READ_BYTES = 16 << 20
#: Digests that a task remembers to have stored.
SEEN = 200_000
#: The signature and the length of what precedes the samples of a PNG.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
LEVEL = 6


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload as samples of a greyscale image, one row per 64 bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """What the first 33 bytes of a PNG say."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[colour]}


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    head, at, body = read_header(data), 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head["height"], head["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit sketch of their means over an 8 x 8 grid."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    held = share[share > 0]
    cuts = np.linspace(0, len(x), 65).astype(np.int64)
    means = np.add.reduceat(x.astype(np.int64), cuts[:-1]) / np.maximum(np.diff(cuts), 1)
    bits = np.packbits(means > np.median(means)).tobytes().hex()
    return f"mean={x.mean():.3f};std={x.std():.3f};entropy={max(0.0, -(held * np.log2(held)).sum()):.4f};grid={bits}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class ShardWriter:
    """Appends members to tar shards of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = open_store(folder)
        self.out = None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        member = tarfile.TarInfo(name)
        member.size = len(data)
        head = member.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % 512
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, zero-padded to a positive multiple of 64."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.greatest(F.ceil(F.octet_length(data) / F.lit(UNIT)).cast("int"), F.lit(1)) * UNIT
    return F.rpad(data, n, F.lit(b"\x00"))


def store(docs: DataFrame, text_col: str, folder: str) -> DataFrame:
    """Write payloads and return the index: digest, shard, offset, length, one row per digest.

    Payloads are never shuffled: each task stores what it hasn't stored yet, and of the
    copies that several tasks stored the first by shard and offset is the one that counts.
    """

    def write(batches):
        seen: set[bytes] = set()
        out = ShardWriter(folder)
        try:
            for batch in batches:
                rows: dict[str, list] = {k: [] for k in ("digest", "shard", "offset", "length")}
                for text in batch.column(0):
                    payload = padded((text.as_py() or "").encode("utf-8"))
                    key = hashlib.sha256(payload).digest()
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    data = to_png(payload)
                    shard, offset = out.add(f"{key.hex()}.png", data)
                    for k, v in zip(rows, (key.hex(), shard, offset, len(data))):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows["digest"], pa.string()), pa.array(rows["shard"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], names=list(rows))
        finally:
            out.close()

    written = materialize(docs.select(F.col(text_col)).mapInArrow(write, "digest string, shard string, offset long, length long"), "media-written")
    first = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return materialize(first.select("digest", "at.shard", "at.offset", "at.length"), "media-index")


def _ranged(index: DataFrame, folder: str, take, ddl: str, whole: bool) -> DataFrame:
    """``take`` of what each index row points at: its header alone, or the whole stored form."""
    names = ["digest", *[x.split()[0] for x in ddl.split(", ")]]
    schema = pa.schema([("digest", pa.string()), *[(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in ddl.split(", ")]])

    def run(batches):
        store_, base = open_store(folder)
        name = file = None
        try:
            for batch in batches:
                out: dict[str, list] = {n: [] for n in names}
                for r in batch.to_pylist():
                    if r["shard"] != name:
                        if file is not None:
                            file.close()
                        name, file = r["shard"], store_.open_input_file(f"{base}/{r['shard']}")
                    got = take(file.read_at(r["length"] if whole else HEADER, r["offset"]))
                    out["digest"].append(r["digest"])
                    for n in names[1:]:
                        out[n].append(got[n])
                yield pa.RecordBatch.from_pydict(out, schema=schema)
        finally:
            if file is not None:
                file.close()

    # neighbours in a shard are read one after another, about READ_BYTES of stored forms in a task
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return index.repartitionByRange(max(1, -(-total // READ_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, f"digest string, {ddl}")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """Width, height, depth and channels of each stored form, from header-only range reads."""
    return _ranged(index, folder, read_header, "width int, height int, bit_depth int, channels int", whole=False)


def _examine(data: bytes) -> dict:
    payload = from_png(data)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature(payload),
    }


def examined(index: DataFrame, folder: str) -> DataFrame:
    """Digests and features of each stored form, read back whole."""
    return _ranged(index, folder, _examine, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", whole=True)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Each row with its pointer (digest, shard, offset, length), metadata and features."""
    folder = folder or new_path(docs.sparkSession, "media")
    index = store(docs, text_col, folder)
    facts = index.join(metadata(index, folder), "digest").join(examined(index, folder), "digest")
    payload = payload_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("digest"))
    found = rows.join(facts, "digest", "left")
    return found.select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "length", "width", "height", "bit_depth", "channels",
    )
