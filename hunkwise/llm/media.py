"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the rows of a 64 pixels wide 8-bit grey PNG image:
lossless, compressed, and with the unpadded length in a text chunk ahead of the samples. ``pack`` stores each distinct
image of a task once, as a member of a tar shard named by its SHA-256, and returns rows that carry digest, shard, offset
and length. ``canonical`` settles on one stored copy for each digest. ``headers`` fills metadata columns from the first
``HEADER`` bytes of each object; ``read_back`` reads the whole object, checks its address and decodes the samples.

Shards are written under a fresh name by every attempt of a task, and rows name the shard their own attempt wrote, so
retries and lost executors leave unreferenced shards at worst. A shard is closed at ``SHARD_BYTES``. The same payload
packed by several tasks has several stored copies, of which one is referenced; no text is shuffled to find equal ones.

Defined results: a null text counts as empty, and the empty text is one row of 64 zero bytes. Equal texts get equal
values. Repeated rows and further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

WIDTH = 64
SHARD_BYTES = 64 << 20
#: Stored bytes that one task reads back.
READ_BYTES = 16 << 20
#: Signature, image header and text chunk: what a header-only read fetches.
HEADER = 96
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LEVEL = 4


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode(text: str | None) -> bytes:
    """The stored form of one text."""
    data = payload(text)
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter type, none
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    size = f"{len((text or '').encode()):020d}".encode()
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0" + size) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), _LEVEL)) + _chunk(b"IEND", b"")


def header(stored: bytes) -> dict:
    """Metadata from an object's first ``HEADER`` bytes."""
    if stored[:8] != _SIGNATURE or stored[12:16] != b"IHDR" or stored[37:41] != b"tEXt":
        raise ValueError("not an image of this store")
    width, height, depth = struct.unpack(">IIB", stored[16:25])
    return {"width": width, "height": height, "bit_depth": depth, "n_bytes": int(stored[47:67])}


def decode(stored: bytes) -> tuple[bytes, int]:
    """The padded payload and its unpadded length; checks every chunk's checksum."""
    info, at, packed = header(stored), 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(info["height"], info["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written by this store")
    return rows[:, 1:].tobytes(), info["n_bytes"]


def feature(data: bytes) -> str:
    """Mean, deviation and largest sample, entropy in millibits, and eight coarse means."""
    samples = np.frombuffer(data, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(samples))
    spread = float(np.sqrt(max(0.0, (counts * values * values).sum() / len(samples) - mean * mean)))
    columns = samples.reshape(-1, 8, 8).sum(axis=(0, 2), dtype=np.int64) / (len(samples) / 8)
    return f"{mean:.3f}:{spread:.3f}:{int(samples.max())}:{round(-1000 * float((share * np.log2(share)).sum()))}:" + ",".join(str(int(c)) for c in columns)


def _store(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """One open tar shard of a task, written where all machines can read it."""

    def __init__(self, folder: str) -> None:
        files, path = _store(folder)
        files.create_dir(path, recursive=True)
        self.key = uuid.uuid4().bytes  # the file is named by its hex digits
        self.out, self.size = files.open_output_stream(f"{path}/{self.key.hex()}.tar"), 0

    def add(self, digest: bytes, stored: bytes) -> int:
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(stored)
        block = info.tobuf(tarfile.USTAR_FORMAT) + stored + bytes(-len(stored) % 512)
        at = self.size + 512
        self.out.write(block)
        self.size += len(block)
        return at

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def pack(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, shard, offset, length`` of every row, and shards under ``folder`` (a URI all machines share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        at: dict[bytes, tuple[bytes, int, int]] = {}
        for b in batches:
            made: list[tuple] = []
            for text in b.column(1):
                stored = encode(text.as_py())
                digest = hashlib.sha256(stored).digest()
                if digest not in at:
                    if len(at) >= 200_000:
                        at.clear()
                    shard = shard or _Shard(folder)
                    at[digest] = (shard.key, shard.add(digest, stored), len(stored))
                    if shard.size >= SHARD_BYTES:
                        shard.close()
                        shard = None
                made.append((digest, *at[digest]))
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, digest binary, shard binary, offset long, length long")


def canonical(packed: DataFrame) -> DataFrame:
    """One stored copy for each digest."""
    return packed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")


def placed(objects: DataFrame, total_bytes: int) -> DataFrame:
    """``objects`` by shard and in order of offset, ``READ_BYTES`` of them a partition."""
    many = max(1, -(-total_bytes // READ_BYTES))
    return objects.repartition(int(many), "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")


def _ranges(objects: DataFrame, folder: str, fields: str, read: Callable[[bytes, bytes], tuple], whole: bool) -> DataFrame:
    """``objects`` with the further columns that ``read(digest, bytes)`` makes of each object's range."""
    named = [f.split() for f in fields.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for _, t in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _store(folder)
        name, source = b"", io.BytesIO()
        for b in batches:
            made = []
            for digest, shard, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    source.close()
                    name, source = shard, files.open_input_file(f"{path}/{shard.hex()}.tar")
                source.seek(offset)
                made.append(read(digest, source.read(length if whole else min(HEADER, length))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))], names=[*b.schema.names, *(n for n, _ in named)])
        source.close()

    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema)
    return objects.mapInArrow(run, f"{known}, {fields}")


def headers(objects: DataFrame, folder: str) -> DataFrame:
    """``objects`` with ``width, height, bit_depth, n_bytes`` from header-only range reads."""
    return _ranges(objects, folder, "width long, height long, bit_depth long, n_bytes long", lambda _, data: tuple(header(data).values()), False)


def _features(digest: bytes, stored: bytes) -> tuple:
    if hashlib.sha256(stored).digest() != digest:
        raise ValueError(f"object {digest.hex()} is damaged")
    data, _ = decode(stored)
    return len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-WIDTH:]), len(stored), feature(data)


def read_back(objects: DataFrame, folder: str) -> DataFrame:
    """``objects`` with ``payload_bytes, payload_sha256, tail_crc32, media_bytes, feature`` from whole objects."""
    return _ranges(objects, folder, "payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string", _features, True)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, with its object's address, metadata and features.

    Objects are placed once; headers and whole objects are then read in one chain without a shuffle between.
    """
    folder = scratch_path(docs.sparkSession, "media")
    packed = written(pack(docs, folder, id_col, text_col), "media-rows")
    total = packed.agg(F.sum("length")).first()[0] or 0
    known = written(read_back(headers(placed(canonical(packed), total), folder), folder), "media-known")
    hexed = lambda c: F.lower(F.hex(c))
    return packed.select("doc_id", "digest").join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("digest").alias("media_sha256"), "feature",
        F.concat(hexed("shard"), F.lit(".tar")).alias("shard"), "offset", "length", "width", "height",
    )
