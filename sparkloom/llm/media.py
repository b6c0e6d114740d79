"""Media columns: content-addressed payloads in tar shards, filled by header-only range reads.

A payload is stored once in its writer's tar shard, as a PNG of 8-bit grey samples named by its digest. Rows carry
the digest, shard, offset and length; equal payloads of other writers resolve to one place. Metadata columns come
from range reads of the PNG's header alone; a full range read gives the samples back.
Shards live in the shared folder and are named by writer and attempt, so a task that runs again leaves what
the committed rows point to untouched.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkloom.runtime import Scratch, partitions, ship

UNIT, PAD, SIDE, LEVEL = 192, b" ", 192, 6
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes up to the end of the header chunk.
HEADER = 33
_PLACE = "digest binary, shard string, offset long, length long"


def payload(text: str | None) -> bytes:
    """A text's bytes, padded with blanks to a positive multiple of UNIT; a null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + PAD * (-len(data) % UNIT or (0 if data else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """8-bit grey samples, SIDE to a row, as a PNG."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, SIDE)
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first HEADER bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(png: bytes) -> bytes:
    """The samples of a PNG that to_png made; checksums are checked."""
    width, height, _ = read_header(png[:HEADER])
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, spread, entropy and an 8 x 8 average hash of the samples."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    sums = np.add.reduceat(x.astype(np.int64), np.linspace(0, len(x), 64, endpoint=False).astype(np.int64))
    sizes = np.diff(np.append(np.linspace(0, len(x), 64, endpoint=False).astype(np.int64), len(x)))
    means = sums / np.maximum(sizes, 1)
    bits = int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};ahash={bits:016x}"


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to rows (key, n_bytes, digest, shard, offset, length); new payloads go to this task's shard."""
    fs, root = _filesystem(folder)
    context = TaskContext.get()
    name = f"shard-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.tar"
    out, tar, known = None, None, {}
    try:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                data = payload(text)
                own = hashlib.sha256(data).digest()
                if own not in known:
                    if tar is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}")
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                    png = to_png(data)
                    digest = hashlib.sha256(png).digest()
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(png)
                    at = tar.offset + tarfile.BLOCKSIZE
                    tar.addfile(info, io.BytesIO(png))
                    known[own] = (digest, at, len(png))
                digest, at, n = known[own]
                for x, v in zip(rows, (len((text or "").encode("utf-8", "surrogatepass")), digest, at, n)):
                    x.append(v)
            n, digests, offsets, lengths = rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([name] * len(n), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "n_bytes", "digest", "shard", "offset", "length"])
    finally:
        if tar is not None:
            tar.close()
            out.close()


class _Reader:
    """Range reads, with the shard read last kept open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = _filesystem(folder)
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            if self.file:
                self.file.close()
            self.shard, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def _headers(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    reader = _Reader(folder)
    for b in batches:
        got = [read_header(reader.read(s, o, HEADER)) for s, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([g[i] for g in got], pa.int32()) for i in range(3)]], [*b.schema.names, "width", "height", "bit_depth"])


def _contents(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    reader = _Reader(folder)
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for digest, shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(4))):
            png = reader.read(shard, offset, length)
            if hashlib.sha256(png).digest() != digest:
                raise ValueError(f"{shard} does not hold {digest.hex()} at {offset}")
            data = from_png(png)
            for x, v in zip(out, (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), digest.hex(), feature(data), len(data))):
                x.append(v)
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))]], [*b.schema.names, "payload_sha256", "tail_crc32", "media_sha256", "feature", "payload_bytes"])


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """Stores each row's payload; rows (key, n_bytes, digest), the payloads' places (digest, shard, offset, length), the folder."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "media")
    folder = f"{scratch.path}/payloads"
    kind = df.schema[key].dataType.simpleString()
    pointers = scratch.stage(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lambda it: _store(it, folder), f"key {kind}, n_bytes long, digest binary, shard string, offset long, length long"))
    places = pointers.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return pointers.select("key", "n_bytes", "digest"), places, folder


def headers(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with width, height and bit_depth, reading HEADER bytes of each payload."""
    ordered = places.repartitionByRange(partitions(places.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(lambda it: _headers(it, folder), f"{_PLACE}, width int, height int, bit_depth int")


def contents(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with payload_sha256, tail_crc32, media_sha256, feature and payload_bytes, each from the stored bytes."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema)
    return places.mapInArrow(lambda it: _contents(it, folder), f"{names}, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string, payload_bytes long")


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its payload's columns. A null text counts as empty; repeated rows and keys stay; equal texts share a payload."""
    rows, places, folder = store(df, key, text)
    read = contents(headers(places, folder), folder)
    return rows.join(read, "digest").withColumnRenamed("key", key)


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents' payloads, stored and read back."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "bit_depth", "shard", "offset")
