"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. A match of the pattern depends
only on the text from its start, so where a chunk and the next have a boundary in common they agree from there
on: chunks are stitched at the first such boundary in their overlap. Matches whose end more text could still
move are not trusted. Each chunk then encodes the pieces between its two stitches. A text with an overlap that
holds no common boundary (one run of letters longer than the overlap, say) is encoded in one go.
Decoding concatenates the tokens' raw bytes.

A worker makes the codec of a rank file once, by a name the driver gives it, and keeps it for later tasks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkloom.runtime import give_back, ship

CHUNK, OVERLAP = 32_768, 512
#: Characters past a match's end that can still decide about it (contractions, the look-ahead).
_MARGIN = 4
#: Encoded pieces that a worker remembers.
_CACHE = 100_000
_CODECS: dict[str, Codec] = {}


def _pack(sizes: list[int]) -> bytes:
    """Piece lengths in as few bytes each as the longest needs, which the first byte tells."""
    width = 1 if max(sizes, default=0) < 256 else 4
    return bytes([width]) + np.array(sizes, f"<u{width}").tobytes()


def _pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """A rank file and its pattern: pieces to packed little-endian ids, ids to bytes."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self._matches = regex.compile(pattern).findall
        self._bytes = {i: t for t, i in table.items()}
        self._known: dict[str, bytes] = {}


    def pieces(self, text: str) -> list[str]:
        return self._matches(text)

    def encode(self, pieces: list[str]) -> bytes:
        known = self._known
        out = list(map(known.get, pieces))
        if None in out:
            for i, (p, ids) in enumerate(zip(pieces, out)):
                if ids is None:
                    out[i] = ids = _pack_ids(self._encode(p.encode()))
                    if len(known) >= _CACHE:
                        known.clear()
                    if len(p) < 64:
                        known[p] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Ranks:
    """A rank file and a pattern, as the driver sends them; ``codec()`` is made once a worker."""

    def __init__(self, spark, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            body = f.read()
        self.name, self.pattern = hashlib.sha256(body + pattern.encode()).hexdigest(), pattern
        self.body = spark.sparkContext.broadcast(body)  # a vocabulary: its size doesn't depend on the data

    def codec(self) -> Codec:
        if self.name not in _CODECS:
            _CODECS[self.name] = Codec(self.body.value, self.pattern)
        return _CODECS[self.name]


def _series(make, kind: T.DataType):
    """A pandas UDF by make(), which gives a task its function of one value."""
    from pandas import Series

    def each(it: Iterator) -> Iterator:
        f = make()
        for s in it:
            yield Series([f(x) for x in s], dtype=object)
        give_back()

    each.__annotations__ = {"it": Iterator[Series], "return": Iterator[Series]}
    return F.pandas_udf(each, kind)


def _both(ranks: Ranks):
    """A pandas UDF for a text's ids and the bytes that these decode to, in one worker."""
    from pandas import DataFrame as Frame, Series

    def each(it: Iterator) -> Iterator:
        codec = ranks.codec()
        for i, s in enumerate(it):
            ids = [codec.encode(codec.pieces(t)) for t in s]
            yield Frame({"ids": Series(ids, dtype=object), "decoded": Series(list(map(codec.decode, ids)), dtype=object)})
            del ids, s
            if i % 8 == 7:
                give_back()
        give_back()

    each.__annotations__ = {"it": Iterator[Series], "return": Iterator[Frame]}
    return F.pandas_udf(each, "ids binary, decoded binary")


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            starts = list(range(0, max(1, len(text) - overlap), chunk))
            for lo in range(0, len(starts), 256):
                some = starts[lo : lo + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(some), pa.binary()), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array(some, pa.int64()), pa.array([text[s : s + chunk + overlap] if s != starts[-1] else text[s:] for s in some]), pa.array([s == starts[-1] for s in some])],
                    ["digest", "no", "start", "part", "last"],
                )


def _pretokenise(batches: Iterator[pa.RecordBatch], ranks: Ranks, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Adds the piece lengths, the boundaries in the first overlap, and the trusted ones in the last."""
    codec = ranks.codec()
    for b in batches:
        lens, heads, tails = [], [], []
        for start, part, last in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            sizes = [len(p) for p in codec.pieces(part)]
            ends = [0, *accumulate(sizes)]
            lens.append(_pack(sizes))
            heads.append([start + e for e in ends if e <= overlap])
            tails.append([] if last else [start + e for e in ends if e >= chunk and e <= len(part) - _MARGIN])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lens, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*b.schema.names, "lens", "head", "tail"])


def _encode_parts(batches: Iterator[pa.RecordBatch], ranks: Ranks) -> Iterator[pa.RecordBatch]:
    """Rows (digest, no, ids, rest): a chunk's ids between its stitches, or for a text that can't be stitched its own characters."""
    codec = ranks.codec()
    for b in batches:
        out, rest = [], []
        for part, lens, lo, hi, own in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
            if own is not None:
                out.append(None)
                rest.append(part[:own])
                continue
            ends = [0, *accumulate(np.frombuffer(lens, f"<u{lens[0]}", offset=1).tolist())]
            i, j = ends.index(lo), ends.index(hi) if hi is not None else len(ends) - 1
            out.append(codec.encode([part[s:e] for s, e in zip(ends[i:j], ends[i + 1 : j + 1])]))
            rest.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(rest, pa.string())], ["digest", "no", "ids", "rest"])


def _whole_texts(batches: Iterator[pa.RecordBatch], ranks: Ranks, decoded: bool) -> Iterator[pa.RecordBatch]:
    """A text's ids from its parts in order (no, ids, rest); an unstitched one is encoded here in one go."""
    codec = ranks.codec()
    for b in batches:
        ids = []
        for i in range(b.num_rows):
            parts = sorted(b.column(1)[i].as_py(), key=lambda p: p["no"])
            if parts[0]["ids"] is None:
                ids.append(codec.encode(codec.pieces("".join(p["rest"] for p in parts))))
            else:
                ids.append(b"".join(p["ids"] for p in parts))
        back = list(map(codec.decode, ids)) if decoded else [None] * len(ids)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["__done", "__ids", "__decoded"])
    give_back()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text's token ids as packed little-endian unsigned 32-bit integers.

    ``path`` names a rank file on the driver. A null text counts as empty and has no ids. Columns ``out`` and
    ``decoded`` that ``df`` has already are replaced; all other columns and repeated rows stay as they are.
    With ``decoded``, the bytes that the ids decode to go there, from the worker that made the ids.
    """
    if not _MARGIN < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    if text in (out, decoded):
        raise ValueError("the text's own column can't be replaced")
    spark = df.sparkSession
    ship(spark)
    ranks = Ranks(spark, path, pattern)
    df = df.drop(out, *([decoded] if decoded else []))
    body = F.coalesce(F.col(text), F.lit(""))
    short = df.where(F.length(body) <= chunk)
    if decoded:
        short = short.withColumn("__both", _both(ranks)(body)).withColumn(out, F.col("__both.ids")).withColumn(decoded, F.col("__both.decoded")).drop("__both")
    else:
        short = short.withColumn(out, _series(lambda: (lambda t, c=ranks.codec(): c.encode(c.pieces(t))), T.BinaryType())(body))

    long_ = df.where(F.length(body) > chunk).withColumn("__digest", F.unhex(F.sha2(text, 256)))
    parts = long_.select(F.col("__digest"), F.col(text)).mapInArrow(lambda it: _chunks(it, chunk, overlap), "digest binary, no int, start long, part string, last boolean")
    # Copies of a text are encoded once; this also deals the chunks out.
    parts = parts.groupBy("digest", "no").agg(F.first("start").alias("start"), F.first("part").alias("part"), F.first("last").alias("last"))
    cut = parts.mapInArrow(lambda it: _pretokenise(it, ranks, chunk, overlap), "digest binary, no int, start long, part string, last boolean, lens binary, head array<long>, tail array<long>")
    w = Window.partitionBy("digest").orderBy("no")
    sync = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    stitched = cut.withColumn("to", sync).withColumn("from", F.lag("to").over(w))
    broken = F.max((~F.col("last") & F.col("to").isNull()).cast("int")).over(Window.partitionBy("digest")) == 1
    own = F.when(broken, F.when(F.col("last"), F.length("part")).otherwise(F.lit(chunk)))
    regions = stitched.select("digest", "no", "part", "lens", (F.coalesce("from", F.lit(0)) - F.col("start")).alias("from"), (F.col("to") - F.col("start")).alias("to"), own.alias("own"))
    coded = regions.mapInArrow(lambda it: _encode_parts(it, ranks), "digest binary, no int, ids binary, rest string")
    gathered = coded.groupBy("digest").agg(F.collect_list(F.struct("no", "ids", "rest")).alias("parts"))
    texts = gathered.mapInArrow(lambda it: _whole_texts(it, ranks, bool(decoded)), "__done binary, __ids binary, __decoded binary")
    done = long_.join(texts, F.col("__digest") == F.col("__done")).drop("__done", "__digest").withColumnRenamed("__ids", out)
    done = done.withColumnRenamed("__decoded", decoded) if decoded else done.drop("__decoded")
    return short.unionByName(done)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the raw bytes of the packed ids; null ids stay null."""
    spark = df.sparkSession
    ship(spark)
    ranks = Ranks(spark, path, pattern)
    return df.withColumn(out, _series(lambda: (lambda x, c=ranks.codec(): None if x is None else c.decode(x)), T.BinaryType())(F.col(ids)))


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents' token ids and their decoded bytes, as digests."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
