"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes triggers a piece's end wherever its low bits are all ones. Each piece
gives one character of the signature, so an edit changes only the characters of the pieces around it. The
block size 2**k is the least with at most PIECES pieces; the fingerprint is k and the signatures at k, k+1 and
k+2. Likeness compares signatures by edit distance (insertions and deletions) at the block sizes that two
fingerprints share; without one they are unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkloom.runtime import Scratch, partitions, ship

WINDOW, PIECES, COMMON, LEVELS = 7, 64, 4, 3
_STEP = 1 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ROLL = [np.uint32(pow(0x01000193, i, 1 << 32)) for i in range(WINDOW)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    name = hex(base)
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name][:n]


def _levels(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the data and, for each byte, how many low one-bits the rolling hash has there."""
    for lo in range(0, len(data), _STEP):
        head = data[max(0, lo - WINDOW + 1) : lo]
        x = np.frombuffer(b"\0" * (WINDOW - 1 - len(head)) + head + data[lo : lo + _STEP], np.uint8).astype(np.uint32)
        n = len(x) - WINDOW + 1
        h = np.zeros(n, np.uint32)
        for i, c in enumerate(_ROLL):
            h += x[i : i + n] * c
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        ones = ~h & (h + np.uint32(1))  # the lowest zero bit
        yield x[WINDOW - 1 :], np.where(ones == 0, 32, np.bitwise_count(ones - np.uint32(1))).astype(np.uint8)


def _characters(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> str:
    """One character for each piece at block size 2**k; the text's rest counts as a piece."""
    out: list[np.ndarray] = []
    value, length, mask = 0, 0, (1 << 64) - 1
    for bytes_, level in parts:
        n = len(bytes_)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)))
        ends = np.flatnonzero(level >= k) + 1
        starts = np.concatenate((np.zeros(1, np.int64), ends))
        stops = np.concatenate((ends, np.array([n])))
        sums = (total[stops] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
        first = (value + pow(_BASE, length, 1 << 64) * int(sums[0])) & mask
        if len(ends):
            out.append(np.concatenate((np.array([first], np.uint64), sums[1:-1])))
            value, length = int(sums[-1]), n - int(ends[-1])
        else:
            value, length = first, length + n
    if length or not out:
        out.append(np.array([value], np.uint64))
    x = np.concatenate(out)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return "".join(map(_ALPHABET.__getitem__, (x >> np.uint64(58)).tolist()))


def fingerprint(text: str | None) -> str:
    """A text's fingerprint; a null counts as empty, whose signatures are."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return "0" + ":" * LEVELS
    parts = list(_levels(data))
    counts = np.zeros(33 + LEVELS, np.int64)
    for _, level in parts:
        counts[:33] += np.bincount(level, minlength=33)
    above = np.cumsum(counts[::-1])[::-1]
    k = int(np.flatnonzero(above < PIECES)[0])
    return ":".join([str(k), *(_characters(parts, k + i) for i in range(LEVELS))])


def _alike(a: str, b: str) -> float:
    """1 less the share of characters to insert or delete; 0 without COMMON characters in a row in common (a third of a short signature)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n = min(COMMON, max(1, min(len(a), len(b)) // 3))
    if {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:  # the longest common subsequence, a bit for each character of a
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints are 1."""
    if a == b:
        return 1.0
    (ka, *xs), (kb, *ys) = a.split(":"), b.split(":")
    levels = [{int(k) + i: s for i, s in enumerate(signatures)} for k, signatures in ((ka, xs), (kb, ys))]
    return max((_alike(levels[0][k], levels[1][k]) for k in levels[0].keys() & levels[1].keys()), default=0.0)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with its texts' fingerprints; a column ``out`` is replaced."""
    ship(df.sparkSession)
    from pandas import Series

    def each(it: Iterator) -> Iterator:
        for s in it:
            yield Series([fingerprint(t) for t in s], dtype=object)

    each.__annotations__ = {"it": Iterator[Series], "return": Iterator[Series]}
    return df.withColumn(out, F.pandas_udf(each, T.StringType())(F.coalesce(F.col(text), F.lit(""))))


_FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compare(text: str, mark: str, following: str, next_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    own = fingerprint(edited)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, own, likeness(mark, own), likeness(mark, next_mark)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (key, text): each is compared with the next; a partition's first and last go out with their texts."""
    part, waiting, first = TaskContext.get().partitionId(), None, True
    names = ["key", *_FIELDS, "edge", "part", "text"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            mark = fingerprint(text)
            if first:
                rows.append((key, *[None] * 6, 0, part, text))
                first = False
            else:
                rows.append((waiting[0], *_compare(*waiting[1:], text, mark), None, part, None))
            waiting = (key, text, mark)
        yield batch(rows)
    if waiting:
        yield batch([(waiting[0], *[None] * 6, 1, part, waiting[1])])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, *_compare(t, fingerprint(t), n, fingerprint(n))) for k, t, n in zip(*(b.column(i).to_pylist() for i in range(3)))]
        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["key", *_FIELDS])


def edits_and_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key (as a long; what isn't a number counts as a null key), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the start of the next row's text, ascending key, nulls last,
    ties by a hash of the text; after the last row comes the first. A null text counts as empty; a row alone is its
    own next; an empty table gives no rows. Partitions are key ranges, each walked in order; a partition's last row
    joins the first of the next one, which is found by the partitions' numbers alone.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ctph")
    rows = df.select(F.col(key).try_cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.asc_nulls_last("key"), F.col("hash")]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("key", "text")
    walked = scratch.stage(dealt.mapInArrow(_walk, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge int, part int, text string"))
    done = walked.where("edge is null").select("key", *_FIELDS)
    edges = walked.where("edge is not null").select("key", "edge", "part", "text")
    parts = edges.where("edge = 0").select("part")
    follows = parts.select(F.col("part").alias("prior"), F.lead("part").over(Window.orderBy("part")).alias("part"))  # one number a partition
    follows = follows.select("prior", F.coalesce("part", F.lit(parts.agg(F.min("part")).first()[0]).cast("int")).alias("part"))
    firsts = edges.where("edge = 0").select("part", F.col("text").alias("next")).join(follows, "part")
    lasts = edges.where("edge = 1").select("key", "text", F.col("part").alias("prior")).join(firsts, "prior").select("key", "text", "next")
    return done.unionByName(lasts.mapInArrow(_join_edges, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")).withColumnRenamed("key", key)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents' fingerprints against their edited and their next texts."""
    return edits_and_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
