"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in keyed order, form one stream of words that is cut into blocks. Exact block quotas
come from the target weights; a binary tree over the output shards splits each node's quotas among its two
halves by a multivariate hypergeometric draw, so every shard knows how many blocks of each source it gets.
Sources are split in groups of bounded size: the tree splits the groups' totals, and each group then splits its share
among its own sources, which is the same draw. A keyed permutation orders a source's blocks; shards take disjoint intervals of that order (a second pass
over the source has a permutation of its own) and shuffle what they hold by a local key. A row meets only the
rows of its own bucket of the stream, by a hash of key and text, however much of the rows a source holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkloom.runtime import Scratch, give_back, partitions, ship, short_batches

WEIGHTS, SHARE, REPEAT, SHARDS, SEED = (5, 2, 1), 1.5, 2, 16, 7
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS = 256, 256, 400_000_000
#: Sources that one task splits; the driver sees one number a group and shard.
GROUP_SOURCES = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that are part of a word.
_INSIDE = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
_PIECES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "local", "start", "end")]))


def targets(sizes: list[int], weights: list[float], total: float, repeat: float = REPEAT) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeat`` times its size; what is above goes to the others by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in set(free))
        each = rest / sum(weights[i] for i in free)
        over = [i for i in free if each * weights[i] > repeat * sizes[i]]
        for i in over or free:
            out[i] = float(repeat * sizes[i]) if over else each * weights[i]
        if not over:
            break
        free = [i for i in free if i not in set(over)]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator, sizes: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source for each shard, (shards, sources), by recursive halving; ``sizes`` says how many each shard has in all, else they are even."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(quotas.sum()) * left // shards if sizes is None else int(sizes[:left].sum())
    mine = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    near, far = (None, None) if sizes is None else (sizes[:left], sizes[left:])
    return np.concatenate((split(mine, left, rng, near), split(quotas - mine, shards - left, rng, far)))


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 to n - 1 puts each i: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
            a, b = b, a ^ (_mix64(b + salt) & mask)
        return (a << shift) | b

    x = once(i.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


class _Source:
    """A source's stream: its words, its blocks, how many of them the mix takes, and where each shard's interval ends."""

    def __init__(self, index: int, size: int, block: int, quota: int, ends: list[int]) -> None:
        self.index, self.block, self.quota, self.ends = index, block, quota, ends
        self.blocks = -(-size // block)

    def pieces(self, offsets: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
        """What the mix takes of the words [offset, offset + size) of the stream, for each document of an array:
        (document, shard, local, start, end), as word ranges of the document, pass after pass."""
        held = np.flatnonzero(sizes > 0) if self.quota else np.empty(0, np.int64)
        first = offsets[held] // self.block
        n = (offsets[held] + sizes[held] - 1) // self.block - first + 1
        row = np.repeat(held, n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        lo, hi = np.maximum(i * self.block, offsets[row]) - offsets[row], np.minimum((i + 1) * self.block, offsets[row] + sizes[row]) - offsets[row]
        out = []
        for turn in range(-(-self.quota // self.blocks) if len(row) else 0):
            at = permuted(i, self.blocks, seed * 1_000_003 + self.index * 31 + turn) + turn * self.blocks
            took = np.flatnonzero(at < self.quota)
            at = at[took]
            local = _mix64(at.astype(np.uint64) + np.uint64(self.index << 40)) >> np.uint64(1)
            out.append((row[took], np.searchsorted(self.ends, at, "right"), local.astype(np.int64), lo[took], hi[took]))
        return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.empty((5, 0), np.int64))


def _pieces(plan: dict[int, _Source], owners: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, seed: int) -> pa.ListArray:
    """The pieces of each document of a batch, source by source."""
    codes, owner = np.unique(owners, return_inverse=True)
    parts = []
    for k, name in enumerate(codes.tolist()):
        rows = np.flatnonzero(owner == k)
        row, *rest = plan[name].pieces(offsets[rows], sizes[rows], seed)
        parts.append((rows[row], *rest))
    row, *columns = map(np.concatenate, zip(*parts)) if parts else np.empty((5, 0), np.int64)
    order = np.argsort(row, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(owners)))))
    inner = pa.StructArray.from_arrays([pa.array(c[order], pa.int64()) for c in columns], ["shard", "local", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def words(texts: pa.StringArray | pa.LargeStringArray) -> np.ndarray:
    """Matches of WORD in each text, a null one has none. Its white space is ASCII, so bytes tell."""
    n, (_, ends, data) = len(texts), texts.buffers()
    if not n or data is None:
        return np.zeros(n, np.int64)
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    inside = _INSIDE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]] - ends[0]
    first[heads] = inside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(first), ends - ends[0]))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the words of their texts in place of these."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(words(b.column(0)), pa.int64()), *b.columns[1:]], ["__size", *b.schema.names[1:]])


def _files(df: DataFrame) -> int:
    """Files for the slim rows of a scan of texts: one for 512 MB that it reads, but one for each core at least."""
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(partitions(df.sparkSession), max(df.sparkSession.sparkContext.defaultParallelism, read >> 29))


def _plan(rows: DataFrame, scratch: Scratch, weights: tuple, share: float, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(__src, index, size, target, block, quota, ends) for each source of rows (__src, __size), and the number of rows."""
    order = [(F.col("__src") == "n").asc(), F.col("__src").asc()]
    stats = rows.groupBy("__src").agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    # Their places in order: ranges of sources are numbered on their own, after the counts of those before.
    dealt = scratch.stage(stats.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("size").alias("size")).orderBy("part").collect()  # one row a partition
    rowcount, total = sum(r["n"] for r in counts), share * sum(r["size"] for r in counts)
    offsets = rows.sparkSession.createDataFrame([(r["part"], o) for r, o in zip(counts, accumulate([0, *(r["k"] for r in counts)]))], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.array(*[F.lit(w) for w in weights])
    named = dealt.join(F.broadcast(offsets), "part").select("__src", "size", place.cast("long").alias("index")).withColumn("weight", weight[(F.col("index") % len(weights)).cast("int")])
    # The share of one unit of weight, once those that would go beyond REPEAT times their size are held there.
    each, held = None, F.lit(False)
    while rowcount:
        fixed, free = named.agg(F.coalesce(F.sum(F.when(held, F.col("size") * REPEAT)), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        now = float((total - fixed) / free) if free else each
        if now == each:
            break
        each, held = now, held | (F.lit(now) * F.col("weight") > REPEAT * F.col("size"))
    goal = F.when(held, (F.col("size") * REPEAT).cast("double")).otherwise(F.lit(each) * F.col("weight"))
    cap = max(BLOCK_WORDS, -(-int(total) // MOST_BLOCKS))
    blocks = F.ceil(F.col("size") / F.col("block"))
    quota = F.when(F.col("target") >= REPEAT * F.col("size"), REPEAT * blocks).otherwise(F.least(REPEAT * blocks, F.bround(F.col("target") / F.col("block"))))
    named = named.withColumn("target", goal.cast("double")).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.col("size") / LEAST_BLOCKS))))
    named = named.withColumn("quota", quota.cast("long")).withColumn("group", F.floor(F.col("index") / GROUP_SOURCES)).drop("weight")
    totals = {r["group"]: r["q"] for r in named.groupBy("group").agg(F.sum("quota").alias("q")).collect()}  # one number a group of sources
    table = split(np.array([totals[g] for g in sorted(totals)], np.int64), shards, np.random.default_rng(seed)) if totals else np.zeros((shards, 0), np.int64)
    shares = rows.sparkSession.sparkContext.broadcast(dict(zip(sorted(totals), table.T)))

    def groups(t: pa.Table) -> pa.Table:
        t = t.sort_by("index")
        group = t["group"][0].as_py()
        own = split(t["quota"].to_numpy().astype(np.int64), shards, np.random.default_rng([seed, group]), shares.value[group])
        return t.append_column("ends", pa.array(np.cumsum(own, axis=0).T.tolist(), pa.list_(pa.int64())))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return named.groupBy("group").applyInArrow(groups, f"{kinds}, ends array<bigint>").drop("group"), rowcount


def draw(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, weights: tuple = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, ``carry`` columns, size, source_size, target, pieces) for each row.

    ``pieces`` are the word ranges the mix takes, each with its output shard and local shuffle key. Weights go
    round the sources by code point, a null source last. A null or empty text has size 0 and gives nothing;
    repeated rows each count. Reruns over the same rows give the same pieces.
    """
    placed, take, schema = _draw(df, key, text, source, carry or [], weights, share, shards, seed)
    names = [key, *(carry or [])]
    return placed.mapInArrow(take, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "pieces")


def _draw(df: DataFrame, key: str, text: str, source: str, carry: list[str], weights: tuple = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> tuple:
    """Rows at their places in the streams, what draws their pieces from batches of them, and its schema."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    name = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    body, rest = F.coalesce(F.col(text), F.lit("")), [F.col(key).alias("__key"), name.alias("__src"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("__h")]
    if carry:
        rows = df.select(F.regexp_count(body, F.lit(WORD)).cast("long").alias("__size"), *rest, *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    else:  # counted in numpy: matches of a regular expression fill the heap of the JVM with an object a word
        slim = df.select(body.alias("__text"), *rest)
        kinds = T.StructType([T.StructField("__size", T.LongType()), *slim.schema.fields[1:]])
        with short_batches(spark):
            rows = scratch.stage(slim.mapInArrow(_sized, kinds).repartition(_files(slim)))
    sources, rowcount = _plan(rows.select("__src", "__size"), scratch, weights, share, shards, seed)
    buckets = max(1, -(-rowcount // max(512, -(-rowcount // 65_536))))
    cut = rows.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    w = Window.partitionBy("__src").orderBy("__b")
    before = cut.groupBy("__src", "__b").agg(F.sum("__size").alias("__n")).withColumn("__o", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    before = before.join(sources.withColumnRenamed("size", "total"), "__src")
    inner = Window.partitionBy("__src", "__b").orderBy("__h", "__key").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.join(before, ["__src", "__b"]).withColumn("__at", F.sum("__size").over(inner) - F.col("__size") + F.col("__o"))
    kinds = [df.schema[c].dataType for c in (key, *carry)]
    schema = T.StructType([*[T.StructField(f"c{i}", k) for i, k in enumerate(kinds)], T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("pieces", _PIECES)])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, owner, total, target, block, quota, ends = b.columns[:8]
            owners, sizes = owner.to_numpy(), size.to_numpy()
            plan = {int(k): _Source(int(k), total[i].as_py(), block[i].as_py(), quota[i].as_py(), ends[i].as_py()) for k, i in zip(*(x.tolist() for x in np.unique(owners, return_index=True)))}
            yield pa.RecordBatch.from_arrays([*b.columns[8:], size, total, target, _pieces(plan, owners, at.to_numpy(), sizes, seed)], schema.names)

    return placed.select("__at", "__size", F.col("index"), F.col("total"), F.col("target"), F.col("block"), F.col("quota"), F.col("ends"), "__key", *[f"c{i}" for i in range(len(carry))]), take, schema


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mixed corpus in the columns of ``df``: one row for each taken block of words, shuffled within its shard.

    ``text`` is the block's stretch of the document, with its own white space inside; ``n_chars`` its length.
    """
    columns = [key, *(c for c in df.columns if c != key)]
    placed, take, drawn = _draw(df, key, text, source, columns[1:])
    at, word, pieces_at = columns.index(text), re.compile(WORD), drawn.names.index("pieces")
    chars = columns.index(n_chars) if n_chars in columns else -1
    schema = T.StructType([*drawn.fields[: len(columns)], T.StructField("shard", T.LongType()), T.StructField("local", T.LongType())])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in take(batches):
            rows, texts, shards_, local = [], [], [], []
            for i, (t, pieces) in enumerate(zip(b.column(at).to_pylist(), b.column(pieces_at).to_pylist())):
                spans = [m.span() for m in word.finditer(t)] if pieces else []
                for p in pieces:
                    rows.append(i)
                    texts.append(t[spans[p["start"]][0] : spans[p["end"] - 1][1]])
                    shards_.append(p["shard"])
                    local.append(p["local"])
            index = pa.array(rows, pa.int64())
            out = [c.take(index) if j not in (at, chars) else None for j, c in enumerate(b.columns[: len(columns)])]
            out[at] = pa.array(texts, b.column(at).type)
            if chars >= 0:
                out[chars] = pa.array([len(t) for t in texts], b.column(chars).type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(shards_, pa.int64()), pa.array(local, pa.int64())], schema.names)
            del rows, texts, out
        give_back()

    # One Python worker a task draws and cuts.
    out = placed.mapInArrow(stretches, schema).repartition("shard", F.pmod("local", F.lit(64))).sortWithinPartitions("shard", "local")
    return out.select(*[F.col(f"c{columns.index(c)}").alias(c) for c in df.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    drawn = draw(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return drawn.select("doc_id", "size", "source_size", "target", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"]).alias("taken"))
