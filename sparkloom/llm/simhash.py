"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint is cut into four 16-bit segments on a ring. If two fingerprints differ in at most three
bits, some segment starts a chain whose cumulative differences stay within the proportional budgets
0, 1, 2, 3 after one, two, three and four segments. So a pair is looked for under the 32-bit key
(first segment exact, second within one flip), pruned by the three-segment budget and then checked in full.
Keys that many fingerprints share, or whose neighbours by one flip many share, go on to the 48-bit key (third
segment within the rest of the budget of two), under which at most 2**16 distinct fingerprints exist: nothing
is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.components import connected_components
from sparkloom.runtime import Scratch, give_back, partitions, ship

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Rows under one 32-bit key, flipped ones included, beyond which the 48-bit key is used.
HOT_KEY = 4096
#: Hot keys that a join broadcasts at most (24 bytes each).
_BROADCAST_KEYS = 100_000
_BLOCK = 1 << 15
#: By the segment that a chain starts at, the bits of its first three segments.
_CHAINS = [np.uint64(sum(0xFFFF << 16 * ((i + j) % 4) for j in range(3))) for i in range(4)]


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash as a signed long; no words (or a null): 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [x + i for i, x in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = [0], ends[-1:]
    h, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        part = [h(joined[s:e], SEED) for s, e in zip(starts[lo : lo + _BLOCK], ends[lo : lo + _BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(df: DataFrame, text: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """``df`` with its SimHash as a long column; a null text counts as no words."""
    ship(df.sparkSession)

    def batches(it: Iterator) -> Iterator:
        for s in it:
            yield s.map(lambda t: simhash(t, k)).astype("int64")
        give_back()

    from pandas import Series

    batches.__annotations__ = {"it": Iterator[Series], "return": Iterator[Series]}
    return df.withColumn(out, F.pandas_udf(batches, T.LongType())(F.coalesce(F.col(text), F.lit(""))))


def _keyed(fps: DataFrame) -> DataFrame:
    """For each fingerprint and chain start, its exact 32-bit key (role 0) and the 16 with one flip (role 1)."""
    seg = lambda i: F.shiftrightunsigned("fp", i * 16).bitwiseAND(F.lit(0xFFFF))
    pair = F.lit(None).cast("long")
    third = F.lit(None).cast("long")
    for i in range(4):
        pair = F.when(F.col("start") == i, F.shiftleft(seg(i), 16).bitwiseOR(seg((i + 1) % 4))).otherwise(pair)
        third = F.when(F.col("start") == i, seg((i + 2) % 4)).otherwise(third)
    flip = F.when(F.col("v") % 17 == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, cast(v % 17 - 1 as int))"))
    return (
        fps.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(67))))
        .withColumn("start", F.floor(F.col("v") / 17).cast("int"))
        .select("fp", (F.col("v") % 17 != 0).cast("int").alias("role"), (F.shiftleft(F.col("start").cast("long"), 48)).alias("top"), pair.bitwiseXOR(flip).alias("pair"), third.alias("third"))
    )


def _links(it: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the true links under each key; rows come sorted by key, role."""
    rest_k, rest_r, rest_f = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def run(keys: np.ndarray, roles: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
        us: list[int] = []
        vs: list[int] = []
        if not len(keys):
            return us, vs
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        busy = (hi - lo > 1) & (roles[lo] == 0)
        for s, e in zip(lo[busy].tolist(), hi[busy].tolist()):
            own = fps[s:e].view(np.uint64)
            exact = int((roles[s:e] == 0).sum())
            label = np.arange(len(own))
            chain = _CHAINS[int(keys[s]) >> 48 & 3]
            for a in range(exact):
                x = own ^ own[a]
                held = np.flatnonzero((np.bitwise_count(x & chain) <= 2) & (label != label[a]))
                for b in held[np.bitwise_count(x[held]) <= distance].tolist():
                    if label[b] != label[a]:
                        us.append(int(fps[s + a]))
                        vs.append(int(fps[s + b]))
                        label[label == label[b]] = label[a]
        return us, vs

    for batch in it:
        keys = np.concatenate((rest_k, batch.column(0).to_numpy()))
        roles = np.concatenate((rest_r, batch.column(1).to_numpy()))
        fps = np.concatenate((rest_f, batch.column(2).to_numpy()))
        at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        us, vs = run(keys[:at], roles[:at], fps[:at])
        rest_k, rest_r, rest_f = keys[at:], roles[at:], fps[at:]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["src", "dst"])
    us, vs = run(rest_k, rest_r, rest_f)
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["src", "dst"])


def hamming_links(fps: DataFrame, distance: int = DISTANCE, hot_key: int = HOT_KEY, scratch: Scratch | None = None) -> DataFrame:
    """Links (src, dst) that connect exactly the distinct fingerprints ``distance`` (3 at most) or fewer bits apart.

    ``fps`` has one distinct, non-null long column fp. Under a key only a spanning forest of the links
    goes out, so a crowd of near copies yields no more links than it has members.
    """
    if distance > 3:
        raise ValueError("the chain budgets are those of at most three differing bits")
    spark = fps.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "hamming")
    rows = _keyed(fps)
    # A key's rows are those of its own fingerprints and of its 16 neighbours', so where all 17 are few it is not hot.
    warm = rows.where("role = 0").groupBy("top", "pair").count().where(F.col("count") > hot_key // 17)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(16)])
    hot = scratch.stage(warm.select("top", F.explode(F.transform(flips, lambda x: F.col("pair").bitwiseXOR(x))).alias("pair")).distinct())
    n = hot.count()
    narrow = rows.select((F.col("top").bitwiseOR(F.lit(1 << 60)).bitwiseOR(F.col("pair"))).alias("key"), "role", "fp", "top", "pair", "third")
    if n:
        side = F.broadcast(hot) if n <= _BROADCAST_KEYS else hot
        masks = [0, *(1 << b for b in range(16)), *((1 << a) | (1 << b) for a in range(16) for b in range(a))]
        few, many = F.array(*[F.lit(x) for x in masks[:17]]), F.array(*[F.lit(x) for x in masks])
        deep = rows.join(side, ["top", "pair"], "left_semi")
        deep = deep.select("*", F.explode(F.when(F.col("role") == 0, many).otherwise(few)).alias("flip")).select(
            F.col("top").bitwiseOR(F.shiftleft("pair", 16)).bitwiseOR(F.col("third").bitwiseXOR(F.col("flip").cast("long"))).alias("key"),
            F.when((F.col("role") == 0) & (F.col("flip") == 0), 0).otherwise(1).cast("int").alias("role"),
            "fp",
        )
        narrow = narrow.join(side, ["top", "pair"], "left_anti").select("key", "role", "fp").unionByName(deep)
    dealt = narrow.select("key", "role", "fp").repartition(partitions(spark), "key").sortWithinPartitions("key", "role", "fp")
    return dealt.mapInArrow(lambda it: _links(it, distance), "src long, dst long")


def _components(fps: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """``fps``, one row a fingerprint, with component_fp: the least fingerprint that links reach from it."""
    links = scratch.stage(hamming_links(fps.select("fp"), distance, scratch=scratch))
    parts = connected_components(links, scratch).withColumnRenamed("node", "fp")
    return fps.join(parts, "fp", "left").withColumn("component_fp", F.coalesce("component", "fp")).drop("component")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_fp, component_id) for each row of ``df``.

    Fingerprints link at ``distance`` or fewer differing bits; a component is what links reach.
    component_id is the least non-null key in it (null if it has none), component_fp a name for it.
    Empty and null texts share fingerprint 0 and link like any other. Repeated rows stay repeated; an empty
    table gives none. Other columns of ``df``, whatever their names, take no part.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.stage(fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "fp", k).select("key", "fp"), slim=True)
    fps = scratch.stage(rows.groupBy("fp").agg(F.min("key").alias("least")))
    named = scratch.stage(_components(fps, distance, scratch))
    ids = named.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    named = scratch.stage(named.join(ids, "component_fp").select("fp", "component_fp", "component_id"))
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component_fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``df`` with exactly one row left of each component of near duplicates.

    That row has the least key (nulls last), then the least fingerprint, then the least text; of rows that are equal
    in all these, the first by their columns as JSON. So unlike texts under one key, or under none, all stay. Texts
    are fingerprinted once; they move once, to join the chosen rows by a 128-bit hash of key and text.
    """
    scratch = Scratch(df.sparkSession, "keep")
    hashes = [F.xxhash64(F.lit(i), F.col(key), F.col(text)).alias(f"h{i}") for i in (1, 2)]
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *hashes)
    rows = scratch.stage(fingerprint(slim, "text", "fp", k).select("key", "fp", "h1", "h2"), slim=True)
    rank = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"))
    fps = scratch.stage(rows.groupBy("fp").agg(F.min(rank).alias("least")))
    best = _components(fps, distance, scratch).groupBy("component_fp").agg(F.min(F.struct("least.n", "least.k", "fp")).alias("best"))
    best = best.select("component_fp", F.col("best.k").alias("k"), F.col("best.fp").alias("fp"))
    texts = rows.groupBy("key", "fp", "h1", "h2").agg(F.count("*").alias("rows"))
    first = scratch.stage(texts.join(best, "fp").where(F.col("key").eqNullSafe(F.col("k"))).select("component_fp", "h1", "h2", "rows"))
    chosen = scratch.stage(first.join(first.groupBy("component_fp").agg(F.count("*").alias("texts")), "component_fp"))
    packed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), *hashes)
    sole = packed.join(chosen.where("texts = 1"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min_by("row", F.struct(F.when(F.col("rows") > 1, F.to_json("row")))).alias("row"))
    # Texts that tie, in case alone perhaps, are compared as they are.
    tied = packed.join(chosen.where("texts > 1"), ["h1", "h2"]).groupBy("component_fp").agg(F.min_by("row", F.struct(F.col(f"row.`{text}`"), F.to_json("row"))).alias("row"))
    return sole.select("row.*").unionByName(tied.select("row.*"))


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
