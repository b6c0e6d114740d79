"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. Each starts under a hashed label; per group of linked documents the
state is one row with the number of members under each label. In every round a group pulls its members
towards the label where most of its members (their neighbours) are, as far as the labels' quotas allow:
the demand between labels is one 16 x 16 matrix, a label takes in what others take from it plus its room,
and the largest gains go first. Documents without links fill up what room remains, so that sizes end exact.
Members are ranked in buckets of bounded size, so neither a huge group nor a shard meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.runtime import Scratch

SHARDS, ROUNDS, BUCKET_ROWS, MAX_BUCKETS = 16, 24, 512, 65_536
_LEVELS, _HASHES = 62, 64


def ranked(df: DataFrame, parts: list[str], bucket: Column, order: list[str], out: str = "rank") -> DataFrame:
    """0-based rank of each row within ``parts``, by bucket, then ``order``.

    Only a bucket's rows meet in a task; the buckets' counts (one row each) are summed up ahead of them.
    """
    rows = df.withColumn("__b", bucket)
    w = Window.partitionBy(*parts).orderBy("__b") if parts else Window.orderBy("__b")
    before = rows.groupBy(*parts, "__b").agg(F.count("*").alias("__n")).withColumn("__o", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    inner = Window.partitionBy(*parts, "__b").orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(inner) - 1)
    return numbered.join(before, [*parts, "__b"]).withColumn(out, F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def _bucket_rows(n: int) -> int:
    return max(BUCKET_ROWS, -(-n // MAX_BUCKETS))


def _propagate(state: DataFrame, quotas: list[int], scratch: Scratch, rounds: int) -> DataFrame:
    """The groups' loads (digest, loads) after propagation under the quotas."""
    k = len(quotas)
    full: set[int] = set()  # labels that more wanted to join than there was room for
    own = state
    for turn in range(rounds):
        totals = state.agg(*[F.sum(F.col("loads")[d]).alias(f"t{d}") for d in range(k)]).first()
        room = [q - (totals[d] or 0) for d, q in enumerate(quotas)]
        open_ = F.array(*[F.lit(d not in full and (turn < 2 or r > 0)) for d, r in enumerate(room)])
        rank = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda d: F.struct(F.col("loads")[d].alias("n"), (-F.pmod(d + F.col("h"), F.lit(k))).alias("t"), d.alias("d")))
        ranked_ = state.withColumn("h", F.xxhash64("digest")).withColumn("rank", rank)
        best = ranked_.withColumn("best", F.array_max(F.filter("rank", lambda x: F.element_at(open_, x["d"] + 1) & (x["n"] > 0))))
        moves = best.where("best is not null").select("digest", "h", "best", F.explode(F.filter("rank", lambda x: (x["n"] > 0) & (x < F.col("best")))).alias("m"))
        level = F.floor(F.log2(F.col("best.n"))).cast("int")
        moves = scratch.stage(
            moves.select("digest", F.col("m.d").alias("s"), F.col("best.d").alias("d"), F.col("m.n").alias("n"), ((F.lit(_LEVELS) - level) * _HASHES + F.pmod(F.col("h"), F.lit(_HASHES))).alias("b"))
        )
        demand = [[0] * k for _ in range(k)]
        for r in moves.groupBy("s", "d").agg(F.sum("n").alias("n")).collect():  # k * k numbers at most
            demand[r["s"]][r["d"]] = r["n"]
        flow = [[min(demand[s][d], demand[d][s]) for d in range(k)] for s in range(k)]
        for d in range(k):
            extra = [demand[s][d] - flow[s][d] for s in range(k)]
            if room[d] > 0 and sum(extra):
                for s in range(k):
                    flow[s][d] += extra[s] if sum(extra) <= room[d] else extra[s] * room[d] // sum(extra)
        filled = {d for d in range(k) if sum(demand[s][d] - min(demand[s][d], demand[d][s]) for s in range(k)) > max(room[d], 0)} - full
        full |= filled
        if not any(map(sum, flow)):
            scratch.drop(moves)
            if not filled:
                return state
            continue
        # Of a pair of labels whose demand exceeds the flow, whole buckets go, largest gains first; of the bucket at the cut, a share.
        limit = F.array(*[F.array(*[F.lit(x) for x in row]) for row in flow])
        sums = moves.groupBy("s", "d", "b").agg(F.sum("n").alias("all"))
        upto = F.sum("all").over(Window.partitionBy("s", "d").orderBy("b"))
        takes = sums.withColumn("take", F.greatest(F.lit(0), F.least(F.col("all"), limit[F.col("s")][F.col("d")] - (upto - F.col("all")))))
        went = moves.join(takes, ["s", "d", "b"]).withColumn("go", F.when(F.col("take") == F.col("all"), F.col("n")).otherwise(F.floor(F.col("n") * F.col("take") / F.col("all")).cast("long"))).where("go > 0")
        delta = went.groupBy("digest").agg(*[(F.sum(F.when(F.col("d") == i, F.col("go")).otherwise(0)) - F.sum(F.when(F.col("s") == i, F.col("go")).otherwise(0))).alias(f"c{i}") for i in range(k)])
        changed = F.array(*[F.col("loads")[i] + F.coalesce(F.col(f"c{i}"), F.lit(0)) for i in range(k)])
        after = scratch.stage(state.join(delta, "digest", "left").select("digest", changed.alias("loads")))
        scratch.drop(moves)
        if state is not own:
            scratch.drop(state)
        state = after
    return state


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row, under the law ``rows``.

    Shards' row counts differ by one at most; slots run from 0 in each shard without gaps. Rows of equal
    text are linked and share a shard as far as its quota goes. A null text counts as empty, a null or
    repeated key is placed like any other row, and an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "shard")
    body = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    base = scratch.stage(base.withColumn("label", F.pmod(F.xxhash64("key", "digest"), F.lit(shards)).cast("int")), slim=True)
    n = base.count()
    quotas = [n // shards + (d < n % shards) for d in range(shards)]
    groups = base.groupBy("digest").agg(F.count("*").alias("n"), F.array(*[F.sum((F.col("label") == d).cast("long")) for d in range(shards)]).alias("loads")).where("n > 1")
    state = _propagate(scratch.stage(groups.select("digest", "loads")), quotas, scratch, rounds)

    upto = F.array(*[sum((F.col("loads")[i] for i in range(1, d + 1)), F.col("loads")[0]) for d in range(shards)])
    per = _bucket_rows(n)
    buckets = max(1, -(-n // per))
    linked = base.join(state.select("digest", upto.alias("upto")), "digest", "left")
    many = linked.where("upto is not null")
    many = ranked(many, ["digest"], F.pmod(F.xxhash64("key"), F.ceil(F.element_at("upto", -1) / per)), ["key", "text_crc32"], "r")
    many = many.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("r"))))
    lump = F.floor(F.col("r") / per)
    many = scratch.stage(ranked(many, ["shard"], F.pmod(F.xxhash64("digest", lump), F.lit(-(-buckets // shards))), ["digest", "r"], "slot").drop("upto"))
    held = {r["shard"]: r["n"] for r in many.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one number a shard
    kept = [min(held.get(d, 0), q) for d, q in enumerate(quotas)]
    quota = F.array(*[F.lit(q) for q in quotas])
    fits = F.col("slot") < quota[F.col("shard")]
    ours = many.where(fits).select("key", "size", "text_crc32", "shard", "slot")
    loose = many.where(~fits).select("key", "size", "text_crc32", "digest", "r").unionByName(linked.where("upto is null").select("key", "size", "text_crc32", "digest", F.lit(0).cast("long").alias("r")))
    loose = ranked(loose, [], F.pmod(F.xxhash64("digest", lump), F.lit(buckets)), ["digest", "r", "key"], "p")
    ends, total = [], 0
    for q, x in zip(quotas, kept):
        total += q - x
        ends.append(total)
    starts = F.array(*[F.lit(e - (q - x) - x) for e, q, x in zip(ends, quotas, kept)])
    loose = loose.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("p"))))
    loose = loose.select("key", "size", "text_crc32", "shard", (F.col("p") - starts[F.col("shard")]).alias("slot"))
    return ours.unionByName(loose).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
