"""Session-log analytics over events (session, pos, tool, error, value): order within a session is pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def _session() -> Window:
    return Window.partitionBy("session")


def transitions(events: DataFrame) -> DataFrame:
    """(session, from, to, n): steps between tools, from a synthetic start to a synthetic end."""
    w = _session().orderBy("pos")
    step = events.select("session", F.lag("tool").over(w).alias("from"), F.col("tool").alias("to"), F.lead("tool").over(w).alias("next"))
    inner = step.select("session", F.coalesce("from", F.lit("start")).alias("from"), "to")
    ends = step.where("next is null").select("session", F.col("to").alias("from"), F.lit("end").alias("to"))
    return inner.unionByName(ends).groupBy("session", "from", "to").agg(F.count("*").alias("n"))


def markov(counts: DataFrame, *by: str) -> DataFrame:
    """Transition counts as the probabilities of a row."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from")))


def frobenius_outliers(counts: DataFrame, k: int = 10) -> DataFrame:
    """(session, distance): the ``k`` sessions whose transition matrix is farthest from that of all."""
    own = markov(counts, "session").select("session", "from", "to", "p")
    all_ = markov(counts.groupBy("from", "to").agg(F.sum("n").alias("n"))).select("from", "to", F.col("p").alias("q"))
    # The squares of a session's own cells, less those cells of the population, plus the whole population.
    total = all_.agg(F.sum(F.col("q") * F.col("q")).alias("qq"))
    cells = own.join(all_, ["from", "to"]).groupBy("session").agg(F.sum((F.col("p") - F.col("q")) ** 2 - F.col("q") * F.col("q")).alias("d"))
    out = cells.join(total, F.lit(True)).select("session", F.round(F.sqrt(F.greatest(F.col("d") + F.col("qq"), F.lit(0.0))), 6).alias("distance"))
    return out.orderBy(F.desc("distance"), "session").limit(k)


def runs(events: DataFrame, least: int = 3) -> DataFrame:
    """(session, tool, start, length): maximal runs of one tool, by the difference of two row numbers."""
    w = _session().orderBy("pos")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("session", "tool").orderBy("pos"))
    out = events.withColumn("island", island).groupBy("session", "tool", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("island")


def subsequences(events: DataFrame, shortest: int = 2, longest: int = 5, least: int = 2) -> DataFrame:
    """(pattern, length, n): contiguous tool sequences, by leads over the session, so no session is gathered in one row."""
    w = _session().orderBy("pos")
    ahead = events.select("session", *[F.lead("tool", i).over(w).alias(f"t{i}") for i in range(longest)])
    each = [F.struct(F.concat_ws(">", *[f"t{i}" for i in range(n)]).alias("pattern"), F.lit(n).alias("length"), F.col(f"t{n - 1}").isNotNull().alias("ok")) for n in range(shortest, longest + 1)]
    out = ahead.select(F.explode(F.array(*each)).alias("p")).where("p.ok").groupBy("p.pattern", "p.length").agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def matches(events: DataFrame, pattern: list[str]) -> DataFrame:
    """(session, pos): where a sequence of tool prefixes starts, without case."""
    w = _session().orderBy("pos")
    hit = F.lit(True)
    rows = events.select("session", "pos", *[F.lower(F.lead("tool", i).over(w)).alias(f"t{i}") for i in range(len(pattern))])
    for i, p in enumerate(pattern):
        hit = hit & F.col(f"t{i}").startswith(p.lower())
    return rows.where(hit).select("session", "pos")


def growth(events: DataFrame, value: str = "value") -> DataFrame:
    """(session, unique): the sum of a context's rises, its first size included."""
    prev = F.coalesce(F.lag(value).over(_session().orderBy("pos")), F.lit(0.0))
    return events.withColumn("g", F.greatest(F.lit(0.0), F.col(value) - prev)).groupBy("session").agg(F.round(F.sum("g"), 4).alias("unique"))


def tool_stats(events: DataFrame) -> DataFrame:
    """(tool, calls, errors, success_rate)."""
    out = events.groupBy("tool").agg(F.count("*").alias("calls"), F.sum(F.col("error").cast("long")).alias("errors"))
    return out.withColumn("success_rate", F.round(1 - F.col("errors") / F.col("calls"), 9))


def retry_hotspots(events: DataFrame, attempts: int = 3, failures: int = 2) -> DataFrame:
    """(session, tool, attempts, failures) with at least as many of each."""
    out = events.groupBy("session", "tool").agg(F.count("*").alias("attempts"), F.sum(F.col("error").cast("long")).alias("failures"))
    return out.where((F.col("attempts") >= attempts) & (F.col("failures") >= failures))


def parallel_runs(events: DataFrame, least: int = 2) -> DataFrame:
    """(session, tool, start, savings): runs of a tool over ``least`` or more distinct targets; one call could have done."""
    w = _session().orderBy("pos")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("session", "tool").orderBy("pos"))
    out = events.withColumn("island", island).groupBy("session", "tool", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.countDistinct("target").alias("targets"))
    return out.where((F.col("length") > 1) & (F.col("targets") >= least)).select("session", "tool", "start", (F.col("length") - 1).alias("savings"))


def heatmap(events: DataFrame) -> DataFrame:
    """(target, reads, writes, touches, heat): hot above five writes, read-only with reads alone."""
    out = events.groupBy("target").agg(F.sum((~F.col("write")).cast("long")).alias("reads"), F.sum(F.col("write").cast("long")).alias("writes"), F.count("*").alias("touches"))
    return out.withColumn("heat", F.when(F.col("writes") > 5, "hot").when((F.col("writes") == 0) & (F.col("reads") > 0), "read-only").otherwise("normal"))


def summary(events: DataFrame) -> DataFrame:
    """(session, turns, calls, errors, seconds) with the time from first to last event."""
    t = F.unix_timestamp("ts")
    return events.groupBy("session").agg(F.count("*").alias("turns"), F.countDistinct("tool").alias("tools"), F.sum(F.col("error").cast("long")).alias("errors"), (F.max(t) - F.min(t)).alias("seconds"))


def cost(tokens: DataFrame, rates: dict[str, float]) -> DataFrame:
    """(session, cost, saved, efficiency) from (session, input, output, cache_read, cache_create), rates by million tokens."""
    total = tokens.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_create")])
    money = sum((F.col(c) * (r / 1e6) for c, r in rates.items()), F.lit(0.0))
    saved = F.col("cache_read") * ((rates["input"] - rates["cache_read"]) / 1e6)
    seen = F.col("input") + F.col("cache_read")
    return total.select("session", F.round(money, 9).alias("cost"), F.round(saved, 9).alias("saved"), F.round(F.when(seen > 0, 100 * F.col("cache_read") / seen).otherwise(0.0), 6).alias("efficiency"))
