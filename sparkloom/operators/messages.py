"""Session messages and tool calls: filters, command statistics, aggregates of sessions, blame by edits.

Turns are (session, turn, role, text); tool calls (session, pos, tool, target, is_error, tokens, ts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import texts

#: Tools that change nothing.
READ_ONLY = ("Read", "Grep", "Glob", "LS", "WebFetch", "WebSearch")


def select(turns: DataFrame, role: str | None = None, grep: str | None = None, exclude: str | None = None, session_prefix: str | None = None, min_chars: int = 0, max_chars: int = 0, turn_from: int | None = None, turn_to: int | None = None,
           since=None, until=None, kinds: tuple[str, ...] = (), errors_only: bool = False, has_tool: str | None = None, limit: int = 0, newest_first: bool = False, order: tuple[str, ...] = ("session", "turn")) -> DataFrame:
    """The turns that pass every filter that is given; ``until`` is a day that still counts, ``has_tool`` a prefix without case."""
    tests: list[Column] = []
    add = lambda given, test: tests.append(test()) if given else None
    add(role, lambda: F.col("role") == role)
    add(grep, lambda: F.col("text").rlike(grep))
    add(exclude, lambda: ~F.col("text").rlike(exclude))
    add(session_prefix, lambda: F.col("session").cast("string").startswith(session_prefix))
    add(min_chars, lambda: F.length("text") >= min_chars)
    add(max_chars, lambda: F.length("text") <= max_chars)
    add(turn_from is not None, lambda: F.col("turn") >= turn_from)
    add(turn_to is not None, lambda: F.col("turn") <= turn_to)
    add(since, lambda: F.to_date("ts") >= F.lit(since).cast("date"))
    add(until, lambda: F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    add(kinds, lambda: F.col("kind").isin(*kinds))
    add(errors_only, lambda: F.exists("is_error", lambda x: x))
    add(has_tool, lambda: F.exists("tools", lambda t: F.lower(t).startswith(has_tool.lower())))
    out = turns.where(reduce(Column.__and__, tests, F.lit(True)))
    if limit:
        out = out.orderBy(*[F.desc(c) if newest_first else F.col(c) for c in order]).limit(limit)
    return out


def around(turns: DataFrame, hits: DataFrame, context: int) -> DataFrame:
    """The turns within ``context`` of a hit in the same session, each once. ``hits`` is (session, turn)."""
    near = hits.select("session", F.explode(F.sequence(F.col("turn") - context, F.col("turn") + context)).alias("turn")).distinct()
    return turns.join(near, ["session", "turn"], "left_semi")


def command_stats(commands: DataFrame) -> DataFrame:
    """(category, calls, errors, turns, tokens): by category; a turn's tokens count once, however many commands it has.

    ``commands`` is (turn, command, is_error, tokens).
    """
    one = commands.withColumn("category", texts.command_class(F.col("command"))["category"])
    calls = one.groupBy("category").agg(F.count("*").alias("calls"), F.sum(F.col("is_error").cast("long")).alias("errors"))
    turns = one.groupBy("category", "turn").agg(F.max("tokens").alias("t")).groupBy("category").agg(F.count("*").alias("turns"), F.sum("t").alias("tokens"))
    return calls.join(turns, "category")


def merge_reports(reports: DataFrame) -> DataFrame:
    """(tool, calls, errors, output, most, least, rate) of many reports (tool, calls, errors, output, context): counters add up, contexts keep their ends."""
    out = reports.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("output").alias("output"), F.max("context").alias("most"), F.min("context").alias("least"))
    return out.withColumn("rate", F.round(F.when(F.col("calls") > 0, 1 - F.col("errors") / F.col("calls")).otherwise(0.0), 9))


def turn_costs(usage: DataFrame) -> DataFrame:
    """(session, turn, cost) of (session, turn, model, input, output, cache_write, cache_read); null where the model has no price."""
    p = texts.price(F.col("model"))
    money = sum(F.col(c) * p[c] for c in ("input", "output", "cache_write", "cache_read")) / 1e6
    return usage.select("session", "turn", F.round(money, 9).alias("cost"))


def average_context(usage: DataFrame) -> DataFrame:
    """(session, average): whole tokens seen a call, from (session, input, cache_read)."""
    return usage.groupBy("session").agg(F.floor(F.sum(F.col("input") + F.col("cache_read")) / F.count("*")).alias("average"))


def parallel_safe(chains: DataFrame) -> DataFrame:
    """Chains (tools array) with what running them at once saves, and whether all their tools only read."""
    return chains.withColumn("savings", F.size("tools") - 1).withColumn("safe", F.forall("tools", lambda t: t.isin(*READ_ONLY)))


def repo_stats(calls: DataFrame, repo: Column) -> DataFrame:
    """(repo, sessions, calls, tokens, error_rate, parallel_rate): the last is the share of turns with two calls or more."""
    by = calls.withColumn("repo", repo)
    base = by.groupBy("repo").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("is_error").cast("int")), 9).alias("error_rate"))
    turns = by.groupBy("repo", "session", "turn").agg(F.count("*").alias("n")).groupBy("repo").agg(F.round(F.avg((F.col("n") >= 2).cast("int")), 9).alias("parallel_rate"))
    return base.join(turns, "repo")


def ends(calls: DataFrame) -> DataFrame:
    """(tool, starts, ends): how many sessions start and end with a tool."""
    first = calls.groupBy("session").agg(F.min_by("tool", "pos").alias("a"), F.max_by("tool", "pos").alias("z"))
    both = first.select(F.explode(F.array(F.struct(F.col("a").alias("tool"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("z").alias("tool"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    return both.groupBy("x.tool").agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def listing(sessions: DataFrame, mode: str = "interactive") -> DataFrame:
    """Sessions by mode: interactive ones have no parent, subagents have one; all are both."""
    return sessions if mode == "all" else sessions.where(F.col("parent").isNull() if mode == "interactive" else F.col("parent").isNotNull())


def fuzzy_id(sessions: DataFrame, text: str) -> DataFrame:
    """The one session whose id is nearest to a text: equal, else beginning with it, else containing it, else of the least edit distance; ties by id."""
    i = F.col("session").cast("string")
    tier = F.when(i == text, 0).when(i.startswith(text), 1).when(i.contains(text), 2).otherwise(3 + F.levenshtein(i, F.lit(text)))
    return sessions.withColumn("tier", tier).orderBy("tier", i).limit(1)


def _first_two(df: DataFrame, by: list[str]) -> DataFrame:
    """Of (by, session, ts), a session once in a group, the two earliest of each group; ties by the least session.

    The least comes from an aggregate that is combined before its shuffle, the second from what is left.
    """
    least = lambda x: x.groupBy(*by).agg(F.min(F.struct("ts", "session")).alias("m")).select(*by, "m.ts", "m.session")
    first = least(df)
    rest = df.join(first.select(*by, F.col("session").alias("taken")), by).where("session <> taken").drop("taken")
    return first.unionByName(least(rest))


def attribute_chunks(chunks: DataFrame, edits: DataFrame, least: int = 6) -> DataFrame:
    """(chunk, status, session): chunks of committed text by the one edit before the commit that holds them, or that they hold.

    ``chunks`` is (chunk, path, at, text), ``edits`` (session, path, ts, text). One session found is matched, none
    unattributed, several ambiguous; texts of fewer than ``least`` letters and digits are too short to match. Distinct
    texts meet under their path, each once; a text keeps the moments from which one session, and from which a second
    one, can have written it, so chunks and edits never meet one by one.
    """
    flat = lambda c: texts.squeeze(F.col(c))
    a = chunks.where(texts.meaningful(F.col("text")) >= least).select("chunk", "path", "at", flat("text").alias("x")).where("at is not null")
    b = edits.where(texts.meaningful(F.col("text")) >= least).where("session is not null and ts is not null")
    b = b.groupBy("session", "path", flat("text").alias("y")).agg(F.min("ts").alias("ts"))
    written = _first_two(b, ["path", "y"])
    alike = a.select("path", "x").distinct().join(written.select("path", "y").distinct(), "path").where(F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")))
    since = _first_two(alike.join(written, ["path", "y"]).groupBy("path", "x", "session").agg(F.min("ts").alias("ts")), ["path", "x"])
    since = since.groupBy("path", "x").agg(F.min("ts").alias("one"), F.max("ts").alias("two"), F.min(F.struct("ts", "session")).alias("first"), F.count("*").alias("k"))
    hit = a.join(since, ["path", "x"]).where("one <= at")
    found = hit.select("chunk", F.when((F.col("k") > 1) & (F.col("two") <= F.col("at")), 2).otherwise(1).alias("k"), F.col("first.session").alias("session"))
    found = found.groupBy("chunk").agg(F.when(F.min("session") != F.max("session"), 2).otherwise(F.max("k")).alias("n"), F.min("session").alias("session"))
    out = chunks.select("chunk").join(found, "chunk", "left")
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unattributed")
    return out.select("chunk", status.alias("status"), F.when(F.col("n") == 1, F.col("session")).alias("session"))


def commits_of_sessions(outputs: DataFrame) -> DataFrame:
    """(session, branch, hash) of what a commit command prints: [branch hash] message."""
    m = F.regexp_extract(F.col("text"), r"\[([^\s\]]+) ([0-9a-f]{7,40})\]", 1), F.regexp_extract(F.col("text"), r"\[([^\s\]]+) ([0-9a-f]{7,40})\]", 2)
    return outputs.select("session", m[0].alias("branch"), m[1].alias("hash")).where("hash <> ''").distinct()


def trend(points: DataFrame, by: str) -> DataFrame:
    """(by, first, last, delta, delta_pct) of (by, at, value): the ends of a series; no percentage of a first value near 0."""
    ends_ = points.groupBy(by).agg(F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"))
    delta = F.col("last") - F.col("first")
    return ends_.select(by, "first", "last", F.round(delta, 6).alias("delta"), F.when(F.abs("first") >= 1e-9, F.round(100 * delta / F.abs("first"), 6)).alias("delta_pct"))


def snapshots(commits: DataFrame, n: int) -> DataFrame:
    """(id, at) of about ``n`` commits spread evenly over time: the nearest to each target moment, each once."""
    span = F.broadcast(commits.agg(F.min("at").alias("a"), F.max("at").alias("z")))  # one row
    step = (F.col("z") - F.col("a")) / max(1, n - 1)
    cell = F.when(F.col("z") > F.col("a"), F.floor((F.col("at") - F.col("a")) / step)).otherwise(0)
    ends_ = commits.join(span, F.lit(True)).groupBy(cell.alias("i")).agg(F.min(F.struct("at", "id")).alias("first"), F.max(F.struct(F.col("at"), (-F.col("id")).alias("col2"))).alias("last"))
    spine = span.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"), "a", step.alias("step")).join(ends_, "i", "left")
    w = Window.orderBy("i")  # n rows
    after = F.first("first", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = spine.select((F.col("a") + F.col("step") * F.col("i")).alias("target"), after.alias("after"), before.alias("before"))
    later = F.col("before").isNull() | (F.col("after.at") - F.col("target") < F.col("target") - F.col("before.at"))
    one = F.when(F.col("after").isNotNull() & later, F.struct(F.col("after.at").alias("at"), F.col("after.id").alias("id"))).otherwise(F.struct(F.col("before.at").alias("at"), (-F.col("before.col2")).alias("id")))
    return near.select(one.alias("c")).where("c.id is not null").select("c.id", "c.at").distinct()


def heaviest(df: DataFrame, by: str, score: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows of the largest score in each group; ties by the least ``tie``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
