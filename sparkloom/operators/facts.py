"""Fact lookups, symbol search, call and import resolution over the fact tables.

Tables: symbols(file, name, kind, parent, start_line, end_line, visibility), imports(file, module, name, alias,
resolved_file), calls(caller_file, caller_symbol, callee_name, callee_qualifier, line).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.runtime import Scratch

#: Up to so many resolved kinds of calls go to every task, and their places by number; of more, the calls are moved to them.
_BROADCAST_KINDS = 20_000


def search(symbols: DataFrame, text: str, fuzzy: bool = True, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols by name without case: exact first, then prefixes, then the rest, shorter names first."""
    name, q = F.lower("name"), text.lower()
    hit = symbols.where(name.contains(q) if fuzzy else name == q)
    hit = hit.where(F.col("kind") == kind) if kind else hit
    tier = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    return hit.withColumn("tier", tier).orderBy("tier", F.length("name"), "name", *[c for c in symbols.columns if c != "name"]).limit(limit)


def find_paths(files: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Paths by words: a leading dot asks for an ending; else the first four words must all occur."""
    path = F.lower("path")
    if text.startswith("."):
        return files.where(path.endswith(text.lower())).orderBy("path").limit(1000)
    words = [w for w in text.lower().replace("_", " ").replace("-", " ").split()][:4]
    return files.where(reduce(lambda a, w: a & path.contains(w), words, F.lit(True))).orderBy("path").limit(limit)


def best_tier(files: DataFrame, text: str) -> DataFrame:
    """(path, tier): exact path, else file name, else ending, else a part; only the first tier that has any."""
    name = F.substring_index("path", "/", -1)
    tier = F.when(F.col("path") == text, 0).when(name == text, 1).when(F.col("path").endswith(text), 2).when(F.col("path").contains(text), 3)
    hit = files.select("path", tier.alias("tier")).where("tier is not null")
    return hit.join(hit.agg(F.min("tier").alias("tier")), "tier").select("path", "tier")


def trigrams(column) -> F.Column:
    text = F.lower(column)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def suggest(names: DataFrame, text: str, threshold: float = 0.3, limit: int = 20) -> DataFrame:
    """(name, score): the share of the query's trigrams that a name contains; queries have four letters or more."""
    asked = trigrams(F.lit(text))
    score = F.size(F.array_intersect(trigrams("name"), asked)) / F.size(asked)
    return names.select("name").distinct().withColumn("score", F.round(score, 9)).where(F.col("score") >= threshold).orderBy(F.desc("score"), "name").limit(limit)


def entry_points(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Public symbols that nothing calls by name."""
    return symbols.where("visibility = 'public'").join(calls.select(F.col("callee_name").alias("name")), "name", "left_anti")


def external_surface(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct public symbols called from a file that has an unresolved import."""
    outward = imports.where("resolved_file is null").select(F.col("file").alias("caller_file"))
    called = calls.join(outward, "caller_file", "left_semi").select(F.col("callee_name").alias("name"))
    return symbols.where("visibility = 'public'").join(called, "name", "left_semi").select("file", "name").distinct()


def callers(symbols: DataFrame, imports: DataFrame, calls: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(file, name, caller_file, caller_symbol, line): who calls a symbol, the union of five ways to resolve a call.

    Already resolved; unqualified in the same file; by an imported name or alias; by an imported module as
    qualifier; by self in the file, where symbols have a ``parent`` only among methods of the caller's own class.
    The result is distinct, so repeated symbols and imports go before the joins, where they would multiply. Calls
    that differ in nothing but line (and symbol, without a ``parent``) resolve alike: each such kind is resolved
    once and staged, so the calls are scanned twice and meet one table, whatever the ways.
    """
    scratch = scratch or Scratch(calls.sparkSession, "callers")
    classes = "parent" in symbols.columns
    target = symbols.select("file", "name").distinct()
    call = calls.select("caller_file", "caller_symbol", F.col("callee_name").alias("callee"), F.col("callee_qualifier").alias("q"), "callee_resolved_file", "line")
    by = ["caller_file", "callee", "q", "callee_resolved_file"] + ["caller_symbol"] * classes
    kind = scratch.stage(call.select(*by).distinct())
    bound = imports.select(F.col("file").alias("caller_file"), "resolved_file", F.col("name").alias("original"), F.coalesce("alias", "name").alias("local"), "module")
    named, whole = (bound.select("caller_file", "resolved_file", *c).distinct() for c in (("original", "local"), ("module",)))
    ways = [
        kind.join(target, (kind["callee_resolved_file"] == target["file"]) & (kind["callee"] == target["name"])),
        kind.where("q is null").join(target, (kind["caller_file"] == target["file"]) & (kind["callee"] == target["name"])),
        kind.join(named, "caller_file").where("callee = local").join(target, (F.col("resolved_file") == target["file"]) & (F.col("original") == target["name"])),
        kind.join(whole, "caller_file").where("q = module").join(target, (F.col("resolved_file") == target["file"]) & (F.col("callee") == target["name"])),
    ]
    mine = kind.where("q = 'self'")
    if classes:
        methods = symbols.where("parent is not null")
        mine = mine.join(methods.select(F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"), F.col("parent").alias("own")).distinct(), ["caller_file", "caller_symbol"])
        fellow = methods.select("file", "name", "parent").distinct()
        ways.append(mine.join(fellow, (mine["caller_file"] == fellow["file"]) & (mine["callee"] == fellow["name"]) & (mine["own"] == fellow["parent"])))
    else:
        ways.append(mine.join(target, (mine["caller_file"] == target["file"]) & (mine["callee"] == target["name"])))
    found = scratch.stage(reduce(DataFrame.unionByName, [w.select(*by, "file", "name") for w in ways]).distinct())
    meets = lambda a, b, on: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in on])
    if found.count() > _BROADCAST_KINDS:
        return call.join(found, meets(call, found, by)).select("file", "name", call["caller_file"], call["caller_symbol"], "line").distinct()
    place = ["caller_file", "file", "name"]
    places = scratch.stage(found.select(*place).distinct().withColumn("place", F.monotonically_increasing_id()))
    numbered = found.join(F.broadcast(places), meets(found, places, place)).select(*(found[c] for c in by), "place")
    hits = call.join(F.broadcast(numbered), meets(call, numbered, by)).select("place", call["caller_symbol"], "line").distinct()
    return hits.join(F.broadcast(places), "place").select("file", "name", "caller_file", "caller_symbol", "line")


def resolve_calls(symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls`` with the file each resolves to: same file, else imported name, else qualifier, else self's file; the least where several match."""
    own = symbols.select(F.col("file").alias("caller_file"), F.col("name").alias("callee_name"), F.col("file").alias("r1")).distinct()
    by_name = imports.where("resolved_file is not null").groupBy(F.col("file").alias("caller_file"), F.coalesce("alias", "name").alias("callee_name")).agg(F.min("resolved_file").alias("r2"))
    by_module = imports.where("resolved_file is not null").groupBy(F.col("file").alias("caller_file"), F.coalesce("alias", "module").alias("callee_qualifier")).agg(F.min("resolved_file").alias("r3"))
    out = calls.join(own, ["caller_file", "callee_name"], "left").join(by_name, ["caller_file", "callee_name"], "left").join(by_module, ["caller_file", "callee_qualifier"], "left")
    self_ = F.when(F.col("callee_qualifier") == "self", F.col("caller_file"))
    other = F.when(F.col("callee_qualifier") != "self", F.col("r3"))
    return out.select(*calls.columns, F.coalesce("r1", "r2", other, self_).alias("resolved"))


def chase_reexports(imports: DataFrame, reexports: DataFrame, scratch: Scratch, rounds: int = 10) -> DataFrame:
    """(file, name, resolved_file): imports followed through files that re-export the name (or ``*``), as long as they move.

    ``reexports`` is (file, name, target); at most ``rounds`` hops, the least target where several match.
    """
    now = scratch.stage(imports.select("file", "name", "resolved_file"))
    hop = reexports.where("file <> target").groupBy("file", "name").agg(F.min("target").alias("target"))
    for _ in range(rounds):
        named = hop.where("name <> '*'").select(F.col("file").alias("resolved_file"), "name", F.col("target").alias("t1"))
        star = hop.where("name = '*'").select(F.col("file").alias("resolved_file"), F.col("target").alias("t2"))
        step = now.join(named, ["resolved_file", "name"], "left").join(star, "resolved_file", "left").select("file", "name", F.coalesce("t1", "t2", "resolved_file").alias("resolved_file"), F.coalesce("t1", "t2").isNotNull().alias("moved"))
        step = scratch.stage(step)
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return now


def enclosing(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """(file, line, name): the innermost span around each point, by equal buckets of lines; none: null.

    ``points`` is (file, line) and ``spans`` (file, name, start, end); ties go to the least name.
    """
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    p = points.distinct().withColumn("cell", F.floor(F.col("line") / bucket))
    inside = p.join(cells, ["file", "cell"]).where(F.col("line").between(F.col("start"), F.col("end")))
    best = inside.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "name")).alias("best"))
    return points.join(best, ["file", "line"], "left").select("file", "line", F.col("best.name").alias("name"))


def nearest(spine: DataFrame, snapshots: DataFrame, by: str, at: str, time: str, cells: int = 4096) -> DataFrame:
    """(by, at, time): for each wanted time the nearest snapshot of its key, the earlier of two as near.

    Wanted times and snapshots meet in cells of time; what lies in other cells comes from one row a cell, so a key's
    rows never all meet. The last snapshot at or before and the first one after come from one sorted union.
    """
    ends = snapshots.agg(F.min(time).alias("a"), F.max(time).alias("z")).first()
    low, width = (ends["a"] or 0), max(1, -(-((ends["z"] or 0) - (ends["a"] or 0) + 1) // max(1, cells)))
    shots = snapshots.where(F.col(time).isNotNull())
    both = spine.select(by, F.col(at).alias("x"), F.lit(None).cast("long").alias("s")).unionByName(shots.select(by, F.col(time).alias("x"), F.col(time).alias("s")))
    both = both.withColumn("cell", F.floor((F.col("x") - low) / width))
    w = Window.partitionBy(by, "cell")
    before = F.last("s", ignorenulls=True).over(w.orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("s", ignorenulls=True).over(w.orderBy("x").rangeBetween(1, Window.unboundedFollowing))
    around = Window.partitionBy(by).orderBy("cell")
    # Cells of each key, wanted times' too, with the nearest snapshots of the cells before and behind.
    summary = both.groupBy(by, "cell").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    summary = summary.select(by, "cell", F.last("last", True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(around.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    got = both.withColumn("before", before).withColumn("after", after).where("s is null").join(summary, [by, "cell"])
    last, first = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    pick = F.when(first.isNull() | (F.col("x") - last <= first - F.col("x")), last).otherwise(first)
    return got.select(by, F.col("x").alias(at), pick.alias(time))


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the deepest module directory that a path lies in; equi-joins on the path's own prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path").distinct().withColumn("module", F.explode(prefixes)).join(modules.select("module").distinct(), "module", "left_semi")
    deepest = each.groupBy("path").agg(F.max(F.struct(F.length("module").alias("n"), "module")).alias("m"))
    return paths.join(deepest, "path", "left").select("path", F.col("m.module").alias("module"))


def size_rollup(files: DataFrame) -> DataFrame:
    """(prefix, size, pct): sizes summed over every directory prefix, and the share of all."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    out = files.groupBy("path").agg(F.sum("size").alias("size")).withColumn("prefix", F.explode(prefixes)).groupBy("prefix").agg(F.sum("size").alias("size"))
    return out.join(files.agg(F.sum("size").alias("all")), F.lit(True)).select("prefix", "size", F.round(100 * F.col("size") / F.col("all"), 6).alias("pct"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed (by over a fifth and over 2), else same."""
    b, a = before.select(key, F.col(value).alias("b")), after.select(key, F.col(value).alias("a"))
    gap = F.abs(F.col("a") - F.col("b"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when((gap > F.col("b") * 0.2) & (gap > 2), "changed").otherwise("same")
    return b.join(a, key, "full").select(key, kind.alias("change"))


def repo_dependencies(deps: DataFrame, repos: DataFrame) -> DataFrame:
    """(source_repo, target_repo, package) distinct: dependencies on other repositories, by folder, address or published name.

    ``deps`` is (repo, package, source) and ``repos`` (repo, folder, url, published).
    """
    from sparkloom.functions.scalar import git_url

    d = deps.select(F.col("repo").alias("source_repo"), "package", "source").distinct()
    ways = [
        (F.substring_index("source", "/", -1), d.where("source like '../%' or source like './%'"), F.col("folder")),
        (git_url(F.col("source")), d.where("source like '%://%' or source like 'git@%'"), git_url(F.col("url"))),
        (F.col("source"), d.where("source not like '%/%'"), F.col("published")),
    ]
    found = [rows.withColumn("k", own).join(repos.select(F.col("repo").alias("target_repo"), other.alias("k")), "k").select("source_repo", "target_repo", "package") for own, rows, other in ways]
    return reduce(DataFrame.unionByName, found).where("source_repo <> target_repo").distinct()
