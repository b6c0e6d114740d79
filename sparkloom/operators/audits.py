"""Reports that join several fact tables: health, stale and broken documents, symbol diffs, summaries, dependency trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import health
from sparkloom.operators import graph
from sparkloom.runtime import Scratch


def health_report(measures: DataFrame, by: str) -> DataFrame:
    """(by, total, grade and the seven scores) of measures (by, complexity, risk, massive, very_large, tests, ceremony, duplicates, unique)."""
    from sparkloom.functions.scalar import grade

    scores = health.parts(*[F.col(c) for c in ("complexity", "risk", "massive", "very_large", "tests", "ceremony", "duplicates", "unique")])
    out = measures.select(by, *[F.round(c, 9).alias(f"{n}_score") for n, c in scores.items()], F.round(health.total(scores), 9).alias("total"))
    return out.withColumn("grade", grade(F.col("total")))


def weighted_grade(scores: DataFrame, by: str) -> DataFrame:
    """(by, score, grade) of rows (by, score, weight)."""
    from sparkloom.functions.scalar import grade

    out = scores.groupBy(by).agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 9).alias("score"))
    return out.withColumn("grade", grade(F.col("score")))


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, kind, change) of symbols (file, name, kind, signature, lines): added, removed, signature changed, body changed (by over a fifth and over two lines)."""
    keys = ["file", "name", "kind"]
    b, a = before.select(*keys, F.col("signature").alias("s1"), F.col("lines").alias("n1")), after.select(*keys, F.col("signature").alias("s2"), F.col("lines").alias("n2"))
    gap = F.abs(F.col("n2") - F.col("n1"))
    change = F.when(F.col("n1").isNull(), "added").when(F.col("n2").isNull(), "removed").when(~F.col("s1").eqNullSafe(F.col("s2")), "signature").when((gap > 0.2 * F.col("n1")) & (gap > 2), "body")
    return b.join(a, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def stale_docs(pairs: DataFrame, touched: DataFrame, docs: Column, least: int = 3) -> DataFrame:
    """(doc, code, shared, lag) of documents that changed together with code ``least`` times or more, and not since the code last did.

    ``pairs`` is (a, b, shared), ``touched`` (path, at); ``docs`` says which path is a document.
    """
    strong = pairs.where(F.col("shared") >= least)
    both = strong.select(F.col("a").alias("doc"), F.col("b").alias("code"), "shared").unionByName(strong.select(F.col("b").alias("doc"), F.col("a").alias("code"), "shared"))
    last = touched.groupBy("path").agg(F.max("at").alias("at")).withColumn("is_doc", docs)
    out = both.join(last.where("is_doc").select(F.col("path").alias("doc"), F.col("at").alias("d")), "doc").join(last.where("not is_doc").select(F.col("path").alias("code"), F.col("at").alias("c")), "code")
    return out.where("c > d").select("doc", "code", "shared", (F.col("c") - F.col("d")).alias("lag"))


def broken_references(docs: DataFrame, known: DataFrame, pattern: str = r"`([A-Za-z_]\w*)(?:\(\))?`") -> DataFrame:
    """(file, line, name) of names that documents mention and nothing defines. ``docs`` is (file, line, text), ``known`` (name)."""
    said = docs.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    return said.join(known.select("name").distinct(), "name", "left_anti").select("file", "line", "name")


def concerns(found: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` rules that report most (rule, severity, n), errors before warnings."""
    n = found.groupBy("rule", "severity").agg(F.count("*").alias("n"))
    return n.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), F.desc("n"), "rule").limit(most)


def unindexed(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files found, of them indexed, not indexed, and indexed ones that are gone."""
    both = indexed.select("path", F.lit(1).alias("i")).join(found.select("path", F.lit(1).alias("f")), "path", "full")
    return both.agg(F.count("f").alias("files"), F.count(F.when(F.col("i").isNotNull() & F.col("f").isNotNull(), 1)).alias("indexed"), F.count(F.when(F.col("i").isNull(), 1)).alias("unindexed"), F.count(F.when(F.col("f").isNull(), 1)).alias("gone"))


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, path): files that a dotted module may be, by its folders, as a file or as a package. ``modules`` is (module)."""
    path = F.regexp_replace(F.regexp_replace("path", r"(?:/__init__)?\.[a-z]+$", ""), "/", ".")
    parts = F.split(path, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    return files.select("path", F.explode(ends).alias("module")).join(modules.select("module").distinct(), "module").select("module", "path")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file, module ...) with resolved_file: the file a module is, the nearest by folders it shares with the importer, then by path; null without one."""
    options = module_files(files, imports)
    shared = F.aggregate(F.zip_with(F.split("file", "/"), F.split("path", "/"), lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, same: F.struct((acc["n"] + (acc["on"] & same).cast("int")).alias("n"), (acc["on"] & same).alias("on")))["n"]
    pairs = imports.select("file", "module").distinct().join(options, "module").withColumn("near", shared)
    best = pairs.groupBy("file", "module").agg(F.min_by("path", F.struct(-F.col("near"), F.col("path"))).alias("resolved_file"))
    return imports.join(best, ["file", "module"], "left")


def call_neighbours(calls: DataFrame, name: str) -> DataFrame:
    """(side, symbol, file, line) of who calls a name and what functions of that name call, by file and line."""
    callers = calls.where(F.col("callee_name") == name).select(F.lit("caller").alias("side"), F.col("caller_symbol").alias("symbol"), F.col("caller_file").alias("file"), "line")
    callees = calls.where(F.col("caller_symbol") == name).select(F.lit("callee").alias("side"), F.col("callee_name").alias("symbol"), F.col("caller_file").alias("file"), "line")
    return callers.unionByName(callees).distinct()


def search_hinted(symbols: DataFrame, text: str, most: int = 10) -> DataFrame:
    """The best matches for name, Parent.name or file:name: exact names first, then those of the hinted parent or file, then beginnings."""
    hint, _, name = text.replace("::", ".").replace(":", ".").rpartition(".")
    low, want = F.lower("name"), name.lower()
    hit = symbols.where(low.contains(want))
    fits = (F.lower(F.coalesce("parent", F.lit(""))) == hint.lower()) | F.lower("file").contains(hint.lower()) if hint else F.lit(True)
    rank = F.struct((low != want).alias("a"), (~fits).alias("b"), (~low.startswith(want)).alias("c"), F.length("name").alias("n"), F.col("name"), F.col("file"), F.col("start_line"))
    return hit.orderBy(rank).limit(most).select("file", "name", "kind", "start_line")


def dependency_tree(edges: DataFrame, scratch: Scratch, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, path) of all ways down a dependency graph, of ``depth`` steps at most, none through a node twice."""
    return graph.simple_paths(edges, scratch, roots, graph.nodes(edges), depth).select(F.col("start").alias("root"), F.col("target").alias("node"), "depth", "path")


def merge_cochange(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pair counts (a, b, shared) of older and of newer commits as one; counts add up, so commits are read once."""
    return old.select("a", "b", "shared").unionByName(fresh.select("a", "b", "shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def longest_paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth, path): for every strong component (by its least node) a longest way to it, the least by text, nodes joined by >."""
    parts = scratch.stage(graph.strongly_connected(edges, scratch))
    folded = scratch.stage(graph.fold(edges, parts))
    depth = scratch.stage(graph.longest_depth(edges, scratch).join(parts, "node").where("node = component").select("node", "depth"))
    front = scratch.stage(depth.where("depth = 0").select("node", "depth", F.col("node").cast("string").alias("path")))
    found, at = front, 0
    while not front.isEmpty():
        at += 1
        own = depth.where(F.col("depth") == at)
        step = front.select(F.col("node").alias("src"), "path").join(folded, "src").join(own, F.col("dst") == own["node"]).groupBy("node", "depth").agg(F.min(F.concat("path", F.lit(">"), F.col("node").cast("string"))).alias("path"))
        front = scratch.stage(step)
        found = found.unionByName(front)
    return found


def fuzzy_groups(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster, members, similarity): components of similar pairs, with the mean over all pairs of members, those that weren't found counting 0."""
    from sparkloom.operators.similarity import clone_clusters

    parts = scratch.stage(clone_clusters(pairs, scratch))
    n = parts.groupBy("cluster").agg(F.count("*").alias("members"))
    s = pairs.join(parts.select(F.col("node").alias("a"), "cluster"), "a").groupBy("cluster").agg(F.sum("similarity").alias("s"))
    return n.join(s, "cluster").select("cluster", "members", F.round(F.col("s") / (F.col("members") * (F.col("members") - 1) / 2), 6).alias("similarity"))


def labels(nodes: DataFrame, by: str, kind: str, most: int = 2) -> DataFrame:
    """(by, label): the ``most`` commonest classes of a group's nodes, joined by +."""
    n = nodes.groupBy(by, health.node_class(F.col(kind)).alias("c")).agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "c"))).where(F.col("r") <= most)
    return top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]), "+").alias("label"))


def unified(*reports: DataFrame) -> DataFrame:
    """Diagnostics of several engines as one report, what two say alike once."""
    return reduce(DataFrame.unionByName, reports).distinct()


def to_diagnostics(found: DataFrame, rule: str, severity: str = "warning", message: Column | None = None, line: Column | None = None) -> DataFrame:
    """(severity, rule, file, line, message) of rows with a file."""
    return found.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("file").cast("string").alias("file"), (F.lit(0) if line is None else line).cast("int").alias("line"), (F.lit("") if message is None else message).cast("string").alias("message"))
