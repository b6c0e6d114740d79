"""Lookups and joins over a code index: files, symbols, imports, calls and what hangs on them.

Columns are those of the tables in ``plans/fact_tables.py``; a null or missing match gives no row unless a docstring
says otherwise, and repeated rows stay repeated unless it says distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Names too common to count as hotspots, and files that nothing needs to import.
GENERIC = ("new", "default", "from", "into", "clone", "drop", "fmt", "eq", "hash", "cmp", "len", "get", "set", "push", "pop", "print", "main", "init", "unwrap", "to_string")
ENTRY_NAMES = r"(^|/)(main|lib|mod|index|__init__|__main__|setup|conftest|build)\.[a-z]+$"
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_tests?\.[a-z]+$|\.(test|spec)\.[a-z]+$"
GENERATED = r"(^|/)(Cargo\.lock|package-lock\.json|yarn\.lock|poetry\.lock|go\.sum)$|\.min\.(js|css)$|\.pb\.go$|_pb2\.py$|\.generated\.[a-z]+$|(^|/)(target|node_modules|dist|build)/"


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def raw_query(spark, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Any SQL over the named tables; they are views of this call only."""
    views = {}
    for name, df in tables.items():
        views[name] = f"loom_{name}"
        df.createOrReplaceTempView(views[name])
    try:
        heads = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        body = text.strip()
        joined = f"WITH {heads}, {body[4:].strip()}" if body[:5].lower() == "with " else f"WITH {heads} {body}"
        return spark.sql(joined)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def as_json(df: DataFrame) -> DataFrame:
    """One column json: each row as an object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def by_name(files: DataFrame, name: str) -> DataFrame:
    """Files of a name: the path itself or what follows its last slash."""
    return files.where((F.col("path") == name) | F.col("path").endswith("/" + name))


def by_stem(files: DataFrame, stem: str) -> DataFrame:
    """Files below a folder whose name starts with the stem."""
    return files.where(F.col("path").contains("/" + stem))


def callees(calls: DataFrame, file: str, symbol: str) -> DataFrame:
    """(callee_name, line, callee_qualifier) of one caller, by line."""
    return calls.where((F.col("caller_file") == file) & (F.col("caller_symbol") == symbol)).select("callee_name", "line", "callee_qualifier")


def bindings(imports: DataFrame) -> DataFrame:
    """(file, local, original, module, resolved_file): what an import calls things."""
    return imports.select("file", F.coalesce("alias", "name").alias("local"), F.col("name").alias("original"), "module", "resolved_file")


def callees_resolved(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller_file, caller_symbol, callee_name, line, resolved_file): every call with the files its name is imported from, null without one."""
    b = bindings(imports).select(F.col("file").alias("caller_file"), F.col("local").alias("callee_name"), "resolved_file")
    return calls.select("caller_file", "caller_symbol", "callee_name", "line").join(b, ["caller_file", "callee_name"], "left").distinct()


def importers(imports: DataFrame, module: str) -> DataFrame:
    """(file, name, line) of imports from the module or one whose name it starts."""
    return imports.where(F.col("module").startswith(module)).select("file", "name", "line")


def symbol_importers(imports: DataFrame, name: str) -> DataFrame:
    """(file, name, alias, line, module) of imports of a symbol by its own name."""
    return imports.where(F.col("name") == name).select("file", "name", "alias", "line", "module")


def resolve_name(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, local, module, original): where each name called in a file comes from.

    A name or alias that the file imports; only where there is none, a wildcard import from a file that has the name.
    """
    b = bindings(imports)
    named = b.where("original <> '*'").select("file", "local", "module", "original").distinct()
    exported = symbols.where("parent is null").select(F.col("file").alias("resolved_file"), F.col("name").alias("local")).distinct()
    star = b.where("original = '*'").select("file", "module", "resolved_file").join(exported, "resolved_file").select("file", "local", "module", F.col("local").alias("original")).distinct()
    return named.unionByName(star.join(named, ["file", "local"], "left_anti"))


def call_graph(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) distinct: callers and all symbols of the called name, as file:name, without self-edges."""
    node = F.concat_ws(":", "file", "name")
    targets = symbols.select(F.col("name").alias("callee_name"), node.alias("dst")).distinct()
    return calls.select(F.concat_ws(":", "caller_file", "caller_symbol").alias("src"), "callee_name").distinct().join(targets, "callee_name").where("src <> dst").select("src", "dst").distinct()


def call_edges_near(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) distinct: each call to one symbol of its name, that of the same file if there is one, else the first by file."""
    firsts = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.min("file").alias("first"))
    own = symbols.select(F.col("name").alias("callee_name"), F.col("file").alias("caller_file"), F.lit(True).alias("own")).distinct()
    both = calls.select("caller_file", "caller_symbol", "callee_name").distinct().join(firsts, "callee_name").join(own, ["callee_name", "caller_file"], "left")
    target = F.concat_ws(":", F.when(F.col("own"), F.col("caller_file")).otherwise(F.col("first")), "callee_name")
    return both.select(F.concat_ws(":", "caller_file", "caller_symbol").alias("src"), target.alias("dst")).where("src <> dst").distinct()


def test_gaps(symbols: DataFrame, calls: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, name, callers, test_callers, risk): public functions with who calls them by name; risk is size times ln of callers, for those no test calls.

    ``tests`` is (file, name) of test functions.
    """
    test = tests.select(F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"), F.lit(1).alias("t")).distinct()
    by = calls.select("caller_file", "caller_symbol", F.col("callee_name").alias("name")).distinct().join(test, ["caller_file", "caller_symbol"], "left")
    by = by.groupBy("name").agg(F.count("*").alias("callers"), F.count("t").alias("test_callers"))
    out = symbols.where("visibility = 'public' and kind in ('function', 'method')").groupBy("file", "name").agg(F.max(F.col("end_line") - F.col("start_line")).alias("loc")).join(by, "name", "left").fillna(0, ["callers", "test_callers"])
    risk = F.when(F.col("test_callers") == 0, F.col("loc") * F.log(F.col("callers") + 1)).otherwise(0.0)
    return out.select("file", "name", "callers", "test_callers", F.round(risk, 6).alias("risk"))


def references(symbols: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """(file, line, what) distinct by place: definitions and calls of a name; a place that is both counts as a definition."""
    found = symbols.where(F.col("name") == name).select("file", F.col("start_line").cast("int").alias("line"), F.lit("definition").alias("what"))
    used = calls.where(F.col("callee_name") == name).select(F.col("caller_file").alias("file"), "line", F.lit("reference").alias("what"))
    return found.unionByName(used).groupBy("file", "line").agg(F.min("what").alias("what"))


def symbol_hotspots(calls: DataFrame, symbols: DataFrame, top: int = 100, least: int = 3) -> DataFrame:
    """(name, n, file): the most called names that aren't generic, called more than ``least`` times, with the first file that defines them."""
    n = calls.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    where = symbols.groupBy("name").agg(F.min("file").alias("file"))
    return n.where((F.col("n") > least) & ~F.col("name").isin(*GENERIC)).join(where, "name").select("name", "n", "file")


def orphan_modules(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, symbols): files that nothing imports, entry files and tests aside."""
    used = imports.where("resolved_file is not null").select(F.col("resolved_file").alias("file"))
    out = symbols.groupBy("file").agg(F.count("*").alias("symbols")).join(used, "file", "left_anti")
    return out.where(~F.col("file").rlike(ENTRY_NAMES) & ~is_test_path(F.col("file")))


def surface(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, total, public, private, ratio, fan_in, pressure): what a file shows, and public symbols times importers."""
    fan = imports.where("resolved_file is not null").groupBy(F.col("resolved_file").alias("file")).agg(F.countDistinct("file").alias("fan_in"))
    s = symbols.groupBy("file").agg(F.count("*").alias("total"), F.sum((F.col("visibility") == "public").cast("long")).alias("public"))
    s = s.join(fan, "file", "left").fillna(0, ["fan_in"])
    return s.select("file", "total", "public", (F.col("total") - F.col("public")).alias("private"), F.round(F.col("public") / F.col("total"), 9).alias("ratio"), "fan_in", (F.col("public") * F.col("fan_in")).alias("pressure"))


def centrality(imports: DataFrame, names: int = 5) -> DataFrame:
    """(module, importers, names): distinct importing files of a module and the first few names taken from it."""
    each = F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, names), ",")
    return imports.groupBy("module").agg(F.countDistinct("file").alias("importers"), each.alias("names"))


def ceremony(symbols: DataFrame, by: Column) -> DataFrame:
    """(by, callables, impls, ratio): how many of the callables only fulfil an interface; groups of two callables or more."""
    out = symbols.where("kind in ('function', 'method')").groupBy(by).agg(F.count("*").alias("callables"), F.sum(F.col("is_impl").cast("long")).alias("impls")).where("callables >= 2")
    return out.withColumn("ratio", F.round(F.col("impls") / F.col("callables"), 9))


def test_ratio(files: DataFrame) -> DataFrame:
    """(module, impl, test, ratio): test lines over all lines per module, the least tested first."""
    test = is_test_path(F.col("path"))
    out = files.groupBy(F.substring_index("path", "/", 1).alias("module")).agg(F.sum(F.when(~test, F.col("lines")).otherwise(0)).alias("impl"), F.sum(F.when(test, F.col("lines")).otherwise(0)).alias("test"))
    return out.withColumn("ratio", F.round(F.col("test") / (F.col("impl") + F.col("test")), 9))


def line_budget(files: DataFrame) -> DataFrame:
    """(category, files, lines, pct): lines by vendored, generated, test, doc, config or logic, the first that fits."""
    p = F.col("path")
    kind = (
        F.when(p.rlike(r"(^|/)(vendor|third_party|node_modules)/"), "vendored").when(is_generated(p), "generated").when(is_test_path(p), "test")
        .when(p.rlike(r"\.(md|rst|txt)$|(^|/)docs?/"), "doc").when(p.rlike(r"\.(toml|ya?ml|json|ini|cfg)$"), "config").otherwise("logic")
    )
    out = files.groupBy(kind.alias("category")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    total = out.agg(F.sum("lines").alias("t"))
    return out.join(F.broadcast(total), F.lit(True)).select("category", "files", "lines", F.round(100 * F.col("lines") / F.col("t"), 6).alias("pct"))


def top_callers(calls: DataFrame, k: int = 10) -> DataFrame:
    """(callee_name, caller_symbol, n, place): the callers that call each name most, ``k`` a name."""
    n = calls.groupBy("callee_name", "caller_symbol").agg(F.count("*").alias("n"))
    w = Window.partitionBy("callee_name").orderBy(F.desc("n"), "caller_symbol")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def implementations(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(file, name, interface, method) distinct: the methods that a type has of an interface's own, in whatever file that is."""
    asked = methods.select(F.col("type_name").alias("interface"), F.col("method_name").alias("method")).distinct()
    own = methods.select(F.col("type_name").alias("name"), F.col("method_name").alias("method")).distinct()
    return implements.join(asked, "interface").join(own, ["name", "method"]).select("file", "name", "interface", "method").distinct()


def pages(df: DataFrame, order: list[str], size: int, page: int) -> DataFrame:
    """The ``page``-th (from 1) run of ``size`` rows in an order, with the number of pages there are."""
    total = df.agg(F.ceil(F.count("*") / size).cast("long").alias("pages"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))


def union_all(parts: dict[str, DataFrame], tag: str = "repo") -> DataFrame:
    """Reports of several sources as one, each row tagged by its source."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def changed_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, modified (another mtime) or deleted against what is indexed; both are (path, mtime)."""
    both = indexed.select("path", F.col("mtime").alias("was")).join(found.select("path", F.col("mtime").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def reindex(rows: DataFrame, key: str, deleted: DataFrame, fresh: DataFrame) -> DataFrame:
    """A fact table after some files changed: rows of the deleted and of the fresh files' keys go, the fresh rows come. ``deleted`` has the key alone."""
    gone = deleted.select(key).union(fresh.select(key)).distinct()
    return rows.join(gone, key, "left_anti").unionByName(fresh)


def resolve_target(files: DataFrame, symbols: DataFrame, text: str) -> DataFrame:
    """(path, what) of a path, or of a symbol in one, named as path::symbol, path#symbol, path:symbol or path/symbol.

    A path is one as it stands, or one that ends in it; ``what`` is file or the symbol's name. A text that can be read
    in several ways gives what each finds.
    """
    found = [files.where((F.col("path") == text) | F.col("path").endswith("/" + text)).select("path", F.lit("file").alias("what"))]
    for mark in ("::", "#", "/") if "::" in text else ("#", ":", "/"):
        if mark in text:
            path, name = text.rsplit(mark, 1)
            own = symbols.where((F.col("name") == name) & ((F.col("file") == path) | F.col("file").endswith("/" + path)))
            found.append(own.select(F.col("file").alias("path"), F.col("name").alias("what")))
    return reduce(DataFrame.unionByName, found).distinct()
