"""Queries over the code index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.operators import facts, index
from sparkloom.plans.fact_tables import TABLES, sql, table
from sparkloom.plans.registry import ORACLES, QUERIES, query

#: Scans: the index table and the columns they give.
SCANS = {
    "scan_files": ("files", "path, is_dir, mtime, lines"),
    "scan_calls": ("calls", "caller_file, caller_symbol, callee_name"),
    "scan_call_lines": ("calls", "caller_file, caller_symbol, callee_name, line"),
    "scan_call_qualifiers": ("calls", "caller_file, caller_symbol, callee_name, callee_qualifier, line"),
    "scan_imports": ("imports", "file, coalesce(module, '') AS module, name, line"),
    "scan_import_edges": ("imports", "file, resolved_file", "resolved_file IS NOT NULL"),
    "scan_import_lines": ("imports", "file, line, resolved_file", "resolved_file IS NOT NULL"),
    "scan_symbols": ("symbols", "file, name, kind, start_line, end_line, parent, visibility, is_impl"),
    "scan_attributes": ("attributes", "file, name, attribute"),
    "scan_implements": ("implements", "file, name, interface"),
    "scan_type_methods": ("type_methods", "file, type_name, method_name"),
    "scan_cfg_edges": ("cfg_edges", "file, func, func_line, from_block, to_block, kind, coalesce(exception_type, '') AS exception_type"),
    "scan_cfg_effects": ("cfg_effects", "file, func, func_line, block, kind, line, coalesce(label, '') AS label"),
    "doc_comments": ("attributes", "file, name, substr(attribute, 5) AS doc", "attribute LIKE 'doc:%'"),
    "find_symbol": ("symbols", "file, kind, start_line, end_line", "name = 'red_widget'"),
    "find_importers": ("imports", "file, name, line", "module = 'mod1' OR module LIKE 'mod1%'"),
    "methods_of_type": ("type_methods", "DISTINCT method_name", "type_name = 'T3'"),
    "files_of_type": ("type_methods", "DISTINCT file", "type_name = 'T3'"),
    "imports_of_file": ("imports", "name, module, resolved_file", "file = 'Brand#4/promo_test.py' AND resolved_file IS NOT NULL"),
    "distinct_names": ("symbols", "DISTINCT name"),
    "count_files": ("files", "count(*) AS n", "is_dir = 0"),
}


def _scan(name: str, source: str, columns: str, where: str = "true") -> None:
    def run(spark, d):
        rows = table(spark, d, source).where(where)
        if columns.startswith("count(*)"):
            return rows.agg(F.count("*").alias("n"))
        wanted = columns.removeprefix("DISTINCT ")
        depth, parts, now = 0, [], ""
        for c in wanted + ",":
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(now.strip())
                now = ""
            else:
                now += c
        out = rows.selectExpr(*parts)
        return out.distinct() if wanted != columns else out

    run.__name__, run.__doc__, run.__module__ = name, f"Index scan of {source}.", __name__
    QUERIES[name], ORACLES[name] = run, sql(source, f"SELECT {columns} FROM {source} WHERE {where}")


for _name, _spec in SCANS.items():
    _scan(_name, *_spec)

_ADHOC = """WITH hot AS (SELECT callee_name, count(*) AS n FROM calls GROUP BY callee_name)
SELECT s.kind, h.callee_name, n, rank() OVER (PARTITION BY s.kind ORDER BY n DESC) AS place FROM hot h JOIN symbols s ON s.name = h.callee_name GROUP BY s.kind, h.callee_name, n"""


@query(sql("calls symbols", ", " + _ADHOC.removeprefix("WITH ")))
def adhoc_sql(spark, d):
    return index.raw_query(spark, _ADHOC, {n: table(spark, d, n) for n in ("calls", "symbols")})


@query(sql("files", "SELECT '{\"path\":\"' || path || '\",\"lines\":' || CAST(lines AS VARCHAR) || '}' AS json FROM files"))
def adhoc_json(spark, d):
    return index.as_json(index.raw_query(spark, "SELECT path, lines FROM files", {"files": table(spark, d, "files")}))


@query(sql(" ".join(TABLES), " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES)).replace("UNION ALL", "UNION ALL"))
def table_counts(spark, d):
    return index.union_all({n: table(spark, d, n).agg(F.count("*").alias("n")) for n in TABLES}, "name")


@query(sql("files", "SELECT path FROM files WHERE path = 'promo_test.py' OR path LIKE '%/promo_test.py'"))
def find_by_name(spark, d):
    return index.by_name(table(spark, d, "files"), "promo_test.py").select("path")


@query(sql("files", "SELECT path FROM files WHERE path LIKE '%/sm%'"))
def find_by_stem(spark, d):
    return index.by_stem(table(spark, d, "files"), "sm").select("path")


@query(sql("imports files", "SELECT path, count(name) > 0 AS imports_it FROM files LEFT JOIN imports ON file = path AND name = 'red_widget' GROUP BY path"))
def has_import_named(spark, d):
    has = table(spark, d, "imports").where("name = 'red_widget'").select(F.col("file").alias("path"), F.lit(True).alias("x")).distinct()
    return table(spark, d, "files").join(has, "path", "left").select("path", F.coalesce("x", F.lit(False)).alias("imports_it"))


@query(sql("symbols files", "SELECT path, path IN (SELECT file FROM symbols WHERE name = 'red_widget' AND parent IS NULL) AS defines_it FROM files"))
def exports_symbol(spark, d):
    has = table(spark, d, "symbols").where("name = 'red_widget' and parent is null").select(F.col("file").alias("path"), F.lit(True).alias("x")).distinct()
    return table(spark, d, "files").join(has, "path", "left").select("path", F.coalesce("x", F.lit(False)).alias("defines_it"))


@query(sql("calls", "SELECT callee_name, line, callee_qualifier FROM calls WHERE caller_file = 'Brand#8/large.py' AND caller_symbol = 'red_widget'"))
def callees(spark, d):
    return index.callees(table(spark, d, "calls"), "Brand#8/large.py", "red_widget")


@query(sql("calls imports", "SELECT DISTINCT caller_file, caller_symbol, callee_name, c.line, i.resolved_file FROM calls c LEFT JOIN imports i ON i.file = caller_file AND callee_name = coalesce(i.alias, i.name)"))
def callees_resolved(spark, d):
    return index.callees_resolved(table(spark, d, "calls"), table(spark, d, "imports"))


@query(sql("symbols imports calls", """, b AS (SELECT file AS f, resolved_file, name AS original, coalesce(alias, name) AS loc, module FROM imports), ca AS (SELECT caller_file, caller_symbol, callee_name AS c, callee_qualifier AS q, callee_resolved_file AS rf, line FROM calls)
SELECT file, name, caller_file, caller_symbol, line FROM ca JOIN symbols ON rf = file AND c = name
UNION SELECT file, name, caller_file, caller_symbol, line FROM ca JOIN symbols ON q IS NULL AND caller_file = file AND c = name
UNION SELECT file, s.name, caller_file, caller_symbol, line FROM ca JOIN b ON caller_file = f AND c = loc JOIN symbols s ON resolved_file = file AND original = s.name
UNION SELECT file, s.name, caller_file, caller_symbol, line FROM ca JOIN b ON caller_file = f AND q = module JOIN symbols s ON resolved_file = file AND c = s.name
UNION SELECT t.file, t.name, caller_file, caller_symbol, line FROM ca JOIN symbols o ON q = 'self' AND o.file = caller_file AND o.name = caller_symbol JOIN symbols t ON t.file = caller_file AND t.name = c AND t.parent = o.parent"""))
def callers_by_class(spark, d):
    return facts.callers(table(spark, d, "symbols"), table(spark, d, "imports"), table(spark, d, "calls"))


@query(sql("imports", "SELECT file, name, alias, line, module FROM imports WHERE name = 'blue_bolt'"))
def symbol_importers(spark, d):
    return index.symbol_importers(table(spark, d, "imports"), "blue_bolt")


@query(sql("imports symbols", """, n AS (SELECT DISTINCT file, coalesce(alias, name) AS local, module, name AS original FROM imports WHERE name <> '*'),
w AS (SELECT DISTINCT i.file, s.name AS local, module, s.name AS original FROM imports i JOIN symbols s ON s.file = i.resolved_file AND s.parent IS NULL WHERE i.name = '*')
SELECT * FROM n UNION ALL SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file = w.file AND n.local = w.local)"""))
def resolve_import(spark, d):
    return index.resolve_name(table(spark, d, "imports"), table(spark, d, "symbols"))


@query(sql("calls symbols", "SELECT DISTINCT caller_file || ':' || caller_symbol AS src, file || ':' || name AS dst FROM calls JOIN symbols ON callee_name = name WHERE caller_file || ':' || caller_symbol <> file || ':' || name"))
def call_graph(spark, d):
    return index.call_graph(table(spark, d, "calls"), table(spark, d, "symbols"))


@query(sql("calls symbols", """, f AS (SELECT name, min(file) AS first FROM symbols GROUP BY 1),
x AS (SELECT DISTINCT caller_file || ':' || caller_symbol AS src, CASE WHEN (caller_file, callee_name) IN (SELECT (file, name) FROM symbols) THEN caller_file ELSE first END || ':' || callee_name AS dst FROM calls JOIN f ON callee_name = name)
SELECT src, dst FROM x WHERE src <> dst"""))
def call_edges_near(spark, d):
    return index.call_edges_near(table(spark, d, "calls"), table(spark, d, "symbols"))


@query(sql("calls symbols attributes", """, t AS (SELECT DISTINCT file, name FROM attributes WHERE attribute = '#[test]'), c AS (SELECT DISTINCT caller_file, caller_symbol, callee_name FROM calls),
n AS (SELECT callee_name, count(*) AS callers, count(t.file) AS test_callers FROM c LEFT JOIN t ON caller_file = file AND caller_symbol = name GROUP BY 1),
p AS (SELECT file, name, max(end_line - start_line) AS loc FROM symbols WHERE visibility = 'public' AND kind IN ('function', 'method') GROUP BY 1, 2)
SELECT file, name, coalesce(callers, 0) AS callers, coalesce(test_callers, 0) AS test_callers, round(CASE WHEN coalesce(test_callers, 0) = 0 THEN loc * ln(coalesce(callers, 0) + 1) ELSE 0 END, 6) AS risk FROM p LEFT JOIN n ON callee_name = name"""))
def test_gaps(spark, d):
    tests = table(spark, d, "attributes").where("attribute = '#[test]'").select("file", "name")
    return index.test_gaps(table(spark, d, "symbols"), table(spark, d, "calls"), tests)


@query(sql("calls symbols", "SELECT file, line, min(what) AS what FROM (SELECT file, CAST(start_line AS INT) AS line, 'definition' AS what FROM symbols WHERE name = 'hot_gear' UNION ALL SELECT caller_file, line, 'reference' FROM calls WHERE callee_name = 'hot_gear') GROUP BY 1, 2"))
def references(spark, d):
    return index.references(table(spark, d, "symbols"), table(spark, d, "calls"), "hot_gear")


@query(sql("calls symbols", """, n AS (SELECT callee_name AS name, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100)
SELECT n.name, n, min(file) AS file FROM n JOIN symbols s ON s.name = n.name WHERE n > 3 AND n.name <> 'print' GROUP BY 1, 2"""))
def symbol_hotspots(spark, d):
    return index.symbol_hotspots(table(spark, d, "calls"), table(spark, d, "symbols"))


@query(sql("symbols imports", "SELECT file, count(*) AS symbols FROM symbols WHERE file NOT IN (SELECT resolved_file FROM imports WHERE resolved_file IS NOT NULL) AND file NOT LIKE '%\\_test.py' ESCAPE '\\' GROUP BY 1"))
def orphan_modules(spark, d):
    return index.orphan_modules(table(spark, d, "symbols"), table(spark, d, "imports"))


@query(sql("symbols imports", """, f AS (SELECT resolved_file AS file, count(DISTINCT file) AS fan_in FROM imports WHERE resolved_file IS NOT NULL GROUP BY 1),
s AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE visibility = 'public') AS public FROM symbols GROUP BY 1)
SELECT file, total, public, total - public AS private, round(public / total, 9) AS ratio, coalesce(fan_in, 0) AS fan_in, public * coalesce(fan_in, 0) AS pressure FROM s LEFT JOIN f USING (file)"""))
def surface(spark, d):
    return index.surface(table(spark, d, "symbols"), table(spark, d, "imports"))


@query(sql("imports", "SELECT module, count(DISTINCT file) AS importers, array_to_string(list_sort(list(DISTINCT name))[1:5], ',') AS names FROM imports GROUP BY 1"))
def import_centrality(spark, d):
    return index.centrality(table(spark, d, "imports"))


@query(sql("symbols", "SELECT file, count(*) AS callables, count(*) FILTER (WHERE is_impl) AS impls, round(count(*) FILTER (WHERE is_impl) / count(*), 9) AS ratio FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1 HAVING count(*) >= 2"))
def ceremony(spark, d):
    return index.ceremony(table(spark, d, "symbols"), F.col("file"))


@query(sql("files", "SELECT split_part(path, '/', 1) AS module, CAST(sum(CASE WHEN path LIKE '%test.py' THEN 0 ELSE lines END) AS BIGINT) AS impl, CAST(sum(CASE WHEN path LIKE '%test.py' THEN lines ELSE 0 END) AS BIGINT) AS test, round(sum(CASE WHEN path LIKE '%test.py' THEN lines ELSE 0 END) / sum(lines), 9) AS ratio FROM files GROUP BY 1"))
def test_ratio(spark, d):
    return index.test_ratio(table(spark, d, "files"))


@query(sql("files", "SELECT CASE WHEN path LIKE '%test.py' THEN 'test' ELSE 'logic' END AS category, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(100 * sum(lines) / (SELECT sum(lines) FROM files), 6) AS pct FROM files GROUP BY 1"))
def line_budget(spark, d):
    return index.line_budget(table(spark, d, "files"))


@query(sql("calls", """, n AS (SELECT callee_name, caller_symbol, count(*) AS n FROM calls GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY callee_name ORDER BY n DESC, caller_symbol) AS INT) AS place FROM n)
SELECT * FROM r WHERE place <= 10"""))
def top_callers(spark, d):
    return index.top_callers(table(spark, d, "calls"))


@query(sql("calls", "SELECT caller_symbol, count(DISTINCT callee_name) AS callees, array_to_string(list_sort(list(DISTINCT callee_name)), ',') AS names FROM calls GROUP BY 1"))
def callees_by_symbol(spark, d):
    return table(spark, d, "calls").groupBy("caller_symbol").agg(F.countDistinct("callee_name").alias("callees"), F.array_join(F.array_sort(F.collect_set("callee_name")), ",").alias("names"))


@query(sql("implements type_methods", "SELECT DISTINCT i.file, i.name, i.interface, o.method_name AS method FROM implements i JOIN type_methods a ON a.type_name = 'T' || substr(i.interface, 2) JOIN type_methods o ON o.type_name = i.name AND o.method_name = a.method_name"))
def interface_methods(spark, d):
    i = table(spark, d, "implements")
    got = index.implementations(i.withColumn("interface", F.concat(F.lit("T"), F.substring("interface", 2, 9))), table(spark, d, "type_methods"))
    return got.withColumn("interface", F.concat(F.lit("I"), F.substring("interface", 2, 9)))


@query(sql("symbols", "SELECT *, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM symbols) AS pages FROM (SELECT file, name, start_line FROM symbols ORDER BY file, name, start_line LIMIT 25 OFFSET 50)"))
def page_of_symbols(spark, d):
    return index.pages(table(spark, d, "symbols").select("file", "name", "start_line"), ["file", "name", "start_line"], 25, 3)


@query(sql("files", "SELECT path, regexp_matches(path, '^(?:.*/)?Brand#1[^/]*/.*$') AND NOT regexp_matches(path, '_test\\.py$') AS kept FROM files"))
def glob_filter(spark, d):
    only, _ = globs.resolve(["@brand"], {"brand": ["**/Brand#1*/**"]})
    exclude, _ = globs.resolve(["@tests"])
    return table(spark, d, "files").select("path", globs.selected(F.col("path"), only, exclude).alias("kept"))


@query(sql("files", "SELECT path, path LIKE '%\\_test.py' ESCAPE '\\' AS test, false AS generated FROM files"))
def path_predicates(spark, d):
    return table(spark, d, "files").select("path", index.is_test_path(F.col("path")).alias("test"), index.is_generated(F.col("path")).alias("generated"))


@query(sql("files commit_files", """, x AS (SELECT 'Brand#' || CAST(path % 25 AS VARCHAR) || '/economy.py' AS path, max(id) AS mtime FROM commit_files GROUP BY 1)
SELECT path, CASE WHEN f.mtime IS NULL THEN 'added' WHEN x.mtime IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM files f FULL JOIN x USING (path) WHERE f.mtime IS DISTINCT FROM x.mtime"""))
def changed_files(spark, d):
    found = table(spark, d, "commit_files").groupBy(F.concat(F.lit("Brand#"), (F.col("path") % 25).cast("string"), F.lit("/economy.py")).alias("path")).agg(F.max("id").alias("mtime"))
    return index.changed_files(table(spark, d, "files"), found)


@query(sql("symbols", """, o AS (SELECT file, name, start_line FROM symbols), g AS (SELECT DISTINCT file FROM o WHERE file LIKE '%small.py'), n AS (SELECT file, 'new_' || name AS name, start_line FROM o WHERE file LIKE '%large.py')
SELECT * FROM o WHERE file NOT IN (SELECT file FROM g) AND file NOT IN (SELECT file FROM n) UNION ALL SELECT * FROM n"""))
def reindex_files(spark, d):
    rows = table(spark, d, "symbols").select("file", "name", "start_line")
    fresh = rows.where(F.col("file").endswith("large.py")).withColumn("name", F.concat(F.lit("new_"), "name"))
    return index.reindex(rows, "file", rows.where(F.col("file").endswith("small.py")).select("file").distinct(), fresh)


@query(sql("files", "SELECT path, lines, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'other' END AS language, CAST(sum(lines) OVER (PARTITION BY CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'other' END) AS BIGINT) AS language_lines FROM files"))
def file_lengths(spark, d):
    f = table(spark, d, "files").withColumn("language", F.when(F.col("path").endswith(".py"), "python").otherwise("other"))
    return f.join(f.groupBy("language").agg(F.sum("lines").alias("language_lines")), "language").select("path", "lines", "language", "language_lines")


@query(sql("symbols", "SELECT file, max(complexity) AS most, round(avg(complexity), 6) AS mean, count(*) FILTER (WHERE complexity > 10) AS high, count(*) FILTER (WHERE complexity > 20) AS critical FROM symbols WHERE kind <> 'class' GROUP BY 1"))
def complexity_by_file(spark, d):
    s = table(spark, d, "symbols").where("kind <> 'class'")
    over = lambda n: F.sum((F.col("complexity") > n).cast("long"))
    return s.groupBy("file").agg(F.max("complexity").alias("most"), F.round(F.avg("complexity"), 6).alias("mean"), over(10).alias("high"), over(20).alias("critical"))


@query(sql("symbols", "SELECT CASE WHEN end_line - start_line <= 20 THEN '1-20' WHEN end_line - start_line <= 50 THEN '21-50' ELSE '51-100' END AS band, count(*) AS n FROM symbols WHERE kind <> 'class' GROUP BY 1"))
def length_bands(spark, d):
    n = F.col("end_line") - F.col("start_line")
    band = F.when(n <= 20, "1-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise(">100")
    return table(spark, d, "symbols").where("kind <> 'class'").groupBy(band.alias("band")).agg(F.count("*").alias("n"))
