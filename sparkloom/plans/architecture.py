"""Queries over whole graphs of imports, calls, types and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalar, texts
from sparkloom.operators import facts, graph, history, index
from sparkloom.plans.fact_tables import sql, table
from sparkloom.plans.graphs import _DEGREES, _DEPTH, _E, _N, _REACH, _SCC
from sparkloom.plans.registry import part_edges, query
from sparkloom.runtime import Scratch, load

_KNOTS = "k AS (SELECT component, count(*) AS size FROM sc GROUP BY 1 HAVING count(*) > 1), i AS (SELECT a.component, count(*) AS internal FROM e JOIN sc a ON src = a.node JOIN sc b ON dst = b.node WHERE a.component = b.component GROUP BY 1)"


@query(f"WITH RECURSIVE {_E}, {_REACH}, {_N}, {_SCC}, {_KNOTS} SELECT component, size, internal FROM k JOIN i USING (component)")
def knots(spark, d):
    e = part_edges(spark, d)
    return graph.knots(e, graph.strongly_connected(e, Scratch(spark, "knots")))


@query(f"WITH {_E} SELECT count(*) AS n FROM (SELECT DISTINCT z.src, z.dst FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE x.dst <> z.src AND x.dst <> z.dst)")
def redundant_count(spark, d):
    return graph.redundant(part_edges(spark, d)).agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {_E}, p(start, node, depth, path) AS (SELECT DISTINCT src, src, 0, [src] FROM e WHERE src % 200 = 0 UNION ALL SELECT start, dst, depth + 1, list_append(path, dst) FROM p JOIN e ON node = src WHERE depth < 4 AND NOT list_contains(path, dst))
SELECT start, node AS target, depth, array_to_string(path, '>') AS path FROM p WHERE depth > 0 AND node % 200 = 50
""")
def simple_paths(spark, d):
    e = part_edges(spark, d)
    n = graph.nodes(e)
    return graph.simple_paths(e, Scratch(spark, "simple"), e.where("src % 200 = 0").select("src"), n.where("node % 200 = 50"), 4)


@query(f"""
WITH RECURSIVE {_E}, p(start, node, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON node = src WHERE len(path) < 4 AND dst > start AND NOT list_contains(path, dst))
SELECT CAST(len(path) AS INT) AS length, array_to_string(path, '>') AS path FROM p JOIN e ON node = src AND start = dst
""")
def simple_cycles(spark, d):
    return graph.simple_cycles(part_edges(spark, d), Scratch(spark, "cycles"), 4)


@query(f"""
WITH RECURSIVE {_E}, {_DEPTH}, {_DEGREES}, ds AS (SELECT dst AS node, count(*) AS downstream FROM r WHERE src <> dst GROUP BY dst)
SELECT node, fan_out, depth, coalesce(downstream, 0) AS downstream, fan_out * depth * coalesce(downstream, 0) AS score FROM g JOIN dm USING (node) LEFT JOIN ds USING (node)
""")
def ripple(spark, d):
    return graph.ripple(part_edges(spark, d), Scratch(spark, "ripple"))


@query(f"""
WITH RECURSIVE {_E}, {_DEPTH}, y AS (SELECT p_partkey AS node, p_brand AS layer FROM part), a AS (SELECT layer, avg(depth) AS d, count(*) AS nodes FROM dm JOIN y USING (node) GROUP BY layer),
c AS (SELECT x.layer AS f, x2.layer AS t FROM e JOIN y x ON src = x.node JOIN y x2 ON dst = x2.node WHERE x.layer <> x2.layer),
s AS (SELECT f AS layer, count(*) FILTER (WHERE q.d > p.d) AS down, count(*) FILTER (WHERE q.d < p.d) AS up, count(*) FILTER (WHERE q.d = p.d) AS level FROM c JOIN a p ON f = p.layer JOIN a q ON t = q.layer GROUP BY f)
SELECT layer, nodes, round(d, 6) AS mean_depth, coalesce(down, 0) AS down, coalesce(up, 0) AS up, coalesce(level, 0) AS level, round(CASE WHEN coalesce(down + up, 0) = 0 THEN 1.0 ELSE down / (down + up) END, 9) AS compliance FROM a LEFT JOIN s USING (layer)
""")
def layer_summary(spark, d):
    e = part_edges(spark, d)
    layer = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("layer"))
    return graph.layer_summary(e, graph.longest_depth(e, Scratch(spark, "summary")), layer)


@query(f"""
WITH RECURSIVE {_E}, {_REACH}, {_N}, {_SCC}, {_KNOTS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(src, dst) AS (SELECT src, dst FROM b UNION SELECT w.src, b.dst FROM w JOIN b ON w.dst = b.src)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT least(node, m)) FROM (SELECT node, min(w.dst) AS m FROM n LEFT JOIN w ON src = node GROUP BY 1)) AS weak, (SELECT count(DISTINCT component) FROM sc) AS strong,
  (SELECT count(*) FROM k) AS knots, CAST((SELECT coalesce(sum(internal), 0) FROM i JOIN k USING (component)) AS BIGINT) AS knotted, (SELECT count(*) FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst) AS mutual,
  round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9) AS density
""")
def graph_report(spark, d):
    return graph.report(part_edges(spark, d), Scratch(spark, "report"))


@query(sql("imports", "SELECT DISTINCT file AS src, resolved_file AS dst FROM imports WHERE resolved_file IS NOT NULL AND file <> resolved_file"))
def import_graph(spark, d):
    return graph.clean(table(spark, d, "imports").select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")))


@query(sql("implements symbols", ", x AS (SELECT name AS src, interface AS dst, 'implements' AS kind FROM implements UNION ALL SELECT parent, name, 'has' FROM symbols WHERE parent IS NOT NULL) SELECT DISTINCT src, dst, kind FROM x"))
def type_graph(spark, d):
    own = table(spark, d, "symbols").where("parent is not null").select(F.col("parent").alias("src"), F.col("name").alias("dst"))
    return graph.typed_edges({"implements": table(spark, d, "implements").select(F.col("name").alias("src"), F.col("interface").alias("dst")), "has": own})


_LINKS = "k AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'cites' ELSE 'extends' END AS kind FROM lineitem)"


@query(f"""
WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT src, dst FROM k WHERE kind = 'cites'), l(start, node, depth) USING KEY (start, node) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src % 100 = 0 UNION
SELECT l.start, e.dst, min(l.depth) + 1 FROM l JOIN e ON l.node = e.src LEFT JOIN recurring.l x ON x.start = l.start AND x.node = e.dst WHERE x.start IS NULL AND l.depth < 2 GROUP BY 1, 2)
SELECT start, node, depth FROM l
""")
def knowledge_walk(spark, d):
    k = load(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "cites").otherwise("extends").alias("kind")).distinct()
    starts = k.where("kind = 'cites' and src % 100 = 0").select("src").distinct()
    return graph.walk(k, Scratch(spark, "walk"), starts, ("cites",), max_depth=2, include_start=True)


@query(sql("imports calls commits commit_files", """, co AS (SELECT a.path AS x, b.path AS y FROM commit_files a JOIN commit_files b ON a.id = b.id AND a.path < b.path JOIN (SELECT id FROM commit_files GROUP BY 1 HAVING count(DISTINCT path) BETWEEN 2 AND 50) s ON s.id = a.id GROUP BY 1, 2 HAVING count(DISTINCT a.id) >= 3),
u AS (SELECT file AS src, resolved_file AS dst, 'imports' AS kind FROM imports UNION ALL SELECT caller_file, callee_name, 'calls' FROM calls UNION ALL SELECT CAST(path AS VARCHAR), CAST(id AS VARCHAR), 'changed_by' FROM commit_files
UNION ALL SELECT CAST(id AS VARCHAR), author, 'written_by' FROM commits UNION ALL SELECT CAST(x AS VARCHAR), CAST(y AS VARCHAR), 'changes_with' FROM co)
SELECT DISTINCT src, dst, kind FROM u WHERE src IS NOT NULL AND dst IS NOT NULL"""))
def provenance_graph(spark, d):
    files = table(spark, d, "commit_files")
    pairs = history.cochange_pairs(files.select(F.col("id").alias("basket"), F.col("path").alias("item")))
    return graph.typed_edges({
        "imports": table(spark, d, "imports").select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")), "calls": table(spark, d, "calls").select(F.col("caller_file").alias("src"), F.col("callee_name").alias("dst")),
        "changed_by": files.select(F.col("path").alias("src"), F.col("id").alias("dst")), "written_by": table(spark, d, "commits").select(F.col("id").alias("src"), F.col("author").alias("dst")),
        "changes_with": pairs.where("shared >= 3").select(F.col("a").alias("src"), F.col("b").alias("dst")),
    })


_DEPS = "dp AS (SELECT 'r' || CAST(l_suppkey % 40 AS VARCHAR) AS repo, 'p' || CAST(l_partkey % 60 AS VARCHAR) AS package, CASE l_linenumber % 3 WHEN 0 THEN '../r' || CAST(l_partkey % 45 AS VARCHAR) WHEN 1 THEN 'git@host:x/R' || CAST(l_partkey % 45 AS VARCHAR) || '.git' ELSE 'p' || CAST(l_partkey % 60 AS VARCHAR) END AS source FROM lineitem), rp AS (SELECT DISTINCT 'r' || CAST(s_suppkey % 40 AS VARCHAR) AS repo FROM supplier)"


@query(f"""
WITH {_DEPS}, h AS (SELECT d.repo AS source_repo, t.repo AS target_repo, package FROM dp d JOIN rp t ON d.source = '../' || t.repo UNION SELECT d.repo, t.repo, package FROM dp d JOIN rp t ON lower(d.source) = 'git@host:x/' || t.repo || '.git'
UNION SELECT d.repo, t.repo, package FROM dp d JOIN rp t ON d.source = 'p' || substr(t.repo, 2))
SELECT DISTINCT source_repo, target_repo, package FROM h WHERE source_repo <> target_repo
""")
def repo_dependencies(spark, d):
    li = load(spark, d, "lineitem")
    k = F.col("l_partkey") % 45
    source = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("../r"), k.cast("string"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("git@host:x/R"), k.cast("string"), F.lit(".git"))).otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string")))
    deps = li.select(F.concat(F.lit("r"), (F.col("l_suppkey") % 40).cast("string")).alias("repo"), F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string")).alias("package"), source.alias("source"))
    n = (F.col("s_suppkey") % 40).cast("string")
    repos = load(spark, d, "supplier").select(F.concat(F.lit("r"), n).alias("repo"), F.concat(F.lit("r"), n).alias("folder"), F.concat(F.lit("https://host/x/r"), n).alias("url"), F.concat(F.lit("p"), n).alias("published")).distinct()
    return facts.repo_dependencies(deps, repos)


@query(sql("symbols imports calls", """, f AS (SELECT count(DISTINCT file) AS files, count(*) AS symbols FROM symbols), e AS (SELECT DISTINCT file AS src, resolved_file AS dst FROM imports WHERE resolved_file IS NOT NULL AND file <> resolved_file)
SELECT files, symbols, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS mutual, (SELECT count(DISTINCT split_part(path, '/', 1)) FROM (SELECT file AS path FROM symbols)) AS layers,
(SELECT count(DISTINCT file) FROM symbols WHERE file NOT IN (SELECT resolved_file FROM imports WHERE resolved_file IS NOT NULL) AND file NOT LIKE '%\\_test.py' ESCAPE '\\') AS orphans, (SELECT callee_name FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS busiest FROM f"""))
def architecture_report(spark, d):
    s, i = table(spark, d, "symbols"), table(spark, d, "imports")
    e = graph.clean(i.select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")))
    busiest = table(spark, d, "calls").groupBy(F.col("callee_name").alias("busiest")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "busiest").limit(1).select("busiest")
    pieces = [e.agg(F.count("*").alias("edges")), graph.mutual(e).agg(F.count("*").alias("mutual")), s.select(scalar.layer_of(F.col("file")).alias("l")).agg(F.countDistinct("l").alias("layers")), index.orphan_modules(s, i).agg(F.count("*").alias("orphans")), busiest]
    out = s.agg(F.countDistinct("file").alias("files"), F.count("*").alias("symbols"))
    for p in pieces:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out


@query("SELECT DISTINCT p_brand || '/' || p_type AS path, p_brand AS layer FROM part")
def layers(spark, d):
    p = load(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path")).distinct()
    return p.select("path", scalar.layer_of(F.concat(F.lit("src/"), "path")).alias("layer"))


@query("SELECT n_name AS unit, regexp_matches(lower(replace(n_name, ' ', '-')), '^[a-z0-9][a-z0-9-]*$') AS ok FROM nation")
def unit_ids(spark, d):
    return load(spark, d, "nation").select(F.col("n_name").alias("unit"), texts.unit_id_ok(F.lower(F.translate("n_name", " ", "-"))).alias("ok"))
