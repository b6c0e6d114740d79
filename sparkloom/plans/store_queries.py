"""Queries over kept tables, metrics between versions, control flow reports, vectors and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import globs, texts
from sparkloom.operators import gates, history, index, rank, stores, vectors
from sparkloom.plans.fact_tables import sql, table
from sparkloom.plans.registry import query
from sparkloom.runtime import Scratch, load
from sparkloom.sources import readers


@query("WITH n AS (SELECT DISTINCT l_partkey AS vec_id FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = 0) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, -1 FROM n")
def upsert_vectors(spark, d):
    fresh = load(spark, d, "lineitem").where("l_linenumber = 1 and l_partkey % 3 = 0").select(F.col("l_partkey").alias("vec_id"), F.lit(-1).alias("label")).distinct()
    return stores.upsert(load(spark, d, "embeddings").select("vec_id", "label"), fresh, "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT n_regionkey FROM nation)")
def delete_by_path(spark, d):
    return stores.delete(load(spark, d, "embeddings").select("vec_id", "label"), load(spark, d, "nation").select(F.col("n_regionkey").alias("label")), "label")


_BLOBS = "b AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS path, CASE p_size % 3 WHEN 0 THEN 'syntax' WHEN 1 THEN 'facts' ELSE 'native' END AS engine, CASE WHEN p_size % 7 = 0 THEN 'h2' ELSE 'h1' END AS config_hash, p_name AS blob FROM part)"


def _blobs(spark, d):
    return load(spark, d, "part").selectExpr("'f' || cast(p_partkey as string) AS path", "CASE p_size % 3 WHEN 0 THEN 'syntax' WHEN 1 THEN 'facts' ELSE 'native' END AS engine", "CASE WHEN p_size % 7 = 0 THEN 'h2' ELSE 'h1' END AS config_hash", "p_name AS blob")


@query(f"WITH {_BLOBS} SELECT path, blob FROM b WHERE engine = 'facts' AND config_hash = 'h1'")
def load_diagnostics(spark, d):
    return stores.load_blobs(_blobs(spark, d), "facts", "h1").select("path", "blob")


@query(f"WITH {_BLOBS}, f AS (SELECT DISTINCT 'f' || CAST(s_suppkey AS VARCHAR) AS path FROM supplier) SELECT path, blob FROM b WHERE config_hash = 'h1' AND path IN (SELECT path FROM f)")
def load_diagnostics_of(spark, d):
    files = load(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    return stores.keep_marked(_blobs(spark, d).where("config_hash = 'h1'"), files, "path").select("path", "blob")


@query(f"WITH {_BLOBS} SELECT DISTINCT path FROM b")
def list_diagnostics(spark, d):
    return _blobs(spark, d).select("path").distinct()


@query(f"""
WITH {_BLOBS}, g AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_nationkey = 3), u AS (SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS path, 'native' AS engine, 'h3' AS config_hash, s_name AS blob FROM supplier)
SELECT * FROM b WHERE path NOT IN (SELECT path FROM g) AND path NOT IN (SELECT path FROM u) UNION ALL SELECT * FROM u
""")
def save_diagnostics(spark, d):
    gone = load(spark, d, "customer").where("c_nationkey = 3").selectExpr("'f' || cast(c_custkey as string) AS path")
    fresh = load(spark, d, "supplier").selectExpr("'f' || cast(s_suppkey as string) AS path", "'native' AS engine", "'h3' AS config_hash", "s_name AS blob")
    return stores.apply(_blobs(spark, d), fresh, gone, "path")


@query("WITH w AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents), c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, digest FROM w WHERE digest NOT IN (SELECT digest FROM c)")
def cache_misses(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return stores.missing(w, w.where("doc_id % 3 = 0"), "digest")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_custkey + 1 AS size, o_orderkey AS used FROM orders), t AS (SELECT sum(size) AS t FROM c), r AS (SELECT *, sum(size) OVER (ORDER BY used) AS s, row_number() OVER (ORDER BY used) AS k FROM c),
x AS (SELECT min(k) AS k FROM r, t WHERE s >= t - 0.9 * floor(t * 2 / 3))
SELECT r.id, size, used FROM r, x WHERE r.k > ceil(x.k / 100.0) * 100
""")
def evict_cache(spark, d):
    c = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1).alias("size"), F.col("o_orderkey").alias("used"))
    return stores.evict(c, "size", "used", c.agg(F.sum("size")).first()[0] * 2 // 3)


@query("SELECT p_partkey AS id, p_type AS version FROM part WHERE p_type = 'SMALL'")
def collect_versions(spark, d):
    return stores.current_versions(load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("version")), "SMALL")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unreviewed(spark, d):
    return stores.keep_marked(load(spark, d, "orders").select("o_orderkey"), load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", keep=False)


_BASE = "b AS (SELECT p_brand || '/' || p_type AS address, 'size' AS metric, CAST(avg(p_size) AS DOUBLE) AS value FROM part GROUP BY 1), m AS (SELECT p_brand || '/' || p_type AS address, 'size' AS metric, CAST(max(p_size) - min(p_size) AS DOUBLE) AS value FROM part GROUP BY 1 HAVING count(*) > 2)"


def _baseline(spark, d):
    p = load(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("address"), F.lit("size").alias("metric")).agg(F.avg("p_size").alias("value"), (F.max("p_size") - F.min("p_size")).cast("double").alias("now"), F.count("*").alias("n"))
    return p.select("address", "metric", "value"), p.where("n > 2").select("address", "metric", F.col("now").alias("value"))


@query(f"WITH {_BASE} SELECT address, metric, round(CASE WHEN m.value < b.value THEN m.value ELSE b.value END, 6) AS value FROM b LEFT JOIN m USING (address, metric)")
def baseline_update(spark, d):
    return stores.baseline_update(*_baseline(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {_BASE} SELECT address, metric, round(value, 6) AS value FROM b WHERE address <> 'Brand#1' AND address NOT LIKE 'Brand#1/%'")
def baseline_remove(spark, d):
    return _baseline(spark, d)[0].where(~gates.within(F.col("address"), "Brand#1")).withColumn("value", F.round("value", 6))


@query(f"WITH {_BASE} SELECT address, metric, round(value, 6) AS value FROM b WHERE address NOT IN (SELECT address FROM m) UNION ALL SELECT address, metric, round(value, 6) FROM m")
def baseline_add(spark, d):
    old, new = _baseline(spark, d)
    return stores.upsert(old, new, "address", "metric").withColumn("value", F.round("value", 6))


@query(f"WITH {_BASE} SELECT 'error' AS severity, 'ratchet' AS rule, address AS file, 0 AS line, 'regressed' AS message FROM b JOIN m USING (address, metric) WHERE m.value - b.value > 1e-10")
def ratchet_diagnostics(spark, d):
    old, new = _baseline(spark, d)
    checked = gates.ratchet(new, old, "address", "value", tolerance=1e-10)
    return stores.violations(checked, "ratchet", "address", F.col("status") == "regressed", F.col("status"))


_LINES = "l AS (SELECT 'd' || CAST(doc_id % 40 AS VARCHAR) AS file, doc_id % 2 AS v, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


def _lines(spark, d):
    t = load(spark, d, "documents").where("text is not null").select(F.concat(F.lit("d"), (F.col("doc_id") % 40).cast("string")).alias("file"), (F.col("doc_id") % 2).alias("v"), F.explode(F.split("text", "\n")).alias("text"))
    return t.where("v = 0").drop("v"), t.where("v = 1").drop("v")


def _line_diff(where: str) -> str:
    return f"""WITH {_LINES}, n AS (SELECT file, text, count(*) FILTER (WHERE v = 0) AS b, count(*) FILTER (WHERE v = 1) AS a FROM l WHERE {where} GROUP BY 1, 2)
SELECT file, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS added, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS removed FROM n GROUP BY 1 HAVING sum(abs(a - b)) > 0"""


@query(_line_diff("true"))
def budget_lines(spark, d):
    return stores.diff_lines(*_lines(spark, d))


@query(_line_diff("regexp_matches(text, '(?i)license|copyright')"))
def budget_marks(spark, d):
    return stores.diff_lines(*_lines(spark, d), F.col("text").rlike("(?i)license|copyright"))


@query("WITH x AS (SELECT DISTINCT p_brand AS file, p_name AS name, p_partkey % 2 AS v FROM part), n AS (SELECT file, name, bool_or(v = 0) AS b, bool_or(v = 1) AS a FROM x GROUP BY 1, 2) SELECT file, count(*) FILTER (WHERE a AND NOT b) AS added, count(*) FILTER (WHERE b AND NOT a) AS removed FROM n WHERE a <> b GROUP BY 1")
def budget_functions(spark, d):
    p = load(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), (F.col("p_partkey") % 2).alias("v"))
    return stores.diff_sets(p.where("v = 0"), p.where("v = 1"), "file", "name")


@query("WITH x AS (SELECT DISTINCT c_mktsegment AS file, c_nationkey AS name, c_custkey % 2 AS v FROM customer), n AS (SELECT file, name, bool_or(v = 0) AS b, bool_or(v = 1) AS a FROM x GROUP BY 1, 2) SELECT file, count(*) FILTER (WHERE a AND NOT b) AS added, count(*) FILTER (WHERE b AND NOT a) AS removed FROM n WHERE a <> b GROUP BY 1")
def budget_modules(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("name"), (F.col("c_custkey") % 2).alias("v"))
    return stores.diff_sets(c.where("v = 0"), c.where("v = 1"), "file", "name")


@query("WITH x AS (SELECT l_suppkey AS file, l_partkey % 50 AS name, l_orderkey % 2 AS v FROM lineitem), n AS (SELECT file, name, bool_or(v = 0) AS b, bool_or(v = 1) AS a FROM x GROUP BY 1, 2) SELECT file, count(*) FILTER (WHERE a AND NOT b) AS added, count(*) FILTER (WHERE b AND NOT a) AS removed FROM n WHERE a <> b GROUP BY 1")
def budget_dependencies(spark, d):
    x = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 50).alias("name"), (F.col("l_orderkey") % 2).alias("v"))
    return stores.diff_sets(x.where("v = 0"), x.where("v = 1"), "file", "name")


@query("WITH n AS (SELECT p_brand AS file, p_name AS name, coalesce(max(p_size) FILTER (WHERE p_partkey % 2 = 0), 0) AS b, coalesce(max(p_size) FILTER (WHERE p_partkey % 2 = 1), 0) AS a FROM part GROUP BY 1, 2) SELECT file, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS added, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS removed FROM n GROUP BY 1 HAVING sum(abs(a - b)) > 0")
def budget_complexity(spark, d):
    c = lambda v: load(spark, d, "part").where(F.col("p_partkey") % 2 == v).groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).agg(F.max("p_size").alias("cc"))
    return stores.diff_values(c(0), c(1), "file", "name", "cc")


@query(sql("symbols", "SELECT file AS address, 'complexity' AS metric, CAST(max(complexity) AS DOUBLE) AS value FROM symbols GROUP BY 1 UNION ALL SELECT file, 'functions', CAST(count(*) FILTER (WHERE kind <> 'class') AS DOUBLE) FROM symbols GROUP BY 1 UNION ALL SELECT file, 'classes', CAST(count(*) FILTER (WHERE kind = 'class') AS DOUBLE) FROM symbols GROUP BY 1 UNION ALL SELECT file, 'lines', CAST(sum(end_line - start_line) AS DOUBLE) FROM symbols GROUP BY 1"))
def ratchet_metrics(spark, d):
    return gates.file_metrics(table(spark, d, "symbols"))


@query(sql("symbols", ", p AS (SELECT CAST(complexity AS DOUBLE) AS v FROM symbols WHERE file = 'Brand#2' OR starts_with(file, 'Brand#2/')) SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median, max(v) AS max, min(v) AS min, round(sum(v), 4) AS sum, count(*) AS n FROM p"))
def measure_prefix(spark, d):
    p = table(spark, d, "symbols").select(F.col("file").alias("address"), F.col("complexity").cast("double").alias("value"))
    return gates.aggregates(p.where(gates.within(F.col("address"), "Brand#2")))


@query("""
WITH s AS (SELECT id, path, size, mtime FROM (SELECT p_partkey AS id, 'f' || CAST(p_partkey AS VARCHAR) AS path, p_size AS size, p_size % 5 AS mtime FROM part)), t AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS path, c_custkey % 50 + 1 AS size, c_custkey % 5 AS mtime FROM customer)
SELECT path, CASE WHEN s.size = t.size AND s.mtime = t.mtime THEN 'skip' ELSE 'copy' END AS action FROM s LEFT JOIN t USING (path)
""")
def copy_plan(spark, d):
    s = load(spark, d, "part").selectExpr("'f' || cast(p_partkey as string) AS path", "p_size AS size", "p_size % 5 AS mtime", "'' AS digest")
    t = load(spark, d, "customer").selectExpr("'f' || cast(c_custkey as string) AS path", "c_custkey % 50 + 1 AS size", "c_custkey % 5 AS mtime", "'' AS digest")
    return stores.copy_plan(s, t)


@query("WITH i AS (SELECT p_name AS name, max(p_size) AS version FROM part GROUP BY 1), a AS (SELECT p_name AS name, p_partkey % 60 AS below, p_type AS severity, p_partkey AS id FROM part) SELECT i.name, version, severity, id FROM i JOIN a ON i.name = a.name WHERE version < below")
def audit(spark, d):
    p = load(spark, d, "part")
    return stores.audit(p.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("version")), p.select(F.col("p_name").alias("name"), (F.col("p_partkey") % 60).alias("below"), F.col("p_type").alias("severity"), F.col("p_partkey").alias("id")))


@query("SELECT page_id AS id, upper(substr(url, 1, 20)) AS body FROM pages WHERE page_id % 4 > 0")
def transform_units(spark, d):
    u = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("body"))
    return stores.transform_units(u, F.when(F.col("id") % 4 > 0, F.upper(F.substring("body", 1, 20))))


_TURN_LINES = "l AS (SELECT session * 100 + turn AS k, CAST(i AS INT) AS line, x[i] AS text FROM (SELECT conv_id AS session, turn, string_split(text, chr(10)) AS x FROM conversations WHERE text IS NOT NULL), range(1, 400) r(i) WHERE i <= len(x))"


def _turn_lines(spark, d):
    t = load(spark, d, "conversations").where("text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return t.select("k", (F.col("p") + 1).alias("line"), "text")


@query(f"WITH {_TURN_LINES}, h AS (SELECT k, list_sort(list(line))[2] AS m FROM l WHERE regexp_matches(text, 'en') GROUP BY 1) SELECT l.k, line, text FROM l JOIN h ON l.k = h.k AND abs(line - m) <= 1")
def context_view(spark, d):
    return stores.around(_turn_lines(spark, d), "k", "en", 1, 2)


@query(f"WITH {_TURN_LINES} SELECT k, line, text, (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM l y WHERE y.k = l.k) AS chunks FROM l WHERE line BETWEEN 4 AND 6")
def chunk_view(spark, d):
    return stores.chunks(_turn_lines(spark, d), "k", 3, 2)


@query(f"WITH {_TURN_LINES} SELECT k, line, text FROM l WHERE line BETWEEN 2 AND 3")
def line_range(spark, d):
    return _turn_lines(spark, d).where(F.col("line").between(2, 3))


@query(f"WITH {_TURN_LINES}, m AS (SELECT k, line, text, regexp_extract(text, '(?i)the?n?') AS f FROM l WHERE regexp_matches(text, '(?i)the?n?')) SELECT k, line, CAST(strpos(text, f) - 1 AS INT) AS start, CAST(strpos(text, f) - 1 + length(f) AS INT) AS \"end\", trim(text) AS content FROM m ORDER BY k, line LIMIT 80")
def grep_offsets(spark, d):
    return stores.grep(_turn_lines(spark, d), "k", "the?n?", ignore_case=True, limit=80)


@query(sql("cfg_effects", "SELECT file, func, kind, count(*) AS n, count(DISTINCT block) AS blocks, min(line) AS first_line FROM cfg_effects GROUP BY 1, 2, 3"))
def effects_report(spark, d):
    return table(spark, d, "cfg_effects").groupBy("file", "func", "kind").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.min("line").alias("first_line"))


@query(sql("cfg_edges", "SELECT file, func, exception_type, count(*) AS thrown, count(*) FILTER (WHERE to_block <> 7) AS caught, count(*) FILTER (WHERE to_block = 7) AS unhandled FROM cfg_edges WHERE kind = 'exception' GROUP BY 1, 2, 3"))
def exceptions_report(spark, d):
    e = table(spark, d, "cfg_edges").where("kind = 'exception'")
    n = lambda c: F.sum(c.cast("long"))
    return e.groupBy("file", "func", "exception_type").agg(F.count("*").alias("thrown"), n(F.col("to_block") != 7).alias("caught"), n(F.col("to_block") == 7).alias("unhandled"))


@query(sql("cfg_edges", "SELECT file, func, 'graph TD' || chr(10) || string_agg(t, chr(10) ORDER BY t) AS mermaid FROM (SELECT DISTINCT file, func, '  b' || from_block || ' -->' || CASE WHEN kind = 'exception' THEN '|' || exception_type || '|' ELSE '' END || ' b' || to_block AS t FROM cfg_edges) GROUP BY 1, 2"))
def mermaid(spark, d):
    e = table(spark, d, "cfg_edges")
    label = F.when(F.col("kind") == "exception", F.concat(F.lit("|"), "exception_type", F.lit("|"))).otherwise("")
    line = F.concat(F.lit("  b"), F.col("from_block").cast("string"), F.lit(" -->"), label, F.lit(" b"), F.col("to_block").cast("string"))
    return e.groupBy("file", "func").agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("mermaid"))


@query(sql("commit_files", ", t AS (SELECT path, max(id) AS no FROM commit_files GROUP BY 1) SELECT path, round(least(1.0, ((SELECT max(id) FROM commit_files) - no) / 50), 9) AS staleness FROM t"))
def staleness(spark, d):
    t = table(spark, d, "commit_files").select("path", F.col("id").alias("no"))
    return vectors.file_staleness(t, t)


@query("SELECT vec_id, CAST(len(embedding) * 4 AS INT) AS bytes, true AS same FROM embeddings")
def vector_packing(spark, d):
    e = load(spark, d, "embeddings").withColumn("b", vectors.pack(F.col("embedding")))
    return e.select("vec_id", F.octet_length("b").alias("bytes"), (vectors.unpack(F.col("b")) == F.col("embedding")).alias("same"))


@query("SELECT e.vec_id, e.label, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def vector_metadata(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label").join(load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_counts(spark, d):
    return load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query()
def knn_ann(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vectors.search(e, q, "vec_id", "embedding", Scratch(spark, "ann"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY 1 LIMIT 500")
def to_embed(spark, d):
    return vectors.to_embed(load(spark, d, "documents").select("doc_id"), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", most=500)


@query(sql("symbols calls attributes", """, dc AS (SELECT file, name, min(substr(attribute, 5)) AS doc FROM attributes WHERE attribute LIKE 'doc:%' GROUP BY 1, 2), cr AS (SELECT callee_name AS name, array_to_string(list_sort(list(DISTINCT caller_symbol))[1:5], ', ') AS v FROM calls GROUP BY 1),
ce AS (SELECT caller_symbol AS name, array_to_string(list_sort(list(DISTINCT callee_name))[1:5], ', ') AS v FROM calls GROUP BY 1)
SELECT DISTINCT s.file, s.name, concat_ws(chr(10), s.kind || ' ' || s.name, s.file, doc, 'callers: ' || cr.v, 'callees: ' || ce.v) AS text FROM symbols s LEFT JOIN dc ON dc.file = s.file AND dc.name = s.name LEFT JOIN cr ON cr.name = s.name LEFT JOIN ce ON ce.name = s.name"""))
def symbol_chunks(spark, d):
    docs = table(spark, d, "attributes").where("attribute like 'doc:%'").select("file", "name", F.substring("attribute", 5, 1000).alias("doc"))
    c = table(spark, d, "calls")
    return vectors.symbol_chunks(table(spark, d, "symbols"), docs, c.select(F.col("callee_name").alias("name"), F.col("caller_symbol").alias("caller")), c.select(F.col("caller_symbol").alias("name"), F.col("callee_name").alias("callee")))


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem), s AS (SELECT b FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM t x JOIN t y ON x.b = y.b AND x.i <> y.i WHERE x.b IN (SELECT b FROM s) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p) SELECT a AS path, array_to_string(list(b ORDER BY k), ',') AS neighbours FROM r WHERE k <= 5 GROUP BY 1
""")
def cochange_neighbours(spark, d):
    from sparkloom.plans.registry import touches

    return history.neighbours(history.cochange_pairs(touches(spark, d), min_count=1), 5)


@query("WITH s AS (SELECT p_partkey AS id, p_size AS score, p_brand AS file, p_partkey % 90 AS line FROM part) SELECT id, score, file, line FROM s ORDER BY file, line, id LIMIT 60")
def diagnostics_sort(spark, d):
    s = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score"), F.col("p_brand").alias("file"), (F.col("p_partkey") % 90).alias("line"))
    return rank.ranked(s, "file,line,id", 60)


@query(sql("files", "SELECT path, 'file' AS what FROM files WHERE path = 'Brand#3/small.py'"))
def resolve_unified(spark, d):
    return index.resolve_target(table(spark, d, "files"), table(spark, d, "symbols"), "Brand#3/small.py")


@query(sql("symbols", "SELECT DISTINCT file AS path, name AS what FROM symbols WHERE file = 'Brand#3/small.py' AND name = 'red_widget' OR file LIKE '%/small.py' AND name = 'red_widget'"))
def resolve_symbol_path(spark, d):
    return index.resolve_target(table(spark, d, "files"), table(spark, d, "symbols"), "small.py::red_widget")


@query("SELECT page_id, regexp_matches(url, '^(?:.*/)?[^/]*\\.example\\.com/.*$') AS matched FROM pages")
def glob_urls(spark, d):
    return load(spark, d, "pages").select("page_id", globs.matches(F.col("url"), "**/*.example.com/**").alias("matched"))


@query("SELECT doc_id, CASE WHEN starts_with(text, '---') THEN NULL ELSE length(text) END AS body_chars FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '---')")
def front_matter(spark, d):
    f = readers.front_matter(load(spark, d, "documents").where("text is not null and not startswith(text, '---')"), "text")
    return f.select("doc_id", F.length("body").alias("body_chars"))


@query(sql("turns", "SELECT session, turn, regexp_replace(lower(text), '\\s+', ' ', 'g') = lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS tidy FROM turns"))
def tidy_turns(spark, d):
    t = F.col("text")
    return table(spark, d, "turns").select("session", "turn", (F.regexp_replace(F.lower(t), r"\s+", " ") == F.lower(texts.squeeze(t))).alias("tidy"))
