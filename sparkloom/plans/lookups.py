"""Fact lookup, resolution, roll-up and diff queries. Parts stand for symbols and files, orders for calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import facts
from sparkloom.plans.registry import query
from sparkloom.runtime import Scratch, load


def _symbols(spark, d):
    p = load(spark, d, "part")
    return p.select(
        F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), (F.col("p_partkey") % 400).alias("start"),
        (F.col("p_partkey") % 400 + F.col("p_size")).alias("end"), F.when(F.col("p_size") % 3 == 0, "private").otherwise("public").alias("visibility"),
    )


_SYMBOLS = "sy AS (SELECT p_brand || '/' || p_type AS file, p_name AS name, lower(p_type) AS kind, p_partkey % 400 AS st, p_partkey % 400 + p_size AS en, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM part)"


def _imports(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = F.col("s_suppkey")
    types = F.array(*map(F.lit, ("ECONOMY", "SMALL", "LARGE", "STANDARD", "PROMO", "MEDIUM")))
    names = F.array(*map(F.lit, ("small ring", "red widget", "blue bolt", "hot gear", "*")))
    file = lambda k: F.concat(F.lit("Brand#"), (k % 25).cast("string"), F.lit("/"), types[(k % 6).cast("int")])
    return s.select(
        file(n).alias("file"), F.concat(F.lit("mod"), (F.col("s_nationkey") % 7).cast("string")).alias("module"), names[(n % 5).cast("int")].alias("name"),
        F.when(n % 4 == 0, F.concat(F.lit("as"), (n % 3).cast("string"))).alias("alias"), F.when(n % 5 != 0, file(n * 7 + 3)).alias("resolved_file"),
    )


_FILE = "'Brand#' || CAST(({0}) % 25 AS VARCHAR) || '/' || ['ECONOMY', 'SMALL', 'LARGE', 'STANDARD', 'PROMO', 'MEDIUM'][({0}) % 6 + 1]"
_IMPORTS = (
    f"im AS (SELECT {_FILE.format('s_suppkey')} AS file, 'mod' || CAST(s_nationkey % 7 AS VARCHAR) AS module, ['small ring', 'red widget', 'blue bolt', 'hot gear', '*'][s_suppkey % 5 + 1] AS name, "
    f"CASE WHEN s_suppkey % 4 = 0 THEN 'as' || CAST(s_suppkey % 3 AS VARCHAR) END AS alias, CASE WHEN s_suppkey % 5 <> 0 THEN {_FILE.format('s_suppkey * 7 + 3')} END AS resolved_file FROM supplier)"
)


def _calls(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_custkey")
    types = F.array(*map(F.lit, ("ECONOMY", "SMALL", "LARGE", "STANDARD", "PROMO", "MEDIUM")))
    names = F.array(*map(F.lit, ("small ring", "red widget", "blue bolt", "hot gear", "as1", "as2", "as0")))
    file = lambda x: F.concat(F.lit("Brand#"), (x % 25).cast("string"), F.lit("/"), types[(x % 6).cast("int")])
    q = F.when(k % 3 == 0, F.concat(F.lit("mod"), (k % 7).cast("string"))).when(k % 11 == 0, F.lit("self"))
    return o.select(file(k).alias("caller_file"), F.col("o_orderpriority").alias("caller_symbol"), names[(F.col("o_orderkey") % 7).cast("int")].alias("callee_name"), q.alias("callee_qualifier"), F.when(k % 13 == 0, file(k + 1)).alias("callee_resolved_file"), F.col("o_orderkey").alias("line"))


_CALLS = (
    f"ca AS (SELECT {_FILE.format('o_custkey')} AS caller_file, o_orderpriority AS caller_symbol, ['small ring', 'red widget', 'blue bolt', 'hot gear', 'as1', 'as2', 'as0'][o_orderkey % 7 + 1] AS callee_name, "
    f"CASE WHEN o_custkey % 3 = 0 THEN 'mod' || CAST(o_custkey % 7 AS VARCHAR) WHEN o_custkey % 11 = 0 THEN 'self' END AS q, CASE WHEN o_custkey % 13 = 0 THEN {_FILE.format('o_custkey + 1')} END AS rf, o_orderkey AS line FROM orders)"
)


@query(f"WITH {_SYMBOLS} SELECT file, name, kind, st AS start, en AS \"end\", visibility, 0 AS tier FROM sy WHERE lower(name) = 'red widget' ORDER BY length(name), name, file, kind, st, en LIMIT 50")
def find_symbols_exact(spark, d):
    return facts.search(_symbols(spark, d), "Red Widget", fuzzy=False)


@query(f"WITH {_SYMBOLS} SELECT file, name, kind, st AS start, en AS \"end\", visibility, CASE WHEN starts_with(lower(name), 'red') THEN 1 ELSE 2 END AS tier FROM sy WHERE contains(lower(name), 'red') AND kind = 'small' ORDER BY tier, length(name), name, file, kind, st, en LIMIT 50")
def find_symbols_fuzzy(spark, d):
    return facts.search(_symbols(spark, d), "red", kind="small")


@query("WITH p AS (SELECT DISTINCT p_brand || '/' || p_type AS path FROM part) SELECT path FROM p WHERE contains(lower(path), 'brand') AND contains(lower(path), 'small') ORDER BY path LIMIT 50")
def find_like(spark, d):
    return facts.find_paths(_symbols(spark, d).select(F.col("file").alias("path")).distinct(), "brand small")


@query("WITH p AS (SELECT DISTINCT p_brand || '/' || p_type AS path FROM part) SELECT path, 1 AS tier FROM p WHERE split_part(path, '/', 2) = 'SMALL'")
def path_tiers(spark, d):
    return facts.best_tier(_symbols(spark, d).select(F.col("file").alias("path")).distinct(), "SMALL")


@query("SELECT DISTINCT p_brand || '/' || p_type AS path FROM part WHERE p_brand = 'Brand#1'")
def prefix_filter(spark, d):
    from sparkloom.operators.gates import within

    return _symbols(spark, d).select(F.col("file").alias("path")).distinct().where(within(F.col("path"), "Brand#1"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT unnest(['red', 'ed ', 'd w', ' wi', 'wid', 'idg']) AS t),
g AS (SELECT DISTINCT name, substr(lower(name), i, 3) AS t FROM n, range(1, 60) r(i) WHERE i <= length(name) - 2)
SELECT name, round(count(*) / 6, 9) AS score FROM g JOIN q USING (t) GROUP BY name HAVING count(*) / 6 >= 0.3 ORDER BY score DESC, name LIMIT 20
""")
def trigram_suggest(spark, d):
    return facts.suggest(_symbols(spark, d), "red widg")


@query("WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(*) AS n FROM w GROUP BY word")
def vocabulary(spark, d):
    return load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_CORE = "c AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1), i AS (SELECT l_partkey AS file, count(DISTINCT l_suppkey) AS fan_in FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 5)"


def _core(spark, d):
    li = load(spark, d, "lineitem").withColumnRenamed("l_partkey", "file")
    c = li.groupBy("file").agg(F.countDistinct("l_orderkey").alias("commits"))
    return c.join(li.where("l_returnflag = 'R'").groupBy("file").agg(F.countDistinct("l_suppkey").alias("fan_in")).where("fan_in > 5"), "file")


@query(f"WITH {_CORE} SELECT file, commits, fan_in FROM c JOIN i USING (file) ORDER BY commits, fan_in DESC, file LIMIT 100")
def stable_core(spark, d):
    return _core(spark, d).orderBy("commits", F.desc("fan_in"), "file").limit(100)


@query(f"WITH {_CORE} SELECT file, commits, fan_in FROM c JOIN i USING (file) ORDER BY commits DESC, fan_in DESC, file LIMIT 100")
def unstable_core(spark, d):
    return _core(spark, d).orderBy(F.desc("commits"), F.desc("fan_in"), "file").limit(100)


@query("""
WITH p AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, p_brand, p_type FROM part)
SELECT path, CASE WHEN p_type = 'SMALL' THEN p_brand || '/SMALL' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand END AS module FROM p
""")
def longest_prefix_module(spark, d):
    p = load(spark, d, "part")
    paths = p.select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    modules = p.where("p_type = 'SMALL'").select(F.concat(F.col("p_brand"), F.lit("/SMALL")).alias("module")).union(p.where("p_brand in ('Brand#1', 'Brand#2')").select("p_brand")).distinct()
    return facts.longest_prefix(paths, modules)


@query(f"WITH {_SYMBOLS}, {_CALLS} SELECT file, name, kind FROM sy WHERE visibility = 'public' AND name NOT IN (SELECT callee_name FROM ca)")
def entry_points(spark, d):
    return facts.entry_points(_symbols(spark, d), _calls(spark, d)).select("file", "name", "kind")


@query(f"WITH {_IMPORTS} SELECT file, module, name FROM im WHERE resolved_file IS NULL")
def external_deps(spark, d):
    return _imports(spark, d).where("resolved_file is null").select("file", "module", "name")


@query(f"WITH {_SYMBOLS}, {_CALLS}, {_IMPORTS} SELECT DISTINCT file, name FROM sy WHERE visibility = 'public' AND name IN (SELECT callee_name FROM ca WHERE caller_file IN (SELECT file FROM im WHERE resolved_file IS NULL))")
def external_surface(spark, d):
    return facts.external_surface(_symbols(spark, d), _calls(spark, d), _imports(spark, d))


@query(f"""
WITH {_SYMBOLS}, {_CALLS}, {_IMPORTS}, b AS (SELECT file AS f, resolved_file, name AS original, coalesce(alias, name) AS loc, module FROM im)
SELECT file, name, caller_file, caller_symbol, line FROM ca JOIN sy ON rf = file AND callee_name = name
UNION SELECT file, name, caller_file, caller_symbol, line FROM ca JOIN sy ON q IS NULL AND caller_file = file AND callee_name = name
UNION SELECT file, sy.name, caller_file, caller_symbol, line FROM ca JOIN b ON caller_file = f AND callee_name = loc JOIN sy ON resolved_file = file AND original = sy.name
UNION SELECT file, sy.name, caller_file, caller_symbol, line FROM ca JOIN b ON caller_file = f AND q = module JOIN sy ON resolved_file = file AND callee_name = sy.name
UNION SELECT file, name, caller_file, caller_symbol, line FROM ca JOIN sy ON q = 'self' AND caller_file = file AND callee_name = name
""")
def callers_union5(spark, d):
    return facts.callers(_symbols(spark, d), _imports(spark, d), _calls(spark, d))


@query(f"""
WITH {_SYMBOLS}, {_CALLS}, {_IMPORTS}, n AS (SELECT file, coalesce(alias, name) AS k, min(resolved_file) AS r FROM im WHERE resolved_file IS NOT NULL GROUP BY 1, 2),
m AS (SELECT file, coalesce(alias, module) AS k, min(resolved_file) AS r FROM im WHERE resolved_file IS NOT NULL GROUP BY 1, 2), o AS (SELECT DISTINCT file, name FROM sy)
SELECT caller_file, callee_name, q AS callee_qualifier, line, coalesce(o.file, n.r, CASE WHEN q <> 'self' THEN m.r END, CASE WHEN q = 'self' THEN caller_file END) AS resolved
FROM ca LEFT JOIN o ON o.file = caller_file AND o.name = callee_name LEFT JOIN n ON n.file = caller_file AND n.k = callee_name LEFT JOIN m ON m.file = caller_file AND m.k = q
""")
def resolve_calls(spark, d):
    return facts.resolve_calls(_symbols(spark, d), _imports(spark, d), _calls(spark, d)).select("caller_file", "callee_name", "callee_qualifier", "line", "resolved")


@query(f"""
WITH RECURSIVE {_IMPORTS}, h AS (SELECT n_nationkey AS k, n_name AS file, n_regionkey FROM nation),
x AS (SELECT a.file, 'n' || CAST(a.k % 3 AS VARCHAR) AS name, b.file AS target FROM h a JOIN h b ON b.k = a.k + 5 UNION ALL SELECT a.file, '*', b.file FROM h a JOIN h b ON b.k = a.k + 1 WHERE a.k % 4 = 0),
w AS (SELECT file, name, min(target) AS target FROM x WHERE file <> target GROUP BY 1, 2),
i AS (SELECT s_name AS file, 'n' || CAST(s_suppkey % 3 AS VARCHAR) AS name, n_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s(file, name, r, hop) AS (SELECT file, name, r, 0 FROM i UNION ALL SELECT s.file, s.name, coalesce(p.target, q.target), hop + 1 FROM s LEFT JOIN w p ON p.file = s.r AND p.name = s.name LEFT JOIN w q ON q.file = s.r AND q.name = '*'
  WHERE coalesce(p.target, q.target) IS NOT NULL AND hop < 10)
SELECT file, name, arg_max(r, hop) AS resolved_file FROM s GROUP BY file, name
""")
def reexport_chase(spark, d):
    n = load(spark, d, "nation")
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 3).cast("string"))
    b = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))
    named = n.join(b, F.col("k") == F.col("n_nationkey") + 5).select(F.col("n_name").alias("file"), name("n_nationkey").alias("name"), "target")
    star = n.where("n_nationkey % 4 = 0").join(b, F.col("k") == F.col("n_nationkey") + 1).select(F.col("n_name").alias("file"), F.lit("*").alias("name"), "target")
    imports = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("file"), name("s_suppkey").alias("name"), F.col("n_name").alias("resolved_file"))
    return facts.chase_reexports(imports, named.union(star), Scratch(spark, "reexports"))


@query(f"""
WITH {_SYMBOLS}, p AS (SELECT DISTINCT p_brand || '/' || p_type AS file, (p_partkey * 3) % 450 AS line FROM part),
i AS (SELECT p.file, line, name, row_number() OVER (PARTITION BY p.file, line ORDER BY en - st, name) AS k FROM p JOIN sy ON p.file = sy.file AND line BETWEEN st AND en)
SELECT p.file, p.line, i.name FROM p LEFT JOIN i ON p.file = i.file AND p.line = i.line AND k = 1
""")
def range_join_enclosing(spark, d):
    points = load(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("file"), (F.col("p_partkey") * 3 % 450).alias("line")).distinct()
    return facts.enclosing(points, _symbols(spark, d).select("file", "name", "start", "end"))


@query("""
WITH o AS (SELECT o_custkey % 50 AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders), s AS (SELECT DISTINCT k, CAST(727000000 + i * 20000000 AS BIGINT) AS at FROM o, range(0, 10) r(i)),
x AS (SELECT s.k, s.at AS a, t, row_number() OVER (PARTITION BY s.k, s.at ORDER BY abs(t - s.at), t) AS r FROM s JOIN o ON s.k = o.k)
SELECT k, a AS "at", t FROM x WHERE r = 1
""".replace("AS at FROM", "AS \"at\" FROM").replace("s.at", "s.\"at\""))
def as_of_nearest_snapshot(spark, d):
    o = load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.unix_timestamp("o_orderdate").alias("t"))
    spine = o.select("k").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("k", (F.lit(727000000) + F.col("i").cast("long") * 20000000).alias("at"))
    return facts.nearest(spine, o, "k", "at", "t")


@query("""
WITH f AS (SELECT p_brand || '/' || p_type AS path, p_size AS size FROM part)
SELECT prefix, CAST(sum(size) AS BIGINT) AS size, round(100 * sum(size) / (SELECT sum(size) FROM f), 6) AS pct
FROM (SELECT split_part(path, '/', 1) AS prefix, size FROM f UNION ALL SELECT path, size FROM f) GROUP BY prefix
""")
def size_rollup(spark, d):
    return facts.size_rollup(load(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_size").alias("size")))


@query("""
WITH y AS (SELECT l_partkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, n FROM y WHERE y = 1995), a AS (SELECT l_partkey, n FROM y WHERE y = 1996)
SELECT l_partkey, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN abs(a.n - b.n) > b.n * 0.2 AND abs(a.n - b.n) > 2 THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a USING (l_partkey)
""")
def skeleton_diff(spark, d):
    y = load(spark, d, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    return facts.changes(y.where("y = 1995"), y.where("y = 1996"), "l_partkey", "n")
