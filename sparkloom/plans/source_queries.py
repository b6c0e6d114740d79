"""Queries over source texts, manifests, logs, units and JSON that parts, orders and events are printed as."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import jq
from sparkloom.plans.registry import query
from sparkloom.runtime import load
from sparkloom.sources import exports, manifests, python_source

_CODE = """import os
from mod{s} import alpha as beta

class Shape{k}(Base):
    def area(self, width: int, spare):
        if width and self:
            return scale{s}(width)
        return beta.zoom(width)
"""


def _code(spark, d):
    """A small module for each part."""
    text = F.replace(F.replace(F.lit(_CODE), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    return load(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


_F = "'f' || p_partkey || '.py' AS file"


@query(f"SELECT {_F}, 'Shape' || p_partkey AS name, 'class' AS kind, NULL AS parent, 4 AS start_line, 8 AS end_line, 'public' AS visibility, 0 AS complexity FROM part UNION ALL SELECT {_F}, 'area', 'method', 'Shape' || p_partkey, 5, 8, 'public', 3 FROM part")
def parse_symbols(spark, d):
    return python_source.symbols(_code(spark, d)).drop("doc", "hash", "tokens")


@query(f"SELECT {_F}, 'os' AS module, 'os' AS name, NULL AS alias, 1 AS line FROM part UNION ALL SELECT {_F}, 'mod' || p_size, 'alpha', 'beta', 2 FROM part")
def parse_imports(spark, d):
    return python_source.imports(_code(spark, d))


@query(f"SELECT 'f' || p_partkey || '.py' AS caller_file, 'area' AS caller_symbol, 'scale' || p_size AS callee_name, NULL AS callee_qualifier, 7 AS line FROM part UNION ALL SELECT 'f' || p_partkey || '.py', 'area', 'zoom', 'beta', 8 FROM part")
def parse_calls(spark, d):
    return python_source.calls(_code(spark, d))


@query(f"SELECT {_F}, 'Shape' || p_partkey AS symbol, 'Base' AS type, 4 AS line FROM part UNION ALL SELECT {_F}, 'Shape' || p_partkey || '.area', 'int', 5 FROM part")
def parse_types(spark, d):
    return python_source.type_references(_code(spark, d))


@query(f"SELECT {_F}, 'area' AS function, 'spare' AS parameter, 5 AS line FROM part")
def dead_parameters(spark, d):
    return python_source.unused_parameters(_code(spark, d))


@query(f"SELECT {_F}, kind, n FROM part, (VALUES ('true', 1), ('false', 1), ('next', 1), ('return', 2)) v(kind, n)")
def parse_flow(spark, d):
    e = python_source.cfg_edges(_code(spark, d)).groupBy("file", "kind").agg(F.count("*").cast("int").alias("n"))
    return e


@query(f"SELECT {_F}, name, scope FROM part, (VALUES ('Base', NULL), ('int', NULL), ('width', 'area'), ('self', 'area'), ('beta', '<module>'), ('scale', NULL)) v(name, scope)")
def parse_scopes(spark, d):
    s = python_source.scopes(_code(spark, d))
    return s.select("file", F.regexp_replace("name", "[0-9]+$", "").alias("name"), "scope").distinct()


@query("SELECT 'class' AS kind, count(*) AS members FROM part UNION ALL SELECT 'method', count(*) FROM part")
def duplicate_shapes(spark, d):
    s = python_source.symbols(_code(spark, d))
    groups = s.groupBy("hash", "kind").agg(F.count("*").alias("members")).where("members > 1")
    return groups.select("kind", "members")


@query(f"SELECT {_F}, 8 AS lines, 0 AS comments FROM part")
def count_lines(spark, d):
    return python_source.line_counts(_code(spark, d))


def _manifests(spark, d):
    k = F.col("p_partkey").cast("string")
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"))
    shown = {
        0: ("package.json", F.concat(F.lit('{"name":"n'), k, F.lit('","version":"2.0","dependencies":{"left":"^'), v, F.lit('"},"devDependencies":{"right":"*"}}'))),
        1: ("Cargo.toml", F.concat(F.lit('[package]\nname = "n'), k, F.lit('"\nversion = "2.0"\n[dependencies]\nleft = "'), v, F.lit('"\nright = { version = "*", features = ["x"] }\n'))),
        2: ("requirements.txt", F.concat(F.lit("# pinned\nleft=="), v, F.lit("\nright[x] >=2 ; python_version > '3'\n-r other.txt\n"))),
        3: ("go.mod", F.concat(F.lit("module n"), k, F.lit("\n\nrequire (\n\tleft v"), v, F.lit("\n\tright v2.0.0 // indirect\n)\n"))),
        4: ("pom.xml", F.concat(F.lit('<project xmlns="http://m"><artifactId>n'), k, F.lit("</artifactId><version>2.0</version><dependencies><dependency><groupId>g</groupId><artifactId>left</artifactId><version>"), v, F.lit("</version></dependency></dependencies></project>"))),
    }
    case = lambda i: F.coalesce(*[F.when(F.col("p_partkey") % 5 == n, shown[n][i] if i else F.lit(shown[n][0])) for n in shown])
    return load(spark, d, "part").select(F.concat(F.lit("d"), k, F.lit("/"), case(0)).alias("path"), case(1).alias("text"))


@query("""
WITH p AS (SELECT p_partkey % 5 AS m, 'n' || p_partkey AS n, '1.' || p_size AS v, 'd' || p_partkey || '/' || CASE p_partkey % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'go.mod' ELSE 'pom.xml' END AS path FROM part)
SELECT path, ['npm', 'cargo', 'pip', 'go', 'maven'][m + 1] AS ecosystem, CASE WHEN m <> 2 THEN n END AS name, CASE WHEN m NOT IN (2, 3) THEN '2.0' END AS version, CASE WHEN m = 4 THEN 'g:left' ELSE 'left' END AS dependency, ['^', '', '==', 'v', ''][m + 1] || v AS requirement, 'normal' AS kind FROM p
UNION ALL SELECT path, ['npm', 'cargo', 'pip', 'go'][m + 1], CASE WHEN m <> 2 THEN n END, CASE WHEN m NOT IN (2, 3) THEN '2.0' END, 'right', ['*', '*', '>=2', 'v2.0.0'][m + 1], ['dev', 'normal', 'normal', 'indirect'][m + 1] FROM p WHERE m < 4
""")
def manifest_dependencies(spark, d):
    return manifests.manifests(_manifests(spark, d))


def _log(spark, d):
    """Orders as commits and their lines as files, printed by order."""
    o = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("\x01"), F.lpad(F.hex("o_orderkey"), 40, "0"), F.lit("\x02"), F.unix_timestamp("o_orderdate").cast("string"), F.lit("\x02C"), (F.col("o_custkey") % 40).cast("string"), F.lit("@X\x02"), "o_orderpriority", F.lit("\n\n")).alias("head"))
    line = F.concat_ws("\t", F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") == 3, "-").otherwise("1"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return o.join(li, "o_orderkey", "left").select(F.concat("head", F.coalesce("body", F.lit(""))).alias("value"))


@query("SELECT 'c' || o_custkey % 40 || '@x' AS author, o_orderpriority AS subject, epoch(o_orderdate)::BIGINT AS ts, 'f' || l_partkey AS path, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS added, CASE WHEN l_linenumber <> 3 THEN '1' END AS removed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def git_log_rows(spark, d):
    return exports.git_log(_log(spark, d)).select("author", "subject", "ts", "path", F.col("added").cast("string").alias("added"), F.col("removed").cast("string").alias("removed"))


@query("SELECT 'f' || l_partkey AS path, count(DISTINCT l_orderkey) AS commits, CAST(sum(l_quantity + CASE WHEN l_linenumber <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS churn FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def git_churn(spark, d):
    return exports.churn(exports.git_log(_log(spark, d)))


@query("SELECT 'c' || o_custkey % 40 || '@x' AS author, count(*) AS commits FROM orders GROUP BY 1")
def git_shortlog(spark, d):
    return exports.shortlog(exports.git_log(_log(spark, d)))


@query("SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line, md5(p_name) || substr(md5(p_name), 1, 8) AS commit, p_type || '@x' AS author FROM part")
def git_blame_lines(spark, d):
    digest = F.concat(F.md5("p_name"), F.substring(F.md5("p_name"), 1, 8))
    p = load(spark, d, "part")
    ranked = p.groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", digest.alias("h"), "p_type"))).alias("x"))
    entry = F.transform("x", lambda e, i: F.concat(e["h"], F.lit(" 1 "), (i + 1).cast("string"), F.lit(" 1\nauthor A\nauthor-mail <"), e["p_type"], F.lit("@x>\nfilename f\n\tcode\n")))
    return exports.git_blame(ranked.select("path", F.array_join(entry, "").alias("value")))


def _logs(spark, d):
    """Conversations printed in four formats by their number."""
    c = load(spark, d, "conversations").where("text is not null and role is not null")
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    message = F.struct(F.col("role"), F.array(text).alias("content"))
    shown = F.when(F.col("conv_id") % 4 == 0, F.to_json(F.struct(F.lit("2024").alias("timestamp"), F.lit("item").alias("type"), message.alias("payload")))).when(F.col("conv_id") % 4 == 1, F.to_json(F.struct(F.lit("u").alias("type"), message.alias("message"))))
    shown = shown.when(F.col("conv_id") % 4 == 2, F.to_json(F.struct(F.col("role"), F.col("text").alias("content")))).otherwise(F.to_json(F.struct(F.lit("1").alias("id"), F.array(F.struct("text")).alias("content"), F.col("role").alias("type"))))
    lines = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", shown.alias("j")))), lambda x: x["j"]).alias("l"))
    whole = F.when(F.col("conv_id") % 4 == 2, F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))).otherwise(F.array_join("l", "\n"))
    return lines.select(F.col("conv_id").alias("path"), whole.alias("value"))


@query("SELECT conv_id AS session, role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def chat_log_blocks(spark, d):
    return exports.chat_blocks(_logs(spark, d)).select("session", "role", "text")


@query("SELECT conv_id AS session, ['rollout', 'message_lines', 'message_array', 'chat_lines'][conv_id % 4 + 1] AS format FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id")
def chat_log_formats(spark, d):
    return _logs(spark, d).select(F.col("path").alias("session"), exports.detect_format(F.col("value")).alias("format"))


_UNITS = """SELECT 'u' || p_partkey AS id, p_size > 10 AS has_front, 'cites:u' || (p_partkey + 1) || ',link:u' || p_size AS links, 'See [[cites:u' || (p_partkey + 1) || ']] and [[u' || p_size || ']].' AS body FROM part"""


@query(_UNITS)
def knowledge_units(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    body = F.concat(F.lit("See [[cites:u"), (k + 1).cast("string"), F.lit("]] and [[u"), s, F.lit("]]."))
    files = load(spark, d, "part").select(F.concat(F.lit("kg/u"), k.cast("string"), F.lit(".md")).alias("path"), F.when(F.col("p_size") > 10, F.concat(F.lit("---\ntitle: x\n---\n"), body)).otherwise(body).alias("value"))
    u = exports.units(files)
    return u.select("id", F.col("front").isNotNull().alias("has_front"), F.array_join(F.transform("links", lambda x: F.concat(x["kind"], F.lit(":"), x["to"])), ",").alias("links"), "body")


@query("SELECT 'a/b/f' || p_partkey AS path, CAST(n AS INT) AS no, 'body ' || n AS body FROM part, (VALUES (0), (1)) v(n) WHERE CASE n WHEN 0 THEN p_brand ELSE p_type END IN ('Brand#3', 'SMALL')")
def context_selection(spark, d):
    value = F.concat(F.lit("---\nscope: x\nkind: "), "p_brand", F.lit("\n---\nbody 0\n---\nkind: "), "p_type", F.lit("\n---\nbody 1\n"))
    blocks = exports.context_blocks(load(spark, d, "part").select(F.concat(F.lit("a/b/f"), F.col("p_partkey").cast("string")).alias("path"), value.alias("value")))
    either = exports.context_for(blocks, "a/b/c", {"kind": "Brand#3", "other": "y"}).unionByName(exports.context_for(blocks, "a/b/c/d", {"kind": "SMALL"}))
    return either.select("path", "no", "body")


_JSON = "p_partkey AS id, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || ',\"tags\":[\"' || p_type || '\",\"' || p_brand || '\"],\"at\":{\"brand\":\"' || p_brand || '\"}}' AS j"


def _json(spark, d):
    return load(spark, d, "part").selectExpr(*[x.strip() for x in ("p_partkey AS id", _JSON.split(", ", 1)[1])])


@query("SELECT p_partkey AS id FROM part WHERE p_size > 20 AND p_type = 'SMALL'")
def jq_predicate(spark, d):
    return _json(spark, d).where(jq.holds(F.col("j"), '.size > 20 and (.tags | any(. == "SMALL"))')).select("id")


@query("SELECT p_partkey AS id, unnest([p_type, p_brand]) AS tag FROM part")
def jq_outputs(spark, d):
    return _json(spark, d).select("id", F.explode(jq.outputs(F.col("j"), ".tags[]")).alias("tag")).select("id", F.replace("tag", F.lit('"'), F.lit("")).alias("tag"))


@query("SELECT p_partkey AS id, '{\"n\":' || (p_size * 2) || ',\"b\":\"' || lower(p_brand) || '\"}' AS body FROM part WHERE p_size % 3 <> 0")
def jq_transform(spark, d):
    j = _json(spark, d).withColumn("body", jq.first(F.col("j"), "if .size % 3 == 0 then null else {n: (.size * 2), b: (.at.brand | ascii_downcase)} end"))
    return j.where("body is not null").select("id", "body")


@query("SELECT p_partkey AS id, p_type || '|' || p_brand AS tags FROM part")
def json_arrays(spark, d):
    return _json(spark, d).select("id", F.array_join(F.from_json(F.get_json_object("j", "$.tags[*]"), "array<string>"), "|").alias("tags"))


@query("SELECT p_partkey AS k, CAST(1 AS INT) AS no, 'Options' AS section, '-' || substr(p_name, 1, 1) AS short, '--size' AS long, '<N>' AS value, p_brand AS description FROM part UNION ALL SELECT p_partkey, 3, 'Commands', NULL, 'run', NULL, p_type FROM part")
def help_texts(spark, d):
    value = F.concat(F.lit("Options:\n  -"), F.substring("p_name", 1, 1), F.lit(", --size <N>   "), "p_brand", F.lit("\nCommands:\n  run   "), "p_type")
    return exports.help_entries(load(spark, d, "part").select(F.col("p_partkey").alias("k"), value.alias("value")), "k")
