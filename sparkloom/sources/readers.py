"""Sources: text sections and front matter, session logs, manifests, SARIF findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>, results:array<struct<ruleId:string, level:string, message:struct<text:string>, locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int>>>>>>>>"


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """(tool, rule, severity, file, line, message) of SARIF files."""
    runs = spark.read.schema(_SARIF).option("multiLine", True).json(path).select(F.explode("runs").alias("r"))
    each = runs.select(F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    at = F.col("x.locations")[0].getField("physicalLocation")
    return each.select("tool", F.col("x.ruleId").alias("rule"), F.coalesce("x.level", F.lit("warning")).alias("severity"), at.getField("artifactLocation").getField("uri").alias("file"), at.getField("region").getField("startLine").alias("line"), F.col("x.message.text").alias("message"))


def front_matter(files: DataFrame, text: str = "value") -> DataFrame:
    """``files`` with front (the block between --- lines at the top, else null) and body."""
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = F.col(text).rlike(pattern)
    return files.withColumn("front", F.when(has, F.regexp_extract(text, pattern, 1))).withColumn("body", F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(F.col(text)))


def markdown_sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, breadcrumb, body): a section for each heading, with the headings above it."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    depth = F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))
    w = Window.partitionBy(key).orderBy("p")
    marked = lines.withColumn("depth", depth).withColumn("no", F.sum((F.col("depth") > 0).cast("int")).over(w))
    for d in range(1, 7):
        reset = F.when(F.col("depth") == d, F.trim(F.regexp_replace("line", "^#+ ", ""))).when((F.col("depth") > 0) & (F.col("depth") < d), F.lit(""))
        marked = marked.withColumn(f"h{d}", F.last(reset, ignorenulls=True).over(w))
    crumb = F.array_join(F.filter(F.array(*[f"h{d}" for d in range(1, 7)]), lambda h: h.isNotNull() & (h != "")), " > ")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("depth") == 0, F.struct("p", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy(key, "no").agg(F.max(crumb).alias("breadcrumb"), body.alias("body"))


def session_blocks(rows: DataFrame, session: str, payload: str) -> DataFrame:
    """(session, block, role, type, tool, text) of chat messages stored as JSON {role, content: [...]}."""
    parsed = rows.select(session, F.from_json(payload, "role string, content array<struct<type:string, text:string, name:string, id:string>>").alias("m"))
    each = parsed.select(session, F.col("m.role").alias("role"), F.posexplode_outer("m.content").alias("block", "b"))
    return each.select(session, "block", "role", F.col("b.type").alias("type"), F.col("b.name").alias("tool"), F.col("b.text").alias("text"))


def package_json(files: DataFrame, text: str = "value") -> DataFrame:
    """(name, version, dependency, requirement, kind) of package manifests."""
    kinds = "map<string,string>"
    m = files.select(F.from_json(text, f"name string, version string, dependencies {kinds}, devDependencies {kinds}").alias("m"))
    both = [m.select("m.name", "m.version", F.explode(f"m.{field}").alias("dependency", "requirement"), F.lit(kind).alias("kind")) for field, kind in (("dependencies", "normal"), ("devDependencies", "dev"))]
    return both[0].unionByName(both[1])


def cargo_toml(files: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, dependency, requirement) of the [dependencies] table of Cargo manifests."""
    table = F.regexp_extract(text, r"(?s)(?:^|\n)\[dependencies\]\n(.*?)(?:\n\[|$)", 1)
    line = files.select(key, F.explode(F.split(table, "\n")).alias("line")).where(F.col("line").contains("="))
    requirement = F.regexp_extract("line", r'=\s*(?:\{[^}]*version\s*=\s*)?"([^"]*)"', 1)
    return line.select(key, F.trim(F.substring_index("line", "=", 1)).alias("dependency"), requirement.alias("requirement"))


def to_sarif(findings: DataFrame, tool: str) -> DataFrame:
    """Findings (rule, severity, file, line, message) as SARIF results, one JSON text a row, ready for ``write.text``."""
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.lit(tool).alias("tool"))).alias("value"))
