"""Readers, writers and scalar functions on small literals; streams against batches."""

import json

from pyspark.sql import functions as F

from sparkloom.functions import scalar
from sparkloom.operators import facts, reports, similarity
from sparkloom.runtime import Scratch
from sparkloom.sources import readers


def test_sarif_round_trip(spark, tmp_path):
    doc = {"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.py"}, "region": {"startLine": 3}}}]}]}]}
    (tmp_path / "a.sarif").write_text(json.dumps(doc))
    got = readers.sarif(spark, str(tmp_path / "a.sarif"))
    assert tuple(got.first()) == ("t", "r", "error", "f.py", 3, "m")
    assert json.loads(readers.to_sarif(got, "t").first().value)["ruleId"] == "r"


def test_text_sources(spark):
    df = spark.createDataFrame([(1, "---\nid: a\n---\nbody"), (2, "no front")], "k int, value string")
    assert [(r.front, r.body) for r in readers.front_matter(df).orderBy("k").collect()] == [("id: a", "body"), (None, "no front")]
    md = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n# C\nz")], "k int, value string")
    assert [(r.breadcrumb, r.body) for r in readers.markdown_sections(md, "k", "value").orderBy("no").collect()] == [("", "intro"), ("A", "x"), ("A > B", "y"), ("C", "z")]
    chat = spark.createDataFrame([(1, '{"role":"user","content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Read"}]}')], "s int, p string")
    assert [(r.block, r.type, r.tool) for r in readers.session_blocks(chat, "s", "p").collect()] == [(0, "text", None), (1, "tool_use", "Read")]
    pkg = spark.createDataFrame([('{"name":"a","version":"1","dependencies":{"b":"^2"},"devDependencies":{"c":"3"}}',)], "value string")
    assert sorted((r.dependency, r.requirement, r.kind) for r in readers.package_json(pkg).collect()) == [("b", "^2", "normal"), ("c", "3", "dev")]
    cargo = spark.createDataFrame([(1, '[package]\nname = "x"\n[dependencies]\na = "1"\nb = { version = "2", features = [] }\n')], "k int, value string")
    assert sorted((r.dependency, r.requirement) for r in readers.cargo_toml(cargo, "k").collect()) == [("a", "1"), ("b", "2")]


def test_scalars(spark):
    one = spark.createDataFrame([("git@Host.com:Org/Repo.git", "src/core/a.py", "cd x && ls; # no || pwd")], "u string, p string, c string")
    r = one.select(scalar.git_url(F.col("u")).alias("u"), scalar.layer_of(F.col("p")).alias("p"), scalar.commands(F.col("c")).alias("c"), scalar.security_score(F.lit(1), F.lit(1), F.lit(1), F.lit(7)).alias("s")).first()
    assert (r.u, r.p, r.c, r.s) == ("host.com/org/repo", "core", ["cd x", "ls", "pwd"], 0)


def test_enclosing_and_latest(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 200), ("f", "inner", 50, 90)], "file string, name string, start long, end long")
    points = spark.createDataFrame([("f", 60), ("f", 150), ("f", 300)], "file string, line long")
    assert [(r.line, r.name) for r in facts.enclosing(points, spans).orderBy("line").collect()] == [(60, "inner"), (150, "outer"), (300, None)]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, t int, v string")
    assert [tuple(r) for r in reports.keep_latest(log, "k", "t").collect()] == [("a", 2, "y")]


def test_minhash(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    rows = [(1, base + "end one"), (2, base + "end two"), (3, "something else entirely that shares nothing at all"), (4, None), (5, ""), (6, base + "end one")]
    got = similarity.minhash_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t", Scratch(spark, "t")).collect()
    assert {(r.a, r.b) for r in got} >= {(1, 6)} and all(r.similarity >= 0.8 and 3 not in (r.a, r.b) for r in got)
