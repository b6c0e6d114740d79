"""Readers, the jq language, Python sources, manifests and kept tables on small literals."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import jq, texts
from sparkloom.operators import graph, index, messages, similarity, stores, vectors
from sparkloom.plans import catalogue
from sparkloom.runtime import Scratch, clean, shared_dir
from sparkloom.sources import exports, manifests, python_source
from sparkloom.streaming import windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


DOC = '{"a":{"b":[1,2,{"c":"x"}]},"n":3,"tags":["p","q"],"s":"Hello"}'


@pytest.mark.parametrize(("program", "want"), [
    (".a.b[2].c", ['"x"']), (".a.b[:2]", ["[1,2]"]), (".tags[]", ['"p"', '"q"']), ('.missing // "d"', ['"d"']), ("{n, first: .tags[0]}", ['{"n":3,"first":"p"}']), ('[.tags[] | select(. != "p")]', ['["q"]']), (".n * 2 + 1", ["7"]),
    ('if .n > 5 then 1 elif .n > 2 then "mid" else 0 end', ['"mid"']), ("[.a.b[] | type]", ['["number","number","object"]']), ("del(.a) | keys", ['["n","s","tags"]']), ("to_entries | map(.key) | length", ["4"]), ('.s | test("^He") and (length == 5)', ["true"]),
    (".n | .x", []), (".tags | sort_by(.) | reverse", ['["q","p"]']), ("[range(3)] | add", ["3"]), (".nothing?", ["null"]), (".tags | any(. == \"q\")", ["true"]), ("empty", []),
])
def test_jq(program, want):
    assert jq.run(program, DOC) == want


def test_jq_columns(spark):
    df = spark.createDataFrame([(1, DOC), (2, "not json"), (3, None), (4, "{}")], "id int, j string")
    assert rows(df.select("id", jq.holds(F.col("j"), ".n == 3"))) == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(df.select("id", jq.first(F.col("j"), ".s"))) == [(1, '"Hello"'), (2, None), (3, None), (4, None)]
    with pytest.raises(jq.JqError):
        jq.outputs(F.col("j"), ".a |")


CODE = '''"""Module."""
import os.path as p
from . import x
async def go(a, b, _c, *, d=1):
    """Doc."""
    with open(a) as f:
        pass
    for i in range(3):
        if i and d or f:
            continue
        await x.run(i)
    try:
        risky()
    except ValueError:
        raise KeyError("k")
    return [y for y in p.list() if y]
class A(x.Base):
    size: int = 0
    def _m(self): yield self
'''


def test_python_source(spark):
    files = spark.createDataFrame([("a.py", CODE), ("bad.py", "def ("), ("empty.py", ""), ("none.py", None)], "path string, text string")
    assert [(r.name, r.kind, r.parent, r.visibility, r.complexity) for r in python_source.symbols(files).orderBy("start_line").collect()] == [("go", "function", None, "public", 7), ("A", "class", None, "public", 0), ("_m", "method", "A", "private", 1)]
    assert rows(python_source.imports(files)) == [("a.py", ".", "x", None, 3), ("a.py", "os.path", "os.path", "p", 2)]
    assert ("a.py", "go", "run", "x", 11) in rows(python_source.calls(files)) and ("a.py", "go", "risky", None, 13) in rows(python_source.calls(files))
    assert rows(python_source.type_references(files)) == [("a.py", "A", "int", 18), ("a.py", "A", "x.Base", 17)]
    assert rows(python_source.unused_parameters(files)) == [("a.py", "go", "b", 4)]
    kinds = {(r.kind, r.exception) for r in python_source.cfg_edges(files).where("func = 'go'").collect()}
    assert {("exception", "ValueError"), ("exception", "KeyError"), ("continue", None), ("back", None), ("return", None)} <= kinds
    assert {r.kind for r in python_source.cfg_effects(files).collect()} == {"await", "defer", "yield"}
    assert ("a.py", "y", 16, "go") in rows(python_source.scopes(files)) and ("a.py", "range", 8, None) in rows(python_source.scopes(files))
    assert rows(python_source.line_counts(files)) == [("a.py", 19, 0), ("empty.py", 0, 0), ("none.py", 0, 0)]
    twins = spark.createDataFrame([("a", "def f(x):\n    return x + 1\n"), ("b", "def g(y):\n    return y + 2\n"), ("c", "def h(y):\n    return y * 2\n")], "path string, text string")
    hashes = [r["hash"] for r in python_source.symbols(twins).orderBy("file").collect()]
    assert hashes[0] == hashes[1] != hashes[2]


@pytest.mark.parametrize(("path", "text", "want"), [
    ("x/pyproject.toml", '[project]\nname="n"\nversion="1"\ndependencies=["a>=1","b[c]"]\n[project.optional-dependencies]\nt=["d"]\n', [("pip", "n", "1", "a", ">=1", "normal"), ("pip", "n", "1", "b", None, "normal"), ("pip", "n", "1", "d", None, "optional")]),
    ("Gemfile", "source 'x'\ngem 'rails', '~> 7'\ngem \"rake\"\n", [("bundler", None, None, "rails", "~> 7", "normal"), ("bundler", None, None, "rake", None, "normal")]),
    ("build.gradle", "dependencies {\n  implementation 'g:a:1'\n  testImplementation(\"g:b:2\")\n}", [("gradle", None, None, "g:a", "1", "normal"), ("gradle", None, None, "g:b", "2", "dev")]),
    ("p.csproj", '<Project><ItemGroup><PackageReference Include="A" Version="1"/></ItemGroup></Project>', [("nuget", None, None, "A", "1", "normal")]),
    ("mix.exs", 'app: :n, version: "1", deps: [{:a, "~> 1"}]', [("hex", "n", "1", "a", "~> 1", "normal")]),
    ("pubspec.yaml", "name: n\nversion: 1.0\ndependencies:\n  a: ^1\ndev_dependencies:\n  b: any\n", [("pub", "n", "1.0", "a", "^1", "normal"), ("pub", "n", "1.0", "b", "any", "dev")]),
    ("setup.cfg", "[metadata]\nname = n\nversion = 1\n[options]\ninstall_requires =\n    a>=1\n    b\n", [("pip", "n", "1", "a", ">=1", "normal"), ("pip", "n", "1", "b", None, "normal")]),
    ("composer.json", '{"name":"n","require":{"a":"1"},"require-dev":{"b":"2"}}', [("composer", "n", None, "a", "1", "normal"), ("composer", "n", None, "b", "2", "dev")]),
    ("n.cabal", "name: n\nversion: 1\nlibrary\n  build-depends: base >=4, text\n", [("hackage", "n", "1", "base", ">=4", "normal"), ("hackage", "n", "1", "text", None, "normal")]),
    ("Cargo.toml", "not toml =", []), ("README.md", "x", []), ("package.json", '{"name":"n"}', [("npm", "n", None, None, None, None)]),
])
def test_manifests(path, text, want):
    assert [r[1:] for r in manifests.parse_manifest(path, text)] == want


def test_walk_and_help(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("one\ntwo")
    (tmp_path / "b.min.js").write_text("x\n")
    (tmp_path / "empty").write_text("")
    assert [(r.path, r.size, r.lines) for r in exports.walk(spark, str(tmp_path), ("*.min.js",)).orderBy("path").collect()] == [("src/a.py", 7, 2)]
    text = "Usage: x\n\nOptions:\n  -v, --verbose   say more\n  --out <FILE>    where to\nCommands:\n  build   makes it\n"
    got = exports.help_entries(spark.createDataFrame([(1, text)], "k int, value string"), "k").orderBy("no").collect()
    assert [(r.section, r.short, r.long, r.value, r.description) for r in got] == [("Options", "-v", "--verbose", None, "say more"), ("Options", None, "--out", "<FILE>", "where to"), ("Commands", None, "build", None, "makes it")]


def test_usage(spark):
    line = '{"message":{"role":"assistant","model":"m","usage":{"input_tokens":5,"output_tokens":2,"cache_read_input_tokens":1}}}'
    assert rows(exports.usage(spark.createDataFrame([("s", line + "\n{}\n" + line)], "path string, value string"))) == [("s", 0, "m", 5, 2, 1, 0), ("s", 2, "m", 5, 2, 1, 0)]


def test_eviction(spark):
    rng = random.Random(3)
    cache = [(i, rng.randint(1, 9), rng.randint(0, 500)) for i in range(900)]
    df = spark.createDataFrame(cache, "id int, size int, used int")
    total = sum(s for _, s, _ in cache)
    assert stores.evict(df, "size", "used", total) is df
    for limit in (total - 1, total // 2, 10):
        left = stores.evict(df, "size", "used", limit, chunk=50).collect()
        gone = sorted(set(cache) - {tuple(r) for r in left}, key=lambda r: r[2])
        assert len(gone) % 50 == 0 or not left
        assert sum(r["size"] for r in left) <= 0.9 * limit
        assert not left or max(r[2] for r in gone) <= min(r["used"] for r in left)
        assert sum(s for _, s, _ in gone[:-50]) < total - 0.9 * limit  # a chunk less wouldn't do


def test_overlaps_and_blocks(spark):
    rng = random.Random(1)
    pairs = [(rng.choice("ab"), s := rng.randint(1, 40), s + rng.randint(5, 20), "z", t := rng.randint(1, 40), t + rng.randint(5, 20), float(i)) for i in range(40)]
    df = spark.createDataFrame(pairs, "file_a string, sa int, ea int, file_b string, sb int, eb int, score double")
    share = lambda s, e, x, y: max(0, min(e, y) - max(s, x) + 1) / (max(e, y) - min(s, x) + 1)
    want: list = []
    for p in sorted(pairs, key=lambda p: -p[6]):
        if not any(k[0] == p[0] and share(p[1], p[2], k[1], k[2]) > 0.5 and share(p[4], p[5], k[4], k[5]) > 0.5 for k in want):
            want.append(p)
    assert rows(similarity.without_overlaps(df)) == sorted(want, key=str) and len(want) < len(pairs)


def test_minhash_finds_what_brute_force_finds(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts_ = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        texts_ += [base, [w if rng.random() > 0.02 else "changed" for w in base], base[: len(base) - rng.randint(0, 12)]]
    data = [(i, " ".join(t)) for i, t in enumerate(texts_)] + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One")]
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in data if t and (w := t.lower().split())}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in similarity.minhash_pairs(spark.createDataFrame(data, "id int, t string"), "id", "t", Scratch(spark, "t")).collect()}
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}  # copies are linked to the first of them only
    assert got == {(a, b): pytest.approx(s) for (a, b), s in want.items() if (first[b] == a and s == 1) or (first[a] == a and first[b] == b)}
    assert (903, 904) in got


def test_vector_search_recall(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = {(r.query, r.vec_id) for r in vectors.search(e, q, "vec_id", "embedding", Scratch(spark, "t"), cells=8).collect()}
    true = {(r["query"], r["vec_id"]) for r in catalogue.QUERIES["knn_cosine"](spark, small).collect()}
    assert len(got & true) >= 0.9 * len(true)
    assert vectors.search(e.where("false"), q, "vec_id", "embedding", Scratch(spark, "t")).collect() == []


def test_simple_paths_and_cycles(spark):
    e = spark.createDataFrame([tuple(p) for p in ("ab", "bc", "ca", "bd", "dc", "cb", "xx")], "src string, dst string")
    one = lambda c: spark.createDataFrame([(c,)], "n string")
    assert rows(graph.simple_paths(e, Scratch(spark, "t"), one("a"), one("c"), 3)) == [("a", "c", 2, "a>b>c"), ("a", "c", 3, "a>b>d>c")]
    assert rows(graph.simple_cycles(e, Scratch(spark, "t"), 4)) == [(2, "b>c"), (3, "a>b>c"), (3, "b>d>c"), (4, "a>b>d>c")]


def test_streams(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_type").collect()
    by: dict[int, list] = {}
    for r in events:
        by.setdefault(r.user_id, []).append(r.ts)
    got = catalogue.QUERIES["stream_session"](spark, small)
    assert got.count() <= sum(len(v) for v in by.values()) and {r.user_id for r in got.collect()} <= set(by)
    assert callable(windows.bursts)


def test_blame_is_one_session_or_none(spark):
    chunks = spark.createDataFrame([(1, "f", 10, "alpha beta  gamma"), (2, "f", 10, "delta words"), (3, "f", 10, "a b"), (4, "g", 10, "alpha beta gamma"), (5, "f", 1, "alpha beta gamma")], "chunk int, path string, at int, text string")
    edits = spark.createDataFrame([("s1", "f", 5, "alpha beta gamma and more"), ("s1", "f", 6, "delta words"), ("s2", "f", 7, "some delta words too")], "session string, path string, ts int, text string")
    assert rows(messages.attribute_chunks(chunks, edits)) == [(1, "matched", "s1"), (2, "ambiguous", None), (3, "unattributed", None), (4, "unattributed", None), (5, "unattributed", None)]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(texts.common_prefix(F.array(F.lit("a/b/c"), F.lit("a/b/d/e")))) == "a/b/" and one(texts.common_prefix(F.array(F.lit("a"), F.lit("b")))) == ""
    assert one(texts.price(F.lit("unknown"))) is None and one(texts.price(F.lit("Opus 4.6")))["input"] == 5.0
    assert one(texts.correction(F.lit("fine"))) is None
    assert one(texts.sparkline(F.array(F.lit(0), F.lit(0)))) == "▁▁"


def test_ad_hoc_views_do_not_stay(spark):
    t = spark.createDataFrame([(1,), (2,)], "a int")
    assert index.raw_query(spark, "SELECT sum(a) AS s FROM t", {"t": t}).first()["s"] == 3
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("loom_")]


def test_shared_folder_and_clean(spark):
    import os

    scratch = Scratch(spark, "cleaned")
    kept = scratch.stage_by(spark.range(20).withColumnRenamed("id", "k"), "k", 3)
    assert kept.groupBy("k").count().count() == 20
    path = scratch.path.removeprefix("file://")
    assert os.path.isdir(path) and shared_dir(spark) in scratch.path
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("loom_")]
    clean(spark)
    assert not os.path.exists(path)
