"""Package manifests as (path, ecosystem, name, version, dependency, requirement, kind), by the file's name."""

from __future__ import annotations

import configparser
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.runtime import ship

SCHEMA = "path string, ecosystem string, name string, version string, dependency string, requirement string, kind string"
Parsed = tuple[str | None, str | None, list[tuple[str, str | None, str]]]


def _table(deps: dict | None, kind: str) -> list[tuple[str, str | None, str]]:
    return [(n, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, kind) for n, v in (deps or {}).items()]


def _json(*fields: tuple[str, str]) -> Callable[[str], Parsed]:
    def parse(text: str) -> Parsed:
        m = json.loads(text)
        return m.get("name"), m.get("version"), [d for field, kind in fields for d in _table(m.get(field), kind)]

    return parse


def _cargo(text: str) -> Parsed:
    m = tomllib.loads(text)
    own = m.get("package", {})
    kinds = (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))
    return own.get("name"), own.get("version") if isinstance(own.get("version"), str) else None, [d for f, k in kinds for d in _table(m.get(f), k)]


def _requirement(line: str) -> tuple[str, str | None] | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)", line)
    return (m[1], m[2].strip() or None) if m else None


def _requirements(text: str) -> Parsed:
    found = [_requirement(line) for line in text.splitlines() if not line.lstrip().startswith(("#", "-"))]
    return None, None, [(*f, "normal") for f in found if f]


def _pyproject(text: str) -> Parsed:
    m = tomllib.loads(text)
    own, poetry = m.get("project", {}), m.get("tool", {}).get("poetry", {})
    deps = [(*f, "normal") for f in map(_requirement, own.get("dependencies", [])) if f]
    deps += [(*f, "optional") for group in own.get("optional-dependencies", {}).values() for f in map(_requirement, group) if f]
    deps += [d for d in _table(poetry.get("dependencies"), "normal") if d[0] != "python"]
    return own.get("name") or poetry.get("name"), own.get("version") or poetry.get("version"), deps


def _setup_cfg(text: str) -> Parsed:
    c = configparser.ConfigParser()
    c.read_string(text)
    lines = c.get("options", "install_requires", fallback="").splitlines()
    return c.get("metadata", "name", fallback=None), c.get("metadata", "version", fallback=None), [(*f, "normal") for f in map(_requirement, lines) if f]


def _go(text: str) -> Parsed:
    module = re.search(r"^module\s+(\S+)", text, re.M)
    body = [line for block in re.findall(r"^require\s*\(([^)]*)\)", text, re.M) for line in block.splitlines()] + re.findall(r"^require\s+([^(\s]\S*\s+\S+.*)$", text, re.M)
    found = [re.match(r"\s*(\S+)\s+(v\S+)(.*)", line) for line in body]
    return module[1] if module else None, None, [(m[1], m[2], "indirect" if "// indirect" in m[3] else "normal") for m in found if m]


def _pom(text: str) -> Parsed:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    deps = [(f"{d.findtext('groupId')}:{d.findtext('artifactId')}", d.findtext("version"), d.findtext("scope") or "normal") for d in root.findall("./dependencies/dependency")]
    return root.findtext("artifactId"), root.findtext("version"), deps


def _csproj(text: str) -> Parsed:
    root = ET.fromstring(text)
    return root.findtext(".//AssemblyName"), root.findtext(".//Version"), [(d.get("Include"), d.get("Version"), "normal") for d in root.iter("PackageReference") if d.get("Include")]


def _gemfile(text: str) -> Parsed:
    return None, None, [(m[1], m[2], "normal") for m in re.finditer(r"""^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", text, re.M)]


def _gradle(text: str) -> Parsed:
    found = re.finditer(r"""^\s*(implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['"]([^:'"]+:[^:'"]+)(?::([^'"]+))?['"]""", text, re.M)
    return None, None, [(m[2], m[3], "dev" if m[1].startswith("test") else "normal") for m in found]


def _mix(text: str) -> Parsed:
    app, version = re.search(r"app:\s*:(\w+)", text), re.search(r'version:\s*"([^"]+)"', text)
    return app and app[1], version and version[1], [(m[1], m[2], "normal") for m in re.finditer(r'\{:(\w+),\s*"([^"]+)"', text)]


def _pubspec(text: str) -> Parsed:
    name, version = re.search(r"^name:\s*(\S+)", text, re.M), re.search(r"^version:\s*(\S+)", text, re.M)
    deps = [(m[1], m[2].strip() or None, kind) for field, kind in (("dependencies", "normal"), ("dev_dependencies", "dev")) for block in re.findall(rf"^{field}:\n((?:[ \t]+.*\n?)*)", text, re.M) for m in re.finditer(r"^  (\w+):[ \t]*(.*)$", block, re.M)]
    return name and name[1], version and version[1], deps


def _cabal(text: str) -> Parsed:
    field = lambda n: (m := re.search(rf"^{n}:\s*(\S+)", text, re.M | re.I)) and m[1]
    deps = [d.strip() for block in re.findall(r"build-depends:\s*((?:[^\n]*\n?(?:\s+,[^\n]*\n?)*))", text, re.I) for d in block.replace("\n", " ").split(",")]
    return field("name"), field("version"), [(m[1], m[2].strip() or None, "normal") for d in deps if (m := re.match(r"([\w\-]+)\s*(.*)", d))]


#: By file name, or ending: ecosystem and parser.
PARSERS: dict[str, tuple[str, Callable[[str], Parsed]]] = {
    "package.json": ("npm", _json(("dependencies", "normal"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))), "deno.json": ("deno", _json(("imports", "normal"))), "composer.json": ("composer", _json(("require", "normal"), ("require-dev", "dev"))), "bower.json": ("bower", _json(("dependencies", "normal"), ("devDependencies", "dev"))),
    "Cargo.toml": ("cargo", _cargo), "requirements.txt": ("pip", _requirements), "constraints.txt": ("pip", _requirements), "pyproject.toml": ("pip", _pyproject), "setup.cfg": ("pip", _setup_cfg), "go.mod": ("go", _go), "pom.xml": ("maven", _pom), ".csproj": ("nuget", _csproj), ".fsproj": ("nuget", _csproj),
    "Gemfile": ("bundler", _gemfile), "build.gradle": ("gradle", _gradle), "build.gradle.kts": ("gradle", _gradle), "mix.exs": ("hex", _mix), "pubspec.yaml": ("pub", _pubspec), ".cabal": ("hackage", _cabal),
}


def parser(path: str) -> tuple[str, Callable[[str], Parsed]] | None:
    name = path.rsplit("/", 1)[-1]
    return PARSERS.get(name) or next((p for end, p in PARSERS.items() if end.startswith(".") and name.endswith(end)), None)


def parse_manifest(path: str, text: str) -> list[tuple]:
    """A manifest's dependencies; one row without a dependency if it has none; nothing for other files and what can't be read."""
    found = parser(path)
    if not found:
        return []
    try:
        name, version, deps = found[1](text)
    except (ValueError, ET.ParseError, AttributeError, configparser.Error):
        return []
    return [(path, found[0], name, version, *d) for d in deps] or [(path, found[0], name, version, None, None, None)]


def manifests(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """All manifests among files, of whatever ecosystem."""
    ship(files.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p and t for r in parse_manifest(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    return files.select(path, text).mapInArrow(batches, SCHEMA)
