"""Facts of Python source texts: symbols, imports, calls, type references, control flow, scopes, clones.

Each function is one pass over files (path, text) in Arrow batches; a text that doesn't parse gives no rows. Other
languages come in through the same tables from whatever parses them.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.runtime import ship

SYMBOLS = "file string, name string, kind string, parent string, start_line int, end_line int, visibility string, complexity int, doc string, hash string, tokens int"
IMPORTS = "file string, module string, name string, alias string, line int"
CALLS = "caller_file string, caller_symbol string, callee_name string, callee_qualifier string, line int"
REFERENCES = "file string, symbol string, type string, line int"
BLOCKS = "file string, func string, func_line int, block int, kind string, line int"
EDGES = "file string, func string, func_line int, src int, dst int, kind string, exception string"
USES = "file string, func string, func_line int, block int, what string, name string"
EFFECTS = "file string, func string, func_line int, block int, kind string, line int, label string"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)


def _each(files: DataFrame, path: str, text: str, schema: str, rows) -> DataFrame:
    """``rows(path, tree, text)`` of every file that parses."""
    ship(files.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = ast.parse(t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += rows(p, tree, t or "")
            columns = list(zip(*out)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])

    return files.select(path, text).mapInArrow(batches, schema)


def _walk(node: ast.AST, parents: tuple = ()) -> Iterator[tuple[ast.AST, tuple]]:
    """Nodes with the classes and functions around them."""
    for child in ast.iter_child_nodes(node):
        yield child, parents
        yield from _walk(child, (*parents, child) if isinstance(child, (*_FUNCTIONS, ast.ClassDef)) else parents)


def complexity(function: ast.AST) -> int:
    """One more than the branches of a function, each further operand of and / or being one."""
    return 1 + sum(isinstance(n, _BRANCHES) for n in ast.walk(function)) + sum(len(n.values) - 1 for n in ast.walk(function) if isinstance(n, ast.BoolOp))


def shape(node: ast.AST, names: bool = True, literals: bool = True) -> list[str]:
    """A subtree as tokens: kinds of nodes in order, with names and literals unless they are left out. Docstrings and places don't count."""
    out = []
    for n in ast.walk(node):
        out.append(type(n).__name__)
        if names:
            out += [str(v) for f in ("id", "name", "attr", "arg") if isinstance(v := getattr(n, f, None), str)]
        if literals and isinstance(n, ast.Constant):
            out.append(repr(n.value))
    return out


def _hash(node: ast.AST) -> tuple[str, int]:
    tokens = shape(node, names=False, literals=False)
    return hashlib.sha256("\0".join(tokens).encode()).hexdigest()[:16], len(tokens)


def _symbols(path: str, tree: ast.AST, text: str) -> list[tuple]:
    out = []
    for n, around in _walk(tree):
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            inside = bool(around) and isinstance(around[-1], ast.ClassDef)
            kind = "class" if isinstance(n, ast.ClassDef) else "method" if inside else "function"
            out.append((path, n.name, kind, around[-1].name if around else None, n.lineno, n.end_lineno, "private" if n.name.startswith("_") else "public", 0 if kind == "class" else complexity(n), ast.get_docstring(n), *_hash(n)))
    return out


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Classes, functions and methods with lines, visibility, McCabe complexity, docstring, and a hash of their shape without names and literals."""
    return _each(files, path, text, SYMBOLS, _symbols)


def _imports(path: str, tree: ast.AST, text: str) -> list[tuple]:
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(path, a.name, a.name, a.asname, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(path, "." * n.level + (n.module or ""), a.name, a.asname, n.lineno) for a in n.names]
    return out


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Imported names with their module (dots first where it is relative) and alias."""
    return _each(files, path, text, IMPORTS, _imports)


def _calls(path: str, tree: ast.AST, text: str) -> list[tuple]:
    out = []
    for n, around in _walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
            own = next((a.name for a in reversed(around) if isinstance(a, _FUNCTIONS)), "<module>")
            by = n.func.value.id if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) else None
            out.append((path, own, n.func.id if isinstance(n.func, ast.Name) else n.func.attr, by, n.lineno))
    return out


def calls(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Calls with the function they stand in, the name called and what is before its dot."""
    return _each(files, path, text, CALLS, _calls)


def _references(path: str, tree: ast.AST, text: str) -> list[tuple]:
    out = []
    for n, around in _walk(tree):
        own = ".".join(a.name for a in around)
        if isinstance(n, ast.ClassDef):
            out += [(path, ".".join(filter(None, (own, n.name))), ast.unparse(b), n.lineno) for b in n.bases]
        elif isinstance(n, ast.arg | ast.AnnAssign) and n.annotation:
            out.append((path, own, ast.unparse(n.annotation), n.lineno))
        elif isinstance(n, _FUNCTIONS) and n.returns:
            out.append((path, ".".join(filter(None, (own, n.name))), ast.unparse(n.returns), n.lineno))
    return out


def type_references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Types named by base classes and annotations."""
    return _each(files, path, text, REFERENCES, _references)


class _Flow:
    """The control flow graph of a function: blocks, edges, names set and read, effects."""

    def __init__(self, function: ast.AST) -> None:
        self.blocks: list[tuple[str, int]] = []
        self.edges: list[tuple[int, int, str, str | None]] = []
        self.uses: list[tuple[int, str, str]] = []
        self.effects: list[tuple[int, str, int, str | None]] = []
        self.loops: list[tuple[int, int]] = []
        self.handlers: list[tuple[int, str | None]] = []
        entry = self.block("entry", function.lineno)
        self.exit = self.block("exit", function.end_lineno)
        for a in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs, *filter(None, (function.args.vararg, function.args.kwarg))]:
            self.uses.append((entry, "def", a.arg))
        last = self.body(function.body, entry)
        if last is not None:
            self.edge(last, self.exit, "next")

    def block(self, kind: str, line: int) -> int:
        self.blocks.append((kind, line))
        return len(self.blocks) - 1

    def edge(self, a: int, b: int, kind: str, exception: str | None = None) -> None:
        self.edges.append((a, b, kind, exception))

    def look(self, at: int, node: ast.AST | None) -> None:
        for n in ast.walk(node) if node else ():
            if isinstance(n, ast.Name):
                self.uses.append((at, "use" if isinstance(n.ctx, ast.Load) else "def", n.id))
            elif isinstance(n, ast.Await | ast.Yield | ast.YieldFrom):
                self.effects.append((at, "await" if isinstance(n, ast.Await) else "yield", n.lineno, None))
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("acquire", "release", "close"):
                self.effects.append((at, "acquire" if n.func.attr == "acquire" else "release", n.lineno, ast.unparse(n.func.value)))

    def body(self, statements: list, at: int | None) -> int | None:
        """The block control leaves the statements from, or None if it doesn't."""
        for s in statements:
            if at is None:
                return None
            at = self.statement(s, at)
        return at

    def join(self, line: int, ends: list[int | None]) -> int | None:
        ends = [e for e in ends if e is not None]
        if not ends:
            return None
        after = self.block("body", line)
        for e in ends:
            self.edge(e, after, "next")
        return after

    def statement(self, s: ast.AST, at: int) -> int | None:
        if isinstance(s, ast.If):
            self.look(at, s.test)
            yes, no = self.block("branch", s.lineno), self.block("branch", s.lineno)
            self.edge(at, yes, "true")
            self.edge(at, no, "false")
            return self.join(s.end_lineno, [self.body(s.body, yes), self.body(s.orelse, no)])
        if isinstance(s, ast.For | ast.AsyncFor | ast.While):
            head, inside, after = self.block("loop", s.lineno), self.block("body", s.lineno), self.block("body", s.end_lineno)
            self.edge(at, head, "next")
            self.look(head, s.test if isinstance(s, ast.While) else s.iter)
            self.look(head, getattr(s, "target", None))
            self.edge(head, inside, "true")
            self.loops.append((head, after))
            end = self.body(s.body, inside)
            self.loops.pop()
            if end is not None:
                self.edge(end, head, "back")
            other = self.block("branch", s.lineno)
            self.edge(head, other, "false")
            end = self.body(s.orelse, other)
            if end is not None:
                self.edge(end, after, "next")
            return after
        if isinstance(s, ast.Match):
            self.look(at, s.subject)
            ends: list[int | None] = []
            for case in s.cases:
                b = self.block("case", case.pattern.lineno)
                self.edge(at, b, "case")
                ends.append(self.body(case.body, b))
            return self.join(s.end_lineno, [*ends, at])
        if isinstance(s, ast.Try | ast.TryStar):
            heads = [(self.block("catch", h.lineno), ast.unparse(h.type) if h.type else "") for h in s.handlers]
            inside = self.block("try", s.lineno)
            self.edge(at, inside, "next")
            for b, kind in heads:
                self.edge(inside, b, "exception", kind)
            kept, self.handlers = self.handlers, [*self.handlers, *heads]
            end = self.body(s.body, inside)
            self.handlers = kept
            ends = [self.body(s.orelse, end) if end is not None else None, *[self.body(h.body, b) for h, (b, _) in zip(s.handlers, heads)]]
            after = self.join(s.end_lineno, ends)
            return self.body(s.finalbody, after) if after is not None else None
        if isinstance(s, ast.With | ast.AsyncWith):
            for item in s.items:
                self.look(at, item.context_expr)
                self.look(at, item.optional_vars)
                self.effects.append((at, "defer", s.lineno, ast.unparse(item.context_expr)))
            return self.body(s.body, at)
        if isinstance(s, (*_FUNCTIONS, ast.ClassDef)):
            self.uses.append((at, "def", s.name))
            return at
        self.look(at, s)
        if isinstance(s, ast.Return):
            self.edge(at, self.exit, "return")
            return None
        if isinstance(s, ast.Raise):
            what = s.exc.func if isinstance(s.exc, ast.Call) else s.exc
            name = ast.unparse(what) if what else ""
            to = next((b for b, kind in reversed(self.handlers) if kind in ("", "Exception", name)), self.exit)
            self.edge(at, to, "exception", name)
            return None
        if isinstance(s, ast.Break | ast.Continue) and self.loops:
            self.edge(at, self.loops[-1][isinstance(s, ast.Break)], "break" if isinstance(s, ast.Break) else "continue")
            return None
        return at


def _flows(path: str, tree: ast.AST) -> Iterator[tuple[tuple, _Flow]]:
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTIONS):
            yield (path, n.name, n.lineno), _Flow(n)


def cfg_blocks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return _each(files, path, text, BLOCKS, lambda p, tree, _: [(*own, i, kind, line) for own, flow in _flows(p, tree) for i, (kind, line) in enumerate(flow.blocks)])


def cfg_edges(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Edges between blocks: next, true, false, back, case, return, break, continue, and exception with its type."""
    return _each(files, path, text, EDGES, lambda p, tree, _: [(*own, *e) for own, flow in _flows(p, tree) for e in flow.edges])


def cfg_uses(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Names that blocks set (def) and read (use)."""
    return _each(files, path, text, USES, lambda p, tree, _: sorted({(*own, *u) for own, flow in _flows(p, tree) for u in flow.uses}))


def cfg_effects(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """await, yield, defer (with), acquire and release by block."""
    return _each(files, path, text, EFFECTS, lambda p, tree, _: [(*own, *e) for own, flow in _flows(p, tree) for e in flow.effects])


def _unused(path: str, tree: ast.AST, text: str) -> list[tuple]:
    out = []
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTIONS):
            read = {x.id for s in n.body for x in ast.walk(s) if isinstance(x, ast.Name)}
            args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
            out += [(path, n.name, a.arg, a.lineno) for a in args if a.arg not in read and a.arg not in ("self", "cls") and not a.arg.startswith("_")]
    return out


def unused_parameters(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Parameters that their function never names; self, cls and those that start with _ aside."""
    return _each(files, path, text, "file string, function string, parameter string, line int", _unused)


def _scopes(path: str, tree: ast.AST, text: str) -> list[tuple]:
    """Each name read, with the innermost function around it that binds it, else the module, else none."""
    binds: dict[ast.AST | None, set[str]] = {}
    for n, around in _walk(tree):
        scope = next((a for a in reversed(around) if isinstance(a, _FUNCTIONS)), None)
        if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
            binds.setdefault(scope, set()).add(n.id)
        elif isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            binds.setdefault(scope, set()).add(n.name)
        elif isinstance(n, ast.arg):
            binds.setdefault(scope, set()).add(n.arg)
        elif isinstance(n, ast.Import | ast.ImportFrom):
            binds.setdefault(scope, set()).update((a.asname or a.name).split(".")[0] for a in n.names)
    out = []
    for n, around in _walk(tree):
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            scopes = [a for a in reversed(around) if isinstance(a, _FUNCTIONS)]
            home = next((a.name for a in scopes if n.id in binds.get(a, ())), "<module>" if n.id in binds.get(None, ()) else None)
            out.append((path, n.id, n.lineno, home))
    return out


def scopes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, name, line, scope): where each name that is read is bound; null for built-ins and what nothing binds."""
    return _each(files, path, text, "file string, name string, line int, scope string", _scopes)


def _comments(path: str, tree: ast.AST, text: str) -> list[tuple]:
    lines = len(text.splitlines())
    n = sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(text).readline))
    return [(path, lines, n)]


def line_counts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, lines, comments)."""
    return _each(files, path, text, "file string, lines int, comments int", _comments)
