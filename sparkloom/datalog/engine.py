"""A Datalog engine on DataFrames.

Text such as

    relation reaches(String, String);
    reaches(a, b) <-- import(a, b, _);
    reaches(a, c) <-- reaches(a, b), import(b, c, _), if a != c;
    big(f) <-- symbol(f, _, _, _), agg n = count() in symbol(f, _, _, _), if n > 50;
    lone(f) <-- symbol(f, _, _, _), !import(_, f, _);

is parsed to rules; each body becomes equi-joins on shared variables, anti joins for negation, an aggregate over
distinct tuples for agg, and filters for guards. Relations are sets. Strata are evaluated in order; within a
recursive one, each round joins only what the round before added (semi-naive), staged in the shared folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.runtime import Scratch

_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+)|(?P<op><--|!=|==|<=|>=|&&|\|\||[<>!(),;.=_](?!\w)|[!(),;.])|(?P<name>\w+))')
#: Rounds after which what was derived is written as one table, so that plans of deep recursions stay short.
MERGE = 50
_TESTS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class DatalogError(ValueError):
    """A program that can't be read or that has no meaning."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass
class Atom:
    relation: str
    terms: list
    negated: bool = False


@dataclass
class Guard:
    left: object
    test: str
    right: object


@dataclass
class Either:
    """Guards of which all in one of the lists must hold."""

    ways: list[list[Guard]]


@dataclass
class Count:
    var: str
    atom: Atom


@dataclass
class Rule:
    head: Atom
    body: list = field(default_factory=list)


class _Parser:
    def __init__(self, text: str) -> None:
        text = re.sub(r"//[^\n]*|^\s*#[^\n]*", "", text, flags=re.M)
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise DatalogError(f"can't read {text[at : at + 30]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise DatalogError("the program ends too early")
        kind, text = self.tokens[self.at]
        if wanted and text != wanted:
            raise DatalogError(f"{wanted!r} is expected, not {text!r}")
        self.at += 1
        return kind, text

    def term(self):
        kind, text = self.take()
        if kind == "str":
            return text[1:-1].replace('\\"', '"')
        if kind == "num":
            return int(text)
        if text == "_":
            return None
        if kind == "name":
            return Var(text)
        raise DatalogError(f"{text!r} is no term")

    def atom(self) -> Atom:
        name = self.take()[1]
        self.take("(")
        terms = []
        while self.peek() != ")":
            terms.append(self.term())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return Atom(name, terms)

    def guard(self) -> Guard:
        negated = self.peek() == "!"
        if negated:
            self.take()
        left = self.term()
        if self.peek() == ".":
            self.take()
            name = self.take()[1]
            self.take("(")
            right = None if self.peek() == ")" else self.term()
            self.take(")")
            return Guard(left, ("!" if negated else "") + name, right)
        return Guard(left, self.take()[1], self.term())

    def clause(self):
        if self.peek() == "!":
            self.take()
            a = self.atom()
            a.negated = True
            return a
        if self.peek() == "if":
            self.take()
            either = [[self.guard()]]
            while self.peek() in ("||", "&&"):
                if self.take()[1] == "||":
                    either.append([])
                either[-1].append(self.guard())
            return either[0][0] if len(either) == len(either[0]) == 1 else Either(either)
        if self.peek() == "agg":
            self.take()
            var = self.take()[1]
            for w in ("=", "count", "(", ")", "in"):
                self.take(w)
            return Count(var, self.atom())
        return self.atom()

    def program(self) -> tuple[dict[str, int], list[Rule]]:
        declared, rules = {}, []
        while self.peek() is not None:
            if self.peek() == "relation":
                self.take()
                a = self.atom()
                declared[a.relation] = len(a.terms)
            else:
                rule = Rule(self.atom())
                if self.peek() == "<--":
                    self.take()
                    rule.body.append(self.clause())
                    while self.peek() == ",":
                        self.take()
                        rule.body.append(self.clause())
                rules.append(rule)
            self.take(";")
        return declared, rules


def parse(text: str) -> tuple[dict[str, int], list[Rule]]:
    """Declared relations by arity, and rules."""
    return _Parser(text).program()


def _reads(rule: Rule) -> list[tuple[str, bool]]:
    """Relations a rule reads, and whether they must be complete first."""
    return [(c.atom.relation, True) if isinstance(c, Count) else (c.relation, c.negated) for c in rule.body if isinstance(c, Atom | Count)]


def strata(rules: list[Rule]) -> list[list[str]]:
    """Derived relations in the order they can be evaluated, those that depend on each other together."""
    heads = sorted({r.head.relation for r in rules})
    needs: dict[str, set[str]] = {h: set() for h in heads}
    for r in rules:
        needs[r.head.relation] |= {name for name, _ in _reads(r)} & set(heads)
    reach = {h: set(n) for h, n in needs.items()}
    for k in heads:
        for h in heads:
            if k in reach[h]:
                reach[h] |= reach[k]
    for r in rules:
        for name, complete in _reads(r):
            if complete and name in reach and r.head.relation in reach[name] | {name}:
                raise DatalogError(f"{name} depends on its own negation or count")
    groups = {tuple(x for x in heads if x == h or (x in reach[h] and h in reach[x])) for h in heads}
    return [list(g) for g in sorted(groups, key=lambda g: (len(reach[g[0]] | set(g)), g))]


def check(text: str, base: dict[str, int]) -> list[str]:
    """What is wrong with a program: unknown relations, wrong numbers of terms, unbound variables, relations never used."""
    declared, rules = parse(text)
    known = base | declared
    found, used = [], set()
    for r in rules:
        bound = {t.name for c in r.body if isinstance(c, Atom) and not c.negated for t in c.terms if isinstance(t, Var)} | {c.var for c in r.body if isinstance(c, Count)}
        for a in [r.head, *(c if isinstance(c, Atom) else c.atom for c in r.body if isinstance(c, Atom | Count))]:
            if a.relation not in known:
                found.append(f"unknown relation {a.relation}")
            elif known[a.relation] != len(a.terms):
                found.append(f"{a.relation} has {known[a.relation]} terms, not {len(a.terms)}")
        used |= {name for name, _ in _reads(r)}
        found += [f"{t.name} in the head of {r.head.relation} is not bound" for t in r.head.terms if isinstance(t, Var) and t.name not in bound]
    return found + [f"relation {name} is never derived" for name in declared if name not in {r.head.relation for r in rules}]


def _named(df: DataFrame, atom: Atom) -> DataFrame:
    """The relation's rows that fit an atom, as columns by variable."""
    cols = df.columns
    if len(cols) != len(atom.terms):
        raise DatalogError(f"{atom.relation} has {len(cols)} terms, not {len(atom.terms)}")
    seen: dict[str, str] = {}
    for c, t in zip(cols, atom.terms):
        if isinstance(t, Var):
            if t.name in seen:
                df = df.where(F.col(c) == F.col(seen[t.name]))
            else:
                seen[t.name] = c
        elif t is not None:
            df = df.where(F.col(c) == F.lit(t))
    return df.select(*[F.col(c).alias(v) for v, c in seen.items()], *([] if seen else [F.lit(1).alias("__any")])).distinct()


def _value(t) -> Column:
    return F.col(t.name) if isinstance(t, Var) else F.lit(t)


def _guard(g: Guard | Either) -> Column:
    if isinstance(g, Either):
        return reduce(Column.__or__, [reduce(Column.__and__, map(_guard, way)) for way in g.ways])
    left = _value(g.left)
    if g.test in _TESTS:
        return getattr(left, _TESTS[g.test])(_value(g.right))
    name, no = g.test.lstrip("!"), g.test.startswith("!")
    tests = {"is_empty": lambda: left == "", "starts_with": lambda: left.startswith(_value(g.right)), "ends_with": lambda: left.endswith(_value(g.right)), "contains": lambda: left.contains(_value(g.right))}
    if name not in tests:
        raise DatalogError(f"unknown guard {name}")
    return ~tests[name]() if no else tests[name]()


def _body(rule: Rule, relations: dict[str, DataFrame], swap: int = -1, delta: DataFrame | None = None, spark=None) -> DataFrame:
    """A rule's head tuples; the clause at ``swap`` reads ``delta`` instead of its relation. A rule without a body is a fact."""
    if not rule.body and spark is not None:
        return spark.range(1).select(*[F.lit(t).alias(f"c{i}") for i, t in enumerate(rule.head.terms)])
    now: DataFrame | None = None
    guards, late = [], []
    for i, c in enumerate(rule.body):
        if isinstance(c, Guard | Either):
            guards.append(c)
        elif isinstance(c, Count) or c.negated:
            late.append(c)
        else:
            new = _named(delta if i == swap else relations[c.relation], c)
            if now is None:
                now = new
                continue
            on = [v for v in new.columns if v in now.columns]
            if not on:
                raise DatalogError(f"{c.relation} shares no variable with what stands before it in {rule.head.relation}")
            now = now.join(new, on)
    if now is None:
        raise DatalogError(f"{rule.head.relation} reads no relation")
    for c in sorted(late, key=lambda c: isinstance(c, Atom)):
        atom = c.atom if isinstance(c, Count) else c
        if isinstance(c, Count):
            by = [t.name for t in atom.terms if isinstance(t, Var) and t.name in now.columns]
            # Every place counts: a tuple is a tuple even where the rule doesn't name it.
            full = relations[atom.relation].distinct()
            renamed = full.select(*[F.col(x).alias(t.name if isinstance(t, Var) and t.name in now.columns else f"__{i}") for i, (x, t) in enumerate(zip(full.columns, atom.terms))])
            for i, t in enumerate(atom.terms):
                if t is not None and not isinstance(t, Var):
                    renamed = renamed.where(F.col(f"__{i}") == F.lit(t))
            counted = renamed.groupBy(*by).agg(F.count("*").alias(c.var))
            now = now.join(counted, by) if by else now.join(counted, F.lit(True))
        else:
            new = _named(relations[atom.relation], atom)
            on = [v for v in new.columns if v in now.columns]
            if on:
                now = now.join(new.select(*on), on, "left_anti")
            elif not new.isEmpty():
                now = now.where(F.lit(False))
    for g in guards:
        now = now.where(_guard(g))
    return now.select(*[_value(t).alias(f"c{i}") for i, t in enumerate(rule.head.terms)]).distinct()


def evaluate(text: str, base: dict[str, DataFrame], scratch: Scratch, max_rounds: int = 0) -> dict[str, DataFrame]:
    """All derived relations of a program over base relations; columns of derived ones are c0, c1 and so on.

    More than ``max_rounds`` rounds of recursion are an error, where it isn't 0.
    """
    _, rules = parse(text)
    relations = dict(base)
    for group in strata(rules):
        own = [r for r in rules if r.head.relation in group]
        recursive = {h for h in group if any(name in group for r in own if r.head.relation == h for name, _ in _reads(r))}
        union = lambda parts: reduce(DataFrame.union, parts).distinct()
        for h in [h for h in group if h not in recursive]:
            relations[h] = union([_body(r, relations, spark=scratch.spark) for r in own if r.head.relation == h])
        if not recursive:
            continue
        facts, fresh = {}, {}
        for h in recursive:
            start = [_body(r, relations, spark=scratch.spark) for r in own if r.head.relation == h and not any(name in recursive for name, _ in _reads(r))]
            if start:
                facts[h] = fresh[h] = scratch.stage(union(start))
        if not facts:
            raise DatalogError(f"{', '.join(group)}: no rule to start from")
        rounds = 0
        while True:
            rounds += 1
            if rounds > max_rounds > 0:
                raise DatalogError(f"no fixpoint in {max_rounds} rounds")
            step: dict[str, list[DataFrame]] = {}
            for r in own:
                for i, c in enumerate(r.body):
                    ready = all(name in facts or name not in recursive for name, _ in _reads(r))
                    if isinstance(c, Atom) and not c.negated and c.relation in fresh and ready:
                        step.setdefault(r.head.relation, []).append(_body(r, relations | facts, i, fresh[c.relation]))
            fresh = {}
            for h, parts in step.items():
                new = union(parts)
                new = scratch.stage(new.join(facts[h], facts[h].columns, "left_anti") if h in facts else new)
                if not new.isEmpty():
                    fresh[h] = new
            if not fresh:
                break
            for h, new in fresh.items():
                facts[h] = facts[h].unionByName(new) if h in facts else new
                if rounds % MERGE == 0:
                    facts[h] = scratch.stage(facts[h])
        some = next(iter(facts.values()))
        for h in recursive - facts.keys():  # nothing was derived
            arity = next(len(r.head.terms) for r in own if r.head.relation == h)
            facts[h] = some.sparkSession.createDataFrame([], ", ".join(f"c{i} string" for i in range(arity)))
        relations |= facts
    return {h: relations[h] for h in {r.head.relation for r in rules}}
