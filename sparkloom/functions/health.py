"""Scores by steps, grades, labels: the scalar parts of reports, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Steps of the health score, largest or least value first, with the score up to there; what is beyond gets the last.
COMPLEXITY = ((3, 1.0), (5, 0.9), (7, 0.8), (10, 0.7), (15, 0.5))
RISK = ((0.01, 1.0), (0.02, 0.9), (0.03, 0.8), (0.05, 0.7), (0.1, 0.5))
TESTS = ((0.3, 1.0), (0.2, 0.9), (0.1, 0.7), (0.05, 0.5))
CEREMONY = ((0.2, 1.0), (0.3, 0.9), (0.4, 0.8), (0.5, 0.7), (0.6, 0.5))
UNIQUE = ((0.95, 1.0), (0.9, 0.9), (0.8, 0.7), (0.7, 0.5))
LEAST = 0.3
#: Weights of the parts of the health score.
WEIGHTS = {"complexity": 0.15, "risk": 0.15, "file_size": 0.20, "tests": 0.20, "ceremony": 0.05, "duplicates": 0.15, "uniqueness": 0.10}
#: Names of functions whose risk counts less, and kinds of nodes by what they are.
MINOR = r"^(new|default|__init__|constructor|fmt|clone|drop|eq|hash|to_string|__repr__|__str__|toString)$"
GETTER = r"^(get|is|has|set)_?[A-Z_a-z]"
KINDS = {"branch": ("If", "IfExp", "Match", "match_case"), "loop": ("For", "While", "AsyncFor", "comprehension"), "call": ("Call", "Await"), "error": ("Try", "Raise", "ExceptHandler", "Assert"), "data": ("Assign", "AugAssign", "AnnAssign", "Dict", "List", "Set", "Tuple"), "exit": ("Return", "Yield")}


def steps(value: Column, ladder, down: bool = False) -> Column:
    """The score of the first step that a value doesn't exceed (with ``down``, doesn't fall below); LEAST beyond all."""
    return reduce(lambda rest, s: F.when(value >= s[0] if down else value <= s[0], F.lit(s[1])).otherwise(rest), reversed(ladder), F.lit(LEAST))


def file_size_score(massive: Column, very_large: Column) -> Column:
    return F.when(massive > 0, F.greatest(F.lit(LEAST), 0.5 - massive * 0.1)).when(very_large > 5, 0.5).when(very_large > 0, 0.7).otherwise(1.0)


def parts(complexity: Column, risk: Column, massive: Column, very_large: Column, tests: Column, ceremony: Column, duplicates: Column, unique: Column) -> dict[str, Column]:
    """The seven scores of the health report; a ratio that wasn't measured (null) is 0, uniqueness 1."""
    known = lambda c, default: F.coalesce(c, F.lit(default))
    return {
        "complexity": steps(complexity, COMPLEXITY), "risk": steps(known(risk, 0.0), RISK), "file_size": file_size_score(massive, very_large), "tests": steps(known(tests, 0.0), TESTS, True), "ceremony": steps(known(ceremony, 0.0), CEREMONY),
        "duplicates": 1 / (1 + known(duplicates, 0) / 10.0), "uniqueness": steps(known(unique, 1.0), UNIQUE, True),
    }


def total(scores: dict[str, Column]) -> Column:
    return sum((scores[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))


def minor(name: Column, lines: Column) -> Column:
    """Constructors, formatting and the like, and getters and setters of three lines or fewer."""
    return name.rlike(MINOR) | (name.rlike(GETTER) & (lines <= 3))


def node_class(kind: Column) -> Column:
    return reduce(lambda rest, item: F.when(kind.isin(*item[1]), F.lit(item[0])).otherwise(rest), KINDS.items(), F.lit("other"))


def gzip_ratio(text: Column) -> Column:
    """Compressed over plain bytes; 0 for an empty text."""
    import zlib

    import pandas as pd
    from pyspark.sql import types as T

    def each(s):
        def ratio(t):
            data = (t or "").encode("utf-8", "surrogatepass")
            return len(zlib.compress(data, 6)) / len(data) if data else 0.0

        return s.map(ratio)

    each.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, T.DoubleType())(text)


def captures_hold(captures: Column, tests: list[tuple]) -> Column:
    """Tests over a map of captures: ("eq?", name, value or @name), "not-eq?", "match?", "not-match?", ("any-of?", name, values ...); a test that can't be read is passed over."""
    out = F.lit(True)
    for test in tests:
        if len(test) < 3 or test[0] not in ("eq?", "not-eq?", "match?", "not-match?", "any-of?"):
            continue
        value = F.coalesce(captures[test[1]], F.lit(""))
        other = captures[test[2][1:]] if str(test[2]).startswith("@") else F.lit(test[2])
        one = {"eq?": lambda: value == other, "match?": lambda: value.rlike(test[2]), "any-of?": lambda: value.isin(*test[2:])}[test[0].replace("not-", "")]()
        out = out & (~one if test[0].startswith("not-") else one)
    return out
