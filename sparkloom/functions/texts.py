"""Text functions of session and report operators, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Error classes by the text that gives them away, in the order they are tried.
ERRORS = (("exit code", "Command failure"), ("not found", "File not found"), ("permission", "Permission error"), ("timeout", "Timeout"), ("syntax", "Syntax error"), ("import", "Import error"))
#: Phrases of corrections by family, in the order they are tried.
CORRECTIONS = {
    "apology": ("i apologize", "i'm sorry", "sorry about", "my apologies"),
    "mistake": ("i made a mistake", "i was wrong", "that was incorrect", "my mistake"),
    "let_me_fix": ("let me fix", "i'll fix", "let me correct"),
    "actually": ("actually,", "actually i", "actually that"),
}
#: Programs by the category of their commands.
PROGRAMS = {
    "build": ("make", "cmake", "ninja", "tsc", "webpack", "vite", "esbuild", "rollup", "parcel"),
    "test": ("pytest", "jest", "vitest", "mocha", "rspec", "phpunit"),
    "lint": ("eslint", "prettier", "ruff", "black", "flake8", "mypy", "pylint", "rubocop", "biome", "oxlint"),
    "search": ("find", "grep", "rg", "ag", "fd", "ls", "cat", "head", "tail", "wc", "file", "stat", "tree", "less"),
}
_JS, _PACKAGES = ("npm", "npx", "yarn", "pnpm"), ("apt", "apt-get", "brew", "dnf", "pacman", "nix")
#: Prices a million tokens (input, output, cache write, cache read) by what a model's name contains; the first that fits.
PRICES = (
    (("opus", "4-5"), (5.0, 25.0, 6.25, 0.5)), (("opus", "4.5"), (5.0, 25.0, 6.25, 0.5)), (("opus", "4-6"), (5.0, 25.0, 6.25, 0.5)), (("opus", "4.6"), (5.0, 25.0, 6.25, 0.5)), (("opus",), (15.0, 75.0, 18.75, 1.5)),
    (("sonnet",), (3.0, 15.0, 3.75, 0.3)),
    (("haiku", "4-5"), (1.0, 5.0, 1.25, 0.1)), (("haiku", "4.5"), (1.0, 5.0, 1.25, 0.1)), (("haiku", "3-5"), (0.8, 4.0, 1.0, 0.08)), (("haiku", "3.5"), (0.8, 4.0, 1.0, 0.08)), (("haiku",), (0.25, 1.25, 0.3, 0.03)),
)
_BARS = "▁▂▃▄▅▆▇█"


def _ladder(cases: list[tuple[Column, Column]], last: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), last)


def error_class(message: Column) -> Column:
    """The first class whose text the message contains, without case; else Other."""
    low = F.lower(message)
    return _ladder([(low.contains(part), F.lit(name)) for part, name in ERRORS], F.lit("Other"))


def correction(text: Column, length: int = 80) -> Column:
    """(kind, excerpt) of the first family with a phrase in the text, from there on; null without one."""
    low = F.lower(text)
    cases = [(low.contains(p), F.struct(F.lit(kind).alias("kind"), F.substr(text, F.locate(p, low), F.lit(length)).alias("excerpt"))) for kind, phrases in CORRECTIONS.items() for p in phrases]
    return _ladder(cases, F.lit(None))


def split_commands(line: Column) -> Column:
    """The commands of a shell line, split at ; && and ||, trimmed, without empty ones and comments."""
    return F.filter(F.transform(F.split(line, r";|&&|\|\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.startswith("#"))


def command_class(command: Column) -> Column:
    """(category, pattern) of one command: by its program, and for some by the word after it; leading VAR=value words don't count."""
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: w != "")
    first = F.array_position(F.transform(words, lambda w: w.contains("=") & ~w.startswith("-")), False)
    rest = F.when(first > 0, F.slice(words, first.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))
    base = F.substring_index(F.get(rest, F.lit(0)), "/", -1)
    sub, third = F.coalesce(F.get(rest, F.lit(1)), F.lit("")), F.coalesce(F.get(rest, F.lit(2)), F.lit("?"))
    pair = lambda category, *pattern: F.struct(F.lit(category).alias("category"), F.concat(*pattern).alias("pattern"))
    both = (base, F.lit(" "), sub)
    script = (base, F.lit(" run "))
    cargo, js = base == "cargo", base.isin(*_JS)
    cases = [
        (F.size(rest) == 0, pair("other", F.trim(command))),
        (cargo & sub.isin("build", "b"), pair("build", F.lit("cargo build"))), (cargo & sub.isin("test", "t", "nextest"), pair("test", F.lit("cargo test"))),
        (cargo & sub.isin("clippy", "fmt"), pair("lint", *both)), (cargo & sub.isin("add", "install"), pair("install", *both)), (cargo, pair("build", *both)),
        (js & (sub == "run") & third.contains("build"), pair("build", *script, F.lit("build"))), (js & (sub == "run") & third.contains("test"), pair("test", *script, F.lit("test"))),
        (js & (sub == "run") & third.contains("lint"), pair("lint", *script, F.lit("lint"))), (js & (sub == "run") & third.rlike("format|fmt"), pair("lint", *script, third)), (js & (sub == "run"), pair("other", *script, third)),
        (js & sub.isin("build", "test"), F.struct(sub.alias("category"), F.concat(*both).alias("pattern"))), (js & sub.isin("install", "i", "add", "ci"), pair("install", base, F.lit(" install"))), (js, pair("other", *both)),
        *[(base.isin(*programs), pair(category, base)) for category, programs in PROGRAMS.items()],
        ((base == "go") & (sub == "test"), pair("test", F.lit("go test"))), ((base == "ruby") & sub.isin("-e", "test"), pair("test", F.lit("ruby test"))),
        (base.isin("git", "gh"), pair("git", base, F.lit(" "), F.when(sub == "", "git").otherwise(sub))),
        (base.isin("pip", "pip3") & (sub == "install"), pair("install", F.lit("pip install"))), (base.isin(*_PACKAGES), pair("install", *both)),
    ]
    return _ladder(cases, pair("other", base))


def price(model: Column) -> Column:
    """(input, output, cache_write, cache_read) a million tokens of a model; null if its family isn't known."""
    low = F.lower(model)
    cases = [(reduce(Column.__and__, [low.contains(p) for p in parts]), F.struct(*[F.lit(x).alias(n) for x, n in zip(rates, ("input", "output", "cache_write", "cache_read"))])) for parts, rates in PRICES]
    return _ladder(cases, F.lit(None))


def for_ngrams(text: Column) -> Column:
    """Letters, digits and apostrophes in lower case, everything else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nl}0-9']+", " "))


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def meaningful(text: Column) -> Column:
    """How many letters and digits a text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def loose(text: Column) -> Column:
    """Lower case with - . _ as spaces."""
    return F.translate(F.lower(text), "-._", "   ")


def truncated(text: Column, width: int) -> Column:
    """A path's last ``width`` characters, with dots for what is cut."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(width - 3))))


def repo_name(path: Column) -> Column:
    """The last part of a path or address, without slashes at the end and .git."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), r"\.git$", "")


def canonical(name: Column) -> Column:
    """A name's words in lower case by spaces: camel, snake and kebab, letters from digits, without the endings type, info, data and the like."""
    apart = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    words = F.trim(F.regexp_replace(F.lower(apart), r"[\s_\-]+", " "))
    return F.regexp_replace(words, r"(?<=\w)(?: (?:type|info|data|struct|impl|dto|model|entity))+$", "")


def sparkline(values: Column) -> Column:
    """An array of numbers as bars of eight heights against its largest; all lowest if that is 0."""
    top = F.array_max(values)
    level = lambda v: F.when(top > 0, F.floor(v * 7 / top)).otherwise(0).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substr(F.lit(_BARS), level(v) + 1, F.lit(1))), "")


def progress_bar(share: Column, width: int = 20) -> Column:
    """A share of 0 to 1 as a bar of # and -."""
    n = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n))


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def fill(template: Column, captures: dict[str, Column]) -> Column:
    """A template with $name replaced by a capture's text; longer names first, names without a capture stay."""
    return reduce(lambda out, name: F.replace(out, F.lit("$" + name), F.coalesce(captures[name], F.lit(""))), sorted(captures, key=lambda n: (-len(n), n)), template)


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def common_prefix(paths: Column) -> Column:
    """The folders that all paths of an array have in common, with a slash at the end; empty if there are none."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    n = F.least(F.size(low), F.size(high)) - 1
    pairs = F.zip_with(F.slice(low, 1, F.greatest(n, F.lit(0))), F.slice(high, 1, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), (a == b).alias("same")))
    zero = F.struct(F.lit("").alias("path"), F.lit(True).alias("on"))
    out = F.aggregate(pairs, zero, lambda acc, p: F.struct(F.when(acc["on"] & p["same"], F.concat(acc["path"], p["a"], F.lit("/"))).otherwise(acc["path"]).alias("path"), (acc["on"] & p["same"]).alias("on")))
    return out["path"]


def unwrap_lines(text: Column) -> Column:
    """Hard-wrapped lines joined by spaces; blank lines still part paragraphs."""
    return F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")


def unit_id_ok(name: Column) -> Column:
    """Whether a unit's id is one: small letters, digits and dashes, no dash first."""
    return name.rlike("^[a-z0-9][a-z0-9-]*$")
