"""Exports of other tools as tables: version control logs, chat logs of several formats, knowledge units, context blocks, file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.functions.globs import any_glob

#: What a log is printed with, one commit after the other: git log --numstat --format='%x01%H%x02%at%x02%ae%x02%s'.
LOG_FORMAT = "%x01%H%x02%at%x02%ae%x02%s"


def git_log(rows: DataFrame, text: str = "value") -> DataFrame:
    """(commit, ts, author, subject, path, added, removed) of printed logs; a commit without files has one row without a path, a binary file no counts."""
    each = rows.select(F.explode(F.slice(F.split(text, "\x01"), 2, 1 << 30)).alias("c"))
    lines = each.select(F.split("c", "\n").alias("l")).select(F.split(F.col("l")[0], "\x02").alias("h"), F.filter(F.slice("l", 2, 1 << 30), lambda x: x != "").alias("files"))
    out = lines.select("h", F.explode_outer("files").alias("f")).select("h", F.split("f", "\t").alias("f"))
    count = lambda i: F.when(F.get("f", F.lit(i)) != "-", F.get("f", F.lit(i)).cast("long"))
    return out.select(F.col("h")[0].alias("commit"), F.col("h")[1].cast("long").alias("ts"), F.lower(F.col("h")[2]).alias("author"), F.get("h", F.lit(3)).alias("subject"), F.get("f", F.lit(2)).alias("path"), count(0).alias("added"), count(1).alias("removed"))


def churn(log: DataFrame) -> DataFrame:
    """(path, commits, churn) of a log."""
    return log.where("path is not null").groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))).alias("churn"))


def shortlog(log: DataFrame) -> DataFrame:
    """(author, commits) of a log."""
    return log.groupBy("author").agg(F.countDistinct("commit").alias("commits"))


def git_blame(rows: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, line, commit, author) of git blame --line-porcelain texts."""
    entry = F.regexp_extract_all(text, F.lit(r"(?m)^([0-9a-f]{40} \d+ \d+[^\n]*\n(?:[^\t\n][^\n]*\n)*\t[^\n]*)"), F.lit(1))
    each = rows.select(path, F.explode(entry).alias("e"))
    return each.select(path, F.regexp_extract("e", r"^[0-9a-f]{40} \d+ (\d+)", 1).cast("int").alias("line"), F.regexp_extract("e", "^([0-9a-f]{40})", 1).alias("commit"), F.regexp_extract("e", r"(?m)^author-mail <([^>]*)>", 1).alias("author"))


_BLOCK = "type string, text string, id string, name string, input string, tool_use_id string, content string, is_error boolean"
_USAGE = "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long"


def detect_format(first: Column) -> Column:
    """The format of a chat log by how its text starts: rollout lines, message lines, an array of messages, or chat lines; null for none."""
    t = F.ltrim(first)
    return (
        F.when(t.rlike(r'^\{"timestamp":[^\n]*"payload":'), "rollout").when(t.rlike(r'^\{[^\n]*"message":\s*\{'), "message_lines").when(t.rlike(r'(?s)^\[\s*\{.{0,200}"role"'), "message_array")
        .when(t.rlike(r'^\{[^\n]*"content":\s*\['), "chat_lines").when(t.rlike(r'(?s)^\{.{0,400}"messages":\s*\['), "history")
    )


def _blocks(rows: DataFrame, message: Column, order: Column) -> DataFrame:
    each = rows.select("session", order.alias("turn"), message["role"].alias("role"), F.posexplode_outer(message["content"]).alias("block", "b"))
    return each.select("session", "turn", "role", "block", F.col("b.type").alias("type"), F.col("b.text").alias("text"), F.coalesce("b.id", "b.tool_use_id").alias("tool_id"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def chat_blocks(files: DataFrame, session: str = "path", text: str = "value") -> DataFrame:
    """(session, turn, role, block, type, text, tool_id, tool, input, is_error): the blocks of chat logs of every format known.

    The format of each file is told from its start; files of none give no rows, lines that can't be read none either.
    A content that is plain text is one block of type text.
    """
    known = files.select(F.col(session).alias("session"), F.col(text).alias("x"), detect_format(F.col(text)).alias("format")).where("format is not null")
    # Possessive: a text of any length is matched in a loop, without a stack frame for each character.
    plain = lambda c: F.regexp_replace(c, r'"content":\s*+("(?:[^"\\]++|\\.)*+")', r'"content":[{"type":"text","text":$1}]')
    message = f"role string, content array<struct<{_BLOCK}>>"
    lines = known.where("format in ('message_lines', 'rollout', 'chat_lines')").select("session", "format", F.posexplode(F.split("x", "\n")).alias("n", "line")).where("trim(line) <> ''")
    a = lines.where("format = 'message_lines'").withColumn("m", F.from_json(plain(F.col("line")), f"message struct<{message}>")["message"])
    b = lines.where("format = 'rollout'").withColumn("m", F.from_json(plain(F.col("line")), f"payload struct<{message}>")["payload"])
    c = lines.where("format = 'chat_lines'").withColumn("j", F.from_json(plain(F.col("line")), f"type string, content array<struct<{_BLOCK}>>"))
    c = c.withColumn("m", F.struct(F.col("j.type").alias("role"), F.col("j.content").alias("content")))
    whole = known.where("format in ('message_array', 'history')").withColumn("x", plain(F.col("x")))
    d = whole.withColumn("ms", F.when(F.col("format") == "history", F.from_json("x", f"messages array<struct<{message}>>")["messages"]).otherwise(F.from_json("x", f"array<struct<{message}>>")))
    d = d.select("session", F.posexplode("ms").alias("n", "m"))
    parts = [_blocks(p.where("m.role is not null"), F.col("m"), F.col("n")) for p in (a, b, c, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def usage(files: DataFrame, session: str = "path", text: str = "value") -> DataFrame:
    """(session, turn, model, input, output, cache_read, cache_create) of logs of message lines."""
    lines = files.select(F.col(session).alias("session"), F.posexplode(F.split(text, "\n")).alias("turn", "line"))
    m = lines.select("session", "turn", F.from_json("line", f"message struct<model string, usage struct<{_USAGE}>>")["message"].alias("m")).where("m.usage is not null")
    return m.select("session", "turn", F.col("m.model").alias("model"), *[F.coalesce(F.col(f"m.usage.{f}"), F.lit(0)).alias(n) for f, n in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_input_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_create"))])


def units(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(id, front, links, body) of knowledge units: the file's stem, its front matter, the [[kind:to]] and [[to]] links of its body."""
    front = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = F.col(text).rlike(front)
    body = F.when(has, F.regexp_extract(text, front, 2)).otherwise(F.col(text))
    links = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.struct(F.when(x.contains(":"), F.substring_index(x, ":", 1)).otherwise("link").alias("kind"), F.substring_index(x, ":", -1).alias("to")))
    return files.select(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "").alias("id"), F.when(has, F.regexp_extract(text, front, 1)).alias("front"), links.alias("links"), body.alias("body"))


def context_blocks(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, no, keys, body): the blocks of a context file, each under front matter of its own as a map of its plain keys; a text without any is one block."""
    marked = F.when(F.col(text).startswith("---\n"), F.col(text)).otherwise(F.concat(F.lit("---\n---\n"), F.col(text)))
    parts = F.split(marked, r"(?m)^---[ \t]*\n")
    each = files.select(path, parts.alias("p")).select(path, F.explode(F.sequence(F.lit(1), F.size("p") - 1, F.lit(2))).alias("i"), "p")
    line = F.filter(F.transform(F.split(F.col("p")[F.col("i")], "\n"), lambda x: F.regexp_extract(x, r"^([\w.-]+):\s*(.+?)\s*$", 0)), lambda x: x != "")
    keys = F.map_from_entries(F.transform(line, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[\w.-]+:", "")))))
    return each.select(path, ((F.col("i") - 1) / 2).cast("int").alias("no"), keys.alias("keys"), F.regexp_replace(F.get("p", F.col("i") + 1), r"^\s+|\s+$", "").alias("body"))


def block_matches(keys: Column, caller: dict[str, str]) -> Column:
    """Whether every key of a block that the caller has, has the caller's value; keys that the caller lacks don't matter."""
    out = F.lit(True)
    for k, v in caller.items():
        out = out & F.coalesce(keys[k] == v, F.lit(True))
    return out


def context_for(blocks: DataFrame, folder: str, caller: dict[str, str], path: str = "path") -> DataFrame:
    """The matching blocks of the files in a folder and those above it, the farthest first."""
    above = F.regexp_replace(path, "[^/]*$", "")
    here = blocks.where(F.lit(folder.rstrip("/") + "/").startswith(above) & block_matches(F.col("keys"), caller))
    return here.withColumn("level", F.length(above)).orderBy("level", path, "no").drop("level")


def walk(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), pattern: str = "*") -> DataFrame:
    """(path, size, mtime, lines): the files of a tree but for those that an ignore glob takes; paths are from the root.

    Spark's readers pass over files without a byte, so those have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    cut = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    body = F.decode("content", "ISO-8859-1")
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + F.when((F.length(body) > 0) & ~body.endswith("\n"), 1).otherwise(0)
    out = files.select(cut.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), lines.cast("long").alias("lines"))
    return out.where(~any_glob(F.col("path"), ignore)) if ignore else out


def help_entries(rows: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, no, section, short, long, value, description): the options and commands of printed help texts, under the heading above each."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no")
    head = F.when(F.col("line").rlike(r"^[A-Za-z][\w ]*:\s*$"), F.regexp_replace("line", r":\s*$", ""))
    marked = lines.withColumn("section", F.last(head, True).over(w))
    option = F.regexp_extract("line", r"^\s+(?:(-\w)(?:,\s*)?)?(--[\w-]+)?(?:[ =]([<\[][^>\]]+[>\]]))?\s*(?:\s{2,}(.*))?$", 0) != ""
    part = lambda i: F.nullif(F.regexp_extract("line", r"^\s+(?:(-\w)(?:,\s*)?)?(--[\w-]+)?(?:[ =]([<\[][^>\]]+[>\]]))?\s*(?:\s{2,}(.*))?$", i), F.lit(""))
    dashed = marked.where(F.col("line").rlike(r"^\s+-") & option).select(key, "no", "section", part(1).alias("short"), part(2).alias("long"), part(3).alias("value"), F.trim(part(4)).alias("description"))
    command = marked.where(F.col("line").rlike(r"^\s{2,}[a-z][\w-]*\s{2,}\S")).select(key, "no", "section", F.lit(None).cast("string").alias("short"), F.regexp_extract("line", r"^\s+([\w-]+)", 1).alias("long"), F.lit(None).cast("string").alias("value"), F.trim(F.regexp_extract("line", r"^\s+[\w-]+\s{2,}(.*)$", 1)).alias("description"))
    return dashed.unionByName(command)
