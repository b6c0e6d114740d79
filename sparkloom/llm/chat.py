"""Chat formatting: multi-party perspective rotation.

Every participant of a dialogue gets it rendered with their own turns as the assistant's and everyone else's as
turns of named users; the mask marks what the assistant says, the only text a model trained on it should learn.
Turns of the system role open no perspective and stay as they are.

A rendering is cut into parts of PART_TURNS turn numbers, each a row with its own mask, so that a dialogue of many
turn numbers never meets in one task (turns of one number, null ones included, stay together); the parts of a
perspective, in order, concatenate to the whole rendering. Turn markers inside a text or a name are broken by a
blank, so no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART_TURNS = 512
SYSTEM = "system"
#: The turn markers of the template.
_START, _END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<| im_start|>")), F.lit("<|im_end|>"), F.lit("<| im_end|>"))


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("user name="), speaker)
    return F.concat(F.lit(_START), F.when(role == "assistant", "assistant").when(role == "system", "system").otherwise(named), F.lit("\n"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, perspective, part, n_turns, n_masked, rendered, mask) for every participant and part of every dialogue.

    ``mask`` lists the character spans start-end that the assistant says, by comma. A null text is an empty turn; a
    null speaker is called ``unknown`` and takes part like others; a null turn number comes first. Equal turn
    numbers are ordered by speaker and text, repeated rows are repeated turns, and rows without a dialogue id form one.
    """
    rows = df.select(F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("t"), _safe(F.coalesce(F.col(speaker), F.lit("unknown"))).alias("s"), _safe(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    rows = rows.withColumn("part", F.floor(F.col("t") / part_turns).cast("long"))
    people = rows.where(F.col("s") != SYSTEM).select(F.col("c").alias("pc"), F.col("s").alias("perspective")).distinct()
    # One row a part of a dialogue; every perspective renders it on its own.
    parts = rows.groupBy("c", "part").agg(F.array_sort(F.collect_list(F.struct("t", "s", "x"))).alias("turns"))
    seen = parts.join(people, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")
    role = lambda u: F.when(u["s"] == F.col("perspective"), "assistant").when(u["s"] == SYSTEM, "system").otherwise("user")
    pieces = F.transform("turns", lambda u: F.struct(_head(role(u), u["s"]).alias("head"), u["x"].alias("x"), (role(u) == "assistant").alias("own")))
    step = lambda p: F.length(p["head"]) + F.length(p["x"]) + len(_END)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    walked = F.aggregate(
        "pieces",
        zero,
        lambda a, p: F.struct(
            (a["at"] + step(p)).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.concat((a["at"] + F.length(p["head"])).cast("string"), F.lit("-"), (a["at"] + F.length(p["head"]) + F.length(p["x"])).cast("string"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    out = seen.withColumn("pieces", pieces)
    return out.select(
        F.col("c").alias(conv), "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(p["own"], F.length(p["x"])).otherwise(0)).alias("n_masked"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["x"], F.lit(_END))), "").alias("rendered"),
        F.array_join(walked["spans"], ",").alias("mask"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """All conversations from every participant's perspective."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH r AS (SELECT conv_id c, coalesce(turn, -1) t, replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') s, replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') x, CAST(floor(coalesce(turn, -1) / 512) AS BIGINT) part FROM conversations),
people AS (SELECT DISTINCT c, s AS perspective FROM r WHERE s <> 'system'),
v AS (SELECT r.*, perspective, s = perspective own,
        '<|im_start|>' || CASE WHEN s = perspective THEN 'assistant' WHEN s = 'system' THEN 'system' ELSE 'user name=' || s END || chr(10) AS head
      FROM r JOIN people p ON r.c IS NOT DISTINCT FROM p.c),
w AS (SELECT *, length(head) + length(x) + 11 AS n, row_number() OVER o AS k, sum(length(head) + length(x) + 11) OVER o - (length(head) + length(x) + 11) AS pos
      FROM v WINDOW o AS (PARTITION BY c, perspective, part ORDER BY t, s, x ROWS UNBOUNDED PRECEDING))
SELECT c AS conv_id, perspective, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN length(x) ELSE 0 END) AS BIGINT) AS n_masked,
  string_agg(head || x || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(x) AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM w GROUP BY c, perspective, part
"""
