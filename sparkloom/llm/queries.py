"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, chat, ctph, langid, media, mixing, sharding, simhash, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1,
    "op2_sharding": sharding.op2,
    "op3_chat": chat.op3,
    "op4_ctph": ctph.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_mixing": mixing.op6,
    "op7_media": media.op7,
    "op8_langid": langid.op8,
    "op9_toxicity": toxicity.op9,
    "op10_simhash": simhash.op10,
}

#: DuckDB SQL of those that SQL expresses.
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE}
