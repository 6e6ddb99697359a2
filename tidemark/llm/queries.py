"""The queries of this subpackage, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import audio_fingerprint, bpe_trie, chat_format, debruijn_dedup, lm_mixing, minhash, packing, quality, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_packing": packing.op2_packing,
    "op3_lm_score": lm_mixing.op3_lm_score,
    "op4_audio_fingerprint": audio_fingerprint.op4_audio_fingerprint,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_debruijn_dedup": debruijn_dedup.op6_debruijn_dedup,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_bpe": bpe_trie.op10_bpe,
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": minhash.OP1_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_debruijn_dedup": debruijn_dedup.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
}
