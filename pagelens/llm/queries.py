"""Queries of the operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import ORACLE_OP3, op3_chat_format
from .embeddings import ORACLE_OP5, op5_embedding_dedup
from .langid import op7_language_id
from .media import op6_media
from .minhash import ORACLE_OP4, op4_minhash_dedup
from .mixing import ORACLE_OP9, op9_mix_sources
from .packing import op8_packing
from .pii import op2_pii
from .sstable import op1_sstable_tokens
from .token_counts import op10_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sstable_tokens": op1_sstable_tokens,
    "op2_pii": op2_pii,
    "op3_chat_format": op3_chat_format,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_media": op6_media,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": ORACLE_OP3,
    "op4_minhash_dedup": ORACLE_OP4,
    "op5_embedding_dedup": ORACLE_OP5,
    "op9_mix_sources": ORACLE_OP9,
}
