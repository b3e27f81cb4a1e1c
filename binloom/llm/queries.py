"""The corpus operators as queries over the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup
from . import embedding_dedup as vectors
from . import suffix_dedup as repeats
from .bpe import encode_and_decode
from .common import table
from .embedding_dedup import embedding_dedup
from .filter_audit import SQL as AUDIT_SQL
from .filter_audit import audit_filters
from .html_extract import SQL as HTML_SQL
from .html_extract import extract_text
from .packing import pack_documents
from .quality import score_quality
from .simhash import simhash_dedup
from .spelling import SQL as SPELLING_SQL
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_counts import count_tokens
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def byte_bpe() -> str:
    """Where the public byte-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), byte_bpe())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_text=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = [
        op1_token_counts, op2_packing, op3_embedding_dedup, op4_bpe_round_trip, op5_quality_classifier, op6_chat_formatting, op7_suffix_dedup, op8_exact_dedup, op9_toxicity, op10_simhash_dedup,
        op11_html_extraction, op12_filter_audit, op13_spelling_variants,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": vectors.SQL, "op7_suffix_dedup": repeats.SQL, "op6_chat_formatting": chat.SQL, "op8_exact_dedup": exact_dedup.SQL,
        "op11_html_extraction": HTML_SQL, "op12_filter_audit": AUDIT_SQL, "op13_spelling_variants": SPELLING_SQL,
    }
