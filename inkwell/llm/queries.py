"""Registry of this subpackage: a query for each operator, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.embeddings import near_vectors
from inkwell.llm.html import extract_pages
from inkwell.llm.licenses import scan_licenses
from inkwell.llm.linededup import dedup_lines
from inkwell.llm.mixing import mix_sources
from inkwell.llm.quality import quality_rules
from inkwell.llm.sentencepiece import encode_documents
from inkwell.llm.sharding import shard_documents
from inkwell.llm.simhash import near_duplicates
from inkwell.llm.tokencount import count_edited


#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("INKWELL_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is counted, then edited in three places that its length fixes: replaced, inserted, deleted."""
    n, text = F.length("text"), F.col("text")

    def edit(at, drop, add):
        return F.struct(at.cast("int").alias("at"), F.lit(drop).alias("drop"), add.alias("add"))

    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = F.array(edit(third, 12, F.substring(text, half.cast("int") + 1, F.lit(20))), edit(third * 2, 0, F.concat(F.lit(" "), F.reverse(F.substring(text, third.cast("int") + 1, F.lit(30))))), edit(F.lit(0), 5, F.lit("")))
    docs = _table(spark, sf_dir, "documents").withColumn("edits", F.when(text.isNotNull(), edits))
    return count_edited(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per licence text found in a document."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text after dedup, its lines and how many of them went."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sentencepiece, op2_simhash_dedup, op3_quality_bands, op4_html_extraction, op5_edit_token_counts, op6_jump_sharding, op7_license_scan, op8_embedding_dedup, op9_line_dedup, op10_source_mix]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from inkwell.llm.oracles import ORACLES

    return dict(ORACLES)
