"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mix, SentencePiece encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, n_words, unused
from inkwell.llm.linededup import dedup_lines
from inkwell.llm.mixing import mix_sources
from inkwell.llm.quality import keep_good
from inkwell.llm.queries import TOKENIZERS
from inkwell.llm.sentencepiece import encode_documents
from inkwell.llm.shingles import near_texts
from inkwell.llm.simhash import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go; null and empty texts have no words and go too."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines with 50 words or more go, and documents of which nothing is left.

    n_chars follows a changed text. Null texts stay as they are; rows equal in id and text keep the same lines.
    """
    left = dedup_lines(docs, min_words=50).where((F.col("n_removed") == 0) | (n_words(F.col("text")) > 0))
    changed = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return changed.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts within 3 bits, or with 0.8 or more of their 5-word shingles in common, the least id stays.

    Null and empty texts are one group. Rows without an id come last in a group; rows equal in id and text stay together.
    """
    return one_of_each(docs, near_texts)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded half up: 0, 1 or 2 rows.

    Texts without words go. A row is known by its id, source and text: rows equal in all three share what they take.
    """
    id_, source, print_, n, copy = unused(docs, "_id", "_source", "_print", "_times", "_copy")
    shares = mix_sources(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = F.floor(F.col("_taken") / F.when(F.col("_size") > 0, F.col("_size")) + 0.5).cast("int")
    shares = shares.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("text_hash").alias(print_), times.alias(n)).where(F.col(n) > 0)
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & docs["source"].eqNullSafe(F.col(source)) & (F.xxhash64(docs["text"]) == F.col(print_))
    taken = docs.join(shares, same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; a null text has null ids, the empty text none."""
    return encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("source mix", mix),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the compression bands nor XXH64 nor the Viterbi search; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
