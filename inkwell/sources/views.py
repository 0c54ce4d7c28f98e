"""Article-shaped views over the driver tables: what the ranking operators read in the product's own database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.basics import filled
from inkwell.functions.topics import TOPICS

#: "Now" of every query, in epoch milliseconds: 2024-02-01 UTC.
AS_OF = 1706745600000
DAY = 86_400_000
HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table is dealt out anew before costly work on its rows.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is at most SMALL bytes; a larger table is split where it is read and never shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def epoch_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without a time zone, whatever the session's."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at)


def pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def articles(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One article per document; the text itself only where a query scores it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    i = F.col("doc_id")
    dense = i % 5 < 2
    author = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("author-"), F.when(dense, i % 20).otherwise(20 + i % 2000).cast("string")))
    domain = F.when(i % 19 == 0, "").otherwise(F.concat(F.lit("publication-"), F.when(dense, i % 10).otherwise(10 + i % 1200).cast("string"), F.lit(".example")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(
        i.alias("id"),
        F.concat(F.lit("https://"), F.when(domain == "", F.lit("nowhere.example")).otherwise(domain), F.lit("/post/"), i.cast("string")).alias("url"),
        F.array_join(F.slice(F.split(F.substring("text", 1, 400), r"[\x20\x09-\x0D]+", -1), 1, 8), " ").alias("title"),
        F.when(i % 7 == 3, None).otherwise(F.substring("source", 4, 9).cast("long")).alias("source_id"),
        pick(TOPICS, i).alias("topic"),
        author.alias("author_key"),
        domain.alias("site_domain"),
        F.when(i % 23 != 0, F.lit(AS_OF) - (i % 75) * DAY).alias("published_date"),
        (F.lit(AS_OF) - (i % 30) * HOUR).alias("fetched_at"),
        (F.lit(0.35) + (i % 55) / 100.0).alias("topic_relevance"),
        (F.lit(0.45) + (i % 40) / 100.0).alias("quality"),
        (F.lit(0.5) + (i % 45) / 100.0).alias("score"),
        words.alias("word_count"),
        (i % 11 == 0).cast("int").alias("is_read"),
        (i % 17 == 0).cast("int").alias("is_archived"),
        (i % 29 == 0).cast("int").alias("is_bookmarked"),
        F.when(i % 11 == 0, F.lit(AS_OF) - (i % 60) * DAY).alias("read_at"),
        *([F.col("text").alias("text_content")] if text else []),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per source of the documents, and two without articles."""
    n = F.substring("source", 4, 9).cast("long")
    found = table(spark, sf_dir, "documents").select(n.alias("id")).distinct().union(spark.range(9001, 9003).toDF("id"))
    i = F.col("id")
    return found.select(
        i,
        F.concat(F.lit("Source "), i.cast("string")).alias("name"),
        F.concat(F.lit("https://feed"), i.cast("string"), F.lit(".example/rss")).alias("feed_url"),
        F.concat(F.lit("https://feed"), i.cast("string"), F.lit(".example")).alias("site_url"),
        pick(TOPICS, i).alias("topic"),
        pick(["seed", "hn", "aggregator", "outbound"], i).alias("origin"),
        pick(["active", "failing", "active", "dead", "paused"], i).alias("status"),
        (F.lit(0.5) + (i % 30) / 100.0).alias("score"),
        (i % 9).cast("long").alias("consecutive_failures"),
        (F.lit(12.0) + i % 48).alias("avg_update_hours"),
        F.when(i % 6 != 0, F.lit(AS_OF) + (i % 5 - 2) * HOUR).alias("next_check_at"),
        F.when(i % 7 != 0, F.lit(AS_OF) - (i % 40) * HOUR).alias("last_fetched_at"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as (author_key, domain, article_id, at)."""
    ms = epoch_ms(F.col("ts"))
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select(
        "event_id", F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key"), F.concat(F.lit("publication-"), (F.col("event_id") % 10).cast("string"), F.lit(".example")).alias("domain"), (F.col("event_id") % 500).alias("article_id"), ms.alias("at")
    )


def muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id % 37 = 5").select(F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key")).distinct()


def domain_key() -> Column:
    """What stands for an article's publication."""
    return F.coalesce(filled(F.col("site_domain")), F.concat(F.lit("source:"), F.col("source_id").cast("string")), F.concat(F.lit("article:"), F.col("id").cast("string")))


def voice_key() -> Column:
    """What stands for an article's voice: its byline, else its publication."""
    return F.coalesce(filled(F.col("author_key")), domain_key())
