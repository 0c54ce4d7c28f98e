"""Reports over pools and reading sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.basics import filled
from inkwell.sources.views import AS_OF, DAY


def pool_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Articles, distinct domains and distinct bylines, in all or per group."""
    measures = [F.count("*").alias("articles"), F.countDistinct("domain").alias("domains"), F.countDistinct(filled(F.col("author_key"))).alias("authors")]
    return rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)


def top_pairs(rows: DataFrame, limit: int = 30) -> DataFrame:
    return rows.groupBy("domain", "topic").agg(F.count("*").alias("articles")).orderBy(F.col("articles").desc(), "domain", "topic").limit(limit)


def first_rows(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of an order with their place, from 1 on; numbered after the cut."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def crawl_summary(articles: DataFrame, min_words: int = 250) -> DataFrame:
    """(articles, enriched, failed, avg_quality, with_math): one row about a crawl's articles (word_count, quality, content_html)."""
    long = F.col("word_count") >= min_words
    return articles.agg(F.count("*").alias("articles"), F.count_if(long).alias("enriched"), F.count_if(F.col("word_count") == -1).alias("failed"), F.round(F.avg(F.when(long, F.col("quality"))), 9).alias("avg_quality"), F.count_if(F.col("content_html").like("%nc-math%")).alias("with_math"))


def output_by_source(sources: DataFrame, articles: DataFrame, min_words: int = 250, limit: int = 15) -> DataFrame:
    """The sources whose articles were enriched most: (source_id, name, topic, discovered, enriched, place)."""
    counts = articles.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("word_count") >= min_words).alias("enriched"))
    rows = counts.join(sources.select(F.col("id").alias("source_id"), "name", "topic"), "source_id")
    return first_rows(rows, limit, F.col("enriched").desc(), F.col("discovered").desc(), F.col("source_id"))


def source_list(sources: DataFrame, articles: DataFrame, eligible: DataFrame) -> DataFrame:
    """Every source with its articles and its eligible ones, those without any included."""
    counts = articles.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("articles"))
    fit = eligible.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("eligible"))
    joined = sources.join(counts, "id", "left").join(fit, "id", "left")
    return joined.select("id", "name", "origin", "status", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("eligible", F.lit(0)).alias("eligible"))


def age_histogram(rows: DataFrame, now: int = AS_OF) -> DataFrame:
    """(bucket, articles, share) of the articles' ages in days."""
    days = (F.lit(now) - F.col("effective")) / float(DAY)
    bucket = F.when(days <= 7, "0-7").when(days <= 30, "8-30").when(days <= 90, "31-90").when(days <= 180, "91-180").otherwise("181-")
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("articles"))
    return counts.withColumn("share", F.round(F.col("articles") / F.sum("articles").over(Window.partitionBy(F.lit(0))), 9))


def concentration(rows: DataFrame, many: int = 5) -> DataFrame:
    """(sources, total, top_source, top_share, heavy): how much of a window one publication holds."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("m"), F.col("domain").alias("d")))
    out = counts.agg(F.count("*").alias("sources"), F.sum("n").alias("total"), first.alias("f"), F.count_if(F.col("n") >= many).alias("heavy"))
    return out.select("sources", "total", F.col("f.d").alias("top_source"), F.round(-F.col("f.m") / F.col("total"), 9).alias("top_share"), "heavy")


def adjacent_repeats(rows: DataFrame, by: str, position: str = "position") -> DataFrame:
    """Cards of a sequence that share the domain or the voice of the card before, per sequence."""
    order = Window.partitionBy(by).orderBy(position)
    marked = rows.select(by, (F.col("domain") == F.lag("domain").over(order)).alias("d"), (F.col("voice") == F.lag("voice").over(order)).alias("v"))
    return marked.groupBy(by).agg(F.count_if("d").alias("domain_repeats"), F.count_if("v").alias("voice_repeats"))


def gaps(rows: DataFrame, by: str, position: str = "position") -> DataFrame:
    """Least gap of a domain, first repeat of a voice and topic repeats within 12 cards, per sequence."""

    def gap(key: str):
        return F.col(position) - F.lag(position).over(Window.partitionBy(by, key).orderBy(position))

    marked = rows.withColumn("dg", gap("domain")).withColumn("vg", gap("voice")).withColumn("tg", gap("topic"))
    return marked.groupBy(by).agg(F.min("dg").alias("min_domain_gap"), F.min(F.when(F.col("vg").isNotNull(), F.col(position))).alias("first_voice_repeat"), F.count_if(F.col("tg") < 12).alias("topic_repeats"))


def prefix_imbalance(rows: DataFrame, by: str, topics: list[str], position: str = "position") -> DataFrame:
    """Greatest difference between two topics' counts over all prefixes of a sequence, per sequence."""
    upto = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.sum((F.col("topic") == t).cast("int")).over(upto).alias(f"t{i}") for i, t in enumerate(topics)]
    running = rows.select(by, *counts)
    names = [F.col(f"t{i}") for i in range(len(topics))]
    return running.groupBy(by).agg(F.max(F.greatest(*names) - F.least(*names)).alias("imbalance"))


def nearest_rank(rows: DataFrame, value: str, *shares: float) -> DataFrame:
    """(share, value): the value at place floor(n * share) of the sorted values, for whole numbers.

    Values are counted first, so only distinct values are sorted.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("value"))).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(0))))
    places = upto.select("value", "upto", "n", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    return places.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("share")))).groupBy("share").agg(F.min("value").alias("value"))
