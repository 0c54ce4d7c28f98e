"""A reader's session: what was shown last, what to append, and how selections change the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import hn

# Cards remembered, cards per topic below which a refill is due, trust bounds by origin.
CONTEXT, LOW_WATER = 60, 12
MOST = {"seed": 0.58}
LEAST = {"hn": 0.50, "aggregator": 0.50}


def diversity_context(queue: DataFrame, articles: DataFrame, size: int = CONTEXT) -> DataFrame:
    """(position, id, ...): the last `size` queued cards in their order, or, with an empty queue, the last read ones."""
    last = queue.orderBy(F.col("position").desc()).limit(size).join(articles, "id")
    read = articles.where("is_read = 1 and read_at is not null").orderBy(F.col("read_at").desc(), F.col("id").desc()).limit(size)
    read = read.withColumn("position", F.row_number().over(Window.orderBy("read_at", "id")))
    names = [c for c in last.columns if c in read.columns]
    alone = read.withColumn("_k", F.lit(1)).join(queue.limit(1).select(F.lit(1).alias("_k")), "_k", "left_anti")
    return last.select(names).unionByName(alone.select(names))


def append_unseen(queue: DataFrame, fresh: DataFrame, most: int = 10 * CONTEXT) -> DataFrame:
    """(position, id): the queue with the fresh cards it doesn't hold behind it, each once, in their order.

    fresh is one window of cards; no more than `most` of them, ten windows, are appended at once.
    """
    new = fresh.groupBy("id").agg(F.min("position").alias("position")).join(queue.select("id"), "id", "left_anti")
    end = queue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_end")).withColumn("_k", F.lit(1))
    placed = new.orderBy("position").limit(most).withColumn("_n", F.row_number().over(Window.orderBy("position"))).withColumn("_k", F.lit(1)).join(end, "_k")
    return queue.select("position", "id").unionByName(placed.select((F.col("_end") + F.col("_n")).cast(queue.schema["position"].dataType).alias("position"), "id"))


def refill_due(eligible_by_topic: DataFrame, least: int = LOW_WATER) -> DataFrame:
    """(due): whether a topic has fewer eligible articles than a refill needs."""
    return eligible_by_topic.agg(F.coalesce(F.min("eligible") < least, F.lit(True)).alias("due"))


def diverse_openings(slates: DataFrame, by: str, opening: int = 12, topics: int = 3) -> DataFrame:
    """(by, diverse): whether a slate's first cards are of different voices and domains and its topics differ by one at most."""
    head = F.col("position") < opening
    counts = slates.groupBy(by, "topic").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("k"))
    first = slates.groupBy(by).agg(F.count_if(head).alias("cards"), F.countDistinct(F.when(head, F.col("domain"))).alias("domains"), F.countDistinct(F.when(head, F.col("voice"))).alias("voices"))
    even = F.col("most") - F.when(F.col("k") < topics, 0).otherwise(F.col("least")) <= 1
    return first.join(counts, by).select(by, ((F.col("cards") == opening) & (F.col("domains") == opening) & (F.col("voices") == opening) & even).alias("diverse"))


def select_topics(sources: DataFrame, topics: list[str]) -> DataFrame:
    """Sources after a choice of topics: paused ones of a chosen topic resume, live ones of others pause."""
    chosen = F.col("topic").isin(topics)
    status = F.when(chosen & (F.col("status") == "paused"), "active").when(~chosen & F.col("status").isin("active", "failing"), "paused").otherwise(F.col("status"))
    return sources.withColumn("status", status)


def archive_unselected(articles: DataFrame, topics: list[str]) -> DataFrame:
    """Articles after a choice of topics: unread, unbookmarked ones of other topics are archived."""
    out = ~F.col("topic").isin(topics) & (F.col("is_read") == 0) & (F.col("is_bookmarked") == 0)
    return articles.withColumn("is_archived", F.when(out, 1).otherwise(F.col("is_archived")))


def clamp_trust(sources: DataFrame) -> DataFrame:
    """Sources with their trust within the bounds of their origin."""
    score = F.col("score")
    for origin, x in MOST.items():
        score = F.when(F.col("origin") == origin, F.least(score, F.lit(x))).otherwise(score)
    for origin, x in LEAST.items():
        score = F.when(F.col("origin") == origin, F.greatest(score, F.lit(x))).otherwise(score)
    return sources.withColumn("score", score)


def seed_catalog(catalog: DataFrame, known: DataFrame, topics: list[str]) -> DataFrame:
    """Sources after seeding: the catalog's feeds of the topics that are new, and known ones among them brought back to life."""
    wanted = catalog.where(F.col("topic").isin(topics)).select("feed_url", F.col("name").alias("c_name"), F.col("topic").alias("c_topic"), F.coalesce("origin", F.lit("seed")).alias("c_origin")).dropDuplicates(["feed_url"])
    joined = known.join(wanted, "feed_url", "full")
    back = F.col("c_topic").isNotNull() & F.coalesce(F.col("status").isin("paused", "dead"), F.lit(False))
    status = F.when(back, "active").otherwise(F.coalesce("status", F.lit("active")))
    return joined.select("feed_url", F.coalesce("name", "c_name").alias("name"), *(F.when(back, F.col(f"c_{c}")).otherwise(F.coalesce(c, f"c_{c}")).alias(c) for c in ("topic", "origin")), status.alias("status"))


def probe_outcomes(evidence: DataFrame) -> DataFrame:
    """(domain, outcome) of probed sites, by the first rule that fits; errors take no slot.

    evidence: (domain, allowed, known, feed_url, entries, title, authors, duplicate, failed).
    """
    outcome = F.when(~F.col("allowed"), "blocked").when(F.col("known"), "known").when(F.col("failed"), "error").when(F.col("feed_url").isNull() | (F.col("entries") < 2), "no-feed")
    outcome = outcome.when(F.col("title").rlike(hn.NOT_BLOG), "blocked").when(F.col("authors") >= 4, "blocked").when(F.col("duplicate"), "known").otherwise("added")
    return evidence.select("domain", outcome.alias("outcome"), (outcome != "error").alias("takes_slot"))


def first_of_each_domain(entries: DataFrame, limit: int = 30) -> DataFrame:
    """The first entry of every domain in the order of position, `limit` at most, without its date."""
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("position"))).where("_n = 1").drop("_n")
    return first.orderBy("position").limit(limit).withColumn("published", F.lit(None).cast("long"))
