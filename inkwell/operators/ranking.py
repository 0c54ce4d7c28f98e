"""Candidate ranking: eligibility, weighted random keys, identity round-robin, exposure cool-down, topic rescue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.basics import clamp, uniform
from inkwell.functions.topics import MIN_RELEVANCE, TOPICS
from inkwell.sources.views import AS_OF, DAY, domain_key, voice_key


@dataclass(frozen=True)
class Settings:
    """What a ranking run may vary; time and chance are parameters, so reruns agree."""

    now: int = AS_OF
    seed: str = "42"
    topics: tuple[str, ...] = tuple(TOPICS)
    min_words: int = 250
    min_relevance: float = MIN_RELEVANCE
    stale_days: int = 60
    half_life_days: float = 10.0
    seed_origin: str = "seed"
    discovery_boost: float = 1.25
    #: Cards of a window, for one topic and for more.
    window: dict = field(default_factory=lambda: {1: 60, 2: 36, 3: 36})


def keyed(articles: DataFrame) -> DataFrame:
    return articles.withColumn("domain", domain_key()).withColumn("voice", voice_key()).withColumn("effective", F.coalesce("published_date", "fetched_at"))


def servable(articles: DataFrame, muted: DataFrame, s: Settings) -> DataFrame:
    """Articles a reader may get: fresh, long and relevant enough, unread, on a selected topic and by nobody muted."""
    rows = keyed(articles).where((F.col("is_archived") == 0) & (F.col("is_read") == 0) & (F.col("word_count") >= s.min_words) & (F.col("topic_relevance") >= s.min_relevance) & F.col("topic").isin(*s.topics))
    rows = rows.where(F.col("effective") > s.now - s.stale_days * DAY)
    hidden = muted.where("author_key <> ''").select("author_key").distinct()
    return rows.join(hidden, "author_key", "left_anti")


def ranking_key(s: Settings) -> Column:
    """Quality, relevance, recency, trust and discovery, times a uniform number that seed and id fix."""
    age = F.greatest((F.lit(s.now) - F.col("effective")) / float(DAY), F.lit(-30.0))
    boost = F.when(F.col("source_origin").isNull() | (F.col("source_origin") != s.seed_origin), s.discovery_boost).otherwise(1.0)
    parts = [F.greatest("quality", F.lit(0.05)), F.lit(0.35) + F.lit(0.65) * F.col("topic_relevance"), F.pow(F.lit(0.5), age / s.half_life_days), F.lit(0.75) + F.lit(0.5) * clamp(F.col("score")), boost, uniform(s.seed, F.col("id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return F.round(out, 9)


def weighed(articles: DataFrame, sources: DataFrame, muted: DataFrame, s: Settings) -> DataFrame:
    """Eligible articles with their feed's name and origin and their ranking_key."""
    feeds = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("origin").alias("source_origin"))
    return servable(articles, muted, s).join(feeds, "source_id", "left").withColumn("ranking_key", ranking_key(s))


def round_robin(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """The best article of every identity first, then every identity's second, and so on; `limit` rows, per group of by.

    Adds rank_in_voice, rank_in_domain and position. The first `limit` rows all have both ranks within the limit: as many
    rows with higher keys have lower ranks. So each ranking is cut at the limit by itself, which happens before its
    shuffle, and a voice or domain with a third of all rows sends a task no more than its best; the two meet by id.
    """
    best = [F.col("ranking_key").desc(), F.col("id")]
    in_voice = rows.withColumn("rank_in_voice", F.row_number().over(Window.partitionBy(*by, "voice").orderBy(*best))).where(F.col("rank_in_voice") <= limit)
    in_domain = rows.select("id", *by, F.row_number().over(Window.partitionBy(*by, "domain").orderBy(*best)).alias("rank_in_domain")).where(F.col("rank_in_domain") <= limit)
    both = in_voice.join(in_domain, ["id", *by])
    order = [F.greatest("rank_in_voice", "rank_in_domain"), *best]
    if by:
        return both.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= limit)
    top = both.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def exposures(reads: DataFrame) -> DataFrame:
    """(kind, key, exposure_count, last_exposed_at) of authors and domains."""

    def of(kind: str, column: str) -> DataFrame:
        return reads.where(F.col(column) != "").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("exposure_count"), F.max("at").alias("last_exposed_at")).select(F.lit(kind).alias("kind"), "key", "exposure_count", "last_exposed_at")

    return of("author", "author_key").unionByName(of("domain", "domain"))


def _penalty(count: Column, last: Column, now: int, weight: float, half_life: float, history: float) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - last) / float(DAY)
    recency = F.when(last.isNull() | (last == 0), 0.0).otherwise(F.pow(F.lit(0.5), age / half_life))
    return F.when(count <= 0, 0.0).otherwise(F.lit(weight) * recency + F.lit(history) * F.log2(F.greatest(F.lit(1), count) + 1))


def exposure_cost(now: int = AS_OF) -> Column:
    """Cool-down cost of a candidate: bylines weigh four times what publications do, and stand in for each other."""
    author = _penalty(F.col("author_count"), F.col("author_last"), now, 100.0, 45.0, 2.0)
    domain = _penalty(F.col("domain_count"), F.col("domain_last"), now, 25.0, 21.0, 0.5)
    alone = _penalty(F.col("domain_count"), F.col("domain_last"), now, 100.0, 45.0, 2.0)
    has_author, has_domain = F.col("author_key") != "", F.col("domain") != ""
    return F.round(F.when(~has_author & has_domain, alone).otherwise(F.when(has_author, author).otherwise(0.0) + F.when(has_domain, domain).otherwise(0.0)), 9)


def with_exposure(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows with how often and when their author and their domain were last shown."""
    for kind, key in (("author", "author_key"), ("domain", "domain")):
        side = seen.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("exposure_count").alias(f"{kind}_count"), F.col("last_exposed_at").alias(f"{kind}_last"))
        rows = rows.join(side, key, "left").withColumn(f"{kind}_count", F.coalesce(f"{kind}_count", F.lit(0)).cast("long"))
    return rows


def cooled(rows: DataFrame, now: int = AS_OF) -> DataFrame:
    """rows in the order of their cost, ties in the order they had as `position`; adds cost and cooled_position."""
    costed = rows.withColumn("cost", exposure_cost(now))
    return costed.withColumn("cooled_position", F.row_number().over(Window.orderBy("cost", "position")))


def legacy_sample(rows: DataFrame, per_domain: int = 3, per_author: int = 3, per_topic: int = 30) -> DataFrame:
    """The older sampler: the best of each domain, of those the best of each voice, of those the best of each topic."""
    order = [F.col("ranking_key").desc(), F.col("id")]
    for key, most in (("domain", per_domain), ("voice", per_author), ("topic", per_topic)):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return rows


def topic_rescue(rows: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """pool plus, for each topic with under its share of the window in it, that topic's own round-robin pool."""
    window = s.window[len(s.topics)]
    share, size = window // len(s.topics), window * 10
    have = pool.groupBy("topic").agg(F.count("*").alias("have"))
    wanted = rows.sparkSession.createDataFrame([(t,) for t in s.topics], "topic string").join(have, "topic", "left").where(F.coalesce("have", F.lit(0)) < share).select("topic")
    own = round_robin(rows.join(wanted, "topic", "left_semi"), size, "topic").select(pool.columns)
    return pool.unionByName(own.join(pool.select("id"), "id", "left_anti"))
