"""Queries of a reader's session and of the choice of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import ranking, session
from inkwell.operators.ranking import Settings
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.sources import views


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookmarked articles, queued from the newest id on."""
    rows = views.articles(spark, sf_dir).where("is_bookmarked = 1").select("id")
    return rows.select((F.lit(1_000_000) - F.col("id")).alias("position"), "id")


@query(with_views("SELECT 1000000 - id AS position, id, domain, topic FROM keyed WHERE is_bookmarked = 1 ORDER BY position DESC LIMIT 60", "keyed"))
def queued_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sixty queued cards."""
    cards = ranking.keyed(views.articles(spark, sf_dir)).select("id", "domain", "topic", "is_read", "read_at")
    return session.diversity_context(_queue(spark, sf_dir), cards).select("position", "id", "domain", "topic")


@query(with_views("SELECT row_number() OVER (ORDER BY read_at, id) AS position, id, domain, topic FROM (SELECT * FROM keyed WHERE is_read = 1 AND read_at IS NOT NULL ORDER BY read_at DESC, id DESC LIMIT 60)", "keyed"))
def read_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sixty read cards, in the place of an empty queue."""
    cards = ranking.keyed(views.articles(spark, sf_dir)).select("id", "domain", "topic", "is_read", "read_at")
    return session.diversity_context(_queue(spark, sf_dir).where("id < 0"), cards).select("position", "id", "domain", "topic")


@query(with_views("""--+ q AS (SELECT 1000000 - id AS position, id FROM articles WHERE is_bookmarked = 1),
w AS (SELECT id, row_number() OVER (ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id) AS r FROM ranked QUALIFY r <= 360), n AS (SELECT id, row_number() OVER (ORDER BY r) AS r FROM w WHERE id NOT IN (SELECT id FROM q))
SELECT position, id FROM q UNION ALL SELECT (SELECT max(position) FROM q) + r, id FROM n""", "ranked"))
def top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue with the unqueued cards of a window behind it; the window of 360 is the feature."""
    rows = ranking.weighed(views.articles(spark, sf_dir), views.sources(spark, sf_dir), views.muted(spark, sf_dir), Settings())
    return session.append_unseen(_queue(spark, sf_dir), ranking.round_robin(rows, 360).select("id", "position"))


@query(with_views("SELECT id, CASE WHEN topic IN ('technology', 'math') AND status = 'paused' THEN 'active' WHEN topic NOT IN ('technology', 'math') AND status IN ('active', 'failing') THEN 'paused' ELSE status END AS status FROM sources", "sources"))
def topic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after choosing two topics."""
    return session.select_topics(views.sources(spark, sf_dir), ["technology", "math"]).select("id", "status")


@query(with_views("SELECT id, CASE WHEN topic NOT IN ('technology', 'math') AND is_read = 0 AND is_bookmarked = 0 THEN 1 ELSE is_archived END AS is_archived FROM articles", "articles"))
def topic_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after choosing two topics."""
    return session.archive_unselected(views.articles(spark, sf_dir), ["technology", "math"]).select("id", "is_archived")


@query(with_views("SELECT id, round(CASE origin WHEN 'seed' THEN least(score + 0.2 * (id % 2), 0.58) WHEN 'outbound' THEN score + 0.2 * (id % 2) ELSE greatest(score + 0.2 * (id % 2) - 0.3, 0.5) END::DOUBLE, 9) AS score FROM sources", "sources"))
def trust_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust within the bounds of the origins."""
    moved = F.col("score") + F.lit(0.2) * (F.col("id") % 2) - F.when(F.col("origin").isin("hn", "aggregator"), 0.3).otherwise(0.0)
    return session.clamp_trust(views.sources(spark, sf_dir).withColumn("score", moved)).select("id", F.round("score", 9).alias("score"))


@query(with_views("""--+ c AS (SELECT 'https://feed' || i || '.example/rss' AS feed_url, 'Catalog ' || i AS name, ['technology', 'economics', 'math'][(i % 3 + 1)::INT] AS topic, CASE WHEN i % 5 = 0 THEN 'aggregator' ELSE 'seed' END AS origin FROM range(40) r(i)),
w AS (SELECT * FROM c WHERE topic IN ('technology', 'math'))
SELECT coalesce(s.feed_url, w.feed_url) AS feed_url, coalesce(s.name, w.name) AS name, CASE WHEN w.feed_url IS NOT NULL AND s.status IN ('paused', 'dead') THEN w.topic ELSE coalesce(s.topic, w.topic) END AS topic,
  CASE WHEN w.feed_url IS NOT NULL AND s.status IN ('paused', 'dead') THEN w.origin ELSE coalesce(s.origin, w.origin) END AS origin, CASE WHEN w.feed_url IS NOT NULL AND s.status IN ('paused', 'dead') THEN 'active' ELSE coalesce(s.status, 'active') END AS status
FROM sources s FULL JOIN w ON w.feed_url = s.feed_url""", "sources"))
def seed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after seeding from a catalog of forty feeds."""
    i = F.col("id")
    catalog = spark.range(40).select(F.concat(F.lit("https://feed"), i.cast("string"), F.lit(".example/rss")).alias("feed_url"), F.concat(F.lit("Catalog "), i.cast("string")).alias("name"), views.pick(["technology", "economics", "math"], i).alias("topic"), F.when(i % 5 == 0, "aggregator").alias("origin"))
    return session.seed_catalog(catalog, views.sources(spark, sf_dir).select("feed_url", "name", "topic", "origin", "status"), ["technology", "math"])


@query(r"""WITH e AS (SELECT doc_id, 'site-' || doc_id || '.example' AS domain, doc_id % 11 <> 0 AS allowed, doc_id % 13 = 0 AS known, doc_id % 17 = 0 AS failed, CASE WHEN doc_id % 19 <> 0 THEN 'https://f' END AS feed_url, doc_id % 7 AS entries, ['A Blog', 'Company news', 'The Podcast', 'Notes'][(doc_id % 4 + 1)::INT] AS title, doc_id % 6 AS authors, doc_id % 23 = 0 AS duplicate FROM documents),
o AS (SELECT domain, CASE WHEN NOT allowed THEN 'blocked' WHEN known THEN 'known' WHEN failed THEN 'error' WHEN feed_url IS NULL OR entries < 2 THEN 'no-feed' WHEN regexp_matches(title, '(?i)podcast|archive|changelog|release notes|recent additions|\bnews\b|status|jobs|roadmap|press release') THEN 'blocked' WHEN authors >= 4 THEN 'blocked' WHEN duplicate THEN 'known' ELSE 'added' END AS outcome FROM e)
SELECT domain, outcome, outcome <> 'error' AS takes_slot FROM o""")
def probe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of probed sites."""
    i = F.col("doc_id")
    evidence = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("site-"), i.cast("string"), F.lit(".example")).alias("domain"), (i % 11 != 0).alias("allowed"), (i % 13 == 0).alias("known"), (i % 17 == 0).alias("failed"), F.when(i % 19 != 0, "https://f").alias("feed_url"), (i % 7).alias("entries"), views.pick(["A Blog", "Company news", "The Podcast", "Notes"], i).alias("title"), (i % 6).alias("authors"), (i % 23 == 0).alias("duplicate"))
    return session.probe_outcomes(evidence)


@query(with_views("SELECT id, domain, NULL::BIGINT AS published FROM (SELECT id, domain FROM keyed QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id) = 1 ORDER BY id LIMIT 30)", "keyed"))
def small_web_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entries of thirty domains; the limit is the feature."""
    rows = ranking.keyed(views.articles(spark, sf_dir)).select("id", "domain", F.col("id").alias("position"))
    return session.first_of_each_domain(rows, 30).select("id", "domain", "published")
