"""Queries of the reader's deque: pool, window, slates behind cards shown before, and refills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.topics import TOPICS
from inkwell.operators import deque, ranking, session
from inkwell.operators.ranking import Settings
from inkwell.operators.slate import diverse_slates
from inkwell.plans.oracle_views import with_views
from inkwell.plans.ranking import _EXPOSED, _weighed
from inkwell.plans.registry import query
from inkwell.plans.session import _queue
from inkwell.sources import views

S = Settings()
_rows = _weighed


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.exposures(views.reads(spark, sf_dir))


_POOL = _EXPOSED + """, q AS (SELECT id FROM articles WHERE is_bookmarked = 1),
pool AS (SELECT *, row_number() OVER (ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id) AS place FROM costed QUALIFY place <= {size}),
short AS (SELECT t.topic, t.i FROM (SELECT unnest(['technology', 'economics', 'math']) AS topic, unnest(range(3)) AS i) t LEFT JOIN (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM q)) p ON p.topic = t.topic GROUP BY t.topic, t.i HAVING count(p.id) < 12),
own AS (SELECT c.id, c.topic, c.cost, ranking_key, i, row_number() OVER (PARTITION BY c.topic, voice ORDER BY ranking_key DESC, c.id) AS v, row_number() OVER (PARTITION BY c.topic, domain ORDER BY ranking_key DESC, c.id) AS d FROM costed c JOIN short ON short.topic = c.topic),
own2 AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY greatest(v, d), ranking_key DESC, id) AS n FROM own QUALIFY n <= {size}),
every AS (SELECT id, topic, cost, place FROM pool UNION ALL SELECT id, topic, cost, {size} * (1 + i) + n FROM own2 WHERE id NOT IN (SELECT id FROM pool))
SELECT id, topic, cost, row_number() OVER (ORDER BY cost, place) AS position FROM every WHERE id NOT IN (SELECT id FROM q)"""


@query(with_views(_POOL.format(size=360), "ranked", "exposures"))
def deque_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's next window is drawn from: ten windows, with what they lack of a topic's share."""
    return deque.deque_pool(_rows(spark, sf_dir), _seen(spark, sf_dir), _queue(spark, sf_dir), S).select("id", "topic", "cost", "position")


@query(with_views(_POOL.format(size=36), "ranked", "exposures"))
def rescued_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one window only, which leaves topics short."""
    return deque.deque_pool(_rows(spark, sf_dir), _seen(spark, sf_dir), _queue(spark, sf_dir), S, times=1).select("id", "topic", "cost", "position")


@query()
def deque_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's next window behind the queue; a greedy choice, which the tests hold against the choice itself."""
    articles = ranking.keyed(views.articles(spark, sf_dir))
    return deque.deque_window(_rows(spark, sf_dir), _seen(spark, sf_dir), _queue(spark, sf_dir), articles, views.sources(spark, sf_dir), S)


def _cards(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    named = rows.join(views.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("origin").alias("source_origin")), "source_id", "left")
    return named.withColumn("cluster", deque.card_cluster())


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sixty cards that each of twenty readers saw."""
    reads = views.reads(spark, sf_dir).select((F.col("event_id") % 20).alias("session_id"), "article_id", "event_id").groupBy("session_id", "article_id").agg(F.max("event_id").alias("position"))
    from pyspark.sql import Window

    last = reads.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("position").desc()))).where("_n <= 60")
    cards = _cards(spark, sf_dir, ranking.keyed(views.articles(spark, sf_dir)))
    return last.join(cards, F.col("article_id") == F.col("id")).select("session_id", "position", "id", "topic", "domain", "author_key", "cluster")


@query()
def slate_with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next slates of twenty readers behind the cards that each of them saw last."""
    base = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S)
    base = ranking.with_exposure(_cards(spark, sf_dir, base), _seen(spark, sf_dir)).withColumn("cost", ranking.exposure_cost())
    base = base.select("id", "topic", "domain", "voice", "author_key", "cost", "cluster", "quality", "topic_relevance", "effective", "score", "source_origin")
    drawn = base.withColumn("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return diverse_slates(drawn, 36, list(TOPICS), S, _shown(spark, sf_dir))


@query(with_views("--+ c AS (SELECT t.topic, count(e.id) AS n FROM (SELECT unnest(['technology', 'economics', 'math']) AS topic) t LEFT JOIN eligible e ON e.topic = t.topic GROUP BY t.topic) SELECT min(n) < 12 AS due FROM c", "eligible"))
def top_up_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a topic has run low, so that a crawl is due."""
    found = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy("topic").agg(F.count("*").alias("n"))
    topics = spark.createDataFrame([(t,) for t in S.topics], "topic string")
    return session.refill_due(topics.join(found, "topic", "left").select(F.coalesce("n", F.lit(0)).alias("eligible")))


@query(with_views("""--+ s AS (SELECT id // 36 AS session_id, id % 36 AS position, topic, domain, voice FROM keyed),
f AS (SELECT session_id, count(*) FILTER (position < 12) AS cards, count(DISTINCT domain) FILTER (position < 12) AS domains, count(DISTINCT voice) FILTER (position < 12) AS voices FROM s GROUP BY session_id),
t AS (SELECT session_id, max(n) AS most, CASE WHEN count(*) < 3 THEN 0 ELSE min(n) END AS least FROM (SELECT session_id, topic, count(*) AS n FROM s GROUP BY ALL) GROUP BY session_id)
SELECT f.session_id, cards = 12 AND domains = 12 AND voices = 12 AND most - least <= 1 AS diverse FROM f JOIN t ON t.session_id = f.session_id""", "keyed"))
def diverse_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs of thirty-six articles would do as a first screen."""
    rows = ranking.keyed(views.articles(spark, sf_dir)).select(F.floor(F.col("id") / 36).alias("session_id"), (F.col("id") % 36).alias("position"), "topic", "domain", "voice")
    return session.diverse_openings(rows, "session_id")
