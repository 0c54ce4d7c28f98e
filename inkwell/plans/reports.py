"""Queries of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.topics import TOPICS
from inkwell.operators import ranking, reports
from inkwell.operators.ranking import Settings
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.sources import views

S = Settings()


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keyed(views.articles(spark, sf_dir))


@query(with_views("SELECT count(*) AS articles, count(DISTINCT domain) AS domains, count(DISTINCT nullif(author_key, '')) AS authors FROM eligible", "eligible"))
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the eligible pool."""
    return reports.pool_counts(_eligible(spark, sf_dir))


@query(with_views("SELECT topic, count(*) AS articles, count(DISTINCT domain) AS domains, count(DISTINCT nullif(author_key, '')) AS authors FROM eligible GROUP BY topic", "eligible"))
def pool_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the eligible pool by topic."""
    return reports.pool_counts(_eligible(spark, sf_dir), "topic")


@query(with_views("SELECT domain, topic, count(*) AS articles FROM eligible GROUP BY domain, topic ORDER BY articles DESC, domain, topic LIMIT 30", "eligible"))
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty largest pairs of domain and topic; the limit is the feature."""
    return reports.top_pairs(_eligible(spark, sf_dir), 30)


@query(with_views("SELECT s.origin, count(DISTINCT s.id) AS sources, count(*) AS articles FROM eligible e JOIN sources s ON s.id = e.source_id GROUP BY s.origin", "eligible"))
def source_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and eligible articles by origin."""
    rows = _eligible(spark, sf_dir).select("source_id").join(views.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "origin"), "source_id")
    return rows.groupBy("origin").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("articles"))


@query(with_views("SELECT s.id, s.name, s.origin, s.status, (SELECT count(*) FROM articles a WHERE a.source_id = s.id) AS articles, (SELECT count(*) FROM eligible e WHERE e.source_id = s.id) AS eligible FROM sources s", "eligible"))
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their articles."""
    return reports.source_list(views.sources(spark, sf_dir), views.articles(spark, sf_dir), _eligible(spark, sf_dir))


@query(with_views("""--+ b AS (SELECT CASE WHEN d <= 7 THEN '0-7' WHEN d <= 30 THEN '8-30' WHEN d <= 90 THEN '31-90' WHEN d <= 180 THEN '91-180' ELSE '181-' END AS bucket FROM (SELECT (1706745600000 - effective) / 86400000.0::DOUBLE AS d FROM keyed WHERE word_count >= 250))
SELECT bucket, count(*) AS articles, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY bucket""", "keyed"))
def age_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of long articles."""
    return reports.age_histogram(_all(spark, sf_dir).where("word_count >= 250"))


_SEQUENCE = "--+ pool AS (SELECT *, row_number() OVER (ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id) AS place FROM ranked), seq AS (SELECT *, 0 AS session, place AS position FROM pool WHERE place <= 600)\n"


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.weighed(views.articles(spark, sf_dir), views.sources(spark, sf_dir), views.muted(spark, sf_dir), S)
    return ranking.round_robin(rows, 600).select(F.lit(0).alias("session"), F.col("position").cast("long").alias("position"), "id", "domain", "voice", "topic")


@query(with_views(_SEQUENCE + ", c AS (SELECT domain, count(*) AS n FROM seq GROUP BY domain) SELECT count(*) AS sources, sum(n)::BIGINT AS total, (SELECT domain FROM c ORDER BY n DESC, domain LIMIT 1) AS top_source, round(max(n)::DOUBLE / sum(n), 9) AS top_share, count(*) FILTER (n >= 5) AS heavy FROM c", "ranked"))
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the pool one publication holds."""
    return reports.concentration(_sequence(spark, sf_dir))


@query(with_views(_SEQUENCE + ", l AS (SELECT session, domain = lag(domain) OVER o AS d, voice = lag(voice) OVER o AS v FROM seq WINDOW o AS (PARTITION BY session ORDER BY position)) SELECT session, count(*) FILTER (d) AS domain_repeats, count(*) FILTER (v) AS voice_repeats FROM l GROUP BY session", "ranked"))
def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the pool's order that share a domain or a voice."""
    return reports.adjacent_repeats(_sequence(spark, sf_dir), "session")


@query(with_views(_SEQUENCE + """, g AS (SELECT session, position, position - lag(position) OVER (PARTITION BY session, domain ORDER BY position) AS dg, position - lag(position) OVER (PARTITION BY session, voice ORDER BY position) AS vg, position - lag(position) OVER (PARTITION BY session, topic ORDER BY position) AS tg FROM seq)
SELECT session, min(dg) AS min_domain_gap, min(position) FILTER (vg IS NOT NULL) AS first_voice_repeat, count(*) FILTER (tg < 12) AS topic_repeats FROM g GROUP BY session""", "ranked"))
def min_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of domains, voices and topics in the pool's order."""
    return reports.gaps(_sequence(spark, sf_dir), "session")


@query(with_views(_SEQUENCE + """, r AS (SELECT session, sum((topic = 'technology')::INT) OVER o AS a, sum((topic = 'economics')::INT) OVER o AS b, sum((topic = 'math')::INT) OVER o AS c FROM seq WINDOW o AS (PARTITION BY session ORDER BY position ROWS UNBOUNDED PRECEDING))
SELECT session, max(greatest(a, b, c) - least(a, b, c))::BIGINT AS imbalance FROM r GROUP BY session""", "ranked"))
def prefix_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst balance of topics over the prefixes of the pool's order."""
    return reports.prefix_imbalance(_sequence(spark, sf_dir), "session", list(TOPICS))


@query(with_views("SELECT s.share, a.sorted[least(len(a.sorted), floor(len(a.sorted) * s.share)::INT + 1)] AS value FROM (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) s, (SELECT list(word_count ORDER BY word_count) AS sorted FROM articles) a", "articles"))
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the articles' lengths."""
    return reports.nearest_rank(views.articles(spark, sf_dir), "word_count", 0.5, 0.95, 0.99)


@query(with_views("""SELECT count(*) AS articles, count(*) FILTER (word_count >= 250) AS enriched, count(*) FILTER (word_count = -1) AS failed, round(avg(quality) FILTER (word_count >= 250), 9) AS avg_quality, count(*) FILTER (contains(text_content, 'e')) AS with_math FROM articles""", "articles"))
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean quality of a crawl; texts with an e stand for those with formulas."""
    rows = views.articles(spark, sf_dir, text=True).withColumn("content_html", F.when(F.contains("text_content", F.lit("e")), "<nc-math>").otherwise(""))
    return reports.crawl_summary(rows)


@query(with_views("""SELECT s.id AS source_id, s.name, s.topic, count(*) AS discovered, count(*) FILTER (word_count >= 250) AS enriched, row_number() OVER (ORDER BY count(*) FILTER (word_count >= 250) DESC, count(*) DESC, s.id) AS place
FROM articles a JOIN sources s ON s.id = a.source_id GROUP BY s.id, s.name, s.topic QUALIFY place <= 15""", "articles", "sources"))
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen sources with most enriched articles, by an inner join of sources and articles; the limit is the feature."""
    return reports.output_by_source(views.sources(spark, sf_dir), views.articles(spark, sf_dir))


@query(with_views("SELECT id, word_count, quality, row_number() OVER (ORDER BY quality DESC, id) AS place FROM articles WHERE word_count >= 250 QUALIFY place <= 5", "articles"))
def top_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best long articles; the limit is the feature."""
    rows = views.articles(spark, sf_dir).where("word_count >= 250")
    return reports.first_rows(rows, 5, F.col("quality").desc(), F.col("id")).select("id", "word_count", "quality", "place")


@query(with_views("SELECT id, title FROM articles WHERE topic = 'economics' AND lower(title) GLOB '*er*'", "articles"))
def glob_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a topic that hold a string, in this case only."""
    return views.articles(spark, sf_dir).where((F.col("topic") == "economics") & F.lower("title").like("%er%")).select("id", "title")
