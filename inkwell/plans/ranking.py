"""Queries of ranking and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.topics import TOPICS, cluster
from inkwell.operators import fairness, ranking
from inkwell.operators.ranking import Settings
from inkwell.operators.slate import diverse_slates
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.sources import views

S = Settings()
_EXPOSED = """--+ shown AS (
  SELECT r.*, coalesce(a.exposure_count, 0) AS author_count, a.last_exposed_at AS author_last, coalesce(d.exposure_count, 0) AS domain_count, d.last_exposed_at AS domain_last
  FROM ranked r LEFT JOIN exposures a ON a.kind = 'author' AND a.key = r.author_key LEFT JOIN exposures d ON d.kind = 'domain' AND d.key = r.domain),
costed AS (
  SELECT *, round(CASE
    WHEN author_key = '' AND domain <> '' THEN {alone}
    ELSE CASE WHEN author_key <> '' THEN {author} ELSE 0 END + CASE WHEN domain <> '' THEN {domain} ELSE 0 END END, 9) AS cost
  FROM shown)
"""


def _cost(kind: str, weight: float, half: float, history: float) -> str:
    age = f"greatest(0, 1706745600000 - {kind}_last) / 86400000.0::DOUBLE"
    return f"(CASE WHEN {kind}_count <= 0 THEN 0 ELSE {weight}::DOUBLE * CASE WHEN {kind}_last IS NULL OR {kind}_last = 0 THEN 0 ELSE pow(0.5::DOUBLE, {age} / {half}::DOUBLE) END + {history}::DOUBLE * log2(greatest(1, {kind}_count) + 1) END)"


_EXPOSED = _EXPOSED.format(alone=_cost("domain", 100, 45, 2), author=_cost("author", 100, 45, 2), domain=_cost("domain", 25, 21, 0.5))


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.weighed(views.articles(spark, sf_dir), views.sources(spark, sf_dir), views.muted(spark, sf_dir), S)


@query(with_views("SELECT t.topic, count(e.id)::BIGINT AS eligible FROM (SELECT unnest(['technology', 'economics', 'math']) AS topic) t LEFT JOIN eligible e ON e.topic = t.topic GROUP BY t.topic", "eligible"))
def eligible_count_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible articles of each selected topic, zero where there are none."""
    found = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy("topic").count()
    topics = spark.createDataFrame([(t,) for t in S.topics], "topic string")
    return topics.join(found, "topic", "left").select("topic", F.coalesce("count", F.lit(0)).cast("long").alias("eligible"))


@query(with_views("SELECT id, topic, domain, author_key, voice, source_name, source_origin, ranking_key, rank_in_voice, rank_in_domain FROM ranked ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id LIMIT 360", "ranked"))
def weighted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate pool of a reader: the flagship plan."""
    return ranking.round_robin(_weighed(spark, sf_dir), 360).select("id", "topic", "domain", "author_key", "voice", "source_name", "source_origin", "ranking_key", *(F.col(c).cast("long").alias(c) for c in ("rank_in_voice", "rank_in_domain")))


@query(with_views("""--+ a AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ranking_key DESC, id) AS n FROM ranked),
b AS (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY ranking_key DESC, id) AS m FROM a WHERE n <= 3),
c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ranking_key DESC, id) AS o FROM b WHERE m <= 3)
SELECT id, topic, domain, voice, ranking_key FROM c WHERE o <= 30""", "ranked"))
def legacy_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older sampler: three a domain, three a voice, thirty a topic."""
    return ranking.legacy_sample(_weighed(spark, sf_dir)).select("id", "topic", "domain", "voice", "ranking_key")


@query(with_views("""--+ pool AS (SELECT * FROM ranked ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id LIMIT 40),
short AS (SELECT t.topic FROM (SELECT unnest(['technology', 'economics', 'math']) AS topic) t LEFT JOIN pool p ON p.topic = t.topic GROUP BY t.topic HAVING count(p.id) < 12),
own AS (SELECT id, topic, ranking_key, row_number() OVER (PARTITION BY topic, voice ORDER BY ranking_key DESC, id) AS v, row_number() OVER (PARTITION BY topic, domain ORDER BY ranking_key DESC, id) AS d FROM ranked WHERE topic IN (SELECT topic FROM short)),
own2 AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY greatest(v, d), ranking_key DESC, id) AS n FROM own)
SELECT id, topic, ranking_key FROM pool UNION ALL SELECT id, topic, ranking_key FROM own2 WHERE n <= 360 AND id NOT IN (SELECT id FROM pool)""", "ranked"))
def topic_rescue_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 40 with what it lacks of each topic's share."""
    rows = _weighed(spark, sf_dir)
    return ranking.topic_rescue(rows, ranking.round_robin(rows, 40), S).select("id", "topic", "ranking_key")


@query(with_views("SELECT kind, key, exposure_count, last_exposed_at FROM exposures", "exposures"))
def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and when each author and each domain were shown."""
    return ranking.exposures(views.reads(spark, sf_dir))


@query(with_views(_EXPOSED + "SELECT id, author_count, domain_count, cost FROM costed", "ranked", "exposures"))
def exposure_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cool-down cost of every eligible article."""
    rows = ranking.with_exposure(_weighed(spark, sf_dir), ranking.exposures(views.reads(spark, sf_dir)))
    return rows.select("id", "author_count", "domain_count", ranking.exposure_cost().alias("cost"))


def _pool(spark: SparkSession, sf_dir: str, limit: int = 360) -> DataFrame:
    return ranking.round_robin(_weighed(spark, sf_dir), limit)


@query(with_views(_EXPOSED + """, pool AS (SELECT *, row_number() OVER (ORDER BY greatest(rank_in_voice, rank_in_domain), ranking_key DESC, id) AS position FROM costed QUALIFY position <= 360)
SELECT id, position, cost, row_number() OVER (ORDER BY cost, position) AS cooled_position FROM pool""", "ranked", "exposures"))
def cooled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool in the order of its cool-down cost."""
    rows = ranking.with_exposure(_pool(spark, sf_dir), ranking.exposures(views.reads(spark, sf_dir)))
    return ranking.cooled(rows).select("id", "cost", *(F.col(c).cast("long").alias(c) for c in ("position", "cooled_position")))


@query(with_views("""--+ c AS (SELECT topic, count(*) AS available FROM eligible GROUP BY topic),
t AS (SELECT p.place, p.topic, coalesce(c.available, 0) AS available FROM (SELECT unnest(['technology', 'economics', 'math', 'poetry']) AS topic, unnest(range(4)) AS place) p LEFT JOIN c ON c.topic = p.topic),
seats AS (SELECT topic, row_number() OVER (ORDER BY turn, place) AS seat FROM (SELECT topic, place, unnest(range(1, least(available, 50) + 1)) AS turn FROM t WHERE available > 0))
SELECT t.topic, t.available::BIGINT AS available, (SELECT count(*) FROM seats s WHERE s.topic = t.topic AND seat <= 50)::BIGINT AS quota FROM t""", "eligible"))
def topic_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty seats dealt to the topics in turn."""
    counts = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy("topic").agg(F.count("*").alias("available"))
    return fairness.topic_quotas(counts, 50, [*TOPICS, "poetry"])


@query(with_views("""--+ c AS (SELECT domain, count(*) AS n FROM eligible GROUP BY domain), s AS (SELECT least(coalesce(sum(n), 0), 120)::BIGINT AS slots FROM c)
SELECT slots, (SELECT min(cap) FROM range(0, 121) r(cap) WHERE (SELECT sum(least(n, cap)) FROM c) >= slots)::BIGINT AS cap FROM s""", "eligible"))
def identity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cap per domain that still fills 120 slots."""
    counts = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy(F.col("domain").alias("key")).agg(F.count("*").alias("n"))
    return fairness.identity_cap(counts, 120)


_DEMAND = {"technology": 40, "economics": 30, "math": 50}


@query(with_views("""--+ p AS (SELECT domain, count(*) FILTER (topic = 'technology') AS a, count(*) FILTER (topic = 'economics') AS b, count(*) FILTER (topic = 'math') AS c FROM eligible GROUP BY domain)
SELECT cap, least(sum(least(cap, a + b + c)), sum(least(cap, b + c)) + 40, sum(least(cap, a + c)) + 30, sum(least(cap, a + b)) + 50, sum(least(cap, c)) + 70, sum(least(cap, b)) + 90, sum(least(cap, a)) + 80, 120)::BIGINT AS flow
FROM p, (SELECT unnest([1, 2, 3, 5, 8, 13])::INT AS cap) GROUP BY cap""", "eligible"))
def domain_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cards capped domains can give to three demands, for six caps."""
    pairs = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy("domain", "topic").agg(F.count("*").alias("n"))
    return fairness.domain_flow(pairs, _DEMAND, [1, 2, 3, 5, 8, 13])


@query(with_views("""--+ p AS (SELECT domain, count(*) FILTER (topic = 'technology') AS a, count(*) FILTER (topic = 'economics') AS b, count(*) FILTER (topic = 'math') AS c FROM eligible GROUP BY domain),
f AS (SELECT cap, least(sum(least(cap, a + b + c)), sum(least(cap, b + c)) + 40, sum(least(cap, a + c)) + 30, sum(least(cap, a + b)) + 50, sum(least(cap, c)) + 70, sum(least(cap, b)) + 90, sum(least(cap, a)) + 80, 120) AS flow
FROM p, (SELECT unnest(range(1, 121)) AS cap) GROUP BY cap)
SELECT coalesce(min(cap) FILTER (flow >= 120), 120)::BIGINT AS cap FROM f""", "eligible"))
def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cap per domain that meets the topics' demands, or the demand itself."""
    pairs = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).groupBy("domain", "topic").agg(F.count("*").alias("n"))
    need = sum(_DEMAND.values())
    flows = fairness.domain_flow(pairs, _DEMAND, list(range(1, need + 1)))
    return flows.agg(F.coalesce(F.min(F.when(F.col("flow") >= need, F.col("cap"))), F.lit(need)).cast("long").alias("cap"))


@query(with_views("""--+ r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY id) AS round, min(id) OVER (PARTITION BY domain) AS f FROM keyed)
SELECT id, domain, round, row_number() OVER (ORDER BY round, f) AS slot FROM r WHERE round <= 4 ORDER BY round, f LIMIT 200""", "keyed"))
def round_robin_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by domain in turn, four a domain, two hundred in all."""
    rows = ranking.keyed(views.articles(spark, sf_dir)).select("id", "domain")
    return fairness.round_robin_by(rows, "domain", "id", 200, 4).select("id", "domain", *(F.col(c).cast("long").alias(c) for c in ("round", "slot")))


@query(with_views("""--+ q AS (SELECT id, domain, score, effective FROM keyed WHERE word_count < 120 AND effective > 1706745600000 - 60 * 86400000::BIGINT AND fetched_at > 1706745600000 - 60 * 86400000::BIGINT ORDER BY score DESC, effective DESC, id LIMIT 96),
n AS (SELECT *, row_number() OVER (ORDER BY score DESC, effective DESC, id) AS place FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY place) AS round, min(place) OVER (PARTITION BY domain) AS f FROM n)
SELECT id, domain, place, round, row_number() OVER (ORDER BY round, f) AS slot FROM r ORDER BY round, f LIMIT 24""", "keyed"))
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 96 short articles, of which 24 by domain in turn go to enrichment."""
    since = S.now - S.stale_days * views.DAY
    rows = ranking.keyed(views.articles(spark, sf_dir)).where((F.col("word_count") < 120) & (F.col("effective") > since) & (F.col("fetched_at") > since))
    order = [F.col("score").desc(), F.col("effective").desc(), F.col("id")]
    top = rows.orderBy(*order).limit(96).select("id", "domain", F.row_number().over(Window.orderBy(*order)).alias("place"))
    return fairness.round_robin_by(top, "domain", "place", 24).select("id", "domain", *(F.col(c).cast("long").alias(c) for c in ("place", "round", "slot")))


@query()
def diverse_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slates of twenty readers, each over a pool drawn with the reader's own seed: (session_id, position, id, ...)."""
    sessions = spark.range(20).select(F.col("id").alias("session_id"))
    base = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S).join(views.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("origin").alias("source_origin")), "source_id", "left")
    base = ranking.with_exposure(base, ranking.exposures(views.reads(spark, sf_dir))).withColumn("cost", ranking.exposure_cost()).withColumn("cluster", cluster(F.col("topic"), F.col("title"), F.col("domain"), F.col("source_name"), F.col("source_origin")))
    base = base.select("id", "topic", "domain", "voice", "author_key", "cost", "cluster", "quality", "topic_relevance", "effective", "score", "source_origin")
    # Each session re-draws its key; sessions come in one at a time as rows, the pool is cut per session by window limits.
    drawn = base.withColumn("session_id", F.explode(F.sequence(F.lit(0), F.lit(19)))).join(sessions, "session_id")
    return diverse_slates(drawn, limit=36, topics=list(TOPICS), settings=S)
