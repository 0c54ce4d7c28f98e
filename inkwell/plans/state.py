"""Queries of state transitions over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.basics import uniform
from inkwell.operators import ranking, reports, state
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.sources import views


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").withColumn("at", views.epoch_ms(F.col("ts")))


@query("""WITH l AS (SELECT substr(d.source, 4, 9)::BIGINT AS source_id, d.doc_id, 0.45::DOUBLE + (d.doc_id % 40) / 100.0::DOUBLE - 0.3::DOUBLE * (1 - quality) AS quality FROM labels x JOIN documents d ON d.doc_id = x.doc_id),
g AS (SELECT source_id, list(quality ORDER BY doc_id) AS qs FROM l GROUP BY source_id)
SELECT source_id, round(list_reduce(qs, lambda s, x: greatest(0.3::DOUBLE, least(0.85::DOUBLE, s * 0.8::DOUBLE + x * 0.2::DOUBLE)), 0.55::DOUBLE), 9) AS score FROM g""")
def trust_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust of each source after its labelled documents, in their order."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 9).cast("long").alias("source_id"))
    graded = F.lit(0.45) + (F.col("doc_id") % 40) / 100.0 - F.lit(0.3) * (F.lit(1) - F.col("quality"))
    log = views.table(spark, sf_dir, "labels").join(docs, "doc_id").select("source_id", F.col("doc_id").alias("seq"), graded.alias("quality"))
    return state.trust(log, F.lit(0.55)).select("source_id", F.round("value", 9).alias("score"))


_CHECKS = """WITH checks AS (SELECT user_id % 23 AS source_id, event_id AS seq, epoch_us(ts) // 1000 AS ms, (event_type IN ('purchase', 'signup'))::INT AS new_entries, event_type <> 'error' AS ok FROM events)
"""


@query(_CHECKS + """, g AS (SELECT *, (ms - lag(ms) OVER (PARTITION BY source_id ORDER BY seq)) / 3600000.0::DOUBLE AS gap FROM checks),
s AS (SELECT source_id, list(CASE WHEN new_entries > 0 AND gap IS NOT NULL THEN CASE WHEN gap >= 0.5 AND gap <= 720 THEN gap ELSE -2 END ELSE -1 END ORDER BY seq) AS steps, arg_max(ms, seq) AS last_ms FROM g GROUP BY source_id),
r AS (SELECT source_id, last_ms, list_reduce(steps, lambda x, y: greatest(0.5::DOUBLE, least(168.0::DOUBLE, CASE WHEN y = -1 THEN x * 1.3::DOUBLE WHEN y = -2 THEN x ELSE y END)), 24.0::DOUBLE) AS hours FROM s)
SELECT source_id, round(hours, 9) AS interval_hours, round((last_ms + hours * (0.85::DOUBLE + 0.3::DOUBLE * (('0x' || substr(md5('poll:' || source_id), 1, 8))::BIGINT % 1000000 + 1)::DOUBLE / 1000001.0::DOUBLE) * 3600000) / 1000)::BIGINT AS next_check_s FROM r""")
def poll_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval and next check of each source after its checks."""
    checks = _events(spark, sf_dir).select((F.col("user_id") % 23).alias("source_id"), F.col("event_id").alias("seq"), "at", F.col("event_type").isin("purchase", "signup").cast("int").alias("new_entries"))
    hours = state.poll_interval(checks, F.lit(24.0))
    last = checks.groupBy("source_id").agg(F.max_by("at", "seq").alias("last"))
    jitter = F.lit(0.85) + F.lit(0.3) * uniform("poll", F.col("source_id"))
    return hours.join(last, "source_id").select("source_id", F.round("value", 9).alias("interval_hours"), F.round((F.col("last") + F.col("value") * jitter * 3600000) / 1000).cast("long").alias("next_check_s"))


@query(_CHECKS + """, g AS (SELECT source_id, count(*) FILTER (NOT ok AND seq > coalesce(last_ok, -1)) AS failures, arg_max(ms, seq) AS last FROM (SELECT *, max(CASE WHEN ok THEN seq END) OVER (PARTITION BY source_id) AS last_ok FROM checks) GROUP BY source_id)
SELECT source_id, failures, CASE WHEN failures = 0 THEN 'active' WHEN failures >= 8 THEN 'dead' ELSE 'failing' END AS status, CASE WHEN failures > 0 THEN last + 6 * 3600000 END AS next_check_at FROM g""")
def failure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row and status of each source."""
    checks = _events(spark, sf_dir).select((F.col("user_id") % 23).alias("source_id"), F.col("event_id").alias("seq"), "at", (F.col("event_type") != "error").alias("ok"))
    return state.failures(checks)


@query(with_views("""--+ f AS (SELECT article_id, arg_min(shown_at, event_id) AS read_at FROM reads GROUP BY article_id),
x AS (SELECT k.author_key, k.domain, f.read_at FROM f JOIN keyed k ON k.id = f.article_id)
SELECT 'author' AS kind, author_key AS key, count(*) AS exposure_count, max(read_at) AS last_exposed_at FROM x WHERE author_key <> '' GROUP BY author_key
UNION ALL SELECT 'domain', domain, count(*), max(read_at) FROM x WHERE domain <> '' GROUP BY domain""", "keyed", "reads"))
def mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures after first reads only: reading an article again counts nothing."""
    log = views.reads(spark, sf_dir).select("article_id", F.col("event_id").alias("seq"), "at")
    shown = state.first_reads(log).join(ranking.keyed(views.articles(spark, sf_dir)).select(F.col("id").alias("article_id"), "author_key", "domain"), "article_id")
    return ranking.exposures(shown.select("author_key", "domain", F.col("read_at").alias("at")))


@query("SELECT event_id % 500 AS article_id, arg_max(event_type = 'click', event_id) AS is_bookmarked FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each article is bookmarked after its last word."""
    log = _events(spark, sf_dir).where(F.col("event_type").isin("click", "error")).select((F.col("event_id") % 500).alias("article_id"), "event_id", (F.col("event_type") == "click").alias("is_bookmarked"))
    return state.last_word(log, "article_id", "event_id", "is_bookmarked")


@query(with_views("""--+ w AS (SELECT 'author-' || user_id AS author_key, arg_max(event_type = 'error', event_id) AS is_muted FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id)
SELECT id, author_key FROM articles WHERE author_key IN (SELECT author_key FROM w WHERE is_muted)""", "articles"))
def mute_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the authors whose last mute stands."""
    log = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup")).select(F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key"), "event_id", (F.col("event_type") == "error").alias("is_muted"))
    muted = state.last_word(log, "author_key", "event_id", "is_muted").where("is_muted")
    return views.articles(spark, sf_dir).select("id", "author_key").join(muted, "author_key", "left_semi").select("id", "author_key")


@query("SELECT event_id % 300 AS article_id, user_id % 7 AS paragraph FROM events WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that an odd number of taps left liked."""
    return state.toggled(_events(spark, sf_dir).where("event_type = 'click'").select((F.col("event_id") % 300).alias("article_id"), (F.col("user_id") % 7).alias("paragraph")))


@query(with_views("""--+ n AS (SELECT 'https://feed' || (event_id % 40) || '.example/rss' AS feed_url, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Feed ' || event_id END AS name, ['technology', 'economics', 'math'][(event_id % 3 + 1)::INT] AS topic, ['seed', 'hn', 'aggregator', 'outbound'][(event_id % 4 + 1)::INT] AS origin, event_id AS seq FROM events WHERE event_type = 'signup'),
o AS (SELECT feed_url, arg_min(topic, seq) AS topic, arg_min(origin, seq) AS origin, arg_max(name, seq) FILTER (name <> '') AS name FROM n GROUP BY feed_url)
SELECT coalesce(s.feed_url, o.feed_url) AS feed_url, coalesce(o.name, s.name, '') AS name, coalesce(s.topic, o.topic) AS topic, coalesce(s.origin, o.origin) AS origin,
  coalesce(s.score, CASE o.origin WHEN 'seed' THEN 0.58 WHEN 'outbound' THEN 0.55 WHEN 'hn' THEN 0.54 ELSE 0.5 END::DOUBLE) AS score FROM sources s FULL JOIN o ON o.feed_url = s.feed_url""", "sources"))
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after a batch of subscriptions."""
    i = F.col("event_id")
    new = _events(spark, sf_dir).where("event_type = 'signup'").select(F.concat(F.lit("https://feed"), (i % 40).cast("string"), F.lit(".example/rss")).alias("feed_url"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Feed "), i.cast("string"))).alias("name"), views.pick(["technology", "economics", "math"], i).alias("topic"), views.pick(["seed", "hn", "aggregator", "outbound"], i).alias("origin"), i.alias("seq"))
    return state.upsert_sources(views.sources(spark, sf_dir).select("feed_url", "name", "topic", "origin", "score"), new)


@query(with_views("""--+ known AS (SELECT url, CASE WHEN id % 4 = 0 THEN '' ELSE title END AS title, author_key AS author, published_date FROM articles WHERE id % 2 = 0),
n AS (SELECT url, CASE WHEN id % 5 = 0 THEN '' ELSE title || ' (feed)' END AS title, CASE WHEN id % 3 = 0 THEN '' ELSE 'By ' || id END AS author, CASE WHEN id % 6 <> 0 THEN fetched_at END AS published_date, id AS seq FROM articles WHERE id % 3 <> 1
  UNION ALL SELECT url, 'Again ' || id, 'Late', 1700000000000, 1000000 + id FROM articles WHERE id % 3 = 0),
o AS (SELECT url, coalesce(arg_min(title, seq) FILTER (title <> ''), '') AS title, coalesce(arg_min(author, seq) FILTER (author <> ''), '') AS author, arg_min(published_date, seq) FILTER (published_date IS NOT NULL) AS published_date FROM n GROUP BY url)
SELECT coalesce(k.url, o.url) AS url, coalesce(nullif(k.title, ''), o.title, k.title) AS title, coalesce(nullif(k.author, ''), o.author, k.author) AS author, coalesce(k.published_date, o.published_date) AS published_date, k.url IS NULL AS inserted FROM known k FULL JOIN o ON o.url = k.url""", "articles"))
def upsert_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after a batch of feed entries."""
    a, i = views.articles(spark, sf_dir), F.col("id")
    known = a.where(i % 2 == 0).select("url", F.when(i % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.col("author_key").alias("author"), "published_date")
    new = a.where(i % 3 != 1).select("url", F.when(i % 5 == 0, "").otherwise(F.concat("title", F.lit(" (feed)"))).alias("title"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("By "), i.cast("string"))).alias("author"), F.when(i % 6 != 0, F.col("fetched_at")).alias("published_date"), i.alias("seq"))
    again = a.where(i % 3 == 0).select("url", F.concat(F.lit("Again "), i.cast("string")).alias("title"), F.lit("Late").alias("author"), F.lit(1700000000000).alias("published_date"), (i + 1000000).alias("seq"))
    return state.upsert_articles(known, new.unionByName(again))


@query(with_views("""--+ old AS (SELECT id, title, author_key AS author, author_key, site_domain AS site_name, published_date, 'old' AS excerpt, '<p>old</p>' AS content_html, 'old' AS text_content, '' AS lead_image_url, word_count, quality, topic, topic_relevance FROM articles),
p AS (SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE 'Found ' || id END AS title, CASE WHEN id % 5 = 0 THEN 'Jane Doe' ELSE '' END AS author, CASE WHEN id % 7 = 0 THEN 'Site' END AS site_name, CASE WHEN id % 3 = 0 THEN fetched_at END AS published_date, CASE WHEN id % 4 = 1 THEN 'New' ELSE '' END AS excerpt,
  CASE WHEN id % 6 <> 0 THEN '<p>new</p>' END AS content_html, 'text ' || id AS text_content, CASE WHEN id % 8 = 1 THEN 'https://i.example/x' END AS lead_image_url, CASE WHEN id % 9 <> 0 THEN word_count + 7 END AS word_count, 0.9::DOUBLE AS quality, CASE WHEN id % 10 = 1 THEN 'math' END AS topic, CASE WHEN id % 10 = 1 THEN 0.8::DOUBLE END AS topic_relevance FROM articles WHERE id % 4 <> 0)
SELECT o.id, coalesce(nullif(p.title, ''), o.title) AS title, coalesce(nullif(p.author, ''), o.author) AS author, coalesce(nullif(lower(p.author), ''), o.author_key) AS author_key, coalesce(nullif(p.site_name, ''), o.site_name) AS site_name, coalesce(o.published_date, p.published_date) AS published_date,
  coalesce(nullif(p.excerpt, ''), o.excerpt) AS excerpt, CASE WHEN p.id IS NULL THEN o.content_html ELSE coalesce(p.content_html, '') END AS content_html, CASE WHEN p.id IS NULL THEN o.text_content ELSE p.text_content END AS text_content, CASE WHEN p.id IS NULL THEN o.lead_image_url ELSE coalesce(p.lead_image_url, '') END AS lead_image_url,
  CASE WHEN p.id IS NULL THEN o.word_count ELSE coalesce(p.word_count, 0) END AS word_count, coalesce(p.quality, o.quality) AS quality, coalesce(p.topic, o.topic) AS topic, coalesce(p.topic_relevance, o.topic_relevance) AS topic_relevance FROM old o LEFT JOIN p ON p.id = o.id""", "articles"))
def patch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after extraction, all fields that it finds."""
    a, i = views.articles(spark, sf_dir), F.col("id")
    old = a.select("id", "title", F.col("author_key").alias("author"), "author_key", F.col("site_domain").alias("site_name"), "published_date", F.lit("old").alias("excerpt"), F.lit("<p>old</p>").alias("content_html"), F.lit("old").alias("text_content"), F.lit("").alias("lead_image_url"), "word_count", "quality", "topic", "topic_relevance")
    found = a.where(i % 4 != 0).select(
        "id", F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("Found "), i.cast("string"))).alias("title"), F.when(i % 5 == 0, "By Jane Doe").otherwise("Posted on").alias("author"), F.when(i % 7 == 0, "Site").alias("site_name"), F.when(i % 3 == 0, F.col("fetched_at")).alias("published_date"), F.when(i % 4 == 1, "New").otherwise("").alias("excerpt"),
        F.when(i % 6 != 0, "<p>new</p>").alias("content_html"), F.concat(F.lit("text "), i.cast("string")).alias("text_content"), F.when(i % 8 == 1, "https://i.example/x").alias("lead_image_url"), F.when(i % 9 != 0, F.col("word_count") + 7).alias("word_count"), F.lit(0.9).alias("quality"), F.when(i % 10 == 1, "math").alias("topic"), F.when(i % 10 == 1, 0.8).alias("topic_relevance"),
    )
    return state.patch_contents(old, found)


@query(with_views("SELECT id, CASE WHEN id IN (SELECT event_id % 500 FROM events WHERE event_type = 'error') THEN -1 ELSE word_count END AS word_count FROM articles", "articles"))
def failed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after failed extractions."""
    failed = _events(spark, sf_dir).where("event_type = 'error'").select((F.col("event_id") % 500).alias("id"))
    return state.mark_failed(views.articles(spark, sf_dir).select("id", "word_count"), failed)


@query("""WITH w AS (SELECT 'author-' || user_id AS author_key, arg_max(event_type = 'error', event_id) AS is_muted, max(epoch_us(ts) // 1000) FILTER (event_type = 'error') AS muted_at FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id)
SELECT author_key, muted_at, row_number() OVER (ORDER BY muted_at DESC, author_key) AS place FROM w WHERE is_muted QUALIFY place <= 100""")
def muted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred authors muted last, newest first: one screen of the list."""
    log = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup")).select(F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key"), "event_id", "at", (F.col("event_type") == "error").alias("is_muted"))
    muted = log.groupBy("author_key").agg(F.max_by("is_muted", "event_id").alias("is_muted"), F.max(F.when(F.col("is_muted"), F.col("at"))).alias("muted_at")).where("is_muted")
    return reports.first_rows(muted, 100, F.col("muted_at").desc(), F.col("author_key")).select("author_key", "muted_at", "place")


@query(with_views("SELECT id, title, read_at, row_number() OVER (ORDER BY read_at DESC NULLS LAST, id) AS place FROM articles WHERE is_bookmarked = 1 QUALIFY place <= 100", "articles"))
def bookmark_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred bookmarks read last, newest first: one screen of the list."""
    rows = views.articles(spark, sf_dir).where("is_bookmarked = 1")
    return reports.first_rows(rows, 100, F.col("read_at").desc_nulls_last(), F.col("id")).select("id", "title", "read_at", "place")


@query(with_views("""--+ l AS (SELECT substr(d.source, 4, 9)::BIGINT AS source_id, x.doc_id AS id, quality FROM labels x JOIN documents d ON d.doc_id = x.doc_id)
SELECT id FROM l WHERE source_id IS NOT NULL AND quality = 0 AND id NOT IN (SELECT id FROM articles WHERE is_read = 1 OR is_bookmarked = 1)""", "articles"))
def swipe_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that leave the queue when their author is muted or they are swiped away: neither read nor kept."""
    docs = views.table(spark, sf_dir, "documents").where("source is not null").select("doc_id")
    swiped = views.table(spark, sf_dir, "labels").where("quality = 0").join(docs, "doc_id").select(F.col("doc_id").alias("id"))
    kept = views.articles(spark, sf_dir).where("is_read = 1 or is_bookmarked = 1").select("id")
    return swiped.join(kept, "id", "left_anti")


@query(with_views("""SELECT id, CASE WHEN is_bookmarked = 0 AND is_read = 1 AND coalesce(read_at, fetched_at) < 1706745600000 - 30 * 86400000::BIGINT THEN '' ELSE text_content END AS text_content FROM articles
WHERE NOT (is_bookmarked = 0 AND is_read = 0 AND word_count <= 0 AND fetched_at < 1706745600000 - 45 * 86400000::BIGINT)""", "articles"))
def prune_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after the retention rules."""
    return state.pruned(views.articles(spark, sf_dir, text=True)).select("id", "text_content")


@query(with_views("""SELECT id FROM articles WHERE NOT ((SELECT sum(octet_length(encode(text_content))) FROM articles) > 1000000 AND id IN (SELECT id FROM articles WHERE is_bookmarked = 0 AND is_read = 1 ORDER BY coalesce(read_at, fetched_at), id LIMIT 200))""", "articles"))
def ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles left once the texts pass a million bytes."""
    return state.under_ceiling(views.articles(spark, sf_dir, text=True), 1_000_000).select("id")
