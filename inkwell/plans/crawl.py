"""Queries of fetching, ingesting and probing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import topics
from inkwell.operators import crawl, ranking, session
from inkwell.plans.discovery import _LINKS, _STORIES, _stories
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.plans.text import HEADLINES, q, qs
from inkwell.sources import feeds, views


@query("""WITH r AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN md5(html) ELSE 'old' END AS etag FROM pages WHERE page_id % 10 <> 9 UNION ALL SELECT 'https://gone.example/' || page_id, NULL FROM pages),
s AS (SELECT url, html, md5(html) AS etag FROM pages)
SELECT r.url, status IN (200, 304) AS ok, status, CASE WHEN status = 200 THEN html ELSE '' END AS text, CASE WHEN status <> 413 THEN new_etag END AS etag
FROM (SELECT r.url, s.html, s.etag AS new_etag, CASE WHEN s.html IS NULL THEN 404 WHEN r.etag = s.etag THEN 304 WHEN octet_length(encode(s.html)) > 5000 THEN 413 ELSE 200 END AS status FROM r LEFT JOIN s ON s.url = r.url) r""")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional fetches answered from the stored pages, those over five thousand bytes refused."""
    pages, i = views.table(spark, sf_dir, "pages"), F.col("page_id")
    stored = pages.select("url", F.col("html").alias("text"), F.md5("html").alias("etag"))
    wanted = pages.where(i % 10 != 9).select("url", F.when(i % 3 == 0, F.md5("html")).otherwise("old").alias("etag"))
    gone = pages.select(F.concat(F.lit("https://gone.example/"), i.cast("string")).alias("url"), F.lit(None).cast("string").alias("etag"))
    return crawl.fetch(wanted.unionByName(gone), stored, 5000)


@query("SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, row_number() OVER w AS turn, (row_number() OVER w - 1) * 1000 AS start_ms FROM pages WINDOW w AS (PARTITION BY lower(regexp_extract(url, '//([^/?#]*)', 1)) ORDER BY page_id, url)")
def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page may be asked for: one at a time and a second apart on a host."""
    requests = views.table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("position"))
    return crawl.host_schedule(requests).select("page_id", "host", "turn", "start_ms")


@query(with_views("SELECT id, status, last_fetched_at FROM sources WHERE status IN ('active', 'failing') ORDER BY last_fetched_at NULLS FIRST, id LIMIT 10", "sources"))
def oldest_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten live sources fetched longest ago; the limit is the feature."""
    return crawl.by_oldest_fetch(views.sources(spark, sf_dir), 10).select("id", "status", "last_fetched_at")


_ROUNDUP = " OR ".join(f"regexp_matches(title, {q('(?i)' + p)})" for p in topics.ROUNDUPS)


@query(f"""WITH e AS (SELECT doc_id AS id, {qs(HEADLINES)}[(doc_id % {len(HEADLINES)} + 1)::INT] AS title, CASE WHEN doc_id % 4 <> 0 THEN 1706745600000 - (doc_id % 90) * 86400000 END AS published FROM documents)
SELECT id, title, published FROM e WHERE NOT ({_ROUNDUP}) AND (published IS NULL OR published >= 1706745600000 - 60 * 86400000::BIGINT)""")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that may enter: no round-ups, nothing older than sixty days."""
    i = F.col("doc_id")
    entries = views.table(spark, sf_dir, "documents").select(i.alias("id"), views.pick(HEADLINES, i).alias("title"), F.when(i % 4 != 0, F.lit(views.AS_OF) - (i % 90) * views.DAY).alias("published"))
    return crawl.fresh_entries(entries)


@query(with_views("""--+ e AS (SELECT k.id, s.id AS source_id, s.origin, k.domain FROM keyed k JOIN sources s ON s.id = k.source_id),
own AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS slot FROM e WHERE origin <> 'aggregator' QUALIFY slot <= 12),
r AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id, domain ORDER BY id) AS n, min(id) OVER (PARTITION BY source_id, domain) AS f FROM e WHERE origin = 'aggregator'),
mixed AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY n, f) AS slot FROM r QUALIFY slot <= 24)
SELECT * FROM own UNION ALL SELECT * FROM mixed""", "keyed", "sources"))
def entries_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries each source gives at once: twelve, or twenty-four over an aggregator's domains in turn."""
    cards = ranking.keyed(views.articles(spark, sf_dir)).select("id", "source_id", "domain", F.col("id").alias("position"))
    return crawl.entries_by_origin(cards.join(views.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "origin"), "source_id")).select("id", "source_id", "slot")


@query(_STORIES + """, n AS (SELECT *, row_number() OVER (ORDER BY position) AS slot FROM scored)
SELECT NULL::BIGINT AS source_id, url, title, '' AS author, domain AS site_name, published_at AS published_date, '' AS excerpt, 'technology' AS topic,
  CASE WHEN points <= 0 THEN 0.5::DOUBLE ELSE round(least(0.78::DOUBLE, 0.54::DOUBLE + 0.018::DOUBLE * log2(points + 1) + CASE WHEN is_front_page THEN 0.05::DOUBLE ELSE 0 END), 9) END AS score FROM n WHERE slot <= 36
UNION ALL SELECT NULL, url, title, '', domain, published_at, '', 'economics', 0.45 FROM n""")
def ingested_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a batch of stories, at most thirty-six, and of a forum's."""
    from inkwell.operators.reports import first_rows

    stories = _stories(spark, sf_dir)
    first = first_rows(stories, crawl.STORIES, F.col("position")).withColumnRenamed("place", "slot")
    return crawl.story_articles(first, "stories", ["technology"]).unionByName(crawl.story_articles(stories, "forum", ["economics"]))


@query(with_views("""--+ e AS (SELECT id, url, trim(title, ' ') AS title, author_key, regexp_extract(url, '//([^/]*)', 1) AS domain FROM articles WHERE trim(title, ' ') <> ''),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id) = 1 ORDER BY id LIMIT 30)
SELECT NULL::BIGINT AS source_id, url, title, author_key AS author, domain AS site_name, NULL::BIGINT AS published_date, '' AS excerpt, 'math' AS topic, 0.45::DOUBLE AS score FROM f""", "articles"))
def ingested_small_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the first entries of thirty domains, for a reader of one topic; the limit is the feature."""
    entries = views.articles(spark, sf_dir).select(F.col("id").alias("position"), "url", "title", F.col("author_key").alias("author"))
    return crawl.story_articles(crawl.small_web_stories(entries, ["math"]), "small web", ["math"])


@query(with_views("""--+ k AS (SELECT url, title, author_key, 'publication-' || id || '.example' AS domain, id FROM articles),
c AS (SELECT * FROM (VALUES ('a', 'math', 1706745600000 - 43200000), ('b', 'economics', 1706745600000 - 43199999), ('c', 'math', NULL)) t(channel_id, topic, fetched)),
due AS (SELECT * FROM c WHERE topic = 'math' AND coalesce(fetched, 0) <= 1706745600000 - 43200000),
e AS (SELECT due.channel_id, due.topic, a.id, a.site_domain AS domain, a.url FROM due JOIN articles a ON ['a', 'b', 'c'][(a.id % 3 + 1)::INT] = due.channel_id WHERE site_domain <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY channel_id, domain ORDER BY id) AS n FROM e)
SELECT channel_id, topic, url, row_number() OVER (PARTITION BY channel_id ORDER BY id) AS slot FROM f WHERE n = 1 QUALIFY slot <= 30""", "articles"))
def channel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the community channels that are due: the first entry of thirty domains of each; the limit is the feature."""
    channels = spark.createDataFrame([("a", "math"), ("b", "economics"), ("c", "math")], "channel_id string, topic string")
    fetched = spark.createDataFrame([("a", views.AS_OF - 12 * views.HOUR), ("b", views.AS_OF - 12 * views.HOUR + 1)], "channel_id string, at long")
    due = crawl.due_channels(channels, fetched, ["math"])
    entries = views.articles(spark, sf_dir).where("site_domain <> ''").select(views.pick(["a", "b", "c"], F.col("id")).alias("channel_id"), F.col("id").alias("position"), F.col("site_domain").alias("domain"), "url")
    picked = crawl.entries_by_origin(entries.join(due, "channel_id").withColumnRenamed("channel_id", "source_id").withColumn("origin", F.lit("aggregator")), dealt=30)
    first = picked.join(picked.groupBy("source_id", "domain").agg(F.min("position").alias("position")), ["source_id", "domain", "position"])
    return first.select(F.col("source_id").alias("channel_id"), "topic", "url", "slot")


@query(with_views("""--+ live AS (SELECT * FROM sources WHERE status = 'active' AND NOT (id % 4 = 0 AND 1706745600000 - (id % 20) * 86400000 > 1706745600000 - 14 * 86400000::BIGINT)),
p AS (SELECT id AS source_id, topic, CASE WHEN id % 2 = 0 THEN site_url || '/about/' ELSE site_url || '/' END AS page FROM live WHERE id % 3 <> 0),
l AS (SELECT source_id, topic, page, k, CASE k WHEN 1 THEN 'https://friend-' || source_id || '.example/' WHEN 2 THEN 'https://other.example/essays/one' WHEN 3 THEN page ELSE 'https://friend-' || source_id || '.example/' END AS url FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT source_id, page, row_number() OVER (PARTITION BY source_id ORDER BY min(k)) AS position, url, topic AS topic_hint FROM l WHERE k <> 3 GROUP BY source_id, page, url, topic""", "sources"))
def blogroll_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages where live sources recommend others."""
    sources, i = views.sources(spark, sf_dir), F.col("id")
    stored = sources.where(i % 3 != 0).select(F.concat("site_url", F.when(i % 2 == 0, "/about/").otherwise("/")).alias("url"), F.concat(F.lit('<a href="https://friend-'), i.cast("string"), F.lit('.example/">f</a><a class=x href=\'https://other.example/essays/one?x=1\'>o</a><a href="/own/page">me</a><a href="https://friend-'), i.cast("string"), F.lit('.example/">again</a>')).alias("html"))
    later = sources.where((i % 2 == 0) & (i % 3 != 0)).select(F.concat("site_url", F.lit("/links/")).alias("url"), F.lit('<a href="https://late.example/post/x">l</a>').alias("html"))
    mined = sources.where(i % 4 == 0).select(i.alias("source_id"), (F.lit(views.AS_OF) - (i % 20) * views.DAY).alias("at"))
    return crawl.blogroll_links(sources, stored.unionByName(later), mined)


@query(with_views("""--+ c AS (SELECT DISTINCT CASE WHEN event_id % 40 = 7 THEN 'feed' || (user_id % 60) || '.example' WHEN event_id % 40 = 8 THEN 'school.edu' ELSE 'site-' || (user_id % 300) || '.example' END AS domain FROM events WHERE event_type = 'click'),
n AS (SELECT *, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS h FROM c),
e AS (SELECT domain, domain = 'school.edu' AS blocked, domain IN (SELECT 'feed' || id || '.example' FROM sources) AS known, h % 17 = 0 AS failed, h % 19 <> 0 AS has_feed, h % 9 AS entries, CASE WHEN h % 7 = 0 THEN 'The Podcast' ELSE 'Notes' END AS title, CASE WHEN h % 9 = 0 THEN 0 ELSE least(h % 9, h % 6 + 1) END AS authors, h % 23 = 0 AS duplicate FROM n),
o AS (SELECT domain, CASE WHEN blocked THEN 'blocked' WHEN known THEN 'known' WHEN failed THEN 'error' WHEN NOT has_feed OR entries < 2 THEN 'no-feed' WHEN title = 'The Podcast' OR authors >= 4 THEN 'blocked' WHEN duplicate THEN 'known' ELSE 'added' END AS outcome FROM e)
SELECT domain, outcome, outcome <> 'error' AS takes_slot FROM o""", "sources"))
def probed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of cited sites, from the evidence that their feeds' entries and our sources give."""
    i, u = F.col("event_id"), F.col("user_id")
    name = F.when(i % 40 == 7, F.concat(F.lit("feed"), (u % 60).cast("string"), F.lit(".example"))).when(i % 40 == 8, "school.edu").otherwise(F.concat(F.lit("site-"), (u % 300).cast("string"), F.lit(".example")))
    candidates = views.table(spark, sf_dir, "events").where("event_type = 'click'").select(name.alias("domain")).distinct()
    h = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")
    marked = candidates.withColumn("h", h)
    m = F.col("h")
    probes = marked.select("domain", F.when(m % 19 != 0, F.concat(F.lit("https://"), "domain", F.lit("/feed"))).alias("feed_url"), F.when(m % 7 == 0, "The Podcast").otherwise("Notes").alias("title"), (m % 17 == 0).alias("failed"))
    entries = marked.where(m % 9 > 0).select("domain", F.explode(F.sequence(F.lit(1).cast("long"), m % 9)).alias("k"), "h").select("domain", F.concat(F.lit(" Author "), (F.col("k") % (m % 6 + 1)).cast("string")).alias("author"))
    evidence = crawl.probe_evidence(candidates, views.sources(spark, sf_dir), probes, entries, marked.where(m % 23 == 0).select("domain"))
    return session.probe_outcomes(evidence)


@query("""WITH d AS (SELECT doc_id, 'Post ' || doc_id AS title, 'https://blog-' || (doc_id % 90) || '.example/p/' || (doc_id // 2) AS url FROM documents),
n AS (SELECT doc_id // 100 AS feed_id, doc_id, title, url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Ann ' || doc_id END AS author FROM d QUALIFY row_number() OVER (PARTITION BY doc_id // 100, url ORDER BY doc_id) = 1)
SELECT feed_id, 'EconAcademics' AS feed_title, url, title, author, CASE WHEN doc_id % 3 <> 0 THEN 1704153600000 END AS published FROM n QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY doc_id) <= 60""")
def aggregator_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregator's HTML lists read as entries, sixty of a list at most as the product has it."""
    i = F.col("doc_id")
    byline = F.when(i % 5 == 0, F.lit("?")).otherwise(F.concat(F.lit("bo@x.example (Ann "), i.cast("string"), F.lit(")")))
    date = F.when(i % 3 != 0, ", Tue, 02 Jan 2024 00:00:00 GMT").otherwise(", soon")
    item = F.concat(F.lit('<li class=x><b> <a rel=y href="https://blog-'), (i % 90).cast("string"), F.lit(".example/p/"), F.floor(i / 2).cast("string"), F.lit('?utm_source=e&amp;utm_medium=f">Post &amp;amp; '), i.cast("string"), F.lit("</a></b><br/>&nbsp;by "), byline, F.lit(" in <i>A Blog</i>"), date, F.lit('<br><blockquote>Said <a href="https://no.example/x">x</a></blockquote>'))
    lists = views.table(spark, sf_dir, "documents").select(F.floor(i / 100).alias("feed_id"), F.struct(i.alias("k"), item.alias("x")).alias("s")).groupBy("feed_id").agg(F.concat(F.lit("<html><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), ""), F.lit("</ul></html>")).alias("xml"))
    return feeds.entries(lists.withColumn("url", F.lit("https://www.econacademics.org/en.html")), url_col="url").select("feed_id", "feed_title", "url", "title", "author", "published")


@query("""WITH c AS (SELECT 'k' || (user_id % 50) AS key, event_id, value FROM events WHERE event_type = 'purchase'),
last AS (SELECT key, '{"n":' || arg_max(event_id, event_id) || '}' AS value FROM c GROUP BY key)
SELECT key, value FROM last UNION ALL SELECT 'k' || i, '{"n":-1}' FROM range(60) r(i) WHERE 'k' || i NOT IN (SELECT key FROM last)""")
def kv_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of keys and JSON values after a log of writes."""
    old = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit('{"n":-1}').alias("value"))
    log = views.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("key"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("value"), F.col("event_id").alias("seq"))
    return crawl.kv_set(old, log)


@query(with_views("""SELECT '{"id":' || id || ',"name":"' || name || '","status":"' || status || '","next_check_at":' || coalesce(next_check_at::VARCHAR, 'null') || '}' AS json FROM sources""", "sources"))
def sources_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as the JSON that an endpoint sends."""
    return crawl.as_json(views.sources(spark, sf_dir).select("id", "name", "status", "next_check_at"))


@query(_LINKS + "SELECT domain, count, sample_url, 'https://www.' || domain || '/blog' AS site_url, topic, origin, added_at FROM best")
def saved_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate pool after it was saved to the shared folder and loaded again."""
    import uuid

    from inkwell.plans.discovery import _pool
    from inkwell.sources.shared import delete_at_exit, shared_dir

    pool = _pool(spark, sf_dir)
    where = f"{shared_dir(spark)}/pool-{uuid.uuid4().hex}"
    crawl.save_pool(pool, where)
    delete_at_exit(spark, where)
    return crawl.load_pool(pool, where)




@query("""SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/own.xml?id=' || page_id WHEN 1 THEN 'https://other-' || page_id || '.example/rss' ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/feed.xml' END AS feed_url FROM pages WHERE page_id % 4 <> 3""")
def discovered_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of pages taken as sites: a link of their own, one elsewhere behind one that is none, or a usual place."""
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.lit("p"), F.col("page_id").cast("string"), F.lit("."), F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("url"), F.col("url").alias("_url"))
    i, root = F.col("page_id"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1)

    def link(href):
        return F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="'), href, F.lit('">'))

    other = F.concat(F.lit("https://other-"), i.cast("string"), F.lit(".example/rss"))
    html = F.when(i % 4 == 0, F.concat(link(F.lit("/gone.xml")), link(F.concat(F.lit("/own.xml?id="), i.cast("string"))))).when(i % 4 == 1, F.concat(link(F.lit("/page.html")), link(other))).otherwise("<p>none</p>")
    fronts = pages.select("url", html.alias("text"))
    feed = F.when(i % 4 == 0, F.concat(root, F.lit("/own.xml?id="), i.cast("string"))).when(i % 4 == 1, other).when(i % 4 == 2, F.concat(root, F.lit("/feed.xml"))).otherwise(F.concat(root, F.lit("/blog/feed/")))
    feeds_ = pages.select(feed.alias("url"), F.lit("<?xml version='1.0'?><rss></rss>").alias("text"))
    plain = pages.where(i % 4 == 1).select(F.concat(root, F.lit("/page.html")).alias("url"), F.lit("<html></html>").alias("text"))
    found = crawl.discover_feeds(pages.select("url"), fronts.unionByName(feeds_).unionByName(plain))
    named = found.join(pages, "url").select("page_id", F.col("_url").alias("url"), F.regexp_replace("feed_url", r"//p[0-9]+\.", "//").alias("feed_url"))
    return named


@query(with_views(f"""--+ e AS (SELECT a.id, 'https://site-' || (a.id % 30) || '.example/p/' || a.id AS url, {qs(HEADLINES)}[(a.id % {len(HEADLINES)} + 1)::INT] || ' ' || a.id AS title, s.id AS source_id, s.origin, 'site-' || (a.id % 30) || '.example' AS domain, CASE WHEN a.id % 4 <> 0 THEN 1706745600000 - (a.id % 90) * 86400000 END AS published
  FROM articles a JOIN sources s ON s.id = a.source_id),
own AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS slot FROM e WHERE origin <> 'aggregator' QUALIFY slot <= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, domain ORDER BY id) AS n, min(id) OVER (PARTITION BY source_id, domain) AS f FROM e WHERE origin = 'aggregator'),
mixed AS (SELECT * EXCLUDE (n, f), row_number() OVER (PARTITION BY source_id ORDER BY n, f) AS slot FROM r QUALIFY slot <= 24),
new AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM mixed) WHERE NOT ({_ROUNDUP}) AND (published IS NULL OR published >= 1706745600000 - 60 * 86400000::BIGINT)),
k AS (SELECT url, '' AS title, 'Known' AS author, NULL::BIGINT AS published_date FROM e WHERE id % 6 = 0)
SELECT coalesce(k.url, new.url) AS url, coalesce(nullif(k.title, ''), new.title, k.title) AS title, coalesce(nullif(k.author, ''), 'Ann') AS author, coalesce(k.published_date, new.published) AS published_date, k.url IS NULL AS inserted FROM k FULL JOIN new ON new.url = k.url""", "articles", "sources"))
def ingest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after a crawl of every source's feed."""
    i = F.col("id")
    a = views.articles(spark, sf_dir).where("source_id is not null").select("id", "source_id")
    url = F.concat(F.lit("https://site-"), (i % 30).cast("string"), F.lit(".example/p/"), i.cast("string"))
    date = F.when(i % 4 != 0, F.concat(F.lit("<dc:date>"), F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.lit(views.AS_OF) - (i % 90) * views.DAY) / 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</dc:date>"))).otherwise(F.lit(""))
    item = F.concat(F.lit("<item><link>"), url, F.lit("</link><title>"), views.pick(HEADLINES, i), F.lit(" "), i.cast("string"), F.lit("</title><dc:creator>Ann</dc:creator>"), date, F.lit("</item>"))
    made = a.select("source_id", F.struct(i.alias("k"), item.alias("x")).alias("s")).groupBy("source_id").agg(F.concat(F.lit('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>F</title>'), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), ""), F.lit("</channel></rss>")).alias("xml"))
    known = a.where(i % 6 == 0).select(url.alias("url"), F.lit("").alias("title"), F.lit("Known").alias("author"), F.lit(None).cast("long").alias("published_date"))
    return crawl.ingest_round(views.sources(spark, sf_dir), made, known)
