"""Queries of small text helpers, membership, merges and supply tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import hn, texts, urls
from inkwell.operators import ranking
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.plans.reports import S
from inkwell.sources import feeds, views


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 4000), '<[^>]*>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS x, len(regexp_extract_all(regexp_replace(substr(html, 1, 100000), '<[^>]*>', ' ', 'g'), '\S+')) AS words FROM pages)
SELECT page_id, words::BIGINT AS words, greatest(1, floor(words / 220.0::DOUBLE + 0.5))::INT AS minutes, CASE WHEN length(x) <= 300 THEN x ELSE regexp_replace(substr(x, 1, 297), '\s\S*$', '') || '…' END AS paragraph FROM p""")
def feed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, reading time and first paragraph of pages as feed summaries."""
    words = texts.summary_words(F.col("html")).cast("long")
    return views.table(spark, sf_dir, "pages").select("page_id", words.alias("words"), texts.read_minutes(words).alias("minutes"), texts.first_paragraph(F.col("html")).alias("paragraph"))


@query(with_views("SELECT id, name FROM sources WHERE feed_url ILIKE '%FEED1%' OR site_url ILIKE '%7.example%'", "sources"))
def like_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose addresses hold a string, in any case."""
    return views.sources(spark, sf_dir).where(F.col("feed_url").ilike("%FEED1%") | F.col("site_url").ilike("%7.example%")).select("id", "name")


@query(with_views("SELECT l.pos, k.id, k.domain FROM (SELECT unnest(range(50)) AS pos, unnest(list_transform(range(50), lambda i: (i * 37) % 191)) AS id) l JOIN keyed k ON k.id = l.id", "keyed"))
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a list of ids, in its order."""
    ids = spark.range(50).select(F.col("id").alias("pos"), ((F.col("id") * 37) % 191).alias("id"))
    return ids.join(ranking.keyed(views.articles(spark, sf_dir)).select("id", "domain"), "id").select("pos", "id", "domain")


@query(with_views("""--+ merged AS (SELECT kind, key, exposure_count AS n, last_exposed_at AS last FROM exposures UNION ALL SELECT kind, key, 7, 1700000000000 FROM exposures WHERE kind = 'author' UNION ALL SELECT 'author', 'author-new', 1, 5)
SELECT kind, key, max(n) AS exposure_count, max(last) AS last_exposed_at FROM merged GROUP BY kind, key""", "exposures"))
def merge_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exposure tables merged by the greater value."""
    seen = ranking.exposures(views.reads(spark, sf_dir))
    other = seen.where("kind = 'author'").withColumn("exposure_count", F.lit(7).cast("long")).withColumn("last_exposed_at", F.lit(1700000000000))
    new = spark.createDataFrame([("author", "author-new", 1, 5)], seen.schema)
    return seen.unionByName(other).unionByName(new).groupBy("kind", "key").agg(F.max("exposure_count").alias("exposure_count"), F.max("last_exposed_at").alias("last_exposed_at"))


@query(with_views("SELECT 'topic-voice' AS pair, topic AS a, voice AS b, count(*) AS n FROM eligible GROUP BY ALL UNION ALL SELECT 'topic-domain', topic, domain, count(*) FROM eligible GROUP BY ALL UNION ALL SELECT 'voice-domain', voice, domain, count(*) FROM eligible GROUP BY ALL", "eligible"))
def identity_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible articles by topic and voice, topic and domain, voice and domain, in one pass."""
    rows = ranking.servable(views.articles(spark, sf_dir), views.muted(spark, sf_dir), S)
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("topic", "voice"), ("topic", "domain"), ("voice", "domain")))))
    return rows.select(pairs.alias("p")).groupBy("p.pair", "p.a", "p.b").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT page_id, html || '<link rel="alternate" type="application/rss+xml" href="/feed?a=1&amp;b=' || page_id || '"><link rel=alternate type="text/xml" href=''/x.xml''><link rel="stylesheet" type="text/xml" href="/no"><link rel="alternate" type="text/html" href="/no2"><link rel="alternate" type="application/atom+xml" href="/feed?a=1&amp;b=' || page_id || '">' AS html FROM pages)
SELECT page_id, '/feed?a=1&b=' || page_id AS href FROM t UNION ALL SELECT page_id, '/x.xml' FROM t""")
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to their feeds."""
    i = F.col("page_id").cast("string")
    more = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed?a=1&amp;b='), i, F.lit('"><link rel=alternate type="text/xml" href=\'/x.xml\'><link rel="stylesheet" type="text/xml" href="/no"><link rel="alternate" type="text/html" href="/no2"><link rel="alternate" type="application/atom+xml" href="/feed?a=1&amp;b='), i, F.lit('">'))
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html"))
    return feeds.alternate_links(pages).select("page_id", "href")


_TITLES = "CASE doc_id % 4 WHEN 0 THEN 'The Podcast' WHEN 1 THEN 'Release Notes' WHEN 2 THEN 'Newsletter ' || doc_id ELSE 'A Blog - ' || substr(text, 1, 60) END"


@query(rf"SELECT doc_id, regexp_matches({_TITLES}, '(?i)podcast|archive|changelog|release notes|recent additions|\bnews\b|status|jobs|roadmap|press release') AS not_blog, regexp_replace(lower({_TITLES}), '[^a-z0-9]', '', 'g') AS name, contains(lower(substr(text, 1, 3000)), '<rss') OR contains(lower(substr(text, 1, 3000)), '<feed') OR contains(lower(substr(text, 1, 3000)), '<rdf:rdf') OR contains(lower(substr(text, 1, 3000)), '<?xml') AS is_feed FROM documents")
def feed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed titles that are no blog's, names to compare, and texts that look like feeds."""
    i = F.col("doc_id")
    title = F.when(i % 4 == 0, "The Podcast").when(i % 4 == 1, "Release Notes").when(i % 4 == 2, F.concat(F.lit("Newsletter "), i.cast("string"))).otherwise(F.concat(F.lit("A Blog - "), F.substring("text", 1, 60)))
    return views.table(spark, sf_dir, "documents").select("doc_id", title.rlike(hn.NOT_BLOG).alias("not_blog"), texts.normal_name(title).alias("name"), feeds.is_feed(F.col("text")).alias("is_feed"))


_RAW = ["noreply@mail.example (Jane Doe)", "?", " <b>Ann</b> Lee ", "bo@x.example(Bo Ray)", ""]


@query("SELECT doc_id, ['Jane Doe', '', 'Ann Lee', 'Bo Ray', ''][(doc_id % 5 + 1)::INT] AS author, CASE WHEN doc_id % 2 = 0 THEN 'host-' || doc_id || '.example' WHEN doc_id % 3 = 0 THEN 'Feed' ELSE 'Source' END AS site FROM documents")
def list_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bylines of aggregator lists and the names of the entries' publications."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://www.host-"), i.cast("string"), F.lit(".example/a"))
    name = texts.site_name(F.when(i % 2 == 0, "aggregator").otherwise("seed"), urls.host(url), F.when(i % 3 == 0, "Feed").otherwise(""), F.lit("Source"))
    return views.table(spark, sf_dir, "documents").select("doc_id", texts.list_author(views.pick(_RAW, i)).alias("author"), name.alias("site"))


@query("SELECT doc_id // 20 AS feed_id, 'site-' || (doc_id % 20) || '.example' AS domain, 'https://site-' || (doc_id % 20) || '.example/a/' || doc_id AS url FROM documents WHERE doc_id % 20 < 10 AND doc_id >= 0")
def forum_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that forum threads link to: ten sites a feed, each cited twice."""
    i = F.col("doc_id")
    own = F.concat(F.lit("https://site-"), (i % 20 % 10).cast("string"), F.lit(".example/a/"), i.cast("string"))
    html = F.concat(F.lit('<a href="https://www.reddit.com/r/x/1">t</a><a href="https://i.redd.it/p.png">p</a><a href="'), own, F.lit('#c">s</a>'))
    entries = views.table(spark, sf_dir, "documents").select(F.floor(i / 20).alias("feed_id"), i.alias("position"), F.lit("Thread").alias("title"), html.alias("summary"))
    return feeds.forum_stories(entries).select("feed_id", "domain", "url")
