"""Queries of discovery: feeds, story lists, cited sites and voices already carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import hn, texts, urls
from inkwell.operators import fairness
from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.plans.text import HEADLINES, q, qs
from inkwell.sources import feeds, pages, views


def _feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents of twenty entries each, made of the documents."""

    def escaped(x):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    i = F.col("id")
    item = F.concat(F.lit("<item><link>"), "url", F.lit("?utm_source=feed</link><title>"), escaped(F.col("title")), F.lit("</title><dc:creator>"), F.col("author_key"), F.lit("</dc:creator><pubDate>"), F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("fetched_at") / 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>"))
    rows = views.articles(spark, sf_dir).select(F.floor(i / 20).alias("feed_id"), F.struct(i.alias("k"), item.alias("x")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "")
    head = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed &amp; more</title><link>https://feed.example</link>'
    return rows.groupBy("feed_id").agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


@query(with_views(r"""--+ t AS (SELECT id, url, trim(regexp_replace(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) AS title, author_key AS author, fetched_at FROM articles)
SELECT id // 20 AS feed_id, 'Feed & more' AS feed_title, url, CASE WHEN title = '' THEN '(untitled)' ELSE title END AS title, author, fetched_at AS published FROM t""", "articles"))
def feed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as RSS and read back."""
    return feeds.entries(_feed_documents(spark, sf_dir)).select("feed_id", "feed_title", "url", "title", "author", "published")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom and RDF documents of ten entries each, made of the documents."""
    rows = views.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("n"), F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("i"))
    atom = F.concat(F.lit("<entry><title type='html'>&lt;b&gt;A&lt;/b&gt; "), "i", F.lit("</title><link rel='self' href='https://no.example'/><link href='https://a.example/p/"), "i", F.lit("#c'/><author><name>Ann "), "i", F.lit("</name></author>"), F.when(F.col("k") % 2 == 0, F.lit("<published>2024-01-02T03:04:05Z</published>")).otherwise(F.lit("")), F.lit("<updated>2024-01-03</updated></entry>"))
    rdf = F.concat(F.lit("<item><title>R "), "i", F.lit("</title><link>https://r.example/p/"), "i", F.lit("?utm_source=x&amp;a=1</link><dc:creator>Bo</dc:creator><dc:date>2024-01-02T00:00:00+00:00</dc:date></item>"))
    heads = {"atom": ('<feed xmlns="http://www.w3.org/2005/Atom"><title>An Atom</title><link href="https://a.example/"/>', "</feed>"), "rdf": ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>An RDF</title></channel>', "</rdf:RDF>")}

    def made(kind: str, item) -> DataFrame:
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("x")))), lambda s: s["x"]), "")
        documents = rows.groupBy("n").agg(F.concat(F.lit(heads[kind][0]), body, F.lit(heads[kind][1])).alias("xml"))
        return documents.select(F.concat(F.lit(f"{kind} "), F.col("n").cast("string")).alias("feed_id"), "xml")

    return made("atom", atom).unionByName(made("rdf", rdf))


@query("""SELECT 'atom ' || doc_id // 10 AS feed_id, 'An Atom' AS feed_title, 'https://a.example/' AS site_url, 'https://a.example/p/' || doc_id AS url, 'A ' || doc_id AS title, 'Ann ' || doc_id AS author, CASE WHEN doc_id % 2 = 0 THEN 1704164645000 ELSE 1704240000000 END AS published FROM documents
UNION ALL SELECT 'rdf ' || doc_id // 10, 'An RDF', '', 'https://r.example/p/' || doc_id || '?a=1', 'R ' || doc_id, 'Bo', 1704153600000 FROM documents""")
def feed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Atom and as RDF and read back."""
    return feeds.entries(_kinds(spark, sf_dir)).select("feed_id", "feed_title", "site_url", "url", "title", "author", "published")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON story lists of fifty stories each, made of the documents, read as stories."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://site-"), (i % 40).cast("string"), F.when(i % 31 == 0, ".edu").otherwise(".example"), F.when(i % 29 == 0, "/press/").otherwise("/post/"), (i % 700).cast("string"), F.lit("#top"))
    hit = F.struct(url.alias("url"), F.concat(views.pick(HEADLINES, i), F.lit(" no "), i.cast("string")).alias("title"), (F.lit(1700000000) + i).alias("created_at_i"), ((i * 7919) % 400).alias("points"), (i % 50).alias("num_comments"), F.when(i % 9 == 0, F.array(F.lit("story"), F.lit("front_page"))).otherwise(F.array(F.lit("story"))).alias("_tags"))
    rows = views.table(spark, sf_dir, "documents").select(F.floor(i / 50).alias("batch"), F.struct(i.alias("k"), hit.alias("h")).alias("s"))
    made = rows.groupBy("batch").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]).alias("hits"))).alias("json"))
    return feeds.stories(made)


_STORIES = f"""WITH raw AS (SELECT doc_id, 'https://site-' || (doc_id % 40) || CASE WHEN doc_id % 31 = 0 THEN '.edu' ELSE '.example' END || CASE WHEN doc_id % 29 = 0 THEN '/press/' ELSE '/post/' END || (doc_id % 700) AS url,
    {qs(HEADLINES)}[(doc_id % {len(HEADLINES)} + 1)::INT] || ' no ' || doc_id AS title, (1700000000 + doc_id) * 1000 AS published_at, doc_id * 7919 % 400 AS points, doc_id % 50 AS comments, doc_id % 9 = 0 AS is_front_page, doc_id // 50 * 1000000 + row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS position FROM documents),
stories AS (SELECT *, regexp_extract(url, '//([^/]*)', 1) AS domain, lower(title) AS low FROM raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) = 1),
scored AS (SELECT *, {" + ".join(f"CASE WHEN regexp_matches(low, {q(p)}) THEN {w} ELSE 0 END" for p, w in hn.PLAYFUL)} AS playfulness FROM stories)
"""


@query(_STORIES + "SELECT position, url, title, published_at, points, comments, is_front_page, playfulness, round(log2(greatest(1, points) + 1) + playfulness * 1.5::DOUBLE, 9) AS selection_score, CASE WHEN points <= 0 THEN 0.5::DOUBLE ELSE round(least(0.78::DOUBLE, 0.54::DOUBLE + 0.018::DOUBLE * log2(points + 1) + CASE WHEN is_front_page THEN 0.05::DOUBLE ELSE 0 END), 9) END AS article_score FROM scored")
def story_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories read from JSON with their scores."""
    return _stories(spark, sf_dir).select("position", "url", "title", "published_at", "points", "comments", "is_front_page", hn.playfulness(F.col("title")).alias("playfulness"), hn.selection_score(F.col("points"), F.col("title")).alias("selection_score"), hn.article_score(F.col("points"), F.col("is_front_page")).alias("article_score"))


@query(_STORIES + f"""--
, ok AS (SELECT *, round(log2(greatest(1, points) + 1) + playfulness * 1.5::DOUBLE, 9) AS selection_score FROM scored WHERE NOT ends_with(domain, '.edu') AND NOT contains(url, '/press/') AND len(regexp_extract_all(title, '\\S+')) >= 4 AND NOT regexp_matches(title, {q('(?i)' + hn.WIRE)})),
front0 AS (SELECT * FROM ok WHERE is_front_page QUALIFY row_number() OVER (PARTITION BY domain ORDER BY points DESC, position) = 1),
front AS (SELECT *, 0 AS lane_no, row_number() OVER (ORDER BY points DESC, position) AS n FROM front0 QUALIFY n <= 8),
play0 AS (SELECT * FROM ok WHERE playfulness > 0 AND domain NOT IN (SELECT domain FROM front) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY selection_score DESC, position) = 1),
play AS (SELECT *, 1 AS lane_no, row_number() OVER (ORDER BY selection_score DESC, position) AS n FROM play0),
two AS (SELECT * FROM (SELECT * FROM front UNION ALL SELECT * FROM play) ORDER BY lane_no, n LIMIT 12),
viral0 AS (SELECT * FROM ok WHERE domain NOT IN (SELECT domain FROM two) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY points DESC, selection_score DESC, position) = 1),
viral AS (SELECT *, 2 AS lane_no, row_number() OVER (ORDER BY points DESC, selection_score DESC, position) AS n FROM viral0),
three AS (SELECT * FROM (SELECT * FROM two UNION ALL SELECT * FROM viral) ORDER BY lane_no, n LIMIT 12)
SELECT url, points, playfulness, ['front', 'playful', 'viral'][lane_no + 1] AS lane, row_number() OVER (ORDER BY lane_no, n) AS slot FROM three""")
def hn_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve stories for direct reading."""
    rows = _stories(spark, sf_dir)
    fit = urls.classify(F.col("url"))["allowed"] & hn.is_readable(F.col("url"), F.col("title"))
    rows = rows.where(fit).withColumn("domain", urls.root_domain(urls.host(F.col("url")))).withColumn("playfulness", hn.playfulness(F.col("title"))).withColumn("selection_score", hn.selection_score(F.col("points"), F.col("title")))
    return fairness.hn_lanes(rows, 12).select("url", "points", "playfulness", "lane", F.col("slot").cast("long").alias("slot"))


_LINKS = """WITH links AS (SELECT event_id // 60 AS batch, event_id AS position, 'site-' || (user_id * 7 % 900) || '.example' AS domain, 'https://www.site-' || (user_id * 7 % 900) || '.example/blog/' || event_id AS url,
    ['technology', 'economics', 'math'][(event_id % 3 + 1)::INT] AS topic, ['outbound', 'hn', 'outbound', 'aggregator', 'outbound', 'outbound'][(event_id // 60 % 6 + 1)::INT] AS origin, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'click'),
used AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY batch ORDER BY position) <= 30),
pool AS (SELECT domain, count(*) AS count, arg_min(url, (ms, batch, position)) AS sample_url, arg_min(origin, (ms, batch, position)) AS first_origin, arg_min(topic, (ms, batch, position)) AS first_topic, arg_max(topic, (ms, batch, position)) FILTER (origin = 'aggregator') AS told, min(ms) AS added_at FROM used GROUP BY domain),
best AS (SELECT domain, count, sample_url, coalesce(told, first_topic) AS topic, CASE WHEN told IS NOT NULL THEN 'aggregator' ELSE first_origin END AS origin, added_at FROM pool ORDER BY count DESC, added_at DESC, domain LIMIT 600)
"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, name = F.col("event_id"), F.concat(F.lit("site-"), (F.col("user_id") * 7 % 900).cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://www."), name, F.lit("/blog/"), i.cast("string"))
    rows = views.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.floor(i / 60).alias("batch"), i.alias("position"), url.alias("url"), views.pick(["technology", "economics", "math"], i).alias("topic"), views.pick(["outbound", "hn", "outbound", "aggregator", "outbound", "outbound"], F.floor(i / 60)).alias("origin"), views.epoch_ms(F.col("ts")).alias("at"))
    rows = rows.withColumn("c", urls.candidate(F.col("url"))).select("*", "c.site_url", "c.domain")
    return fairness.fold_candidates(rows)


@query(_LINKS + "SELECT domain, count, sample_url, 'https://www.' || domain || '/blog/' || regexp_extract(sample_url, '([0-9]+)$', 1) AS site_check, topic, origin, added_at FROM best")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sites with their citations."""
    return _pool(spark, sf_dir).select("domain", "count", "sample_url", F.col("sample_url").alias("site_check"), "topic", "origin", "added_at")


@query(_LINKS + "SELECT domain, count, origin FROM best WHERE domain NOT IN (SELECT 'site-' || (i * 11) || '.example' FROM range(9) r(i)) AND (origin IN ('aggregator', 'hn') OR count >= 2)")
def candidate_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sites worth probing."""
    rejected = spark.range(9).select(F.concat(F.lit("site-"), (F.col("id") * 11).cast("string"), F.lit(".example")).alias("domain"))
    return fairness.promotable(_pool(spark, sf_dir), rejected).select("domain", "count", "origin")


@query(r"""WITH c AS (SELECT doc_id AS candidate_id, regexp_replace(lower('The ' || substr(text, 1, 14 + (doc_id % 12)::INT)), '[^a-z0-9]', '', 'g') AS name, 'site-' || (doc_id * 13 % 50021) || '.example' AS domain FROM documents),
s AS (SELECT doc_id AS source_id, regexp_replace(lower(substr(text, 1, 10 + (doc_id % 7)::INT)), '[^a-z0-9]', '', 'g') AS name, 'site-' || doc_id || '.example' AS domain FROM documents)
SELECT candidate_id, min(source_id) AS source_id FROM c, s WHERE (length(s.name) >= 6 AND (c.name = s.name OR (length(s.name) >= 8 AND length(c.name) >= 8 AND (contains(c.name, s.name) OR contains(s.name, c.name))))) OR c.domain = s.domain GROUP BY candidate_id""")
def duplicate_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are voices carried already, with the first source they repeat."""
    docs, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    new = docs.select(i.alias("candidate_id"), texts.normal_name(F.concat(F.lit("The "), F.substring(F.col("text"), F.lit(1), (F.lit(14) + i % 12).cast("int")))).alias("name"), F.concat(F.lit("site-"), (i * 13 % 50021).cast("string"), F.lit(".example")).alias("domain"))
    old = docs.select(i.alias("source_id"), texts.normal_name(F.substring(F.col("text"), F.lit(1), (F.lit(10) + i % 7).cast("int"))).alias("name"), F.concat(F.lit("site-"), i.cast("string"), F.lit(".example")).alias("domain"))
    return fairness.duplicate_voices(new, old)


@query(with_views("""SELECT id, name, status, next_check_at FROM sources WHERE status IN ('active', 'failing') AND (next_check_at IS NULL OR next_check_at <= 1706745600000) ORDER BY next_check_at NULLS FIRST, id LIMIT 8""", "sources"))
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight sources due longest; the limit is the feature."""
    rows = views.sources(spark, sf_dir).where(F.col("status").isin("active", "failing") & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= views.AS_OF)))
    return rows.orderBy(F.col("next_check_at").asc_nulls_first(), "id").limit(8).select("id", "name", "status", "next_check_at")


_OUT = r"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS own, regexp_extract(url, '^(https?)', 1) AS scheme, k,
  CASE k WHEN 3 THEN 'https://github.com/x/' || page_id WHEN 4 THEN '/local/' || page_id WHEN 5 THEN 'HTTPS://www.site-' || (page_id * 7 % 97) || '.example/a/' || page_id || '?q=1#f' WHEN 6 THEN 'https://site-' || (page_id % 50) || '.example/'
    WHEN 7 THEN '//cdn-' || page_id || '.example/post/x' WHEN 8 THEN 'https://site-1.example/tag/x' ELSE 'https://site-' || ((page_id * 7 + k // 2) % 97) || '.example/a/' || page_id END AS href FROM pages, (SELECT unnest(range(1, 9)) AS k)),
h AS (SELECT page_id, k, own, regexp_extract(regexp_replace(href, '^//', scheme || '://'), '^([A-Za-z]+)://([^/?#]+)([^?#]*)', ['scheme', 'host', 'path']) AS u FROM l WHERE k <> 4),
g AS (SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || u.path AS url, min(k) AS k FROM h
  WHERE lower(u.host) <> own AND u.host <> 'github.com' AND ({roots} u.path NOT IN ('', '/')) AND NOT regexp_matches(lower(u.path), '/(tag|tags|category|categories|author|archive|page|search)/') GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS position, url, '{hint}' AS topic_hint FROM g"""


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with eight links more, of every kind that the rules know."""
    i = F.col("page_id")

    def made(k):
        site = F.concat(F.lit("https://site-"), ((i * 7 + F.floor(k / 2)) % 97).cast("string"), F.lit(".example/a/"), i.cast("string"))
        href = F.when(k == 3, F.concat(F.lit("https://github.com/x/"), i.cast("string"))).when(k == 4, F.concat(F.lit("/local/"), i.cast("string"))).when(k == 5, F.concat(F.lit("HTTPS://www.site-"), (i * 7 % 97).cast("string"), F.lit(".example/a/"), i.cast("string"), F.lit("?q=1#f")))
        href = href.when(k == 6, F.concat(F.lit("https://site-"), (i % 50).cast("string"), F.lit(".example/"))).when(k == 7, F.concat(F.lit("//cdn-"), i.cast("string"), F.lit(".example/post/x"))).when(k == 8, F.lit("https://site-1.example/tag/x")).otherwise(site)
        return F.concat(F.lit('<p><a class="l" href="'), href, F.lit('">x</a></p>'))

    more = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), made), "")
    return views.table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", more).alias("html"))


@query(_OUT.format(roots="", hint="technology"))
def outbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to articles elsewhere."""
    return pages.outbound_links(_linked_pages(spark, sf_dir))


@query(_OUT.format(roots="u.path IN ('', '/') OR", hint="math"))
def outbound_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to articles and front pages elsewhere."""
    return pages.outbound_links(_linked_pages(spark, sf_dir), allow_root_paths=True, topic_hint="math")
