"""Crawling as tables: what to fetch, what entries enter, what probes find, and where the small states live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import topics, urls
from inkwell.functions.hn import article_score
from inkwell.operators.session import first_of_each_domain
from inkwell.operators.state import upsert_articles
from inkwell.sources import pages as page_source
from inkwell.sources.feeds import alternate_links, entries, is_feed
from inkwell.sources.views import AS_OF, DAY, HOUR

# Entries a feed or an aggregator gives at once, stories of a batch, their score, ages, bounds and paths.
FIRST_ENTRIES, DEALT_ENTRIES, STORIES = 12, 24, 36
STORY_SCORE = 0.45
INGEST_DAYS, REMINE_DAYS, CHANNEL_HOURS = 60, 14, 12
MOST_BYTES, HOST_GAP_MS = 3 * 1024 * 1024, 1000
BLOGROLL_PATHS = ["/", "/about/", "/links/", "/blogroll/", "/reading/"]


def fetch(requests: DataFrame, stored: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(url, ok, status, text, etag) of requests (url, etag) answered from stored pages (url, text, etag).

    The offline twin of a conditional GET: an unchanged page is 304 without text, a page over most_bytes 413, one that
    isn't there 404.
    """
    have = stored.select("url", F.col("text").alias("_text"), F.col("etag").alias("_etag"))
    rows = requests.select("url", "etag").join(have, "url", "left")
    status = F.when(F.col("_text").isNull(), 404).when(F.col("etag") == F.col("_etag"), 304).when(F.octet_length("_text") > most_bytes, 413).otherwise(200)
    rows = rows.withColumn("status", status)
    text = F.when(F.col("status") == 200, F.col("_text")).otherwise("")
    return rows.select("url", F.col("status").isin(200, 304).alias("ok"), "status", text.alias("text"), F.when(F.col("status") != 413, F.col("_etag")).alias("etag"))


def host_schedule(requests: DataFrame, gap_ms: int = HOST_GAP_MS) -> DataFrame:
    """requests (url, position) with host, turn and start_ms: a host's requests follow each other gap_ms apart, hosts in parallel."""
    rows = requests.withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit("unknown")))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("position", "url")).cast("long"))
    return rows.withColumn("start_ms", (F.col("turn") - 1) * gap_ms)


def by_oldest_fetch(sources: DataFrame, limit: int = 100) -> DataFrame:
    """The live sources that were fetched longest ago, never fetched ones first."""
    return sources.where(F.col("status").isin("active", "failing")).orderBy(F.col("last_fetched_at").asc_nulls_first(), "id").limit(limit)


def fresh_entries(entries: DataFrame, now: int = AS_OF, days: int = INGEST_DAYS) -> DataFrame:
    """Entries (title, published) that may enter: no round-ups, and none dated before the gate; undated ones stay."""
    stale = F.col("published").isNotNull() & (F.col("published") < now - days * DAY)
    return entries.where(~topics.is_roundup(F.col("title")) & ~stale)


def entries_by_origin(entries: DataFrame, first: int = FIRST_ENTRIES, dealt: int = DEALT_ENTRIES) -> DataFrame:
    """Of each source (source_id, origin, position, domain) the first entries; of an aggregator its domains' in turn. Adds slot."""
    source = Window.partitionBy("source_id")
    own = entries.where("origin <> 'aggregator'").withColumn("slot", F.row_number().over(source.orderBy("position"))).where(F.col("slot") <= first)
    mixed = entries.where("origin = 'aggregator'").withColumn("_round", F.row_number().over(Window.partitionBy("source_id", "domain").orderBy("position"))).where(F.col("_round") <= dealt)
    mixed = mixed.withColumn("_first", F.min("position").over(Window.partitionBy("source_id", "domain")))
    mixed = mixed.withColumn("slot", F.row_number().over(source.orderBy("_round", "_first"))).where(F.col("slot") <= dealt).drop("_round", "_first")
    return own.unionByName(mixed).withColumn("slot", F.col("slot").cast("long"))


def story_articles(stories: DataFrame, channel: str, selected: list[str]) -> DataFrame:
    """Article rows (source_id null) of a channel's stories: "stories" (url, title, published_at, points, is_front_page,
    slot), "small web" (url, title, author) or "forum" (url, title, published_at)."""
    site = urls.without_www(urls.host(F.col("url")))
    hint = selected[0] if len(selected) == 1 else "technology"
    topic = {"stories": "technology", "small web": hint, "forum": "economics"}[channel]
    rows = stories.where(F.col("slot") <= STORIES) if channel == "stories" else stories
    author = F.trim("author") if channel == "small web" else F.lit("")
    date: Column = F.lit(None).cast("long") if channel == "small web" else F.col("published_at")
    score = article_score(F.col("points"), F.col("is_front_page")) if channel == "stories" else F.lit(STORY_SCORE)
    return rows.where(site.isNotNull()).select(F.lit(None).cast("long").alias("source_id"), "url", F.trim("title").alias("title"), author.alias("author"), site.alias("site_name"), date.alias("published_date"), F.lit("").alias("excerpt"), F.lit(topic).alias("topic"), score.cast("double").alias("score"))


def small_web_stories(entries: DataFrame, selected: list[str], limit: int = 30) -> DataFrame:
    """The first article of every domain of a feed, without its date, on the one selected topic or technology."""
    fit = entries.where((F.trim("title") != "") & urls.is_article_path(F.col("url"))).withColumn("domain", urls.root_domain(urls.host(F.col("url"))))
    return first_of_each_domain(fit, limit).withColumn("topic", F.lit(selected[0] if len(selected) == 1 else "technology"))


def due_channels(channels: DataFrame, fetched: DataFrame, selected: list[str], now: int = AS_OF, hours: int = CHANNEL_HOURS) -> DataFrame:
    """Channels (channel_id, topic, url) of selected topics that were not fetched (channel_id, at) for some hours."""
    rows = channels.where(F.col("topic").isin(selected)).join(fetched.select("channel_id", "at"), "channel_id", "left")
    return rows.where(F.coalesce("at", F.lit(0)) <= now - hours * HOUR).drop("at")


def blogroll_links(sources: DataFrame, stored: DataFrame, mined: DataFrame, now: int = AS_OF, days: int = REMINE_DAYS) -> DataFrame:
    """(source_id, page, position, url, topic_hint): links of the first page there is of each live source's five, front pages
    of sites included. Sources mined (source_id, at) some days ago or less rest."""
    live = sources.where("status = 'active'").join(mined.select(F.col("source_id").alias("id"), "at"), "id", "left").where(F.col("at").isNull() | (F.col("at") <= now - days * DAY))
    root = F.regexp_extract("site_url", r"^([A-Za-z]+://[^/?#]+)", 1)
    tries = live.where(root != "").select(F.col("id").alias("source_id"), "topic", F.posexplode(F.transform(F.array(*map(F.lit, BLOGROLL_PATHS)), lambda p: F.concat(root, p))).alias("_try", "url"))
    found = tries.join(stored.select("url", "html"), "url").groupBy("source_id").agg(F.min_by(F.struct("url", "html", "topic"), "_try").alias("p"))
    links = page_source.outbound_links(found.select(F.col("source_id").alias("page_id"), "p.url", "p.html"), allow_root_paths=True)
    return links.withColumnRenamed("page_id", "source_id").drop("topic_hint").join(found.select("source_id", F.col("p.url").alias("page"), F.col("p.topic").alias("topic_hint")), "source_id")


def probe_evidence(candidates: DataFrame, sources: DataFrame, probes: DataFrame, entries: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(domain, allowed, known, failed, feed_url, entries, title, authors, duplicate) of candidate sites, for probe_outcomes.

    candidates: (domain); probes: (domain, feed_url, title, failed); entries: (domain, author) of the feeds found;
    duplicates: (domain) of those whose voice we carry. A site is known if a source's address is on it or below it.
    """
    hosts = sources.select(F.explode(F.array("site_url", "feed_url")).alias("u")).select(F.explode(_parents(urls.without_www(urls.host(F.col("u"))))).alias("domain")).distinct().withColumn("known", F.lit(True))
    name = F.lower(F.trim("author"))
    said = entries.groupBy("domain").agg(F.count("*").alias("entries"), F.countDistinct(F.when(name != "", name)).alias("authors"))
    rows = candidates.select("domain").join(hosts, "domain", "left").join(probes, "domain", "left").join(said, "domain", "left").join(duplicates.select("domain").distinct().withColumn("duplicate", F.lit(True)), "domain", "left")
    no = {c: F.coalesce(c, F.lit(False)).alias(c) for c in ("known", "failed", "duplicate")}
    return rows.select("domain", urls.classify(F.col("domain"))["allowed"].alias("allowed"), no["known"], no["failed"], "feed_url", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit(0)).alias("authors"), no["duplicate"])


def _parents(host: Column) -> Column:
    """A host and the hosts above it that still have a dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def kv_set(table: DataFrame, changes: DataFrame) -> DataFrame:
    """A table (key, value) after changes (key, value, seq): the last value of each key, kept ones as they are."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return table.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last)


def kv_json(table: DataFrame, key: str, schema: str) -> DataFrame:
    """(value) of a key whose value is JSON of a schema; no row without the key, null for what is no such JSON."""
    return table.where(F.col("key") == key).select(F.from_json("value", schema).alias("value"))


def save_pool(pool: DataFrame, where: str) -> None:
    """Write a candidate pool over the one at a path, in the shared folder or a store."""
    pool.write.mode("overwrite").parquet(where)


def load_pool(like: DataFrame, where: str) -> DataFrame:
    """The pool saved at a path, with the columns of like."""
    return like.sparkSession.read.schema(like.schema).parquet(where)


def as_json(rows: DataFrame) -> DataFrame:
    """(json) of every row: what the product's endpoints for slates, statistics and sources send."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


# Where feeds are looked for; the first four only, where a site's front page was read.
FEED_PATHS = ["/atom.xml", "/feed.xml", "/rss.xml", "/index.xml", "/feed/", "/feed", "/rss", "/blog/atom.xml", "/blog/feed.xml", "/blog/feed/", "/?feed=rss2", "/feeds/posts/default"]
SHORT_PATHS = 4


def discover_feeds(sites: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, feed_url) of sites (url) whose feed is among stored pages (url, text): the first that is a feed of what the
    front page links to as one, in its order, and then of the usual places."""
    fronts = sites.select("url").distinct().join(stored.select("url", F.col("text").alias("html")), "url", "left")
    links = alternate_links(fronts.where("html is not null"), "url", "html").withColumnRenamed("url", "site")
    root = F.regexp_extract("site", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    href = F.col("href")
    whole = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("site", "^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace("site", "[^/]*$", ""), href))
    told = links.select("site", F.substring_index(whole, "#", 1).alias("feed_url"), F.col("position").cast("long").alias("place"))
    usual = fronts.select(F.col("url").alias("site"), F.posexplode(F.slice(F.array(*map(F.lit, FEED_PATHS)), F.lit(1), F.when(F.col("html").isNotNull(), SHORT_PATHS).otherwise(len(FEED_PATHS)))).alias("k", "path"))
    usual = usual.where(root != "").select("site", F.concat(root, "path").alias("feed_url"), (F.col("k") + 1_000_000).cast("long").alias("place"))
    found = told.unionByName(usual).join(stored.where(is_feed(F.col("text"))).select(F.col("url").alias("feed_url")), "feed_url", "left_semi")
    return found.groupBy(F.col("site").alias("url")).agg(F.min_by("feed_url", "place").alias("feed_url"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, site_url, feed_url, topic, origin) of a catalog of feeds, a JSON list of objects; origin may be missing."""
    rows = spark.read.schema("name string, siteUrl string, feedUrl string, topic string, origin string").json(path, multiLine=True)
    return rows.select("name", F.col("siteUrl").alias("site_url"), F.col("feedUrl").alias("feed_url"), "topic", "origin")


def ingest_round(sources: DataFrame, documents: DataFrame, known: DataFrame, now: int = AS_OF) -> DataFrame:
    """Articles (url, title, author, published_date, inserted) after one round: of every source's feed document (source_id,
    xml) the entries that its origin gives at once, less those the gate keeps out, into the known articles."""
    each = entries(documents, "source_id").withColumnRenamed("feed_id", "source_id")
    each = each.join(sources.select(F.col("id").alias("source_id"), "origin"), "source_id").withColumn("domain", urls.root_domain(urls.host(F.col("url"))))
    new = fresh_entries(entries_by_origin(each), now)
    seq = F.col("source_id") * 1_000_000 + F.col("slot")
    return upsert_articles(known, new.select("url", "title", "author", F.col("published").alias("published_date"), seq.alias("seq")))
