"""State transitions as functions from tables to tables: upserts, patches, folds over logs, pruning.

Order-dependent folds here are compositions of x -> clamp(a x + b, low, high). Two such steps make one of the same form,
so a log folds in blocks of consecutive entries first and over the blocks then; no task folds a whole key's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import texts
from inkwell.functions.basics import filled
from inkwell.sources.views import AS_OF, DAY

# The prior trust of a source by origin.
PRIORS = {"seed": 0.58, "outbound": 0.55, "hn": 0.54, "aggregator": 0.50}


def _map(a: Column, b: Column, low: Column, high: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), low.cast("double").alias("low"), high.cast("double").alias("high"))


def _then(f: Column, g: Column) -> Column:
    """The step g after the step f."""

    def through(x: Column) -> Column:
        # A bound may be infinite, and nothing times infinity is no number.
        return F.greatest(g["low"], F.least(g["high"], F.when(g["a"] == 0, 0.0).otherwise(g["a"] * x) + g["b"]))

    return _map(f["a"] * g["a"], g["a"] * f["b"] + g["b"], through(f["low"]), through(f["high"]))


def clamped_fold(log: DataFrame, key: str, seq: str, step: Column, start: Column, block: int = 4096) -> DataFrame:
    """(key, value): the steps of each key in the order of seq (an integer), applied to start (a column of key)."""
    wide = float("inf")
    same = _map(F.lit(1.0), F.lit(0.0), F.lit(-wide), F.lit(wide))

    def composed(steps: Column) -> Column:
        return F.aggregate(F.array_sort(F.collect_list(steps)), same, lambda f, x: _then(f, x["step"]))

    blocks = log.select(key, F.col(seq).alias("_seq"), F.floor(F.col(seq) / block).alias("_block"), step.alias("step")).groupBy(key, "_block").agg(composed(F.struct("_seq", "step")).alias("step"))
    whole = blocks.groupBy(key).agg(composed(F.struct(F.col("_block").alias("_seq"), "step")).alias("f"))
    return whole.select(key, F.greatest(F.col("f.low"), F.least(F.col("f.high"), F.col("f.a") * start + F.col("f.b"))).alias("value"))


def trust(log: DataFrame, start: Column) -> DataFrame:
    """(source_id, value): trust after articles of some quality, a moving mean within 0.3 and 0.85."""
    step = _map(F.lit(0.8), F.col("quality") * 0.2, F.lit(0.3), F.lit(0.85))
    return clamped_fold(log, "source_id", "seq", step, start)


def poll_interval(checks: DataFrame, start: Column, block: int = 4096) -> DataFrame:
    """(source_id, value): hours to the next check after (source_id, seq, at, new_entries).

    A check that brings something sets the hours since the one before, if those are 0.5 to 720; one that brings nothing,
    and the first, stretches the interval by 1.3; half an hour to a week bound it.
    """
    # The check before is in the same block of entries, or it is the last of the block before; no task sees a whole log.
    blocked = checks.withColumn("_block", F.floor(F.col("seq") / block))
    ends = blocked.groupBy("source_id", "_block").agg(F.max_by("at", "seq").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("source_id").orderBy("_block"))).drop("_end")
    before = F.coalesce(F.lag("at").over(Window.partitionBy("source_id", "_block").orderBy("seq")), "_before")
    rows = blocked.join(ends, ["source_id", "_block"]).withColumn("gap", (F.col("at") - before) / 3600000.0).drop("_block", "_before")
    fresh = (F.col("new_entries") > 0) & F.col("gap").isNotNull()
    usable = fresh & (F.col("gap") >= 0.5) & (F.col("gap") <= 720)
    a = F.when(usable, 0.0).when(fresh, 1.0).otherwise(1.3)
    return clamped_fold(rows, "source_id", "seq", _map(a, F.when(usable, F.col("gap")).otherwise(0.0), F.lit(0.5), F.lit(168.0)), start, block)


def failures(checks: DataFrame, dead_at: int = 8, retry_hours: int = 6) -> DataFrame:
    """(source_id, failures, status, next_check_at) after (source_id, seq, at, ok): failures since the last success, and when
    a source that failed last is tried again (null after a success, whose polling interval says it)."""
    good = checks.where("ok").groupBy("source_id").agg(F.max("seq").alias("last_ok"))
    bad = ~F.col("ok") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))
    after = checks.join(good, "source_id", "left").groupBy("source_id").agg(F.count_if(bad).alias("failures"), F.max_by("at", F.when(bad, F.col("seq"))).alias("last"))
    status = F.when(F.col("failures") == 0, "active").when(F.col("failures") >= dead_at, "dead").otherwise("failing")
    return after.select("source_id", "failures", status.alias("status"), F.when(F.col("failures") > 0, F.col("last") + retry_hours * 3600000).alias("next_check_at"))


def first_reads(log: DataFrame) -> DataFrame:
    """The first entry of each article in a log (article_id, seq, at): reading again changes nothing."""
    return log.groupBy("article_id").agg(F.min_by("at", "seq").alias("read_at"), F.min("seq").alias("seq"))


def last_word(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, value) with the value of each key's last entry."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def toggled(log: DataFrame) -> DataFrame:
    """(article_id, paragraph) that an odd number of toggles left on."""
    return log.groupBy("article_id", "paragraph").agg(F.count("*").alias("n")).where("n % 2 = 1").select("article_id", "paragraph")


def upsert_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """Sources by feed_url: new ones with the prior of their origin, known ones with a new name if it isn't empty.

    new: (feed_url, name, topic, origin, seq); of several entries for a feed the first inserts, and the last name counts.
    """
    offered = new.groupBy("feed_url").agg(F.min_by(F.struct("topic", "origin"), "seq").alias("f"), F.max_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("new_name"))
    prior = F.lit(0.5)
    for origin, value in PRIORS.items():
        prior = F.when(F.col("f.origin") == origin, value).otherwise(prior)
    joined = known.join(offered, "feed_url", "full")
    return joined.select("feed_url", F.coalesce("new_name", "name", F.lit("")).alias("name"), F.coalesce("topic", "f.topic").alias("topic"), F.coalesce("origin", "f.origin").alias("origin"), F.coalesce("score", prior).alias("score"))


def upsert_articles(known: DataFrame, new: DataFrame) -> DataFrame:
    """Articles by url: new ones as first offered; of known ones only empty fields are filled, from the first that has them.

    Both: (url, title, author, published_date); new has seq. What an insert leaves empty a later entry fills too.
    """

    def first_filled(c: str) -> Column:
        return F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(f"new_{c}")

    offered = new.groupBy("url").agg(first_filled("title"), first_filled("author"), F.min_by("published_date", F.when(F.col("published_date").isNotNull(), F.col("seq"))).alias("new_date"))
    joined = known.withColumn("_known", F.lit(True)).join(offered, "url", "full")
    return joined.select("url", *(F.coalesce(filled(F.col(c)), F.col(f"new_{c}"), F.col(c)).alias(c) for c in ("title", "author")), F.coalesce("published_date", "new_date").alias("published_date"), F.col("_known").isNull().alias("inserted"))


PATCHED = ["title", "author", "author_key", "site_name", "published_date", "excerpt", "content_html", "text_content", "lead_image_url", "word_count", "quality", "topic", "topic_relevance"]


def patch_contents(articles: DataFrame, patches: DataFrame) -> DataFrame:
    """Articles (id and PATCHED) with what extraction found: empty finds keep the old field, a date only fills a missing one,
    a byline is cleaned and its key follows it, topics keep their own where none was found; content, image, words and
    quality are replaced, by nothing if nothing was found."""
    given = [c for c in PATCHED if c != "author_key"]
    found = patches.select("id", F.lit(True).alias("_new"), *(F.col(c).alias(f"p_{c}") for c in given)).withColumn("p_author", texts.clean_author(F.coalesce("p_author", F.lit(""))))
    joined = articles.join(found, "id", "left")
    new = {c: F.coalesce(filled(F.col(f"p_{c}")), c) for c in ("title", "author", "site_name", "excerpt")}
    new["author_key"] = F.coalesce(filled(F.lower("p_author")), "author_key")
    new["published_date"] = F.coalesce("published_date", "p_published_date")
    new |= {c: F.coalesce(f"p_{c}", c) for c in ("topic", "topic_relevance")}
    new |= {c: F.when(F.col("_new"), F.coalesce(f"p_{c}", F.lit(nothing))).otherwise(F.col(c)) for c, nothing in (("content_html", ""), ("text_content", ""), ("lead_image_url", ""), ("word_count", 0), ("quality", 0.0))}
    return joined.select("id", *(new[c].alias(c) for c in PATCHED))


def mark_failed(articles: DataFrame, failed: DataFrame) -> DataFrame:
    """Articles whose extraction failed (id) get -1 words, which keeps them out of every pool and queue."""
    hit = failed.select("id").distinct().withColumn("_failed", F.lit(True))
    return articles.join(hit, "id", "left").withColumn("word_count", F.when(F.col("_failed"), F.lit(-1)).otherwise(F.col("word_count"))).drop("_failed")


def pruned(articles: DataFrame, now: int = AS_OF, text_days: int = 30, dead_days: int = 45) -> DataFrame:
    """Articles without stale texts of read ones, and without old ones that never got a text; bookmarks stay whole."""
    free = F.col("is_bookmarked") == 0
    stale = free & (F.col("is_read") == 1) & (F.coalesce("read_at", "fetched_at") < now - text_days * DAY)
    dead = free & (F.col("is_read") == 0) & (F.col("word_count") <= 0) & (F.col("fetched_at") < now - dead_days * DAY)
    return articles.where(~dead).withColumn("text_content", F.when(stale, "").otherwise(F.col("text_content")))


def under_ceiling(articles: DataFrame, ceiling: int, batch: int = 200) -> DataFrame:
    """Articles without the `batch` oldest read, unbookmarked ones, if all texts together are over the ceiling."""
    total = articles.agg(F.coalesce(F.sum(F.octet_length("text_content").cast("long")), F.lit(0)).alias("bytes")).where(F.col("bytes") > ceiling).select(F.lit(1).alias("_k"))
    old = articles.where("is_bookmarked = 0 and is_read = 1").orderBy(F.coalesce("read_at", "fetched_at"), "id").limit(batch)
    return articles.join(old.select("id", F.lit(1).alias("_k")).join(total, "_k").select("id"), "id", "left_anti")
