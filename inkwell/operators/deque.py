"""The reader's deque: the pool it is drawn from, the window that is served, and when it is filled up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.topics import cluster
from inkwell.operators.ranking import Settings, exposure_cost, round_robin, with_exposure
from inkwell.operators.session import diversity_context
from inkwell.operators.slate import COLUMNS, build_slate, cards_of


def card_cluster() -> Column:
    return cluster(F.col("topic"), F.col("title"), F.col("domain"), F.col("source_name"), F.col("source_origin"))


def selected_topics(chosen: list[str] | None, known: tuple[str, ...]) -> tuple[str, ...]:
    """Chosen topics in their canonical order; all of them where no choice was made."""
    return known if chosen is None else tuple(t for t in known if t in chosen)


def deque_pool(rows: DataFrame, seen: DataFrame, queue: DataFrame, s: Settings, times: int = 10) -> DataFrame:
    """Candidates with cost and position: `times` windows by identities in turn, and of topics that have less than their share
    of a window in it, queued cards aside, a pool of their own; without queued cards, by exposure cost, then as drawn.

    rows: weighed(); seen: exposures(); queue: (id). The pool is at most (1 + topics) * times windows, whatever the table.
    """
    window = s.window[len(s.topics)]
    share, size = window // len(s.topics), window * times
    pool = round_robin(rows, size).withColumn("_place", F.col("position").cast("long"))
    held = queue.select("id").distinct()
    have = pool.join(held, "id", "left_anti").groupBy("topic").agg(F.count("*").alias("_have"))
    order = rows.sparkSession.createDataFrame(list(enumerate(s.topics)), "_t int, topic string")
    short = order.join(have, "topic", "left").where(F.coalesce("_have", F.lit(0)) < share).select("topic", "_t")
    own = round_robin(rows.join(short.select("topic"), "topic", "left_semi"), size, "topic").join(short, "topic")
    own = own.withColumn("_place", F.col("position") + (F.col("_t") + 1) * F.lit(size).cast("long"))
    both = pool.unionByName(own.join(pool.select("id"), "id", "left_anti").select(pool.columns)).join(held, "id", "left_anti")
    # Without any history all costs are zero, and the order is that of the draw.
    costed = with_exposure(both.drop("position"), seen).withColumn("cost", exposure_cost(s.now))
    return costed.withColumn("position", F.row_number().over(Window.orderBy("cost", "_place")).cast("long")).drop("_place")


def deque_window(rows: DataFrame, seen: DataFrame, queue: DataFrame, articles: DataFrame, sources: DataFrame, s: Settings, times: int = 10) -> DataFrame:
    """(position, id, topic, domain, author_key, cluster): the cards that come next.

    The cards continue what the reader has before them: the end of the queue (position, id), or the last cards read if the
    queue is empty and some candidate was shown before. articles: keyed(). One window is one small Python call.
    """
    pool = deque_pool(rows, seen, queue, s, times).withColumn("cluster", card_cluster())
    named = articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("origin").alias("source_origin")), "source_id", "left").withColumn("cluster", card_cluster())
    before = diversity_context(queue.select("position", "id"), named.select("id", "topic", "domain", "author_key", "cluster", "is_read", "read_at"))
    known = pool.where("author_count > 0 or domain_count > 0").select(F.lit(1).alias("_k")).limit(1).unionByName(queue.select(F.lit(1).alias("_k")).limit(1))
    before = before.withColumn("_k", F.lit(1)).join(known, "_k", "left_semi")
    limit, topics = s.window[len(s.topics)], list(s.topics)

    def build(key: tuple, cards: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
        slate = build_slate(cards_of(cards.sort_values("position")), limit, topics, cards_of(prior.sort_values("position")))
        return pd.DataFrame([(i, c.id, c.topic, c.domain, c.author, c.cluster) for i, c in enumerate(slate)], columns=["position", *COLUMNS])

    groups = [x.select(F.lit(0).alias("_g"), "position", *COLUMNS).groupBy("_g") for x in (pool, before)]
    return groups[0].cogroup(groups[1]).applyInPandas(build, "position long, id long, topic string, domain string, author_key string, cluster string")
