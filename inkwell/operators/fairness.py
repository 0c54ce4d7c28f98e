"""Fair shares: round-robins over identities, topic quotas, identity caps and the joint domain cap."""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin_by(rows: DataFrame, key: str, position: str, limit: int, per_key: int | None = None) -> DataFrame:
    """The first of each key in the order keys appear, then the second of each, up to limit; adds round and slot.

    Keys take turns in the order of their first position, so the result is a sort by (round, first position). A key is
    cut at what it can give before its shuffle, so a key with a third of all rows sends a task few of them.
    """
    own = Window.partitionBy(key).orderBy(position)
    rows = rows.withColumn("round", F.row_number().over(own)).where(F.col("round") <= min(limit, limit if per_key is None else per_key))
    rows = rows.withColumn("_first", F.min(position).over(Window.partitionBy(key)))
    top = rows.orderBy("round", "_first").limit(limit)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("round", "_first"))).drop("_first")


def topic_quotas(counts: DataFrame, limit: int, topics: list[str]) -> DataFrame:
    """(topic, available, quota): seats dealt one by one to the topics in order, as long as each has candidates."""
    spark = counts.sparkSession
    order = spark.createDataFrame(list(enumerate(topics)), "place int, topic string")
    have = order.join(counts, "topic", "left").select("place", "topic", F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    seats = have.where("available > 0").select("place", "topic", F.explode(F.sequence(F.lit(1), F.least(F.col("available"), F.lit(limit)).cast("int"))).alias("turn"))
    won = seats.orderBy("turn", "place").limit(limit).groupBy("topic").agg(F.count("*").alias("quota"))
    return have.join(won, "topic", "left").select("topic", "available", F.coalesce("quota", F.lit(0)).alias("quota"))


def identity_cap(counts: DataFrame, limit: int) -> DataFrame:
    """(slots, cap): the least cap with which capped counts still fill the slots. counts: (key, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    slots = total.select(F.least(F.col("all"), F.lit(limit)).alias("slots"), F.least(F.col("most"), F.lit(limit)).alias("most"))
    # The sum of capped counts gains, from cap - 1 to cap, one for each count that reaches cap.
    reach = counts.select(F.least("n", F.lit(limit)).alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    steps = reach.withColumn("at_least", F.sum("k").over(Window.orderBy(F.col("n").desc()))).select(F.col("n").alias("cap"), "at_least")
    below = Window.orderBy("cap")
    steps = steps.withColumn("gap", F.col("cap") - F.coalesce(F.lag("cap").over(below), F.lit(0)))
    steps = steps.withColumn("filled", F.sum(F.col("gap") * F.col("at_least")).over(below))
    # Within a step each cap adds at_least; the last step's caps that are still enough follow by division.
    meets = steps.withColumn("_k", F.lit(1)).join(slots.select("slots", F.lit(1).alias("_k")), "_k").where(F.col("filled") >= F.col("slots")).groupBy("slots").agg(F.min_by(F.struct("cap", "at_least", "filled"), F.col("cap")).alias("s"))
    cap = F.col("s.cap") - F.floor((F.col("s.filled") - F.col("slots")) / F.col("s.at_least"))
    return slots.select("slots").join(meets.select(F.col("slots").alias("_slots"), cap.alias("cap")), F.col("slots") == F.col("_slots"), "left").select(F.col("slots").cast("long"), F.when(F.col("slots") == 0, 0).otherwise(F.col("cap")).cast("long").alias("cap"))


def domain_flow(pairs: DataFrame, demand: dict[str, int], caps: list[int]) -> DataFrame:
    """(cap, flow): the most cards that domains, capped, can give to the topics' demands. pairs: (domain, topic, n).

    The network has as many cuts as there are sets of topics, so the flow is the least of eight sums at most: for a set
    A the demands of A plus, over the domains, the smaller of the cap and their supply to the topics outside A.
    """
    topics = sorted(demand)
    wide = pairs.groupBy("domain").agg(*(F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("n"))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(topics)))
    wide = wide.select("*", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    cuts = []
    for inside in chain.from_iterable(combinations(range(len(topics)), k) for k in range(len(topics) + 1)):
        outside = [F.col(f"t{i}") for i in range(len(topics)) if i not in inside]
        supply: Column = F.lit(0)
        for c in outside:
            supply = supply + c
        cuts.append(F.sum(F.least(F.col("cap"), supply)) + F.lit(sum(demand[topics[i]] for i in inside)))
    return wide.groupBy("cap").agg(F.least(*cuts).cast("long").alias("flow"))


def fold_candidates(links: DataFrame, per_batch: int = 30, most: int = 600) -> DataFrame:
    """The pool of cited sites: (domain, count, sample_url, site_url, topic, origin, added_at).

    links: (batch, position, url, site_url, domain, topic, origin, at). Of a batch the first per_batch links count. The
    first citation gives a site its sample, an aggregator's last word its topic and origin; the most cited, then the
    newest stay.
    """
    used = links.withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy("position"))).where(F.col("_n") <= per_batch)
    when = F.struct("at", "batch", "position")
    told = F.col("origin") == "aggregator"
    pool = used.groupBy("domain").agg(F.count("*").alias("count"), F.min_by(F.struct("url", "site_url", "topic", "origin", "at"), when).alias("f"), F.max_by("topic", F.when(told, when)).alias("told_topic"))
    out = pool.select("domain", "count", F.col("f.url").alias("sample_url"), F.col("f.site_url").alias("site_url"), F.coalesce("told_topic", "f.topic").alias("topic"), F.when(F.col("told_topic").isNotNull(), "aggregator").otherwise(F.col("f.origin")).alias("origin"), F.col("f.at").alias("added_at"))
    return out.orderBy(F.col("count").desc(), F.col("added_at").desc(), "domain").limit(most)


def promotable(pool: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sites worth probing: not rejected before, and cited twice unless a topic's own channel named them."""
    return pool.join(rejected.select("domain"), "domain", "left_anti").where(F.col("origin").isin("aggregator", "hn") | (F.col("count") >= 2))


def hn_lanes(stories: DataFrame, limit: int = 12) -> DataFrame:
    """Stories for direct reading, with lane and slot: front page, then playful, then viral, one per domain; then any.

    stories: (url, domain, points, is_front_page, playfulness, selection_score, position), eligible and distinct by url.
    A later lane only sees domains that the ones before left, and each takes its best of every domain.
    """

    def lane(rows: DataFrame, name: str, keep: Column, order: list[Column], most: int, place: int) -> DataFrame:
        best = rows.where(keep).withColumn("_d", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where("_d = 1").drop("_d")
        top = best.orderBy(*order).limit(max(0, most))
        return top.withColumn("lane", F.lit(name)).withColumn("_lane", F.lit(place)).withColumn("_in", F.row_number().over(Window.orderBy(*order)))

    points, score, at = F.col("points").desc(), F.col("selection_score").desc(), F.col("position")
    taken = lane(stories, "front", F.col("is_front_page"), [points, at], max(1, limit - 4), 0)
    for name, keep, order, place in (("playful", F.col("playfulness") > 0, [score, at], 1), ("viral", F.lit(True), [points, score, at], 2)):
        rest = stories.join(taken.select("domain"), "domain", "left_anti")
        taken = taken.unionByName(lane(rest, name, keep, order, limit, place))
        taken = taken.orderBy("_lane", "_in").limit(limit)
    # The fill goes over the playful ones again, then over all; it may repeat domains.
    left = stories.join(taken.select("url"), "url", "left_anti")
    playful = F.when(F.col("playfulness") > 0, 0).otherwise(1)
    order = [playful, F.when(playful == 0, -F.col("selection_score")).otherwise(-F.col("points").cast("double")), -F.col("selection_score"), at]
    fill = left.orderBy(*order).limit(limit)
    fill = fill.withColumn("lane", F.lit("fill")).withColumn("_lane", F.lit(3)).withColumn("_in", F.row_number().over(Window.orderBy(*order)))
    out = taken.unionByName(fill).orderBy("_lane", "_in").limit(limit)
    return out.withColumn("slot", F.row_number().over(Window.orderBy("_lane", "_in"))).drop("_lane", "_in")


def duplicate_voices(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(candidate_id, source_id) of every candidate that is a voice we carry, with the least source it repeats.

    candidates: (candidate_id, name, domain); sources: (source_id, name, domain), names normalised. Equal names of 6
    characters and equal domains are equi-joins. Containment is one on n-grams: a name of 8 characters or more is in
    another only if all its runs of 8 characters are, so it is looked up by the one of them that the fewest names have; a
    common opening costs nothing. Names and domains are made distinct first, and a candidate gives one row.
    """

    def least(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min("source_id").alias("source_id"))

    def grams(names: DataFrame) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.length("name") - 7), lambda i: F.substring(F.col("name"), i, F.lit(8)))
        return names.where(F.length("name") >= 8).select("name", F.explode(F.array_distinct(runs)).alias("gram"))

    def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """(inner_name, name): distinct names of inner that lie in names of outer."""
        there = grams(outer)
        own = grams(inner).join(there.groupBy("gram").agg(F.count("*").alias("k")), "gram", "left")
        rare = own.groupBy("name").agg(F.min_by("gram", "k").alias("gram"), F.count_if(F.col("k").isNull()).alias("absent")).where("absent = 0")
        return rare.select(F.col("name").alias("inner_name"), "gram").join(there, "gram").where(F.contains("name", "inner_name")).select("inner_name", "name")

    carried = least(sources.where(F.length("name") >= 6), "name")
    names = candidates.select("name").distinct()
    same = names.join(carried, "name")
    held = contained(carried.select("name"), names).join(carried.withColumnRenamed("name", "inner_name"), "inner_name").select("name", "source_id")
    holding = contained(names, carried.select("name")).join(carried, "name").select(F.col("inner_name").alias("name"), "source_id")
    by_name = candidates.join(least(same.unionByName(held).unionByName(holding), "name"), "name").select("candidate_id", "source_id")
    by_domain = candidates.where("domain <> ''").join(least(sources, "domain"), "domain").select("candidate_id", "source_id")
    return least(by_name.union(by_domain), "candidate_id")
