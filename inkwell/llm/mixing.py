"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, n_words

_ALL_BEFORE = (Window.unboundedPreceding, -1)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def target_words(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """Adds weight and target to a table (key, source, source_size) of one row per source.

    Sources by code point, null last, weigh as weights says, repeating. The targets add up to share of all sizes, in
    proportion to the weights, but stop at ceiling times the source's size; the excess is shared again by weight. That
    is one pass over the sources in the order of size per weight: those whose ceiling lies under the level that the
    ones before leave are full, the others share the rest. The windows see one row per source, never the documents.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("_full") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(*_ALL)
    total = F.sum("source_size").over(every).cast("double") * F.lit(share)
    out = out.withColumn("_full", F.col("source_size") * F.lit(ceiling)).withColumn("_total", total).withColumn("_weights", F.sum("weight").over(every))
    full_before = F.coalesce(F.sum("_full").over(order.rowsBetween(*_ALL_BEFORE)), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(order.rowsBetween(*_ALL_BEFORE)), F.lit(0))
    level = (F.col("_total") - full_before) / (F.col("_weights") - weight_before)
    out = out.withColumn("_capped", F.col("_full") / F.col("weight") < level)
    rest = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_full")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(every)
    shared = rest / F.when(open_weight > 0, open_weight) * F.col("weight")
    return out.withColumn("target", F.when(F.col("_capped"), F.col("_full").cast("double")).otherwise(shared)).drop("_full", "_total", "_weights", "_capped")


def sainte_lague(parties: DataFrame, votes: str, house: Column, within: list[str], tie: str) -> DataFrame:
    """Adds seats: the house's seats, per group of within, to the highest of the quotients votes / (2 i - 1).

    house must be the same in all rows of a group. With n parties the final divisor lies within n / 2 seats of the mean
    one, so the seats a party may or may not get lie in a window around its ideal share: three rows a party on average
    are ranked, whatever the house. Equal quotients go by tie. No votes in a group: no seats.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    rows = parties.withColumn("_n", F.count("*").over(group)).withColumn("_v", F.sum(F.col(votes)).over(group)).withColumn("_h", house.cast("long"))
    ideal = F.col("_h") * F.col(votes) / F.when(F.col("_v") > 0, F.col("_v"))
    slack = F.col("_n") / (F.lit(2) * F.greatest(F.col("_h"), F.lit(1)))
    low = F.greatest(F.lit(0), F.floor(ideal * (F.lit(1) - slack) - F.lit(1))).cast("long")
    high = F.least(F.col("_h"), F.ceil(ideal * (F.lit(1) + slack) + F.lit(1)).cast("long"))
    rows = rows.withColumn("_low", F.coalesce(low, F.lit(0))).withColumn("_high", F.coalesce(high, F.lit(0)))
    open_seats = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))
    keys = [*within, tie]
    seats = rows.withColumn("_open", F.col("_h") - F.sum("_low").over(group)).select(*keys, votes, "_open", F.explode(open_seats).alias("_i"))
    by_quotient = Window.partitionBy(*(within or [F.lit(0)])).orderBy((F.col(votes) / (F.lit(2) * F.col("_i") - F.lit(1))).desc(), tie, "_i")
    won = seats.withColumn("_rank", F.row_number().over(by_quotient)).where("_rank <= _open").groupBy(*keys).agg(F.count("*").alias("_won"))
    return rows.join(won, keys, "left").withColumn("seats", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_n", "_v", "_h", "_low", "_high", "_won")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: int = 2, block: int = 8, shards: int = 4, seed: int = 42, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, text_hash for each document: how many of its words the mix takes.

    size is the number of words. Targets: target_words(). Blocks of `block` words go to the sources by the highest
    quotients, round(total / block) in all, and each source's blocks to its shards in the same way by their sizes; a
    shard's quota is an integer of at most ceiling times its words. In a shard the documents stand in a seeded order
    and the quota's blocks are laid over them from the front, around and around, so whole documents come first, at
    most `ceiling` times, and one document at the end of the quota is taken in part.

    Null text: size 0, taken 0. Null source: a source of its own, the last. A document without an id has its place in the
    order by its text. Repeated rows each count; which of several equal rows is the one taken in part is not defined,
    the set of results is. source and text_hash (XXH64 of the text, null for null) tell rows that share an id apart;
    further columns are not carried. The weights and quotas are windows over one row per source, and per source and
    shard: fine for thousands of sources, not for a source per document. Running sums go over hash-ordered buckets, so no task sorts a whole source. An empty table gives no rows.
    """
    where = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col(text_col), F.lit(""))))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("text_hash"), where.alias("_at"))
    # The key stands for the source where null has to be equal to null.
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.withColumn("_shard", F.conv(F.substring("_at", 17, 8), 16, 10).cast("long") % shards).withColumn("_bucket", (F.conv(F.substring("_at", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    rows = cut(rows.select("doc_id", "source", "size", "text_hash", F.substring("_at", 1, 16).alias("_at"), "_key", "_shard", "_bucket"))
    parts = cut(rows.groupBy("_key", "source", "_shard", "_bucket").agg(F.sum("size").alias("_words")))
    sources = cut(target_words(parts.groupBy("_key", "source").agg(F.sum("_words").alias("source_size")), weights, share, ceiling))
    every = Window.orderBy(F.lit(1)).rowsBetween(*_ALL)
    quotas = sainte_lague(sources, "target", F.round(F.sum("source_size").over(every) * min(share, float(ceiling)) / block), [], "_key")
    quotas = cut(quotas.withColumnRenamed("seats", "_blocks"))
    strata = parts.groupBy("_key", "_shard").agg(F.sum("_words").alias("_stratum")).join(quotas.select("_key", "source_size", "target", "_blocks"), "_key")
    strata = sainte_lague(strata, "_stratum", F.col("_blocks"), ["_key"], "_shard")
    strata = strata.withColumn("_quota", F.least(F.col("seats"), F.floor(F.col("_stratum") * ceiling / block).cast("long")) * block)
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_key", "_shard").orderBy("_bucket").rowsBetween(*_ALL_BEFORE)), F.lit(0))
    placed = parts.withColumn("_base", before).select("_key", "_shard", "_bucket", "_base").join(strata.select("_key", "_shard", "source_size", "target", "_stratum", "_quota"), ["_key", "_shard"])
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("_key", "_shard", "_bucket").orderBy("_at", "size").rowsBetween(*_ALL_BEFORE)), F.lit(0))
    start = F.col("_base") + F.col("_inside")
    rounds = F.floor(F.col("_quota") / F.when(F.col("_stratum") > 0, F.col("_stratum"))).cast("long")
    part = F.col("_quota") - rounds * F.col("_stratum")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(start + F.col("size"), part) - start)
    out = rows.withColumn("_inside", inside).join(placed, ["_key", "_shard", "_bucket"])
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", "text_hash")
