"""Jump consistent hashing of stable keys to shards, in DataFrame operations only.

The generator that the method fixes multiplies 64-bit keys with wrap-around. Under ANSI arithmetic a product that
leaves the long range is an error, so the product is put together from 16 and 32-bit parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value of the method: the multiplier of its linear congruential generator.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _times_low(x: Column, y: int) -> Column:
    """Low 32 bits of x * y, both of 32 bits."""
    return (x * F.lit(y & 0xFFFF) + F.shiftleft((x * F.lit(y >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def _step(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, as a signed long."""
    low, high = key.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, 32)
    m_low, m_high = MULTIPLIER & _LOW, MULTIPLIER >> 32
    first, second = low * F.lit(m_low & 0xFFFF), low * F.lit(m_low >> 16)
    rest = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(rest, 32) + F.shiftright(second, 16)
    top = (carry + _times_low(high, m_low) + _times_low(low, m_high)).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(top, 32).bitwiseOR(rest.bitwiseAND(F.lit(_LOW)))


def jump_shards(key: Column, *counts: int, steps: int = 64) -> list[Column]:
    """The shard of a long key for each number of shards; a null key counts as 0.

    The method walks a key-determined rising sequence of shard numbers and takes the last below the count. One walk
    serves all counts. It has at most max(counts) steps, about the logarithm of that on average, and a step after the end
    changes nothing. So every key walks `steps` steps, and only a key that isn't at its end then walks on.
    """
    if not counts or min(counts) < 1:
        raise ValueError("counts must be positive")
    start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.lit(0).cast("long").alias("j"), *(F.lit(-1).cast("long").alias(f"b{i}") for i in range(len(counts))))

    def walk(acc: Column, _: Column) -> Column:
        new = _step(acc["key"])
        draw = F.shiftrightunsigned(new, 33) + F.lit(1)
        ahead = F.floor((acc["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        reached = [F.when(acc["j"] < F.lit(n), acc["j"]).otherwise(acc[f"b{i}"]).alias(f"b{i}") for i, n in enumerate(counts)]
        done = acc["j"] >= F.lit(max(counts))
        return F.struct(F.when(done, acc["key"]).otherwise(new).alias("key"), F.when(done, acc["j"]).otherwise(ahead).alias("j"), *reached)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(max(counts), steps))), start, walk)
    if max(counts) > steps:
        rest = F.sequence(F.lit(steps + 1), F.lit(max(counts)))
        end = bind(end, lambda x: F.when(x["j"] < F.lit(max(counts)), F.aggregate(rest, x, walk)).otherwise(x))
    return [end[f"b{i}"].cast("int") for i in range(len(counts))]


def bind(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def gapless_slots(df: DataFrame, group: str, id_col: str, ties: list[str]) -> DataFrame:
    """Adds slot: 0, 1, 2, ... within each value of group, in the order of the MD5 of id_col, or of ties where it is null.

    No task sorts a whole group: the first three digits of the MD5 deal its rows to 4096 buckets that follow the order,
    and a slot is the rows of the buckets before plus the place in the bucket. The table of bucket sizes has at most
    4096 rows a group. Rows equal in id and ties may swap slots.
    """
    dealt = df.withColumn("_at", F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat_ws(":", F.lit("null"), *(F.col(c).cast("string") for c in ties))))).withColumn("_b", F.substring("_at", 1, 3))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "_b").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_at", *ties)) - 1)
    return placed.join(sizes, [group, "_b"]).withColumn("slot", (F.col("_base") + F.col("_place")).cast("long")).drop("_at", "_b", "_base", "_place")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of documents by key: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the number of shards decide alone; grown_shard is the shard with one more shard, so rows move only into
    the new one. size is the UTF-8 bytes plus 1. A null text has size 1 and the checksum of the empty text; a null id
    goes where key 0 goes. Equal ids go together, repeated rows keep a slot each, further columns are not carried.
    An empty table gives an empty result. Only id, size and checksum are shuffled, never the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    now, grown = jump_shards(F.col("doc_id"), shards, shards + 1)
    rows = rows.withColumn("shard", now).withColumn("grown_shard", grown)
    return gapless_slots(rows, "shard", "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
