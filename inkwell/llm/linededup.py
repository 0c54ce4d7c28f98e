"""Line dedup by winnowing over line hashes, in DataFrame operations only.

What goes: every line that lies in a run of lines with min_words words or more that also starts at an earlier place (by
document id, then line). So the first copy of everything stays, and nothing shorter goes. Lines are compared without
ASCII white space at their ends, by 128 bits of two hashes with different seeds; lines without a word neither count nor
break a run, and go if they lie inside one.

How it is found: a passage is the shortest run, from some line on, that has min_words words. The hash of the shortest
run with min_words / 2 words from a line on is the line's gram. In the window of grams that start within the next
min_words / 2 words the least is that line's fingerprint. Gram and window lie inside the passage, so equal passages have
equal fingerprints, and only lines whose fingerprint is that of two places or more are joined; the others cannot be
repeated. A match is extended to the left by the passages that start there, and to the right line by line up to the end
of the passage that starts a line later: each of these longer runs is looked up among all places, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, cut, release, text_key, unused

_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _hash(*columns: Column, seed: int = 1) -> Column:
    """A second 64-bit hash; the seed's own hash is the seed of the columns'."""
    return F.xxhash64(F.lit(seed), *columns)


def repeated_lines(docs: DataFrame, min_words: int = 50, doc_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(doc, first, last): disjoint ranges of 0-based lines with a word to delete. Rows with the same doc have the same text."""
    half = min_words // 2

    def marked(x: Column, i: Column) -> Column:
        bare = F.regexp_replace(x, _EDGES, "")
        return F.struct(i.alias("pos"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).cast("long").alias("n"), F.struct(F.xxhash64(bare).alias("a"), _hash(bare).alias("b")).alias("h"))

    line = F.transform(F.split(F.col(text_col), "\n"), marked)
    lines = docs.select(F.col(doc_col).alias("doc"), F.inline(F.filter(line, lambda x: x["n"] > 0)))
    in_doc = Window.partitionBy("doc").orderBy("pos")
    # A document that is given several times counts once.
    lines = lines.withColumn("again", F.lag("pos").over(in_doc)).where(F.col("again").isNull() | (F.col("again") != F.col("pos"))).drop("again")
    lines = lines.withColumn("start", F.coalesce(F.sum("n").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Starts rise strictly in a document, so a range of starts is a range of lines.
    ahead = Window.partitionBy("doc").orderBy("start")
    near, far = ahead.rangeBetween(0, half - 1), ahead.rangeBetween(0, min_words - 1)
    end = F.col("start") + F.col("n")
    lines = lines.withColumn("gram", F.when(F.max(end).over(near) - F.col("start") >= half, F.xxhash64(F.collect_list("h").over(near))))
    lines = lines.withColumn("low", F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(near)).withColumn("full", F.max(end).over(far) - F.col("start") >= min_words).withColumn("run", F.collect_list("h").over(far))
    lines = lines.withColumn("after", F.lead("run").over(in_doc)).withColumn("at", F.collect_list("pos").over(far)).withColumn("at_after", F.lead("at").over(in_doc)).withColumn("fresh", F.coalesce(F.col("low") != F.lag("low").over(in_doc), F.lit(True)))

    def on(own: str, later: str, kind: str):
        """A passage's array and what the passage a line later has beyond it."""
        return F.concat(own, F.coalesce(F.slice(later, F.size(own), F.size(later)), F.array().cast(f"array<{kind}>")))

    starts = cut(lines.where("full").select("doc", "pos", F.col("low.gram").alias("mark"), "fresh", F.size("run").alias("len"), on("run", "after", "struct<a:bigint,b:bigint>").alias("run"), on("at", "at_after", "int").alias("at")))
    marks = starts.groupBy("mark").agg(F.sum(F.col("fresh").cast("int")).alias("places")).where("places > 1").select("mark")
    seeds = starts.join(marks, "mark", "left_semi")
    runs = F.transform(F.sequence("len", F.size("run")), lambda n: F.struct(n.alias("n"), F.xxhash64(F.slice("run", F.lit(1), n)).alias("key"), _hash(F.slice("run", F.lit(1), n)).alias("check"), F.get("at", n - 1).alias("last")))
    runs = cut(seeds.select("doc", "pos", F.inline(runs)))
    firsts = cut(runs.groupBy("key", "check", "n").agg(F.min(F.struct("doc", "pos")).alias("a"), F.count("*").alias("k")).where("k > 1").drop("k"))
    later = runs.join(firsts, ["key", "check", "n"]).where(F.struct("doc", "pos") > F.struct("a.doc", "a.pos"))
    spans = later.select("doc", F.col("pos").alias("first"), "last")
    reach = F.max("last").over(_in_doc_by("first").rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.groupBy("doc", "first").agg(F.max("last").alias("last")).withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(_in_doc_by("first").rowsBetween(Window.unboundedPreceding, 0)))
    out = cut(islands.groupBy("doc", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island"))
    release(starts, runs, firsts)
    return out


def _in_doc_by(column: str):
    return Window.partitionBy("doc").orderBy(column)


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col freed of later repeated runs, and n_lines, n_removed (long): its lines, and those deleted.

    Further columns stay as they are. Documents that lose all their lines stay with an empty text. A null text stays
    null with 0 lines; the empty text is one line. Documents are in the order of their ids, those without an id last;
    of the same id, or without one, in that of a hash of the text. Rows equal in id and text are one document given
    several times, and all of them keep the same lines. An empty table gives no rows. Ranges of a document are merged
    before they meet its text, whose lines are then cut in one pass. That join is by sorted shuffle at every size: the
    ranges grow with the documents.
    """
    key, cuts = unused(docs, "_doc", "_cuts")
    rows = docs.select(text_key(docs, id_col, text_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    spans = repeated_lines(rows, min_words).groupBy(F.col("doc").alias(key)).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(cuts))
    joined = docs.join(spans.hint("merge"), text_key(docs, id_col, text_col) == F.col(key), "left").drop(key)
    lines = F.split(F.col(text_col), "\n")
    count = F.size(lines).cast("long")
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["last"] + 1))
    ends = F.concat(F.transform(cuts, lambda x: x["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    left = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate(cuts, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1), F.lit(0).cast("long"))
    return joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(count).cast("long")).withColumn("n_removed", gone).withColumn(text_col, left).drop(cuts)

