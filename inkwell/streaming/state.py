"""Incremental forms of the state operators.

Files of events arrive as a stream. Reads become exposures; checks of a source become its polling interval and its
failures. State is kept per key and checkpointed; a lost executor replays from the last batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from inkwell.sources.shared import delete_at_exit, shared_dir
from inkwell.sources.views import epoch_ms


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """Events of the Parquet files of a folder as they come; `at` in epoch milliseconds, `ts` with a time zone."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return raw.withColumn("at", epoch_ms(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp"))


def reads_of(events: DataFrame) -> DataFrame:
    """Views and clicks as reads of (reader, article_id)."""
    return events.where(F.col("event_type").isin("view", "click")).select("ts", "at", F.col("user_id").alias("reader"), (F.col("event_id") % 500).alias("article_id"), F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key"), F.concat(F.lit("publication-"), (F.col("event_id") % 10).cast("string"), F.lit(".example")).alias("domain"))


def first_reads(reads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reads of an article by a reader once; a repeat after the watermark has passed counts again.

    The batch operator knows no such bound; this one trades it for state that doesn't grow for ever.
    """
    return reads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["reader", "article_id"])


def exposures(reads: DataFrame) -> DataFrame:
    """(kind, key, exposure_count, last_exposed_at) as of each batch, for update or complete mode."""
    both = reads.select("at", F.explode(F.array(F.struct(F.lit("author").alias("kind"), F.col("author_key").alias("key")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("key")))).alias("i"))
    return both.where("i.key <> ''").groupBy("i.kind", "i.key").agg(F.count("*").alias("exposure_count"), F.max("at").alias("last_exposed_at"))


def windowed_reads(reads: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Reads per author and tumbling window, given out when the watermark closes the window."""
    return reads.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "author_key").agg(F.count("*").alias("reads")).select(F.col("w.start").alias("start"), "author_key", "reads")


_OUT = "source_id long, interval_hours double, failures long, status string, last_at long"
_STATE = "interval double, failures long, last_at long"


def polling(checks: DataFrame, start_hours: float = 24.0, dead_at: int = 8, forget_ms: int | None = None) -> DataFrame:
    """Interval, failures and status of each source after each batch of checks (source_id, seq, at, new_entries, ok).

    Within a batch a source's checks count in the order of seq. A source without a check for forget_ms milliseconds is
    forgotten and starts anew; None: never.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hours, failed, last = state.get if state.exists else (start_hours, 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for check in rows.itertuples():
            if not check.ok:
                failed += 1
                last = int(check.at)
                continue
            failed = 0
            gap = (check.at - last) / 3_600_000 if last >= 0 else None
            if check.new_entries > 0 and gap is not None:
                hours = gap if 0.5 <= gap <= 720 else hours
            else:
                hours *= 1.3
            hours = max(0.5, min(hours, 168.0))
            last = int(check.at)
        state.update((float(hours), int(failed), int(last)))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        status = "active" if not failed else "dead" if failed >= dead_at else "failing"
        yield pd.DataFrame([(key[0], hours, failed, status, last)], columns=["source_id", "interval_hours", "failures", "status", "last_at"])

    return checks.groupBy("source_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def run_to_end(frame: DataFrame, *keys: str) -> DataFrame:
    """Run a stream over what is there now and give the last row of every key.

    Each batch writes the rows it changed to the shared folder, under its number, so a batch that is run again replaces
    its own; nothing is collected, and no batch writes the whole state.
    """
    spark = frame.sparkSession
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{run}/out/part={number}")

    q = frame.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    delete_at_exit(spark, run)
    rest = [c for c in frame.columns if c not in keys]
    rows = spark.read.schema(frame.select("*", F.lit(0).cast("long").alias("_batch")).schema).parquet(f"{run}/out/*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")
