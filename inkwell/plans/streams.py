"""Queries that run a stream to its end and give its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.oracle_views import with_views
from inkwell.plans.registry import query
from inkwell.streaming import state


@query(with_views("SELECT kind, key, exposure_count, last_exposed_at FROM exposures", "exposures"))
def stream_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures kept over the event stream; at its end they are the batch operator's."""
    path = f"{sf_dir}/events.parquet"
    events = state.event_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    return state.run_to_end(state.exposures(state.reads_of(events)), "kind", "key")


@query(with_views("SELECT user_id % 23 AS source_id, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1"))
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad checks of each source kept over the event stream."""
    path = f"{sf_dir}/events.parquet"
    events = state.event_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    counts = events.groupBy((F.col("user_id") % 23).alias("source_id")).agg(F.count_if(F.col("event_type") != "error").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return state.run_to_end(counts, "source_id")


@query("""WITH c AS (SELECT user_id % 23 AS source_id, event_id AS seq, epoch_us(ts) // 1000 AS ms, (event_type IN ('purchase', 'signup'))::INT AS fresh, event_type <> 'error' AS ok FROM events),
g AS (SELECT source_id, list({'hours': 24.0::DOUBLE, 'failed': 0::BIGINT, 'last': ms::BIGINT, 'ok': ok, 'fresh': fresh > 0} ORDER BY seq) AS xs FROM c GROUP BY source_id),
r AS (SELECT source_id, list_reduce(xs, lambda s, x: {'hours': CASE WHEN NOT x.ok THEN s.hours WHEN x.fresh AND s.last >= 0 THEN
    CASE WHEN (x.last - s.last) / 3600000.0::DOUBLE BETWEEN 0.5 AND 720 THEN greatest(0.5::DOUBLE, least(168.0::DOUBLE, (x.last - s.last) / 3600000.0::DOUBLE)) ELSE greatest(0.5::DOUBLE, least(168.0::DOUBLE, s.hours)) END
    ELSE greatest(0.5::DOUBLE, least(168.0::DOUBLE, s.hours * 1.3::DOUBLE)) END, 'failed': CASE WHEN x.ok THEN 0 ELSE s.failed + 1 END::BIGINT, 'last': x.last, 'ok': x.ok, 'fresh': x.fresh},
  {'hours': 24.0::DOUBLE, 'failed': 0::BIGINT, 'last': -1::BIGINT, 'ok': true, 'fresh': false}) AS s FROM g)
SELECT source_id, round(s.hours, 9) AS interval_hours, s.failed AS failures, CASE WHEN s.failed = 0 THEN 'active' WHEN s.failed >= 8 THEN 'dead' ELSE 'failing' END AS status, s.last AS last_at FROM r""")
def stream_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polling interval and failures of each source kept over the stream of its checks, with state per source."""
    path = f"{sf_dir}/events.parquet"
    events = state.event_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    checks = events.select((F.col("user_id") % 23).alias("source_id"), F.col("event_id").alias("seq"), "at", F.col("event_type").isin("purchase", "signup").cast("int").alias("new_entries"), (F.col("event_type") != "error").alias("ok"))
    return state.run_to_end(state.polling(checks), "source_id").withColumn("interval_hours", F.round("interval_hours", 9))
