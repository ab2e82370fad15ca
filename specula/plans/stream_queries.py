"""Queries that run the streams over events to the end of what is there, and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.plans.catalog_queries import _folder
from specula.streaming import manifest


def _events(spark, d):
    """events as a stream of files."""
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a pattern may name a single file


def _run(spark, stream, mode: str):
    """The rows that a stream wrote, the last ones where it writes all anew."""
    folder = _folder(spark, "stream")
    written = lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")
    query = stream.writeStream.foreachBatch(written).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _counts(spark, d):
    rows = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    return _run(spark, manifest.status_counts(rows, "1 day"), "complete").select(F.unix_seconds("start").alias("start"), "status", "n")


def _filled(spark, d):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return _run(spark, manifest.filled(_events(spark, d).select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), value.alias("value"))), "append")


QUERIES = {
    "stream_counts": (_counts, "SELECT (epoch(date_trunc('day', ts)))::BIGINT AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_fill": (
        _filled,
        """WITH e AS (SELECT user_id::BIGINT AS video_id, event_id::BIGINT AS frame_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
        f AS (SELECT video_id, frame_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e)
        SELECT video_id, frame_id, value, CASE WHEN v IS NOT NULL THEN 'detector' WHEN value IS NOT NULL THEN 'last_bbox' ELSE 'fallback_center' END AS source FROM f""",
    ),
}
