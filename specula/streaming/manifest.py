"""Streams, an extension: manifest events deduplicated in a watermark, their counts by window, and boxes filled by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.functions.scalars import normalize_label, video_id_from_url


def new_records(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Source events (ts, source_url, label) with their video id; of one URL the first within the watermark."""
    rows = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_url"])
    return rows.withColumns({"video_id": video_id_from_url("source_url"), "label": normalize_label("label")})


def status_counts(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Manifest events (ts, status) counted by tumbling window; late ones within the delay still count."""
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "status", "n")


OUT = "video_id long, frame_id long, value double, source string"
STATE = "value double"


def filled(stream: DataFrame) -> DataFrame:
    """Detections (video_id, frame_id, value or null) with the last value of the video where there is none.

    The state of a video is one number. Frames that come in one trigger are put in order; a later trigger's frames follow.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame_id")
        out = []
        for frame, value in zip(rows["frame_id"], rows["value"]):
            known = pd.notna(value)
            last = float(value) if known else last
            out.append((key[0], frame, last, "detector" if known else "last_bbox" if last is not None else "fallback_center"))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["video_id", "frame_id", "value", "source"])

    rows = stream.select(F.col("video_id").cast("long").alias("video_id"), F.col("frame_id").cast("long").alias("frame_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("video_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
